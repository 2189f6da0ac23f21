"""Problem 1: texts that look the same in different characters, brought to one form.

`canonical` maps a text to the form that all texts of the same look share:

* compatibility forms of width and of position (full-width letters, Arabic
  presentation forms, Latin ligatures) become the ordinary letters;
* composed and decomposed letters become composed;
* every kind of space becomes U+0020, line ends become U+000A;
* characters without width go, unless they change the print: a zero-width
  non-joiner stays between two letters that would otherwise join, a zero-width
  joiner where it makes a letter join that otherwise would not;
* Greek and Cyrillic letters shaped like Latin ones become those;
* the digits that Arabic and Persian share in shape become Persian (4, 5 and 6
  differ in shape and stay), every yeh and kaf becomes the Persian one.

Letter case, vowel marks, kashida and other digits stay as they are.

The operator then groups the mapped values under the accent-sensitive collation
UNICODE in SQL, takes the member of the least id as the class's canonical one
and joins it back. The collation alone decides which values are of one class.
Values equal under it have the same letters but for accents, case and order, so
only values that share the sum of their base letters' hashes (`letters_key`) with
another value of the book can be of any class, and no others are shuffled.

That collation ignores or equates some characters which do differ in print (the
non-joiner, kashida, digits of other scripts), so `guard` first puts private-use
characters in their place.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, keep, slices, spread

# Letters of other alphabets and the Latin letters of the same shape.
CYRILLIC = dict(zip("асеорхуіјѕһԁԛԝАВСЕНІЈКМОРЅТХУԌԚԜ", "aceopxyijshdqwABCEHIJKMOPSTXYGQW"))
GREEK = dict(zip("νορΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϹϳͿ", "vopABEZHIKMNOPTYXcCjJ"))
# Arabic-Indic digits of the Persian shape; yeh and kaf.
DIGITS = dict(zip("٠١٢٣٧٨٩", "۰۱۲۳۷۸۹"))
LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک"}
# Arabic letters that join to the letter before only, and those that don't join.
RIGHT_JOINING = set("آأؤإاةدذرزوٱٲٳٵٶٷۃۄۅۆۇۈۉۊۋۍۏےۓەۮۯڈډڊڋڌڍڎڏڐڑڒړڔڕږڗژڙ")
NOT_JOINING = set("ءٴ")
WIDTHS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")

ZWNJ, ZWJ, HAMZA, HEH_HAMZA = "\u200c", "\u200d", "\u0654", "\u06c0"


def _char(c: str) -> str:
    """One character's own mapping, decomposed."""
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if c in (ZWNJ, ZWJ, "\n", "\t"):
        return c
    if c == "\r":
        return ""
    if kind in ("Cf", "Cc") or c == "\u034f" or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    how = unicodedata.decomposition(c)
    if how.startswith(WIDTHS) or "\ufb00" <= c <= "\ufb4f":
        wide = unicodedata.normalize("NFKD", c)
        if not wide.startswith(" ") or len(wide) == 1:
            return "".join(map(_char, wide)) if wide != c else c
    whole = unicodedata.normalize("NFD", c)
    if len(whole) > 1:
        return "".join(map(_char, whole))
    return CYRILLIC.get(whole) or GREEK.get(whole) or DIGITS.get(whole) or LETTERS.get(whole) or whole


_MAP = Memo(_char, 1_200_000)


def _joins(c: str, forward: bool) -> bool:
    """Whether the letter can join the next (forward) or the previous one."""
    if not "\u0620" <= c <= "\u06ff" or not c.isalpha() or c in NOT_JOINING:
        return c == "\u0640"
    return not forward or c not in RIGHT_JOINING


def _beside(t: str, i: int, step: int) -> str:
    """The nearest character that is neither a joiner nor a mark above or below."""
    i += step
    while 0 <= i < len(t) and (t[i] in (ZWNJ, ZWJ) or unicodedata.combining(t[i])):
        i += step
    return t[i] if 0 <= i < len(t) else ""


def _joiners(t: str) -> str:
    out = []
    for i, c in enumerate(t):
        if c in (ZWNJ, ZWJ):
            a, b = _joins(_beside(t, i, -1), True), _joins(_beside(t, i, 1), False)
            if c == ZWNJ and not (a and b) or c == ZWJ and (a == b) or i and t[i - 1] == c:
                continue
        out.append(c)
    return "".join(out)


def canonical_word(w: str) -> str:
    """`canonical` of a text without plain spaces and line ends beside it."""
    if w.isascii() and w.isprintable():
        return w
    t = "".join(map(_MAP.__getitem__, w))
    t = unicodedata.normalize("NFC", t)
    if ZWNJ in t or ZWJ in t:
        t = unicodedata.normalize("NFC", _joiners(t))
    if HAMZA in t:  # these have a composed form only with other code points of the same look
        t = t.replace("ی" + HAMZA, "ئ").replace("ه" + HAMZA, "ۀ").replace("ە" + HAMZA, "ۀ")
    return t.replace("ۀ", "ۀ")


CANONICAL = Memo(canonical_word)


def canonical(text: str | None) -> str | None:
    """The form of a text; null stays null, empty stays empty. No character of a word changes how another word is mapped, so words are mapped one by one."""
    if not text:
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    get = CANONICAL.__getitem__
    return "\n".join([" ".join(map(get, line.split(" "))) for line in text.split("\n")])


def canonical_lines(text: str) -> list[str]:
    """The canonical forms of what line feeds separate; a carriage return never makes a line of its own here."""
    return list(map(canonical, text.split("\n"))) if "\r" in text else canonical(text).split("\n")


#: Fixed: what the collation ignores or equates although it differs in print, and a private character for each.
GUARDED = {0x200C: 0xE00C, 0x200D: 0xE00D, 0x640: 0xE640} | {d: 0xE000 + d for d in (*range(0x660, 0x66A), *range(0x6F0, 0x6FA))}


def guard(text: str) -> str:
    return text.translate(GUARDED)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Between the elements of an array put into one text, and for a null element.
BETWEEN, NOTHING = "\x1f", "\x1e"


def values(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """(field, rec_id, book, value): non-empty texts and non-empty arrays of headings, the elements put into one value. Deliveries may repeat."""
    texts = pages.where(F.col("text_md") != "").select(F.lit("text_md").alias("field"), "rec_id", "book", F.col("text_md").alias("value"))
    heads = fields.where(F.size("headings") > 0).select(F.lit("headings").alias("field"), "rec_id", "book", F.array_join(F.transform("headings", lambda h: F.coalesce(h, F.lit(NOTHING))), BETWEEN).alias("value"))
    return texts.unionByName(heads)


def _mapped(value: str) -> str:
    return value if value == NOTHING else canonical(value)


def mapped(value: str) -> str:
    """`canonical` of each element of a value."""
    return BETWEEN.join(map(_mapped, value.split(BETWEEN))) if BETWEEN in value else _mapped(value)


def with_canonical(df: DataFrame, guarded: bool = False) -> DataFrame:
    """Adds `mapped`, the canonical form of `value`."""

    def run(batches):
        for batch in slices(batches, "value"):
            forms = map(mapped, batch.column("value").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(guard, forms) if guarded else forms, pa.string())], [*batch.schema.names, "mapped"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("mapped", T.StringType())]))


class _Letters:
    """A number for the base letters of each character, 0 for what is no letter; filled as characters are met, one per Python worker."""

    def __init__(self):
        self.value = self.known = None

    def of(self, code: np.ndarray) -> np.ndarray:
        if self.value is None:
            self.value, self.known = np.zeros(0x110000, np.uint64), np.zeros(0x110000, bool)
        for c in np.unique(code[~self.known[code]]).tolist():
            base = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(c)).casefold())
            self.value[c] = sum(_digest(x) for x in base if unicodedata.category(x) in ("Lu", "Ll", "Lt", "Lo")) & 0xFFFFFFFFFFFFFFFF
            self.known[c] = True
        return self.value[code]


LETTERS_OF = _Letters()


def letters_key(texts: list[str]) -> np.ndarray:
    """The sum of the hashes of each text's base letters: equal for texts that are equal under the collation."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS_OF.of(code), dtype=np.uint64)])
    ends = np.cumsum([0, *map(len, texts)])
    return np.diff(total[ends]).view(np.int64)


def with_hashes(df: DataFrame) -> DataFrame:
    """(field, rec_id, book, letters, raw): `letters_key` of the canonical form and a 64-bit hash of the value itself."""

    def run(batches):
        for batch in slices(batches, "value", 1 << 20):
            text = batch.column("value").to_pylist()
            letters, raw = letters_key([mapped(t) for t in text]), [_digest(t) for t in text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("field", "rec_id", "book")), pa.array(letters), pa.array(raw, pa.int64())], ["field", "rec_id", "book", "letters", "raw"])

    return df.mapInArrow(run, "field string, rec_id bigint, book string, letters bigint, raw bigint")


def members(vals: DataFrame) -> DataFrame:
    """(field, rec_id, book, member, raw) of the records whose look another record of the book has in different characters; member is the canonical member.

    Only hashes are shuffled to find values that may have such another; these are
    grouped under the collation and the canonical member is joined back.
    """
    spark = vals.sparkSession
    hashed = keep(with_hashes(spread(vals)).dropDuplicates(["field", "rec_id", "book", "raw"]), "p1-hashes")
    several = hashed.groupBy("field", "book", "letters").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b")
    some = hashed.join(several.select("field", "book", "letters"), ["field", "book", "letters"], "leftsemi").select("field", "rec_id", "raw")
    texts = vals.join(some, ["field", "rec_id"]).dropDuplicates(["field", "rec_id", "raw"])
    v = with_canonical(texts, guarded=True).select("field", "rec_id", "book", "raw", "mapped")
    return spark.sql(
        """WITH v AS (SELECT field, rec_id, book, raw, mapped COLLATE UNICODE AS look FROM {v}),
        c AS (SELECT field, book, look, min(rec_id) AS member FROM v GROUP BY field, book, look HAVING min(raw) <> max(raw))
        SELECT v.field, v.rec_id, v.book, c.member, v.raw FROM v JOIN c ON v.field = c.field AND v.book = c.book AND v.look = c.look""",
        v=v,
    )


def classes(vals: DataFrame) -> DataFrame:
    """(field, book, member, records, spellings): each class of values that look the same in different characters, by its canonical member; what `pairs` says without expanding a large class."""
    return members(vals).groupBy("field", "book", "member").agg(F.countDistinct("rec_id").alias("records"), F.countDistinct("raw").alias("spellings"))


def pairs(vals: DataFrame) -> DataFrame:
    """(field, rec_a, rec_b), rec_a < rec_b: records of one book of the same look but not equal code point by code point."""
    m = keep(members(vals), "p1-members")
    a, b = (m.select("field", "member", F.col("rec_id").alias(f"rec_{x}"), F.col("raw").alias(f"raw_{x}")) for x in "ab")
    both = a.join(b, ["field", "member"]).where("rec_a < rec_b AND raw_a <> raw_b")
    return both.select("field", "rec_a", "rec_b").distinct()
