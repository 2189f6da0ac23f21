"""Problem 4: texts whose end is missing.

A text's end is the last line left when the lines of its origin (repeated.py)
and of the page layout (denoise.py) are taken away. A record is truncated if

* a near-copy goes on where it ends: bands of min-hashes over shingles of five
  words find copies of a Jaccard similarity of 0.8 or more, and the attempts at
  one page meet by their key; each member of a group is aligned with the longest
  one, then with every other that has the words before its end and goes on after
  them, and the copy whose alignment ends early is cut;
* its size is a limit of its origin: a length in characters or in UTF-8 bytes at
  which the origin's records pile up far beyond the neighbouring lengths;
* its last line is of a kind that can't end so (a table row without its end, an
  open block of verse, a heading, a list item without its mark);
* its closing word is none that closes or goes on anywhere: terminality is the
  count of the word inside texts against its count as a closing word. Pieces of
  words stand almost only at ends, and a more frequent word begins with them;
* it ends inside a sentence and the next page doesn't go on: that page's
  `starts_mid_paragraph` decides, this page's `continues_next` only where that is
  null or the page is missing.

Defined results: null and empty texts and texts of nothing but furniture are not
truncated; a null origin has no limits; exact copies of one another are cut or whole alike.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Bits, Memo, Numbers, batch_of, keep, of_numbers, only_numbers, slices
from .denoise import DIGIT, HYPHENS, LETTERS, LIST, NOTE, PAGE, core, is_letter
from .visual import canonical, canonical_lines, canonical_word

#: 16 bands of 4 min-hashes find a pair of similarity 0.8 with a probability of 0.9998.
BANDS, ROWS, SHINGLE = 16, 4, 5
_RNG = np.random.default_rng(20240229)
FACTORS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

TERMINAL = re.compile(r"[.!?؟][»”\"')\]*]*$")
DOTS = re.compile(r"\s*(?:…|\.{2,})$")


def _hash32(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little", signed=True)


WORDS = Memo(_hash32)


def _raw_hash(token: str) -> int | None:
    """The hash of a token's canonical form if that is one word."""
    words = canonical_word(token).split()
    return WORDS[words[0]] if len(words) == 1 else None


HASHES = Memo(_raw_hash)


def _lines(text: str, gone) -> list[str]:
    """A text's lines, as stored, without those gone. Any number alone is furniture here: copies of a page carry the number of another."""
    if "\r" in text:
        return [c for i, c in enumerate(canonical_lines(text), 1) if i not in gone and not (DIGIT.search(c) and PAGE.fullmatch(c.strip()))]
    return [s for i, s in enumerate(text.split("\n"), 1) if i not in gone and (LETTERS.match(s) or not DIGIT.search(s) or not PAGE.fullmatch(canonical(s).strip()))]


def ending(lines: list[str]) -> tuple[str, str]:
    """(kind, closing word) of a text's lines without furniture; kinds: whole, cut, open (inside a sentence), broken (a hyphenated word)."""
    at, last = len(lines) - 1, ""
    while at >= 0 and not (last := canonical(lines[at]).rstrip()):
        at -= 1
    if not last:
        return "whole", ""
    s = NOTE.sub("", last).rstrip() if last.endswith("]") else last
    words = s.split()
    word = core(words[-1].rstrip("…")) if words else ""
    fences = sum(canonical(x).strip().startswith("```") for x in lines[: at + 1] if "`" in x or "｀" in x)
    if last.strip().startswith("```"):
        return ("cut" if fences % 2 else "whole"), ""
    if fences % 2:
        return "cut", word
    t = last.lstrip()
    if t.startswith("|"):
        return ("whole" if t.endswith("|") and len(t) > 1 else "cut"), word
    if t.startswith("#"):
        return "cut", word
    dotted = DOTS.sub("", s)
    if dotted != s:
        return "open", word or core(dotted.split()[-1] if dotted.split() else "")
    if TERMINAL.search(s) or s.endswith("؛"):
        return "whole", word
    if LIST.match(last) or t.startswith(("[^", ">")):
        return "cut", word
    if s[-1] in HYPHENS and len(s) > 1 and is_letter(s[-2]):
        return "broken", word
    return "open", word


def min_hash_bands(hashes: list[np.ndarray]) -> list[list[int]]:
    """The bands of each text's words; texts of fewer than five words have none."""
    sets = []
    for h in hashes:
        if len(h) < SHINGLE:
            sets.append(np.zeros(0, np.uint64))
            continue
        x = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(x) + i].astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        sets.append(x ^ (x >> np.uint64(29)))
    sizes = np.array([len(x) for x in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return [[] for _ in hashes]
    every = np.concatenate([sets[i] for i in full])
    starts = np.cumsum(sizes[full]) - sizes[full]
    bands = np.zeros((BANDS, len(full)), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            low = np.minimum.reduceat(every * FACTORS[b * ROWS + r], starts)
            bands[b] = bands[b] * np.uint64(0xBF58476D1CE4E5B9) + (low >> np.uint64(8)) + np.uint64(b + 1)
    out: list[list[int]] = [[] for _ in hashes]
    for k, i in enumerate(full):
        out[i] = bands[:, k].view(np.int64).tolist()
    return out


def read_ends(pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """Of each delivery of a record: its end, sizes, words as hashes and bands; besides, rows of (word, n) for the counts of words inside texts. What was delivered twice is dropped later, from rows without texts."""
    furniture = keep(furniture, "p4-dropped")
    hit = pages.sparkSession.sparkContext.broadcast(Numbers(furniture.select("rec_id").distinct()))
    may = F.arrow_udf(lambda c: pa.array(hit.value.hits(pc.fill_null(c, 0).to_numpy(zero_copy_only=False))), "boolean")("rec_id")
    dropped = furniture.groupBy("rec_id").agg(F.collect_set("line_no").alias("dropped"))  # at most the lines of one text
    # texts that lose no line pass through; the others meet their lines by a shuffled join at every size, as the lines grow with the texts; the lines are the smaller side, the texts are not sorted
    df = pages.select("rec_id", "book", "page", "origin", "text_md").withColumn("may", may)
    lost = df.where("may").join(dropped.hint("shuffle_hash"), "rec_id", "left")
    df = lost.select("rec_id", "book", "page", "origin", "text_md", "dropped").unionByName(df.where("NOT may").drop("may").withColumn("dropped", F.lit(None).cast("array<int>")))
    names = ["rec_id", "book", "page", "origin", "chars", "bytes", "kind", "last", "n_words", "words", "bands", "word", "n"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.int64()]

    def run(batches):
        counts: Counter = Counter()

        def out():
            found: Counter = Counter()
            for raw, n in counts.items():
                for part in canonical_word(raw).split():
                    if w := core(part):
                        found[w] += n
            counts.clear()
            none = [pa.nulls(len(found), t) for t in types[:-2]]
            return pa.RecordBatch.from_arrays([*none, pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names)

        for batch in slices(batches, "text_md", 1 << 19):  # arrays that fit the processor's cache
            columns = {c: batch.column(c) for c in ("rec_id", "book", "page", "origin")}
            chars, size, kinds, lasts, hashes = [], [], [], [], []
            for text, gone in zip(batch.column("text_md").to_pylist(), batch.column("dropped").to_pylist()):
                text = text or ""
                lines = _lines(text, gone or ())
                kind, last = ending(lines)
                raw = " ".join(lines).split()
                counts.update(raw[:-1])
                chars.append(len(text)), size.append(len(text.encode("utf-8", "surrogatepass"))), kinds.append(kind), lasts.append(last)
                found = list(map(HASHES.__getitem__, raw))
                if None in found:  # a token that is no word, or several
                    found = [WORDS[w] for w in canonical(" ".join(raw)).split()]
                hashes.append(np.array(found, np.int32))
            n = pa.array([len(h) for h in hashes], pa.int32())
            words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, hashes)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *hashes])))
            bands = pa.array(min_hash_bands(hashes), pa.list_(pa.int64()))
            rows = len(kinds)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(chars, pa.int32()), pa.array(size, pa.int32()), pa.array(kinds), pa.array(lasts), n, words, bands, pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64())], names)
            if len(counts) > 100_000:
                yield out()
        yield out()

    schema = "rec_id bigint, book string, page int, origin string, chars int, bytes int, kind string, last string, n_words int, words array<int>, bands array<bigint>, word string, n bigint"
    return df.select("rec_id", "book", "page", "origin", "text_md", "dropped").mapInArrow(run, schema)


def limits(ends: DataFrame, least: int = 5, times: float = 10.0, width: int = 30) -> DataFrame:
    """(origin, unit, size): sizes at which an origin's records pile up. A cut in bytes may fall up to 3 short of the limit, so it covers the sizes just below."""
    sizes = ends.where("origin IS NOT NULL AND chars > 0").select("origin", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("s"))
    hist = sizes.groupBy("origin", "s.unit", "s.size").count()  # at most two rows for each size and origin
    by = W.partitionBy("origin", "unit").orderBy("size")
    around = F.sum("count").over(by.rangeBetween(-width, width)) - F.sum("count").over(by.rangeBetween(-3, 3))
    found = hist.withColumn("mean", around / (2 * width - 6)).where((F.col("count") >= least) & (F.col("count") >= times * F.col("mean")) & (F.col("mean") > 0))
    chars = found.where("unit = 'chars'").select("origin", "unit", "size")
    bytes_ = found.where("unit = 'bytes'").select("origin", "unit", F.explode(F.sequence(F.col("size") - 2, F.col("size"))).alias("size"))
    # bytes follow characters: where an origin's limit is in characters, no pile of bytes is its cause
    return chars.unionByName(bytes_.join(chars.select("origin").distinct(), "origin", "left_anti")).distinct()


def aligned_early(short: list[int], short_last: str, long: list[int], long_last: str) -> bool:
    """Whether a text's words, aligned with a longer copy's, end before that copy does."""
    n = len(short)
    if n < 3 or len(long) < n:
        return False
    a, b = np.array(short, np.int64), np.array(long, np.int64)
    k = n - 1  # the closing word may be cut
    agree = int((a[:k] == b[:k]).sum())
    at = k
    if agree < 0.8 * k:  # not word for word: find where the last words before the closing one stand
        tail = a[max(0, k - 4) : k]
        spots = [i for i in range(len(tail), len(b) + 1) if (b[i - len(tail) : i] == tail).all()]
        if not spots:
            return False
        at = min(spots, key=lambda i: abs(i - k))
        x = {tuple(a[i : i + SHINGLE]) for i in range(max(1, k - SHINGLE + 1))}
        y = {tuple(b[i : i + SHINGLE]) for i in range(max(1, at - SHINGLE + 1))}
        if len(x & y) < 0.8 * len(x | y):
            return False
    elif k >= 2 and not (a[k - 2 : k] == b[k - 2 : k]).all():
        return False
    rest = len(b) - at - 1
    if rest > 0:
        return True
    return rest == 0 and a[-1] != b[-1] and bool(short_last) and long_last.startswith(short_last) and long_last != short_last


def _mixed(*parts) -> np.ndarray:
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = (x ^ np.atleast_1d(np.asarray(p, np.int64)).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
    return x.view(np.int64)


PLACED, TAIL = 1, 2
#: (kind, number of words): the words before a closing one at their place, or anywhere.
ENDS = ((PLACED, 2), (TAIL, 2), (TAIL, 3), (TAIL, 4))


def _key(kind: int, n: int, place, goes_on, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the n words before each place: for PLACED with the place itself; goes_on is 0 or the hash of a closing word."""
    return _mixed(kind, place if kind == PLACED else n, goes_on, *(words[at - j] for j in range(n, 0, -1)))


def _flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all words, first place of each text, number of its words)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64), np.cumsum(sizes) - sizes, sizes


def end_keys(texts: list[np.ndarray], lasts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, key): what any text after which `aligned_early` finds this one cut must offer, one of: the two words before the closing one at their place, or the four before it anywhere; with more than one word after them, or with a closing word that begins with this one's."""
    words, first, sizes = _flat(texts)
    k = sizes - 1
    of, keys = [], []
    for kind, n in ENDS:
        some = np.flatnonzero((k >= 2) if kind == PLACED else (np.minimum(k, 4) == n))
        for goes_on in (np.zeros(len(some), np.int64), np.array([WORDS[lasts[i]] if lasts[i] else 0 for i in some], np.int64)):
            of.append(some), keys.append(_key(kind, n, k[some], goes_on, words, first[some] + k[some]))
    return np.concatenate(of), np.concatenate(keys)


def going_on_keys(texts: list[np.ndarray], lasts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, key): the keys of all ends after which each text goes on."""
    words, first, sizes = _flat(texts)
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(words)) - np.repeat(first, sizes)
    last = np.repeat(sizes - 1, sizes)
    begun = [(i, WORDS[w[:cut]]) for i, w in enumerate(lasts) for cut in range(1, len(w))]
    begins, parts = (np.array(x, np.int64) for x in zip(*begun)) if begun else (np.zeros(0, np.int64),) * 2
    of, keys = [], []
    for kind, n in ENDS:
        at = np.flatnonzero((place >= n) & (place < last))  # another word comes after the closing word's place
        of.append(text[at]), keys.append(_key(kind, n, place[at], np.zeros(len(at), np.int64), words, at))
        some = sizes[begins] > n  # the closing word itself goes on
        i = begins[some]
        of.append(i), keys.append(_key(kind, n, sizes[i] - 1, parts[some], words, first[i] + sizes[i] - 1))
    return np.concatenate(of), np.concatenate(keys)


def _keyed(texts: DataFrame, keys, known: Numbers | None = None) -> DataFrame:
    """(rec_id, n, key) of texts' keys; of those that can't be known none. n is the number of words."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                b = batch.slice(part, 1024)
                column = b.column("words")
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))])
                flat = column.flatten().to_numpy(zero_copy_only=False)
                of, got = keys([flat[i:j] for i, j in zip(ends[:-1], ends[1:])], [x or "" for x in b.column("last").to_pylist()])
                if shared.value is not None:
                    hit = shared.value.hits(got)
                    of, got = of[hit], got[hit]
                yield pa.RecordBatch.from_arrays([b.column("rec_id").take(pa.array(of)), pa.array(np.diff(ends)[of].astype(np.int32)), pa.array(got)], ["rec_id", "n", "key"])

    return texts.select("rec_id", "words", "last").mapInArrow(run, "rec_id bigint, n int, key bigint")


def near_groups(texts: DataFrame, attempts: bool = True) -> DataFrame:
    """(rec_id, band): records that share a band of min-hashes and, with `attempts`, those at one page."""
    banded = texts.select("rec_id", F.explode("bands").alias("band"))
    # one shuffle of all bands, combined before; only bands of several records and their members are looked at again
    several = keep(banded.groupBy("band").agg(F.min("rec_id").alias("a"), F.max("rec_id").alias("b")).where("a <> b").select("band"), "p4-bands")
    members = only_numbers(texts.select("rec_id", "bands"), "bands", Numbers(several)).select("rec_id", F.explode("bands").alias("band")).join(several, "band", "leftsemi")
    if attempts:
        page = F.xxhash64("book", "page").alias("band")
        of_page = texts.where("book IS NOT NULL AND page IS NOT NULL").select("rec_id", page)
        met = of_page.groupBy("band").agg(F.min("rec_id").alias("a"), F.max("rec_id").alias("b")).where("a <> b").select("band")
        members = members.unionByName(of_page.join(met, "band", "leftsemi"))
    return keep(members.distinct(), "p4-groups")


def cut_copies(ends: DataFrame, attempts: bool = True) -> DataFrame:
    """(rec_id) of the records that a near-copy goes on after.

    Each text's end is hashed (the words before its closing word), and so is every place of each text that another word follows; where both meet
    within a group, the two texts are aligned. A text that is whole meets nothing, so only the texts of possible cuts are shuffled."""
    texts = ends.where("n_words > 2")
    groups = near_groups(texts, attempts)
    texts = keep(of_numbers(texts.select("rec_id", "words", "last"), "rec_id", Numbers(groups.select("rec_id").distinct())), "p4-copies")
    asked = keep(_keyed(texts, end_keys), "p4-asked")
    offered = keep(_keyed(texts, going_on_keys, Numbers(asked.select("key").distinct())), "p4-offered")
    # keys that someone asks for and someone else offers, then within groups
    met = asked.join(offered.groupBy("key").agg(F.min("rec_id").alias("a"), F.max("rec_id").alias("b")), "key").where("rec_id <> a OR rec_id <> b").select("rec_id", "key")
    mine = keep(met.join(groups, "rec_id").distinct(), "p4-mine")
    offered = offered.join(mine.select("key").distinct(), "key", "leftsemi").join(groups, "rec_id").withColumnRenamed("rec_id", "top")
    offered = keep(offered.join(mine.select("band", "key").distinct(), ["band", "key"], "leftsemi").distinct(), "p4-theirs")
    # first one member for each group and key, so that a hot group makes no pairs; then every one for the records that are left
    one = offered.groupBy("band", "key").agg(F.max(F.struct("n", "top")).alias("t")).select("band", "key", F.col("t.top").alias("top"))

    def pairs(asks: DataFrame, other: DataFrame) -> DataFrame:
        return asks.join(other.select("band", "key", "top"), ["band", "key"]).where("rec_id <> top").select("rec_id", "top").distinct()

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                b = batch.slice(part, 256)
                kept = [r["rec_id"] for r in b.to_pylist() if aligned_early(r["a"], r["a_last"], r["b"], r["b_last"])]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], ["rec_id"])

    def cut(found: DataFrame) -> DataFrame:
        found = keep(found, "p4-pairs")
        some = of_numbers(texts, "rec_id", Numbers(found.select(F.explode(F.array("rec_id", "top")).alias("id")))).dropDuplicates(["rec_id"])
        a = some.select("rec_id", F.col("words").alias("a"), F.col("last").alias("a_last"))
        b = some.select(F.col("rec_id").alias("top"), F.col("words").alias("b"), F.col("last").alias("b_last"))
        return keep(found.join(a, "rec_id").join(b, "top").select("rec_id", "a", "a_last", "b", "b_last").mapInArrow(run, "rec_id bigint").distinct(), "p4-cut")

    found = cut(pairs(mine, one))
    return found.unionByName(cut(pairs(mine.join(found, "rec_id", "leftanti"), offered)))


def closing_words(ends: DataFrame, counts: DataFrame, inside: float = 8.0) -> DataFrame:
    """(last, terminality, piece) of the closing words of open texts. Terminality is the share of a word's occurrences that close a text, 1 for a word found only so; piece says that it stands almost only at ends (inside texts less than `inside` times as often) and that a more frequent word begins with it."""
    closing = ends.where("kind = 'open' AND last <> ''").groupBy("last").agg(F.count("*").alias("n_end"))
    words = keep(counts.groupBy("word").agg(F.sum("n").alias("n")), "p4-words")
    scored = keep(closing.join(words.withColumnRenamed("word", "last"), "last", "left").withColumn("n", F.coalesce("n", F.lit(0))), "p4-closing")
    odd = scored.where(F.col("n") < inside * F.col("n_end")).select("last", "n")
    bits = ends.sparkSession.sparkContext.broadcast(Bits(odd.select("last")))

    def run(batches):  # only beginnings that may be odd words leave the task
        for batch in batches:
            rows = [(w[:k], n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) for k in range(1, len(w)) if w[:k] in bits.value]
            yield batch_of(rows, {"last": pa.string(), "m": pa.int64()})

    starts = words.mapInArrow(run, "last string, m bigint").groupBy("last").agg(F.max("m").alias("m"))
    pieces = odd.join(starts, "last", "left").select("last", (F.coalesce("m", F.lit(0)) > 4 * F.col("n")).alias("piece"))
    return scored.select("last", F.round(F.col("n_end") / (F.col("n_end") + F.col("n")), 6).alias("terminality")).join(pieces, "last", "left")


def truncated(pages: DataFrame, fields: DataFrame, furniture: DataFrame) -> DataFrame:
    """(rec_id, origin, why, terminality) of the truncated records, each once; why is the first reason that holds: limit, copy, form, word, sentence; terminality is that of the closing word of an open text."""
    kept = keep(read_ends(pages, furniture), "p4-ends")
    ends, counts = kept.where("rec_id IS NOT NULL"), kept.where("rec_id IS NULL").select("word", "n")
    once = keep(ends.select("rec_id", "book", "page", "origin", "chars", "bytes", "kind", "last", "n_words").distinct(), "p4-once")  # deliveries of one record say the same
    flags = fields.select("rec_id", "starts_mid_paragraph", "continues_next").dropDuplicates(["rec_id"])
    slim = once.where("n_words > 0").drop("n_words").join(flags, "rec_id", "left")
    nxt = slim.where("book IS NOT NULL AND page IS NOT NULL").groupBy("book", (F.col("page") - 1).alias("page")).agg(F.max("starts_mid_paragraph").alias("goes_on"))
    lim = limits(once)
    at_limit = slim.join(lim.where("unit = 'chars'").select("origin", F.col("size").alias("chars")), ["origin", "chars"], "leftsemi").select("rec_id").unionByName(slim.join(lim.where("unit = 'bytes'").select("origin", F.col("size").alias("bytes")), ["origin", "bytes"], "leftsemi").select("rec_id")).distinct().withColumn("limit", F.lit(True))
    copies = cut_copies(ends).withColumn("copy", F.lit(True))
    all_ = slim.join(nxt, ["book", "page"], "left").join(closing_words(once, counts), "last", "left").join(at_limit, "rec_id", "left").join(copies, "rec_id", "left")
    goes_on = F.coalesce("goes_on", "continues_next", F.lit(True))
    why = (
        F.when(F.col("limit"), "limit")
        .when(F.col("copy"), "copy")
        .when(F.col("kind") == "cut", "form")
        .when((F.col("kind") == "open") & F.col("piece"), "word")
        .when((F.col("kind") == "open") & ~goes_on, "sentence")
    )
    return all_.withColumn("why", why).where("why IS NOT NULL").select("rec_id", "origin", "why", F.when(F.col("kind") == "open", F.col("terminality")).alias("terminality")).dropDuplicates(["rec_id"])


def shares(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(origin, records, truncated, share) of every origin, null included; each record once."""
    once = pages.select("rec_id", "origin").dropDuplicates(["rec_id"])
    return once.join(found.select("rec_id", F.lit(1).alias("t")), "rec_id", "left").groupBy("origin").agg(F.count("*").alias("records"), F.sum(F.coalesce("t", F.lit(0))).alias("truncated"), F.round(F.avg(F.coalesce("t", F.lit(0))), 6).alias("share"))
