"""Problem 3: noise of scanned pages, repaired by a noisy channel.

* Page furniture. A line that is only the page's own number is a page number. A
  line that is the book's title, one of its chapters' titles, or a text found so
  on several pages of the book is a running line, with or without a number.
* Broken words. A line that ends with a hyphen after a letter is continued.
* Misread words. Words are counted over the whole corpus. Each word that differs
  from a much more frequent one in one character of a confusable shape, or holds
  a character no word of its script has, gets candidates; the probabilities of
  the confusions are estimated from these pairs. Each line with such a word is
  decoded by Viterbi over the candidates of its words, with the channel's
  probabilities and the corpus counts of word pairs. Only pairs that some line
  needs are counted.

What Python workers need of the corpus is broadcast as a bit table of fixed size
(Bits): false positives cost time only, exact joins follow.

Defined results: null and empty texts have no lines; records of books that are
neither scanned nor mixed, or of no known book, take no part; page numbers need
a page; headings, tables, verse, lists, notes and quotations are never misread.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bargspark.operators import windows

from . import repeated
from .common import Bits, Memo, Numbers, batch_of, keep, of_texts, slices, spread
from .visual import canonical, canonical_lines

# Letters of one base shape, hyphens of scans, marks around words, marks that scans take letters for, words beside page numbers.
SHAPES = ["بپتثن", "جچحخ", "دذ", "رزژ", "سش", "صض", "طظ", "عغ", "فق", "کگ", "نی"]
HYPHENS = "-‐‑¬"
OUTER = ".,:;!?،؛؟«»()[]|*#>`\"“”…–"
EDGES = ")!|,>"
PAGE_WORDS = ("صفحه", "صفحهٔ", "صفحۀ", "صفحه‌ی", "ص", "برگ", "page", "p", "pp", "pg")

GROUP = {c: [str(i) for i, g in enumerate(SHAPES) if c in g] for c in "".join(SHAPES)}
NOTE = re.compile(r"\[\^[^\]]*\]")
BROKEN = re.compile(rf"(?<=[^\s{re.escape(HYPHENS)}])[{re.escape(HYPHENS)}][ \t]*\n+")
DIGIT = re.compile(r"\d")
SENTENCE = re.compile(r"[.!?؟؛»](?:\s|$)")
LIST = re.compile(r"\s*(?:[-*•]|\d+[.)])\s")
PAGE = re.compile(r"[\W_]*(?:(" + "|".join(map(re.escape, PAGE_WORDS)) + r")[\W_]*)?(\d+)[\W_]*", re.I)
#: Eight letters: more than any line of PAGE has.
LETTERS = re.compile(r"[\W\d_]*(?:[^\W\d_][\W\d_]*){8}")
NUMBERED = (re.compile(r"\s*(\d+)(?:\s*[|·•–—…:.-]+\s*|\s{2,})(\S.*\S)\s*"), re.compile(r"\s*(\S.*?\S)(?:\s*[|·•–—…:-]+\s*|\s*\.{2,}\s*|\s{2,})(\d+)\s*"))


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


# ---------------------------------------------------------------- words


def is_letter(c: str) -> bool:
    return "ؠ" <= c <= "ۿ" and c.isalpha()


def foreign(word: str) -> list[int]:
    """Where a word has characters that no word of its script has."""
    return [i for i, c in enumerate(word) if not is_letter(c) and c not in "‌ـ" and not unicodedata.combining(c)]


def core(raw: str) -> str:
    """A token without the marks around it; empty if no letter of the script is left."""
    t = NOTE.sub("", raw).strip(OUTER)
    return t if any(map(is_letter, t)) else ""


CORE = Memo(core)


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over all texts; words broken over lines count as whole ones. Each task adds up before the shuffle."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            words: Counter = Counter()
            for raw, n in counts.items():
                if w := core(raw):
                    words[w] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text_md"):
            for t in batch.column("text_md").to_pylist():
                counts.update(BROKEN.sub("", canonical(t)).split())
            if len(counts) > 100_000:
                yield out()
        yield out()

    return spread(pages.where(F.length("text_md") > 0).select("text_md")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def clean_keys(w: str):
    """(key, true character) under which a misread form would ask for this word."""
    for i, c in enumerate(w):
        yield f"{w[:i]}\1{w[i + 1 :]}", c
        for g in GROUP.get(c, ()):
            yield f"{w[:i]}\2{g}{w[i + 1 :]}", c
    yield w, ""
    if len(w) > 2:
        yield w[:-1] + "\3", w[-1]
        yield "\4" + w[1:], w[0]


def asking_keys(w: str):
    """(form, key, seen character): what a word that may be misread asks for."""
    bad = foreign(w)
    if len(bad) == 1:
        i = bad[0]
        yield w, f"{w[:i]}\1{w[i + 1 :]}", w[i]
        yield w, w[:i] + w[i + 1 :], w[i]
    elif not bad:
        for i, c in enumerate(w):
            for g in GROUP.get(c, ()):
                yield w, f"{w[:i]}\2{g}{w[i + 1 :]}", c
        yield w + "\3", w + "\3", "\3"
        yield "\4" + w, "\4" + w, "\4"


def corrections(words: DataFrame, ratio: float = 8.0) -> DataFrame:
    """(form, n_form, word, n_word, log_p): the candidate words for each form that may be misread. A form is a word, or one that lacks its last (\\3) or first (\\4) letter. Forms with a foreign character also have a row with no word: a word unknown to the corpus."""

    def keyed(make, names):
        def run(batches):
            for batch in batches:
                rows = [(*x, n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) for x in make(w)]
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k[0] == "n" else pa.string()) for c, k in zip(columns, names)], names)

        return run

    has = words.where("n > 1").mapInArrow(keyed(lambda w: [] if foreign(w) else ((w, *x) for x in clean_keys(w)), ["word", "key", "meant", "n_word"]), "word string, key string, meant string, n_word bigint")
    asks = words.mapInArrow(keyed(asking_keys, ["form", "key", "seen", "n_form"]), "form string, key string, seen string, n_form bigint")
    bare = F.regexp_replace("form", "[\3\4]", "")
    pairs = asks.join(has, "key").where("meant <> seen OR meant = ''").where(bare != F.col("word"))
    odd = F.col("key").contains("\1") | (F.col("meant") == "")
    pairs = pairs.where(F.when(odd, F.col("n_word") >= F.col("n_form")).otherwise(F.col("n_word") >= ratio * F.col("n_form")))
    # how often each character is taken for which: from the clearest pairs, one vote of mass for each
    confusion = pairs.where(odd | (F.col("n_word") >= 100 * F.col("n_form"))).groupBy("meant", "seen").agg(F.sum("n_form").alias("mass"), F.count("*").alias("votes"))
    confusion = confusion.join(words.where("n > 1").select(F.explode(F.split("word", "")).alias("meant"), "n").groupBy("meant").agg(F.sum("n").alias("chars")), "meant", "left")
    p = F.log((F.col("mass") + 0.5) / (F.coalesce("chars", F.sum("mass").over(W.partitionBy("meant"))) + F.col("mass") + 1))
    confusion = confusion.where("votes > 1 OR seen IN ('\3', '\4')").select("meant", "seen", F.least(p, F.lit(-2.0)).alias("log_p"))
    scored = pairs.join(confusion, ["meant", "seen"], "left").where(odd | F.col("log_p").isNotNull()).withColumn("log_p", F.coalesce("log_p", F.lit(-14.0)))
    best = scored.groupBy("form", "word").agg(F.max("n_form").alias("n_form"), F.max("n_word").alias("n_word"), F.max("log_p").alias("log_p"))
    unknown = words.mapInArrow(keyed(lambda w: [(w,)] if foreign(w) else [], ["form", "n_form"]), "form string, n_form bigint")
    none = {c: F.lit(None).cast(t) for c, t in (("word", "string"), ("n_word", "bigint"), ("log_p", "double"))}
    return best.select("form", "n_form", "word", "n_word", "log_p").unionByName(unknown.select("form", "n_form", *(v.alias(c) for c, v in none.items())))


# ---------------------------------------------------------------- lines of a page


def running_key(line: str, page: int | None):
    """(text without number, whether the page's own number stood beside it) of a line that may be running; None for markup."""
    s = line.strip()
    if not s or s.startswith(("#", "|", ">", "```", "**", "[^")) or LIST.match(s):
        return None
    for i, pattern in enumerate(NUMBERED if DIGIT.search(s) else ()):
        if m := pattern.fullmatch(s):
            number, text = (m[1], m[2]) if i == 0 else (m[2], m[1])
            return text.strip(), page is not None and number.isdecimal() and int(number) == page
    return s, False


#: Whether a token is a word with a foreign character.
DOUBTFUL = Memo(lambda w: any(map(is_letter, w)) and bool(foreign(w.strip(OUTER))))


def blanked(text: str, doubtful: bool) -> list[str]:
    """A text with one word left out: each in turn, or only one with a foreign character."""
    words = text.split()
    if len(words) < 3:
        return []
    return [" ".join([*words[:i], "~", *words[i + 1 :]]) for i, w in enumerate(words) if not doubtful or DOUBTFUL[w]]


def page_number(line: str, page: int | None) -> bool:
    m = PAGE.fullmatch(line.strip()) if page is not None and not LETTERS.match(line) and DIGIT.search(line) else None
    return bool(m) and int(m[2]) == page


def scanned_books(books: DataFrame) -> DataFrame:
    return books.where(F.lower("source_type").isin("scanned", "mixed")).select("book").distinct()


#: Of a line that may be furniture: look is a hash of its text; how is 2 for a page number, 1 for a text beside the page's number, 0 for another of the outer lines without the marks of sentences, -1 for any other line whose text may be a title, 3 for an outer one that may be a title but for one misread word; letters is the number of letters.
EDGE_FIELDS = {"rec_id": pa.int64(), "line_no": pa.int32(), "book": pa.string(), "page": pa.int32(), "origin": pa.string(), "look": pa.int64(), "how": pa.int8(), "letters": pa.int32()}
EDGE_DDL = "rec_id bigint, line_no int, book string, page int, origin string, look bigint, how byte, letters int"


def titles_of(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, look, n): hashes of the titles of books and chapters, whole and with each word left out in turn; n is the title's length."""

    def run(batches):
        for batch in batches:
            rows = []
            for b, t in zip(batch.column("book").to_pylist(), batch.column("title").to_pylist()):
                t = canonical(t).strip()
                rows += [(b, hash64(x), len(t)) for x in (t, *blanked(t, False))]
            yield batch_of(rows, {"book": pa.string(), "look": pa.int64(), "n": pa.int32()})

    both = books.select("book", F.col("title_fa").alias("title")).unionByName(chapters.select("book", "title"))
    return both.where("title IS NOT NULL AND book IS NOT NULL").mapInArrow(run, "book string, look bigint, n int").distinct()


def edge_rows(rec, book, page, origin, lines: list[str], titles: "Titles", edge: int) -> list[tuple]:
    """EDGE_FIELDS of a text's lines. Titles are sought in every line, in the `edge` outer ones also with one word misread."""
    some = [(i, s) for i, s in enumerate(lines, 1) if s.strip()]
    got = []
    for j, (i, s) in enumerate(some):
        if page_number(s, page):
            got.append((i, 0, 2, ""))
            continue
        near = j < edge or len(some) - j <= edge
        if not near and len(s) > titles.longest and not DIGIT.search(s):
            continue
        if found := running_key(s, page):
            text, numbered = found
            if near:
                plain = not SENTENCE.search(text)
                got.append((i, hash64(text), (1 if numbered else 0) if plain else -1, text))
                if len(text) <= 2 * titles.longest:  # a longer one is no title, whatever one of its words is
                    got += [(i, hash64(x), 3, text) for x in blanked(text, True)]
            elif len(text) <= titles.longest:
                got.append((i, hash64(text), -1, text))
    if not got:
        return got
    sure = titles.hits(np.array([g[1] for g in got], np.int64))
    rows = [(rec, i, book, page, origin, look, how, sum(map(str.isalpha, text))) for (i, look, how, text), hit in zip(got, sure) if hit or 0 <= how <= 2]
    return [r for r in rows if r[6] == 2 or r[7] > 2]


def edges(pages: DataFrame, books: DataFrame, titles: "Titles", edge: int = 5) -> DataFrame:
    """EDGE_FIELDS of the scanned and mixed books."""
    ours = scanned_books(books)
    bits, known = (pages.sparkSession.sparkContext.broadcast(x) for x in (Bits(ours), titles))

    def run(batches):
        for batch in slices(batches, "text_md"):
            rows = []
            for k, b, p, o, t in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "book", "page", "origin", "text_md"))):
                rows += edge_rows(k, b, p, o, canonical_lines(t), known.value, edge)
            yield batch_of(rows, EDGE_FIELDS)

    texts = of_texts(spread(pages.where("book IS NOT NULL").where(F.length("text_md") > 0).select("rec_id", "book", "page", "origin", "text_md")), "book", bits)
    return texts.mapInArrow(run, EDGE_DDL).join(ours, "book", "leftsemi")


class Titles(Numbers):
    """Titles' looks for a broadcast, with the length of the longest title."""

    def __init__(self, titles: DataFrame):
        super().__init__(titles.select("look"))
        self.longest = titles.agg(F.max("n")).first()[0] or 0


def lines_and_edges(pages: DataFrame, books: DataFrame, titles: Titles, letters: int = 25, edge: int = 5) -> tuple[DataFrame, DataFrame]:
    """`repeated.lines` and `edges` of one pass over the texts, as kept tables."""
    ours = scanned_books(books)
    bits, known = (pages.sparkSession.sparkContext.broadcast(x) for x in (Bits(ours), titles))

    def run(batches):
        scanned = Memo(lambda b: b is not None and b in bits.value)
        for batch in slices(batches, "text_md", 1 << 19):
            texts = [canonical_lines(t) for t in batch.column("text_md").to_pylist()]
            long = repeated.line_batch(batch, texts, letters)
            rows = []
            for k, b, p, o, lines in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "book", "page", "origin")), texts):
                if scanned[b]:
                    rows += edge_rows(k, b, p, o, lines, known.value, edge)
            outer = batch_of(rows, EDGE_FIELDS)
            for part in (long, outer):
                yield pa.RecordBatch.from_arrays([part.column(c) if c in part.schema.names else pa.nulls(part.num_rows, t) for c, t in fields.items()], list(fields))

    fields = {**repeated.LINE_FIELDS, **EDGE_FIELDS}
    both = spread(pages.where(F.length("text_md") > 0).select("rec_id", "book", "page", "origin", "text_md"))
    both = keep(both.mapInArrow(run, f"{repeated.LINE_DDL}, line_no int, page int, look bigint, how byte, letters int"), "p4-lines")
    return both.where("nos IS NOT NULL").select(*repeated.LINE_FIELDS), both.where("how IS NOT NULL").select(*EDGE_FIELDS).join(ours, "book", "leftsemi")


def furniture(found: DataFrame, titles: DataFrame, repeats: int = 3, letters: int = 25, books: int = 3) -> DataFrame:
    """(rec_id, line_no, kind), each once, of `edges`: running lines and page numbers.

    A text that is no title is a running line if it stands beside the page's number, or among the outer lines of `repeats` pages of the book; what problem 5
    takes for a line of the origin (`letters` letters or more, in `books` books of it) isn't."""
    outer = found.where("how IN (0, 1)")
    # distinct pages are counted after each task has dropped its repeats; the rows of one text of one book can be at most its pages
    often = outer.select("book", "look", "page").distinct().groupBy("book", "look").count().where(F.col("count") >= repeats).select("book", "look")
    own = outer.where(F.col("letters") >= letters).where("origin IS NOT NULL").select("origin", "look", "book").distinct().groupBy("origin", "look").count().where(F.col("count") >= books).select("origin", "look")
    named = found.where("how <> 2").join(titles, ["book", "look"], "leftsemi")
    again = outer.join(often, ["book", "look"], "leftsemi").join(own, ["origin", "look"], "left_anti")
    columns = ["rec_id", "line_no"]
    running = named.select(*columns).unionByName(again.select(*columns)).unionByName(found.where("how = 1").select(*columns)).withColumn("kind", F.lit("running_line"))
    return found.where("how = 2").select(*columns, F.lit("page_number").alias("kind")).unionByName(running).distinct()


def prose(lines: list[str]) -> list[bool]:
    """Which lines are running text."""
    out, fence = [], False
    for s in lines:
        t = s.strip()
        if t.startswith("```"):
            fence = not fence
            out.append(False)
        else:
            out.append(bool(t) and not fence and not t.startswith(("#", "|", ">", "[^", "**")) and not LIST.match(s))
    return out


def breaks(line: str) -> bool:
    """Whether a line ends inside a word: a hyphen without a space before it, after a word of the script."""
    end = line.rstrip()
    return len(end) > 1 and end[-1] in HYPHENS and not end[-2].isspace() and end[-2] not in HYPHENS and bool(CORE[end.rsplit(None, 1)[-1].rstrip(HYPHENS)])


def forms_of(raw: str, suspects) -> list[tuple[str, bool]]:
    """[(form, sure)] of a token that may be misread: a word with a foreign character surely is. All forms that may be suspects are given, so a false one hides no true one."""
    w = CORE[raw]
    if not w:
        return []
    if foreign(w):
        return [(w, True)]
    t = NOTE.sub("", raw)
    i = t.find(w)
    forms = [w]
    if t[i + len(w) : i + len(w) + 1] in EDGES and t[i + len(w) :]:
        forms.append(w + "\3")
    if i and t[i - 1] in EDGES:
        forms.append("\4" + w)
    return [(f, False) for f in forms if f in suspects]


def events_of(text: str, suspects, memo: Memo):
    """The broken words and the lines with doubtful words of a text: (line_no, None, None) and (line_no, words, [(place, form, sure, length of the part on this line or 0)])."""
    lines = canonical_lines(text)
    is_prose = prose(lines)
    carried, begun = "", False
    for no, (s, p) in enumerate(zip(lines, is_prose), 1):
        if not p:
            continue
        raw = s.split()
        if carried and raw:
            raw = raw[1:]
        carried = ""
        words, spots = [], []
        end = s.rstrip()
        if breaks(s):
            yield no, None, None
            head = raw.pop().rstrip(HYPHENS).lstrip(OUTER) if raw else ""  # a mark at its end may be a letter
            after = next((x for x, q in zip(lines[no:], is_prose[no:]) if q), "")
            tail = after.split()[0] if after.split() else ""
            if head and tail and is_letter(tail[0]) and is_prose[no : no + 1] == [True]:
                carried = tail
                spots += [(len(raw), *found, len(head)) for found in memo[head + tail]]
                raw.append(head + tail)
            elif head:
                if foreign(head):
                    spots.append((len(raw), head, True, 0))
                raw.append(head)
        for i, r in enumerate(raw):
            # a page's first word may be the rest of one broken over pages
            if (found := memo[r]) and not (spots and spots[0][0] == i) and (begun or i or found[0][1]):
                spots += [(i, *f, 0) for f in found]
        begun = begun or bool(raw)
        if spots:
            yield no, [CORE[r] or r for r in raw], spots


def line_events(pages: DataFrame, books: DataFrame, suspects: Bits) -> DataFrame:
    """(rec_id, line_no, words, place, form, sure, part): a row for each form of each doubtful word; words is null for a broken word."""
    sc = pages.sparkSession.sparkContext
    ours = scanned_books(books)
    shared, known = sc.broadcast(suspects), sc.broadcast(Bits(ours))

    def run(batches):
        bits = shared.value
        memo = Memo(lambda raw: forms_of(raw, bits))
        for batch in slices(batches, "text_md"):
            rows = []
            for k, b, t in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "book", "text_md"))):
                for no, words, spots in events_of(t, bits, memo):
                    rows += [(k, b, no, words, *x) for x in spots] if words is not None else [(k, b, no, None, None, None, None, None)]
            columns = list(zip(*rows)) or [[]] * 8
            types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["rec_id", "book", "line_no", "words", "place", "form", "sure", "part"])

    df = of_texts(spread(pages.where("book IS NOT NULL").where(F.length("text_md") > 0).select("rec_id", "book", "text_md")), "book", known)
    out = df.mapInArrow(run, "rec_id bigint, book string, line_no int, words array<string>, place int, form string, sure boolean, part int")
    return out.join(ours, "book", "leftsemi").drop("book").dropDuplicates(["rec_id", "line_no", "place", "form"])


def pair_counts(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pair, n): how often the wanted pairs of neighbouring words stand in the corpus."""
    shared = pages.sparkSession.sparkContext.broadcast(Bits(wanted))

    def run(batches):
        bits, counts = shared.value, Counter()
        # CRC-32 goes on from word to word, so each word is hashed once and each pair only from its second word on
        first, second = Memo(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass"))), Memo(lambda w: b" " + w.encode("utf-8", "surrogatepass"))

        def out():
            t = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])
            counts.clear()
            return t

        for batch in slices(batches, "text_md"):
            for t in batch.column("text_md").to_pylist():
                words = [w for r in BROKEN.sub("", canonical(t)).split() if (w := CORE[r])]
                if len(words) > 1:
                    crc = np.fromiter(map(zlib.crc32, map(second.__getitem__, words[1:]), map(first.__getitem__, words)), np.int64, len(words) - 1)
                    counts.update(f"{words[i]} {words[i + 1]}" for i in np.flatnonzero(bits.hits(crc)))
            if len(counts) > 100_000:
                yield out()
        yield out()

    found = spread(pages.where(F.length("text_md") > 0).select("text_md")).mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return found.join(wanted, "pair", "leftsemi")


# ---------------------------------------------------------------- decoding


#: What stands for a character that can't be read. The logs of the channel of a word that isn't in the corpus, of a true word with a foreign character, and of a word that is true though far rarer than its candidate.
UNREAD, UNKNOWN, MIXED, RARE = "\ufffd", -9.0, -16.0, -12.0


def lattice(words: list[str], spots: list) -> list[list[tuple]]:
    """For each word of a line its candidates (word, count or None, log of the channel). A word that is doubted competes itself; one with a foreign character also with a word that the corpus doesn't have."""
    options: list[list[tuple]] = [[(w, None, 0.0)] for w in words]
    for s in spots:
        found = [(c["word"], c["n_word"], c["log_p"]) for c in s["candidates"] or []]
        w, n = words[s["place"]], s["n_form"] or 1
        if s["sure"]:
            unread = "".join(UNREAD if i in bad else c for bad in [set(foreign(w))] for i, c in enumerate(w))
            options[s["place"]] = [*found, (unread, 0, UNKNOWN), (w, max(n - 1, 0), MIXED)]
        elif found:
            # a word 60 times rarer than its candidate is taken for no word of the corpus, as all its count may be misreadings
            options[s["place"]] = [(w, max(n - 1, 0), 0.0 if max(c[1] for c in found) < 60 * n else RARE), *found]
    return options


def viterbi(words: list[str], options: list[list[tuple]], pairs: dict[tuple[str, str], int], total: int, smooth: float = 2.0) -> list[str]:
    """The likeliest words of a line; the line's own pairs and words don't count for themselves."""

    def prior(n):
        return (n + 0.01) / total if n is not None else 1e-4

    best = [(math.log(prior(n)) + e, [w]) for w, n, e in options[0]]
    for i in range(1, len(options)):
        nxt = []
        for w, n, e in options[i]:
            reach = []
            for (score, path), (v, m, d) in zip(best, options[i - 1]):
                k = pairs.get((v, w), 0)
                if v == words[i - 1] and w == words[i]:
                    k = 0 if MIXED in (d, e) else max(k - 1, 0)  # a misread word with its neighbours is found in the page's copies only
                step = math.log(k + smooth * prior(n)) - (math.log(m + smooth) if m is not None else 0.0)
                reach.append((score + step, path))
            score, path = max(reach, key=lambda x: x[0])
            nxt.append((score + e, [*path, w]))
        best = nxt
    return max(best, key=lambda x: x[0])[1]


def decode(pages: DataFrame, events: DataFrame, fixes: DataFrame, total: int) -> DataFrame:
    """(rec_id, line_no, place, was, word, part): the words found misread and what they are read as; word is null for one that the corpus doesn't have."""
    doubt = events.where("words IS NOT NULL").join(fixes, "form", "left")
    spots = doubt.groupBy("rec_id", "line_no", "place").agg(
        F.first("words").alias("words"), F.max("sure").alias("sure"), F.max("part").alias("part"), F.max("n_form").alias("n_form"),
        F.filter(F.collect_set(F.struct("word", "n_word", "log_p")), lambda c: c["word"].isNotNull()).alias("candidates"),
    )
    lines = spots.where(F.col("sure") | (F.size("candidates") > 0)).groupBy("rec_id", "line_no").agg(F.first("words").alias("words"), F.collect_list(F.struct("place", "sure", "part", "n_form", "candidates")).alias("spots"))
    lines = keep(lines, "p3-doubt")

    def pairs_of(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                options = lattice(r["words"], r["spots"])
                rows += {(r["rec_id"], r["line_no"], f"{a[0]} {b[0]}") for x, y in zip(options, options[1:]) if len(x) > 1 or len(y) > 1 for a in x for b in y}
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.string()])], ["rec_id", "line_no", "pair"])

    wanted = lines.mapInArrow(pairs_of, "rec_id bigint, line_no int, pair string")
    counted = wanted.join(pair_counts(pages, wanted.select("pair").distinct()), "pair").groupBy("rec_id", "line_no").agg(F.collect_list(F.struct("pair", "n")).alias("pairs"))

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                pairs = {tuple(p["pair"].split(" ")): p["n"] for p in r["pairs"] or []}
                got = viterbi(r["words"], lattice(r["words"], r["spots"]), pairs, total)
                for s in r["spots"]:
                    was, word = r["words"][s["place"]], got[s["place"]]
                    if word != was:
                        rows.append((r["rec_id"], r["line_no"], s["place"], was, None if UNREAD in word else word, s["part"]))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["rec_id", "line_no", "place", "was", "word", "part"])

    return lines.join(counted, ["rec_id", "line_no"], "left").mapInArrow(run, "rec_id bigint, line_no int, place int, was string, word string, part int")


def _differs(was: str, word: str | None) -> int:
    """Where a word was misread."""
    if word is None:
        return (foreign(was) or [0])[0]
    return next((i for i, (a, b) in enumerate(zip(was, word)) if a != b), min(len(was), len(word)))


def misread_lines(fixed: DataFrame) -> DataFrame:
    """(rec_id, line_no); in a word broken over two lines, the line that holds the wrong character."""
    at = F.udf(_differs, "int", useArrow=True)
    return fixed.select("rec_id", F.when((F.col("part") > 0) & (at("was", "word") >= F.col("part")), F.col("line_no") + 1).otherwise(F.col("line_no")).alias("line_no")).distinct()


def noise(pages: DataFrame, books: DataFrame, chapters: DataFrame):
    """((rec_id, line_no, kind) each once, the corrections of `decode`)."""
    words = keep(word_counts(pages), "p3-words")
    total = words.agg(F.sum("n")).first()[0] or 1
    fixes = keep(corrections(words), "p3-fixes")
    events = keep(line_events(pages, books, Bits(fixes.select("form").distinct())), "p3-events")
    fixed = keep(decode(pages, events, fixes, total), "p3-fixed")
    titles = keep(titles_of(books, chapters), "p3-titles")
    placed = furniture(keep(edges(pages, books, Titles(titles)), "p3-lines"), titles)
    text = misread_lines(fixed).select("rec_id", "line_no", F.lit("misread").alias("kind")).unionByName(events.where("words IS NULL").select("rec_id", "line_no", F.lit("broken_word").alias("kind")))
    placed = keep(placed, "p3-furniture")
    return placed.unionByName(text.join(placed, ["rec_id", "line_no"], "left_anti").distinct()), fixed


# ---------------------------------------------------------------- repaired text


def rebuilt(text: str, drop: set[int], fixes: list[dict]) -> tuple[list[str], bool]:
    """(paragraphs, whether the last goes on inside a word): a page's text in canonical characters without furniture, misread words replaced, broken words and wrapped lines joined. Headings, verse, tables and lists keep their lines."""
    lines = canonical_lines(text)
    is_prose = prose(lines)
    put: dict[int, dict[str, str]] = defaultdict(dict)
    for f in fixes:
        if f["word"]:
            put[f["line_no"]][f["was"]] = f["word"]
            if f["part"]:
                put[f["line_no"] + 1][f["was"]] = f["word"]
    out: list[str] = []
    open_, hanging = False, False
    for no, (s, p) in enumerate(zip(lines, is_prose), 1):
        if no in drop:
            continue
        if not p:
            open_ = False
            if s.strip():
                out.append(s)
                hanging = False
            continue
        s = s.strip()
        if open_:
            s = out.pop()[:-1] + s if hanging else out.pop() + " " + s
        hanging = breaks(s)
        if put[no]:  # once joined, a broken word is one token like any other
            s = re.sub(r"\S+", lambda m: m[0].replace(w, put[no][w]) if (w := CORE[m[0]]) in put[no] else _edge(m[0], put[no]), s)
        out.append(s)
        open_ = True
    return out, hanging


def _edge(token: str, put: dict[str, str]) -> str:
    """A token whose first or last letter was taken for a mark."""
    for was, word in put.items():
        for c in EDGES:
            if token.startswith(was + c) and word.startswith(was):
                return word + token[len(was) + 1 :]
            if c + was in token and word.endswith(was) and word != was:
                return token.replace(c + was, word)
    return token


def paragraphs(pages: DataFrame, flags: DataFrame, furniture_and_text: DataFrame, fixed: DataFrame, books: DataFrame) -> DataFrame:
    """(book, page, n, to_page, text): the paragraphs of the last attempt at each page of the scanned and mixed books, without running lines, page numbers and lines of the kind `origin_line`.

    A page's last paragraph takes in the first of the next page where it ends inside a word, or where both pages' flags say so; n counts from 1 on the page where a paragraph begins. The order of pages is kept by windows over rows without texts; only the parts of one paragraph meet."""
    ours = scanned_books(books)
    w = W.partitionBy("book", "page").orderBy(F.desc("attempt"), F.desc("rec_id"))
    last = pages.select("rec_id", "book", "page", "attempt").dropDuplicates(["rec_id"]).join(ours, "book", "leftsemi").withColumn("r", F.row_number().over(w)).where("r = 1").select("rec_id", "book", "page")
    drop = furniture_and_text.where("kind IN ('running_line', 'page_number', 'origin_line')").groupBy("rec_id").agg(F.collect_set("line_no").alias("dropped"))
    fixes = fixed.groupBy("rec_id").agg(F.collect_list(F.struct("line_no", "was", "word", "part")).alias("fixes"))
    texts = pages.select("rec_id", "text_md").dropDuplicates(["rec_id"]).where(F.length("text_md") > 0)
    rows = texts.join(last, "rec_id").join(drop, "rec_id", "left").join(fixes, "rec_id", "left")
    names, types = ["rec_id", "book", "page", "n", "text", "hanging"], [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]

    def run(batches):
        for batch in slices(batches, "text_md"):
            got = []
            for r in batch.to_pylist():
                parts, hanging = rebuilt(r["text_md"], set(r["dropped"] or ()), r["fixes"] or [])
                got += [(r["rec_id"], r["book"], r["page"], n, t, hanging and n == len(parts)) for n, t in enumerate(parts, 1)]
            columns = list(zip(*got)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    parts = keep(rows.select("rec_id", "book", "page", "text_md", "dropped", "fixes").mapInArrow(run, "rec_id bigint, book string, page int, n int, text string, hanging boolean"), "p3-parts")
    markup = F.col("text").rlike(r"^\s*(#|\||>|```|\[\^|[-*•] |\d+[.)] )")
    ends = parts.select("rec_id", "book", "page", "n", "hanging", markup.alias("markup")).groupBy("rec_id", "book", "page").agg(F.max("n").alias("last"), F.max("hanging").alias("hanging"), F.max_by("markup", "n").alias("last_markup"), F.min_by("markup", "n").alias("first_markup"))
    said = flags.select("rec_id", "starts_mid_paragraph", "continues_next").dropDuplicates(["rec_id"])
    ends = keep(ends.join(said, "rec_id", "left"), "p3-ends")
    # the order of pages is followed in blocks of pages, so no task holds a book
    ends = windows.last_before(ends, ["book"], "page", {"p": F.struct("page", "last_markup", "hanging", "continues_next")})
    joins = (F.col("p.page") == F.col("page") - 1) & ~F.col("first_markup") & ~F.col("p.last_markup") & (F.col("p.hanging") | (F.col("p.continues_next") & F.col("starts_mid_paragraph")))
    ends = ends.withColumn("joins", F.coalesce(joins, F.lit(False)))
    # a page of one paragraph that goes on passes the join through: the head is the last page before the run of joins that isn't such a page
    starts = ~(F.col("joins") & (F.col("last") == 1))
    through = windows.last_before(ends, ["book"], "page", {"head": F.when(starts, F.struct("page", "last"))})
    joined = through.where("joins").select("rec_id", F.lit(1).alias("n"), F.col("head.page").alias("h_page"), F.col("head.last").alias("h_n"))
    at = parts.join(joined, ["rec_id", "n"], "left").withColumn("h_page", F.coalesce("h_page", "page")).withColumn("h_n", F.coalesce("h_n", "n"))
    whole = F.array_sort(F.collect_list(F.struct("page", "n", "text", "hanging")))
    # a part that ends inside a word is marked by a null character and loses its hyphen when the next part comes
    glue = F.aggregate("p", F.lit(""), lambda s, x: F.concat(F.regexp_replace(s, r"(?s).\x00$", ""), F.when((s == "") | s.endswith("\0"), "").otherwise(" "), x["text"], F.when(x["hanging"], "\0").otherwise("")))
    got = at.groupBy("book", "h_page", "h_n").agg(whole.alias("p"), F.max("page").alias("to_page"))
    return got.select("book", F.col("h_page").alias("page"), F.col("h_n").alias("n"), "to_page", F.regexp_replace(glue, r"\x00$", "").alias("text"))
