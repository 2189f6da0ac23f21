"""Problem 5: text repeated within one origin, by content-defined chunking.

A rolling hash runs over canonical characters (see visual.py; numbers are one
character), and a chunk ends wherever its low bits are zero, so equal passages
fall into equal chunks wherever they stand. Distinct books are counted for each
chunk and origin; chunks of several books are repeated.

* `repeated_chunks` and `without_chunks` do this over whole texts, line breaks
  being white space like any other: passages are found however they are wrapped.
* `repeated` gives whole lines, as the problem is stated: there a line break is a
  cut too, so a line is a whole number of chunks and can be repeated only if all
  its chunks are. Of the lines that remain distinct books are counted exactly,
  per origin and 128-bit digest of the line.

The search is pre-aggregated before its shuffle, so an origin that holds a
third of all rows is spread over all tasks by its chunks, and a chunk found
everywhere leaves each task once. The chunks of several books are broadcast as a
bit table of bounded size (Numbers); were it too full, all lines would go to the
exact count.

Defined results: null and empty texts have no lines; records without origin or
book take no part; lines and chunks of fewer than `letters` letters don't count.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Numbers, batch_of, keep, slices, spread
from .visual import canonical, canonical_lines

SPACE = re.compile(r"\s+")
#: The window of the rolling hash, and the bits of it that are zero at a cut: chunks have about 2**BITS characters.
WINDOW, BITS = 8, 6
#: Fixed: the base of the hash, its inverse and an odd factor for characters (arithmetic modulo 2**64).
BASE, INVERSE, FACTOR = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 0xD6E8FEB86659FD93


class _Tables:
    """Powers of the base and of its inverse, as long as they were needed so far, and which characters are letters; one per Python worker."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.kinds = {}

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            n = 1 << n.bit_length()
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (BASE, INVERSE))
        return self.powers, self.inverses

    def _of(self, test, code: np.ndarray) -> np.ndarray:
        """What a test of characters says: from a table up to U+1FFFF, of each different character beyond."""
        if test not in self.kinds:
            self.kinds[test] = np.fromiter((test(chr(c)) for c in range(0x20000)), bool, 0x20000)
        far = code >= 0x20000
        if not far.any():
            return self.kinds[test][code]
        found = self.kinds[test][np.where(far, 0, code)]
        for c in np.unique(code[far]).tolist():
            found[code == c] = test(chr(c))
        return found

    def is_letter(self, code: np.ndarray) -> np.ndarray:
        return self._of(str.isalpha, code)

    def is_digit(self, code: np.ndarray) -> np.ndarray:
        return self._of(str.isdecimal, code)


TABLES = _Tables()


def codes(keys: list[str]) -> np.ndarray:
    return np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32)


def chunk_hashes(sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of its text, start, end within all characters) of each chunk of texts of these sizes and characters, in order."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3
    power, inverse = TABLES.upto(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR) * power[:n])])
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    cut = np.zeros(n + 1, bool)
    if n >= WINDOW:  # a window that ends before place i, weighed by its distance from there
        cut[WINDOW:] = ((total[WINDOW:] - total[:-WINDOW]) * inverse[WINDOW - 1 : n]) >> np.uint64(64 - BITS) == 0
        for i in range(1, WINDOW):  # no window looks over a text's start
            cut[np.minimum(firsts + i, n)] = False
    cut[firsts] = True
    cut[n] = False
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    found = (total[end] - total[start]) * inverse[start]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    return found.view(np.int64), np.repeat(np.arange(len(sizes)), sizes)[start], start, end


def _source(origin: str) -> int:
    return int.from_bytes(hashlib.blake2b(origin.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


SOURCES = Memo(_source)
#: A row for each text: its lines of enough letters by number, a digest of each, how many chunks each has, and the chunks of all.
LINE_FIELDS = {"rec_id": pa.int64(), "origin": pa.string(), "book": pa.string(), "nos": pa.list_(pa.int32()), "keys": pa.list_(pa.binary()), "sizes": pa.list_(pa.int32()), "chunks": pa.list_(pa.int64())}
LINE_DDL = "rec_id bigint, origin string, book string, nos array<int>, keys array<binary>, sizes array<int>, chunks array<bigint>"


def _of_origin(hashes: np.ndarray, origins: np.ndarray) -> np.ndarray:
    return ((hashes.view(np.uint64) ^ origins) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _with_zeros(code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters and sizes of texts with each number as one zero."""
    digit = TABLES.is_digit(code)
    again = np.concatenate([[False], digit[:-1]]) & digit
    again[np.cumsum(sizes)[:-1]] = False  # a number at the start of a text (none is empty) is the first of its own
    code = np.where(digit, np.uint32(ord("0")), code)[~again]
    return code, sizes - np.add.reduceat(again, np.cumsum(sizes) - sizes, dtype=np.int64)


def line_batch(batch: pa.RecordBatch, texts: list[list[str]], letters: int) -> pa.RecordBatch:
    """LINE_FIELDS of a batch's texts (their canonical lines) that have such lines and an origin and a book; chunks are 64-bit hashes of origin and chunk."""
    own = [None if o is None or b is None else SOURCES[o] for o, b in zip(batch.column("origin").to_pylist(), batch.column("book").to_pylist())]
    rows = [(i, no, x) for i, lines in enumerate(texts) if own[i] is not None for no, line in enumerate(lines, 1) if len(line) >= letters and len(x := line.strip()) >= letters]
    recs, nos, keys = (list(x) for x in zip(*rows)) if rows else ([], [], [])
    code, sizes = codes(keys), np.fromiter(map(len, keys), np.int64, len(keys))
    if rows:
        some = np.add.reduceat(TABLES.is_letter(code), np.cumsum(sizes) - sizes, dtype=np.int64) >= letters
        code, sizes = code[np.repeat(some, sizes)], sizes[some]
        recs, nos = [r for r, ok in zip(recs, some) if ok], [n for n, ok in zip(nos, some) if ok]
    if len(sizes):
        code, sizes = _with_zeros(code, sizes)
    hashes, line, _, _ = chunk_hashes(sizes, code)
    at = np.array(recs, np.int64)
    if len(hashes):
        hashes = _of_origin(hashes, np.array([o or 0 for o in own], np.uint64)[at[line]])
    ends, raw = np.cumsum(sizes) * 4, code.tobytes()
    digests = [hashlib.blake2b(raw[e - n : e], digest_size=16).digest() for e, n in zip(ends.tolist(), (sizes * 4).tolist())]
    texts_of, first = np.unique(at, return_index=True)
    by_text = pa.array(np.append(first, len(at)).astype(np.int32))
    per_line = np.bincount(line, minlength=len(at)) if len(at) else np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(per_line)])[np.append(first, len(at))]
    take = pa.array(texts_of)
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(c).take(take) for c in ("rec_id", "origin", "book")),
            pa.ListArray.from_arrays(by_text, pa.array(nos, pa.int32())), pa.ListArray.from_arrays(by_text, pa.array(digests, pa.binary())),
            pa.ListArray.from_arrays(by_text, pa.array(per_line.astype(np.int32))), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(hashes)),
        ],
        list(LINE_FIELDS),
    )


def _ours(pages: DataFrame, letters: int) -> DataFrame:
    return spread(pages.where("origin IS NOT NULL AND book IS NOT NULL").where(F.length("text_md") >= letters).select("rec_id", "origin", "book", "text_md"))


def lines(pages: DataFrame, letters: int = 25) -> DataFrame:
    """LINE_FIELDS of the texts."""

    def run(batches):
        for batch in slices(batches, "text_md", 1 << 19):  # arrays that fit the processor's cache
            yield line_batch(batch, [canonical_lines(t) for t in batch.column("text_md").to_pylist()], letters)

    return _ours(pages, letters).mapInArrow(run, LINE_DDL)


def repeated(pages: DataFrame, books: int = 3, letters: int = 25, all_lines: DataFrame | None = None) -> DataFrame:
    """(rec_id, line_no), each once: the lines found in records of at least `books` books of their origin. `all_lines` is a kept table of `lines`, where there is one."""
    all_lines = keep(lines(pages, letters), "p5-lines") if all_lines is None else all_lines
    chunk = all_lines.select(F.explode("chunks").alias("chunk"), F.hash("book").alias("book"))
    # one shuffle: of each task at most one row per origin and chunk, with the least and the greatest book it saw
    shared = chunk.groupBy("chunk").agg(F.min("book").alias("a"), F.max("book").alias("b")).where("a <> b")
    known = all_lines.sparkSession.sparkContext.broadcast(Numbers(shared.select("chunk")))

    def lines_of(nos: pa.Array, keys: pa.Array, sizes: pa.Array, chunks: pa.Array) -> pa.Array:
        """The lines all of whose chunks may be repeated."""
        ok = known.value.hits(chunks.flatten().to_numpy(zero_copy_only=False))
        each = sizes.flatten().to_numpy(zero_copy_only=False)
        sure = np.diff(np.concatenate([[0], np.cumsum(ok)])[np.concatenate([[0], np.cumsum(each)])]) == each
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(nos).to_numpy(zero_copy_only=False))])
        left = pa.array(np.concatenate([[0], np.cumsum(sure)])[ends].astype(np.int32))
        keep_ = pa.array(sure)
        return pa.ListArray.from_arrays(left, pa.StructArray.from_arrays([nos.flatten().filter(keep_), keys.flatten().filter(keep_)], ["line_no", "key"]))

    found = F.arrow_udf(lines_of, "array<struct<line_no: int, key: binary>>")("nos", "keys", "sizes", "chunks")
    some = keep(all_lines.select("rec_id", "origin", "book", F.explode(found).alias("l")).select("rec_id", "origin", "book", "l.line_no", "l.key"), "p5-some")
    sure = some.select("origin", "key", F.xxhash64("book").alias("book")).distinct().groupBy("origin", "key").count().where(F.col("count") >= books)
    return some.join(sure, ["origin", "key"], "leftsemi").select("rec_id", "line_no").distinct()


def whole_key(text: str) -> str:
    """A text as its chunks are cut: canonical, white space of any length and kind a space. Numbers stay, so that places stay."""
    return SPACE.sub(" ", canonical(text)).strip()


def repeated_chunks(pages: DataFrame, books: int = 3, letters: int = 25) -> DataFrame:
    """(rec_id, start, end), each once: the chunks of whole texts found in records of at least `books` books of their origin, as places in `whole_key` of the text."""

    def run(batches):
        for batch in slices(batches, "text_md", 1 << 19):
            keys = [whole_key(t) for t in batch.column("text_md").to_pylist()]
            code = codes(keys)
            code = np.where(TABLES.is_digit(code), np.uint32(ord("0")), code)
            hashes, text, start, end = chunk_hashes(np.fromiter(map(len, keys), np.int64, len(keys)), code)
            first = np.cumsum([0, *map(len, keys)])
            enough = np.diff(np.concatenate([[0], np.cumsum(TABLES.is_letter(code))])[np.append(start, len(code))]) >= letters if len(start) else np.zeros(0, bool)
            own = np.array([SOURCES[o] for o in batch.column("origin").to_pylist()], np.uint64)
            take = pa.array(text[enough])
            place = first[text[enough]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rec_id").take(take), batch.column("book").take(take), pa.array(_of_origin(hashes[enough], own[text[enough]])), pa.array((start[enough] - place).astype(np.int32)), pa.array((end[enough] - place).astype(np.int32))],
                ["rec_id", "book", "chunk", "start", "end"],
            )

    chunks = keep(_ours(pages, letters).mapInArrow(run, "rec_id bigint, book string, chunk bigint, start int, end int"), "p5-chunks")
    often = chunks.select("chunk", F.xxhash64("book").alias("book")).distinct().groupBy("chunk").count().where(F.col("count") >= books).select("chunk")
    return chunks.join(often, "chunk", "leftsemi").select("rec_id", "start", "end").distinct()


def without_chunks(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(rec_id, n_cut, text): every record once, its `whole_key` less the chunks found; null texts stay null."""
    cut = found.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut"))  # at most the chunks of one text
    fields = {"rec_id": pa.int64(), "n_cut": pa.int32(), "text": pa.string()}

    def run(batches):
        for batch in slices(batches, "text_md"):
            rows = []
            for k, t, gone in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "text_md", "cut"))):
                t, at, parts = t and whole_key(t), 0, []
                for g in gone or ():
                    parts.append(t[at : g["start"]])
                    at = g["end"]
                rows.append((k, len(gone or ()), "".join([*parts, t[at:]]) if gone else t))
            yield batch_of(rows, fields)

    once = pages.select("rec_id", "text_md").dropDuplicates(["rec_id"]).join(cut, "rec_id", "left")
    return once.mapInArrow(run, "rec_id bigint, n_cut int, text string")


def without(pages: DataFrame, found: DataFrame, key: str = "rec_id") -> DataFrame:
    """Every record once, with `text_md` less the lines found and `n_cut`, how many they were."""
    cut = found.groupBy(key).agg(F.sort_array(F.collect_set("line_no")).alias("__cut"))  # at most the lines of one text
    once = pages.dropDuplicates([key])
    kept = F.array_join(F.filter(F.split("text_md", "\n"), lambda _, i: ~F.array_contains("__cut", i + 1)), "\n")
    return once.join(cut, key, "left").withColumn("text_md", F.when(F.col("__cut").isNull(), F.col("text_md")).otherwise(kept)).withColumn("n_cut", F.coalesce(F.size("__cut"), F.lit(0))).drop("__cut")
