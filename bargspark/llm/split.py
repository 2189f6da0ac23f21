"""Problem 8: oversized texts cut into pieces at natural boundaries, by pointer doubling.

Every token boundary of a text that ends a chapter, paragraph, line, sentence or
word is a possible end of a piece. Each is joined to its farthest legal
successor: the next piece starts `overlap` tokens before it and ends at most
`limit` tokens later, at the farthest boundary of the strongest kind in the
second half of that window, else at the farthest boundary of any kind, else
(no boundary at all) at the farthest whole character. The successor table is
then squared again and again; after k rounds the set reached from the text's
start holds 2**k cuts, so all cuts come out in log2(pieces) rounds. The tables
of one text are arrays of one task; nothing is shuffled.

Defined results: texts of at most `limit` tokens (null, empty and white-space
texts too) have no pieces; ties take the farther boundary; the last piece ends
with the text; limits so small that a whole character doesn't fit are an error,
as no piece may be larger. A piece's token range shares exactly `overlap` tokens with the
one before. Where its first token begins inside a character, the piece's text
begins with that whole character.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, spread
from .encode import Encoder, encoder, vocab_path

#: The kinds of boundary from strong to weak, the words that open a chapter and the marks that end a sentence.
KINDS = ["token", "word", "sentence", "line", "paragraph", "chapter"]
CHAPTER = re.compile(r"\s*(?:#{1,6} |(?:فصل|بخش|گفتار|درس|پاره|باب|chapter|part)[ ‌]+[0-9۰-۹٠-٩ivxlc]+\b)", re.I)
SENTENCE_END = re.compile(r"[.!?؟؛…۔][»”\"')\]]*$")


def boundary_kinds(fragments: list[str]) -> np.ndarray:
    """The kind of the boundary after each fragment but the last."""
    out = np.ones(max(0, len(fragments) - 1), np.int8)
    for i, nxt in enumerate(fragments[1:]):
        if (n := nxt.count("\n") or nxt.count("\r")) and CHAPTER.match(" ".join(fragments[i + 1 : i + 3]) if nxt.strip() != "#" else nxt.strip() + " "):
            out[i] = 5
        elif n:
            out[i] = 4 if n > 1 else 3
        elif SENTENCE_END.search(fragments[i]):
            out[i] = 2
    return out


def successors(at: np.ndarray, kind: np.ndarray, total: int, limit: int, overlap: int) -> np.ndarray:
    """For each boundary at[i] the index of its farthest legal successor; the end is its own."""
    start = np.maximum(at - overlap, 0)
    high, half = np.minimum(start + limit, total), np.maximum(start + limit // 2, at)
    chosen = np.full(len(at), -1)
    for least, low in [(k, half) for k in range(5, 0, -1)] + [(1, at), (0, at)]:
        pool = np.flatnonzero(kind >= least)
        i = np.searchsorted(at[pool], high, "right") - 1
        found = pool[np.maximum(i, 0)] if len(pool) else np.zeros(len(at), int)
        good = (chosen < 0) & (i >= 0) & (at[found] > low)
        chosen[good] = found[good]
    chosen[start + limit >= total] = len(at) - 1
    if (chosen < 0).any():
        raise ValueError(f"a piece of at most {limit} tokens, {overlap} of them shared, can't hold the next whole character")
    return chosen


def doubled(table: np.ndarray) -> np.ndarray:
    """All indices reached from index 0, by squaring the table."""
    reached = np.zeros(1, int)
    while True:
        more = np.union1d(reached, table[reached])
        if len(more) == len(reached):
            return more
        reached, table = more, table[table]


def cut(enc: Encoder, text: str, limit: int, overlap: int):
    """[(first token, end token, first byte, end byte, kind)] of a text, [] if it isn't too long."""
    fragments = enc.fragments(text)
    parts = [enc.memo[f] for f in fragments]
    sizes = np.fromiter((len(p) // 4 for p in parts), int, len(parts))
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if total <= limit:
        return []
    ids = np.frombuffer(b"".join(parts), np.int32)
    byte = np.concatenate([[0], np.cumsum(enc.token_bytes[ids], dtype=np.int64)])
    raw = np.frombuffer(text.encode(), np.uint8)
    kind = np.full(total + 1, -1, np.int8)
    for i in np.flatnonzero(sizes > (limit - overlap) // 4):  # inside huge fragments whole characters are boundaries too
        p = np.arange(ends[i] - sizes[i] + 1, ends[i])
        kind[p] = np.where(raw[byte[p]] & 0xC0 == 0x80, -1, 0)
    kind[ends[:-1]] = boundary_kinds(fragments)
    kind[0] = 0
    kind[total] = 5
    at = np.flatnonzero(kind >= 0)
    kinds = kind[at]
    kinds[0] = -1
    chosen = at[doubled(successors(at, kinds, total, limit, overlap))]
    out = []
    for before, end in zip(chosen[:-1], chosen[1:]):
        start = max(int(before) - overlap, 0)
        first = int(byte[start])
        while first and raw[first] & 0xC0 == 0x80:
            first -= 1
        out.append((start, int(end), first, int(byte[end]), "end" if end == total else KINDS[kind[end]]))
    return out


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2048, overlap: int = 128, path: str | None = None, with_text: bool = True) -> DataFrame:
    """(key, piece, tok_start, tok_end, n_tokens, ends_at[, text]) of the texts of more than `limit` tokens; piece counts from 1."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    path = path or vocab_path()
    fields = [T.StructField(key, df.schema[key].dataType), *(T.StructField(n, T.IntegerType()) for n in ("piece", "tok_start", "tok_end", "n_tokens")), T.StructField("ends_at", T.StringType())]
    if with_text:
        fields.append(T.StructField("text", T.StringType()))
    names = [f.name for f in fields]

    def run(batches):
        enc = encoder(path)
        for batch in slices(batches, "__text"):
            rows = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column("__text").to_pylist()):
                found = cut(enc, t, limit, overlap)
                raw = t.encode() if found and with_text else b""
                for n, (a, b, i, j, kind) in enumerate(found, 1):
                    rows.append((k, n, a, b, b - a, kind, *([raw[i:j].decode()] if with_text else [])))
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(key).type, *[pa.int32()] * 4, pa.string(), pa.string()])], names)

    # a token is at least a byte, so shorter texts can't be too long; they never reach Python
    long = df.where(F.octet_length(text) > limit).select(key, F.col(text).alias("__text"))
    return spread(long).mapInArrow(run, T.StructType(fields))
