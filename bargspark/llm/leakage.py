"""Problem 7: passages of evaluation items in training texts, by a generalised suffix automaton.

The items' words (see `word_key`) become numbers; one suffix automaton holds all
substrings of all items. Each task streams the words of its texts through it and
tracks the length of the longest match that ends at each word. Wherever that
length reaches `least` words, the items that hold the last `least` words are
found; the words matched are a leaked span. No shuffle, nothing quadratic.

The automaton is broadcast. Its size follows the items, not the texts: items come
in blocks of at most BLOCK words, each an automaton of flat arrays (about 60 bytes
a word of its items, so 12 MB a block), and up to TOGETHER blocks are broadcast
for one scan of the texts. More items make more scans, never a larger broadcast.
Only one block at a time is on the driver as Python objects (about 0.2 GB).

Defined results: null, empty and word-less texts hold nothing; an item of fewer
than `least` words can't be held; repeated items are all reported; an unknown
word ends every match, a token of punctuation alone is skipped.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Numbers, batch_of, keep, slices, spread
from .visual import canonical_word

BLOCK, TOGETHER = 200_000, 8
KASHIDA = "ـ"


def word_key(token: str) -> str:
    """What a token is compared by; empty for punctuation alone."""
    t = canonical_word(token.replace(KASHIDA, ""))
    t = "".join(c for c in t if unicodedata.category(c)[0] not in "PS")
    return canonical_word(t).strip().casefold() if t else ""


class Automaton:
    """Suffix automaton of several word sequences; `hits[state]` are the items whose text holds the last `least` words of a match ending in it."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.words: dict[str, int] = {}
        step, link, length, held = [{}], [-1], [0], [set()]
        for item, words in items:
            last = 0
            for w in words:
                c = self.words.setdefault(w, len(self.words) + 1)
                if (q := step[last].get(c)) is not None and length[q] == length[last] + 1:
                    last = q
                else:
                    split = q is not None
                    if not split:
                        cur = len(step)
                        step.append({}), link.append(0), length.append(length[last] + 1), held.append(set())
                        p = last
                        while p >= 0 and c not in step[p]:
                            step[p][c] = cur
                            p = link[p]
                        q = step[p][c] if p >= 0 else 0
                    else:
                        p, cur = last, -1
                    if p >= 0 and length[q] != length[p] + 1:
                        copy = len(step)
                        step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1), held.append(set(held[q]))
                        while p >= 0 and step[p].get(c) == q:
                            step[p][c] = copy
                            p = link[p]
                        link[q] = copy
                        q = copy
                    if cur >= 0:
                        link[cur] = q
                        last = cur
                    else:
                        last = q
                p = last
                while p > 0 and item not in held[p]:
                    held[p].add(item)
                    p = link[p]
        self.least, self._numbers = least, None
        # flat and sorted: (state, word) as one number -> next state; the items of state s are items[hit[s]:hit[s + 1]]
        self.width = len(self.words) + 1
        edges = sorted((s * self.width + c, q) for s, found in enumerate(step) for c, q in found.items())
        self.keys, self.targets = array("q", [k for k, _ in edges]), array("i", [q for _, q in edges])
        self.pairs = array("q", sorted({self.words[x] * self.width + self.words[y] for _, words in items for x, y in zip(words, words[1:])}))
        self.link, self.length = array("i", link), array("i", length)
        self.hit, self.items = array("q", [0]), array("q")
        for s in range(len(step)):
            p = s
            while p > 0 and length[link[p]] >= least:
                p = link[p]
            if length[p] >= least:
                self.items.extend(sorted(held[p]))
            self.hit.append(len(self.items))

    def number(self, token: str) -> int:
        """-1: no word; 0: a word of no item."""
        key = word_key(token)
        return self.words.get(key, 0) if key else -1

    def numbers(self) -> Memo:
        """`number` of each token, kept as long as the Python worker keeps the automaton."""
        if self._numbers is None:
            self._numbers = Memo(self.number)
        return self._numbers

    def match(self, numbers: list[int]) -> tuple[set[int], list[tuple[int, int]]]:
        """The items held and the spans (first token, end token) of the longest matches of at least `least` words."""
        found: set[int] = set()
        spans: list[tuple[int, int]] = []
        n = np.fromiter(numbers, np.int64, len(numbers))
        where = np.flatnonzero(n >= 0)  # tokens of punctuation alone are skipped
        words = n[where]
        known = words > 0
        if known.sum() < self.least:
            return found, spans
        # no match leaves a run of words each of which follows the one before it in some item
        pairs = np.frombuffer(self.pairs, np.int64)
        key = words[:-1] * self.width + words[1:]
        at = np.minimum(np.searchsorted(pairs, key), max(0, len(pairs) - 1))
        goes_on = np.concatenate([[False], known[:-1] & known[1:] & (pairs[at] == key if len(pairs) else False)])
        first = np.flatnonzero(known & ~goes_on)
        run = np.cumsum(known & ~goes_on)[known]  # the number of each known word's run, from 1
        size = np.bincount(run, minlength=len(first) + 1)[1:]
        for a, m in zip(first[size >= self.least].tolist(), size[size >= self.least].tolist()):
            self._run(words[a : a + m].tolist(), where[a : a + m].tolist(), found, spans)
        return found, spans

    def _run(self, words: list[int], where: list[int], found: set[int], spans: list[tuple[int, int]]) -> None:
        keys, targets, link, length, least, width = self.keys, self.targets, self.link, self.length, self.least, self.width
        state = size = 0
        for i, c in enumerate(words):
            while True:
                key = state * width + c
                at = bisect_left(keys, key)
                if at < len(keys) and keys[at] == key:
                    state, size = targets[at], size + 1
                    break
                if not state:
                    size = 0
                    break
                state = link[state]
                size = length[state]
            if size >= least:
                found.update(self.items[self.hit[state] : self.hit[state + 1]])
                a, end = where[i - size + 1], where[i] + 1
                if spans and spans[-1][1] > a:
                    spans[-1] = (min(a, spans[-1][0]), end)
                else:
                    spans.append((a, end))


def automata(items: DataFrame, least: int):
    """Of the items in blocks, one at a time; the items themselves are the stated query set."""
    block, size = [], 0
    for r in items.select("item_id", "text").where("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        words = [k for t in r["text"].split() if (k := word_key(t))]
        if size and size + len(words) > BLOCK:
            yield Automaton(block, least)
            block, size = [], 0
        if len(words) >= least:
            block.append((r["item_id"], words))
            size += len(words)
    if block:
        yield Automaton(block, least)


def matches(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """(doc_id, version, item_id, start, end): a row for each item held (item_id) and for each leaked span of tokens (start, end); version tells texts of one doc_id apart. One scan of the texts for TOGETHER blocks of items."""
    texts = spread(docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("version"), "text"))
    ddl = "doc_id bigint, version bigint, item_id bigint, start int, end int"
    fields = {"doc_id": pa.int64(), "version": pa.int64(), "item_id": pa.int64(), "start": pa.int32(), "end": pa.int32()}
    out = docs.sparkSession.createDataFrame([], ddl)
    blocks = automata(items, least)
    while group := list(islice(blocks, TOGETHER)):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches, shared=shared):
            pairs = [(a, a.numbers()) for a in shared.value]
            for batch in slices(batches, "text"):
                rows = []
                for k, v, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text"))):
                    tokens = t.split()
                    for a, n in pairs:
                        held, spans = a.match(list(map(n.__getitem__, tokens)))
                        rows += [(k, v, i, None, None) for i in sorted(held)]
                        rows += [(k, v, None, i, j) for i, j in spans]
                yield batch_of(rows, fields)

        out = out.unionByName(texts.mapInArrow(run, ddl))
    return out


def leaked(docs: DataFrame, items: DataFrame, least: int = 13) -> DataFrame:
    """(doc_id, item_id), each pair once: the text holds at least `least` consecutive words of the item."""
    return matches(docs, items, least).where("item_id IS NOT NULL").select("doc_id", "item_id").distinct()


def cleaned(docs: DataFrame, items: DataFrame, least: int = 13, coverage: float = 0.5) -> DataFrame:
    """(doc_id, n_words, n_leaked, dropped, text) of every document: leaked spans are cut out; a text of which they cover `coverage` or more of the words is dropped as a whole (null).

    Only the texts that may hold a span (by a bit table of their ids) meet the spans in a join; the others pass through."""
    spans = keep(matches(docs, items, least).where("start IS NOT NULL").groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "p7-spans")
    hit = docs.sparkSession.sparkContext.broadcast(Numbers(spans.select("doc_id")))
    may = F.arrow_udf(lambda c: pa.array(hit.value.hits(pc.fill_null(c, 0).to_numpy(zero_copy_only=False))), "boolean")
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text").withColumn("may", may("doc_id"))
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    both = rows.where("may").join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans").unionByName(rows.where("NOT may").select("doc_id", "text", none))
    fields = {"doc_id": pa.int64(), "n_words": pa.int32(), "n_leaked": pa.int32(), "dropped": pa.bool_(), "text": pa.string()}

    def run(batches):
        for batch in slices(batches, "text"):
            out = []
            for k, t, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                tokens = (t or "").split()
                gone = bytearray(len(tokens))
                for x in found or ():
                    gone[x["start"] : x["end"]] = b"\1" * (x["end"] - x["start"])
                lost = sum(gone)
                drop = bool(lost) and lost >= coverage * len(tokens)
                if lost and not drop:
                    parts, end = [], 0
                    for m, g in zip(re.finditer(r"\S+", t), gone):
                        if g:
                            parts.append(t[end : m.start()])
                            end = m.end()
                    t = "".join(parts) + t[end:]
                out.append((k, len(tokens), lost, drop, None if drop else t))
            yield batch_of(out, fields)

    return both.mapInArrow(run, "doc_id bigint, n_words int, n_leaked int, dropped boolean, text string")
