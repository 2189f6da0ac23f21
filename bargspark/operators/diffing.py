"""What changed between two texts of a page: signals, hunks, their application, and the findings they belong to.

Differences are those of the Ratcliff-Obershelp matcher of the standard library,
computed in Arrow batches only for rows whose texts differ; what follows the
differences is Column expressions again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bargspark.functions import text as X
from bargspark.functions.batches import slices

# Endings joined to a final heh, what counts as punctuation, the least part of a snippet's words, the first id of findings.
HEH = re.compile("ه(?:‌|ها|ای|اش|ام|اند|یی|تر|تری)")
PUNCTUATION, LINKED, FINDINGS = re.compile("[،؛؟«».:]"), 0.4, 100_000
_FIELDS = {"id": T.IntegerType(), "old": T.StringType(), "new": T.StringType(), "ctx_before": T.StringType(), "ctx_after": T.StringType(), "is_unique": T.BooleanType(), "occurrence": T.IntegerType(), "ws_only": T.BooleanType(), "show_before": T.StringType(), "show_after": T.StringType()}
HUNK = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _FIELDS.items()]))


def _changes(a: list, b: list) -> list[tuple[int, int, int, int]]:
    return [op[1:] for op in SequenceMatcher(None, a, b, False).get_opcodes() if op[0] != "equal"]


def _in_verse(lines: list[str]) -> list[bool]:
    out, tag = [], None
    for s in map(str.strip, lines):
        edge = s.startswith("```")
        out.append(not edge and tag == "verse")
        if edge:
            tag = s[3:].strip() if tag is None else None
    return out


def signals(old: str | None, new: str | None) -> list[str]:
    """What kinds of marks the change touches, sorted: lines of headings, tables and verse; non-joiners, heh boundaries, digits, punctuation and notes in changed words."""
    old, new = old or "", new or ""
    found: set[str] = set()
    sides = old.splitlines(), new.splitlines()
    verse = tuple(map(_in_verse, sides))
    for i, j, k, m in _changes(*sides):
        for side, span in ((0, range(i, j)), (1, range(k, m))):
            for n in span:
                s = sides[side][n].strip()
                found |= {name for name, hit in (("heading", s[:1] == "#"), ("table", s[:1] == "|"), ("verse", verse[side][n])) if hit}
    a, b = old.split(), new.split()
    piece = " ".join(w for i, j, k, m in _changes(a, b) for w in (*a[i:j], *b[k:m]))
    tests = {"zwnj": "‌" in piece, "heh_boundary": HEH.search(piece), "digits": re.search("[0-9۰-۹]", piece), "punctuation": PUNCTUATION.search(piece), "footnote": "[^" in piece}
    return sorted(found | {k for k, hit in tests.items() if hit})


def _starts(hay: str, needle: str) -> list[int]:
    if not needle:
        return [0]
    out, at = [], hay.find(needle)
    while at >= 0:
        out.append(at)
        at = hay.find(needle, at + 1)
    return out


def hunks(old: str | None, new: str | None, near: int = 3, far: int = 12, shown: int = 15) -> list[dict]:
    """The changes as pieces that can be applied one by one in any order: put `new` for `old` between the contexts, at that occurrence.

    Tokens keep the white space after them. Changes at most 2 * near + 1 tokens apart are one. Contexts grow until they are found once, and never reach into another change."""
    old, new = old or "", new or ""
    if old == new:
        return []
    cut = [[m.start() for m in re.finditer(r"\S+\s*|\s+", t)] + [len(t)] for t in (old, new)]
    toks = [[t[a:b] for a, b in zip(c, c[1:])] for t, c in zip((old, new), cut)]
    groups: list[list[int]] = []
    for i, j, k, m in _changes(*toks):
        if groups and i - groups[-1][1] <= 2 * near + 1:
            groups[-1][1], groups[-1][3] = j, m
        else:
            groups.append([i, j, k, m])
    at = cut[0]
    last = len(at) - 1
    out = []
    for n, (i, j, k, m) in enumerate(groups):
        room_left = i - (groups[n - 1][1] if n else 0)
        room_right = (groups[n + 1][0] if n + 1 < len(groups) else last) - j

        def window(size: int) -> tuple[int, int]:
            return i - min(size, room_left), j + min(size, room_right)  # noqa: B023

        for size in [*range(near, far, 3), far]:
            lo, hi = window(size)
            found = _starts(old, old[at[lo] : at[hi]])
            if len(found) == 1:
                break
        place = bisect_left(found, at[lo])
        lo_s, hi_s = window(shown)
        before, after = old[at[lo_s] : at[i]], old[at[j] : at[hi_s]]
        piece, put = old[at[i] : at[j]], new[cut[1][k] : cut[1][m]]
        out.append({
            "id": n, "old": piece, "new": put, "ctx_before": old[at[lo] : at[i]], "ctx_after": old[at[j] : at[hi]],
            "is_unique": len(found) == 1, "occurrence": place + 1 if place < len(found) and found[place] == at[lo] else 1, "ws_only": piece.split() == put.split(),
            "show_before": "… " * (lo_s > 0) + before, "show_after": after + " …" * (hi_s < last),
        })
    return out


def apply_hunks(text: str, parts: list[dict], decisions: dict[int, str | None] | None = None) -> str:
    """The text with hunks applied, last first: all of them, or those in `decisions` with their own text where it isn't None. Hunks that aren't found are left out."""
    for h in reversed(parts):
        if decisions is not None and h["id"] not in decisions:
            continue
        put = h["new"] if decisions is None or decisions[h["id"]] is None else decisions[h["id"]]
        found = _starts(text, h["ctx_before"] + h["old"] + h["ctx_after"])
        if h["occurrence"] <= len(found):
            a = found[h["occurrence"] - 1] + len(h["ctx_before"])
            text = text[:a] + put + text[a + len(h["old"]) :]
    return text


def applied(df: DataFrame, key: str, text: str = "text_md") -> DataFrame:
    """Of (key, text, hunks, decisions array<struct<id, text>>): (key, text) with the hunks put in that decisions name, with their own text where it isn't null; all of them where decisions is null."""
    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType())])

    def run(batches):
        for b in slices(batches, text, 4 << 20):
            rows = zip(*(b.column(c).to_pylist() for c in (text, "hunks", "decisions")))
            done = [apply_hunks(t or "", h or [], None if d is None else {x["id"]: x["text"] for x in d}) for t, h, d in rows]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(done, pa.string())], [key, "text"])

    return df.select(key, text, "hunks", "decisions").mapInArrow(run, schema)


def _mapped(df: DataFrame, old: str, new: str, name: str, kind: T.DataType, make, arrow: pa.DataType) -> DataFrame:
    keep = [c for c in df.columns if c not in (old, new)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, kind)])

    def run(batches):
        for b in slices(batches, old, 4 << 20):
            got = [make(x, y) for x, y in zip(b.column(old).to_pylist(), b.column(new).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got, arrow)], [*keep, name])

    return df.mapInArrow(run, schema)


def with_signals(df: DataFrame, old: str, new: str) -> DataFrame:
    """The other columns and `signals`; rows of equal texts never reach Python."""
    same = df.where(F.col(old).eqNullSafe(F.col(new))).drop(old, new).withColumn("signals", F.array().cast("array<string>"))
    return _mapped(df.where(~F.col(old).eqNullSafe(F.col(new))), old, new, "signals", T.ArrayType(T.StringType()), signals, pa.list_(pa.string())).unionByName(same)


def with_hunks(df: DataFrame, old: str, new: str) -> DataFrame:
    """The other columns and one row per hunk: its fields."""
    from pyspark.sql.pandas.types import to_arrow_type

    got = _mapped(df.where(F.col(old).isNotNull() & F.col(new).isNotNull() & (F.col(old) != F.col(new))), old, new, "h", HUNK, hunks, to_arrow_type(HUNK))
    return got.select(*[c for c in got.columns if c != "h"], F.explode("h").alias("h")).select("*", "h.*").drop("h")


def link(issues: Column, old: Column, new: Column, before: Column, after: Column) -> Column:
    """The place of the issue whose snippet shares the largest part of its words with a hunk and its context, the first on ties; null below 0.4."""
    hay = F.array_distinct(X.words(F.concat_ws(" ", old, new, before, after)))
    score = lambda s: X.let(F.array_distinct(X.words(F.coalesce(s, F.lit("")))), lambda w: F.when(F.size(w) > 0, F.size(F.array_intersect(w, hay)).cast("double") / F.size(w)))
    best = F.array_max(F.transform(issues, lambda x, i: F.struct(score(x["snippet"]).alias("score"), (-i).alias("i"))))
    return F.when(best["score"] >= LINKED, -best["i"])


def findings(df: DataFrame, linked: str = "linked") -> DataFrame:
    """Of (…, text_md, issues, linked array<int>): a row for each issue with a snippet that no hunk is linked to: id, issue_idx, snippet, is_unique."""
    each = df.select(*[c for c in df.columns if c not in ("issues", linked)], F.posexplode("issues").alias("issue_idx", "issue"), F.coalesce(linked, F.array().cast("array<int>")).alias("_l"))
    each = each.where(~F.array_contains("_l", F.col("issue_idx"))).withColumn("snippet", X.strip(F.col("issue.snippet"))).where("snippet <> ''")
    first = F.expr("instr(text_md, snippet)")
    again = F.expr("locate(snippet, text_md, instr(text_md, snippet) + 1)")
    return each.withColumn("id", F.lit(FINDINGS) + F.col("issue_idx")).withColumn("is_unique", (first > 0) & (again == 0)).drop("_l", "issue", "text_md")
