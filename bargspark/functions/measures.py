"""Similarity, boxes and buckets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two bags (array<struct<w, n>>, each word once); 0 if either is empty or null.

    Both bags are sorted together, so that a word of both stands beside itself: n log n a pair, no map and no join."""
    both = let(F.array_sort(F.concat(a, b)), lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(m) - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + F.when(F.get(m, i)["w"] == F.get(m, i - 1)["w"], (F.get(m, i)["n"] * F.get(m, i - 1)["n"]).cast("double")).otherwise(0.0)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x["n"] * x["n"]).cast("double")))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def bag_size(b: Column) -> Column:
    return F.aggregate(b, F.lit(0), lambda s, x: s + x["n"].cast("int"))


def clean_bbox(b: Column) -> Column:
    """Four numbers rounded and held within 0..1000, null if they aren't four or the box has no width or height."""
    v = F.transform(b, lambda x: F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(x.cast("double"), 0).cast("int"))))
    whole = (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull())
    return F.when(whole & (F.get(v, F.lit(0)) < F.get(v, F.lit(2))) & (F.get(v, F.lit(1)) < F.get(v, F.lit(3))), v)


def bbox_to_box(b: Column) -> Column:
    """A clean box in fractions of the page: struct<x0, y0, x1, y1>, null where it isn't one."""
    x = [F.get(b, F.lit(i)).cast("double") / F.lit(1000.0) for i in range(4)]
    ok = (F.size(b) == 4) & (x[0] >= 0) & (x[0] < x[2]) & (x[2] <= 1) & (x[1] >= 0) & (x[1] < x[3]) & (x[3] <= 1)
    return F.when(ok, F.struct(*(c.alias(n) for c, n in zip(x, ("x0", "y0", "x1", "y1")))))


def bucket(confidence: Column) -> Column:
    """The four half-open buckets of a confidence; null for null and not-a-number."""
    c = F.nanvl(confidence, F.lit(None).cast("double"))
    return F.when(c < 0.7, "<0.7").when(c < 0.8, "0.7-0.8").when(c < 0.9, "0.8-0.9").when(c.isNotNull(), "0.9-1.0")
