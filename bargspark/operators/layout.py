"""Where a piece of text stands on a page: by share of characters over printed lines (SQL), or over lines found in a scan's pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bargspark.functions import text as X

# How far the counts of text and print may differ, and what is too short to wrap.
RATIO, SHORT = (0.5, 2.0), 14
LINE = ["rec_id", "line"]


def exact_spans(df: DataFrame) -> DataFrame:
    """Of (…, text_md, snippet): adds s and e, the 0-based half-open span of the snippet's first place, null if it isn't found as it is."""
    at = F.expr("instr(text_md, snippet)")
    return df.withColumn("s", F.when((F.length("snippet") > 0) & (at > 0), at - 1)).withColumn("e", F.col("s") + F.length("snippet"))


def shares(queries: DataFrame) -> DataFrame:
    """Of (rec_id, qid, text_md, s, e): (rec_id, qid, chars, total, fa, fb): the span in shares of the page's countable characters."""
    c = lambda a, n: X.countable(F.substring("text_md", a, n))
    got = queries.where("s IS NOT NULL").select("rec_id", "qid", X.countable(F.col("text_md")).alias("total"), c(F.lit(1), F.col("s").cast("int")).alias("a"), c((F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")).alias("chars"))
    fa, fb = F.col("a").cast("double") / F.col("total"), (F.col("a") + F.col("chars")).cast("double") / F.col("total")
    return got.where("total > 0").select("rec_id", "qid", "chars", "total", fa.alias("fa"), fb.alias("fb"))


def line_shares(lines: DataFrame, weight: str) -> DataFrame:
    """Adds ls, le: each line's range of the page's weight, in order of (y0 to one place, x0)."""
    w = W.partitionBy("rec_id").orderBy(F.round("y0", 1), "x0", "line")
    total = F.sum(weight).over(W.partitionBy("rec_id"))
    upto = F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("page_weight", total).withColumn("ls", (upto - F.col(weight)).cast("double") / total).withColumn("le", upto.cast("double") / total).where("page_weight > 0")


def hits(spans: DataFrame, lines: DataFrame, weight: str, nearest: bool) -> DataFrame:
    """(rec_id, qid, line, u0, u1, overlap): the lines a span overlaps and its range within each. With `nearest`, a span that overlaps none takes the line that holds its start, else the one whose middle is nearest.

    An equi-join on the page with the ranges as a filter; pages have few lines, so it grows with queries times lines of their own page."""
    ranged = line_shares(lines, weight)
    both = spans.join(ranged.select("rec_id", "line", "ls", "le", "page_weight"), "rec_id")
    if nearest:
        ratio = F.col("page_weight") / F.col("total")
        both = both.where(ratio.between(*RATIO))
        over = (F.col("le") > F.col("fa")) & (F.col("ls") < F.col("fb"))
        rank = F.when(over, 0).when((F.col("ls") <= F.col("fa")) & (F.col("fa") < F.col("le")), 1).otherwise(2)
        w = W.partitionBy("rec_id", "qid")
        both = both.withColumn("rank", rank).withColumn("best", F.min("rank").over(w)).where("rank = best")
        order = F.row_number().over(w.orderBy(F.when(F.col("rank") == 2, F.abs((F.col("ls") + F.col("le")) / 2 - F.col("fa"))).otherwise(F.lit(0.0)), "line"))
        both = both.withColumn("n", order).where("rank = 0 OR n = 1")
    else:
        both = both.where("le > fa AND ls < fb")
    width = F.nullif(F.col("le") - F.col("ls"), F.lit(0.0))
    u0, u1 = (F.greatest("fa", "ls") - F.col("ls")) / width, (F.least("fb", "le") - F.col("ls")) / width
    return both.select("rec_id", "qid", "line", u0.alias("u0"), u1.alias("u1"), (F.least("fb", "le") - F.greatest("fa", "ls")).alias("overlap"), "chars")


def word_extents(found: DataFrame, words: DataFrame) -> DataFrame:
    """Of hits and (rec_id, line, word, x0, y0, x1, y1, chars): the box of the words of each hit that its range overlaps, counted from the right; the word at the range's start if it overlaps none."""
    w = W.partitionBy(*LINE).orderBy(F.desc("x1"), "word")
    total = F.sum("chars").over(W.partitionBy(*LINE))
    upto = F.sum("chars").over(w.rowsBetween(W.unboundedPreceding, 0))
    ranged = words.withColumn("place", F.row_number().over(w) - 1).withColumn("of", F.count("*").over(W.partitionBy(*LINE))).withColumn("w0", (upto - F.col("chars")).cast("double") / total).withColumn("w1", upto.cast("double") / total)
    lo = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("u0")))
    hi0 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("u1")))
    hi = F.when(hi0 <= lo, F.least(F.lit(1.0), lo + 1e-6)).otherwise(hi0)
    both = found.select("rec_id", "qid", "line", lo.alias("lo"), hi.alias("hi")).join(ranged.drop("chars"), LINE)
    over = (F.col("w1") > F.col("lo")) & (F.col("w0") < F.col("hi"))
    fallback = F.col("place") == F.least(F.floor(F.col("lo") * F.col("of")), F.col("of") - 1)
    any_ = F.max(over.cast("int")).over(W.partitionBy("rec_id", "qid", "line"))
    return both.withColumn("any", any_).where(over | ((F.col("any") == 0) & fallback)).groupBy("rec_id", "qid", "line").agg(*(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))


def scan_extents(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Of hits and scan lines (rec_id, line, x0, y0, x1, y1, words): the box of the words of each hit's line that its range overlaps, by width from the right edge; the nearest word if it overlaps none, the bare range if the line has no words."""
    lo = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("u0")))
    hi = F.greatest(lo + 1e-6, F.least(F.lit(1.0), F.col("u1")))
    both = found.select("rec_id", "qid", "line", lo.alias("lo"), hi.alias("hi")).join(lines.select(*LINE, "x0", "y0", "x1", "y1", "words"), LINE)
    wide = F.col("x1") - F.col("x0")
    both = both.withColumn("right", F.col("x1") - F.col("lo") * wide).withColumn("left", F.col("x1") - F.col("hi") * wide)
    over = F.filter("words", lambda w: (w["x1"] > F.col("left")) & (w["x0"] < F.col("right")))
    away = lambda w, i: F.struct(F.abs((w["x0"] + w["x1"]) / 2 - (F.col("left") + F.col("right")) / 2).alias("away"), i.alias("i"), w.alias("w"))
    nearest = F.array(F.array_min(F.transform("words", away))["w"])
    bare = F.array(F.struct(F.col("left").alias("x0"), "y0", F.col("right").alias("x1"), "y1"))
    hit = F.when(F.size("words") == 0, bare).when(F.size(over) > 0, over).otherwise(nearest)
    both = both.withColumn("hit", hit)
    return both.select("rec_id", "qid", "line", *(f(F.col("hit")[c]).alias(c) for f, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))))


def boxes(extents: DataFrame, pages: DataFrame, source: str) -> DataFrame:
    """(rec_id, qid, x0, y0, x1, y1, source): the union of a query's boxes in fractions of its page (rec_id, width, height), held within 0..1."""
    union = extents.groupBy("rec_id", "qid").agg(*(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    part = lambda c, of: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col(of))).alias(c)
    return union.join(pages.select("rec_id", "width", "height"), "rec_id").select("rec_id", "qid", part("x0", "width"), part("y0", "height"), part("x1", "width"), part("y1", "height"), F.lit(source).alias("source"))


def one_line_if_short(found: DataFrame) -> DataFrame:
    """A span too short to wrap keeps only the line that carries most of it, the first on ties."""
    w = W.partitionBy("rec_id", "qid").orderBy(F.desc("overlap"), "line")
    return found.withColumn("n", F.row_number().over(w)).where((F.col("chars") > SHORT) | (F.col("n") == 1)).drop("n")


def placed(*tiers: DataFrame) -> DataFrame:
    """Per query the box of the first tier that has one."""
    best = None
    for n, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(n))
        best = t if best is None else best.unionByName(t)
    w = W.partitionBy("rec_id", "qid").orderBy("tier")
    return best.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "tier")
