"""Which pages there are: records once, latest attempts, semi and anti joins, page specifications, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import windows

KEY = ["book", "page"]


def once(df: DataFrame, key: str = "rec_id") -> DataFrame:
    """Each record once, however often it was delivered."""
    return df.dropDuplicates([key])


def once_of(table: DataFrame, key: str, *cols: str) -> DataFrame:
    """The columns of a scanned table of files, each record once: the deliveries of a record are told apart by file and row.

    Which records came more than once is found from the keys alone and joined on, so a broadcast (below Spark's threshold) leaves the texts where they are; only beyond it are they shuffled."""
    at = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    again = table.select(F.col(key).alias("_k"), at.alias("_at")).groupBy("_k").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = table.select(*cols, at.alias("_at"))
    return rows.join(again, F.col(key).eqNullSafe(F.col("_k")), "left").where("_first IS NULL OR _at = _first").select(*cols)


def keep_better(attempts: DataFrame, score: Column, *order: str) -> DataFrame:
    """The attempt of the best score per page, the later one on ties; null scores are worst. One shuffle, combined on the map side."""
    best = F.max_by(F.struct(*attempts.columns), F.struct(F.coalesce(score, F.lit(-1.0)), *order))
    return attempts.groupBy(*KEY).agg(best.alias("b")).select("b.*")


def done(texts: DataFrame, fields: DataFrame) -> DataFrame:
    """Pages with a text and fields."""
    return texts.select(*KEY).distinct().join(fields.select(*KEY).distinct(), KEY, "leftsemi")


def missing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return wanted.select(*KEY).distinct().join(have.select(*KEY), KEY, "left_anti")


def page_spec(spec: str | None, last: int) -> list[int]:
    """The pages of '5', '3-10', '3-', '-20', '1,3-5', in order, once, within 1..last. Empty: all; reversed ranges hold none; what is no number raises ValueError."""
    if not (spec or "").strip():
        return list(range(1, last + 1))
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, dash, high = part.partition("-")
        a = int(low) if low.strip() else 1
        b = (int(high) if high.strip() else last) if dash else a
        found.update(range(max(a, 1), min(b, last) + 1))
    return sorted(found)


def in_spec(spec: str, page: Column, last: Column) -> Column:
    """The same as a predicate, for a last page that differs by row; it is pushed down where `last` is a literal."""
    if not spec.strip():
        return page.between(1, last)
    any_ = F.lit(False)
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, dash, high = part.partition("-")
        a = F.lit(int(low) if low.strip() else 1)
        b = (F.lit(int(high)) if high.strip() else last) if dash else a
        any_ = any_ | page.between(a, b)
    return any_ & page.between(1, last)


def classify_sources(texts: DataFrame, long: int = 200, most: float = 0.8, least: float = 0.2) -> DataFrame:
    """(book, pages, share, kind): digital if at least `most` of the pages have a long text, scanned if at most `least`, else mixed."""
    share = F.avg((F.length(F.coalesce("text_md", F.lit(""))) > long).cast("double"))
    found = texts.groupBy("book").agg(F.count("*").alias("pages"), share.alias("share"))
    return found.withColumn("kind", F.when(F.col("share") >= most, "digital").when(F.col("share") <= least, "scanned").otherwise("mixed"))


def usable_layer(texts: DataFrame, sample: int = 5, long: int = 200, ratio: float = 0.3) -> DataFrame:
    """(book, usable): whether any of a book's first long pages has that share of Arabic letters among its characters."""
    from bargspark.functions.text import WHITE

    first = texts.where(F.length("text_md") > long).withColumn("r", F.row_number().over(W.partitionBy("book").orderBy("page", "rec_id"))).where(F.col("r") <= sample)
    solid = F.length(F.regexp_replace("text_md", WHITE, ""))
    arabic = F.length(F.regexp_replace("text_md", "[^؀-ۿ]", ""))
    hit = first.groupBy("book").agg(F.max((arabic >= ratio * solid).cast("int")).alias("hit"))
    return texts.select("book").distinct().join(hit, "book", "left").select("book", (F.coalesce("hit", F.lit(0)) == 1).alias("usable"))


def review_budget(pages: DataFrame, flagged: Column, quality: Column, part: int = 5) -> DataFrame:
    """Flagged pages in rising quality up to a `part`-th of all the book's pages, rounded up; the rest of them is skipped: adds `surfaced` and `skipped`.

    The rank is over flagged pages only, and the books' totals are a small aggregate joined on, so no window holds unflagged pages. Pages are ranked within
    thousandths of quality, these within blocks of pages of one quality (windows.ranked), so no task ranks a whole book."""
    total = pages.groupBy("book").agg(F.ceil(F.count("*") / part).alias("budget"))
    hot = pages.where(flagged).withColumn("_q", F.coalesce(quality, F.lit(0.0))).withColumn("_t", F.floor(F.col("_q") * 1000))
    hot = windows.ranked(hot, ["book", "_t"], F.struct("_q", F.floor(F.col("page") / windows.BLOCK).alias("b")), "_q", "page", name="_in")
    size = hot.groupBy("book", "_t").agg(F.count("*").alias("_n"))
    before = size.withColumn("_c", F.coalesce(F.sum("_n").over(W.partitionBy("book").orderBy("_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    hot = windows.joined(hot, before, ["book", "_t"]).withColumn("rank", F.col("_in") + F.col("_c")).drop("_q", "_t", "_in", "_c")
    return hot.join(total, "book").withColumn("surfaced", F.col("rank") <= F.col("budget")).withColumn("skipped", F.col("rank") > F.col("budget"))


def sample_order(seed: str, *keys: str) -> Column:
    """A fixed random order of rows, the same on every engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def verify_selection(pages: DataFrame, forced: Column, risk: Column, threshold: float = 0.15, part: float = 0.05, seed: str = "barg") -> DataFrame:
    """(…, why): forced pages, pages at risk, and a sample of a twentieth (half to even, one at least) of each book's clean ones."""
    kind = pages.withColumn("kind", F.when(forced, "forced").when(risk >= threshold, "risky").otherwise("clean"))
    clean = kind.where("kind = 'clean'")
    size = clean.groupBy("book").agg(F.least(F.count("*"), F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(part), 0).cast("long"))).alias("k"))
    order = sample_order(seed, "book", "page")
    ranked = windows.ranked(clean.withColumn("_o", order), ["book"], F.substring("_o", 1, 3), "_o", name="r").drop("_o")
    sampled = ranked.join(size, "book").where("r <= k").drop("r", "k").withColumn("kind", F.lit("sample"))
    return kind.where("kind <> 'clean'").unionByName(sampled).withColumnRenamed("kind", "why")
