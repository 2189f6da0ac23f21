"""Running values over long sequences in two levels, so that no task holds all rows of one key.

A window over a book's pages alone puts the book into one task. Here the pages
come in blocks of BLOCK: one window runs within each block, a second one over one
row per block, and the two are added. A book of a third of all rows is then
spread over as many tasks as it has blocks.

Defined results: null keys and null orders are values like any other, nulls come
first; rows equal in all of the order come in any order among themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 512


def joined(rows: DataFrame, per: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which nulls are equal; the columns of `on` are kept once."""
    other = per.select(*(F.col(c).alias(f"_r_{c}") for c in on), *(c for c in per.columns if c not in on))
    return rows.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])).drop(*(f"_r_{c}" for c in on))


def _block(order: str) -> Column:
    return F.floor(F.col(order) / BLOCK)


def sums_before(df: DataFrame, by: list[str], order: str, value: Column, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds `name`, the sum of `value` over the rows of the same keys that come earlier by (order, *ties); 0 for the first. `order` is an integer."""
    on = [*by, "_block"]
    d = df.withColumn("_block", _block(order)).withColumn("_v", value)
    per = d.groupBy(*on).agg(F.sum("_v").alias("_s"))
    carry = per.withColumn("_c", F.sum("_s").over(W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))).drop("_s")
    here = F.sum("_v").over(W.partitionBy(*on).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1))
    zero = F.lit(0)
    return joined(d.withColumn("_h", here), carry, on).withColumn(name, F.coalesce("_h", zero) + F.coalesce("_c", zero)).drop("_block", "_v", "_h", "_c")


def last_before(df: DataFrame, by: list[str], order: str, values: dict[str, Column], ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds for each name the last value that isn't null among the earlier rows of the same keys by (order, *ties)."""
    on = [*by, "_block"]
    d = df.withColumn("_block", _block(order))
    for i, v in enumerate(values.values()):
        d = d.withColumn(f"_v{i}", v)
    place = F.struct(order, *ties)
    per = d.groupBy(*on).agg(*(F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), place)).alias(f"_s{i}") for i in range(len(values))))
    over = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = per.select(*on, *(F.last(f"_s{i}", ignorenulls=True).over(over).alias(f"_c{i}") for i in range(len(values))))
    within = W.partitionBy(*on).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    d = d.select("*", *(F.last(f"_v{i}", ignorenulls=True).over(within).alias(f"_h{i}") for i in range(len(values))))
    got = joined(d, carry, on)
    return got.select(*df.columns, *(F.coalesce(f"_h{i}", f"_c{i}").alias(name) for i, name in enumerate(values)))


def ranked(df: DataFrame, by: list[str], bucket: Column, *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds the row number by (bucket, *order) within the keys: rows are numbered within their bucket, buckets are counted. A bucket must be small against its key and rise with the order."""
    on = [*by, "_bucket"]
    d = df.withColumn("_bucket", bucket)
    per = d.groupBy(*on).agg(F.count("*").alias("_n"))
    carry = per.withColumn("_c", F.sum("_n").over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).drop("_n")
    d = d.withColumn("_h", F.row_number().over(W.partitionBy(*on).orderBy(*order)))
    return joined(d, carry, on).withColumn(name, F.col("_h") + F.coalesce("_c", F.lit(0))).drop("_bucket", "_h", "_c")
