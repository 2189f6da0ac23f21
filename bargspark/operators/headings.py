"""Heading candidates from the spans of a page's text layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bargspark.functions import text as X

# The bold bit of a span, how much larger than body text a heading is, and its length.
BOLD, LARGER, LENGTHS = 16, 1.15, (2, 60)


def candidates(spans: DataFrame, key: str = "rec_id") -> DataFrame:
    """Of (key, line, span, text, size, flags): (key, line, text) of the lines that look like headings: all their spans bold, or one larger than 1.15 times the body size; 2 to 60 characters, not digits and marks alone.

    The body size is the one (to a tenth) with most characters, the first seen on ties. Blank spans count for nothing."""
    solid = spans.withColumn("s", X.strip(F.col("text"))).where("s <> ''").withColumn("size", F.round("size", 1))
    sizes = solid.groupBy(key, "size").agg(F.sum(F.length("s")).alias("n"), F.min(F.struct("line", "span")).alias("first"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first"))
    body = sizes.withColumn("r", rank).where("r = 1").select(key, F.col("size").alias("body"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "")
    lines = solid.groupBy(key, "line").agg(X.strip(words).alias("text"), F.min((F.col("flags").bitwiseAND(BOLD) != 0).cast("int")).alias("bold"), F.max("size").alias("top"))
    looks = (F.col("bold") == 1) | (F.col("top") > LARGER * F.col("body"))
    return lines.join(body, key).where(looks & F.length("text").between(*LENGTHS) & F.col("text").rlike(r"[^\p{Nd}\p{P}\p{S}\s]")).select(key, "line", "text")
