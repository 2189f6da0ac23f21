"""The log of findings as a stream: late and repeated events, running feature counts, tumbling windows.

The reference engine has no streaming; these run its batch operators on arriving data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bargspark.operators import history


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of the log as they arrive, a bounded number per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def once_each(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Each event once within the watermark; state older than `late` is dropped."""
    return events.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_issues(events: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """(start, issue_type, n) by day of loading; with a watermark closed days leave the state."""
    w = F.window("loaded_at", window)
    return events.withWatermark("loaded_at", late).groupBy(w, "issue_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "issue_type", "n")


def update_counts(batch: DataFrame, batch_id: int, store: str) -> None:
    """Writes one batch's counts by feature under the batch's number, in place of what an earlier try of the same batch wrote, so a replay counts nothing twice; the table of partial counts is summed by `weights`."""
    once = batch.dropDuplicates(["event_id"])
    total = once.agg(F.lit("*").alias("feature"), F.count("*").alias("n"), F.sum((~F.col("issue_type").eqNullSafe("pass")).cast("long")).alias("issues")).withColumn("kind", F.lit("total"))
    counts = history.event_features(batch).groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.col("is_issue").cast("long")).alias("issues")).withColumn("kind", F.lit("feature"))
    counts.unionByName(total).write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={batch_id}")


def weights(spark: SparkSession, store: str) -> DataFrame:
    """(feature, n, issues, weight) of all batches so far."""
    sums = spark.read.parquet(store).groupBy("kind", "feature").agg(F.sum("n").alias("n"), F.sum(F.coalesce("issues", F.lit(0))).alias("issues"))
    base = sums.where("kind = 'total'").select((F.col("issues").cast("double") / F.col("n")).alias("base"))
    lift = F.greatest(F.lit(history.LOW), F.least(F.lit(history.HIGH), F.try_divide(F.col("issues").cast("double") / F.col("n"), F.col("base"))))
    weight = F.when((F.col("n") < history.SUPPORT) | (F.col("base") == 0), 1.0).otherwise(lift)
    return sums.where("kind = 'feature'").crossJoin(F.broadcast(base)).select("feature", "n", "issues", weight.alias("weight"))  # base has one row
