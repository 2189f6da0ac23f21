"""The log of findings as files: read whatever state it is in, and added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "date STRING, book STRING, page INT, source_type STRING, model_used STRING, detected_by STRING, issue_type STRING, features STRUCT<flags: ARRAY<STRING>, confidence_bucket: STRING, char_signals: ARRAY<STRING>>"
NAMES = ["date", "book", "page", "source_type", "model_used", "detected_by", "issue_type", "features"]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log that is one JSON document {"events": [...]}; a missing or corrupt one has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(f"events ARRAY<STRUCT<{_struct()}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path).select(F.explode("events").alias("e")).select("e.*")


def _struct() -> str:
    """EVENT as the inside of a struct."""
    head, features = EVENT.split(", features ")
    return ", ".join(f"{n}: {t}" for n, t in (c.split() for c in head.split(", "))) + f", features: {features}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The events of a folder of files with one event a line; lines that are no events, and a missing folder, give none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).where("issue_type IS NOT NULL")


def append(events: DataFrame, path: str) -> None:
    """Adds events to a folder of files; tasks write files of their own, so nothing is locked and readers see whole files."""
    events.select(*NAMES).write.mode("append").json(path)
