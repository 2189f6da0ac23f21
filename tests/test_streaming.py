import datetime as dt

from bargspark.operators import history
from bargspark.streaming import history as stream

SCHEMA = "event_id bigint, book string, page int, source_type string, model_used string, detected_by string, issue_type string, features struct<flags: array<string>, confidence_bucket: string, char_signals: array<string>>, loaded_at timestamp"


def rows(lo, hi):
    return [(i, "b", i % 7, "scanned", "ab"[i % 2], "auto_qc", "pass" if i % 3 else "wrong_word", (["table"] if i % 5 == 0 else None, "<0.7", None), dt.datetime(2025, 1, 1 + i % 20)) for i in range(lo, hi)]


def test_stream_equals_batch(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "counts")
    all_rows = [*rows(0, 60), *rows(40, 80)]
    for part in (rows(0, 60), rows(40, 80)):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(src)
    events = stream.once_each(stream.read_events(spark, src, spark.read.parquet(src).schema), "365 days")
    events.writeStream.foreachBatch(lambda b, i: stream.update_counts(b, i, store)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r) for r in history.feature_weights(spark.createDataFrame(all_rows, SCHEMA)).collect()}
    assert {tuple(r) for r in stream.weights(spark, store).collect()} == want


def test_daily_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(rows(0, 40), SCHEMA).write.parquet(src)
    df = stream.daily_issues(stream.read_events(spark, src, spark.read.parquet(src).schema))
    q = df.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start()
    q.awaitTermination()
    assert spark.table("daily").groupBy().sum("n").first()[0] == 40
