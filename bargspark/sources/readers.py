"""External page readers (models behind a network) as one interface: calls are made once per distinct input, kept as a table, and never from a plan that might run twice."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bargspark.functions.batches import pieces

RETRIES = 3
#: The statuses that pass with time.
PASSING = frozenset({429, 500, 502, 503, 529})


class StatusError(Exception):
    """An answer with a status that says it failed."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"{status} {text}".strip())
        self.status = status


class SchemaError(ValueError):
    """An answer that doesn't have the agreed fields."""


def with_retry(call: Callable, *args, wait: float = 2.0, retry_on: tuple = (ConnectionError, TimeoutError, SchemaError)):
    """Three attempts with growing pauses on lost connections, passing statuses and answers of a wrong shape; other errors pass at once."""
    for n in range(1, RETRIES + 1):
        try:
            return call(*args)
        except Exception as e:
            again = isinstance(e, retry_on) or isinstance(e, StatusError) and e.status in PASSING
            if not again or n == RETRIES:
                raise
            time.sleep(wait * n)


#: The contracts of the readers: what an answer must hold. A name with ? may be missing or null.
CONTRACTS = {
    "transcribe": {"text_md": str, "is_blank": bool, "headings": list, "flags": list, "starts_mid_paragraph": bool, "continues_next": bool, "confidence": (int, float)},
    "verify": {"verdict": str, "issues": list, "suggested_text_md?": str},
    "metadata": {"title_fa?": str, "author_fa?": str, "title_en?": str, "publisher_fa?": str, "language?": str},
}


def agreed(contract: str, answer: str | dict) -> dict:
    """An answer that keeps its contract, as a dict; SchemaError for any other."""
    try:
        found = json.loads(answer) if isinstance(answer, str) else answer
    except ValueError as e:
        raise SchemaError(str(e)) from e
    if not isinstance(found, dict):
        raise SchemaError("no object")
    for name, kind in CONTRACTS[contract].items():
        value = found.get(name.rstrip("?"))
        if value is None and name.endswith("?"):
            continue
        if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
            raise SchemaError(f"{name.rstrip('?')} is {type(value).__name__}")
    if contract == "verify" and found["verdict"] not in ("pass", "fail"):
        raise SchemaError(f"verdict {found['verdict']}")
    return found


def answers(todo: DataFrame, store: str, ask: Callable[[bytes], str | dict], contract: str, pause: float = 2.0) -> DataFrame:
    """Of (content): (key, answer, error), one row per distinct content, the answers as JSON that keeps the contract.

    What the table at `store` holds is not asked again. New answers are appended before anything uses them; one that failed three times is kept with its error and asked again the next time."""
    spark = todo.sparkSession
    schema = "key string, answer string, error string"
    asked = todo.where("content IS NOT NULL").select(F.sha1("content").alias("key"), "content").dropDuplicates(["key"])
    have = spark.read.schema(schema).parquet(store)

    def run(batches):
        for b in pieces(batches, 1 << 20):  # small batches: what is answered leaves the task soon
            rows = []
            for key, content in zip(b.column("key").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows.append((key, json.dumps(with_retry(lambda c=content: agreed(contract, ask(c)), wait=pause), ensure_ascii=False), None))
                except Exception as e:
                    rows.append((key, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["key", "answer", "error"])

    asked.join(have.where("error IS NULL").select("key"), "key", "left_anti").mapInArrow(run, schema).write.mode("append").parquet(store)
    kept = spark.read.schema(schema).parquet(store).join(asked.select("key"), "key", "leftsemi")
    return kept.groupBy("key").agg(F.max("answer").alias("answer"), F.max("error").alias("error")).withColumn("error", F.when(F.col("answer").isNull(), F.col("error")))


def read_once(todo: DataFrame, cache: DataFrame, read: Callable[[list[bytes]], list[list[str]]], store: str) -> DataFrame:
    """Of (content) and a table of answers (key, lines): the answers of every distinct content, new ones appended to the table at `store` before anything uses them. No answer is an answer: it is kept as null and not asked again."""
    asked = todo.where("content IS NOT NULL").select(F.sha1("content").alias("key"), "content").dropDuplicates(["key"])
    new = asked.join(cache.select("key"), "key", "left_anti")

    def run(batches):
        for b in pieces(batches):
            got = with_retry(read, b.column("content").to_pylist())
            got = [*got, *[None] * (b.num_rows - len(got))][: b.num_rows]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(got, pa.list_(pa.string()))], ["key", "lines"])

    new.mapInArrow(run, "key string, lines array<string>").write.mode("append").parquet(store)
    return todo.sparkSession.read.schema("key string, lines array<string>").parquet(store).join(asked.select("key"), "key", "leftsemi")
