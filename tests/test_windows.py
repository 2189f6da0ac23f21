import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bargspark.operators import windows

SCHEMA = "k string, page int, t int, v int"


def rows(spark, n=3000):
    rng = random.Random(6)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(4000)]), i, rng.choice([None, 1, 2, 5])) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def test_against_plain_windows(spark):
    df = rows(spark)
    w = W.partitionBy("k").orderBy("page", "t")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = {r.t: (r.s or 0, r.l, r.r) for r in df.select("t", F.sum("v").over(before).alias("s"), F.last("v", ignorenulls=True).over(before).alias("l"), F.row_number().over(w).alias("r")).collect()}
    got = windows.sums_before(df, ["k"], "page", F.col("v"), "s", ("t",))
    got = windows.last_before(got, ["k"], "page", {"l": F.col("v"), "l2": F.col("v") * 2}, ("t",))
    got = windows.ranked(got, ["k"], F.floor(F.col("page") / 100), "page", "t", name="r").collect()
    assert len(got) == 3000 and {r.t: (r.s, r.l, r.r) for r in got} == want
    assert all(r.l2 == (r.l and r.l * 2) for r in got)


def test_empty(spark):
    df = rows(spark).limit(0)
    assert windows.sums_before(df, ["k"], "page", F.col("v"), "s").count() == 0 and windows.last_before(df, ["k"], "page", {"l": F.col("v")}).count() == 0
