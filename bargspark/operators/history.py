"""The log of findings: features of events, their lift, and the risk of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bargspark.functions import measures as M

# The signal of an issue type, who counts as human, the bounds of a lift.
SIGNALS = {"missing_heading": "heading", "wrong_heading_level": "heading", "zwnj_error": "zwnj", "heh_boundary": "heh_boundary", "footnote_marker": "footnote", "digit_error": "digits", "punctuation": "punctuation", "verse_structure": "verse", "table_structure": "table"}
HUMANS = ["human_edit", "suggestion_accepted", "suggestion_edited", "suggestion_rejected"]
SUPPORT, LOW, HIGH = 3, 0.5, 3.0


def signal(issue_type: Column) -> Column:
    """The signal of a type, null for types without one."""
    pairs = [F.lit(x) for kv in SIGNALS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), issue_type)


def _named(name: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.when(v != "", F.concat(F.lit(name + ":"), v)))


def features(source: Column, model: Column, flags: Column, bucket: Column, signals: Column | None = None) -> Column:
    """The features in fixed order; null and empty ones are left out."""
    parts = [_named("source", F.array(source)), _named("model", F.array(model)), _named("flag", flags), _named("conf", F.array(bucket))]
    return F.filter(F.concat(*parts, *([_named("signal", signals)] if signals is not None else [])), lambda f: f.isNotNull())


def event_features(events: DataFrame) -> DataFrame:
    """(event_id, is_issue, feature): each feature of an event once."""
    f = features(F.col("source_type"), F.col("model_used"), F.col("features.flags"), F.col("features.confidence_bucket"), F.col("features.char_signals"))
    once = events.dropDuplicates(["event_id"])
    return once.select("event_id", (~F.col("issue_type").eqNullSafe("pass")).alias("is_issue"), F.explode(F.array_distinct(f)).alias("feature"))


def feature_weights(events: DataFrame) -> DataFrame:
    """(feature, n, issues, weight): the issue rate of a feature over that of all events within 0.5 and 3; 1 for features seen fewer than three times or if there are no issues.

    The total is one row; the counts are combined before their shuffle, whose size is the number of features, not of events."""
    once = events.dropDuplicates(["event_id"])
    base = once.agg(F.avg((~F.col("issue_type").eqNullSafe("pass")).cast("double")).alias("base"))
    counted = event_features(events).groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.col("is_issue").cast("long")).alias("issues"))
    lift = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.try_divide(F.col("issues").cast("double") / F.col("n"), F.col("base"))))
    weight = F.when((F.col("n") < SUPPORT) | (F.col("base") == 0), 1.0).otherwise(lift)
    return counted.crossJoin(F.broadcast(base)).select("feature", "n", "issues", weight.alias("weight"))  # base has one row


def risk(pages: DataFrame, weights: DataFrame, quality: Column, key: str = "rec_id") -> DataFrame:
    """(key, risk): the lack of quality times the weights of the page's features, repeated ones repeated; unknown features weigh 1."""
    f = features(F.col("source_type"), F.col("model_used"), F.col("flags"), M.bucket(F.col("confidence")))
    base = pages.select(key, (1.0 - F.coalesce(quality, F.lit(0.0))).alias("base"), f.alias("f"))
    each = base.select(key, F.posexplode("f").alias("i", "feature")).join(weights.select("feature", "weight"), "feature", "left")
    # the order of the factors is kept, so the product is the same to the last bit
    product = F.aggregate(F.array_sort(F.collect_list(F.struct("i", F.coalesce("weight", F.lit(1.0)).alias("w")))), F.lit(1.0), lambda p, x: p * x["w"])
    return base.select(key, "base").join(each.groupBy(key).agg(product.alias("p")), key, "left").select(key, (F.col("base") * F.coalesce("p", F.lit(1.0))).alias("risk"))


def without_human(events: DataFrame, books: DataFrame) -> DataFrame:
    """The log less what humans recorded about the books of a table (book). Events of no book stay."""
    gone = books.select("book").where("book IS NOT NULL").distinct().withColumn("_gone", F.lit(True))
    human = F.coalesce(F.col("detected_by").isin(HUMANS), F.lit(False))
    return events.join(gone, "book", "left").where(~(human & F.coalesce("_gone", F.lit(False)))).drop("_gone")
