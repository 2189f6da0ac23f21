"""Problem 2: freely typed values mapped to the codes of a reference list.

Distinct values are normalised (canonical characters, case, separators, order of
words) and looked up in an inverted index of character bigrams over the list's
codes and labels; candidates are scored by the cosine of vectors weighted by the
bigrams' rarity in the list. A value stands for the best code if its score is at
least `least`, if it is ahead of the next code by `margin`, and if an edit
distance, as a last check, is within `edits` of the length; between codes that
share words, a clearly smaller edit distance stands for the margin. Only distinct values
take part; the answers are joined back to the entries on salted keys, as one
value may hold a third of them.

Defined results: null and blank entries (nothing but space and characters
without width) are no cases; an exact code is none in `cases`; a value without
letters and digits is unmatched; ties for the best score between codes are
unmatched, as they have no margin.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, spread
from .visual import ZWNJ, canonical

#: Fixed: words that announce a value.
PREFIX = re.compile(r"^\s*(?:type|flag|issue|code|نوع|کد)\s*[:=]\s*", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def words(value: str) -> list[str]:
    t = PREFIX.sub("", CAMEL.sub(" ", canonical(value))).replace(ZWNJ, "").casefold()
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c) or c in "ٓٔ")
    return "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFC", t)).split()


def views(value: str) -> list[str]:
    """The value without separators, in its own order of words and in sorted order."""
    w = words(value)
    return sorted({"".join(w), "".join(sorted(w))} - {""})


def blank(value: str | None) -> bool:
    return not (value and canonical(value).strip())


def grams(view: str, size: int = 2) -> Counter:
    t = f"^{view}$"
    return Counter(t[i : i + size] for i in range(max(1, len(t) - size + 1)))


def with_grams(df: DataFrame, size: int = 2) -> DataFrame:
    """Each (field, value) with its views and their bigrams: (field, value, blank, view, gram, n); gram is null if there are none."""

    def run(batches):
        for batch in batches:
            rows = []
            for f, v in zip(batch.column("field").to_pylist(), batch.column("value").to_pylist()):
                found = [(f, v, False, x, g, n) for x in views(v) for g, n in grams(x, size).items()]
                rows += found or [(f, v, blank(v), None, None, None)]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32()])], ["field", "value", "blank", "view", "gram", "n"])

    return df.select("field", "value").mapInArrow(run, "field string, value string, blank boolean, view string, gram string, n int")


def entries(fields: DataFrame, reports: DataFrame) -> DataFrame:
    """(field, id, pos, value) of every entry that isn't null, each record once."""
    flags = fields.select("rec_id", "flags").dropDuplicates(["rec_id"]).select(F.lit("flags").alias("field"), F.col("rec_id").alias("id"), F.posexplode("flags").alias("pos", "value"))
    types = reports.select("report_id", F.col("issues.type").alias("types")).dropDuplicates(["report_id"]).select(F.lit("issue_type").alias("field"), F.col("report_id").alias("id"), F.posexplode("types").alias("pos", "value"))
    return flags.unionByName(types).where("value IS NOT NULL")


def mapping(values: DataFrame, vocab: DataFrame, least: float = 0.45, margin: float = 0.06, edits: float = 0.4, salts: int = 8, size: int = 2) -> DataFrame:
    """(field, value, code, score, ahead) of each distinct value that isn't blank; code is empty if it stands for none.

    The postings of a gram are spread over `salts` parts, as one gram may be in a third of all forms; products are added up before they are shuffled
    by pair. Pairs below least - margin go before anything else is taken of them: none of them is the best one or too near to it. `size` is the length
    of the grams: 2 for short lists, where it is the most tolerant; 3 for lists of many thousands, where pairs of letters tell too little apart."""
    forms = vocab.select("field", "code", F.explode(F.array("code", "label_en", "label_fa")).alias("value")).where("value IS NOT NULL")
    postings = with_grams(forms, size).where("gram IS NOT NULL").join(forms, ["field", "value"]).select("field", "code", F.col("view").alias("form"), "gram", "n").distinct()
    total = postings.select("field", "code", "form").distinct().groupBy("field").agg(F.count("*").alias("total"))
    weight = postings.groupBy("field", "gram").agg(F.countDistinct("code", "form").alias("df")).join(total, "field").select("field", "gram", F.log(1 + F.col("total") / F.col("df")).alias("w"))
    of_form = ["field", "code", "form"]
    index = postings.join(weight, ["field", "gram"]).withColumn("x", F.col("n") * F.col("w"))
    index = keep(index.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(*of_form)))).select(*of_form, "gram", "w", "x"), "p2-index")

    mine = keep(with_grams(values.select("field", "value").distinct(), size), "p2-values")
    known = mine.where("NOT blank").join(weight, ["field", "gram"], "left").join(total, "field", "left")
    of_value = ["field", "value", "view"]
    own = known.withColumn("x", F.col("n") * F.coalesce("w", F.log(1 + F.col("total")), F.lit(1.0)))
    own = own.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(*of_value)))).where("w IS NOT NULL").select(*of_value, "gram", "w", "x")

    asked = own.drop("w").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    offered = index.select(*of_form, "gram", F.col("x").alias("y"), F.pmod(F.xxhash64("form"), F.lit(salts)).cast("int").alias("salt"))
    scored = asked.join(offered, ["field", "gram", "salt"]).groupBy(*of_value, "code", "form").agg(F.sum(F.col("x") * F.col("y")).alias("score")).where(F.col("score") >= least - margin)
    scored = scored.withColumn("off", F.levenshtein("view", "form") / F.greatest(F.length("view"), F.length("form")))
    best = scored.groupBy("field", "value", "code").agg(F.struct(F.round(F.max("score"), 6).alias("score"), (-F.min("off")).alias("near")).alias("b"))
    all_codes = W.partitionBy("field", "value")
    order = all_codes.orderBy(F.desc("b.score"), F.desc("b.near"), "code")
    ranked = best.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("b.score").over(order))
    ranked = ranked.withColumn("nearest", F.min(F.when(F.col("rank") > 1, -F.col("b.near"))).over(all_codes)).where("rank = 1")
    ahead = F.col("b.score") - F.coalesce("next", F.lit(0.0))
    # codes that share a word have close scores; where the edit distance tells them apart clearly, it does
    clear = (-F.col("b.near") <= edits / 2) & (F.coalesce("nearest", F.lit(1.0)) + F.col("b.near") >= edits / 2) & (ahead > 0)
    ok = (F.col("b.score") >= least) & ((ahead >= margin) | clear) & (-F.col("b.near") <= edits)
    found = ranked.select("field", "value", F.when(ok, F.col("code")).otherwise("").alias("code"), F.col("b.score").alias("score"), ahead.alias("ahead"))
    every = mine.where("NOT blank").select("field", "value").distinct()
    return every.join(found, ["field", "value"], "left").select("field", "value", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("ahead", F.lit(0.0)).alias("ahead"))


def cases(fields: DataFrame, reports: DataFrame, vocab: DataFrame, salts: int = 16) -> DataFrame:
    """(field, id, pos, code) of every entry that isn't exactly a code of its field, null or blank."""
    codes = vocab.select("field", F.col("code").alias("value"))
    typed = spread(entries(fields, reports)).join(codes, ["field", "value"], "left_anti")
    found = mapping(typed, vocab).select("field", "value", "code", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return typed.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(salts)).cast("int")).join(found, ["field", "value", "salt"]).select("field", "id", "pos", "code")
