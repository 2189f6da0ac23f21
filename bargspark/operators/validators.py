"""Page validators: script, repetition, agreement with a second text of the page, headings, and the score they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bargspark.functions import measures as M
from bargspark.functions import text as X

# Thresholds of the validators.
LATIN_MOST, ARABIC_MOST, REPEAT_LONG, REPEAT_MOST = 0.15, 0.05, 200, 0.25
WORDS_LEAST, SIMILAR, SIMILAR_REVIEW, LENGTHS, HEADING_SIMILAR = 25, 0.97, 0.90, (0.60, 1.60), 0.85
SURE, SURE_REVIEW = 0.85, 0.70
ESCALATING, REVIEWING = ["illegible", "two_column", "table"], ["repetition", "arabic_codepoints", "missing_heading", "embedded_heading_missing"]


def script(df: DataFrame, text: str = "text_md") -> DataFrame:
    """Adds latin, persian, arabic_codepoints and latin_ratio (4 places)."""
    t = F.col(text)
    df = df.withColumns({"latin": X.count_of(t, "A-Za-z"), "persian": X.count_of(t, "؀-ۿ"), "arabic_codepoints": X.count_of(t, "يك")})
    return df.withColumn("latin_ratio", F.round(F.coalesce(F.try_divide(F.col("latin").cast("double"), F.col("latin") + F.col("persian")), F.lit(0.0)), 4))


def top_word(text: Column) -> Column:
    """struct<n, first, w> of the most frequent word, the first seen on ties; words sorted with their places put equal ones side by side."""
    placed = lambda ws: F.array_sort(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def best(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == n) | ((i < n) & (F.get(s, i)["w"] != F.get(s, i - 1)["w"])))
        run = lambda e: F.transform(e, lambda x, k: X.let(F.coalesce(F.get(e, k - 1), F.lit(0)), lambda a: F.struct((x - a).alias("n"), (-F.get(s, a)["i"]).alias("first"), F.get(s, a)["w"].alias("w"))))
        return X.let(ends, lambda e: F.array_max(run(e)))

    return X.let(placed(X.words(text)), best)


def repetition(text: Column) -> Column:
    """Whether one word of three letters or more makes up over a quarter of a text of over 200 characters."""
    top = top_word(text)
    return (F.length(text) > REPEAT_LONG) & X.let(top, lambda t: (F.length(t["w"]) > 2) & (t["n"].cast("double") / F.size(X.words(text)) > REPEAT_MOST))


def unmatched(names: Column, text_lines: Column, skip_empty: bool) -> Column:
    """The names without a heading line whose bag is similar enough. An empty bag matches nothing, or is left out."""
    bags = F.transform(text_lines, X.bag)

    def lone(b: Column) -> Column:
        return F.filter(names, lambda h: X.let(X.bag(h), lambda x: ((F.size(x) > 0) | F.lit(not skip_empty)) & ~F.exists(b, lambda y: M.cosine(x, y) >= HEADING_SIMILAR)))

    return X.let(bags, lone)


def evaluate(df: DataFrame) -> DataFrame:
    """Of (text_md, confidence, flags, embedded_text, headings, heading_candidates, …): adds similarity, length_ratio, issues (in fixed order) and quality_score.

    Null confidence counts as 0, null arrays as empty, null texts as empty; a second text of fewer than 25 bag words isn't compared."""
    clean = df.withColumns({
        "text_md": F.coalesce("text_md", F.lit("")),
        "flags": F.coalesce("flags", F.array().cast("array<string>")),
        "headings": F.filter(F.coalesce("headings", F.array().cast("array<string>")), lambda h: h.isNotNull()),
        "heading_candidates": F.coalesce("heading_candidates", F.array().cast("array<string>")),
        "confidence": F.nanvl(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)),
    })
    s = script(clean).withColumn("_lines", X.heading_lines(F.col("text_md")))
    # bags only where there is a second text; they are made once and used for similarity and length
    s = s.withColumn("_emb", F.when(F.length("embedded_text") > 0, X.bag(F.col("embedded_text"))))
    s = s.withColumn("_emb", F.when(M.bag_size(F.col("_emb")) >= WORDS_LEAST, F.col("_emb"))).withColumn("_bag", F.when(F.col("_emb").isNotNull(), X.bag(F.col("text_md"))))
    s = s.withColumn("similarity", F.when(F.col("_emb").isNotNull(), F.round(M.cosine(F.col("_bag"), F.col("_emb")), 4)))
    s = s.withColumn("length_ratio", F.when(F.col("_emb").isNotNull(), F.round(M.bag_size(F.col("_bag")).cast("double") / M.bag_size(F.col("_emb")), 3)))
    found = [
        ("high_latin_ratio", (F.coalesce(F.try_divide(F.col("latin").cast("double"), F.col("latin") + F.col("persian")), F.lit(0.0)) > LATIN_MOST) & ~F.array_contains("flags", "non_persian")),
        ("arabic_codepoints", (F.col("persian") > 0) & (F.coalesce(F.try_divide(F.col("arabic_codepoints").cast("double"), F.col("persian")), F.lit(0.0)) > ARABIC_MOST)),
        ("repetition", repetition(F.col("text_md"))),
        ("embedded_mismatch", F.col("similarity") < SIMILAR),
        ("length_anomaly", ~F.col("length_ratio").between(*LENGTHS)),
        ("missing_heading", F.size(unmatched(F.col("headings"), F.col("_lines"), False)) > 0),
        ("embedded_heading_missing", F.size(unmatched(F.col("heading_candidates"), F.col("_lines"), True)) > 0),
    ]
    s = s.withColumn("issues", F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in found)), lambda x: x.isNotNull()))
    score = F.when(F.col("similarity").isNotNull(), F.lit(0.5) * F.col("confidence") + F.lit(0.5) * F.col("similarity")).otherwise(F.col("confidence"))
    score = score - F.lit(0.1) * F.size(F.filter("issues", lambda x: x != "embedded_mismatch"))
    return s.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)).drop("_lines", "_emb", "_bag")


def needs_escalation(blank: Column) -> Column:
    return ~F.coalesce(blank, F.lit(False)) & ((F.col("confidence") < SURE) | F.arrays_overlap("flags", F.lit(ESCALATING)) | (F.size("issues") > 0))


def needs_review(blank: Column) -> Column:
    doubt = (F.col("confidence") < SURE_REVIEW) | F.array_contains("flags", "illegible") | F.coalesce(F.col("similarity") < SIMILAR_REVIEW, F.lit(False)) | F.arrays_overlap("issues", F.lit(REVIEWING))
    return ~F.coalesce(blank, F.lit(False)) & doubt


def promote_headings(df: DataFrame, key: str = "rec_id") -> DataFrame:
    """Of (key, text_md, headings): (key, line, text) of the lines that become headings, at level 3 where the line is bold, else at level 2.

    The n-th time a heading is declared it takes the n-th line of its text; headings that are heading lines already take none."""
    from pyspark.sql import Window as W

    names = df.select(key, F.posexplode("headings").alias("h_pos", "h")).withColumn("h", X.strip(F.col("h"))).where("h <> ''")
    present = df.select(key, F.explode(X.heading_lines(F.col("text_md"))).alias("h")).distinct()
    names = names.join(present, [key, "h"], "left_anti").withColumn("n", F.row_number().over(W.partitionBy(key, "h").orderBy("h_pos")))
    line = df.select(key, F.posexplode(X.lines(F.col("text_md"))).alias("line", "raw")).withColumn("s", X.strip(F.col("raw")))
    bold = X.strip(F.regexp_extract("s", r"(?s)^\*\*(.+)\*\*$", 1))
    line = line.withColumn("bold", bold).withColumn("h", F.when(F.col("bold") != "", F.col("bold")).otherwise(F.col("s"))).where("h <> ''")
    line = line.join(names.select(key, "h").distinct(), [key, "h"], "leftsemi").withColumn("n", F.row_number().over(W.partitionBy(key, "h").orderBy("line")))
    return names.join(line, [key, "h", "n"]).select(key, "line", F.concat(F.when(F.col("bold") != "", "### ").otherwise("## "), "h").alias("text"))
