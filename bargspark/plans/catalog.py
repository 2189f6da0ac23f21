"""Every operator as a named query over the tables, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bargspark.functions import measures as M
from bargspark.functions import text as X
from bargspark.operators import diffing, headings, history, layout, markdown, matching, pages, review, scans, validators
from bargspark.session import keep, ship, spread, table_path

from . import sql as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str, *cols: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{d}/{table}.parquet")
    return df.select(*cols) if cols else df


def once(spark, d, table: str, key: str, *cols: str) -> DataFrame:
    """The columns of a table, each record once."""
    return pages.once_of(read(spark, d, table), key, *cols)


def texts(spark, d, *more) -> DataFrame:
    return once(spark, d, "page_text", "rec_id", "rec_id", "book", "page", "attempt", "text_md", *more)


def spread_texts(spark, d) -> DataFrame:
    """The texts for work on each row alone."""
    return spread(texts(spark, d), read(spark, d, "page_text", "rec_id"))


FIELDS = ("rec_id", "is_blank", "headings", "flags", "starts_mid_paragraph", "continues_next", "confidence", "model_used", "resolution")


def fields(spark, d) -> DataFrame:
    return once(spark, d, "page_fields", "rec_id", *FIELDS)


def reports(spark, d) -> DataFrame:
    return once(spark, d, "qc_reports", "report_id", "report_id", "rec_id", "verdict", "issues", "suggested_text_md")


def events(spark, d) -> DataFrame:
    return read(spark, d, "qc_events")


def last_texts(spark, d) -> DataFrame:
    """The last attempt at each page that isn't blank, chosen by keys; the texts of those chosen are shuffled once."""
    keys = read(spark, d, "page_text", "rec_id", "book", "page", "attempt", "text_md").where("text_md IS NOT NULL").drop("text_md")
    said = fields(spark, d).where("NOT coalesce(is_blank, false)").select("rec_id", "starts_mid_paragraph", "continues_next")
    flags = F.struct("starts_mid_paragraph", "continues_next")
    last = keys.join(said, "rec_id").groupBy("book", "page").agg(F.max_by(F.struct("rec_id", flags.alias("f")), F.struct("attempt", "rec_id")).alias("b"))
    chosen = last.select("book", "page", "b.rec_id", "b.f.*")
    found = texts(spark, d).select("rec_id", "text_md").join(chosen, "rec_id").select("rec_id", "book", "page", "text_md", "starts_mid_paragraph", "continues_next")
    return spread(found, read(spark, d, "page_text", "rec_id"))


# ---------------------------------------------------------------- texts


@query(f"WITH {S.T} SELECT rec_id, {S.normalize('text_md')} AS text FROM t")
def normalize_text(spark, d):
    return spread_texts(spark, d).select("rec_id", X.normalize(F.col("text_md")).alias("text"))


@query(f"WITH {S.T}, {S.bag_table('b', 't', 'rec_id', 'text_md')} SELECT rec_id, w AS word, n FROM b")
def word_bag(spark, d):
    return spread_texts(spark, d).select("rec_id", F.explode(X.bag(F.col("text_md"))).alias("b")).select("rec_id", F.col("b.w").alias("word"), F.col("b.n").cast("long").alias("n"))



@query(f"""WITH {S.T}, {S.bag_table('b', 't', 'rec_id', 'text_md')}, nrm AS (SELECT rec_id, sum(n * n)::DOUBLE AS nn FROM b GROUP BY rec_id),
    p AS (SELECT x.rec_id AS a_id, y.rec_id AS b_id FROM t x JOIN t y ON x.book = y.book AND x.page = y.page AND x.rec_id < y.rec_id WHERE x.text_md IS NOT NULL AND y.text_md IS NOT NULL),
    d AS (SELECT a_id, b_id, sum(a.n * b.n)::DOUBLE AS dot FROM p JOIN b a ON a.rec_id = a_id JOIN b ON b.rec_id = b_id AND b.w = a.w GROUP BY 1, 2)
    SELECT a_id, b_id, round(coalesce(dot / (sqrt(x.nn) * sqrt(y.nn)), 0.0)::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS similarity FROM p LEFT JOIN d USING (a_id, b_id) LEFT JOIN nrm x ON x.rec_id = a_id LEFT JOIN nrm y ON y.rec_id = b_id""")
def bag_cosine(spark, d):
    t = spread_texts(spark, d).where("text_md IS NOT NULL").select("rec_id", "book", "page", X.bag(F.col("text_md")).alias("bag"))
    a, b = t.select(F.col("rec_id").alias("a_id"), "book", "page", F.col("bag").alias("x")), t.select(F.col("rec_id").alias("b_id"), "book", "page", F.col("bag").alias("y"))
    return a.join(b, ["book", "page"]).where("a_id < b_id").select("a_id", "b_id", F.round(M.cosine(F.col("x"), F.col("y")), 4).alias("similarity"))


@query(f"""WITH {S.T} SELECT rec_id, {S.count_of('text_md', 'A-Za-z')} AS latin, {S.count_of('text_md', '؀-ۿ')} AS persian, {S.count_of('text_md', 'يك')} AS arabic_codepoints,
    round(coalesce({S.count_of('text_md', 'A-Za-z')}::DOUBLE / nullif({S.count_of('text_md', 'A-Za-z')} + {S.count_of('text_md', '؀-ۿ')}, 0), 0.0)::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS latin_ratio FROM t""")
def script_stats(spark, d):
    return validators.script(spread_texts(spark, d)).select("rec_id", "latin", "persian", "arabic_codepoints", "latin_ratio")


@query(f"""WITH {S.T}, w AS (SELECT rec_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT rec_id, {S.words('text_md')} AS ws FROM t)),
    c AS (SELECT rec_id, w, count(*) AS n, min(i) AS i FROM w GROUP BY 1, 2), m AS (SELECT rec_id, sum(n) AS total FROM c GROUP BY 1)
    SELECT rec_id, w AS word, n, length(text_md) > 200 AND length(w) > 2 AND n::DOUBLE / total > 0.25 AS repeated FROM c JOIN m USING (rec_id) JOIN t USING (rec_id) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, i) = 1""")
def repetition(spark, d):
    t = spread_texts(spark, d).where(F.size(X.words(F.col("text_md"))) > 0).withColumn("top", validators.top_word(F.col("text_md")))
    return t.select("rec_id", F.col("top.w").alias("word"), F.col("top.n").cast("long").alias("n"), validators.repetition(F.col("text_md")).alias("repeated"))


@query(f"WITH {S.T} SELECT rec_id, unnest(range(len(h)))::INT AS pos, unnest(h) AS heading FROM (SELECT rec_id, {S.heading_lines('text_md')} AS h FROM t)")
def heading_lines(spark, d):
    return spread_texts(spark, d).select("rec_id", F.posexplode(X.heading_lines(F.col("text_md"))).alias("pos", "heading"))


@query(f"WITH {S.T} SELECT rec_id, {S.countable('text_md')} AS n FROM t")
def countable(spark, d):
    return spread_texts(spark, d).select("rec_id", X.countable(F.col("text_md")).alias("n"))


@query(f"""WITH x AS (SELECT book, lower(title_en) AS a, title_fa FROM books)
    SELECT book, coalesce(nullif({S.rx(S.rx(S.rx('a', '[^a-z0-9-]+', '-'), '-{2,}', '-'), '^-+|-+$')}, ''), 'book') AS slug, coalesce(nullif({S.strip(S.rx(S.rx('title_fa', r'[\\/:*?"<>|]+', '-'), S.W + '+', ' '))}, ''), 'book') AS file FROM x""")
def safe_names(spark, d):
    return read(spark, d, "books", "book", "title_en", "title_fa").select("book", X.slug(F.col("title_en")).alias("slug"), X.safe_name(F.col("title_fa")).alias("file"))


@query(f"""WITH {S.Q}, s AS (SELECT report_id, unnest(range(len(issues)))::INT AS pos, unnest(issues).snippet AS s FROM q)
    SELECT report_id, pos, CASE WHEN len({S.words('s')}) <= 5 THEN s ELSE regexp_extract(s, '^({S.W}*[^{X.SPACES}]+(?:{S.W}+[^{X.SPACES}]+){{0,4}})', 1) END AS head FROM s""")
def cap_words(spark, d):
    s = reports(spark, d).select("report_id", F.posexplode("issues").alias("pos", "i")).select("report_id", "pos", F.col("i.snippet").alias("s"))
    return s.select("report_id", "pos", X.cap_words(F.col("s")).alias("head"))


# ---------------------------------------------------------------- validators


def _unmatched_sql(names: str, source: str, out: str, skip: bool) -> str:
    """CTE of the names without a similar heading line: (rec_id, i, h)."""
    p = out
    return f"""{p}n AS (SELECT rec_id, unnest(range(len({names}))) AS i, unnest({names}) AS h FROM {source}),
    {p}l AS (SELECT rec_id, unnest(range(len(hl))) AS j, unnest(hl) AS h FROM (SELECT rec_id, {S.heading_lines('text_md')} AS hl FROM {source})),
    {S.bag_table(p + 'nb', p + 'n', 'rec_id, i', 'h')}, {S.bag_table(p + 'lb', p + 'l', 'rec_id, j', 'h')},
    {p}nn AS (SELECT rec_id, i, sum(n * n)::DOUBLE AS s FROM {p}nb GROUP BY 1, 2), {p}ll AS (SELECT rec_id, j, sum(n * n)::DOUBLE AS s FROM {p}lb GROUP BY 1, 2),
    {p}ok AS (SELECT DISTINCT rec_id, i FROM (SELECT a.rec_id, a.i, b.j, sum(a.n * b.n)::DOUBLE AS dot FROM {p}nb a JOIN {p}lb b ON a.rec_id = b.rec_id AND a.w = b.w GROUP BY 1, 2, 3) JOIN {p}nn x USING (rec_id, i) JOIN {p}ll y USING (rec_id, j) WHERE dot / (sqrt(x.s) * sqrt(y.s)) >= 0.85),
    {out} AS (SELECT rec_id, i, h FROM {p}n WHERE h IS NOT NULL AND (rec_id, i) NOT IN (SELECT (rec_id, i) FROM {p}ok){f' AND (rec_id, i) IN (SELECT (rec_id, i) FROM {p}nn)' if skip else ''})"""


@query(f"WITH {S.T}, {S.F}, p AS (SELECT rec_id, coalesce(text_md, '') AS text_md, headings FROM t JOIN f USING (rec_id)), {_unmatched_sql('headings', 'p', 'un', False)} SELECT rec_id, h AS heading, count(*) AS n FROM un GROUP BY 1, 2")
def missing_headings(spark, d):
    p = texts(spark, d).join(fields(spark, d), "rec_id").select("rec_id", F.coalesce("text_md", F.lit("")).alias("text_md"), F.filter("headings", lambda h: h.isNotNull()).alias("headings"))
    return p.withColumn("lines", X.heading_lines(F.col("text_md"))).select("rec_id", F.explode(validators.unmatched(F.col("headings"), F.col("lines"), False)).alias("heading")).groupBy("rec_id", "heading").agg(F.count("*").alias("n"))


def evaluated(spark, d) -> DataFrame:
    """Each attempt against the one before it as the second text of its page."""
    return validators.evaluate(_with_before(spark, d))


def _with_before(spark, d) -> DataFrame:
    p = texts(spark, d).join(fields(spark, d), "rec_id")
    before = p.select("book", "page", (F.col("attempt") + 1).alias("attempt"), F.col("text_md").alias("embedded_text"), F.filter("headings", lambda h: h.isNotNull()).alias("heading_candidates"))
    return p.join(before, ["book", "page", "attempt"], "left")


_EVAL = f"""WITH {S.T}, {S.F},
    p0 AS (SELECT rec_id, book, page, attempt, text_md AS raw, coalesce(text_md, '') AS text_md, coalesce(flags, []) AS flags, coalesce(confidence, 0.0) AS confidence, list_filter(coalesce(headings, []), lambda h: h IS NOT NULL) AS headings, is_blank, model_used FROM t JOIN f USING (rec_id)),
    p AS (SELECT x.* EXCLUDE (raw), y.raw AS emb, y.headings AS cand FROM p0 x LEFT JOIN p0 y ON y.book = x.book AND y.page = x.page AND y.attempt = x.attempt - 1),
    e AS (SELECT rec_id, emb FROM p WHERE length(emb) > 0),
    {S.bag_table('eb', 'e', 'rec_id', 'emb')}, {S.bag_table('tb', 'p', 'rec_id', 'text_md')},
    en AS (SELECT rec_id, sum(n) AS words, sum(n * n)::DOUBLE AS s FROM eb GROUP BY 1 HAVING sum(n) >= 25), tn AS (SELECT rec_id, sum(n) AS words, sum(n * n)::DOUBLE AS s FROM tb GROUP BY 1),
    dt AS (SELECT rec_id, sum(a.n * b.n)::DOUBLE AS dot FROM eb a JOIN tb b USING (rec_id, w) GROUP BY 1),
    sm AS (SELECT rec_id, round(coalesce(dot / (sqrt(tn.s) * sqrt(en.s)), 0.0)::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS similarity, round((coalesce(tn.words, 0)::DOUBLE / en.words)::VARCHAR::DECIMAL(38, 20), 3)::DOUBLE AS length_ratio FROM en LEFT JOIN tn USING (rec_id) LEFT JOIN dt USING (rec_id)),
    w AS (SELECT rec_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT rec_id, {S.words('text_md')} AS ws FROM p WHERE length(text_md) > 200)),
    c AS (SELECT rec_id, w, count(*) AS n, min(i) AS i FROM w GROUP BY 1, 2),
    rep AS (SELECT rec_id FROM (SELECT rec_id, w, n, sum(n) OVER (PARTITION BY rec_id) AS total, row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, i) AS r FROM c) WHERE r = 1 AND length(w) > 2 AND n::DOUBLE / total > 0.25),
    {_unmatched_sql('headings', 'p', 'mh', False)}, {_unmatched_sql('cand', 'p', 'eh', True)},
    s AS (SELECT p.*, similarity, length_ratio, {S.count_of('text_md', 'A-Za-z')} AS latin, {S.count_of('text_md', '؀-ۿ')} AS persian, {S.count_of('text_md', 'يك')} AS arabic_codepoints FROM p LEFT JOIN sm USING (rec_id)),
    i AS (SELECT *, coalesce(latin::DOUBLE / nullif(latin + persian, 0), 0.0) AS lr,
      list_filter([CASE WHEN coalesce(latin::DOUBLE / nullif(latin + persian, 0), 0.0) > 0.15 AND NOT list_contains(flags, 'non_persian') THEN 'high_latin_ratio' END,
        CASE WHEN persian > 0 AND arabic_codepoints::DOUBLE / nullif(persian, 0) > 0.05 THEN 'arabic_codepoints' END,
        CASE WHEN rec_id IN (SELECT rec_id FROM rep) THEN 'repetition' END, CASE WHEN similarity < 0.97 THEN 'embedded_mismatch' END,
        CASE WHEN length_ratio NOT BETWEEN 0.60 AND 1.60 THEN 'length_anomaly' END,
        CASE WHEN rec_id IN (SELECT rec_id FROM mh) THEN 'missing_heading' END, CASE WHEN rec_id IN (SELECT rec_id FROM eh) THEN 'embedded_heading_missing' END], lambda x: x IS NOT NULL) AS issues FROM s),
    ev AS (SELECT *, round(greatest(0.0, least(1.0, CASE WHEN similarity IS NOT NULL THEN 0.5::DOUBLE * confidence + 0.5::DOUBLE * similarity ELSE confidence END - 0.1::DOUBLE * len(list_filter(issues, lambda x: x <> 'embedded_mismatch'))))::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS quality_score FROM i)"""


@query(_EVAL + " SELECT rec_id, similarity, length_ratio, round(lr::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS latin_ratio, arabic_codepoints, array_to_string(issues, '|') AS issues, quality_score FROM ev")
def evaluate(spark, d):
    return evaluated(spark, d).select("rec_id", "similarity", "length_ratio", "latin_ratio", "arabic_codepoints", F.array_join("issues", "|").alias("issues"), "quality_score")


_NEEDS = """SELECT rec_id, NOT coalesce(is_blank, false) AND (confidence < 0.85 OR list_has_any(flags, ['illegible', 'two_column', 'table']) OR len(issues) > 0) AS escalate,
    NOT coalesce(is_blank, false) AND (confidence < 0.70 OR list_contains(flags, 'illegible') OR coalesce(similarity < 0.90, false) OR list_has_any(issues, ['repetition', 'arabic_codepoints', 'missing_heading', 'embedded_heading_missing'])) AS review FROM ev"""


@query(f"{_EVAL} {_NEEDS}")
def needs(spark, d):
    flags = F.filter("flags", lambda x: x.isNotNull())  # a null flag would make the overlap unknown
    return evaluated(spark, d).withColumn("flags", flags).select("rec_id", validators.needs_escalation(F.col("is_blank")).alias("escalate"), validators.needs_review(F.col("is_blank")).alias("review"))


#: Texts whose headings have lost their marks: plain lines, bold ones in every other record.
_PLAIN = "regexp_replace(text_md, '(?m)^#{1,3} (.+)$', CASE WHEN rec_id % 2 = 0 THEN '\\1' ELSE '**\\1**' END, 'g')"


@query(f"""WITH {S.T}, {S.F}, p AS (SELECT rec_id, {_PLAIN} AS text_md, headings FROM t JOIN f USING (rec_id) WHERE text_md IS NOT NULL),
    n0 AS (SELECT rec_id, i, {S.strip('h')} AS h FROM (SELECT rec_id, unnest(range(len(headings))) AS i, unnest(headings) AS h FROM p)),
    pres AS (SELECT DISTINCT rec_id, unnest({S.heading_lines('text_md')}) AS h FROM p),
    n AS (SELECT rec_id, h, row_number() OVER (PARTITION BY rec_id, h ORDER BY i) AS k FROM n0 WHERE h <> '' AND (rec_id, h) NOT IN (SELECT (rec_id, h) FROM pres)),
    l0 AS (SELECT rec_id, line, {S.strip('raw')} AS s FROM (SELECT rec_id, unnest(range(len(x)))::INT AS line, unnest(x) AS raw FROM (SELECT rec_id, string_split(text_md, chr(10)) AS x FROM p))),
    l1 AS (SELECT *, {S.strip(r"regexp_extract(s, '(?s)^\*\*(.+)\*\*$', 1)")} AS b FROM l0),
    l AS (SELECT rec_id, line, b, CASE WHEN b <> '' THEN b ELSE s END AS h, row_number() OVER (PARTITION BY rec_id, CASE WHEN b <> '' THEN b ELSE s END ORDER BY line) AS k FROM l1)
    SELECT rec_id, line, CASE WHEN b <> '' THEN '### ' ELSE '## ' END || h AS text FROM n JOIN l USING (rec_id, h, k)""")
def promote_headings(spark, d):
    """Which lines become headings again in texts whose headings have lost their marks."""
    bare = F.when(F.col("rec_id") % 2 == 0, F.regexp_replace("text_md", "(?m)^#{1,3} (.+)$", "$1")).otherwise(F.regexp_replace("text_md", "(?m)^#{1,3} (.+)$", "**$1**"))
    p = texts(spark, d).where("text_md IS NOT NULL").join(fields(spark, d), "rec_id").select("rec_id", bare.alias("text_md"), "headings")
    return validators.promote_headings(p)


# ---------------------------------------------------------------- pages


@query(f"WITH {S.T} SELECT book, pages, share, CASE WHEN share >= 0.8 THEN 'digital' WHEN share <= 0.2 THEN 'scanned' ELSE 'mixed' END AS kind FROM (SELECT book, count(*) AS pages, round(avg((length(coalesce(text_md, '')) > 200)::INT::DOUBLE), 6) AS share FROM t GROUP BY 1)")
def classify_sources(spark, d):
    return pages.classify_sources(texts(spark, d)).withColumn("share", F.round("share", 6))


@query(f"""WITH {S.T}, l AS (SELECT book, length({S.rx('text_md', '[^؀-ۿ]')}) >= 0.3 * length({S.rx('text_md', S.W)}) AS ok FROM (SELECT * FROM t WHERE length(text_md) > 200 QUALIFY row_number() OVER (PARTITION BY book ORDER BY page, rec_id) <= 5))
    SELECT book, coalesce(bool_or(ok), false) AS usable FROM (SELECT DISTINCT book FROM t) LEFT JOIN l USING (book) GROUP BY 1""")
def usable_layers(spark, d):
    return pages.usable_layer(texts(spark, d))


@query("SELECT DISTINCT book, page FROM page_text WHERE (book, page) IN (SELECT (book, page) FROM page_fields)")
def pages_done(spark, d):
    return pages.done(read(spark, d, "page_text", "book", "page"), read(spark, d, "page_fields", "book", "page"))


@query("SELECT book, page FROM (SELECT book, unnest(range(1, page_count + 1))::INT AS page FROM books) EXCEPT SELECT book, page FROM page_text")
def pages_missing(spark, d):
    wanted = read(spark, d, "books", "book", "page_count").where("page_count > 0").select("book", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    return pages.missing(wanted, read(spark, d, "page_text", "book", "page").distinct())


@query("SELECT DISTINCT p.book, page FROM page_text p JOIN (SELECT book, max(page) AS last FROM page_text GROUP BY 1) m ON m.book = p.book WHERE page BETWEEN 1 AND last AND (page = 1 OR page BETWEEN 3 AND 5 OR page BETWEEN 20 AND last)")
def page_spec(spark, d):
    p = read(spark, d, "page_text", "book", "page").distinct()
    last = p.groupBy("book").agg(F.max("page").alias("last"))
    return p.join(last, "book").where(pages.in_spec("1,3-5,20-", F.col("page"), F.col("last"))).select("book", "page")


@query(f"{_EVAL} SELECT book, page, rec_id, quality_score FROM ev QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY quality_score DESC, attempt DESC, rec_id DESC) = 1")
def keep_better(spark, d):
    return pages.keep_better(evaluated(spark, d).select("book", "page", "rec_id", "attempt", "quality_score"), F.col("quality_score"), "attempt", "rec_id").select("book", "page", "rec_id", "quality_score")


_BEST = "best AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY quality_score DESC, attempt DESC, rec_id DESC) = 1)"


def _best(spark, d):
    """The better attempt at each page, without texts; kept, as selections use it several times."""
    return keep(_better(spark, d), "best")


def _better(spark, d):
    return pages.keep_better(evaluated(spark, d).select("book", "page", "rec_id", "attempt", "quality_score", "issues", "is_blank", "model_used", "flags", "confidence"), F.col("quality_score"), "attempt", "rec_id")


@query(f"{_EVAL}, {_BEST}, bud AS (SELECT book, ceil(count(*) / 5.0)::BIGINT AS budget FROM best GROUP BY 1) SELECT book, page, rank, rank <= budget AS surfaced FROM (SELECT book, page, row_number() OVER (PARTITION BY book ORDER BY quality_score, page) AS rank FROM best WHERE len(issues) > 0) JOIN bud USING (book)")
def review_selection(spark, d):
    return pages.review_budget(_best(spark, d), F.size("issues") > 0, F.col("quality_score")).select("book", "page", F.col("rank").cast("long").alias("rank"), "surfaced")


# ---------------------------------------------------------------- history


@query(f"WITH {S.F} SELECT rec_id, {S.bucket('confidence')} AS bucket FROM f")
def confidence_bucket(spark, d):
    return fields(spark, d).select("rec_id", M.bucket(F.col("confidence")).alias("bucket"))


_FEAT = """ft AS (SELECT event_id, issue_type IS DISTINCT FROM 'pass' AS is_issue, unnest(list_distinct(list_filter(list_concat(
    [CASE WHEN source_type <> '' THEN 'source:' || source_type END], [CASE WHEN model_used <> '' THEN 'model:' || model_used END],
    list_transform(coalesce(features.flags, []), lambda x: CASE WHEN x <> '' THEN 'flag:' || x END), [CASE WHEN features.confidence_bucket <> '' THEN 'conf:' || features.confidence_bucket END],
    list_transform(coalesce(features.char_signals, []), lambda x: CASE WHEN x <> '' THEN 'signal:' || x END)), lambda x: x IS NOT NULL))) AS feature FROM e)"""
_WEIGHT = "wt AS (SELECT feature, count(*) AS n, sum(is_issue::INT)::BIGINT AS issues, CASE WHEN count(*) < 3 OR any_value(base) = 0 THEN 1.0 ELSE greatest(0.5, least(3.0, (sum(is_issue::INT)::DOUBLE / count(*)) / any_value(base))) END AS weight FROM ft CROSS JOIN (SELECT avg((issue_type IS DISTINCT FROM 'pass')::INT::DOUBLE) AS base FROM e) GROUP BY 1)"


@query(f"WITH {S.E}, {_FEAT} SELECT event_id, is_issue, feature FROM ft")
def event_features(spark, d):
    return history.event_features(events(spark, d))


@query(f"WITH {S.E}, {_FEAT}, {_WEIGHT} SELECT feature, n, issues, round(weight::VARCHAR::DECIMAL(38, 20), 6)::DOUBLE AS weight FROM wt")
def feature_weights(spark, d):
    return history.feature_weights(events(spark, d)).withColumn("weight", F.round("weight", 6))


_RISK = f"""rk AS (SELECT rec_id, book, page, issues, is_blank, quality_score, (1.0::DOUBLE - quality_score) * coalesce((SELECT list_reduce(list_prepend(1.0::DOUBLE, list(coalesce(weight, 1.0) ORDER BY i)), lambda a, b: a * b) FROM (SELECT unnest(range(len(fs))) AS i, unnest(fs) AS feature) LEFT JOIN wt USING (feature)), 1.0) AS risk
    FROM (SELECT best.*, list_filter(list_concat([CASE WHEN source_type <> '' THEN 'source:' || source_type END], [CASE WHEN model_used <> '' THEN 'model:' || model_used END], list_transform(flags, lambda x: CASE WHEN x <> '' THEN 'flag:' || x END), [CASE WHEN conf0 IS NOT NULL THEN 'conf:' || {S.bucket('conf0')} END]), lambda x: x IS NOT NULL) AS fs FROM best JOIN (SELECT book, source_type FROM books) USING (book) JOIN (SELECT rec_id, confidence AS conf0 FROM f) USING (rec_id)))"""


def _risk(spark, d):
    best = _best(spark, d).drop("confidence").join(fields(spark, d).select("rec_id", "confidence"), "rec_id").join(read(spark, d, "books", "book", "source_type"), "book")
    return best.join(history.risk(best, history.feature_weights(events(spark, d)), F.col("quality_score")), "rec_id")


@query(f"{_EVAL}, {_BEST}, e2 AS (SELECT DISTINCT ON (event_id) * FROM qc_events), {_FEAT.replace(' FROM e)', ' FROM e2)')}, {_WEIGHT.replace(' FROM e)', ' FROM e2)')}, {_RISK} SELECT rec_id, round(risk::VARCHAR::DECIMAL(38, 20), 6)::DOUBLE AS risk FROM rk")
def risk_score(spark, d):
    return _risk(spark, d).select("rec_id", F.round("risk", 6).alias("risk"))


@query(f"""{_EVAL}, {_BEST}, e2 AS (SELECT DISTINCT ON (event_id) * FROM qc_events), {_FEAT.replace(' FROM e)', ' FROM e2)')}, {_WEIGHT.replace(' FROM e)', ' FROM e2)')}, {_RISK},
    k AS (SELECT *, CASE WHEN len(issues) > 0 THEN 'forced' WHEN risk >= 0.15 THEN 'risky' ELSE 'clean' END AS kind FROM rk WHERE NOT coalesce(is_blank, false)),
    r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY md5('barg|' || book || '|' || page)) AS r, count(*) OVER (PARTITION BY book) AS n FROM k WHERE kind = 'clean')
    SELECT book, page, kind AS why FROM k WHERE kind <> 'clean' UNION ALL SELECT book, page, 'sample' FROM r WHERE r <= least(n, greatest(1, round_even(n * 0.05::DOUBLE, 0)::BIGINT))""")
def verify_selection(spark, d):
    p = _risk(spark, d).where("NOT coalesce(is_blank, false)")
    return pages.verify_selection(p, F.size("issues") > 0, F.col("risk")).select("book", "page", "why")


@query(f"WITH {S.E} SELECT event_id FROM e WHERE NOT (book IN (SELECT book FROM books WHERE source_type = 'scanned') AND coalesce(detected_by IN ('human_edit', 'suggestion_accepted', 'suggestion_edited', 'suggestion_rejected'), false))")
def without_human_events(spark, d):
    gone = read(spark, d, "books", "book", "source_type").where("source_type = 'scanned'").select("book")
    return history.without_human(pages.once(events(spark, d).select("event_id", "book", "detected_by"), "event_id"), gone).select("event_id")


@query(f"WITH {S.Q}, i AS (SELECT report_id, unnest(range(len(issues)))::INT AS pos, unnest(issues).type AS type FROM q) SELECT report_id, pos, CASE WHEN type IN ('missing_heading', 'wrong_heading_level') THEN 'heading' WHEN type = 'zwnj_error' THEN 'zwnj' WHEN type = 'heh_boundary' THEN 'heh_boundary' WHEN type = 'footnote_marker' THEN 'footnote' WHEN type = 'digit_error' THEN 'digits' WHEN type = 'punctuation' THEN 'punctuation' WHEN type = 'verse_structure' THEN 'verse' WHEN type = 'table_structure' THEN 'table' END AS signal FROM i")
def issue_signals(spark, d):
    return reports(spark, d).select("report_id", F.posexplode("issues").alias("pos", "i")).select("report_id", "pos", history.signal(F.col("i.type")).alias("signal"))


@query(f"""WITH {S.E} SELECT book, count(*) AS events, count(*) FILTER (WHERE issue_type = 'pass') AS passed, count(*) FILTER (WHERE detected_by IN ('human_edit', 'suggestion_accepted', 'suggestion_edited', 'suggestion_rejected')) AS human, count(DISTINCT page) AS pages FROM e GROUP BY 1""")
def run_summary(spark, d):
    e = pages.once(events(spark, d), "event_id")
    return e.groupBy("book").agg(F.count("*").alias("events"), F.count_if(F.col("issue_type") == "pass").alias("passed"), F.count_if(F.col("detected_by").isin(history.HUMANS)).alias("human"), F.countDistinct("page").alias("pages"))


# ---------------------------------------------------------------- review
#
# The tables hold reports, but no reviewers' submissions; these are made from the reports by rules that both engines can follow.

_SUB = f"""s0 AS (SELECT report_id, q.rec_id, t.book, coalesce(text_md, '') AS text_md, verdict, issues, suggested_text_md, CASE WHEN report_id % 5 < 3 THEN 'pending' WHEN report_id % 5 = 3 THEN 'accepted' END AS status,
      report_id % 7 <> 0 AS needs_review, CASE WHEN report_id % 4 = 1 THEN 'edited' WHEN report_id % 4 = 2 THEN 'accepted' END AS reviewed, report_id % 6 = 0 AS skipped, CAST(NULL AS VARCHAR) AS orig_text_md, report_id % 2 = 0 AS decided,
      CASE report_id % 3 WHEN 0 THEN coalesce(text_md, '') WHEN 1 THEN coalesce(suggested_text_md, coalesce(text_md, '') || ' ') ELSE coalesce(text_md, '') || '.' END AS new_text FROM q JOIN t USING (rec_id)),
    s1 AS (SELECT *, coalesce(verdict = 'fail' AND status = 'pending' AND suggested_text_md IS NOT NULL, false) AS pend, CASE WHEN len(issues) > 0 THEN issues[1].type ELSE 'human_edit' END AS first, new_text <> text_md AS changed FROM s0),
    i0 AS (SELECT report_id, unnest(range(len(issues)))::INT AS idx, unnest(issues) AS i FROM s0),
    pc AS (SELECT report_id, idx, suggested IS NULL OR idx % 2 = 1 AS finding, CASE WHEN suggested IS NULL OR idx % 2 = 1 THEN 100000 + idx ELSE idx END AS id, old, CASE WHEN suggested IS NULL OR idx % 2 = 1 THEN old ELSE old || '؟' END AS new, coalesce(nullif(type, ''), first) AS issue_type,
      CASE (report_id + idx) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'edited' WHEN 2 THEN 'rejected' ELSE 'pending' END AS decision, CASE WHEN (report_id + idx) % 8 = 1 THEN old || '!' END AS own
      FROM (SELECT i0.report_id, idx, s1.suggested_text_md AS suggested, i.type AS type, first, {S.strip('i.snippet')} AS old FROM i0 JOIN s1 USING (report_id)) WHERE old <> ''),
    ct AS (SELECT report_id, count(*) FILTER (NOT finding) AS nf, count(*) FILTER (NOT finding AND decision = 'approved') AS na, count(*) FILTER (NOT finding AND decision = 'edited') AS ne, count(*) FILTER (finding AND decision = 'edited') AS no_ FROM pc GROUP BY 1),
    oc AS (SELECT *, CASE WHEN changed THEN 'edited' ELSE 'accepted' END AS now, CASE mode WHEN 'findings' THEN CASE WHEN no_ > 0 OR changed THEN 'edited' ELSE 'rejected' END WHEN 'taken' THEN 'accepted' WHEN 'whole' THEN CASE WHEN changed THEN 'edited' ELSE 'rejected' END
      WHEN 'pieces' THEN CASE WHEN nf > 0 AND na = nf AND no_ = 0 THEN 'accepted' WHEN na + ne + no_ = 0 THEN 'rejected' ELSE 'edited' END END AS new_status
      FROM (SELECT s1.*, coalesce(nf, 0) AS nf, coalesce(na, 0) AS na, coalesce(ne, 0) AS ne, coalesce(no_, 0) AS no_, CASE WHEN NOT pend THEN CASE WHEN coalesce(status = 'pending', false) AND suggested_text_md IS NULL THEN 'findings' ELSE 'none' END WHEN new_text = suggested_text_md THEN 'taken' WHEN decided THEN 'pieces' ELSE 'whole' END AS mode FROM s1 LEFT JOIN ct USING (report_id)))"""
_REVIEW = f"WITH {S.T}, {S.Q}, {_SUB}"


def _states(spark, d) -> DataFrame:
    r = reports(spark, d).join(texts(spark, d).select("rec_id", "book", F.coalesce("text_md", F.lit("")).alias("text_md")), "rec_id")
    k = F.col("report_id")
    r = r.withColumns({"status": F.when(k % 5 < 3, "pending").when(k % 5 == 3, "accepted"), "needs_review": k % 7 != 0, "reviewed": F.when(k % 4 == 1, "edited").when(k % 4 == 2, "accepted"), "skipped": k % 6 == 0, "orig_text_md": F.lit(None).cast("string"), "decided": k % 2 == 0})
    return r.withColumn("new_text", F.when(k % 3 == 0, F.col("text_md")).when(k % 3 == 1, F.coalesce("suggested_text_md", F.concat("text_md", F.lit(" ")))).otherwise(F.concat("text_md", F.lit("."))))


def _submitted(spark, d):
    """(states, decided pieces, outcomes), states and pieces kept."""
    states = keep(_states(spark, d), "states")
    i, k = F.col("issue_idx"), F.col("report_id")
    fixes = F.when(F.col("suggested_text_md").isNull(), F.expr("sequence(0, size(issues))")).otherwise(F.filter(F.expr("sequence(0, size(issues))"), lambda x: x % 2 == 1))
    found = review.finding_pieces(states, "report_id")
    linked = F.when(F.col("suggested_text_md").isNotNull(), F.filter(F.expr("sequence(0, size(issues))"), lambda x: x % 2 == 0))
    finding = review.finding_pieces(states, "report_id", linked)
    other = found.join(states.select("report_id", fixes.alias("f")), "report_id").where(~F.array_contains("f", i)).drop("f")
    pieces = finding.unionByName(other.select("report_id", i.alias("id"), "issue_idx", "old", F.concat("old", F.lit("؟")).alias("new"), F.lit(False).alias("finding")))
    n = (k + i) % 8
    said = F.when(n % 4 == 0, "approved").when(n % 4 == 1, "edited").when(n % 4 == 2, "rejected")
    sent = pieces.select("report_id", "id", said.alias("decision"), F.when(n == 1, F.concat("old", F.lit("!"))).alias("text"), F.lit(1).alias("n")).where("decision IS NOT NULL")
    sent = sent.unionByName(sent.select("report_id", "id", F.lit("rejected").alias("decision"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("n")))  # decided before, then anew
    decided = keep(review.decided_pieces(states, pieces, review.last_decisions(sent, "report_id"), "report_id"), "pieces")
    return states, decided, review.outcomes(states, decided, "report_id")


@query(f"{_REVIEW} SELECT report_id, pend AS waits, first AS first_type, CASE WHEN verdict = 'fail' AND status = 'pending' THEN CASE WHEN suggested_text_md IS NULL THEN 'no_suggestion' WHEN suggested_text_md = text_md THEN 'identical' ELSE 'hunks' END END AS panel, len(issues) AS n_issues FROM s1")
def review_panels(spark, d):
    """What waits beside each page: whether a suggestion does, the type of its first issue, and what is shown."""
    return _states(spark, d).select("report_id", review.pending().alias("waits"), review.first_type(F.col("issues")).alias("first_type"), review.panel_kind().alias("panel"), F.size("issues").cast("long").alias("n_issues"))


@query(f"{_REVIEW} SELECT report_id, now AS reviewed, mode, new_status FROM oc")
def accept_outcomes(spark, d):
    """What each submission means for its page."""
    return _submitted(spark, d)[2].select("report_id", "reviewed", "mode", "new_status")


@query(f"""{_REVIEW} SELECT report_id, CAST(NULL AS INT) AS id, by_ AS detected_by, first AS issue_type, text_md AS old, CASE WHEN by_ = 'suggestion_rejected' THEN suggested_text_md ELSE new_text END AS decided
    FROM (SELECT *, CASE WHEN mode = 'taken' THEN 'suggestion_accepted' WHEN mode = 'whole' THEN CASE WHEN changed THEN 'suggestion_edited' ELSE 'suggestion_rejected' END WHEN changed AND (mode = 'none' OR mode = 'findings' AND no_ = 0) THEN 'human_edit' END AS by_ FROM oc) WHERE by_ IS NOT NULL
    UNION ALL SELECT report_id, id, CASE WHEN finding THEN 'human_edit' WHEN decision = 'approved' THEN 'suggestion_accepted' WHEN decision = 'edited' THEN 'suggestion_edited' ELSE 'suggestion_rejected' END, issue_type, old,
    CASE WHEN decision = 'approved' THEN new WHEN decision = 'edited' THEN coalesce(own, CASE WHEN finding THEN old ELSE new END) ELSE old END FROM pc JOIN (SELECT report_id, mode FROM oc) USING (report_id) WHERE (mode = 'pieces' OR mode = 'findings' AND finding) AND (NOT finding OR decision = 'edited')""")
def accept_events(spark, d):
    """The events that submissions leave in the log."""
    _, pieces, out = _submitted(spark, d)
    return review.outcome_events(out, pieces, "report_id")


@query(f"{_REVIEW} SELECT report_id, new_text AS text_md, CASE WHEN changed THEN text_md END AS orig_text_md, false AS needs_review, now AS reviewed, coalesce(new_status, status) AS status FROM oc")
def accepted_pages(spark, d):
    """The pages after their submissions."""
    states, _, out = _submitted(spark, d)
    return review.accepted(states, out, "report_id").select("report_id", "text_md", "orig_text_md", "needs_review", "reviewed", "status")


@query(f"{_REVIEW} SELECT report_id, CASE WHEN touched AND status IN ('accepted', 'edited', 'rejected') THEN 'pending' ELSE status END AS status, touched OR needs_review AS needs_review, CASE WHEN NOT touched THEN reviewed END AS reviewed FROM (SELECT *, reviewed IS NOT NULL OR skipped AS touched FROM s1)")
def reset_reviews(spark, d):
    """The pages with their reviews undone."""
    return review.reset(_states(spark, d)).select("report_id", "status", "needs_review", "reviewed")


@query(f"{_REVIEW}, x AS (SELECT report_id, count(*) FILTER (decision = 'approved') AS a, count(*) FILTER (decision = 'edited') AS e, count(*) FILTER (decision = 'rejected') AS r, count(*) FILTER (decision = 'pending') AS p FROM pc GROUP BY 1) SELECT book, count(*) FILTER (changed) AS edited, count(*) FILTER (NOT changed) AS accepted, coalesce(sum(a), 0)::BIGINT AS approved_pieces, coalesce(sum(e), 0)::BIGINT AS edited_pieces, coalesce(sum(r), 0)::BIGINT AS rejected_pieces, coalesce(sum(p), 0)::BIGINT AS open_pieces FROM oc LEFT JOIN x USING (report_id) GROUP BY 1")
def review_totals(spark, d):
    """What the submissions came to, by book."""
    _, pieces, out = _submitted(spark, d)
    return review.totals(out, pieces, "book", "report_id")


_LATEST = "lr AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY report_id DESC) = 1)"


@query(f"""WITH {S.F}, {S.Q}, {_LATEST}, c AS (SELECT f.rec_id, verdict, report_id IS NOT NULL AS has, suggested_text_md, confidence < 0.7 AS nr FROM f LEFT JOIN lr USING (rec_id))
    SELECT rec_id, verdict, CASE WHEN verdict = 'fail' THEN suggested_text_md END AS suggested_text_md, CASE WHEN verdict = 'fail' THEN 'pending' END AS status, coalesce(verdict = 'fail', false) OR nr AS needs_review FROM c""")
def checked_pages(spark, d):
    """Every page with the result of its last report."""
    r = reports(spark, d)
    last = r.groupBy("rec_id").agg(F.max_by(F.struct("verdict", "issues", "suggested_text_md"), "report_id").alias("r")).select("rec_id", "r.*")
    none = {"verdict": F.lit(None).cast("string"), "issues": F.lit(None).cast(r.schema["issues"].dataType), "suggested_text_md": F.lit(None).cast("string"), "status": F.lit(None).cast("string")}
    states = fields(spark, d).select("rec_id", (F.col("confidence") < 0.7).alias("needs_review"), *(v.alias(c) for c, v in none.items()))
    return review.checked(states, last, "rec_id").select("rec_id", "verdict", "suggested_text_md", "status", "needs_review")


@query(f"""WITH {S.T}, {S.F}, {S.Q}, e AS (SELECT report_id, rec_id, CASE WHEN verdict = 'fail' AND len(issues) > 0 THEN list_transform(issues, lambda i: i.type) ELSE ['pass'] END AS ty FROM q),
    x AS (SELECT report_id, rec_id, unnest(range(len(ty)))::INT AS pos, unnest(ty) AS issue_type FROM e)
    SELECT report_id, pos, t.book, t.page, source_type, model_used, 'auto_qc' AS detected_by, issue_type, array_to_string(list_filter(coalesce(flags, []), lambda v: v IS NOT NULL), '|') AS flags, {S.bucket('confidence')} AS bucket,
    CASE WHEN issue_type IN ('missing_heading', 'wrong_heading_level') THEN 'heading' WHEN issue_type = 'zwnj_error' THEN 'zwnj' WHEN issue_type = 'heh_boundary' THEN 'heh_boundary' WHEN issue_type = 'footnote_marker' THEN 'footnote' WHEN issue_type = 'digit_error' THEN 'digits' WHEN issue_type = 'punctuation' THEN 'punctuation' WHEN issue_type = 'verse_structure' THEN 'verse' WHEN issue_type = 'table_structure' THEN 'table' ELSE '' END AS signals
    FROM x JOIN t USING (rec_id) JOIN f USING (rec_id) LEFT JOIN (SELECT book, source_type FROM books) b ON b.book = t.book""")
def recorded_events(spark, d):
    """The events that the verifier's reports leave in the log."""
    page = texts(spark, d).select("rec_id", "book", "page").join(fields(spark, d).select("rec_id", "model_used", "flags", "confidence"), "rec_id").join(read(spark, d, "books", "book", "source_type"), "book", "left")
    e = review.report_events(reports(spark, d).select("report_id", "rec_id", "verdict", "issues").join(page, "rec_id"))
    return e.select("report_id", "pos", "book", "page", "source_type", "model_used", "detected_by", "issue_type", F.array_join("features.flags", "|").alias("flags"), F.col("features.confidence_bucket").alias("bucket"), F.array_join("features.char_signals", "|").alias("signals"))


@query(f"{_EVAL}, {_BEST.replace('best AS (SELECT *', 'best AS (SELECT *')}, nd AS ({_NEEDS.replace('SELECT rec_id,', 'SELECT rec_id, book,')}) SELECT book, count(*) AS ok, count(*) FILTER (escalate) AS escalated, count(*) FILTER (review) AS flagged FROM nd GROUP BY 1")
def run_counters(spark, d):
    """Pages done, asked again and marked for review, by book."""
    e = evaluated(spark, d).withColumn("flags", F.filter("flags", lambda x: x.isNotNull()))
    return review.counters(e, "book", validators.needs_escalation(F.col("is_blank")), validators.needs_review(F.col("is_blank")))


@query(f"WITH {S.T}, {S.F} SELECT book, page, count(*) AS attempts, sum(coalesce(length(text_md), 0))::BIGINT AS output, sum(CASE WHEN resolution = 'hi' THEN 6800 WHEN resolution = 'std' THEN 3200 ELSE 0 END)::BIGINT AS input FROM t JOIN f USING (rec_id) GROUP BY 1, 2")
def usage_sums(spark, d):
    """What all attempts at a page used; input by resolution, output by the text's length, as the tables hold no counts of tokens."""
    t = once(spark, d, "page_text", "rec_id", "rec_id", "book", "page", "text_md").select("rec_id", "book", "page", F.length("text_md").alias("output"))
    used = t.join(fields(spark, d).select("rec_id", F.when(F.col("resolution") == "hi", 6800).when(F.col("resolution") == "std", 3200).alias("input")), "rec_id")
    return review.usage(used, ["book", "page"], "output", "input")


@query(f"""{_EVAL}, hs AS (SELECT rec_id, h, 0 AS side, i FROM mh WHERE h IS NOT NULL UNION ALL SELECT rec_id, h, 1, i FROM eh), hf AS (SELECT rec_id, h, min(side * 1000000 + i) AS o FROM hs GROUP BY 1, 2) SELECT rec_id, string_agg(h, '|' ORDER BY o) AS hints FROM hf GROUP BY 1""")
def hint_headings(spark, d):
    """The headings a page is asked for again: declared ones its text lacks, then candidates of its other text, each once, in order."""
    p = _with_before(spark, d).select("rec_id", F.coalesce("text_md", F.lit("")).alias("text_md"), F.filter("headings", lambda h: h.isNotNull()).alias("headings"), "heading_candidates").withColumn("lines", X.heading_lines(F.col("text_md")))
    none = F.array().cast("array<string>")
    hints = F.array_distinct(F.concat(*(F.coalesce(validators.unmatched(F.coalesce(c, none), F.col("lines"), skip), none) for c, skip in (("headings", False), ("heading_candidates", True)))))
    return p.withColumn("h", hints).where(F.size("h") > 0).select("rec_id", F.array_join("h", "|").alias("hints"))


# ---------------------------------------------------------------- boxes

_BOX = f"{S.Q}, i AS (SELECT report_id, unnest(range(len(issues)))::INT AS pos, unnest(issues).bbox AS b FROM q), c AS (SELECT report_id, pos, b, list_transform(b, lambda x: greatest(0, least(1000, round_even(x::DOUBLE, 0)::INT))) AS v FROM i)"


@query(f"WITH {_BOX} SELECT report_id, pos, CASE WHEN len(b) = 4 AND len(list_filter(b, lambda x: x IS NULL)) = 0 AND v[1] < v[3] AND v[2] < v[4] THEN array_to_string(v, ',') END AS box FROM c")
def clean_bbox(spark, d):
    i = reports(spark, d).select("report_id", F.posexplode("issues").alias("pos", "i"))
    return i.select("report_id", "pos", F.array_join(M.clean_bbox(F.col("i.bbox")), ",").alias("box"))


@query(f"WITH {_BOX}, x AS (SELECT report_id, pos, b[1] / 1000.0::DOUBLE AS x0, b[2] / 1000.0::DOUBLE AS y0, b[3] / 1000.0::DOUBLE AS x1, b[4] / 1000.0::DOUBLE AS y1 FROM c WHERE len(b) = 4) SELECT * FROM x WHERE x0 >= 0 AND x0 < x1 AND x1 <= 1 AND y0 >= 0 AND y0 < y1 AND y1 <= 1")
def bbox_to_box(spark, d):
    i = reports(spark, d).select("report_id", F.posexplode("issues").alias("pos", "i")).withColumn("x", M.bbox_to_box(F.col("i.bbox"))).where("x IS NOT NULL")
    return i.select("report_id", "pos", "x.*")


# ---------------------------------------------------------------- Markdown


@query(f"WITH {S.T}, p AS (SELECT rec_id, text_md FROM t WHERE text_md IS NOT NULL), {S.kinds('p')} SELECT rec_id, line::INT AS line, kind FROM kind")
def line_kinds(spark, d):
    return markdown.classified(spread_texts(spark, d).where("text_md IS NOT NULL").select("rec_id", "text_md")).select("rec_id", "line", "kind")


@query(f"""WITH {S.T}, x AS (SELECT rec_id, line, s, starts_with(s, '```') AS fence FROM (SELECT rec_id, line, {S.strip('raw')} AS s FROM (SELECT rec_id, unnest(range(len(l)))::INT AS line, unnest(l) AS raw FROM (SELECT rec_id, string_split(text_md, chr(10)) AS l FROM t WHERE text_md IS NOT NULL)))),
    y AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY rec_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x), z AS (SELECT *, CASE WHEN fence AND before % 2 = 0 THEN {S.strip('substring(s, 4)')} END AS tag FROM y)
    SELECT rec_id, line, coalesce(NOT fence AND before % 2 = 1 AND last_value(tag IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'verse', false) AS inside FROM z""")
def verse_mask(spark, d):
    return markdown.parity_verse(spread_texts(spark, d).where("text_md IS NOT NULL").select("rec_id", "text_md"))


@query(f"WITH {S.T}, p AS (SELECT rec_id, text_md FROM t WHERE text_md IS NOT NULL), {S.blocks('p')} SELECT rec_id, block, kind, array_to_string(items, chr(10)) AS items FROM block")
def md_blocks(spark, d):
    b = markdown.blocks(spread_texts(spark, d).where("text_md IS NOT NULL").select("rec_id", "text_md"))
    return b.select("rec_id", F.col("block").cast("int").alias("block"), "kind", F.array_join("items", "\n").alias("items"))


@query(f"WITH {S.T}, p AS (SELECT rec_id, text_md FROM t WHERE text_md IS NOT NULL), {S.kinds('p')} SELECT rec_id, label, arg_max(def, line) AS definition FROM (SELECT rec_id, line, regexp_extract(s, '(?s)^\\[\\^([^\\]]+)\\]:\\s?(.*)$', 1) AS label, regexp_extract(s, '(?s)^\\[\\^([^\\]]+)\\]:\\s?(.*)$', 2) AS def FROM kind WHERE kind = 'note') GROUP BY 1, 2")
def notes(spark, d):
    return markdown.notes(spread_texts(spark, d).where("text_md IS NOT NULL").select("rec_id", "text_md"))


_STITCH = f"WITH {S.T}, {S.F}, {S.LAST}, {S.blocks('last', 'rec_id, book, page')}, {S.STITCH}"


def _stitched(spark, d):
    return markdown.chapters_by_heading(markdown.stitched(last_texts(spark, d)))


@query(f"{_STITCH} SELECT rec_id, block, para, joined FROM st")
def stitch(spark, d):
    return markdown.stitched(last_texts(spark, d)).select("rec_id", F.col("block").cast("int").alias("block"), "para", "joined")


@query(f"{_STITCH} SELECT rec_id, block, chapter FROM cp")
def chapters_by_heading(spark, d):
    return _stitched(spark, d).select("rec_id", F.col("block").cast("int").alias("block"), "chapter")


@query("WITH p AS (SELECT DISTINCT book, page FROM page_text) SELECT book, page, idx, title FROM p LEFT JOIN LATERAL (SELECT idx, title FROM chapters c WHERE c.book = p.book AND c.start_page <= p.page ORDER BY start_page DESC, idx DESC LIMIT 1) x ON true")
def chapters_by_page(spark, d):
    return markdown.chapters_by_page(read(spark, d, "page_text", "book", "page"), read(spark, d, "chapters", "book", "idx", "title", "start_page"))


_NOTES = f"""it AS (SELECT rec_id, book, chapter, page, block, unnest(range(len(items)))::INT AS item, unnest(items) AS tx FROM cp),
    rf AS (SELECT rec_id, book, chapter, page, block, item, unnest(range(len(ls)))::INT AS spot, unnest(ls) AS label FROM (SELECT *, regexp_extract_all(tx, '\\[\\^([^\\]]+)\\]', 1) AS ls FROM it)),
    df AS (SELECT rec_id, label, arg_max(def, line) AS definition FROM (SELECT rec_id, line, regexp_extract(s, '(?s)^\\[\\^([^\\]]+)\\]:\\s?(.*)$', 1) AS label, regexp_extract(s, '(?s)^\\[\\^([^\\]]+)\\]:\\s?(.*)$', 2) AS def FROM kind WHERE kind = 'note') GROUP BY 1, 2),
    fn AS (SELECT rec_id, book, page, block, item, spot, label, chapter, row_number() OVER (PARTITION BY book, chapter ORDER BY page, rec_id, block, item, spot)::INT AS number, coalesce(definition, '') AS definition FROM rf LEFT JOIN df USING (rec_id, label))"""


@query(f"{_STITCH}, {_NOTES} SELECT rec_id, block, item, spot, label, chapter, number, definition FROM fn")
def footnotes(spark, d):
    b, defs = _chaptered(last_texts(spark, d))
    r = markdown.references(b, defs)
    return r.select("rec_id", F.col("block").cast("int").alias("block"), "item", F.col("at").alias("spot"), "label", "chapter", "number", "definition")


def _chaptered(last: DataFrame):
    """(blocks with their chapters, notes' definitions) of one reading of the texts."""
    b = keep(markdown.blocks(last.select("rec_id", "book", "page", "text_md"), with_notes=True), "blocks")
    return markdown.chapters_by_heading(markdown.stitched(last, b)), markdown.notes_of(b)


def _bodies(spark, d):
    b, defs = _chaptered(last_texts(spark, d).withColumn("text_md", X.normalize(F.col("text_md"))))
    b = keep(b, "chapters")
    refs = keep(markdown.references(b, defs), "references")
    return markdown.xhtml(b, refs), refs, b


#: The same over normalised texts, as books are built.
_CLEAN = f"WITH {S.T}, {S.F}, {S.LAST.replace('last AS (', 'l0 AS (')}, last AS (SELECT * REPLACE ({S.normalize('text_md')} AS text_md) FROM l0), {S.blocks('last', 'rec_id, book, page')}, {S.STITCH}, {_NOTES}, {S.xhtml()}"


@query(f"{_CLEAN} SELECT rec_id, block, kind, html FROM xh")
def xhtml(spark, d):
    return _bodies(spark, d)[0].select("rec_id", F.col("block").cast("int").alias("block"), "kind", "html")


@query(f"""{_CLEAN}, pt AS (SELECT para, string_agg(html, ' ' ORDER BY page, block) AS i FROM xh GROUP BY 1), wh AS (SELECT book, chapter, page, block, CASE WHEN kind = 'p' THEN '<p>' || i || '</p>' ELSE i END AS v FROM xh JOIN pt USING (para) WHERE NOT joined),
    bo AS (SELECT book, chapter, string_agg(v, '' ORDER BY page, block) AS b FROM wh GROUP BY 1, 2), en AS (SELECT book, chapter, string_agg('<li id="fn-c' || chapter || '-' || number || '">' || {S.inline('definition')} || ' <a href="#fnref-c' || chapter || '-' || number || '" class="fnback" epub:type="backlink">↩</a></li>', '' ORDER BY number) AS e FROM fn GROUP BY 1, 2)
    SELECT book, chapter, b || coalesce('<section class="endnotes" epub:type="footnotes"><hr/><ol>' || e || '</ol></section>', '') AS body FROM bo LEFT JOIN en USING (book, chapter)""")
def chapter_bodies(spark, d):
    """(book, chapter, body): the XHTML of every chapter."""
    x, refs, _ = _bodies(spark, d)
    return markdown.chapter_bodies(x, refs)


# ---------------------------------------------------------------- differences


@query()
def change_signals(spark, d):
    """What changed between each text and the correction suggested for it."""
    r = reports(spark, d).where("suggested_text_md IS NOT NULL").select("report_id", "rec_id", "suggested_text_md").join(texts(spark, d).select("rec_id", "text_md"), "rec_id")
    return diffing.with_signals(r, "text_md", "suggested_text_md").select("report_id", F.array_join("signals", "|").alias("signals"))


def _hunks(spark, d):
    r = reports(spark, d).where("suggested_text_md IS NOT NULL").join(texts(spark, d).select("rec_id", "text_md"), "rec_id")
    return diffing.with_hunks(r.select("report_id", "issues", "text_md", "suggested_text_md"), "text_md", "suggested_text_md")


@query()
def hunks(spark, d):
    h = _hunks(spark, d)
    return h.select("report_id", *[c for c in h.columns if c not in ("report_id", "issues")], diffing.link(F.col("issues"), F.col("old"), F.col("new"), F.col("ctx_before"), F.col("ctx_after")).alias("issue_idx"))


@query(f"WITH {S.T}, {S.Q} SELECT report_id, suggested_text_md AS text FROM q JOIN t USING (rec_id) WHERE text_md <> suggested_text_md")
def applied_hunks(spark, d):
    """Each text with all its hunks put in, which is the text suggested."""
    h = _hunks(spark, d)
    parts = h.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("id", "old", "new", "ctx_before", "ctx_after", "occurrence"))).alias("hunks"))  # at most the hunks of one text
    r = reports(spark, d).where("suggested_text_md IS NOT NULL").select("report_id", "rec_id").join(texts(spark, d).select("rec_id", "text_md"), "rec_id")
    return diffing.applied(r.join(parts, "report_id").withColumn("decisions", F.lit(None).cast("array<struct<id: int, text: string>>")), "report_id")


@query()
def unlinked_findings(spark, d):
    linked = hunks(spark, d).where("issue_idx IS NOT NULL").groupBy("report_id").agg(F.collect_set("issue_idx").alias("linked"))
    r = reports(spark, d).select("report_id", "rec_id", "issues").join(texts(spark, d).select("rec_id", "text_md"), "rec_id").join(linked, "report_id", "left")
    return diffing.findings(r).select("report_id", "id", "issue_idx", "snippet", "is_unique")


# ---------------------------------------------------------------- places on pages


def printed(spark, d, only=None):
    """Pages as a printer might set them: (lines, words); of `only` (rec_id) where given, so that no words of other pages are made."""
    t = spread_texts(spark, d) if only is None else spread(texts(spark, d).join(only.select("rec_id").distinct(), "rec_id", "leftsemi"), read(spark, d, "page_text", "rec_id"))
    t = t.where("text_md IS NOT NULL").select("rec_id", F.posexplode(X.lines(F.col("text_md"))).alias("line", "raw"))
    t = t.withColumn("n", F.length(F.regexp_replace("raw", X.WHITE, ""))).where("n >= 2")
    y0, y1 = (20 + 14 * F.col("line")).cast("double").alias("y0"), (32 + 14 * F.col("line")).cast("double").alias("y1")
    lines = t.select("rec_id", "line", "n", y0, y1, (2000 - 4 * F.col("n")).cast("double").alias("x0"), F.lit(2000.0).alias("x1"))
    w = t.select("rec_id", "line", F.posexplode(X.words(F.col("raw"))).alias("word", "w"))
    upto = F.sum(F.length("w")).over(W.partitionBy("rec_id", "line").orderBy("word"))
    words = w.withColumn("upto", upto).select("rec_id", "line", "word", "w", F.length("w").alias("chars"), (2000.0 - 5 * (F.col("upto") - F.length("w")) - F.col("word")).alias("x1"), (2000.0 - 5 * F.col("upto") - F.col("word")).alias("x0"), y0, y1)
    return lines, words


def _snippets(spark, d):
    i = reports(spark, d).select("rec_id", "report_id", F.posexplode("issues").alias("pos", "i")).select("rec_id", (F.col("report_id") * 100 + F.col("pos")).alias("qid"), F.col("i.snippet").alias("snippet"))
    return i.join(texts(spark, d).select("rec_id", "text_md"), "rec_id")


def _spans(spark, d):
    """The snippets with their places: exactly where found so, by likeness for the rest."""
    return matching.with_spans(_snippets(spark, d).where("text_md IS NOT NULL AND snippet IS NOT NULL"))


def _found(spark, d):
    return keep(layout.shares(_spans(spark, d)), "found")


def _found_exact(spark, d):
    """Only the snippets that stand in their page as they are, which is what SQL can say."""
    return keep(layout.shares(layout.exact_spans(_snippets(spark, d))), "found")


def _layout_hits(found, spark, d):
    h = layout.hits(found, printed(spark, d, found)[0], "n", True)
    return h.select("rec_id", "qid", "line", F.round("u0", 6).alias("u0"), F.round("u1", 6).alias("u1"))


def _layout_boxes(found, spark, d):
    lines, words = printed(spark, d, found)
    h = layout.hits(found, lines, "n", True)
    size = found.select("rec_id").distinct().select("rec_id", F.lit(2000.0).alias("width"), F.lit(3000.0).alias("height"))
    return layout.boxes(layout.word_extents(h, words), size, "layout")


def _rounded(b):
    return b.select("rec_id", "qid", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")), "source")


def _scan_hits(found, spark, d):
    h = layout.hits(found, printed(spark, d, found)[0], "n", False)
    return layout.one_line_if_short(h).select("rec_id", "qid", "line")


_LAYOUT = f"WITH {S.T}, {S.Q}, {S.PRINT}, {S.SPANS}, {S.line_ranges('n')}, {S.HITS}"


@query(f"{_LAYOUT} SELECT rec_id, qid, line, round(u0::VARCHAR::DECIMAL(38, 20), 6)::DOUBLE AS u0, round(u1::VARCHAR::DECIMAL(38, 20), 6)::DOUBLE AS u1 FROM ht")
def layout_hits(spark, d):
    """Of snippets found exactly, as in the SQL; layout_hits_all has them all."""
    return _layout_hits(_found_exact(spark, d), spark, d)


@query()
def layout_hits_all(spark, d):
    """(rec_id, qid, line, u0, u1) of every snippet that has a place, exactly or by likeness."""
    return _layout_hits(_found(spark, d), spark, d)


@query(f"""{_LAYOUT}, wr AS (SELECT *, row_number() OVER o - 1 AS place, count(*) OVER p AS cnt, (sum(chars) OVER o - chars)::DOUBLE / sum(chars) OVER p AS w0, (sum(chars) OVER o)::DOUBLE / sum(chars) OVER p AS w1 FROM pw WINDOW p AS (PARTITION BY rec_id, line), o AS (PARTITION BY rec_id, line ORDER BY x1 DESC, word)),
    lh AS (SELECT rec_id, qid, line, greatest(0.0, least(1.0, u0)) AS lo, CASE WHEN greatest(0.0, least(1.0, u1)) <= greatest(0.0, least(1.0, u0)) THEN least(1.0, greatest(0.0, least(1.0, u0)) + 1e-6) ELSE greatest(0.0, least(1.0, u1)) END AS hi FROM ht),
    bw AS (SELECT *, w1 > lo AND w0 < hi AS over_, place = least(floor(lo * cnt), cnt - 1) AS fall FROM lh JOIN wr USING (rec_id, line)),
    bx AS (SELECT * FROM bw QUALIFY over_ OR (NOT bool_or(over_) OVER (PARTITION BY rec_id, qid, line) AND fall))
    SELECT rec_id, qid, round(greatest(0.0, least(1.0, min(x0) / 2000.0)), 6) AS x0, round(greatest(0.0, least(1.0, min(y0) / 3000.0)), 6) AS y0, round(greatest(0.0, least(1.0, max(x1) / 2000.0)), 6) AS x1, round(greatest(0.0, least(1.0, max(y1) / 3000.0)), 6) AS y1, 'layout' AS source FROM bx GROUP BY 1, 2""")
def layout_boxes(spark, d):
    """Of snippets found exactly, as in the SQL; layout_boxes_all has them all."""
    return _rounded(_layout_boxes(_found_exact(spark, d), spark, d))


@query()
def layout_boxes_all(spark, d):
    """(rec_id, qid, x0, y0, x1, y1, source) of every snippet that has a place, exactly or by likeness."""
    return _rounded(_layout_boxes(_found(spark, d), spark, d))


@query(f"""WITH {S.T}, {S.Q}, {S.PRINT}, {S.SPANS}, {S.line_ranges('n')}, hs AS (SELECT rec_id, qid, line, least(fb, le) - greatest(fa, ls) AS overlap, chars FROM fr JOIN (SELECT * FROM lr WHERE pwt > 0) USING (rec_id) WHERE le > fa AND ls < fb)
    SELECT rec_id, qid, line FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, qid ORDER BY overlap DESC, line) AS n FROM hs) WHERE chars > 14 OR n = 1""")
def scan_hits(spark, d):
    """Of snippets found exactly, as in the SQL; scan_hits_all has them all."""
    return _scan_hits(_found_exact(spark, d), spark, d)


@query()
def scan_hits_all(spark, d):
    """(rec_id, qid, line) of every snippet that has a place, exactly or by likeness."""
    return _scan_hits(_found(spark, d), spark, d)


@query()
def fuzzy_spans(spark, d):
    """(rec_id, qid, s, e): the place of each finding's snippet, by likeness where it isn't found as it is."""
    return _spans(spark, d).where("s IS NOT NULL").select("rec_id", "qid", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


@query()
def matched_boxes(spark, d):
    """(rec_id, qid, x0, y0, x1, y1): snippets sought among the words of the printed page, of windows nearly as good the one nearest to the layout's box."""
    return _matched(_layout_boxes(_found(spark, d), spark, d), spark, d)


def _matched(by_lines, spark, d):
    middle = by_lines.select("rec_id", "qid", ((F.col("y0") + F.col("y1")) / 2).alias("expected"))
    snippets = reports(spark, d).select("rec_id", "report_id", F.posexplode("issues").alias("pos", "i")).select("rec_id", (F.col("report_id") * 100 + F.col("pos")).alias("qid"), F.col("i.snippet").alias("snippet")).where("snippet IS NOT NULL")
    asked = snippets.join(middle, ["rec_id", "qid"], "left").groupBy("rec_id").agg(F.collect_list(F.struct("qid", F.col("snippet").alias("text"), "expected")).alias("queries"))
    words = printed(spark, d, snippets)[1].groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "word", F.struct("x0", "y0", "x1", "y1", F.col("w").alias("word")).alias("r")))), lambda x: x["r"]).alias("words"))
    p = asked.join(words, "rec_id").select("rec_id", F.lit(2000.0).alias("width"), F.lit(3000.0).alias("height"), "words", "queries")
    return matching.located(p)


@query()
def scan_lines(spark, d):
    """(rec_id, line, x0, y0, x1, y1, weight, n_words): lines found in the pixels of a page drawn from its lines and words."""
    return _seen(printed(spark, d)[1]).select("rec_id", "line", "x0", "y0", "x1", "y1", F.round("weight", 6).alias("weight"), F.size("words").alias("n_words"))


def _seen(words):
    """The scan lines of pages drawn from their words."""
    drawn = words.groupBy("rec_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("w")).mapInArrow(_draw, "rec_id bigint, height int, width int, grey binary")
    return scans.scan_lines(drawn, 0.5)


def _scan_boxes(found, spark, d):
    """The boxes of spans by the pixels of their pages alone; only these pages are drawn."""
    seen = keep(_seen(printed(spark, d, found)[1]), "scan-lines")
    h = layout.one_line_if_short(layout.hits(found, seen, "weight", False))
    x = layout.scan_extents(h, seen)
    # a drawn page has an edge of 80 on the left that the printed one has not
    x = x.select("rec_id", "qid", (F.col("x0") - 80).alias("x0"), "y0", (F.col("x1") - 80).alias("x1"), "y1")
    size = found.select("rec_id").distinct().select("rec_id", F.lit(2000.0).alias("width"), F.lit(3000.0).alias("height"))
    return layout.boxes(x, size, "scan")


def _draw(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for part in range(0, b.num_rows, 64):
            rows = []
            for r in b.slice(part, 64).to_pylist():
                high = int(max(w["y1"] for w in r["w"]) / 2) + 40
                page = np.full((high, 1100), 235, np.uint8)
                for w in r["w"]:
                    x0, x1 = (max(0, int(w[c] / 2) + 40) for c in ("x0", "x1"))
                    page[int(w["y0"] / 2) : int(w["y1"] / 2) - 1, x0 : max(x0 + 1, x1 - 1)] = 20
                rows.append((r["rec_id"], high, 1100, page.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int32(), pa.binary()])], ["rec_id", "height", "width", "grey"])


@query(f"""WITH {S.T}, p AS (SELECT rec_id, text_md FROM t WHERE text_md IS NOT NULL), {S.kinds('p')},
    ws AS (SELECT rec_id, line::INT AS line, unnest(range(len(w)))::INT AS span, unnest(w) AS text, CASE WHEN kind IN ('h1', 'h2', 'h3') THEN 14.04 ELSE 11.02 END AS size, CASE WHEN kind = 'note' THEN 16 ELSE 0 END AS flags FROM (SELECT rec_id, line, kind, {S.words('raw')} AS w FROM kind)),
    sz AS (SELECT rec_id, round(size, 1) AS size, sum(length(text)) AS n, min(line * 100000 + span) AS f FROM ws GROUP BY ALL), bd AS (SELECT rec_id, size AS body FROM sz QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, f) = 1),
    li AS (SELECT rec_id, line, string_agg(text, '' ORDER BY span) AS text, min((flags & 16 <> 0)::INT) AS bold, max(round(size, 1)) AS top FROM ws GROUP BY 1, 2)
    SELECT rec_id, line, text FROM li JOIN bd USING (rec_id) WHERE (bold = 1 OR top > 1.15 * body) AND length(text) BETWEEN 2 AND 60 AND regexp_matches(text, '[^\\p{{Nd}}\\p{{P}}\\p{{S}}\\s]')""")
def heading_candidates(spark, d):
    """Of a text layer in which headings are set larger and notes bold, a span for each word."""
    k = markdown.classified(spread_texts(spark, d).where("text_md IS NOT NULL").select("rec_id", "text_md"))
    size = F.when(F.col("kind").isin("h1", "h2", "h3"), 14.04).otherwise(11.02)
    spans = k.select("rec_id", "line", F.posexplode(X.words(F.col("raw"))).alias("span", "text"), size.alias("size"), F.when(F.col("kind") == "note", 16).otherwise(0).alias("flags"))
    return headings.candidates(spans)


@query(f"{_STITCH}, {_NOTES}, {S.xhtml()} SELECT rec_id, block, substring(kind, 2, 1) AS level, substring(html, 5, length(html) - 9) AS heading FROM xh WHERE kind IN ('h1', 'h2', 'h3')")
def html_headings(spark, d):
    """(rec_id, block, level, heading): the headings of all three levels as the XHTML has them, with their markup."""
    return _headings(spark, d).where("level <> ''")


def _headings(spark, d):
    b, defs = _chaptered(last_texts(spark, d))
    b = keep(b, "chapters")
    x = markdown.xhtml(b, markdown.references(b, defs))
    return x.select("rec_id", F.col("block").cast("int").alias("block"), F.regexp_extract("html", "^<h([123])[^>]*>", 1).alias("level"), F.regexp_extract("html", "(?s)^<h[123][^>]*>(.*)</h[123]>", 1).alias("heading"))


def _tiers(spark, d):
    found = _found(spark, d)
    by_lines = keep(_layout_boxes(found, spark, d), "by-lines")
    by_words = keep(_matched(by_lines, spark, d).withColumn("source", F.lit("match")), "by-words")
    open_ = found.join(by_words.unionByName(by_lines).select("rec_id", "qid"), ["rec_id", "qid"], "leftanti")
    return layout.placed(by_words, by_lines, _scan_boxes(keep(open_, "open"), spark, d))


@query()
def located(spark, d):
    """(rec_id, qid, x0, y0, x1, y1, source): each snippet's box by the first tier that has one."""
    return _rounded(_tiers(spark, d))


@query()
def tier_counts(spark, d):
    """(source, n): how many snippets each tier placed, null for those without a box."""
    return _snippets(spark, d).select("rec_id", "qid").join(_tiers(spark, d).select("rec_id", "qid", "source"), ["rec_id", "qid"], "left").groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {S.E}, {_FEAT}, {_WEIGHT} SELECT feature, n, issues, round(weight::VARCHAR::DECIMAL(38, 20), 6)::DOUBLE AS weight FROM wt")
def streamed_weights(spark, d):
    """The feature weights again, of the log read as a stream."""
    from bargspark.streaming import history as stream

    base = table_path(spark, "stream")
    path = f"{d}/qc_events.parquet"
    kept = read(spark, d, "qc_events").schema
    src = stream.once_each(stream.read_events(spark, path if _is_folder(spark, path) else _folder_of(path), kept), "365 days")
    run = src.writeStream.foreachBatch(lambda b, i: stream.update_counts(b, i, f"{base}/counts")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.weights(spark, f"{base}/counts").withColumn("weight", F.round("weight", 6))


def _is_folder(spark, path: str) -> bool:
    """On whatever file system the path is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _folder_of(path: str) -> str:
    """A file source takes a pattern; one that only this file fits."""
    head, _, tail = path.rpartition("/")
    return f"{head}/{{{tail}}}"
