import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bargspark.operators import history, markdown, pages, validators

EMPTY = "rec_id bigint, book string, page int, text_md string, confidence double, flags array<string>, headings array<string>, embedded_text string, heading_candidates array<string>, attempt int"


def evaluated(spark, **row):
    base = {"rec_id": 1, "book": "b", "page": 1, "text_md": "", "confidence": 0.9, "flags": [], "headings": [], "embedded_text": None, "heading_candidates": [], "attempt": 1}
    return validators.evaluate(spark.createDataFrame([{**base, **row}], EMPTY)).first()


@pytest.mark.parametrize(
    "row,issues,score",
    [
        ({}, [], 0.9),
        ({"text_md": "abc سلام"}, ["high_latin_ratio"], 0.8),
        ({"text_md": "abc سلام", "flags": ["non_persian"]}, [], 0.9),
        ({"text_md": "يك متن"}, ["arabic_codepoints"], 0.8),
        ({"text_md": "تکرار " * 60}, ["repetition"], 0.8),
        ({"text_md": "او " * 100}, [], 0.9),
        ({"text_md": "## عنوان یک\nمتن", "headings": ["عنوان یک", "دیگر متن"]}, ["missing_heading"], 0.8),
        ({"text_md": "متن", "headings": ["۱"]}, ["missing_heading"], 0.8),
        ({"text_md": "متن", "heading_candidates": ["۱", "فصل دوم"]}, ["embedded_heading_missing"], 0.8),
        ({"confidence": None, "flags": None, "headings": None, "text_md": None}, [], 0.0),
        ({"confidence": 0.05, "text_md": "abc ديگر", "headings": ["الف ب", "پت"]}, ["high_latin_ratio", "arabic_codepoints", "missing_heading"], 0.0),
    ],
)
def test_evaluate(spark, row, issues, score):
    r = evaluated(spark, **row)
    assert r.issues == issues and r.quality_score == pytest.approx(score)


def test_second_text(spark):
    words = [f"واژه{'ابپتثجچحخدذرزسشصضطظعغفقکگلمنوهی'[i]}" for i in range(30)]
    same = evaluated(spark, text_md=" ".join(words), embedded_text=" ".join(reversed(words)), confidence=1.0)
    assert same.similarity == 1.0 and same.length_ratio == 1.0 and same.issues == [] and same.quality_score == 1.0
    half = evaluated(spark, text_md=" ".join(words[:15]), embedded_text=" ".join(words), confidence=1.0)
    assert half.issues == ["embedded_mismatch", "length_anomaly"] and half.similarity == pytest.approx(round(15 / math.sqrt(450), 4))
    assert evaluated(spark, text_md="x", embedded_text=" ".join(words[:24])).similarity is None
    gone = evaluated(spark, text_md="", embedded_text=" ".join(words))
    assert gone.similarity == 0.0 and gone.length_ratio == 0.0


def test_empty_tables(spark):
    df = spark.createDataFrame([], EMPTY)
    assert validators.evaluate(df).count() == 0 and validators.promote_headings(df).count() == 0
    assert pages.classify_sources(df).count() == 0 and pages.usable_layer(df).count() == 0


def test_promotion(spark):
    df = spark.createDataFrame([(1, "**A**\nB\n# C\nB\nC", ["A", " B ", "C", "", "B", "Z"]), (2, None, ["A"]), (3, "A", None)], "rec_id bigint, text_md string, headings array<string>")
    assert {tuple(r) for r in validators.promote_headings(df).collect()} == {(1, 0, "### A"), (1, 1, "## B"), (1, 3, "## B")}


def test_keep_better(spark):
    df = spark.createDataFrame([("b", 1, 1, 0.5, 7), ("b", 1, 2, 0.5, 8), ("b", 1, 3, None, 9), ("b", 2, 1, None, 10)], "book string, page int, attempt int, score double, rec_id bigint")
    assert {r.rec_id for r in pages.keep_better(df, F.col("score"), "attempt").collect()} == {8, 10}


@pytest.mark.parametrize("total,budget", [(1, 1), (5, 1), (6, 2)])
def test_review_budget(spark, total, budget):
    df = spark.createDataFrame([("b", p, 1.0 - p / 10) for p in range(1, total + 1)], "book string, page int, q double")
    got = pages.review_budget(df, F.lit(True), F.col("q")).orderBy("rank").collect()
    assert [r.surfaced for r in got] == [True] * budget + [False] * (total - budget) and got[0].page == total


@pytest.mark.parametrize("n,k", [(1, 1), (10, 1), (50, 2), (70, 4)])
def test_sample_size(spark, n, k):
    df = spark.createDataFrame([("b", p) for p in range(n)], "book string, page int")
    assert pages.verify_selection(df, F.lit(False), F.lit(0.0)).count() == k


def log(spark, rows):
    return spark.createDataFrame([(i, "b", 1, *r) for i, r in enumerate(rows)], "event_id bigint, book string, page int, source_type string, model_used string, detected_by string, issue_type string, features struct<flags: array<string>, confidence_bucket: string, char_signals: array<string>>")


def test_weights_and_risk(spark):
    row = lambda m, t, f=(): ("scanned", m, "auto_qc", t, (list(f), "<0.7", None))
    rows = [row("a", "wrong_word", ["table", "table"]), row("a", "wrong_word"), row("a", "pass"), row("b", "pass"), row("b", "pass"), (None, "", "human_edit", None, None)]
    got = {r.feature: r.weight for r in history.feature_weights(log(spark, rows)).collect()}
    base = 3 / 6
    assert got == {"source:scanned": pytest.approx(max(0.5, (2 / 5) / base)), "model:a": pytest.approx((2 / 3) / base), "model:b": 1.0, "flag:table": 1.0, "conf:<0.7": pytest.approx((2 / 5) / base)}
    assert history.feature_weights(log(spark, [])).count() == 0
    p = spark.createDataFrame([(1, "scanned", "a", ["table"], 0.5, 0.4), (2, None, None, None, None, None)], "rec_id bigint, source_type string, model_used string, flags array<string>, confidence double, q double")
    risk = {r.rec_id: r.risk for r in history.risk(p, history.feature_weights(log(spark, rows)), F.col("q")).collect()}
    assert risk == {1: pytest.approx(0.6 * 0.8 * (4 / 3) * 0.8), 2: 1.0}
    assert history.without_human(log(spark, rows), spark.createDataFrame([("b",), ("b",), (None,)], "book string")).count() == 5


PAGE = """# سر
متن **پررنگ** و [^۱] و [^۲]
پاراگراف دوم
## زیرسر
> نقل یک
>
> نقل دو

- الف
- ب
۱. یک
۲. دو

| ا | ب |
| --- | :-: |
| ۱ | ۲ [^۱] |
```verse
مصرع یک --- مصرع دو

تنها
```
#### چهار
[^۱]: پانوشت *یکم*
[^۱]: پانوشت یکم
```verse
باز"""


def test_blocks(spark):
    df = spark.createDataFrame([(1, PAGE), (2, ""), (3, "\n \n"), (4, "```verse\n```"), (5, "```"), (6, "> a\n\n> b\n- x\n* y\n1. z")], "rec_id bigint, text_md string")
    got = {}
    for r in markdown.blocks(df).orderBy("rec_id", "block").collect():
        got.setdefault(r.rec_id, []).append((r.kind, list(r["items"])))
    assert got[1] == [
        ("h1", ["سر"]), ("p", ["متن **پررنگ** و [^۱] و [^۲]"]), ("p", ["پاراگراف دوم"]), ("h2", ["زیرسر"]), ("quote", ["نقل یک", "نقل دو"]), ("ul", ["الف", "ب"]), ("ol", ["یک", "دو"]),
        ("table", ["| ا | ب |", "| ۱ | ۲ [^۱] |"]), ("verse", ["مصرع یک --- مصرع دو", "", "تنها"]), ("p", ["#### چهار"]), ("verse", ["باز"]),
    ]
    assert got[4] == [("verse", [])] and got[5] == [("p", ["```"])] and 2 not in got and 3 not in got
    assert got[6] == [("quote", ["a"]), ("quote", ["b"]), ("ul", ["x", "y"]), ("ol", ["z"])]
    assert [tuple(r) for r in markdown.notes(df).collect()] == [(1, "۱", "پانوشت یکم")]
    inside = {r.line for r in markdown.parity_verse(df.where("rec_id = 1")).where("inside").collect()}
    assert inside == {17, 18, 19, 25}


def book(spark):
    rows = [(1, 1, False, True, "# فصل\nآغاز [^a]\n[^a]: یکم"), (2, 2, True, True, "میانه"), (3, 3, True, True, "[^a]: تنها"), (4, 4, True, False, "پایان [^a]\nدیگر"), (5, 5, True, False, "نو"), (6, 7, True, True, "# دو\nا"), (7, 8, True, False, "- ب")]
    return spark.createDataFrame([(r, "b", p, s, c, t) for r, p, s, c, t in rows], "rec_id bigint, book string, page int, starts_mid_paragraph boolean, continues_next boolean, text_md string")


def test_stitch_chapters_notes(spark):
    df = book(spark)
    st = {(r.rec_id, r.block): (r.para, r.joined) for r in markdown.stitched(df).collect()}
    # page 2 joins page 1; page 3 has no blocks, so page 4 joins the last block before it
    assert st[2, 0] == ("1.1", True) and st[4, 0] == ("1.1", True) and st[4, 1] == ("4.1", False) and st[5, 0] == ("5.0", False) and st[7, 0] == ("7.0", False)
    b = markdown.chapters_by_heading(markdown.stitched(df))
    assert {(r.rec_id, r.chapter) for r in b.collect()} == {(1, 1), (2, 1), (4, 1), (5, 1), (6, 2), (7, 2)}
    refs = markdown.references(b, markdown.notes(df.select("rec_id", "text_md")))
    assert [(r.rec_id, r.number, r.definition) for r in refs.orderBy("number").collect()] == [(1, 1, "یکم"), (4, 2, "")]
    body = {r.chapter: r.body for r in markdown.chapter_bodies(markdown.xhtml(b, refs), refs).collect()}
    assert body[1].startswith("<h1>فصل</h1><p>آغاز <a id=\"fnref-c1-1\" href=\"#fn-c1-1\"") and " میانه پایان <a id=\"fnref-c1-2\"" in body[1] and "</p><p>دیگر</p><p>نو</p>" in body[1]
    assert body[1].endswith('<li id="fn-c1-2"> <a href="#fnref-c1-2" class="fnback" epub:type="backlink">↩</a></li></ol></section>') and body[2] == "<h1>دو</h1><p>ا</p><ul><li>ب</li></ul>"


def test_xhtml_of_blocks(spark):
    df = spark.createDataFrame([(1, "b", 1, False, False, PAGE)], "rec_id bigint, book string, page int, starts_mid_paragraph boolean, continues_next boolean, text_md string")
    b = markdown.chapters_by_heading(markdown.stitched(df))
    refs = markdown.references(b, markdown.notes(df.select("rec_id", "text_md")))
    html = [r.html for r in markdown.xhtml(b, refs).orderBy("block").collect()]
    assert html[1].startswith("متن <strong>پررنگ</strong> و <a id=\"fnref-c1-1\"") and html[4] == "<blockquote><p>نقل یک</p><p>نقل دو</p></blockquote>"
    assert html[7].startswith("<table><thead><tr><th>ا</th><th>ب</th></tr></thead><tbody><tr><td>۱</td><td>۲ <a id=\"fnref-c1-3\"") and html[7].endswith("</td></tr></tbody></table>")
    assert html[8] == '<div class="verse"><p class="v"><span class="m1">مصرع یک</span><span class="m2">مصرع دو</span></p><p class="v"><span class="m-full">تنها</span></p></div>'


def test_chapters_by_page(spark):
    p = spark.createDataFrame([("b", n) for n in (1, 3, 5, 9)], "book string, page int")
    c = spark.createDataFrame([("b", 0, "x", 3), ("b", 1, None, 5), ("b", 2, "z", 5)], "book string, idx int, title string, start_page int")
    assert {(r.page, r.idx) for r in markdown.chapters_by_page(p, c).collect()} == {(1, None), (3, 0), (5, 2), (9, 2)}


def test_top_word(spark):
    df = spark.createDataFrame([("b a b a c",), ("",), (None,)], "t string")
    got = [r.v for r in df.select(validators.top_word(F.col("t")).alias("v")).collect()]
    assert (got[0].w, got[0].n) == ("b", 2)
    assert Counter("b a b a c".split()).most_common(1)[0] == ("b", 2)


def test_heading_candidates(spark):
    from bargspark.operators import headings

    rows = [(1, 0, 0, "عنوان ", 14.0, 0), (1, 0, 1, " ", 30.0, 0), (1, 1, 0, "متن بدنه که بلند است", 11.04, 0), (1, 2, 0, "پررنگ", 11.0, 16), (1, 2, 1, " هم", 11.0, 20), (1, 3, 0, "نیمه", 11.0, 16), (1, 3, 1, "پررنگ", 11.0, 0), (1, 4, 0, "۱۲.", 20.0, 0), (1, 5, 0, "ا", 20.0, 0), (1, 6, 0, "ب" * 61, 20.0, 0), (2, 0, 0, None, None, None)]
    df = spark.createDataFrame(rows, "rec_id bigint, line int, span int, text string, size double, flags int")
    body = df.union(spark.createDataFrame([(1, 9, 0, "بدنه " * 40, 11.0, 0)], df.schema))
    assert {tuple(r) for r in headings.candidates(body).collect()} == {(1, 0, "عنوان"), (1, 2, "پررنگ هم")}
    assert headings.candidates(df.limit(0)).count() == 0


def test_build(spark, tmp_path):
    import zipfile

    from bargspark.plans import build

    books = spark.createDataFrame([("b", "کتاب", None)], "book string, title_fa string, author_fa string")
    out = str(tmp_path / "out")
    said = build.build(book(spark), books, out).collect()
    assert [(r.book, r.chapters) for r in said] == [("b", 2)] and said[0].parts > 2
    z = zipfile.ZipFile(out + "/b.epub")
    assert [n for n in z.namelist() if "chap" in n] == ["OEBPS/chap_001.xhtml", "OEBPS/chap_002.xhtml"]
    assert "<dc:title>کتاب</dc:title><dc:creator>Unknown</dc:creator>" in z.read("OEBPS/content.opf").decode()
    listed = spark.createDataFrame([("b", 0, "یکم", 2), ("b", 1, None, 7)], "book string, idx int, title string, start_page int")
    got = {}
    for r in build.chapters(book(spark), books, listed).orderBy("chapter", "page", "block").collect():
        got[r.chapter] = (r.chapter_title, got.get(r.chapter, ("", ""))[1] + r.body)
    # the paragraph of pages 1 to 4 begins on page 1, before the first chapter
    assert set(got) == {0, 1, 2} and got[0][0] == "فصل" and "میانه" in got[0][1] and got[1][0] == "یکم" and got[2][0] == "دو"
