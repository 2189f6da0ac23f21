import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bargspark.operators import diffing as D
from bargspark.operators import layout, scans
from bargspark.operators import matching as A

WORDS = st.lists(st.sampled_from(["آب", "نان", "خانه‌ها", "رفت.", "\n", "a", "#"]), max_size=30).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_hunks_rebuild_the_new_text(old, new):
    parts = D.hunks(old, new)
    assert D.apply_hunks(old, parts) == new
    rng = random.Random(len(old))
    for _ in range(2):  # in any order
        text, order = old, list(parts)
        rng.shuffle(order)
        if all(h["is_unique"] for h in parts):
            for h in order:
                text = D.apply_hunks(text, [h]) if h["is_unique"] else text
    assert all(h["ctx_before"] + h["old"] + h["ctx_after"] in old for h in parts)


def test_hunk_fields():
    old = " ".join(f"w{i}" for i in range(60))
    parts = D.hunks(old, old.replace("w5 ", "x5 ").replace("w50 ", "x50  "))
    assert [(h["old"], h["new"]) for h in parts] == [("w5 ", "x5 "), ("w50 ", "x50  ")]
    assert parts[0]["ctx_before"] == "w2 w3 w4 " and parts[0]["is_unique"] and parts[0]["show_before"].startswith("w0") and parts[0]["show_after"].endswith(" …")
    assert D.hunks("a b", "a b") == [] and D.hunks(None, "a")[0]["new"] == "a"
    assert D.hunks("a  b", "a b")[0]["ws_only"]
    assert D.apply_hunks(old, parts, {1: "own "}) == old.replace("w50 ", "own ")


@pytest.mark.parametrize(
    "old,new,want",
    [("a", "a", []), ("# x", "## x", ["heading"]), ("| a |", "| b |", ["table"]), ("```verse\na\n```", "```verse\nb\n```", ["verse"]), ("می‌رود", "میرود", ["zwnj"]), ("خانهها", "خانه ها", ["heh_boundary"]), ("۱", "۲", ["digits"]), ("آب", "آب،", ["punctuation"]), ("آب", "آب[^1]", ["digits", "footnote"]), (None, "x", [])],
)
def test_signals(old, new, want):
    assert D.signals(old, new) == want


def test_signals_table(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "۱", "۲"), (3, None, None), (4, None, "۱")], "id int, o string, n string")
    assert {r.id: list(r.signals) for r in D.with_signals(df, "o", "n").collect()} == {1: [], 2: ["digits"], 3: [], 4: ["digits"]}


def test_links_and_findings(spark):
    df = spark.createDataFrame([(1, "یک دو سه چهار", [("a", "پنج شش هفت"), ("b", "دو سه"), ("c", "دو سه"), ("d", None)])], "id int, text_md string, issues array<struct<type: string, snippet: string>>")
    linked = df.select(D.link(F.col("issues"), F.lit("دو"), F.lit("دوم"), F.lit("یک "), F.lit(" سه")).alias("v"), D.link(F.col("issues"), F.lit("x"), F.lit("y"), F.lit(""), F.lit("")).alias("w")).first()
    assert linked.v == 1 and linked.w is None
    got = D.findings(df.withColumn("linked", F.array(F.lit(1)))).orderBy("id").collect()
    assert [(r.id, r.issue_idx, r.is_unique) for r in got] == [(100_000, 0, False), (100_002, 2, True)]


def test_fold_and_match():
    assert A.fold("ﺧﻮﺍﻫﺮﺑﺮﺍﺩﺭ") == "خواهربرادر"
    parts = [((238, 246), "خ"), ((196, 236), "واهربرادر"), ((168, 194), "یریش"), ((162, 166), "ب"), ((151, 160), "ود"), ((146, 151), "ی"), ((141, 146), "م"), ((136, 141), "،")]
    words = [((x0, 82.0, x1, 102.0), f) for (x0, x1), w in parts if (f := A.fold(w))]
    box = A.match({"y0": 0.0, "height": 595.0}, words, "خواهربرادر شیری بودیم")
    assert (box[0], box[2]) == (141, 246)
    assert A.match({"y0": 0.0, "height": 595.0}, words, "چیز دیگری نیست") is None and A.match({"y0": 0.0, "height": 1.0}, [], "x") is None


def test_spans():
    text = "این یک متن بلند است که در آن جمله‌ای گم شده و باید پیدا شود"
    assert A.find_span(text, "متن بلند") == (7, 15)
    a, b = A.find_span(text, "جمله ای گم شد و باید")
    assert abs(a - text.index("جمله")) <= 2
    assert A.find_span(text, "qqqqqqqqqq") is None and A.find_span(text, "") is None and A.find_span(None, "x") is None


def line(y, n):
    words = [(450.0 - 60 * i, y, 500.0 - 60 * i, y + 20.0) for i in range(n)]
    return {"rect": A.union(words), "words": words}


LINES = [line(100.0, 5), line(130.0, 6), line(160.0, 5)]
READ = ["کتاب خانه درخت باران نامه", "چراغ دیوار پنجره ستاره کوه دریا", "آسمان پرنده رودخانه ماه خورشید"]


def test_align():
    assert A.align(["پنجره ستاره"], READ, LINES) == [A.union(LINES[1]["words"][2:4])]
    assert A.align(["کتاب"], READ, LINES) == [LINES[0]["words"][0]]
    assert A.align(["دریا آسمان"], READ, LINES) == [LINES[1]["words"][5], LINES[2]["words"][0]]
    assert A.align(["هرگز چنین نبود", "پنجره ستاره"], READ, LINES) == [A.union(LINES[1]["words"][2:4])]
    assert A.align(["هرگز چنین نبود"], READ, LINES) is None and A.align(["x"], [], LINES) is None
    fewer = A.align(["پنجره ستاره"], [" ".join(READ)], LINES)
    assert fewer is not None and all(r[1] >= 100 for r in fewer)
    twice = ["کتاب خانه", "کتاب خانه"]
    assert A.align(["کتاب"], twice, [line(100.0, 2), line(130.0, 2)], (470.0, 140.0))[0][1] == 130.0


def drawn():
    page = np.full((900, 700), 230, np.uint8)
    boxes = []
    for k, y in enumerate((100, 150, 200)):
        for i in range(5):
            x = 600 - 110 * i
            page[y : y + 20, x - 80 : x] = 30
            boxes.append((x - 80, y))
    page[870:880, 340:360] = 30  # a page number
    page[500:502, 50:650] = 30  # a rule
    return page


def test_scan(spark):
    found = scans.page_lines(drawn(), 1.0)
    assert [(r["rect"][1], r["rect"][3], len(r["words"])) for r in found] == [(100, 120, 5), (150, 170, 5), (200, 220, 5)]
    assert found[0]["words"][0] == (520, 100, 600, 120) and found[0]["weight"] == pytest.approx(520 / 20)
    assert scans.page_lines(np.full((50, 50), 255, np.uint8)) == []
    df = spark.createDataFrame([(1, 900, 700, bytearray(drawn().tobytes())), (2, 5, 5, None), (3, 5, 5, bytearray(b"x"))], "rec_id bigint, height int, width int, grey binary")
    assert {(r.rec_id, r.line) for r in scans.scan_lines(df, 1.0).collect()} == {(1, 0), (1, 1), (1, 2)}
    assert scans.spans(np.array([1, 0, 1, 0, 0, 1], bool), 1).tolist() == [[0, 3], [5, 6]]
    assert scans.strip_rect(found, 0, 1, (700.0, 900.0)) == (66.0, 95.0, 614.0, 175.0)


def test_layout(spark):
    lines = spark.createDataFrame([(1, i, 10, 20.0 + 14 * i, 32.0 + 14 * i, 0.0, 100.0) for i in range(3)], "rec_id bigint, line int, n int, y0 double, y1 double, x0 double, x1 double")
    q = spark.createDataFrame([(1, 1, "ا" * 30, 0, 5), (1, 2, "ا" * 30, 8, 14), (1, 3, "ا" * 30, 30, 30), (1, 4, "ا" * 500, 0, 5), (1, 5, "x", None, None)], "rec_id bigint, qid bigint, text_md string, s int, e int")
    hits = layout.hits(layout.shares(q), lines, "n", True).collect()
    assert {(r.qid, r.line) for r in hits} == {(1, 0), (2, 0), (2, 1), (3, 2)}
    one = layout.one_line_if_short(layout.hits(layout.shares(q), lines, "n", False)).collect()
    assert {(r.qid, r.line) for r in one if r.qid < 4} == {(1, 0), (2, 1)}
    words = spark.createDataFrame([(1, 0, w, 5, 90.0 - 50 * w, 20.0, 100.0 - 50 * w, 32.0) for w in range(2)], "rec_id bigint, line int, word int, chars int, x0 double, y0 double, x1 double, y1 double")
    got = layout.word_extents(spark.createDataFrame([(1, 1, 0, 0.0, 0.4), (1, 2, 0, 0.6, 1.0), (1, 3, 0, 1.0, 1.0)], "rec_id bigint, qid bigint, line int, u0 double, u1 double"), words).collect()
    assert {(r.qid, r.x0) for r in got} == {(1, 90.0), (2, 40.0), (3, 40.0)}


def test_refined(spark, tmp_path):
    calls = str(tmp_path / "calls")
    as_row = lambda r: {"rect": dict(zip(("x0", "y0", "x1", "y1"), r["rect"])), "words": [dict(zip(("x0", "y0", "x1", "y1"), w)) for w in r["words"]]}
    lines = [as_row(r) for r in LINES]
    rows = [(1, 1, ["پنجره ستاره"], 1, 1, lines, None, None), (1, 2, ["کتاب خانه"], 1, 1, lines, None, None), (1, 3, ["هرگز چنین نبود"], 0, 0, lines, 1.0, 1.0), (2, 4, ["x"], 0, 0, None, None, None)]
    rect = "struct<x0: double, y0: double, x1: double, y1: double>"
    df = spark.createDataFrame(rows, f"rec_id bigint, qid bigint, variants array<string>, low int, high int, lines array<struct<rect: {rect}, words: array<{rect}>>>, prior_x double, prior_y double").coalesce(1)

    def crop(k, ls, a, b):
        return f"{a}-{b}".encode()

    def read(images):
        with open(calls, "a") as f:
            f.write(" ".join(x.decode() for x in images) + "\n")
        return [READ[int(x.split(b"-")[0]) : int(x.split(b"-")[1]) + 1] for x in images]

    got = {r.qid: r.segments for r in A.refined(df, read, crop).collect()}
    assert len(got[1]) == 1 and got[1][0].y0 == 130.0 and got[2][0].y0 == 100.0 and got[3] is None and got[4] is None
    assert open(calls).read().split() == ["0-1", "0-2", "0-2"]
