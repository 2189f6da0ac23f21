"""Places of snippets against brute force over the fixture's pages."""

import pytest

from bargspark.operators import layout, matching
from bargspark.plans import catalog

ISSUE = "array<struct<snippet string>>"
PAGES = {
    1: "سطر نخست این صفحه کوتاه است\nپرنده بر شاخه درخت کنار رودخانه نشست\nپایان صفحه با سخنی دیگر است",
    2: "باران بر بام خانه بارید\nکتاب کهنه روی میز بود\nباران بر بام خانه بارید\nچراغ خاموش شد و رفت",
    3: None,
}
#: exact, by likeness (one letter differs), nowhere, null, empty
SNIPPETS = {1: ["درخت کنار", "پرنده بر شاخه درخب کنار", "zzzz qqqq vvvv", None, ""], 2: ["کتاب کهنه", "چراغ خاموس شد"], 3: ["کتاب"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("places"))
    save(spark, d, PAGES, SNIPPETS)
    return d


def save(spark, d, pages, snippets):
    spark.createDataFrame([(k, "b", k, 1, t) for k, t in pages.items()], "rec_id bigint, book string, page int, attempt int, text_md string").write.mode("overwrite").parquet(f"{d}/page_text.parquet")
    spark.createDataFrame([(k, k, "flagged", [(s,) for s in v], None) for k, v in snippets.items()], f"report_id bigint, rec_id bigint, verdict string, issues {ISSUE}, suggested_text_md string").write.mode("overwrite").parquet(f"{d}/qc_reports.parquet")


def brute(nearest):
    """{(rec_id, qid): lines} by counting characters: these pages have no Markdown, and each line's share is that of its letters."""
    count, out = lambda s: sum(not c.isspace() for c in s), {}
    for rec, snippets in SNIPPETS.items():
        for i, snippet in enumerate(snippets):
            span = matching.find_span(PAGES[rec], snippet)
            if not span:
                continue
            a = count(PAGES[rec][: span[0]])
            b, at, over = a + count(PAGES[rec][span[0] : span[1]]), 0, []
            for n, line in enumerate(PAGES[rec].split("\n")):
                over += [(min(b, at + count(line)) - max(a, at), n)] * (at + count(line) > a and at < b)
                at += count(line)
            if not nearest and b - a <= layout.SHORT:
                over = [max(over, key=lambda x: (x[0], -x[1]))]
            out[rec, rec * 100 + i] = {n for _, n in over}
    return out


def lines_of(df):
    got = {}
    for r in df.collect():
        got.setdefault((r.rec_id, r.qid), set()).add(r.line)
    return got


def test_hits_of_snippets_found_by_likeness(spark, folder):
    assert {(1, 101), (2, 201)} <= set(brute(True))
    assert lines_of(catalog.layout_hits_all(spark, folder)) == brute(True)
    assert lines_of(catalog.scan_hits_all(spark, folder)) == brute(False)
    boxes = {(r.rec_id, r.qid): r for r in catalog.layout_boxes_all(spark, folder).collect()}
    assert set(boxes) == set(brute(True))
    for k, lines in brute(True).items():
        assert boxes[k].y0 == pytest.approx((20 + 14 * min(lines)) / 3000, abs=1e-6) and boxes[k].y1 == pytest.approx((32 + 14 * max(lines)) / 3000, abs=1e-6)


def test_a_snippet_found_by_likeness_has_a_second_tier(spark, folder, monkeypatch):
    monkeypatch.setattr(matching, "located", lambda p: p.selectExpr("rec_id", "rec_id AS qid", "width AS x0", "width AS y0", "width AS x1", "width AS y1").where("false"))
    got = {(r.rec_id, r.qid): r.source for r in catalog.located(spark, folder).collect()}
    assert got == dict.fromkeys(brute(True), "layout")


def test_of_equal_windows_the_one_at_the_layouts_height(spark, tmp_path):
    page = "باران بر بام خانه بارید\nکتاب کهنه روی میز بود\nچراغ خاموش شد\nباران بر بام خانه بارید و رفت"
    save(spark, str(tmp_path), {1: page}, {1: ["بر بام خانه بارید و"]})
    (r,) = catalog.matched_boxes(spark, str(tmp_path)).collect()
    assert r.y0 == pytest.approx((20 + 14 * 3) / 3000)
    # two equal runs of words: the snippet's own place is the second, which its end tells
    save(spark, str(tmp_path), {1: "باران «بر بام\nکتاب کهنه روی میز\nباران بر بام"}, {1: ["باران بر بام"]})
    (r,) = catalog.matched_boxes(spark, str(tmp_path)).collect()
    assert r.y0 == pytest.approx((20 + 14 * 2) / 3000)


def test_pages_that_the_first_tiers_refuse_get_a_box_by_scan(spark, tmp_path):
    # few words of the script, and more than twice the letters in print that Markdown counts
    page = "\n".join(["**" * 12 + " alpha beta gamma"] * 3 + ["**" * 20 + " delta"])
    save(spark, str(tmp_path), {1: page}, {1: ["delta", "nowhere to be found at all"]})
    (r,) = catalog.located(spark, str(tmp_path)).collect()
    assert (r.qid, r.source) == (100, "scan")
    assert r.y0 == pytest.approx((20 + 14 * 3) / 3000, abs=2e-3) and r.y1 == pytest.approx((32 + 14 * 3) / 3000, abs=2e-3)
    assert {x.source: x.n for x in catalog.tier_counts(spark, str(tmp_path)).collect()} == {"scan": 1, None: 1}


def test_scan_extents_against_the_kernel(spark):
    import random

    rng, box = random.Random(5), "struct<x0: double, y0: double, x1: double, y1: double>"
    hits, lines = [], []
    for n in range(60):
        cuts = sorted(rng.sample(range(10, 1000), 2 * rng.choice([0, 1, 2, 5])))
        words = [(float(a), 5.0, float(b), 9.0) for a, b in zip(cuts[::2], cuts[1::2])][::-1]
        lines.append((1, n, 10.0, 4.0, 1000.0, 10.0, words))
        a = rng.random()
        hits.append((1, n, n, a, min(1.0, a + rng.choice([0.0, 0.02, 0.4]))))
    h = spark.createDataFrame(hits, "rec_id bigint, qid bigint, line int, u0 double, u1 double")
    seen = spark.createDataFrame(lines, f"rec_id bigint, line int, x0 double, y0 double, x1 double, y1 double, words array<{box}>")
    got = {r.line: (r.x0, r.y0, r.x1, r.y1) for r in layout.scan_extents(h, seen).collect()}
    for (_, n, _, a, b), (*_, words) in zip(hits, lines):
        assert got[n] == pytest.approx(matching.line_part({"rect": (10.0, 4.0, 1000.0, 10.0), "words": words}, a, b)), n


def test_headings_of_all_levels_with_their_markup(spark, tmp_path):
    import html
    import re

    pages = {1: "# بخش نخست\nمتن ساده\n## فصل **مهم** یک\n### بند *کج* و a & b <c>\nمتن # نه", 2: "### سه\n#### چهار نیست\n# سر با یادداشت[^1]\n[^1]: یادداشت"}
    save(spark, str(tmp_path), pages, {1: []})
    spark.createDataFrame([(k, False, [], [], False, False, 0.9, "m", "r") for k in pages], "rec_id bigint, is_blank boolean, headings array<string>, flags array<string>, starts_mid_paragraph boolean, continues_next boolean, confidence double, model_used string, resolution string").write.parquet(f"{tmp_path}/page_fields.parquet")
    want = []
    for k, text in pages.items():
        for line in text.split("\n"):
            if m := re.match(r"(#{1,3}) (.*)", line):
                t = re.sub(r"\*(.+?)\*", r"<em>\1</em>", re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", html.escape(m[2], False)))
                want.append((k, str(len(m[1])), t.split("[^")[0]))
    got = [(r.rec_id, r.level, r.heading) for r in catalog.html_headings(spark, str(tmp_path)).orderBy("rec_id", "block").collect()]
    assert [(k, n, re.sub("<a .*", "", t)) for k, n, t in got] == want
    assert "fnref" in got[-1][2] and got[-1][2].endswith("</a>")
