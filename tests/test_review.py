from pyspark.sql import functions as F

from bargspark.operators import pages, review

ISSUE = "array<struct<type: string, description: string, snippet: string, bbox: array<int>>>"
STATE = f"k bigint, text_md string, new_text string, verdict string, issues {ISSUE}, suggested_text_md string, status string, needs_review boolean, reviewed string, skipped boolean, orig_text_md string, decided boolean, extra string"
PIECE = "k bigint, id int, issue_idx int, old string, new string, finding boolean"


def issue(kind, snippet="x"):
    return (kind, None, snippet, [1, 2, 3, 4])


ROWS = [
    (1, "a", "a", "pass", [], None, None, True, None, None, None, False, "z"),  # nothing waits, unchanged
    (2, "a", "b", None, None, None, None, True, None, None, None, False, "z"),  # nothing waits, changed
    (3, "a", "s", "fail", [issue("digit_error")], "s", "pending", True, None, None, None, True, "z"),  # taken
    (4, "a", "a", "fail", [issue(None)], "s", "pending", True, None, None, None, False, "z"),  # left
    (5, "a", "c", "fail", [issue("")], "s", "pending", True, None, None, None, None, "z"),  # changed otherwise
    (6, "a", "c", "fail", [issue("t"), issue("", " y ")], "s", "pending", True, None, None, None, True, "z"),  # piece by piece
    (7, "a", "a", "fail", [issue("t")], None, "pending", True, None, None, None, False, "z"),  # findings without a suggestion
    (8, None, "", "fail", [issue("t")], None, "accepted", False, "edited", True, None, False, "z"),
]
PIECES = [(6, 0, 0, "o", "n", False), (6, 100001, 1, "y", "y", True), (7, 100000, 0, "x", "x", True)]
SENT = [(6, 0, "rejected", None, 0), (6, 0, "approved", None, 1), (6, 100001, "edited", "w", 0), (7, 100000, "edited", "q", 0), (99, 0, "approved", None, 0)]


def parts(spark):
    states = spark.createDataFrame(ROWS, STATE)
    sent = review.last_decisions(spark.createDataFrame(SENT, "k bigint, id int, decision string, text string, n int"), "k")
    pieces = review.decided_pieces(states, spark.createDataFrame(PIECES, PIECE), sent, "k")
    return states, pieces, review.outcomes(states, pieces, "k")


def test_outcomes_and_events(spark):
    states, pieces, out = parts(spark)
    got = {r.k: (r.mode, r.reviewed, r.new_status) for r in out.collect()}
    assert got == {
        1: ("none", "accepted", None), 2: ("none", "edited", None), 3: ("taken", "edited", "accepted"), 4: ("whole", "accepted", "rejected"), 5: ("whole", "edited", "edited"),
        6: ("pieces", "edited", "edited"), 7: ("findings", "accepted", "edited"), 8: ("none", "accepted", None),
    }
    events = sorted(tuple(r) for r in review.outcome_events(out, pieces, "k").select("k", F.coalesce("id", F.lit(-1)), "detected_by", F.coalesce("issue_type", F.lit("")), "old", "decided").collect())
    assert events == [
        (2, -1, "human_edit", "human_edit", "a", "b"), (3, -1, "suggestion_accepted", "digit_error", "a", "s"), (4, -1, "suggestion_rejected", "", "a", "s"), (5, -1, "suggestion_edited", "", "a", "c"),
        (6, 0, "suggestion_accepted", "t", "o", "n"), (6, 100001, "human_edit", "t", "y", "w"), (7, 100000, "human_edit", "t", "x", "q"),
    ]
    after = {r.k: r for r in review.accepted(states, out.where("k <> 1"), "k").collect()}
    assert (after[2].text_md, after[2].orig_text_md, after[2].needs_review) == ("b", "a", False) and after[1].needs_review and after[4].status == "rejected" and after[4].orig_text_md is None


def test_reset_and_checked(spark):
    states = spark.createDataFrame(ROWS, STATE)
    back = {r.k: r for r in review.reset(states).collect()}
    assert (back[8].status, back[8].needs_review, back[8].reviewed, back[8].skipped) == ("pending", True, None, None) and back[1].needs_review and back[3].status == "pending"
    reports = spark.createDataFrame([(1, "fail", [issue("t")], "new"), (3, "pass", [], "kept?")], f"k bigint, verdict string, issues {ISSUE}, suggested_text_md string")
    got = {r.k: r for r in review.checked(states, reports, "k").collect()}
    assert (got[1].status, got[1].suggested_text_md) == ("pending", "new") and got[1].issues[0].bbox == [1, 2, 3, 4] and got[3].status is None and got[3].suggested_text_md is None and got[4].status == "pending"


def test_empty(spark):
    states, pieces, out = parts(spark)
    assert review.outcomes(states.limit(0), pieces.limit(0), "k").count() == 0 and review.reset(states.limit(0)).count() == 0
    assert {r.mode for r in review.outcomes(states, pieces.limit(0), "k").where("k = 6").collect()} == {"pieces"}


def test_records_once_by_file_and_row(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (2, None), (None, "x"), (None, "y"), (3, "b")]
    at = str(tmp_path / "t")
    for part in (rows, rows[:2]):
        spark.createDataFrame(part, "k bigint, v string").coalesce(1).write.mode("append").parquet(at)
    got = [tuple(r) for r in pages.once_of(spark.read.parquet(at), "k", "k", "v").collect()]
    assert len(got) == 4 and {k for k, _ in got} == {1, 2, 3, None}
    assert pages.once_of(spark.read.parquet(at).where("k < 0"), "k", "k", "v").count() == 0
