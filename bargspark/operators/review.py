"""Findings and their review as table updates: what a verifier's report changes in a page, what a reviewer's submission means, and the events both leave in the log.

A page's state is a row (…, text_md, verdict, issues, suggested_text_md, status,
needs_review, reviewed, skipped). Submissions, pieces and decisions are tables of
their own, so each rule is a CASE over a row and its counts of pieces.

Defined results: a null text is an empty one, a null verdict is no verdict, an
issue without a type takes the page's first type, a piece without a decision is
undecided, of several decisions on one piece the last by `n` counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bargspark.functions import measures as M
from bargspark.functions import text as X

from . import history

# The number findings' pieces are counted from, and the states of a suggestion that are resolved.
FINDING_BASE = 100_000
RESOLVED = ("accepted", "edited", "rejected")
HUMAN = "human_edit"


def _or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def pending() -> Column:
    """Whether a page waits with a suggestion."""
    return _or_false((F.col("verdict") == "fail") & F.col("suggested_text_md").isNotNull() & (F.col("status") == "pending"))


def first_type(issues: Column) -> Column:
    """The type of the first issue; without issues that of a reader's own change."""
    return F.when(F.coalesce(F.size(issues), F.lit(0)) > 0, F.get(issues, F.lit(0))["type"]).otherwise(F.lit(HUMAN))


def panel_kind() -> Column:
    """What is shown beside a page: null where nothing waits, else no_suggestion, identical or hunks."""
    suggested = F.col("suggested_text_md")
    kind = F.when(suggested.isNull(), "no_suggestion").when(suggested == F.coalesce("text_md", F.lit("")), "identical").otherwise("hunks")
    return F.when(_or_false((F.col("verdict") == "fail") & (F.col("status") == "pending")), kind)


def checked(states: DataFrame, reports: DataFrame, *key: str) -> DataFrame:
    """States with a report's result in place of the one before: a failed page waits with its suggestion and needs review, any other has neither. Pages without a report stay."""
    fail = F.col("n_verdict") == "fail"
    issue = lambda i: F.struct(i["type"].alias("type"), i["description"].alias("description"), i["snippet"].alias("snippet"), M.clean_bbox(i["bbox"]).alias("bbox"))
    new = reports.select(*key, F.col("verdict").alias("n_verdict"), F.transform("issues", issue).alias("n_issues"), F.col("suggested_text_md").alias("n_text"), F.lit(True).alias("n_has"))
    put = {
        "verdict": F.when(F.col("n_has"), F.col("n_verdict")).otherwise(F.col("verdict")),
        "issues": F.when(F.col("n_has"), F.col("n_issues")).otherwise(F.col("issues")),
        "suggested_text_md": F.when(F.col("n_has"), F.when(fail, F.col("n_text"))).otherwise(F.col("suggested_text_md")),
        "status": F.when(F.col("n_has"), F.when(fail, "pending")).otherwise(F.col("status")),
        "needs_review": F.when(_or_false(fail), True).otherwise(F.col("needs_review")),
    }
    return states.join(new, list(key), "left").withColumns(put).drop("n_verdict", "n_issues", "n_text", "n_has")


def report_events(reports: DataFrame) -> DataFrame:
    """Of reports with their page's book, page, source_type, model_used, flags and confidence: the events a verifier leaves, one per issue of a failed page, else one that it passed; pos counts the issues."""
    failed = (F.col("verdict") == "fail") & (F.coalesce(F.size("issues"), F.lit(0)) > 0)
    types = F.when(failed, F.transform("issues", lambda i: i["type"])).otherwise(F.array(F.lit("pass")))
    e = reports.select("*", F.posexplode(types).alias("pos", "issue_type"))
    return with_features(e.withColumn("detected_by", F.lit("auto_qc")), F.array_compact(F.array(history.signal(F.col("issue_type")))))


def with_features(events: DataFrame, signals: Column) -> DataFrame:
    """Adds what the log keeps of a page beside its event: flags, the bucket of its confidence and the signals."""
    return events.withColumn("features", F.struct(F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), M.bucket(F.col("confidence")).alias("confidence_bucket"), signals.cast("array<string>").alias("char_signals")))


def last_decisions(decisions: DataFrame, key: str, order: str = "n") -> DataFrame:
    """Of (key, id, decision, text, n): the last decision on each piece."""
    return decisions.groupBy(key, "id").agg(F.max_by(F.struct("decision", "text"), order).alias("d")).select(key, "id", "d.*")


def decided_pieces(states: DataFrame, pieces: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Of pieces (key, id, issue_idx, old, new, finding): adds decision, own (the reader's text) and issue_type."""
    types = states.select(key, F.transform("issues", lambda i: i["type"]).alias("types"), first_type(F.col("issues")).alias("first"))
    rows = pieces.join(decisions.select(key, "id", "decision", F.col("text").alias("own")), [key, "id"], "left").join(types, key)
    named = F.when((F.col("issue_idx") >= 0) & (F.col("issue_idx") < F.size("types")), F.nullif(F.get("types", F.col("issue_idx")), F.lit("")))
    return rows.withColumn("issue_type", F.coalesce(named, "first")).withColumn("decision", F.coalesce("decision", F.lit("pending"))).drop("types", "first")


def outcomes(states: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """Of states with new_text and `decided` (whether decisions were sent) and of decided pieces: adds reviewed, new_status (null leaves the state) and mode, the rule that applied.

    none: nothing waited. findings: issues without a suggestion. taken: the suggestion as it is. pieces: decided piece by piece. whole: neither."""
    fix, is_ = ~F.col("finding"), lambda d: F.col("decision") == d
    count = pieces.groupBy(key).agg(F.count_if(fix).alias("n_fix"), F.count_if(fix & is_("approved")).alias("n_approved"), F.count_if(fix & is_("edited")).alias("n_edited"), F.count_if(~fix & is_("edited")).alias("n_own"))
    df = states.join(count, key, "left").fillna(0, ["n_fix", "n_approved", "n_edited", "n_own"])
    text = F.coalesce("text_md", F.lit(""))
    changed = F.col("new_text") != text
    dangling = _or_false((F.col("status") == "pending") & F.col("suggested_text_md").isNull())
    mode = F.when(~pending(), F.when(dangling, "findings").otherwise("none")).when(F.col("new_text") == F.col("suggested_text_md"), "taken").when(_or_false(F.col("decided")), "pieces").otherwise("whole")
    status = (
        F.when(F.col("mode") == "findings", F.when((F.col("n_own") > 0) | changed, "edited").otherwise("rejected"))
        .when(F.col("mode") == "taken", "accepted")
        .when(F.col("mode") == "whole", F.when(changed, "edited").otherwise("rejected"))
        .when(F.col("mode") == "pieces", F.when((F.col("n_fix") > 0) & (F.col("n_approved") == F.col("n_fix")) & (F.col("n_own") == 0), "accepted").when(F.col("n_approved") + F.col("n_edited") + F.col("n_own") == 0, "rejected").otherwise("edited"))
    )
    return df.withColumn("mode", mode).withColumn("reviewed", F.when(changed, "edited").otherwise("accepted")).withColumn("new_status", status)


def outcome_events(out: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """(key, id, detected_by, issue_type, old, decided): the events of outcomes; id is null for one on the page as a whole."""
    text = F.coalesce("text_md", F.lit(""))
    changed = F.col("reviewed") == "edited"
    mode = F.col("mode")
    who = (
        F.when(mode == "taken", "suggestion_accepted").when(mode == "whole", F.when(changed, "suggestion_edited").otherwise("suggestion_rejected"))
        .when(changed & ((mode == "none") | (mode == "findings") & (F.col("n_own") == 0)), HUMAN)
    )
    decided = F.when(F.col("detected_by") == "suggestion_rejected", F.col("suggested_text_md")).otherwise(F.col("new_text"))
    whole = out.withColumn("detected_by", who).where("detected_by IS NOT NULL").select(key, F.lit(None).cast("int").alias("id"), "detected_by", first_type(F.col("issues")).alias("issue_type"), text.alias("old"), decided.alias("decided"))
    rows = pieces.join(out.select(key, "mode"), key).where("mode = 'pieces' OR (mode = 'findings' AND finding)").where("NOT finding OR decision = 'edited'")
    by = F.when(F.col("finding"), HUMAN).when(F.col("decision") == "approved", "suggestion_accepted").when(F.col("decision") == "edited", "suggestion_edited").otherwise("suggestion_rejected")
    became = F.when(F.col("decision") == "approved", F.col("new")).when(F.col("decision") == "edited", F.coalesce("own", F.when(F.col("finding"), F.col("old")).otherwise(F.col("new")))).otherwise(F.col("old"))
    return whole.unionByName(rows.select(key, F.col("id").cast("int").alias("id"), by.alias("detected_by"), "issue_type", "old", became.alias("decided")))


def accepted(states: DataFrame, out: DataFrame, key: str) -> DataFrame:
    """States after submissions: the new text, the first text before it kept, no review needed any more. Pages without one stay."""
    new = out.select(key, F.col("new_text").alias("_t"), F.col("reviewed").alias("_r"), F.col("new_status").alias("_s"), F.lit(True).alias("_has"))
    old = F.coalesce("text_md", F.lit(""))
    put = {
        "orig_text_md": F.when(_or_false(F.col("_t") != old), F.coalesce("orig_text_md", old)).otherwise(F.col("orig_text_md")),
        "text_md": F.when(F.col("_has"), F.col("_t")).otherwise(F.col("text_md")),
        "needs_review": F.when(F.col("_has"), False).otherwise(F.col("needs_review")),
        "reviewed": F.when(F.col("_has"), F.col("_r")).otherwise(F.col("reviewed")),
        "status": F.coalesce("_s", "status"),
    }
    return states.join(new, key, "left").withColumns(put).drop("_t", "_r", "_s", "_has")


def reset(states: DataFrame) -> DataFrame:
    """States with reviews undone: pages reviewed or skipped need review again, resolved suggestions wait again; texts stay."""
    touched = F.col("reviewed").isNotNull() | _or_false(F.col("skipped"))
    back = touched & _or_false(F.col("status").isin(*RESOLVED))
    return states.withColumn("_t", touched).withColumns(
        {
            "status": F.when(back, "pending").otherwise(F.col("status")),
            "needs_review": F.when(F.col("_t"), True).otherwise(F.col("needs_review")),
            "reviewed": F.when(~F.col("_t"), F.col("reviewed")),
            "skipped": F.when(~F.col("_t"), F.col("skipped")),
        }
    ).drop("_t")


def finding_pieces(states: DataFrame, key: str, linked: Column | None = None) -> DataFrame:
    """(key, id, issue_idx, old, new, finding): a piece for each issue with a snippet that no fix is linked to (`linked` is an array of indices)."""
    rows = states.select(key, *([linked.alias("linked")] if linked is not None else []), F.posexplode("issues").alias("issue_idx", "i")).withColumn("old", X.strip(F.col("i.snippet"))).where("old <> ''")
    if linked is not None:
        rows = rows.where(~_or_false(F.array_contains("linked", F.col("issue_idx"))))
    return rows.select(key, (F.col("issue_idx") + FINDING_BASE).alias("id"), "issue_idx", "old", F.col("old").alias("new"), F.lit(True).alias("finding"))


def totals(out: DataFrame, pieces: DataFrame, by: str, key: str) -> DataFrame:
    """(by, edited, accepted, approved_pieces, edited_pieces, rejected_pieces, open_pieces): what a round of reviews came to."""
    per = pieces.groupBy(key).agg(*(F.count_if(F.col("decision") == d).alias(n) for d, n in (("approved", "approved_pieces"), ("edited", "edited_pieces"), ("rejected", "rejected_pieces"), ("pending", "open_pieces"))))
    names = ["approved_pieces", "edited_pieces", "rejected_pieces", "open_pieces"]
    return out.select(by, key, "reviewed").join(per, key, "left").groupBy(by).agg(F.count_if(F.col("reviewed") == "edited").alias("edited"), F.count_if(F.col("reviewed") == "accepted").alias("accepted"), *(F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names))


def usage(attempts: DataFrame, by: list[str], *counts: str) -> DataFrame:
    """The counts of all attempts added up per key; a missing count is 0."""
    return attempts.groupBy(*by).agg(F.count("*").alias("attempts"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counts))


def counters(pages: DataFrame, by: str, escalate: Column, flagged: Column) -> DataFrame:
    """(by, ok, escalated, flagged): pages done, asked again with the stronger model, and marked for review."""
    return pages.groupBy(by).agg(F.count("*").alias("ok"), F.count_if(escalate).alias("escalated"), F.count_if(flagged).alias("flagged"))
