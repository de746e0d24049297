"""Reviews of runs: what is wrong with each, and what is stored of those that are accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts, decisions, resolutions, tracks and their states that a review may hold.
VERDICTS = ("CONFIRM_SYSTEM_DECISION", "OVERRIDE_DECISION", "REQUEST_MORE_EVIDENCE")
DECISIONS = ("PASS", "REVIEW", "FAIL", "ERROR")
RESOLUTIONS = ("CONFIRMED", "FALSE_POSITIVE", "INSUFFICIENT_EVIDENCE")
TRACKS = ("visual", "layout", "content", "full_deck")
TRACK_STATES = ("TRAIN", "REVIEW", "REJECT")
LONGEST_REQUEST_ID = 128


def _clean(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _listed(rules: list[tuple[Column, Column]]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(broken, name) for broken, name in rules]))


def validate_reviews(reviews: DataFrame, resolutions: DataFrame, reports: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for each of `reviews` (review_id, run, reviewer, verdict, target, note, request_id, tracks: map), cleaned
    and with what its run's report says, accepted, and breaches: all that is wrong with it, in order.

    `resolutions` (review_id, nth, issue_id, resolution, note) say what a review makes of single issues, `issues` (run,
    issue_id) which there are, `reports` (run, decision, coverage, report_hash, observation_hash; one for a run) what the
    machine found. A review of a run without a report is a breach, not a lost row; so is an issue named twice. A target is
    kept for an override only. Resolutions of no review are left out; review ids are unique.
    """
    none = F.create_map().cast("map<string,string>")
    tracks = F.transform_values(F.coalesce("tracks", none), lambda _, v: F.upper(F.trim(F.coalesce(v, F.lit("")))))
    own = reviews.select(
        "review_id", "run", _clean("reviewer").alias("reviewer"), F.upper(_clean("verdict")).alias("verdict"), F.upper(_clean("target")).alias("target"),
        _clean("note").alias("note"), _clean("request_id").alias("request_id"), tracks.alias("tracks"),
    )
    known = issues.select("run", "issue_id").distinct().withColumn("known", F.lit(True))
    named = resolutions.select("review_id", "nth", F.coalesce("issue_id", F.lit("")).alias("issue_id"), F.upper(_clean("resolution")).alias("resolution"), _clean("note").alias("own_note"))
    placed = named.join(own.select("review_id", "run", "note"), "review_id").join(known, ["run", "issue_id"], "left")
    each = placed.groupBy("review_id", "issue_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("known").alias("known"), F.bool_and(F.col("resolution").isin(*RESOLUTIONS)).alias("supported"),
        F.bool_and((F.col("resolution") == "CONFIRMED") | (F.col("own_note") != "") | (F.col("note") != "")).alias("explained"),
        F.array_sort(F.collect_list(F.struct("nth", "resolution", "own_note"))).alias("said"),
    )
    tell = lambda what: F.concat(F.lit("issue "), F.col("issue_id"), F.lit(f": {what}"))
    wrong = _listed([
        (F.col("known").isNull(), tell("unknown")), (F.col("n") > 1, tell("repeated")), (~F.col("supported"), tell("unsupported resolution")), (~F.col("explained"), tell("needs a note")),
    ])
    judged = each.withColumn("wrong", wrong).groupBy("review_id").agg(
        F.flatten(F.array_sort(F.collect_list("wrong"))).alias("wrong"),
        F.array_sort(F.collect_list(F.struct("issue_id", F.get("said", F.lit(0))["resolution"].alias("resolution"), F.get("said", F.lit(0))["own_note"].alias("note")))).alias("resolutions"),
    )
    every = own.join(reports.withColumn("reported", F.lit(True)), "run", "left").join(judged, "review_id", "left")
    verdict, strings = F.col("verdict"), F.array().cast("array<string>")
    breaches = _listed([
        (F.col("reported").isNull(), F.lit("run: no report")),
        (F.col("reviewer") == "", F.lit("reviewer: blank")),
        (~verdict.isin(*VERDICTS), F.lit("verdict: unsupported")),
        (verdict.isin("OVERRIDE_DECISION", "REQUEST_MORE_EVIDENCE") & (F.col("note") == ""), F.lit("note: needed")),
        ((verdict == "OVERRIDE_DECISION") & ~F.col("target").isin(*DECISIONS), F.lit("target: no decision")),
        (F.length("request_id") > LONGEST_REQUEST_ID, F.lit("request_id: too long")),
        (F.exists(F.map_keys("tracks"), lambda k: ~k.isin(*TRACKS)), F.lit("tracks: unknown")),
        (F.exists(F.map_values("tracks"), lambda v: ~v.isin(*TRACK_STATES)), F.lit("tracks: unsupported state")),
    ])
    found = F.concat(breaches, F.coalesce("wrong", strings))
    unresolved = F.array().cast("array<struct<issue_id:string,resolution:string,note:string>>")
    return every.select(
        "review_id", "run", "reviewer", "verdict", F.when(verdict == "OVERRIDE_DECISION", F.col("target")).alias("target"), "note", F.nullif("request_id", F.lit("")).alias("request_id"), "tracks",
        F.coalesce("resolutions", unresolved).alias("resolutions"), F.col("decision").alias("machine_decision"), F.col("coverage").alias("machine_coverage"), "report_hash", "observation_hash",
        (F.size(found) == 0).alias("accepted"), found.alias("breaches"),
    )
