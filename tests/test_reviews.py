"""Reviews and issue lists against small cases worked out by hand."""

import itertools
import random

from pyspark.sql import functions as F

from tallyscope.operators.attention import evidence_gap, issue_details, issue_order, semantic_family
from tallyscope.operators.reviews import validate_reviews

REVIEW = "review_id string, run string, reviewer string, verdict string, target string, note string, request_id string, tracks map<string,string>"
GOOD = ("ann", "CONFIRM_SYSTEM_DECISION", "PASS", None, None, None)


def judged(spark, reviews, resolutions=()):
    reports = [("r1", "FAIL", "FULL", "h1", "o1"), ("r2", "PASS", "DEGRADED", None, None)]
    issues = [("r1", "i1"), ("r1", "i1"), ("r1", "i2"), ("r2", "i3")]
    found = validate_reviews(
        spark.createDataFrame(reviews, REVIEW), spark.createDataFrame(list(resolutions), "review_id string, nth int, issue_id string, resolution string, note string"),
        spark.createDataFrame(reports, "run string, decision string, coverage string, report_hash string, observation_hash string"), spark.createDataFrame(issues, "run string, issue_id string"),
    ).collect()
    assert len(found) == len(reviews) and all(r.accepted == (not r.breaches) for r in found)
    return {r.review_id: r for r in found}


def test_each_rule_of_a_review(spark):
    cases = {
        "whole": (("r1", *GOOD), []),
        "cleaned": (("r1", " ann ", " override_decision ", " pass ", " why ", " id ", {"visual": " train"}), []),
        "no run": (("r9", *GOOD), ["run: no report"]),
        "null run": ((None, *GOOD), ["run: no report"]),
        "blank": (("r1", "  ", *GOOD[1:]), ["reviewer: blank"]),
        "old verdict": (("r1", "ann", "APPROVE", None, None, None, None), ["verdict: unsupported"]),
        "no note": (("r1", "ann", "REQUEST_MORE_EVIDENCE", None, " ", None, None), ["note: needed"]),
        "no target": (("r1", "ann", "OVERRIDE_DECISION", None, "why", None, None), ["target: no decision"]),
        "both": (("r1", "ann", "OVERRIDE_DECISION", "SHIP", None, None, None), ["note: needed", "target: no decision"]),
        "long id": (("r1", "ann", "CONFIRM_SYSTEM_DECISION", None, None, "x" * 129, None), ["request_id: too long"]),
        "track": (("r1", "ann", "CONFIRM_SYSTEM_DECISION", None, None, "x" * 128, {"colour": "TRAIN"}), ["tracks: unknown"]),
        "state": (("r1", "ann", "CONFIRM_SYSTEM_DECISION", None, None, None, {"layout": None}), ["tracks: unsupported state"]),
    }
    got = judged(spark, [(k, *v[0]) for k, v in cases.items()])
    assert {k: r.breaches for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    r = got["cleaned"]
    assert (r.reviewer, r.verdict, r.target, r.note, r.request_id, r.tracks) == ("ann", "OVERRIDE_DECISION", "PASS", "why", "id", {"visual": "TRAIN"})
    assert (r.machine_decision, r.machine_coverage, r.report_hash, r.observation_hash, r.resolutions) == ("FAIL", "FULL", "h1", "o1", [])
    assert got["whole"].target is None and got["no run"].machine_decision is None
    assert judged(spark, []) == {}


def test_each_rule_of_a_resolution(spark):
    resolutions = [
        ("a", 1, "i2", " confirmed", None), ("a", 2, "i1", "FALSE_POSITIVE", "seen"),
        ("b", 1, "i3", "CONFIRMED", None), ("c", 1, "i1", "CONFIRMED", None), ("c", 2, "i1", "CONFIRMED", None),
        ("d", 1, "i1", "MAYBE", "x"), ("e", 1, "i1", "INSUFFICIENT_EVIDENCE", " "), ("f", 1, "i1", "INSUFFICIENT_EVIDENCE", None), ("g", 1, None, "CONFIRMED", None), ("nobody", 1, "i1", "CONFIRMED", None),
    ]
    noted = ("ann", "CONFIRM_SYSTEM_DECISION", None, "for all", None, None)
    got = judged(spark, [(k, "r1", *(noted if k == "f" else GOOD)) for k in "abcdefgh"], resolutions)
    assert {k: r.breaches for k, r in got.items()} == {
        "a": [], "b": ["issue i3: unknown"], "c": ["issue i1: repeated"], "d": ["issue i1: unsupported resolution"], "e": ["issue i1: needs a note"], "f": [], "g": ["issue : unknown"], "h": [],
    }
    assert [tuple(x) for x in got["a"].resolutions] == [("i1", "FALSE_POSITIVE", "seen"), ("i2", "CONFIRMED", "")]


def test_families_and_gaps(spark):
    want = {
        "Key_Point": "TASK_FIDELITY", "typography_craft": "VISUAL_LAYOUT_READABILITY", "provider_layout": "SYSTEM_INTEGRITY", "authorship_title": "AUTHORSHIP", "duplicate_slide_pairs": "SEQUENCE_SYSTEM",
        "contrast_palette": "VISUAL_LAYOUT_READABILITY", "palette_layout": "VISUAL_COMMUNICATION", "crop_risk": "VISUAL_LAYOUT_READABILITY", "chart_language": "TASK_FIDELITY",
        "language": "CONTENT_EXPRESSION", "file_security": "DELIVERY_INTEGRITY", "other": "CONTENT_EXPRESSION", None: "CONTENT_EXPRESSION",
    }
    df = spark.createDataFrame([(k,) for k in want], "m string")
    assert {r.m: r.f for r in df.select("m", semantic_family(F.col("m")).alias("f")).collect()} == want
    reasons = {"a provider failed": True, "required metric is unresolved": True, "Required metric is unresolved": False, "low": False, None: False}
    df = spark.createDataFrame([(k,) for k in reasons], "m string")
    assert {r.m: r.f for r in df.select("m", evidence_gap(F.col("m")).alias("f")).collect()} == reasons


def test_order_and_details_of_issues(spark):
    order, severe = ("P0", "P1", "P2", "P3", "P9"), ("CRITICAL", "MAJOR", "MINOR", "INFO", "NONE")
    rows = [(p, s, pages, i) for p, s, pages, i in itertools.product(order, severe, ([1], [5, 2], []), "ba")]
    want = sorted(rows, key=lambda r: (order.index(r[0]), severe.index(r[1]), min(r[2], default=10**9), r[3]))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "priority string, severity string, pages array<int>, id string")
    got = df.orderBy(*issue_order(*[F.col(c) for c in df.columns])).collect()
    assert [tuple(r) for r in got] == want
    issues = spark.createDataFrame([("r", "i", ["b", "zz", "a"]), ("r", "none", []), ("s", "i", ["a"])], "run string, issue_id string, raw_ids array<string>")
    raw = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("s", "a", 4)], "run string, raw_id string, page int")
    found = {(r.run, r.issue_id): (r.n_raw, [tuple(x) for x in r.raw]) for r in issue_details(issues, raw, ["page"]).collect()}
    assert found == {("r", "i"): (2, [("b", 2), ("a", 1)]), ("r", "none"): (0, []), ("s", "i"): (1, [("a", 4)])}
