"""Choosing issues, evidence and pages against plain versions of the same rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import text as X
from tallyscope.operators.attention import FAMILIES, OWNER, SOURCES, WORST_FIRST, merge_across, rank_evidence
from tallyscope.operators.sampling import authorship_sample, running_before

RAW = "run int, family string, metric string, page int, code string, priority string, severity string, source string"


def merged(spark, rows):
    found = merge_across(spark.createDataFrame(rows, RAW), tuple(OWNER)).collect()
    return {(r.run, r.family): r for r in found}


def test_families_that_report_alike_are_one_issue(spark):
    f = "VISUAL_COMMUNICATION", "SEQUENCE_SYSTEM", "VISUAL_LAYOUT_READABILITY", "AUTHORSHIP"
    rows = [
        (1, f[0], "a", 1, "COLOR_CONTRAST", "P2", "MINOR", "RULE"), (1, f[1], "b", 1, "COLOR_CONTRAST", "P1", "CRITICAL", "MODEL"), (1, f[3], "c", 2, "COLOR_CONTRAST", "P2", "MAJOR", "RULE"),
        (2, f[0], "a", 1, "COLOR_CONTRAST", "P2", "MINOR", "RULE"), (2, f[2], "a", 1, "COLOR_CONTRAST", "P2", "MINOR", "RULE"),
        (3, f[0], "a", 1, "UNLISTED", "P2", "MINOR", "RULE"), (3, f[1], "a", 1, "UNLISTED", "P2", "MINOR", "RULE"),
        (4, f[0], "a", 1, "COLOR_CONTRAST", "P2", "MINOR", "RULE"), (4, f[0], "a", 2, "SMALL_TEXT", "P2", "MINOR", "RULE"), (4, f[1], "a", 1, "COLOR_CONTRAST", "P2", "MINOR", "RULE"), (4, f[1], "a", 2, "SMALL_TEXT", "P2", "MINOR", "RULE"),
        (5, "ELSEWHERE", "a", 1, "GENERIC_COPY", "P2", "MINOR", "RULE"), (5, f[3], "a", 1, "GENERIC_COPY", "P2", "MINOR", "RULE"),
    ]
    got = merged(spark, rows)
    one = got[1, f[0]]
    assert (one.families, one.priority, one.rank, one.metrics, one.consensus, one.n_findings) == ([f[0], f[1]], "P1", 5, ["a", "b"], "AGREED", 2)
    assert got[1, f[3]].families == [f[3]]  # other pages
    assert got[2, f[2]].families == [f[2], f[0]]  # the code's own family is among them
    assert {k for k in got if k[0] in (3, 4)} == {(3, f[0]), (3, f[1]), (4, f[0]), (4, f[1])}  # another code; two codes
    assert got[5, f[3]].families == [f[3], "ELSEWHERE"]
    random.Random(1).shuffle(rows)
    assert merged(spark, rows) == got and merged(spark, rows[:0]) == {}
    assert len(FAMILIES) == 8


EVIDENCE = "run int, source string, kind string, page int, object string, message string, severity string, confidence double, evidence_id string, bbox array<double>, codes array<string>, affected array<int>"


def plain_ranking(rows, keep, defects):
    held = {}
    for run, source, kind, page, thing, message, severity, confidence, name, box, codes, affected in rows:
        source, page, kind = source if source in SOURCES else "RULE", page if page and page > 0 else None, kind or ""
        codes = sorted(set(codes or ())) or ([kind] if kind in defects else [])
        worst = WORST_FIRST.index(severity) if severity in WORST_FIRST else 4
        choice = (worst, -confidence if confidence is not None else 1.0, name or "", json.dumps(box, separators=(",", ":")), codes)
        key = (run, source, kind, page, thing or "", message or "")
        old = held.get(key)
        held[key] = (min(old[0], choice) if old else choice, sorted({*codes, *(old[1] if old else ())}), sorted({*[p for p in affected or () if p > 0], *(old[2] if old else ())}))
    out = {}
    for (run, source, kind, page, thing, message), (choice, codes, affected) in held.items():
        order = (SOURCES.index(source), choice[0], page is None, page or 0, choice[2], kind, thing, message, choice[3], codes, affected)
        out.setdefault(run, []).append((order, (source, kind, page, thing, message, choice[2], choice[3], codes, affected)))
    return sorted(repr((run, i, *x)) for run, xs in out.items() for i, (_, x) in enumerate(sorted(xs)[:keep], 1))


@pytest.mark.parametrize("keep", [1, 3, 100])
def test_evidence_ranking_equals_a_plain_one(spark, keep):
    r = random.Random(keep)
    pick = r.choice
    rows = [
        (r.randrange(4), pick([*SOURCES, "ODD", None]), pick(["TITLE", "CROP", "X", None]), pick([None, 0, 1, 2]), pick([None, "o1", "o2"]), pick(["m", None]), pick([*WORST_FIRST, None]),
         pick([None, 0.5, 0.9]), pick([None, "e1", "e2", "e3"]), pick([None, [0.1, 0.2], [0.25]]), pick([None, [], ["A"], ["B", "A"]]), pick([None, [1], [2, -1]]))
        for _ in range(400)
    ]
    rows = [(*x[:6], x[6] or "INFO", *x[7:]) for x in rows]
    found = rank_evidence(spark.createDataFrame(rows, EVIDENCE), ["run"], keep, ("TITLE",)).collect()
    got = sorted(repr((x.run, x["rank"], x.source, x.kind, x.page, x.object, x.message, x.evidence_id, x.box, x.codes, x.affected)) for x in found)
    assert got == plain_ranking(rows, keep, ("TITLE",))


def test_evidence_is_cut_before_the_shuffle(spark):
    rows = rank_evidence(spark.createDataFrame([], EVIDENCE), ["run"], 3)
    assert "WindowGroupLimit" in rows._jdf.queryExecution().executedPlan().toString() and rows.collect() == []


def plain_sample(pages, k):
    n = max(p for p, *_ in pages)
    grid = list(range(1, n + 1)) if n <= k else [1] if k == 1 else [i * (n - 1) // (k - 1) + 1 for i in range(k)]
    chosen = []

    def add(p):
        if p not in chosen and len(chosen) < k:
            chosen.append(p)

    add(1)
    add(n)
    risk = sorted((x for x in pages if x[1] is not None), key=lambda x: (x[1], -x[2], f"page:{x[0]}"))
    for p, *_ in [x for x in risk if x[0] not in grid][:2]:
        add(p)
    for p, *_ in risk:
        if p in grid and p not in chosen:
            add(p)
            break
    for p, _, _, hits in sorted(risk, key=lambda x: (-x[3], x[1])):
        if hits and p in grid and p not in chosen:
            add(p)
            break
    for p in [*grid, *(x[0] for x in sorted(pages))]:
        add(p)
    return chosen


@pytest.mark.parametrize("k", [1, 2, 3, 6, 8])
def test_authorship_sample_equals_a_plain_one(spark, k):
    r = random.Random(k)
    decks = {d: [(p, r.choice([None, 0.1, 0.5, 0.5, 0.9]), r.choice([0.5, 1.0]), r.choice([0, 0, 1, 3])) for p in range(1, r.choice([1, 2, 3, 7, 15, 30]) + 1)] for d in range(40)}
    rows = [(d, p, len(ps), s, i, h) for d, ps in decks.items() for p, s, i, h in ps]
    found = authorship_sample(spark.createDataFrame(rows, "deck int, page int, n_pages int, score double, importance double, hits int"), k).collect()
    for d, ps in decks.items():
        assert [x.page for x in sorted((x for x in found if x.deck == d), key=lambda x: x.place)] == plain_sample(ps, k), (d, ps)


def test_ranges_have_equal_counts_despite_an_outlier(spark):
    rows = [("hot", i, 1) for i in range(5000)] + [("hot", 10**12, 1), ("cold", 7, 2), (None, None, 3), (None, 5, 4)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    found = running_before(df, "k", "seq", F.col("v"), "before", ranges=64)
    got = {(r.k, r.seq): r.before for r in found.collect()}
    assert all(got["hot", i] == i for i in range(5000)) and got["hot", 10**12] == 5000 and got["cold", 7] == 0 and got[None, None] == 0 and got[None, 5] == 3
    assert running_before(df.limit(0), "k", "seq", F.col("v"), "before").collect() == []


def test_language_labels(spark):
    cases = [("the quick brown", "EN"), ("API KPI ROI", "UNKNOWN"), ("NASA ESA JAXA", "UNKNOWN"), ("EUROPEAN SPACE agency", "UNKNOWN"), ("EUROPEAN CENTRAL agency", "EN"), ("well-known it's so", "EN"),
             ("收入 growth of sales", "MIXED"), ("㐀㐁", "ZH"), ("收 a", "UNKNOWN"), ("", "UNKNOWN")]
    got = [r[0] for r in spark.createDataFrame([(t,) for t, _ in cases], "t string").select(X.language_label(F.col("t"))).collect()]
    assert got == [want for _, want in cases]
