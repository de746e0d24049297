"""Requirements and chart expectations against plain versions of the same rules."""

import random

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import text as X
from tallyscope.operators import requirements as Q

ASKED = "deck int, ord int, text string, declared boolean"
OBJECTS = "deck int, page int, place int, object string, text string"


def observed(spark, asked, objects):
    found = Q.requirement_observations(spark.createDataFrame(asked, ASKED), spark.createDataFrame(objects, OBJECTS)).collect()
    assert len({(r.deck, r.ord, r.scope) for r in found}) == len(found)
    return {(r.ord, r.scope): r for r in found}


DECK = [(1, 1, 1, "a", "Market Analysis"), (1, 1, 2, "b", "Growth of 20%"), (1, 2, 1, "c", "Risk summary"), (1, 3, 1, "d", "市场分析 and Growth"), (2, 1, 1, "e", None)]


@pytest.mark.parametrize(
    "text, scopes, negative, critical, about",
    [
        ("must include market analysis", [None], False, True, "market analysis"), ("Never show passwords", [None], True, True, "passwords"), ("do not use red", [None], True, True, "red"),
        ("page 2 risk", [2], False, False, "risk"), ("slide #3 and page 2: growth", [3, 2], False, False, "and  : growth"), ("page 9 risk", [None], False, False, "risk"),
        ("every page footer", [1, 2, 3], False, False, "footer"), ("Each  slide 2 footer", [1, 2, 3], False, False, "2 footer"), ("第 1 页必须包含市场分析", [1], False, True, "市场分析"),
        ("每页不要红色", [1, 2, 3], True, False, "红色"), ("must", [None], False, True, "must"), ("must not shout", [None], True, True, "not shout"), ("page 99999999999999999999 x", [None], False, False, "x"),
    ],
)
def test_wording(spark, text, scopes, negative, critical, about):
    got = observed(spark, [(1, 1, text, False)], DECK)
    assert sorted(s or 0 for _, s in got) == sorted(s or 0 for s in scopes)
    assert {(r.negative, r.critical) for r in got.values()} == {(negative, critical)}
    found = spark.createDataFrame([(text,)], "t string").select(Q.subject(F.col("t")).alias("s")).first().s
    assert " ".join(found.split()) == " ".join(about.split())


def test_coverage_location_and_severity(spark):
    asked = [
        (1, 1, "must include market analysis", None), (1, 2, "page 2 market analysis", None), (1, 3, "never growth", None), (1, 4, "growth", True), (1, 5, "absent words", True),
        (1, 6, "   ", None), (1, 7, None, None), (2, 1, "anything", None), (3, 1, "no such deck", None), (1, 8, "page 3 市场分析", None),
    ]
    got = observed(spark, asked, DECK)
    one = got[1, None]
    assert (got[1, None].deck in (1, 2)) and {(r.deck, r.ord) for r in got.values()} >= {(1, 2), (1, 3), (1, 4), (1, 5), (1, 8)}
    found = Q.requirement_observations(spark.createDataFrame(asked, ASKED), spark.createDataFrame(DECK, OBJECTS))
    rows = {(r.deck, r.ord): r for r in found.collect()}
    assert set(rows) == {(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 8), (2, 1)} and one is not None
    assert (rows[1, 1].coverage, rows[1, 1].severity, rows[1, 1].importance, rows[1, 1].page, rows[1, 1].object) == (1.0, "INFO", 1.5, 1, "a")
    assert (rows[1, 2].coverage, rows[1, 2].page, rows[1, 2].object, rows[1, 2].severity) == (0.0, 2, None, "MAJOR")  # page 1 isn't in its scope
    assert (rows[1, 3].coverage, rows[1, 3].satisfaction, rows[1, 3].severity, rows[1, 3].object) == (1.0, 0.0, "CRITICAL", "b")
    assert (rows[1, 4].critical, rows[1, 4].severity) == (True, "INFO") and (rows[1, 5].severity, rows[1, 5].page) == ("CRITICAL", None)
    assert (rows[2, 1].coverage, rows[2, 1].object) == (0.0, None) and (rows[1, 8].coverage, rows[1, 8].object) == (1.0, "d")


def test_a_page_is_all_that_travels_for_it(spark):
    """A requirement for every page or for one carries that page's objects alone, whatever its deck holds besides."""
    objects = [(1, p, k, f"{p}:{k}", f"page{p} words{k}") for p in range(1, 41) for k in range(5)]
    asked = spark.createDataFrame([(1, 1, "every page words3", None), (1, 2, "page 7 words4", None), (1, 3, "words4", None)], ASKED)
    decks = Q.viewed(Q.paged(spark.createDataFrame(objects, OBJECTS)))
    rows = Q.scoped(Q.worded(asked).join(decks, "deck"))
    assert not {"views", "whole", "pages"} & set(rows.columns)
    assert sorted((r[0], r[1] or 0, r[2]) for r in rows.select("ord", "view.scope", F.size("view.items")).collect()) == [*[(1, p, 5) for p in range(1, 41)], (2, 7, 5), (3, 0, 200)]
    got = {(r.ord, r.scope): (r.coverage, r.page, r.object) for r in Q.observed(Q.worded(asked).join(decks, "deck")).collect()}
    assert got == {**{(1, p): (1.0, p, f"{p}:3") for p in range(1, 41)}, (2, 7): (1.0, 7, "7:4"), (3, None): (1.0, 1, "1:4")}


def test_objects_without_a_page_are_held_against_the_deck(spark):
    asked = [(1, 1, "every page cost", None), (1, 2, "page 99999999999999999999 page 2 cost", None), (1, 3, "page 2 cost", None)]
    got = observed(spark, asked, [(1, None, 1, "a", "revenue"), (1, 1, 1, "b", "cost"), (1, 2, 1, "c", "north")])
    assert {k: (r.coverage, r.page, r.object) for k, r in got.items()} == {
        (1, None): (1.0, 1, "b"), (1, 1): (1.0, 1, "b"), (1, 2): (0.0, 2, None), (2, None): (1.0, 1, "b"), (2, 2): (0.0, 2, None), (3, 2): (0.0, 2, None),
    }


def test_observations_equal_plain_recall(spark):
    r = random.Random(5)
    word = lambda: r.choice(["revenue", "cost", "3.5", "40%", "north", "收入", "增长率", "ab", "a_b-c", "Growth,", str(r.randrange(30))])
    said = lambda n: " ".join(word() for _ in range(r.randrange(n)))
    objects = [(d, p, k, f"{p}:{k}", said(5)) for d in range(8) for p in range(1, d + 1) for k in range(r.randrange(1, 4))]
    lead = lambda: r.choice(["", "every page ", "page 2 ", "page 1 and slide 3 ", "never "])
    asked = [(d, i, lead() + said(4) + " cost", None) for d in range(9) for i in range(12)]
    texts = {}
    for d, p, _, _, text in sorted(objects, key=lambda o: o[:3]):
        texts.setdefault((d, p), []).append(text)
        texts.setdefault((d, None), []).append(text)
    hay = spark.createDataFrame([(*k, "\n".join(v)) for k, v in texts.items()], "deck int, scope long, hay string")
    got = Q.requirement_observations(spark.createDataFrame(asked, ASKED), spark.createDataFrame(objects, OBJECTS)).select("deck", "ord", "scope", "coverage")
    about = spark.createDataFrame(asked, ASKED).select("deck", "ord", Q.subject(F.col("text")).alias("about"))
    both = got.join(about, ["deck", "ord"]).alias("g").join(hay.alias("h"), F.col("g.deck").eqNullSafe(F.col("h.deck")) & F.col("g.scope").eqNullSafe(F.col("h.scope")))
    rows = both.select("g.deck", "ord", "g.scope", "coverage", X.token_recall(F.col("about"), F.col("hay")).alias("plain")).collect()
    assert len(rows) == got.count() > 7 * 12 and all(x.coverage == x.plain for x in rows)
    assert len({x.coverage for x in rows}) > 3


CHARTS, EXPECTED = "deck int, page int, place int, object string, text string", "deck int, ord int, text string, critical boolean"


def best(spark, expectations, charts):
    found = Q.best_charts(spark.createDataFrame(expectations, EXPECTED), spark.createDataFrame(charts, CHARTS)).collect()
    assert len(found) == len(expectations)
    return sorted(repr((r.deck, r.ord, round(r.coverage, 9), r.page, r.object)) for r in found)


def all_pairs(spark, expectations, charts):
    e = spark.createDataFrame(expectations, EXPECTED).select("deck", "ord", F.coalesce("text", F.lit("")).alias("e"))
    c = spark.createDataFrame(charts, CHARTS).withColumn("text", F.coalesce("text", F.lit("")))
    rows = e.join(c, "deck", "left").withColumn("r", F.coalesce(F.when(F.col("object").isNotNull(), X.token_recall(F.col("e"), F.col("text"))), F.lit(0.0))).collect()
    kept = {}
    for r in sorted(rows, key=lambda r: (-r.r, r.page or 0, r.place or 0, r.object or "")):
        kept.setdefault((r.deck, r.ord), repr((r.deck, r.ord, round(r.r, 9), r.page, r.object)))
    return sorted(kept.values())


@pytest.mark.parametrize("frequent", [0, 1, 4, 32])
def test_best_charts_equal_all_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(Q, "FREQUENT", frequent)
    r = random.Random(frequent)
    word = lambda: r.choice(["revenue", "cost", "even", "seven", "north", "收入", "增长", "ab", "x1", str(r.randrange(30)), f"{r.randrange(9)}.5%"])
    charts = [(d, i // 3 + 1, i % 3, f"o{i}", " ".join(word() for _ in range(r.randrange(6)))) for d in range(4) for i in range(40)]
    asked = [(d, i, " ".join(word() for _ in range(r.randrange(4))), False) for d in range(5) for i in range(25)]
    asked += [(0, 100, None, None), (0, 101, "...", None), (0, 102, "nowhere to be found", True)]
    assert best(spark, asked, charts) == all_pairs(spark, asked, charts)


@pytest.mark.parametrize("few, short", [(32, 16384), (0, 0), (8, 16384), (32, 150)])
def test_few_charts_equal_all_pairs(spark, monkeypatch, few, short):
    """Decks of few charts, of many, of none and of long ones, dealt to both ways by either bound."""
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "SHORT", short)
    r = random.Random(few + short)
    word = lambda: r.choice(["revenue", "cost", "even", "seven", "收入", "增长", "ab", str(r.randrange(30)), f"{r.randrange(9)}.5%"])
    charts = [(d, i // 3 + 1, i % 3, f"o{i}", " ".join(word() for _ in range(r.randrange(6)))) for d in range(6) for i in range(3 * d)]
    asked = [(d, i, " ".join(word() for _ in range(r.randrange(4))), False) for d in range(6) for i in range(15)]
    asked += [(2, 100, None, None), (3, 101, "...", None), (4, 102, "nowhere to be found", True), (None, 103, "revenue", True)]
    assert best(spark, asked, charts) == all_pairs(spark, asked, charts)


def test_few_charts_are_met_without_runs_of_characters(spark):
    """No chart is cut into runs, and no pairs are dealt out, where an expectation can meet every chart of its deck."""
    charts = [(d, i, 1, f"o{i}", f"revenue 2024 total {i}") for d in range(9) for i in range(20)]
    found = Q.best_charts(spark.createDataFrame([(d, i, f"total {i}", True) for d in range(9) for i in range(20)], EXPECTED), spark.createDataFrame(charts, CHARTS))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") <= 2
    assert all((r.page, r.coverage, r.n_charts) == (r.ord, 1.0, 20) for r in found.collect() if r.ord > 2)


def test_many_charts_make_few_pairs(spark):
    charts = [(1, i, 1, f"o{i}", f"revenue 2024 total {i}") for i in range(1000)]
    asked = [(1, i, f"revenue 2024 total {i + 300}", i % 2 == 0) for i in range(1000)]
    e, c = spark.createDataFrame(asked, EXPECTED), spark.createDataFrame(charts, CHARTS)
    found = Q.best_charts(e, c)
    rows = {r.ord: r for r in found.collect()}
    assert all(rows[i].coverage == 1.0 and rows[i].page == i + 300 for i in range(700))
    assert all(rows[i].coverage < 1 for i in range(900, 1000) if i % 10) and rows[900].n_charts == 1000
    assert {rows[i].severity for i in range(900, 1000) if rows[i].coverage == 0.75} <= {"INFO"}
