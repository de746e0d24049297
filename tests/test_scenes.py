"""Observers of decks made from requests and sources, held against small cases worked out by hand."""

from pyspark.sql import functions as F

from tallyscope.operators.scenes import audience_fit, fact_support, render_parity, source_traceability
from tallyscope.plans.scenes import render_availability


def test_audience_fit(spark):
    rows = [
        ("named", "Board", "board: ROI and a recommendation"), ("unnamed", "pupils", "nothing for them"), ("two", "board of engineers", "API. architecture; roi"),
        ("none", None, "text"), ("blank", "  ", "text"), ("empty", "board", None), ("han", "技术团队", "技术团队的架构与接口"),
    ]
    df = spark.createDataFrame(rows, "deck string, audience string, text string")
    got = {r.deck: r.s and round(r.s, 6) for r in df.select("deck", audience_fit(F.col("audience"), F.col("text")).alias("s")).collect()}
    assert got == {
        "named": round(0.35 + 0.35 + 0.3 * 2 / 6, 6), "unnamed": round(0.35 + 0.3 * 0.5, 6), "two": round(0.35 + 0.3 * 3 / 12, 6),
        "none": None, "blank": None, "empty": 0.35, "han": round(0.35 + 0.35 + 0.3 * 2 / 6, 6),
    }


def test_audience_fit_reads_the_text_once(spark):
    """The plan normalises the text in one place, and tokens that only look like a word of the name don't count."""
    rows = [(1, "board engineers", "the boards reengineers"), (2, "board engineers", "a board-room, engineers"), (3, "board engineers", "9board")]
    df = spark.createDataFrame(rows, "deck int, audience string, text string").select("deck", audience_fit(F.col("audience"), F.col("text")).alias("s"))
    got = {r.deck: round(r.s, 6) for r in df.collect()}
    assert got == {1: 0.35, 2: round(0.35 + 0.35 / 2, 6), 3: round(0.35 + 0.35 / 2, 6)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower(coalesce(text") == 1


def test_fact_support(spark):
    decks = [("claims", "x"), ("facts", "The river is 20 km long."), ("both", "nothing"), ("empty bundle", "a"), ("none", "a"), ("blank fact", "a"), ("null text", None)]
    claims = [
        ("claims", "SUPPORTED", 0.9), ("claims", "CONTRADICTED", 0.5), ("claims", "INSUFFICIENT", 0.7), ("claims", "UNHEARD_OF", 0.5),
        ("both", "SUPPORTED", 1.0), ("empty bundle", None, None), ("elsewhere", "SUPPORTED", 1.0),
    ]
    facts = [("facts", "river is 20 km"), ("facts", "river wide"), ("facts", " "), ("both", "nothing"), ("empty bundle", "a"), ("blank fact", ""), ("null text", "some fact")]
    found = fact_support(
        spark.createDataFrame(decks, "deck string, text string"), spark.createDataFrame(claims, "deck string, verdict string, confidence double"),
        spark.createDataFrame(facts, "deck string, fact string"),
    ).collect()
    got = {r.deck: (r.status, r.reason, r.score, r.confidence and round(r.confidence, 6), r.n_checked) for r in found}
    assert got == {
        "claims": ("SCORED", None, 0.375, 0.65, 4), "facts": ("SCORED", None, 0.75, 0.92, 2), "both": ("SCORED", None, 1.0, 1.0, 1),
        "empty bundle": ("NA", "NO_MATERIAL_CLAIMS", None, None, 0), "none": ("NA", "NO_TRUSTED_FACTS", None, None, 0),
        "blank fact": ("NA", "NO_TRUSTED_FACTS", None, None, 0), "null text": ("SCORED", None, 0.0, 0.92, 1),
    }


def test_source_traceability(spark):
    decks = [("a", "See Report.PDF, page 3", None), ("b", None, "from notes.txt"), ("c", "text", "")]
    sources = [("a", 1, "https://x.org/files/report.pdf"), ("a", 2, "report.doc"), ("a", 3, ""), ("a", 4, None), ("a", 5, "/data/page/"), ("b", 1, "notes.txt"), ("z", 1, "text")]
    found = source_traceability(spark.createDataFrame(decks, "deck string, text string, notes string"), spark.createDataFrame(sources, "deck string, nth int, uri string")).collect()
    assert sorted((r.deck, r.nth, r.label, r.hit, r.score) for r in found) == [
        ("a", 1, "report.pdf", True, 1.0), ("a", 2, "report.doc", False, 0.0), ("a", 3, "", False, 0.0), ("a", 4, "", False, 0.0), ("a", 5, "page", True, 1.0), ("b", 1, "notes.txt", True, 1.0),
    ]


def test_render_parity(spark):
    pages = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("a", 3, 3), ("b", 1, 1), ("c", 1, 2), ("c", 2, 2)], "deck string, page int, n_pages int")
    rendered = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("c", 9), ("z", 1)], "deck string, page int")
    found = render_parity(pages, rendered).collect()
    assert sorted((r.deck, r.page, r.status, r.score, r.severity, r.key_unit, r.critical) for r in found) == [
        ("a", 1, "SCORED", 1.0, "INFO", True, False), ("a", 2, "SCORED", 1.0, "INFO", False, False), ("a", 3, "SCORED", 0.0, "CRITICAL", True, True),
        ("b", 1, "NA", None, "INFO", False, False), ("c", 1, "SCORED", 0.0, "CRITICAL", True, True), ("c", 2, "SCORED", 0.0, "CRITICAL", True, True),
    ]


def test_render_availability_measures_its_pages_once(spark, tmp_path):
    """The texts are read to write the pages down; the joins and counts behind read those, and no text again."""
    texts = ["one\ntwo lines. more", "not rendered", None, "abc\n\nthanks"]
    docs = spark.createDataFrame([(4 * i + i % 2, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = render_availability(spark, str(tmp_path))
    assert found.count() == 7 and not [f for f in found.inputFiles() if "documents.parquet" in f]
    got = {(r.doc_id, r.page): (r.status, r.score, r.key_unit, r.critical) for r in found.collect()}
    assert got[0, 1] == ("SCORED", 0.0, True, True) and got[0, 2] == ("SCORED", 1.0, True, False)
    assert got[5, 1] == ("NA", None, False, False) and got[8, 1] == ("SCORED", 1.0, True, False) and got[13, 1] == ("NA", None, False, False)
