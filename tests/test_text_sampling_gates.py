import pytest
from pyspark.sql import functions as F

from tallyscope.functions import text as X
from tallyscope.functions.scores import hash_fraction, stable_id
from tallyscope.operators.attention import merge_issues, top_issues
from tallyscope.operators.gates import confirm, gate_candidates, gate_multiplier
from tallyscope.operators.geometry import overlapping_pairs, reading_order, titles
from tallyscope.operators.logs import content_hash, idempotency, illegal_transitions, latest, verify_chain
from tallyscope.operators.sampling import active_sampling, budgeted_sample, even_places


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_text_measures(spark):
    rows = [("The Revenue grew 12.5% in 2024, revenue!",), ("收入增长 and 利",), (None,), ("",)]
    got = values(spark, rows, "t string", X.tokens(F.col("t")), X.normalize_text(F.col("t")), X.language_label(F.coalesce("t", F.lit(""))))
    assert got[0] == (["revenue", "grew", "12.5%", "2024"], "therevenuegrew125in2024revenue", "EN")
    assert got[1][0] == ["收入", "入增", "增长", "利"] and got[1][1:] == ("收入增长and利", "ZH")
    assert got[2][0] == [] and got[3] == ([], "", "UNKNOWN")
    got = values(spark, [("ab cde", "xx abc de yy"), ("alpha beta", "beta gamma"), ("", "x"), ("a", "z")], "n string, h string", X.token_recall(F.col("n"), F.col("h")))
    assert [g[0] for g in got] == [1.0, 0.5, 1.0, 0.0]
    got = values(spark, [(["a"], ["a", "b"]), ([], [])], "a array<string>, b array<string>", X.jaccard(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [0.5, 1.0]
    got = values(spark, [("A first sentence. Short! 一二三四五六七八。no",)], "t string", X.sentences(F.col("t")))
    assert got[0][0] == ["A first sentence", "一二三四五六七八"]
    assert len(values(spark, [("x" * 500,)], "t string", X.excerpt(F.col("t")))[0][0]) == 120


def test_normalised_text_is_cheap(spark):
    """No letter of Unicode is taken otherwise than by the negated class, and it takes no longer than one of ASCII alone."""
    import time

    every = spark.range(0x110000).where("id not between 55296 and 57343").select(F.concat(F.lit("a"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"), F.lit("z")).alias("t"))
    plain = F.regexp_replace(F.lower("t"), f"[^0-9a-z{X.HAN}]+", "")
    assert every.where(~plain.eqNullSafe(X.normalize_text(F.col("t")))).count() == 0
    long = spark.range(0, 8000, 1, 4).select(F.repeat(F.concat(F.lit("Some words of "), F.col("id").cast("string"), F.lit(", and more. ")), 60).alias("t"))

    def took(norm):
        began = time.time()
        long.agg(F.sum(F.length(norm))).collect()
        return time.time() - began

    ascii_only = F.regexp_replace(F.lower("t"), "[^0-9a-z]+", "")
    least = lambda norm: min(took(norm) for _ in range(4))
    assert least(X.normalize_text(F.col("t"))) < 3 * least(ascii_only)


def test_tokens_of_two_pages_meet_once(spark, tmp_path):
    from tallyscope.queries import QUERIES

    spark.createDataFrame([(1, "first words here\nfirst words there.a.b.c")], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["q03_transition_adjacent"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") <= 3
    assert [r.score for r in found.collect()] == [1.0]


def test_ids(spark):
    import hashlib

    got = values(spark, [("a", 1)], "x string, y int", stable_id(16, F.col("x"), F.col("y")), hash_fraction(F.col("x")))[0]
    assert got[0] == hashlib.sha256(b"a|1").hexdigest()[:16]
    assert got[1] == pytest.approx(int(hashlib.sha256(b"a").hexdigest()[:8], 16) / 0xFFFFFFFF)


def test_even_places(spark):
    for n in range(1, 30):
        for k in (2, 4, 8):
            got = spark.range(1).select(even_places(F.lit(n), k).alias("p")).first().p
            assert got == (list(range(1, n + 1)) if n <= k else sorted({i * (n - 1) // (k - 1) + 1 for i in range(k)}))


def test_budgeted_sample(spark):
    rows = [("d", p, 10, {7: 1, 3: 2, 5: 3}.get(p)) for p in range(1, 11)] + [("e", p, 3, None) for p in range(1, 4)]
    got = budgeted_sample(spark.createDataFrame(rows, "deck string, page int, n_pages int, risk int"), 4).collect()
    assert sorted(r.page for r in got if r.deck == "d") == [1, 3, 7, 10]
    assert sorted(r.page for r in got if r.deck == "e") == [1, 2, 3]


def test_active_sampling(spark):
    rows = [("a", "k", 1, 0.5, 0.5, 0.5, 0.5), ("b", "k", 2, 0.5, 0.5, 0.5, 0.5), ("c", "m", 3, 0.5, 0.5, 0.5, 0.5)]
    got = {r.record: (r.bonus, r.score) for r in active_sampling(spark.createDataFrame(rows, "record string, diversity_key string, seq int, uncertainty double, disagreement double, severity double, value double")).collect()}
    assert got["a"][0] == got["c"][0] == 1.0 and got["b"][0] == 0.5
    assert got["b"][1] == pytest.approx(0.45 + 0.05, abs=0.006)


def test_gate(spark):
    obs = [("r", "m", "SCORED", "MAJOR", False, False)] * 2 + [("r", "m", "SCORED", "INFO", False, False)] * 8 + [("r", "n", "SCORED", "CRITICAL", True, False), ("r", "o", "FAIL", "CRITICAL", True, True), ("r", "p", "SCORED", "MAJOR", True, False), ("r", "q", "SCORED", "INFO", True, False)]
    got = {r.metric: r.candidate for r in gate_candidates(spark.createDataFrame(obs, "run string, metric string, status string, severity string, key_unit boolean, critical boolean")).collect()}
    assert got == {"m": "MAJOR", "n": "CRITICAL", "p": "MAJOR", "q": None}
    pages = [("r", "n", "CRITICAL", 1, True, ["A"]), ("r", "n", "CRITICAL", 2, False, ["A"]), ("s", "m", "MAJOR", 1, False, ["A"]), ("s", "m", "MAJOR", 2, False, ["B"]), ("t", "m", "MAJOR", 1, False, ["A"]), ("u", "m", "MAJOR", 1, False, ["A"])]
    seen = [("r", "n", 2, ["A", "C"], "MAJOR"), ("s", "m", 1, ["A"], "CRITICAL"), ("t", "m", 1, ["A"], "MINOR"), ("s", "m", 2, ["Z"], "NONE")]
    verdicts = confirm(spark.createDataFrame(pages, "run string, metric string, candidate string, page int, key_unit boolean, codes array<string>"), spark.createDataFrame(seen, "run string, metric string, page int, codes array<string>, severity string"))
    assert {r.run: r.verdict for r in verdicts.collect()} == {"r": "CONFIRMED", "s": "CONFIRMED", "t": "REJECTED", "u": "UNRESOLVED"}
    assert {r.run: r.multiplier for r in gate_multiplier(verdicts).collect()} == {"r": 0.0, "s": 0.5, "t": 1.0, "u": None}


def test_geometry(spark):
    rows = [("d", 1, 1, "text", 0.1, 0.1, 0.2, 0.2, 12.0, "one"), ("d", 1, 2, "text", 0.2, 0.1, 0.2, 0.2, 30.0, "two"), ("d", 1, 3, "text", 0.1, 0.05, 0.2, 0.01, 10.0, "x"), ("d", 1, 4, "image", 0.0, 0.0, 1.0, 1.0, 0.0, "full")]
    objects = spark.createDataFrame(rows, "deck string, page int, ord int, kind string, x double, y double, w double, h double, font double, text string")
    got = {(r.left_ord, r.right_ord): r.overlap for r in overlapping_pairs(objects).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)} and got[1, 2] == pytest.approx(0.5)
    assert titles(objects.where("kind = 'text'")).first().ord == 2
    assert tuple(reading_order(objects.where("kind = 'text'")).first())[2:] == (3, 2, pytest.approx(1 / 3))


def test_attention(spark):
    raw = [("r", "layout", "m", 2, "A", "P2", "MAJOR", "RULE"), ("r", "layout", "n", 1, "B", "P1", "CRITICAL", "MODEL"), ("r", "content", "o", 1, "C", "P2", "MINOR", "GAP"), ("r", "style", "o", 1, "C", "P3", "MINOR", "RULE")]
    issues = merge_issues(spark.createDataFrame(raw, "run string, family string, metric string, page int, code string, priority string, severity string, source string"))
    got = {r.family: (r.priority, r.pages, r.consensus, r.n_findings) for r in issues.collect()}
    assert got == {"layout": ("P1", [1, 2], "AGREED", 2), "content": ("P2", [1], "INSUFFICIENT", 1), "style": ("P3", [1], "SINGLE_SOURCE", 1)}
    assert {r.family for r in top_issues(issues, 2).collect()} == {"layout", "content"}
    assert {r.family for r in top_issues(issues, 0).collect()} == {"layout"}


def test_logs(spark):
    rows = [("c", 1, "a"), ("c", 2, "b"), ("c", 3, "d")]
    log = spark.createDataFrame(rows, "chain string, seq int, payload string")
    assert latest(log, ["chain"], ["seq"], ["payload"]).first().payload == "d"
    keyed = spark.createDataFrame([("k", "f", 1), ("k", "f", 2), ("k", "g", 3), ("m", "f", 4)], "key string, fp string, seq int")
    assert {r.key: (r.n_appends, r.n_reused, r.n_conflicts) for r in idempotency(keyed, "key", "fp", "seq").collect()} == {"k": (3, 1, 1), "m": (1, 0, 0)}
    steps = spark.createDataFrame([("r", 1, "A"), ("r", 2, "B"), ("r", 3, "A"), ("s", 1, "B")], "run string, seq int, state string")
    assert sorted((r.run, r.seq) for r in illegal_transitions(steps, "run", "seq", "state", [("A", "B")], ["A"]).collect()) == [("r", 3), ("s", 1)]
    h1 = log.where("seq = 1").select(content_hash(F.lit(""), F.col("payload")).alias("h")).first().h
    stored = [("c", 1, "a", "", h1), ("c", 2, "b", h1, "forged"), ("c", 3, "d", "forged", "forged")]
    got = verify_chain(spark.createDataFrame(stored, "chain string, seq int, payload string, previous_hash string, event_hash string"), "chain", "seq", ["payload"]).first()
    assert (got.n_events, got.n_broken, got.first_broken) == (3, 2, 2)


def test_every_page_with_a_text_is_in_a_class(spark, tmp_path):
    from tallyscope.plans.documents import duplicate_pages

    texts = [(1, "Alpha beta gamma.\nOther words here.\nAlpha beta gamma.\n\nalpha BETA gamma."), (2, "Single line"), (3, None)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in duplicate_pages(spark, str(tmp_path)).collect()]
    assert sorted(r[2:4] for r in rows if r[:2] == (1, "page")) == [(1, 1), (1, 3), (1, 5), (2, 2)]
    assert [r[1:] for r in rows if r[0] == 1 and r[1] == "link"] == [("link", 1, 1, 3, 0.0)]
    assert {r for r in rows if r[0] != 1} == {(2, "deck", None, None, 0, 1.0), (2, "page", 1, 1, 0, 1.0), (3, "deck", None, None, 0, 1.0)}
