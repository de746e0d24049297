import pytest
from pyspark.sql import functions as F

from tallyscope.functions.scores import effective_score, lit, piecewise, severity_band
from tallyscope.operators import reduce as R
from tallyscope.operators.scoring import (
    base_score, cap_model_score, construct_mean, coverage, decision, full_score, fuse, fuse_authorship, gate_product, track_decision, weighted_mean,
)

OBS = "run string, eff double, importance double, confidence double, severity string, key_unit boolean, critical boolean"


def obs(spark, rows):
    return spark.createDataFrame([("r", *r) for r in rows], OBS)


def unit(score, key=False, importance=1.0, severity="INFO", critical=False):
    return (score, importance, 1.0, severity, key, critical)


def reduced(spark, rows, score, **more):
    return R.reduce_metric(obs(spark, rows), ["run"], score, **more).first()


FIVE = [unit(1.0), unit(0.8), unit(0.6), unit(0.4, key=True), unit(0.2)]


def test_page_and_pair_quality(spark):
    assert reduced(spark, FIVE, R.page_quality()).score == pytest.approx(0.47)
    assert reduced(spark, FIVE, R.pair_quality()).score == pytest.approx(0.48)
    assert reduced(spark, [unit(0.5), unit(1.0)], R.page_quality()).score == pytest.approx((0.6 * 0.75 + 0.25 * 0.5) / 0.85)


def test_importance_coverage(spark):
    assert reduced(spark, [unit(1.0, importance=3.0), unit(0.0)], R.importance_coverage()).score == pytest.approx(0.75)
    assert reduced(spark, [unit(1.0, importance=0.0), unit(0.5, importance=0.0)], R.importance_coverage()).score == pytest.approx(0.75)


def test_missing_units(spark):
    half = reduced(spark, [unit(0.9), unit(None)], R.importance_coverage())
    assert (half.status, half.score, half.observability) == ("NA", None, 0.5)
    few = reduced(spark, [unit(0.9)] + [unit(None)] * 4, R.importance_coverage(), required=False)
    assert (few.status, few.score) == ("SCORED", pytest.approx(0.9))
    assert reduced(spark, [unit(None)], R.importance_coverage(), required=False).status == "NA"


def test_what_is_observed_to_just_the_least_share_is_scored(spark):
    # 111 of 185 parts are 0.6; as doubles the sums give 0.5999999999999999, first to last and last to first
    parts = [73, 0, 38, 1, 57, 12, 4]
    rows = [unit(0.9 if i < 3 else None, importance=k / 50) for i, k in enumerate(parts)]
    for own in (rows, rows[::-1]):
        r = R.reduce_metric(obs(spark, own).coalesce(1), ["run"], R.importance_coverage()).first()
        assert r.observability < 0.6 and (r.status, r.score) == ("SCORED", pytest.approx(0.9))


def test_at_the_least_share_the_sums_in_the_given_order_tell(spark):
    # 132 of 220 parts are 0.6; as doubles the sums give 0.5999999999999999 first to last, and 0.6 last to first
    parts = [36, 96, 64, 24]
    rows = [("r", *unit(0.9 if i < 2 else None, importance=k / 50), i, -i) for i, k in enumerate(parts)]
    dealt = spark.createDataFrame(rows[::-1], OBS + ", at int, back int").repartition(3)
    for order, status in (("at", "NA"), ("back", "SCORED")):
        assert R.reduce_metric(dealt, ["run"], R.importance_coverage(), order=[order]).first().status == status


def test_queries_at_the_least_share_equal_their_twins(spark, tmp_path):
    import datetime

    import duckdb

    from tallyscope.queries import QUERIES, SQL

    # runs that are observed to just 0.6: first those with a score, then those without, and the other way round
    at, rows = datetime.datetime(2024, 1, 1), []
    for run, (parts, places) in enumerate((([36, 96, 64, 24], (4, 5, 11, 12)), ([24, 64, 96, 36], (0, 1, 4, 5)), ([73, 0, 38, 1, 57, 12, 4], (4, 5, 6, 11, 12, 22, 23)))):
        rows += [(1100 * run + place, at, run, "click", 50.0, f'{{"k": {k}}}') for k, place in zip(parts, places, strict=True)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(run, 0, "user", "said") for run in range(3)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    for name in ("events", "conversations"):
        db.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("q16_page_quality", "q18_importance_coverage", "q24_construct_mean", "q103_review_validation"):
        got, twin = QUERIES[name](spark, str(tmp_path)), db.sql(SQL[name])
        places = [twin.columns.index(c) for c in got.columns]
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in places)) for r in twin.fetchall()), name


def test_critical_cap(spark):
    rows = [unit(0.9), unit(0.9), unit(0.9, key=True, severity="CRITICAL")]
    r = reduced(spark, rows, R.importance_coverage())
    assert (r.score, r.uncapped_score, r.severity) == (pytest.approx(0.34), pytest.approx(0.9), "CRITICAL")
    assert reduced(spark, [unit(0.9, severity="CRITICAL")], R.importance_coverage()).score == pytest.approx(0.9)


@pytest.mark.parametrize("worse", range(5))
def test_a_worse_unit_never_helps(spark, worse):
    rows = [list(u) for u in FIVE]
    before = reduced(spark, [tuple(r) for r in rows], R.page_quality()).score
    rows[worse][0] -= 0.15
    assert reduced(spark, [tuple(r) for r in rows], R.page_quality()).score <= before + 1e-12


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_effective_scores_and_bands(spark):
    rows = spark.createDataFrame([("SCORED", 0.4), ("PASS", None), ("FAIL", None), ("PASS", 0.7), ("NA", 0.5), ("ERROR", None)], "s string, x double")
    assert [r.e for r in rows.select(effective_score(F.col("s"), F.col("x")).alias("e")).collect()] == [0.4, 1.0, 0.0, 0.7, None, None]
    got = one(spark, a=severity_band(lit(0.2)), b=severity_band(lit(0.5)), c=severity_band(lit(0.9)), d=severity_band(lit(0.1), 0.15), e=severity_band(F.lit(None).cast("double")))
    assert tuple(got) == ("MAJOR", "MINOR", "INFO", "CRITICAL", None)
    knots = ((0.0, 0.0), (0.03, 0.5), (0.20, 1.0), (0.45, 0.85), (1.20, 0.0))
    got = one(spark, a=piecewise(lit(0.015), knots), b=piecewise(lit(0.2), knots), c=piecewise(lit(0.825), knots), d=piecewise(lit(3), knots))
    assert tuple(got) == (pytest.approx(0.25), pytest.approx(1.0), pytest.approx(0.425), 0.0)


def test_weighted_and_construct_means(spark):
    rows = spark.createDataFrame(
        [("r", "content", 0.5, "a", 0.5, 0.8, True, False), ("r", "content", 0.5, "b", 0.5, None, False, False), ("r", "visual", 0.5, "c", 0.6, 0.8, True, False), ("r", "visual", 0.5, "d", 0.4, 0.4, True, False),
         ("q", "content", 0.5, "a", 0.5, None, True, False), ("q", "visual", 0.5, "c", 0.6, 0.5, True, False), ("q", "visual", 0.5, "d", 0.4, None, False, True)],
        "run string, construct string, construct_weight double, metric string, weight double, score double, required boolean, failed boolean",
    )
    flat = {r.run: r for r in weighted_mean(rows, ["run"]).collect()}
    assert flat["r"].value == pytest.approx((0.4 + 0.48 + 0.16) / 1.5) and flat["r"].unresolved == []
    assert flat["q"].unresolved == ["a", "d"]
    nested = {r.run: r for r in construct_mean(rows, ["run"]).collect()}
    assert nested["r"].score == pytest.approx((0.8 + 0.64) / 2)
    assert nested["q"].score == pytest.approx(0.5) and nested["q"].unresolved == ["a", "construct:content", "d"]


def test_gates(spark):
    rows = spark.createDataFrame(
        [("a", 0.5, 0.95), ("a", 0.5, 0.99), ("b", 0.0, 0.5), ("c", 1.0, 0.1), ("c", None, 1.0)], "run string, multiplier double, confidence double"
    )
    got = {r.run: (r.gate, r.n_unresolved, r.n_low_confidence) for r in gate_product(rows, ["run"]).collect()}
    assert got == {"a": (0.25, 0, 0), "b": (1.0, 1, 1), "c": (1.0, 1, 0)}


def test_scores_and_coverage(spark):
    null = F.lit(None).cast("double")
    yes, no = F.lit(True), F.lit(False)
    base = base_score(lit(0.5), lit(0.8))
    got = one(
        spark, base=base, full=full_score(F.lit("FULL"), base, lit(0.8), lit(0.5), lit(0.6), lit(1), 0.55, yes), alone=full_score(F.lit("FULL"), base, lit(0.8), lit(0.5), null, lit(1), 0.55, no),
        none=full_score(F.lit("DEGRADED"), base, lit(0.8), lit(0.5), lit(0.6), lit(1), 0.55, yes), zero=base_score(lit(0), null), open=base_score(lit(1), null),
    )
    assert tuple(got) == (pytest.approx(40.0), pytest.approx(35.5), pytest.approx(40.0), None, 0.0, None)
    got = one(
        spark, a=coverage(null, yes, null, yes, yes), b=coverage(lit(1), yes, null, yes, no), c=coverage(lit(1), no, null, yes, no),
        d=coverage(lit(1), yes, null, yes, yes), e=coverage(lit(1), yes, lit(1), yes, yes), f=coverage(lit(1), yes, lit(1), no, yes),
    )
    assert tuple(got) == ("UNASSESSABLE", "FULL", "DEGRADED", "BASE_ONLY", "FULL", "DEGRADED")


@pytest.mark.parametrize(
    ("gate", "sure", "cover", "open_", "scene", "floors", "score", "want"),
    [
        (0.0, True, "DEGRADED", 1, 1.0, True, 0.0, "FAIL"), (0.0, False, "FULL", 0, 1.0, True, 90.0, "PASS"), (1.0, True, "DEGRADED", 0, 1.0, True, 90.0, "REVIEW"),
        (1.0, True, "FULL", 1, 1.0, True, 90.0, "REVIEW"), (1.0, True, "FULL", 0, 0.0, True, 90.0, "FAIL"), (1.0, True, "FULL", 0, 1.0, False, 82.0, "REVIEW"),
        (1.0, True, "FULL", 0, 1.0, True, None, "ERROR"), (0.5, True, "FULL", 0, 1.0, True, 80.0, "PASS"), (1.0, True, "FULL", 0, 1.0, True, 60.0, "REVIEW"), (1.0, True, "FULL", 0, 1.0, True, 59.9, "FAIL"),
    ],
)
def test_decision_ladder(spark, gate, sure, cover, open_, scene, floors, score, want):
    made = decision(lit(gate), F.lit(sure), F.lit(cover), F.lit(open_), lit(scene), F.lit(floors), F.lit(score).cast("double"))
    assert one(spark, d=made).d == want


@pytest.mark.parametrize(
    ("critical", "raster", "visual", "score", "missing", "want"),
    [
        (False, False, True, 80.0, False, "TRAIN"), (False, False, True, 60.0, False, "REVIEW"), (False, False, True, 59.999, False, "REJECT"), (False, False, True, None, False, "REVIEW"),
        (False, False, False, 59.0, True, "REJECT"), (False, False, False, 90.0, True, "REVIEW"), (True, False, True, 99.0, False, "REJECT"), (False, True, False, 99.0, False, "REJECT"), (False, True, True, 99.0, False, "TRAIN"),
    ],
)
def test_tracks(spark, critical, raster, visual, score, missing, want):
    made = track_decision(F.lit(critical), F.lit(raster), F.lit(visual), F.lit(score).cast("double"), F.lit(missing))
    assert one(spark, d=made).d == want


def test_fusion_and_caps(spark):
    null = F.lit(None).cast("double")
    got = one(spark, a=fuse(lit(0.9), lit(0.5)), b=fuse(lit(0.9), null), c=fuse(null, lit(0.5)), d=fuse_authorship(lit(0.8), lit(0.4)), e=fuse_authorship(lit(0.8), null))
    assert tuple(got) == (pytest.approx(0.67), pytest.approx(0.9), None, pytest.approx(0.68), pytest.approx(0.8))
    cap = lambda s, n, sev: cap_model_score(lit(s), F.lit(n), F.lit(sev))
    got = one(spark, a=cap(0.9, 1, "NONE"), b=cap(0.99, 2, "NONE"), c=cap(0.99, 3, "NONE"), d=cap(0.99, 3, "MINOR"), e=cap(0.99, 3, "MAJOR"), f=cap(0.99, 3, "CRITICAL"))
    assert tuple(got) == (0.79, 0.94, 0.99, 0.94, 0.64, 0.34)
