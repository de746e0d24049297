"""Queries over `labels` and `documents` read as results of metrics: quality and toxicity as gates, text measures as scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.scores import lit, round6
from tallyscope.operators.scoring import base_score, coverage, decision, full_score, gate_product, track_decision, weighted_mean
from tallyscope.plans.registry import query
from tallyscope.sources.tables import table

WEIGHTS = {"length": 0.5, "lines": 0.3, "quality": 0.2}

ROWS = """
m AS (
  SELECT d.doc_id, d.source, least(1::double, length(coalesce(text, '')) / 3989::double) AS s_length, least(1::double, len(string_split(coalesce(text, ''), chr(10))) / 8::double) AS s_lines,
    l.quality::double AS s_quality, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
w AS (SELECT *, (0.5::double * s_length + 0.3::double * s_lines + coalesce(0.2::double * s_quality, 0::double)) / (0.5::double + 0.3::double + CASE WHEN s_quality IS NULL THEN 0::double ELSE 0.2::double END) AS mean FROM m),
g AS (
  SELECT *, CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 THEN 0::double ELSE 1::double END AS g_toxic, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 1::double ELSE 0.5::double END AS g_quality,
    CASE WHEN doc_id % 5 = 0 THEN 0.8::double ELSE 0.95::double END AS conf FROM w),
p AS (
  SELECT *, (CASE WHEN g_toxic IS NULL OR (g_toxic <> 1 AND conf < 0.9) THEN 1::double ELSE g_toxic END) * (CASE WHEN g_quality IS NULL OR (g_quality <> 1 AND conf < 0.9) THEN 1::double ELSE g_quality END) AS gate,
    (g_toxic IS NULL OR (g_toxic <> 1 AND conf < 0.9))::int + (g_quality IS NULL OR (g_quality <> 1 AND conf < 0.9))::int AS n_unresolved,
    (g_toxic IS NOT NULL AND g_toxic <> 1 AND conf < 0.9)::int + (g_quality IS NOT NULL AND g_quality <> 1 AND conf < 0.9)::int AS n_low FROM g)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with its measures and labels."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", "source", F.least(lit(1), F.length(text) / lit(3989)).alias("length"), F.least(lit(1), F.size(F.split(text, "\n")) / lit(8)).alias("lines"),
        F.col("quality").cast("double").alias("quality"), "toxic",
    )


def means(rows: DataFrame) -> DataFrame:
    each = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), lit(w).alias("weight"), F.col(m).alias("score"), F.lit(m == "quality").alias("required"), F.lit(False).alias("failed")) for m, w in WEIGHTS.items()
    ]))
    return weighted_mean(rows.select("doc_id", each.alias("r")).select("doc_id", "r.*"), ["doc_id"])


def gates(rows: DataFrame) -> DataFrame:
    toxic = F.when(F.col("toxic") == 1, lit(0)).when(F.col("toxic").isNotNull(), lit(1))
    quality = F.when(F.col("quality") == 1, lit(1)).when(F.col("quality").isNotNull(), lit(0.5))
    sure = F.when(F.col("doc_id") % 5 == 0, lit(0.8)).otherwise(lit(0.95))
    each = F.explode(F.array(F.struct(toxic.alias("multiplier"), sure.alias("confidence")), F.struct(quality.alias("multiplier"), sure.alias("confidence"))))
    return gate_product(rows.select("doc_id", each.alias("g")).select("doc_id", "g.*"), ["doc_id"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, mean, unresolved, gate, n_unresolved, base, cover, score: all that decisions are made from."""
    rows = results(spark, sf_dir)
    s = rows.select("doc_id", "source", "toxic").join(means(rows), "doc_id").join(gates(rows), "doc_id")
    base = base_score(F.col("gate"), F.col("value"))
    complete = (F.size("unresolved") == 0) & (F.col("n_unresolved") == 0)
    s = s.withColumn("base", base).withColumn("complete", complete).withColumn("scene", F.when(F.col("doc_id") % 3 != 0, lit(0.7)))
    has_scene = F.col("doc_id") % 2 == 0
    cover = coverage(F.col("base"), F.col("complete"), F.col("scene"), F.lit(True), has_scene)
    return s.withColumn("cover", cover).withColumn("full", full_score(F.col("cover"), F.col("base"), F.col("value"), F.col("gate"), F.col("scene"), lit(1), 0.55, has_scene))


SCORED = f"""{ROWS},
b AS (SELECT *, CASE WHEN gate = 0 AND mean IS NULL THEN 0::double ELSE 100::double * gate * mean END AS base, s_quality IS NOT NULL AND n_unresolved = 0 AS complete,
  CASE WHEN doc_id % 3 <> 0 THEN 0.7::double END AS scene, doc_id % 2 = 0 AS has_scene FROM p),
c AS (SELECT *, CASE WHEN base IS NULL THEN 'UNASSESSABLE' WHEN NOT has_scene THEN CASE WHEN complete THEN 'FULL' ELSE 'DEGRADED' END WHEN scene IS NULL THEN 'BASE_ONLY' WHEN complete THEN 'FULL' ELSE 'DEGRADED' END AS cover FROM b),
f AS (SELECT *, CASE WHEN cover = 'FULL' THEN CASE WHEN has_scene THEN 100::double * gate * 1::double * (0.55::double * mean + {1 - 0.55}::double * scene) ELSE base END END AS full_ FROM c)"""


@query(
    "q23_weighted_mean_with_na",
    f"WITH {ROWS} SELECT doc_id, round(mean, 6) AS score, 2 + (s_quality IS NOT NULL)::int AS n_scored, CASE WHEN s_quality IS NULL THEN 'quality' ELSE '' END AS unresolved FROM w",
)
def weighted_mean_with_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over what has a score; a required metric without one is unresolved."""
    return means(results(spark, sf_dir)).select("doc_id", round6(F.col("value")).alias("score"), "n_scored", F.array_join("unresolved", ",").alias("unresolved"))


@query("q25_gate_product", f"WITH {ROWS} SELECT doc_id, gate, n_unresolved, n_low AS n_low_confidence FROM p")
def gate_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of the gates of each document."""
    return gates(results(spark, sf_dir))


@query("q26_full_score_and_coverage", f"WITH {SCORED} SELECT doc_id, round(base, 6) AS base, cover, round(full_, 6) AS score FROM f")
def full_score_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score, coverage and full score."""
    return scored(spark, sf_dir).select("doc_id", round6(F.col("base")).alias("base"), "cover", round6(F.col("full")).alias("score"))


@query(
    "q27_decision_ladder",
    f"""WITH {SCORED}, d AS (
  SELECT *, CASE WHEN n_low = 0 AND gate = 0 THEN 'FAIL' WHEN cover <> 'FULL' OR (s_quality IS NULL)::int + n_unresolved > 0 THEN 'REVIEW' WHEN mean < 0.3 THEN 'REVIEW' WHEN full_ IS NULL THEN 'ERROR'
    WHEN full_ >= 80 THEN 'PASS' WHEN full_ >= 60 THEN 'REVIEW' ELSE 'FAIL' END AS decision FROM f)
SELECT source, decision, count(*) AS n, round(avg(full_), 6) AS score FROM d GROUP BY source, decision""",
)
def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by source."""
    s = scored(spark, sf_dir)
    open_ = F.size("unresolved") + F.col("n_unresolved")
    made = decision(F.col("gate"), F.col("n_low_confidence") == 0, F.col("cover"), open_, lit(1), ~(F.col("value") < 0.3), F.col("full"))
    return s.withColumn("decision", made).groupBy("source", "decision").agg(F.count(F.lit(1)).alias("n"), round6(F.avg("full")).alias("score"))


@query(
    "q28_training_tracks",
    f"""WITH {SCORED}, t AS (SELECT doc_id, toxic, base, s_quality, unnest(['visual', 'layout', 'content', 'full_deck']) AS track FROM f)
SELECT doc_id, track, CASE WHEN coalesce(toxic = 1, false) THEN 'REJECT' WHEN doc_id % 19 = 0 AND track <> 'visual' THEN 'REJECT' WHEN base < 60 THEN 'REJECT'
  WHEN s_quality IS NULL AND track IN ('content', 'full_deck') THEN 'REVIEW' WHEN base IS NULL THEN 'REVIEW' WHEN base >= 80 THEN 'TRAIN' ELSE 'REVIEW' END AS decision FROM t""",
)
def training_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of each document to the four training tracks."""
    t = scored(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, ("visual", "layout", "content", "full_deck")))).alias("track"))
    missing = F.array_contains("unresolved", "quality") & F.col("track").isin("content", "full_deck")
    critical = F.coalesce(F.col("toxic") == 1, F.lit(False))
    made = track_decision(critical, F.col("doc_id") % 19 == 0, F.col("track") == "visual", F.col("base"), missing)
    return t.select("doc_id", "track", made.alias("decision"))


@query(
    "q47_profile_validity",
    """WITH p AS (SELECT user_id AS profile, event_type AS metric, round(avg(value) - 20, 2) AS weight, max(event_id) % 4 = 0 AS gate, count(*) % 3 <> 0 AS required FROM events GROUP BY ALL)
SELECT profile, count(*) FILTER (WHERE weight < 0) AS n_negative, count(*) FILTER (WHERE weight > 0 AND gate) AS n_both, count(*) FILTER (WHERE required AND weight <= 0) AS n_required_unweighted,
  count(*) FILTER (WHERE weight < 0 OR (weight > 0 AND gate) OR (required AND weight <= 0)) = 0 AS valid FROM p GROUP BY profile""",
)
def profile_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a profile's weights; a user is a profile, the mean value of an event type, less 20, the
    weight of a metric."""
    p = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("profile"), F.col("event_type").alias("metric")).agg(
        F.round(F.avg("value") - 20, 2).alias("weight"), (F.max("event_id") % 4 == 0).alias("gate"), (F.count(F.lit(1)) % 3 != 0).alias("required")
    )
    negative, both, bare = F.col("weight") < 0, (F.col("weight") > 0) & F.col("gate"), F.col("required") & (F.col("weight") <= 0)
    return p.groupBy("profile").agg(
        F.count_if(negative).alias("n_negative"), F.count_if(both).alias("n_both"), F.count_if(bare).alias("n_required_unweighted"),
        (F.count_if(negative | both | bare) == 0).alias("valid"),
    )


@query(
    "q62_track_averages",
    f"""WITH {ROWS} SELECT source, round(avg(s_length) * 100, 6) AS visual, round(avg(s_lines) * 100, 6) AS layout, round(avg(s_quality) * 100, 6) AS content, count(*) FILTER (WHERE s_quality IS NULL) AS n_unlabelled FROM m GROUP BY source""",
)
def track_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track scores of each source."""
    return results(spark, sf_dir).groupBy("source").agg(
        round6(F.avg("length") * 100).alias("visual"), round6(F.avg("lines") * 100).alias("layout"), round6(F.avg("quality") * 100).alias("content"), F.count_if(F.col("quality").isNull()).alias("n_unlabelled")
    )
