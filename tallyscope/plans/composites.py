"""Queries from observations to quality attributes: the reducer graph over `events` read as observations of decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.scores import lit, lookup
from tallyscope.operators.composites import AUTHORSHIP_MODEL, COVERAGE, FUSED, GRAPH, PAGE, PAIR, RECOVERED, quality_attributes, reduce_graph
from tallyscope.plans.observations import CONFIDENCE, HELD, OBS, OBSERVABILITY, observations
from tallyscope.plans.observations import COVERAGE as COVERAGE_SQL
from tallyscope.plans.observations import PAGE_QUALITY as PAGE_SQL
from tallyscope.plans.registry import query

#: An event's type and its k modulo 6 name the metric it observes; the last four feed no attribute.
METRICS = {
    "click": ("slide_content_presence", "slide_reading_load", "document_structure", "title_body_alignment", "language_consistency", "slide_role"),
    "view": ("raster_content_structure_vlm", "raster_language_consistency_vlm", "slide_geometry_integrity", "slide_typography_functional", "slide_pixel_contrast", "slide_editability"),
    "purchase": ("media_integrity", "crop_geometry_risk", "effective_image_resolution", "transition_coherence_proxy", "duplicate_slide", "alt_text"),
    "signup": ("authorship_specificity_signals", "requirement_satisfaction", "audience_journey", "fact_claim_support", "source_claim_alignment", "render_availability_parity"),
    "error": ("key_point_coverage", "numeric_claim_alignment", "compression_richness_observation", "source_traceability", "asset_presence", "chart_series_accuracy"),
}
SCOPES = {m: r.scope for r in GRAPH for m in r.inputs}
SCENES = ("READY_MADE", "TEXT_TO_PPT", "PROJECT_SUMMARY", "MULTIMODAL")
MODELS = (*[m for *_, m in FUSED], AUTHORSHIP_MODEL)
OWNERS = (*GRAPH[0].inputs, *GRAPH[1].inputs)
RASTER = (*GRAPH[2].inputs, *GRAPH[3].inputs)


def deck_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with metric, scope and scene. Of every third run all pages are images, of every next one the even
    pages: what is read from text is NA there, and only the first kind has pages read by a model."""
    obs = observations(spark, sf_dir)
    names = F.create_map(*[x for kind, own in METRICS.items() for x in (F.lit(kind), F.array(*map(F.lit, own)))])
    metric = F.get(F.try_element_at(names, F.col("metric")), F.col("k") % 6)
    flat = (F.col("run") % 3 == 0) | ((F.col("run") % 3 == 1) & (F.col("page") % 2 == 0))
    gone = F.col("metric").isin(*OWNERS) & flat
    return (
        obs.withColumn("metric", metric)
        .withColumn("scope", F.coalesce(lookup(F.col("metric"), SCOPES), F.lit("PAGE")))
        .withColumn("scene", F.element_at(F.array(*map(F.lit, SCENES)), (F.col("run") % 4 + 1).cast("int")))
        .where(~F.col("metric").isin(*RASTER) | (F.col("run") % 3 == 0))
        .withColumn("confidence", lit(0.5) + (F.col("k") % 50) / lit(101))
        .withColumns({"eff": F.when(~gone, F.col("eff")), "status": F.when(gone, "NA").otherwise(F.col("status"))})
    )


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, metric, score, confidence: what models scored, from the views of a page's number; some criteria have none."""
    metric = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("page") % len(MODELS) + 1).cast("int"))
    views = observations(spark, sf_dir).where("metric = 'view' and eff is not null").withColumns({"metric": metric, "confidence": lit(0.5) + (F.col("k") % 50) / lit(101)})
    found = views.groupBy("run", "metric").agg(F.avg("eff").alias("score"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    return found.where("n % 4 <> 0").drop("n")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


GRAPH_SQL = f"""{OBS},
named(metric, name, scope, place) AS (VALUES {_values((kind, m, SCOPES.get(m, "PAGE"), i) for kind, own in METRICS.items() for i, m in enumerate(own))}),
placed AS (
  SELECT o.* EXCLUDE (metric, eff, confidence), n.name AS metric, n.scope, 0.5::double + (k % 50) / 101::double AS confidence,
    CASE WHEN NOT (n.name IN ({", ".join(f"'{m}'" for m in OWNERS)}) AND (run % 3 = 0 OR (run % 3 = 1 AND page % 2 = 0))) THEN eff END AS eff
  FROM obs o JOIN named n ON o.metric = n.metric AND o.k % 6 = n.place
  WHERE n.name NOT IN ({", ".join(f"'{m}'" for m in RASTER)}) OR run % 3 = 0),
feeds(metric, reducer) AS (VALUES {_values((m, r.name) for r in GRAPH for m in r.inputs)}),
reducers(reducer, kind, own_scope, required, sample) AS (VALUES {_values((r.name, r.kind, r.scope, r.required, r.sample or 0) for r in GRAPH)}),
per AS (
  SELECT run, reducer, kind, required, sample,
    CASE kind WHEN '{PAGE}' THEN {PAGE_SQL} WHEN '{PAIR}' THEN 0.70::double * avg(eff) + 0.30::double * quantile_disc(eff, 0.2) ELSE {COVERAGE_SQL} END AS raw,
    {OBSERVABILITY} AS observability, {CONFIDENCE} AS confidence, {HELD} AS held, max(rank) FILTER (WHERE eff IS NOT NULL) AS rank,
    count(eff) AS n_scored, count(*) AS n_units, sum(importance) AS total, sum(importance) FILTER (WHERE eff IS NOT NULL) AS sampled, count(*) FILTER (WHERE scope <> own_scope) AS n_misplaced
  FROM placed JOIN feeds USING (metric) JOIN reducers USING (reducer) GROUP BY run, reducer, kind, required, sample),
told AS (
  SELECT *, CASE WHEN n_misplaced > 0 THEN 'ERROR' WHEN n_scored = 0 OR (required AND observability < 0.6) THEN 'NA' ELSE 'SCORED' END AS status FROM per),
reduced AS (
  SELECT run, reducer, status, CASE WHEN status = 'SCORED' THEN round(CASE WHEN held THEN least(raw, 0.34::double) ELSE raw END, 6) END AS score,
    CASE WHEN status = 'SCORED' THEN round(raw, 6) END AS uncapped_score, round(observability, 6) AS observability,
    round(CASE WHEN sample > 0 AND n_scored >= least(sample, n_units) AND total > 0 THEN least(0.6::double, sampled / total) ELSE 0.6::double END, 6) AS least_observability,
    round(confidence, 6) AS confidence, CASE WHEN status = 'SCORED' THEN ['NONE', 'INFO', 'MINOR', 'MAJOR', 'CRITICAL'][rank] ELSE 'INFO' END AS severity, n_units, n_scored
  FROM told)"""


@query("q83_reducer_graph", f"WITH {GRAPH_SQL} SELECT * FROM reduced")
def reducer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reducer of every run, in one aggregation."""
    return reduce_graph(deck_observations(spark, sf_dir), ["run"], order=["event_id"])


def _attributes_sql() -> str:
    mild = lambda x: f"CASE WHEN {x} >= 0.7 THEN 'INFO' WHEN {x} IS NOT NULL THEN 'MINOR' ELSE 'INFO' END"
    rows = []
    columns = "status, score, confidence, severity, observability, mode, rule_score, model_score, page_coverage"
    for attribute, spare in RECOVERED:
        falls = "coalesce(r.status, 'NA') = 'NA' AND s.status = 'SCORED'"
        rows.append(
            f"SELECT d.run, '{attribute}' AS attribute, CASE WHEN {falls} THEN 'SCORED' ELSE coalesce(r.status, 'NA') END AS status, CASE WHEN {falls} THEN s.score ELSE r.score END AS score, "
            f"CASE WHEN {falls} THEN s.confidence ELSE coalesce(r.confidence, 1) END AS confidence, CASE WHEN {falls} THEN {mild('s.score')} ELSE coalesce(r.severity, 'INFO') END AS severity, "
            f"CASE WHEN {falls} THEN s.observability ELSE coalesce(r.observability, 0) END AS observability, CASE WHEN {falls} THEN 'RASTER_FALLBACK' ELSE 'REDUCED' END AS mode, "
            f"NULL::double AS rule_score, NULL::double AS model_score, CASE WHEN {falls} THEN s.n_scored / s.n_units END AS page_coverage FROM decks d "
            f"LEFT JOIN reduced r ON r.run = d.run AND r.reducer = '{attribute}' LEFT JOIN reduced s ON s.run = d.run AND s.reducer = '{spare}'"
        )
    for attribute, name, metric in FUSED:
        score = "least(m.score, CASE WHEN r.score IS NULL THEN 1::double ELSE 0.34::double + 0.66::double * r.score END)"
        score = f"CASE WHEN m.score IS NOT NULL THEN {score} END"
        rows.append(
            f"SELECT d.run, '{attribute}', CASE WHEN m.score IS NULL THEN 'NA' ELSE 'SCORED' END, {score}, CASE WHEN m.score IS NULL THEN 1::double ELSE least(0.9::double, coalesce(r.confidence, 1)) END, "
            f"{mild(score)}, coalesce(r.observability, 0), CASE WHEN m.score IS NULL THEN 'MODEL_MISSING' ELSE 'MODEL_UNDER_CAP' END, r.score, m.score, NULL FROM decks d "
            f"LEFT JOIN reduced r ON r.run = d.run AND r.reducer = '{name}' LEFT JOIN models m ON m.run = d.run AND m.metric = '{metric}'"
        )
    for attribute in ("authorship_specificity_v2", "authorship_specificity"):
        score = "CASE WHEN r.score IS NULL THEN m.score ELSE 0.3::double * r.score + 0.7::double * m.score END"
        rows.append(
            f"SELECT d.run, '{attribute}', CASE WHEN m.score IS NULL THEN 'NA' ELSE 'SCORED' END, {score}, CASE WHEN m.score IS NULL THEN 1::double ELSE least(0.85::double, "
            f"CASE WHEN r.score IS NULL THEN m.confidence ELSE 0.3::double * r.confidence + 0.7::double * m.confidence END) END, {mild(score)}, coalesce(r.observability, 0), "
            f"CASE WHEN m.score IS NULL THEN 'MODEL_MISSING' WHEN r.score IS NULL THEN 'MODEL_ONLY' ELSE 'RULE_AND_MODEL' END, r.score, m.score, NULL FROM decks d "
            f"LEFT JOIN reduced r ON r.run = d.run AND r.reducer = 'authorship_specificity_rule' LEFT JOIN models m ON m.run = d.run AND m.metric = '{AUTHORSHIP_MODEL}'"
        )
    scene = _values((r.name, r.scene) for r in GRAPH if r.scene)
    rows.append(
        f"SELECT d.run, g.reducer, coalesce(r.status, 'NA'), r.score, coalesce(r.confidence, 1), coalesce(r.severity, 'INFO'), coalesce(r.observability, 0), 'REDUCED', NULL, NULL, NULL "
        f"FROM decks d JOIN (VALUES {scene}) g(reducer, scene) USING (scene) LEFT JOIN reduced r ON r.run = d.run AND r.reducer = g.reducer"
    )
    whole = " UNION ALL ".join(rows)
    models = ", ".join(f"'{m}'" for m in MODELS)
    return f"""WITH {GRAPH_SQL},
decks AS (SELECT DISTINCT run, [{", ".join(f"'{s}'" for s in SCENES)}][run % 4 + 1] AS scene FROM obs),
models AS (
  SELECT run, [{models}][page % {len(MODELS)} + 1] AS metric, avg(eff) AS score, avg(0.5::double + (k % 50) / 101::double) AS confidence FROM obs WHERE metric = 'view' AND eff IS NOT NULL GROUP BY ALL HAVING count(*) % 4 <> 0),
attributes AS ({whole})
SELECT run, attribute, status, round(score, 6) AS score, round(confidence, 6) AS confidence, severity, observability, mode, round(rule_score, 6) AS rule_score, round(model_score, 6) AS model_score,
  round(page_coverage, 6) AS page_coverage FROM attributes"""


@query("q84_quality_attributes", _attributes_sql())
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality attributes of every run, with what a model recovered where all pages are images."""
    obs = deck_observations(spark, sf_dir)
    scene = F.element_at(F.array(*map(F.lit, SCENES)), (F.col("run") % 4 + 1).cast("int"))
    decks = observations(spark, sf_dir).select("run", scene.alias("scene")).distinct()
    found = quality_attributes(decks, reduce_graph(obs, ["run"], order=["event_id"]), model_scores(spark, sf_dir), ["run"])
    return found.withColumns({c: F.round(F.col(c), 6) for c in ("rule_score", "model_score")})
