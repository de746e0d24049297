"""The graph from observations to quality attributes, compiled into one plan.

A table of reducers says which metrics feed which attribute, at which scope and by which kind of score. An observation is
routed by its metric to all reducers that read it; one aggregation, with a map side, reduces them all. What is left is a
few rows for each deck, from which the attributes follow: some are a reducer's result, some prefer an owner and fall back
on what a model recovered, some are a model's score under a cap from the rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scores import SEVERITIES, lit, lookup, round6, severity_rank
from tallyscope.operators import reduce as R
from tallyscope.operators.scoring import fuse, fuse_authorship

PAGE, PAIR, COVERAGE = "PAGE_QUALITY", "PAIR_QUALITY", "IMPORTANCE_COVERAGE"
SUMMARY = "PROJECT_SUMMARY"


class Reducer(NamedTuple):
    """What feeds a score: the metrics, the scope their observations must have, the kind of score; whether it is missing
    when too little was observed; how many pages its sample holds at most; the scene it belongs to."""

    name: str
    kind: str
    scope: str
    inputs: tuple[str, ...]
    required: bool = True
    sample: int | None = None
    scene: str | None = None


#: The reducers of the quality attributes and of the scenes.
GRAPH = (
    Reducer("content_structure", PAGE, "PAGE", ("slide_content_presence", "slide_reading_load", "document_structure", "title_body_alignment")),
    Reducer("language_consistency", COVERAGE, "DECK", ("language_consistency",)),
    Reducer("raster_content_structure_recovery", PAGE, "PAGE", ("raster_content_structure_vlm",), False, 4),
    Reducer("raster_language_consistency_recovery", COVERAGE, "PAGE", ("raster_language_consistency_vlm",), False, 8),
    Reducer("composition_rule", PAGE, "PAGE", ("slide_geometry_integrity",)),
    Reducer("typography_rule", PAGE, "PAGE", ("slide_typography_functional",)),
    Reducer("contrast_rule", PAGE, "PAGE", ("slide_pixel_contrast",), False),
    Reducer("visual_communication_rule", COVERAGE, "OBJECT", ("media_integrity", "crop_geometry_risk", "effective_image_resolution"), False),
    Reducer("visual_system_rule", PAIR, "SLIDE_PAIR", ("transition_coherence_proxy", "duplicate_slide"), False),
    Reducer("authorship_specificity_rule", PAGE, "PAGE", ("authorship_specificity_signals",)),
    Reducer("instruction", COVERAGE, "REQUIREMENT", ("requirement_satisfaction",), scene="TEXT_TO_PPT"),
    Reducer("audience", COVERAGE, "DECK", ("audience_journey",), scene="TEXT_TO_PPT"),
    Reducer("fact_claim", COVERAGE, "DECK", ("fact_claim_support",), scene="TEXT_TO_PPT"),
    Reducer("source_claim", COVERAGE, "CLAIM", ("source_claim_alignment",), scene=SUMMARY),
    Reducer("key_point", COVERAGE, "REQUIREMENT", ("key_point_coverage",), scene=SUMMARY),
    Reducer("numeric", COVERAGE, "CLAIM", ("numeric_claim_alignment",), scene=SUMMARY),
    Reducer("compression_richness", COVERAGE, "DECK", ("compression_richness_observation",), scene=SUMMARY),
    Reducer("traceability", COVERAGE, "ASSET", ("source_traceability",), scene=SUMMARY),
    Reducer("asset_coverage", COVERAGE, "ASSET", ("asset_presence",), scene="MULTIMODAL"),
    Reducer("asset_presentation", COVERAGE, "ASSET", ("asset_presence",), scene="MULTIMODAL"),
    Reducer("crop_image_integrity", COVERAGE, "OBJECT", ("crop_geometry_risk",), False, scene="MULTIMODAL"),
    Reducer("chart_fidelity", COVERAGE, "CHART_SERIES", ("chart_series_accuracy",), scene="MULTIMODAL"),
    Reducer("media_integrity", COVERAGE, "OBJECT", ("media_integrity",), False, scene="MULTIMODAL"),
)
#: The attributes that are a model's score under the cap of a rule, with the rule's reducer and the model's metric.
FUSED = (
    ("composition_craft", "composition_rule", "structured_vlm_composition_layout"),
    ("typography_craft", "typography_rule", "structured_vlm_typography_legibility"),
    ("palette_craft", "contrast_rule", "structured_vlm_color_contrast"),
    ("visual_communication", "visual_communication_rule", "structured_vlm_imagery_data_visualization"),
    ("visual_system_sequence", "visual_system_rule", "structured_vlm_cross_slide_consistency"),
)
AUTHORSHIP_MODEL = "structured_vlm_authorship_specificity"
#: The attributes with an owner, and the reducer of what a model recovers where the owner is missing.
RECOVERED = (
    ("content_structure", "raster_content_structure_recovery"),
    ("language_consistency", "raster_language_consistency_recovery"),
)


def reduce_graph(observations: DataFrame, by: Sequence[str], graph: Sequence[Reducer] = GRAPH, order: Sequence[str] = ()) -> DataFrame:
    """The group columns, reducer, status, score, uncapped_score, observability, least_observability, confidence,
    severity, n_units, n_scored: one row for each group and reducer that some observation feeds.

    `observations` has the columns of `operators.reduce` and metric and scope. An observation counts for every reducer
    that reads its metric; one that no reducer reads counts nowhere. A reducer with observations of another scope than its
    own is in ERROR and has no score. One without scored observations is NA, and so is a required one that was observed to
    less than .60; at just .60 the sums in the order of the columns `order` tell, if any are named, and else it is scored.
    least_observability is .60 or, of a reducer over a bounded sample that is complete, the share of
    importance sampled. Null groups are a group of their own; an empty table gives an empty result.
    """
    feeds: dict[str, list[str]] = {}
    for r in graph:
        for metric in r.inputs:
            feeds.setdefault(metric, []).append(r.name)
    routes = F.create_map(*[x for m, names in feeds.items() for x in (F.lit(m), F.array(*map(F.lit, names)))])
    routed = observations.where(F.col("metric").isin(*feeds)).withColumn("reducer", F.explode(F.try_element_at(routes, F.col("metric"))))
    own = lambda f: lookup(F.col("reducer"), {r.name: f(r) for r in graph})
    scored = F.col("eff").isNotNull()
    per = routed.groupBy(*by, "reducer").agg(
        R.page_quality().alias("page"), R.pair_quality().alias("pair"), R.importance_coverage().alias("coverage"),
        R.observability().alias("observability"), R.confidence().alias("confidence"), R.has_critical().alias("held"),
        F.max(F.when(scored, severity_rank(F.col("severity")))).alias("rank"),
        F.count("eff").alias("n_scored"), F.count(F.lit(1)).alias("n_units"), F.sum("importance").alias("total"),
        F.sum(F.when(scored, F.col("importance"))).alias("sampled"),
        F.count_if(~F.col("scope").eqNullSafe(own(lambda r: r.scope))).alias("n_misplaced"),
    )
    per = R.observed_enough(per, routed, [*by, "reducer"], order)
    kind = own(lambda r: r.kind)
    raw = F.when(kind == PAGE, F.col("page")).when(kind == PAIR, F.col("pair")).otherwise(F.col("coverage"))
    required = own(lambda r: r.required)
    missing = (F.col("n_scored") == 0) | (required & ~F.col("enough"))
    status = F.when(F.col("n_misplaced") > 0, "ERROR").when(missing, "NA").otherwise("SCORED")
    capped = F.when(F.col("held"), F.least(raw, lit(R.CRITICAL_CAP))).otherwise(raw)
    sample = own(lambda r: r.sample or 0)
    complete = (sample > 0) & (F.col("n_scored") >= F.least(sample, F.col("n_units"))) & (F.col("total") > 0)
    least = F.when(complete, F.least(lit(R.LEAST_OBSERVABILITY), F.col("sampled") / F.col("total"))).otherwise(lit(R.LEAST_OBSERVABILITY))
    return per.withColumn("status", status).select(
        *by, "reducer", "status", *[F.when(F.col("status") == "SCORED", round6(x)).alias(name) for x, name in ((capped, "score"), (raw, "uncapped_score"))],
        round6(F.col("observability")).alias("observability"), round6(least).alias("least_observability"), round6(F.col("confidence")).alias("confidence"),
        F.when(F.col("status") == "SCORED", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank"))).otherwise("INFO").alias("severity"), "n_units", "n_scored",
    )


def _as_map(rows: DataFrame, by: Sequence[str], key: str, values: Sequence[str], name: str) -> DataFrame:
    """One map for each group: a few entries, as many as there are reducers or models."""
    entry = F.struct(F.col(key), F.struct(*values))
    return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def quality_attributes(decks: DataFrame, reduced: DataFrame, models: DataFrame, by: Sequence[str], graph: Sequence[Reducer] = GRAPH) -> DataFrame:
    """The group columns, attribute, status, score, confidence, severity, observability, mode, rule_score, model_score,
    page_coverage: one row for each attribute of every row of `decks` (the group columns, scene).

    `reduced` is a result of reduce_graph, `models` (the group columns, metric, score, confidence) what models scored, one
    row for each metric. mode says how the score came about. An attribute with an owner and a recovery takes the recovery
    only where the owner is NA: the two are never averaged, and page_coverage says how many of the units were sampled. A
    fused attribute without a model's score is NA, whatever the rules say; without a rule's score nothing caps the model.
    Attributes of a scene stand only in decks of that scene. A deck without observations has all its attributes as NA.
    """
    of = _as_map(reduced, by, "reducer", ("status", "score", "observability", "confidence", "severity", "n_units", "n_scored"), "reduced")
    seen = _as_map(models.where("score is not null"), by, "metric", ("score", "confidence"), "models")
    whole = decks
    for side in (of, seen):
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
        both = same[0]
        for s in same[1:]:
            both = both & s
        whole = whole.alias("l").join(side.alias("r"), both, "left").select("l.*", f"r.{side.columns[-1]}")
    rule = lambda name, field: F.try_element_at(F.col("reduced"), F.lit(name))[field]
    model = lambda name, field: F.try_element_at(F.col("models"), F.lit(name))[field]
    none = F.lit(None).cast("double")
    mild = lambda score: F.when(score >= 0.70, "INFO").when(score.isNotNull(), "MINOR").otherwise("INFO")
    sure = lambda name: F.coalesce(rule(name, "confidence"), lit(1))
    seen_of = lambda name: F.coalesce(rule(name, "observability"), lit(0))

    def row(attribute: str, status: Column, score: Column, confidence: Column, severity: Column, observed: Column, mode: Column, rules=none, models=none, pages=none) -> Column:
        return F.struct(
            F.lit(attribute).alias("attribute"), status.alias("status"), round6(score).alias("score"), round6(confidence).alias("confidence"), severity.alias("severity"),
            observed.alias("observability"), mode.alias("mode"), rules.alias("rule_score"), models.alias("model_score"), round6(pages).alias("page_coverage"),
        )

    def plain(r: Reducer) -> Column:
        status = F.coalesce(rule(r.name, "status"), F.lit("NA"))
        return row(r.name, status, rule(r.name, "score"), sure(r.name), F.coalesce(rule(r.name, "severity"), F.lit("INFO")), seen_of(r.name), F.lit("REDUCED"))

    def recovered(attribute: str, spare: str) -> Column:
        status, score = F.coalesce(rule(attribute, "status"), F.lit("NA")), rule(spare, "score")
        falls = (status == "NA") & F.coalesce(rule(spare, "status") == "SCORED", F.lit(False))
        pick = lambda then, other: F.when(falls, then).otherwise(other)
        return row(
            attribute, pick(F.lit("SCORED"), status), pick(score, rule(attribute, "score")), pick(sure(spare), sure(attribute)),
            pick(mild(score), F.coalesce(rule(attribute, "severity"), F.lit("INFO"))), pick(seen_of(spare), seen_of(attribute)),
            pick(F.lit("RASTER_FALLBACK"), F.lit("REDUCED")), pages=pick(rule(spare, "n_scored") / rule(spare, "n_units"), none),
        )

    def fused(attribute: str, name: str, metric: str) -> Column:
        score, has = fuse(model(metric, "score"), rule(name, "score")), model(metric, "score").isNotNull()
        return row(
            attribute, F.when(has, "SCORED").otherwise("NA"), score, F.when(has, F.least(lit(0.90), sure(name))).otherwise(lit(1)), mild(score), seen_of(name),
            F.when(has, "MODEL_UNDER_CAP").otherwise("MODEL_MISSING"), rule(name, "score"), model(metric, "score"),
        )

    def authorship(attribute: str) -> Column:
        name, score_of = "authorship_specificity_rule", model(AUTHORSHIP_MODEL, "score")
        has, ruled = score_of.isNotNull(), rule(name, "score").isNotNull()
        score, trust = fuse_authorship(score_of, rule(name, "score")), F.coalesce(model(AUTHORSHIP_MODEL, "confidence"), lit(0))
        confidence = F.least(lit(0.85), F.when(ruled, lit(0.30) * sure(name) + lit(0.70) * trust).otherwise(trust))
        mode = F.when(~has, "MODEL_MISSING").when(ruled, "RULE_AND_MODEL").otherwise("MODEL_ONLY")
        return row(attribute, F.when(has, "SCORED").otherwise("NA"), score, F.when(has, confidence).otherwise(lit(1)), mild(score), seen_of(name), mode, rule(name, "score"), score_of)

    rows = [recovered(*x) for x in RECOVERED] + [fused(*x) for x in FUSED] + [authorship("authorship_specificity_v2"), authorship("authorship_specificity")]
    scenes: dict[str, list[Reducer]] = {}
    for r in graph:
        if r.scene is not None:
            scenes.setdefault(r.scene, []).append(r)
    staged = F.when(F.lit(False), F.array(rows[0]))
    for scene, own in scenes.items():
        staged = staged.when(F.col("scene") == scene, F.array(*map(plain, own)))
    every = F.concat(F.array(*rows), F.coalesce(staged, F.filter(F.array(rows[0]), lambda x: F.lit(False))))
    return whole.select(*by, F.inline(every))
