"""Scores, decisions and admission to training tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scores import ladder, lit

PASS_AT, REVIEW_AT = 80.0, 60.0


def weighted_mean(rows: DataFrame, by: Sequence[str], weight: str = "weight", score: str = "score") -> DataFrame:
    """The group columns, value, n_scored and unresolved (sorted metrics that are required or failed, without score).

    `rows` holds one row for each group and weighted metric, so the outer join of weights with results has been made:
    metric, weight, score, required, failed. The mean is over the weights of what has a score.
    """
    counts = (F.col(weight) > 0) & F.col(score).isNotNull()
    open_ = F.when((F.col(weight) > 0) & F.col(score).isNull() & (F.col("required") | F.col("failed")), F.col("metric"))
    return rows.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(counts, F.col(weight) * F.col(score))), F.sum(F.when(counts, F.col(weight)))).alias("value"),
        F.count_if(counts).alias("n_scored"),
        F.array_sort(F.collect_set(open_)).alias("unresolved"),
    )


def construct_mean(rows: DataFrame, by: Sequence[str], construct: str = "construct", own_weight: str = "construct_weight") -> DataFrame:
    """weighted_mean within each construct, then over constructs; a construct without a score is unresolved."""
    inner = weighted_mean(rows, [*by, construct, own_weight])
    has = F.col("value").isNotNull() & (F.col(own_weight) > 0)
    return inner.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(has, F.col(own_weight) * F.col("value"))), F.sum(F.when(has, F.col(own_weight)))).alias("score"),
        F.array_sort(
            F.array_union(
                F.array_distinct(F.flatten(F.collect_list("unresolved"))),
                F.collect_set(F.when(F.col("value").isNull(), F.concat(F.lit("construct:"), F.col(construct)))),
            )
        ).alias("unresolved"),
    )


def gate_product(gates: DataFrame, by: Sequence[str], least_confidence: float = 0.90) -> DataFrame:
    """The group columns, gate, n_unresolved, n_low_confidence.

    Gates multiply (1, .5 or 0). One that isn't 1 but isn't trusted either counts as 1 and is unresolved and of low
    confidence; one without a multiplier is unresolved.
    """
    m = F.col("multiplier")
    doubtful = m.isNotNull() & (m != 1) & (F.col("confidence") < least_confidence)
    used = F.when(doubtful | m.isNull(), lit(1)).otherwise(m)
    return gates.groupBy(*by).agg(
        F.coalesce(F.product(used), lit(1)).alias("gate"),
        F.count_if(doubtful | m.isNull()).alias("n_unresolved"),
        F.count_if(doubtful).alias("n_low_confidence"),
    )


def base_score(gate: Column, mean: Column) -> Column:
    """100 * gate * mean; a zero gate decides without a mean."""
    return F.when((gate == 0) & mean.isNull(), lit(0)).otherwise(lit(100) * gate * mean)


def coverage(base: Column, base_complete: Column, scene: Column, scene_complete: Column, has_scene: Column) -> Column:
    return ladder(
        (base.isNull(), "UNASSESSABLE"),
        (~has_scene, F.when(base_complete, "FULL").otherwise("DEGRADED")),
        (scene.isNull(), "BASE_ONLY"),
        (base_complete & scene_complete, "FULL"),
        otherwise="DEGRADED",
    )


def full_score(cover: Column, base: Column, base_mean: Column, base_gate: Column, scene_mean: Column, scene_gate: Column, share: float, has_scene: Column) -> Column:
    """Only under full coverage: the base alone, or both parts in `share` under both gates."""
    both = lit(100) * base_gate * scene_gate * (lit(share) * base_mean + lit(1 - share) * scene_mean)
    return F.when(cover == "FULL", F.when(has_scene, both).otherwise(base))


def decision(
    base_gate: Column, base_confident: Column, cover: Column, unresolved: Column, scene_gate: Column, floors_met: Column, score: Column
) -> Column:
    """The decision ladder: a confident failed base gate; gaps in the evidence; a failed scene gate; a metric floor; no
    score; then the thresholds."""
    return ladder(
        (base_confident & (base_gate.isNull() | (base_gate == 0)), "FAIL"),
        ((cover != "FULL") | (unresolved > 0), "REVIEW"),
        (scene_gate == 0, "FAIL"),
        (~floors_met, "REVIEW"),
        (score.isNull(), "ERROR"),
        (score >= PASS_AT, "PASS"),
        (score >= REVIEW_AT, "REVIEW"),
        otherwise="FAIL",
    )


def track_decision(critical: Column, raster_only: Column, visual: Column, score: Column, content_missing: Column) -> Column:
    """Admission to one training track, in this order: critical defect, raster-only text, low score, missing content
    evidence, no score, the threshold."""
    return ladder(
        (critical, "REJECT"),
        (raster_only & ~visual, "REJECT"),
        (score < REVIEW_AT, "REJECT"),
        (content_missing, "REVIEW"),
        (score.isNull(), "REVIEW"),
        (score >= PASS_AT, "TRAIN"),
        otherwise="REVIEW",
    )


def fuse(model: Column, rule: Column) -> Column:
    """The model's score under a cap from the rules; null without a model."""
    return F.when(model.isNotNull(), F.least(model, F.when(rule.isNull(), lit(1)).otherwise(lit(0.34) + lit(0.66) * rule)))


def fuse_authorship(model: Column, rule: Column) -> Column:
    return F.when(model.isNotNull(), F.when(rule.isNull(), model).otherwise(lit(0.30) * rule + lit(0.70) * model))


def cap_model_score(score: Column, n_positive: Column, severity: Column) -> Column:
    """The caps on a model's score, in order: over .79 needs two positive signals, over .94 three and no defect; a
    MAJOR defect allows .64, a CRITICAL one .34."""
    s = F.when((score > 0.79) & (n_positive < 2), lit(0.79)).otherwise(score)
    s = F.when((s > 0.94) & ((n_positive < 3) | (severity != "NONE")), lit(0.94)).otherwise(s)
    return F.when(severity == "CRITICAL", F.least(s, lit(0.34))).when(severity == "MAJOR", F.least(s, lit(0.64))).otherwise(s)
