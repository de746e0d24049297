"""Reducers: from observations of one metric to one score for each group.

An observation frame has the group columns and `eff` (the effective score, null for NA and ERROR), `importance`,
`confidence`, `severity`, `key_unit`, `critical`. Every reducer is one hash aggregate, whose map side shrinks a hot
group before the shuffle; only the nearest-rank percentile keeps the distinct scores of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scores import SEVERITIES, lit, severity_rank

CRITICAL_CAP, LEAST_OBSERVABILITY = 0.34, 0.60
#: What sums of doubles in another order take from a share: one that is `least` in exact numbers isn't below it.
SUM_NOISE = 1e-9


def p20(x: str) -> Column:
    """Nearest-rank 20th percentile: sorted[max(1, ceil(n / 5)) - 1]."""
    return F.expr(f"percentile_disc(0.2D) WITHIN GROUP (ORDER BY {x})")


def page_quality(score: str = "eff", key: str = "key_unit") -> Column:
    """.60 mean + .25 p20 + .15 worst key unit; without key units the first two over .85."""
    worst = F.min(F.when(F.col(key), F.col(score)))
    base = lit(0.60) * F.avg(score) + lit(0.25) * p20(score)
    return F.when(worst.isNull(), base / lit(0.85)).otherwise(base + lit(0.15) * worst)


def pair_quality(score: str = "eff") -> Column:
    """.70 mean + .30 p20."""
    return lit(0.70) * F.avg(score) + lit(0.30) * p20(score)


def importance_coverage(score: str = "eff", weight: str = "importance") -> Column:
    """Importance-weighted mean; the plain mean where the weights sum to 0."""
    w = F.when(F.col(score).isNotNull(), F.col(weight))
    return F.coalesce(F.try_divide(F.sum(F.col(score) * F.col(weight)), F.sum(w)), F.avg(score))


def observability(score: str = "eff", weight: str = "importance") -> Column:
    """Importance of what was scored over all importance; by count where that sums to 0."""
    w = F.coalesce(F.sum(F.when(F.col(score).isNotNull(), F.col(weight))), lit(0))
    return F.coalesce(F.try_divide(w, F.sum(weight)), F.count(score) / F.count(F.lit(1)))


def confidence(score: str = "eff", weight: str = "importance", value: str = "confidence") -> Column:
    """Importance-weighted confidence of what was scored; its mean where the weights sum to 0; 1 if nothing was."""
    own = F.when(F.col(score).isNotNull(), F.col(value))
    w = F.when(F.col(score).isNotNull(), F.col(weight))
    return F.coalesce(F.try_divide(F.sum(own * F.col(weight)), F.sum(w)), F.avg(own), lit(1))


def max_severity(severity: str = "severity") -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(severity_rank(F.col(severity))))


def has_critical() -> Column:
    return F.coalesce(
        F.bool_or((F.col("severity") == "CRITICAL") & (F.col("critical") | F.col("key_unit")) & F.col("eff").isNotNull()), F.lit(False)
    )


def observed_enough(found: DataFrame, observations: DataFrame, by: Sequence[str], order: Sequence[str] = (), least: float = LEAST_OBSERVABILITY) -> DataFrame:
    """`found` (the group columns, observability: an aggregate of `observations`) with enough: whether a group was observed
    to `least`.

    Of a group at just `least` the sums of doubles tell by their order alone. Without `order` it is observed enough. With
    it, its rows are summed anew in the order of those columns, as one that reads the table row by row sums them, however
    they are dealt; only the rows of such groups are shuffled. A null group is compared as it was summed.
    """
    share = F.col("observability")
    if not order:
        return found.withColumn("enough", share >= least - SUM_NOISE)
    near = found.where(F.abs(share - least) <= SUM_NOISE).select(*by)
    rows = observations.join(near, list(by), "left_semi").repartition(*by).sortWithinPartitions(*by, *order)
    again = rows.groupBy(*by).agg(observability().alias("in_order"))
    return found.join(again, list(by), "left").withColumn("enough", F.coalesce("in_order", share) >= least).drop("in_order")


def reduce_metric(
    observations: DataFrame,
    by: Sequence[str],
    score: Column,
    required: bool = True,
    cap: float = CRITICAL_CAP,
    least: float = LEAST_OBSERVABILITY,
    order: Sequence[str] = (),
) -> DataFrame:
    """The group columns, status, score, uncapped_score, observability, confidence, severity, n_scored, n_missing.

    A group with nothing scored, or a required one observed to less than `least`, is NA; observed to just `least` it is
    scored, in whatever order its rows are summed, or as they are summed in the order of the columns `order`, if any. A
    critical finding caps the score at `cap`; the uncapped score stays beside it.
    """
    found = observations.groupBy(*by).agg(
        score.alias("raw"),
        observability().alias("observability"),
        confidence().alias("confidence"),
        max_severity().alias("severity"),
        has_critical().alias("held"),
        F.count("eff").alias("n_scored"),
        (F.count(F.lit(1)) - F.count("eff")).alias("n_missing"),
    )
    missing = F.col("n_scored") == 0
    if required:
        found = observed_enough(found, observations, by, order, least)
        missing = missing | ~F.col("enough")
    capped = F.when(F.col("held"), F.least(F.col("raw"), lit(cap))).otherwise(F.col("raw"))
    return found.select(
        *by,
        F.when(missing, "NA").otherwise("SCORED").alias("status"),
        F.when(~missing, capped).alias("score"),
        F.when(~missing, F.col("raw")).alias("uncapped_score"),
        "observability",
        "confidence",
        "severity",
        "n_scored",
        "n_missing",
    )
