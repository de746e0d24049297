"""The integrity gate: defects that are widespread enough to be proposed, and their confirmation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scores import ladder, lit


def gate_candidates(observations: DataFrame, least_share: float = 0.20, least_key: int = 2) -> DataFrame:
    """run, metric, n, major_share, n_key_major, n_critical, candidate: by metric, CRITICAL if a critical finding is on
    a key or critical unit, MAJOR if a share of `least_share` or `least_key` key units are major, else null. Only scored
    observations count."""
    scored = observations.where("status = 'SCORED'")
    major = F.col("severity") == "MAJOR"
    found = scored.groupBy("run", "metric").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(major) / F.count(F.lit(1))).alias("major_share"),
        F.count_if(major & F.col("key_unit")).alias("n_key_major"),
        F.count_if((F.col("severity") == "CRITICAL") & (F.col("critical") | F.col("key_unit"))).alias("n_critical"),
    )
    widespread = (F.col("major_share") >= least_share) | (F.col("n_key_major") >= least_key)
    return found.withColumn("candidate", F.when(F.col("n_critical") > 0, "CRITICAL").when(widespread, "MAJOR"))


def confirm(candidates: DataFrame, findings: DataFrame, least_share: float = 0.20) -> DataFrame:
    """run, metric, candidate, n_pages, n_sampled, n_matching, verdict.

    `candidates` has one row for each candidate page (run, metric, candidate, page, key_unit, codes: the defects
    expected there), `findings` one for each page that a model looked at (run, metric, page, codes, severity). A page
    matches if the model found one of the expected defects there, MAJOR or CRITICAL. Without findings the verdict is
    UNRESOLVED; a critical candidate is CONFIRMED by any match; another needs all its pages sampled and a share of
    `least_share` or two key pages matching; fully sampled without a match is REJECTED.
    """
    found = findings.select("run", "metric", "page", F.col("codes").alias("seen"), F.col("severity").alias("found"))
    joined = candidates.join(found, ["run", "metric", "page"], "left")
    match = F.coalesce(F.col("found").isin("MAJOR", "CRITICAL") & F.arrays_overlap("codes", "seen"), F.lit(False))
    totals = joined.groupBy("run", "metric", "candidate").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count("found").alias("n_sampled"),
        F.count_if(match).alias("n_matching"),
        F.count_if(match & F.col("key_unit")).alias("n_key"),
    )
    n = F.col("n_matching")
    enough = (n / F.col("n_pages") >= lit(least_share)) | (F.col("n_key") >= 2)
    full = F.col("n_sampled") == F.col("n_pages")
    verdict = ladder(
        (F.col("n_sampled") == 0, "UNRESOLVED"),
        ((F.col("candidate") == "CRITICAL") & (n > 0), "CONFIRMED"),
        ((F.col("candidate") == "MAJOR") & full & enough & (n > 0), "CONFIRMED"),
        (full & (n == 0), "REJECTED"),
        otherwise="UNRESOLVED",
    )
    return totals.select("run", "metric", "candidate", "n_pages", "n_sampled", "n_matching", verdict.alias("verdict"))


def gate_multiplier(verdicts: DataFrame) -> DataFrame:
    """run, multiplier: 0 for a confirmed critical, .5 for another confirmed, null if some are only unresolved, else 1."""
    confirmed = F.col("verdict") == "CONFIRMED"
    return verdicts.groupBy("run").agg(
        ladder(
            (F.bool_or(confirmed & (F.col("candidate") == "CRITICAL")), lit(0)),
            (F.bool_or(confirmed), lit(0.5)),
            (F.bool_or(F.col("verdict") == "UNRESOLVED"), F.lit(None).cast("double")),
            otherwise=lit(1),
        ).alias("multiplier")
    )
