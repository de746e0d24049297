"""Append-only logs: hash chains, latest state, idempotent appends, legal transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def verify_chain(log: DataFrame, chain: str, seq: str, payload: Sequence[str]) -> DataFrame:
    """chain, n_events, n_broken, first_broken (its seq, or null) for each chain of `log`.

    An event is whole if its previous_hash is the event_hash of the event before (empty for the first) and its
    event_hash is that of its previous_hash and payload. Stored hashes make this parallel: one window by chain.
    """
    before = F.coalesce(F.lag("event_hash").over(Window.partitionBy(chain).orderBy(seq)), F.lit(""))
    own = content_hash(F.col("previous_hash"), *map(F.col, payload))
    whole = (F.col("previous_hash") == F.col("__before")) & (F.col("event_hash") == own)
    return (
        log.withColumn("__before", before)
        .withColumn("__broken", ~F.coalesce(whole, F.lit(False)))
        .groupBy(chain)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_if("__broken").alias("n_broken"),
            F.min(F.when(F.col("__broken"), F.col(seq))).alias("first_broken"),
        )
    )


def latest(log: DataFrame, by: Sequence[str], seq: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The group columns and `values` of the last row of each group, by `seq`."""
    last = F.max_by(F.struct(*values), F.struct(*seq))
    return log.groupBy(*by).agg(last.alias("last")).select(*by, *[F.col(f"last.{v}").alias(v) for v in values])


def idempotency(log: DataFrame, key: str, fingerprint: str, seq: str) -> DataFrame:
    """key, n_appends, n_reused, n_conflicts: a repeat of a key with the first fingerprint is a reuse of the original,
    with another a conflict."""
    first = log.groupBy(key).agg(F.min_by(fingerprint, seq).alias("first"), F.count(F.lit(1)).alias("n_appends"))
    same = log.join(first, key).groupBy(key, "n_appends").agg(F.count_if(F.col(fingerprint) == F.col("first")).alias("same"))
    return same.select(key, "n_appends", (F.col("same") - 1).alias("n_reused"), (F.col("n_appends") - F.col("same")).alias("n_conflicts"))


def illegal_transitions(log: DataFrame, by: str, seq: str, state: str, allowed: Sequence[tuple[str, str]], start: Sequence[str]) -> DataFrame:
    """The rows of `log` whose state may not follow the state before (or begin a group), with that state as before."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(seq))
    step = F.concat_ws(">", "before", state)
    legal = F.when(F.col("before").isNull(), F.col(state).isin(*start)).otherwise(step.isin(*[f"{a}>{b}" for a, b in allowed]))
    return log.withColumn("before", before).where(~legal)
