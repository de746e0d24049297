"""Hash chains over append-only logs, in batch and as a stream.

A chain is sequential by nature: an event's hash covers the one before. So there is one chain for each run, each built
in order by its own task, and a root chain may cover their heads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "run_id string, seq long, payload string"
CHAINED = "run_id string, seq long, payload string, previous_hash string, event_hash string"


def event_hash(previous: str, run: str, seq: int, payload: str | None) -> str:
    return hashlib.sha256("|".join([previous, str(run), str(seq), payload or ""]).encode()).hexdigest()


def _link(rows: pd.DataFrame, previous: str) -> tuple[pd.DataFrame, str]:
    out = []
    for run, seq, payload in rows.sort_values("seq")[["run_id", "seq", "payload"]].itertuples(index=False):
        own = event_hash(previous, run, seq, payload)
        out.append((run, seq, payload, previous, own))
        previous = own
    return pd.DataFrame(out, columns=["run_id", "seq", "payload", "previous_hash", "event_hash"]), previous


def _link_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole runs one after another, in batches: only the last run and its last hash are carried from one to the next."""
    run, previous = None, ""
    for rows in batches:
        for own, part in rows.groupby("run_id", sort=False, dropna=False):
            own = None if pd.isna(own) else own
            linked, previous = _link(part, previous if own == run else "")
            run = own
            yield linked


def build_chains(events: DataFrame) -> DataFrame:
    """`events` (run_id, seq, payload) with previous_hash and event_hash, chained by run in order of seq."""
    ordered = events.select("run_id", "seq", "payload").repartition("run_id").sortWithinPartitions("run_id", "seq")
    return ordered.mapInPandas(_link_sorted, CHAINED)


def stream_chains(events: DataFrame) -> DataFrame:
    """The same over a stream whose batches bring the events of a run in order: the state of a run is its last hash."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else ""
        linked, previous = _link(pd.concat(list(batches)), previous)
        state.update((previous,))
        yield linked

    return events.select("run_id", "seq", "payload").groupBy("run_id").applyInPandasWithState(
        step, CHAINED, "last string", "append", GroupStateTimeout.NoTimeout
    )


def read_events(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the JSON-lines files that arrive in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(path)


def unique_events(events: DataFrame, key: str, time: str, keep: str = "1 day") -> DataFrame:
    """`events` without repeats of `key` that come within `keep` of each other: the reuse half of an idempotent append."""
    return events.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])
