"""Shards of nearly equal size by longest-processing-time scheduling.

Documents that must stay together (equal texts) are one group. Groups are taken by falling size, and each goes to the
least loaded shard, the one on top of a heap of loads. What comes before a group of some size is the same for all groups
of that size, so the schedule is found over the table of distinct sizes, which is short: sizes that differ add up, so
there are fewer than the square root of twice all bytes. A group's shard then follows from the loads at which its size
begins and its place among its equals, in the tasks. No group's rows are gathered: places come from a range sort and
the row counts of its partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import checked, fresh, in_arrow, materialize
from tallyscope.llm.digest_index import text_digest

SHARDS = 8
#: Groups of one size up to which the heap deals them one by one.
SHORT_RUN = 64
OUT = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def run_shards(loads: np.ndarray, size: int, places: np.ndarray) -> np.ndarray:
    """The shards of the groups at some places of a run of groups of one size that begins at `loads`.

    The heap hands out shards by falling need: the pick at place p is the p-th smallest of all pairs (load + t * size,
    shard). It is found by halving the interval of loads for all places at once.
    """
    at_most = lambda level: np.maximum((level[:, None] - loads[None, :]) // size + 1, 0).sum(1)
    low = np.full(len(places), int(loads.min()) - 1, dtype=np.int64)
    high = int(loads.min()) + (places + 1) * size
    while (high - low > 1).any():
        middle = (low + high) // 2
        enough = at_most(middle) > places
        high, low = np.where(enough, middle, high), np.where(enough, low, middle)
    nth = places - at_most(high - 1)
    reach = (high[:, None] >= loads[None, :]) & ((high[:, None] - loads[None, :]) % size == 0)
    return np.argmax(np.cumsum(reach, axis=1) > nth[:, None], axis=1).astype(np.int32)


def after_run(loads: np.ndarray, size: int, groups: int) -> np.ndarray:
    """The loads after a run of `groups` groups of one size."""
    if groups <= SHORT_RUN:
        heap = [(load, shard) for shard, load in enumerate(loads.tolist())]
        heapq.heapify(heap)
        for _ in range(groups):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
        return np.array([load for load, _ in sorted(heap, key=lambda x: x[1])], dtype=np.int64)
    last = np.array([groups - 1], dtype=np.int64)
    shard = int(run_shards(loads, size, last)[0])
    shards = np.arange(len(loads))
    # the last pick is of the least load above which every shard has been filled
    low, high = int(loads.min()) - 1, int(loads.min()) + groups * size
    while high - low > 1:
        middle = (low + high) // 2
        if int(np.maximum((middle - loads) // size + 1, 0).sum()) >= groups:
            high = middle
        else:
            low = middle
    below = np.maximum((high - 1 - loads) // size + 1, 0)
    level = (high >= loads) & ((high - loads) % size == 0) & (shards <= shard)
    return loads + (below + level) * size


def in_order(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """`df`, written, with `place`: the row's number, from 0 without gaps, in the order of the columns, which must tell
    the rows apart. Only the row counts of the partitions are added up in one place."""
    part, row = fresh("part"), fresh("row")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    index = F.monotonically_increasing_id()
    dealt = materialize(dealt.select("*", F.shiftright(index, 33).alias(part), index.bitwiseAND(F.lit((1 << 33) - 1)).alias(row)), label)
    counts = dealt.groupBy(part).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counts.select(part, before.alias("before")), "offsets")  # a row for each partition
    return dealt.join(F.broadcast(offsets), part).select(*df.columns, (F.col("before") + F.col(row)).alias("place"))


def schedule(runs: DataFrame, shards: int) -> DataFrame:
    """size, begin, loads for each row of `runs` (size, groups, begin; one for each distinct size): the loads of the
    shards when the groups of that size come, the largest first. It takes each run in turn, holding the loads alone."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(shards, dtype=np.int64)
        for batch in batches:
            seen = []
            for size, groups in zip(batch.column("size").to_pylist(), batch.column("groups").to_pylist(), strict=True):
                seen.append(loads.tolist())
                loads = after_run(loads, size, groups)
            yield pa.RecordBatch.from_arrays([batch.column("size"), batch.column("begin"), pa.array(seen, pa.list_(pa.int64()))], ["size", "begin", "loads"])

    one = runs.repartition(1).sortWithinPartitions(F.col("size").desc())
    return in_arrow(one, deal, "size long, begin long, loads array<long>")


def _group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """digest, place, shard of each row of `groups` (digest, size, ...)."""
    groups = in_order(groups.select("digest", "size"), [F.col("size").desc(), F.col("digest").asc()], "groups")
    runs = materialize(groups.groupBy("size").agg(F.count("*").alias("groups"), F.min("place").alias("begin")), "runs")
    loads = materialize(schedule(runs, shards), "loads")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, begin, place = (batch.column(c).to_numpy() for c in ("size", "begin", "place"))
            first = batch.column("loads")
            out = np.empty(len(size), dtype=np.int32)
            order = np.argsort(size, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
                at = int(rows[0])
                out[rows] = run_shards(np.array(first[at].as_py(), dtype=np.int64), int(size[at]), place[rows] - begin[rows])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("place"), pa.array(out)], ["digest", "place", "shard"])

    return in_arrow(groups.join(checked(loads), "size"), pick, "digest binary, place long, shard int")


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs` (doc_id, text).

    The law is `bytes`: the shards' sizes are near equal, while rows of equal text stay together. A row's size is its
    text's bytes in UTF-8 plus 1. Groups go by falling size, equal ones by the text's SHA-256, to the least loaded shard,
    equal ones by number; a shard is above the mean by less than the largest group. slot numbers a shard's rows from 0,
    in the order of groups and then of doc_id; grown_shard is null under this law.

    A null text is empty: it has size 1 and checksum 0 and belongs to the group of empty texts. A null doc_id is the
    first of its group; repeated rows have slots of their own; an empty table gives an empty result. Other columns are
    ignored.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), text_digest(F.col("text")).alias("digest"),
    )
    rows = materialize(rows, "rows")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("size")), "sizes")
    dealt = materialize(_group_shards(groups, shards), "shards")
    # both sides are written tables, so a text with very many copies is split by adaptive execution
    placed = materialize(rows.join(dealt.withColumnRenamed("place", "group_place"), "digest").drop("digest"), "placed")
    placed = in_order(placed, [F.col(c).asc() for c in ("shard", "group_place", "doc_id", "row")], "slots")
    begin = materialize(placed.groupBy("shard").agg(F.min("place").alias("begin")), "begins")  # a row for each shard
    return placed.join(F.broadcast(begin), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("begin")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write `docs` (doc_id, text, ...) as Parquet into a folder `shard=i` for each shard, with all columns."""
    if "shard" in docs.columns:
        raise ValueError("the folders are named by a column `shard`, which docs has already")
    digest = fresh("digest")
    marked = docs.withColumn(digest, text_digest(F.col("text")))
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit("")).cast("binary")) + 1).cast("long")
    groups = materialize(marked.select(F.col(digest).alias("digest"), size.alias("size")).groupBy("digest").agg(F.sum("size").alias("size")), "sizes")
    dealt = materialize(_group_shards(groups, shards).select(F.col("digest").alias(digest), "shard"), "shards")
    marked.join(dealt, digest).drop(digest).write.partitionBy("shard").parquet(path)
