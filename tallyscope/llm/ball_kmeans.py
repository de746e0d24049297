"""Ball k-means over integer vectors: exact nearest centroids with few comparisons.

A cluster is a ball: its centroid and the distance of its farthest member. A centroid is a neighbour of another if half
the gap between the two lies within the ball. Members nearer to their centroid than half the gap to the nearest
neighbour are the stable core and are compared with nothing; between the half gaps to the k-th and the next neighbour
lies an annulus, whose members are compared with the first k neighbours alone. All of it is done on integers, squared,
so no rounding decides.

Vectors travel as blocks, one row each, in a table bucketed by block that is written once; a round reads it beside the
small table of the last round's clusters and writes the next, with each block's sums, so no vector is shuffled again.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import in_arrow, materialize, scratch_path

#: Vectors of a block, and blocks of a bucket of the table on average.
BLOCK, BUCKET = 1024, 256
BLOCKS = "block long, ids array<long>, vectors binary"
STATE = "block long, homes binary, counts array<long>, sums array<long>, spread array<long>, compared long"


class Step(NamedTuple):
    """What a block's vectors come to: cluster and squared distance of each, and how many distances were computed."""

    homes: np.ndarray
    distance: np.ndarray
    compared: int


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of the rows to a centroid."""
    apart = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", apart, apart)


def gaps_between(centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the centroids to each other."""
    return np.stack([squared(centroids, c) for c in centroids])


def assign(vectors: np.ndarray, homes: np.ndarray | None, centroids: np.ndarray) -> Step:
    """The nearest centroid of every vector, equal ones by smaller number. `homes` are the clusters the vectors are in
    now; any are right, near ones spare comparisons."""
    if homes is None:
        homes = np.zeros(len(vectors), dtype=np.int32)
    gaps = gaps_between(centroids)
    nearest, distance, compared = homes.copy(), np.empty(len(vectors), dtype=np.int64), 0
    for own in np.unique(homes).tolist():
        members = np.flatnonzero(homes == own)
        best, best_at = squared(vectors[members], centroids[own]), np.full(len(members), own, dtype=np.int32)
        compared += len(members)
        others = np.delete(np.arange(len(centroids)), own)
        others = others[np.argsort(gaps[own][others], kind="stable")]
        # a gap of more than twice the distance leaves a centroid farther than the own one; squared, of four times
        annulus = np.searchsorted(gaps[own][others], 4 * best, side="right")
        for k, other in enumerate(others.tolist()):
            rows = np.flatnonzero(annulus > k)
            if not len(rows):
                break
            to = squared(vectors[members[rows]], centroids[other])
            compared += len(rows)
            nearer = (to < best[rows]) | ((to == best[rows]) & (other < best_at[rows]))
            best[rows[nearer]], best_at[rows[nearer]] = to[nearer], other
        nearest[members], distance[members] = best_at, best
    return Step(nearest, distance, compared)


def largest(dims: int) -> int:
    """The largest component of which four times a squared distance still fits 64 bits."""
    return math.isqrt((2**63 - 1) // (16 * dims))


def as_integers(x: np.ndarray, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x)."""
    whole = np.floor(x * float(scale))
    if np.abs(whole).max(initial=0) > largest(dims):
        raise ValueError(f"a component is beyond {largest(dims)} after scaling: squared distances don't fit 64 bits")
    return whole.astype(np.int64)


def as_matrix(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int32).reshape(-1, dims)


def _kept(vectors: DataFrame, dims: int) -> DataFrame:
    x = F.col("embedding")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    whole = (F.size(x) == dims) & ~F.coalesce(F.exists(x, odd), F.lit(True))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(whole)


def _blocks(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    """The vectors as integers, in blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                whole = as_integers(rows.column("embedding").flatten().to_numpy(zero_copy_only=False), scale, dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([whole.astype(np.int32).tobytes()], pa.binary())],
                    ["block", "ids", "vectors"],
                )
                number += 1

    return in_arrow(kept, pack, BLOCKS)


def _step(joined: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One round over (block, vectors, homes): the next state."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, homes in zip(*(batch.column(c).to_pylist() for c in ("block", "vectors", "homes")), strict=True):
                vectors = as_matrix(raw, dims)
                got = assign(vectors, None if homes is None else np.frombuffer(homes, dtype=np.int32), centroids)
                sums, spread = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
                for c in np.unique(got.homes).tolist():
                    sums[c] = vectors[got.homes == c].sum(0, dtype=np.int64)
                    spread[c] = got.distance[got.homes == c].sum()
                counts = np.bincount(got.homes, minlength=k)
                values = (block, got.homes.astype(np.int32).tobytes(), counts.tolist(), sums.ravel().tolist(), spread.tolist(), got.compared)
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["block", "homes", "counts", "sums", "spread", "compared"])

    return in_arrow(joined, run, STATE)


def _total(state: DataFrame, column: str, size: int) -> list[int]:
    """The sum over all blocks of each place of an array column: `size` exact numbers."""
    out = [0] * size
    places = state.select(F.posexplode(column).alias("place", "value"))
    for row in places.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect():
        out[row["place"]] = int(row["total"])
    return out


def first_centroids(kept: DataFrame, k: int, seed: str, scale: int, dims: int) -> np.ndarray:
    """The `k` vectors with the smallest sha256 of `seed`:`vec_id`, as integers, in that order; of one id the smaller."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(rank.alias("rank"), "embedding").orderBy("rank", "embedding").limit(k).collect()
    return as_integers(np.array([r["embedding"] for r in rows], dtype=np.float64), scale, dims)


def ball_kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared for every kept row of `vectors`
    (vec_id, embedding).

    Kept are embeddings of exactly `dims` components, none null or non-finite; components become floor(scale * x). The
    first centroids are the `k` vectors with the smallest sha256 of `seed`:`vec_id`. A round assigns every vector and
    then moves every centroid that has members to their componentwise floor(sum / count); rounds that can't change
    anything are not run. distance is squared; inertia its sum. compared is the number of distances computed in the last
    assignment, over all vectors.

    Equal distances go to the smaller number; a null vec_id counts as an empty one and stays null; repeated rows are
    vectors of their own, and of rows with one vec_id the smaller vector is a first centroid; with fewer than `k`
    vectors there are as many centroids; an empty table gives an empty result. Components too large for exact squares
    in 64 bits raise an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = _kept(vectors, dims)
    centroids = first_centroids(kept, k, seed, scale, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared long")
    k = len(centroids)
    written = materialize(_blocks(kept, dims, scale), "blocks")
    buckets = max(1, math.ceil(written.count() / BUCKET), spark.sparkContext.defaultParallelism)
    table = f"vector_blocks_{uuid.uuid4().hex}"
    dealt = written.repartition(buckets, "block")
    dealt.write.format("parquet").bucketBy(buckets, "block").option("path", scratch_path(spark, "bucketed")).saveAsTable(table)
    blocks = spark.table(table)

    def next_state(state: DataFrame | None) -> DataFrame:
        if state is None:
            joined = blocks.select("block", "vectors", F.lit(None).cast("binary").alias("homes"))
        else:
            joined = blocks.select("block", "vectors").join(state.select("block", "homes").hint("shuffle_hash"), "block")
        return materialize(_step(joined, centroids), "clusters")

    state = None
    for _ in range(rounds):
        state = next_state(state)
        counts, sums = _total(state, "counts", k), _total(state, "sums", k * dims)
        moved = np.array([[s // n for s in sums[c * dims : (c + 1) * dims]] if n else centroids[c].tolist() for c, n in enumerate(counts)], dtype=np.int64)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    state = next_state(state)
    spread = _total(state, "spread", k)
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw, homes in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "homes")), strict=True):
                own, all_vectors = np.frombuffer(homes, dtype=np.int32), as_matrix(raw, dims)
                apart = all_vectors.astype(np.int64) - centroids[own]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own), pa.array(np.einsum("ij,ij->i", apart, apart))], ["vec_id", "cluster", "distance"])

    found = in_arrow(blocks.join(state.select("block", "homes").hint("shuffle_hash"), "block"), rows, "vec_id long, cluster int, distance long")
    found = materialize(found, "clustered")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    compared = state.agg(F.sum("compared")).first()[0]
    return found.select(
        "vec_id", "cluster", "distance", pick(spread).cast("long").alias("cluster_inertia"), F.lit(sum(spread)).cast("long").alias("inertia"),
        pick(marks).alias("centroid_sha256"), F.lit(compared).cast("long").alias("compared"),
    )
