import hashlib
import math
import random

import numpy as np
import pytest

from tallyscope.llm.ball_kmeans import assign, ball_kmeans, gaps_between, largest, squared

VECTORS = "vec_id long, embedding array<float>, cluster string"


def plain(vectors, centroids):
    far = np.stack([squared(vectors, c) for c in centroids])
    return far.argmin(0), far.min(0)  # the first of equal ones


def brute_force(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda x: (name(x[0]), x[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        homes = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), home in zip(kept, homes, strict=True) if home == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [near(v) for _, v in kept]
    total = [sum(d for d, c in found if c == j) for j in range(len(centroids))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, c, d, total[c], sum(total), marks[c])) for (i, _), (d, c) in zip(kept, found, strict=True))


def clustered(spark, rows, **more):
    got = ball_kmeans(spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS), **more)
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in got.collect())


def as_float(x):
    return float(np.float32(x))


@pytest.mark.parametrize("seed, n, k", [(1, 300, 8), (2, 5, 8), (3, 60, 1)])
def test_equals_brute_force(spark, seed, n, k):
    r = random.Random(seed)
    rows = [(i, [as_float(r.choice([-1, 0, 1]) * 0.25 + r.gauss(0, 0.1)) for _ in range(4)]) for i in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, [0.0, 0.5, -0.5, 1.0]), (2, [as_float(0.1)] * 4)]
    bad = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 0.0, 0.0]), (905, [float("nan")] * 4), (906, [0.0, float("inf"), 0.0, 0.0])]
    assert clustered(spark, rows + bad, k=k, dims=4, rounds=4) == brute_force(rows + bad, k, 4, 4)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(40)]
    assert clustered(spark, rows, k=6, dims=2, rounds=3) == brute_force(rows, 6, 3, 2)


def test_empty_tables_and_too_large_components(spark):
    assert clustered(spark, []) == [] and clustered(spark, [(1, None), (2, [1.0])]) == []
    with pytest.raises(Exception, match="squared distances"):
        clustered(spark, [(1, [1e30] * 64)])


def test_balls_spare_comparisons_and_are_exact():
    r = np.random.default_rng(5)
    centres = r.integers(-5000, 5000, (12, 16))
    vectors = (centres[r.integers(0, 12, 3000)] + r.integers(-300, 300, (3000, 16))).astype(np.int32)
    want, far = plain(vectors, centres)
    for homes in (None, want.astype(np.int32), r.integers(0, 12, 3000).astype(np.int32)):
        got = assign(vectors, homes, centres)
        assert (got.homes == want).all() and (got.distance == far).all()
    assert assign(vectors, want.astype(np.int32), centres).compared < 1.5 * len(vectors)  # plain k-means computes 12 x as many


def test_no_rounding_decides():
    r = np.random.default_rng(6)
    vectors, centres = r.integers(-2, 3, (2000, 3)).astype(np.int32), r.integers(-2, 3, (9, 3))
    assert (assign(vectors, r.integers(0, 9, 2000).astype(np.int32), centres).homes == plain(vectors, centres)[0]).all()
    top = largest(64)
    ends = np.array([[top] * 64, [-top] * 64])
    assert gaps_between(ends).max() == 64 * (2 * top) ** 2 and 4 * 64 * (2 * top) ** 2 < 2**63
