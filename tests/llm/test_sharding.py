import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyscope.llm.sharding import after_run, assign_shards, run_shards, write_shards

DOCS = "doc_id long, text string, shard_of string"


def heap_deal(loads, sizes):
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
        out.append(s)
    return out, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def brute_force(docs, shards=8):
    groups = defaultdict(list)
    for row, (doc_id, text) in enumerate(docs):
        groups[text or ""].append((doc_id is not None, doc_id or 0, row))
    size = lambda t: len(t.encode()) + 1
    order = sorted(groups, key=lambda t: (-size(t) * len(groups[t]), hashlib.sha256(t.encode()).digest()))
    dealt, _ = heap_deal([0] * shards, [size(t) * len(groups[t]) for t in order])
    slots, out = defaultdict(int), []
    for t, s in zip(order, dealt, strict=True):
        for has, doc_id, _ in sorted(groups[t]):
            out.append((doc_id if has else None, size(t), zlib.crc32(t.encode()), "bytes", s, slots[s], None))
            slots[s] += 1
    return sorted(map(repr, out))


def dealt(spark, docs, **more):
    return sorted(repr(tuple(r)) for r in assign_shards(spark.createDataFrame([(*d, "x") for d in docs], DOCS), **more).collect())


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_the_heap(seed):
    r = random.Random(seed)
    for _ in range(60):
        loads, size, n = [r.choice([0, 3, 17, 400]) * r.randrange(5) for _ in range(r.choice([1, 2, 8, 13]))], r.randrange(1, 30), r.choice([1, 2, 9, 63, 64, 65, 200, 700])
        want, after = heap_deal(loads, [size] * n)
        loads = np.array(loads, dtype=np.int64)
        assert run_shards(loads, size, np.arange(n)).tolist() == want
        assert after_run(loads, size, n).tolist() == after


@pytest.mark.parametrize("shards", [8, 1, 3])
def test_equals_brute_force(spark, shards):
    r = random.Random(7)
    docs = [(i, "x" * r.choice([0, 1, 5, 5, 5, 30, 200]) + r.choice(["", "é", str(r.randrange(40))])) for i in range(900)]
    docs += [(1000 + i, "copies of one text") for i in range(400)] + [docs[5], docs[5], (None, "null id"), (None, "null id"), (None, None), (2000, None), (2001, ""), (2002, "long " * 40000)]
    assert dealt(spark, docs, shards=shards) == brute_force(docs, shards)


def test_law(spark):
    docs = [(i, f"{i} " * (i % 50)) for i in range(3000)]
    rows = assign_shards(spark.createDataFrame([(*d, "x") for d in docs], DOCS)).collect()
    loads, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(loads.values()) - min(loads.values()) <= max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(loads) == 8


def test_empty_and_written(spark, tmp_path):
    assert dealt(spark, []) == []
    docs = [(i, f"text {i % 30} " * (i % 7)) for i in range(200)] + [(None, None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], DOCS)
    write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id or -1, r.shard) for r in back.collect()) == sorted((r.doc_id or -1, r.shard) for r in assign_shards(df).collect())
    assert sorted(map(repr, back.select(df.columns).collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(ValueError):
        assign_shards(df, 0)
