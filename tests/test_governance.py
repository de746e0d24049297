"""Proposals in batch and as a stream, the cache of derived data, canonical JSON."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyscope.functions.canonical import canonical_json, record_digest
from tallyscope.sources.cache import DerivedCache, content_key
from tallyscope.streaming.proposals import EVENT, decide, replay_proposals, stream_proposals


def made(seed, n=400):
    r = random.Random(seed)
    actions = ["create", "validate", "approve", "approve", "approve", "odd"]
    return [(f"p{r.randrange(30)}", i, r.choice(actions), r.choice(["a", "b", "c", " ", None]), r.choice([True, True, True, False, None]), r.choice([True, True, True, False, None])) for i in range(n)]


def plain(rows):
    states, out = {}, []
    for proposal, seq, action, actor, complete, passed in sorted(rows, key=lambda r: r[1]):
        status, approvers = states.get(proposal, (None, []))
        status, approvers, reason = decide(status, approvers, action, actor, complete, passed)
        states[proposal] = status, approvers
        out.append((proposal, seq, action, reason is None, reason, status, len(approvers)))
    return sorted(out, key=lambda r: r[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_one_event_after_another(spark, seed):
    rows = made(seed) + [(None, 1000, "create", None, True, None), (None, 1001, "validate", None, True, True), (None, 1002, "approve", "a", None, None)]
    got = [tuple(r) for r in replay_proposals(spark.createDataFrame(rows, EVENT)).orderBy("seq").collect()]
    assert got == plain(rows)
    assert {"RELEASE_CANDIDATE", "REJECTED", "APPROVED", "DRAFT", None} <= {r[5] for r in got} and replay_proposals(spark.createDataFrame([], EVENT)).collect() == []


def test_two_approvers_are_needed(spark):
    steps = [("create", None), ("approve", "a"), ("validate", None), ("approve", "a"), ("approve", "a"), ("approve", ""), ("approve", "b"), ("approve", "c"), ("validate", None)]
    rows = [("p", i, action, actor, True, True) for i, (action, actor) in enumerate(steps)]
    got = replay_proposals(spark.createDataFrame(rows, EVENT)).orderBy("seq").collect()
    assert [r.status for r in got] == ["DRAFT", "DRAFT", "VALIDATED", "APPROVED", "APPROVED", "APPROVED", *["RELEASE_CANDIDATE"] * 3]
    assert [r.reason for r in got] == [None, "NOT_VALIDATED", None, None, None, "BLANK_APPROVER", None, "NOT_VALIDATED", "NOT_DRAFT"]


def test_the_stream_says_the_same(spark, tmp_path):
    rows = made(3, 240)
    names = [c.split()[0] for c in EVENT.split(", ")]
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    for i in range(0, 240, 80):
        (inbox / f"{i:04}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows[i : i + 80]))
    (inbox / "9999.json").write_text(json.dumps(dict(zip(names, (rows[0][0], rows[0][1], "create", "x", True, True), strict=True))))
    for i, file in enumerate(sorted(inbox.iterdir())):  # the files of a folder come in the order of their times
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = stream_proposals(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(inbox)))
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(out))
    assert run.awaitTermination(120)
    got = sorted((tuple(r) for r in spark.read.parquet(str(out)).collect()), key=lambda r: (r[1], r[4] == "LATE"))
    late = [r for r in got if r[4] == "LATE"]
    assert len(late) == 1 and [r for r in got if r[4] != "LATE"] == plain(rows)


def test_the_cache_derives_only_new_keys(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def derive(rows):
        seen.append(sorted(r.content for r in rows.collect()))
        return rows.where("content <> 'nothing'").select("key", F.length("content").alias("n"))

    def inputs(*contents):
        return spark.createDataFrame([(c,) for c in contents], "content string").withColumn("key", content_key(version=1))

    values = lambda df: sorted(r.n for r in df.collect())
    assert values(DerivedCache(spark, path).derive(inputs("a", "bb", "bb"), derive, "n int")) == [1, 2]
    assert values(DerivedCache(spark, path).derive(inputs("bb", "ccc", "nothing"), derive, "n int")) == [2, 3]
    assert values(DerivedCache(spark, path).derive(inputs("a", "nothing"), derive, "n int")) == [1]
    assert seen == [["a", "bb"], ["ccc", "nothing"], ["nothing"]]

    class Dies(DerivedCache):
        def _note(self, *_):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        Dies(spark, path).derive(inputs("dddd"), derive, "n int")
    assert values(DerivedCache(spark, path).held("n int")) == [1, 2, 3]  # no trace of it
    cache = DerivedCache(spark, path)
    cache.compact("n int")
    assert values(cache.held("n int")) == [1, 2, 3] and len(cache._batches()) == 1
    assert values(cache.derive(inputs("a", "dddd"), derive, "n int")) == [1, 4] and seen[-1] == ["dddd"]
    assert inputs("a").select("key").first() != spark.createDataFrame([("a",)], "content string").select(content_key(version=2)).first()


def test_canonical_json(spark):
    records = [
        {"b": 1, "a": {"ü": [1.0, 1e-7, 12.31, 1e22, -0.0], "z": None, "Z": True}}, {"é": "日本\n\"\\ ", "e": []}, [3, {"y": 1, "x": 2}], "text", 12345678901234567890, {},
    ]
    texts = [json.dumps(x, ensure_ascii=i % 2 == 0, indent=i) for i, x in enumerate(records)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "{broken", "", None])], "i int, t string")
    got = {r.i: r for r in rows.select("i", canonical_json(F.col("t")).alias("c"), canonical_json(F.col("t"), plain=True).alias("p"), record_digest(F.col("t")).alias("d")).collect()}
    for i, x in enumerate(records):
        want = json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert got[i].c == want and got[i].d == hashlib.sha256(want.encode()).hexdigest() and got[i].p == json.dumps(x, ensure_ascii=True, sort_keys=True)
    assert [got[i].c for i in (6, 7, 8)] == [None] * 3 and got[6].d is None
