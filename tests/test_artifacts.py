"""Stored observations, runs, rendered pages and profiles: round trips, and what was tampered with is told."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyscope.sources.artifacts import PROFILE_FIELDS, list_runs, load_observations, rendered_pages, row_digest, save_batch, save_observations, scan_profiles, seal, verify

ROWS = [("r1", 1, 0.5, "a"), ("r1", 2, None, "b"), ("r1", 2, None, "b"), ("r2", 1, 0.1, ""), (None, 7, 0.2, "x")]
SHAPE = "run string, page int, score double, note string"
COLUMNS = ["run", "page", "score", "note"]


def sealed(spark, rows):
    return {r.run: (r.n_rows, r.sha256) for r in seal(spark.createDataFrame(rows, SHAPE), "run", COLUMNS).collect()}


def test_a_seal_tells_all_changes_but_the_order(spark):
    own = sealed(spark, ROWS)
    assert sealed(spark, ROWS[::-1]) == own and {k: v[0] for k, v in own.items()} == {"r1": 3, "r2": 1, None: 1}
    for other in (ROWS[:2] + ROWS[3:], ROWS[:1] + [("r1", 2, 0.0, "b")] + ROWS[2:], ROWS[:1] + [("r1", 2, None, None)] + ROWS[2:]):
        new = sealed(spark, other)
        assert new["r1"] != own["r1"] and new["r2"] == own["r2"] and new[None] == own[None]
    assert sealed(spark, []) == {}
    pairs = spark.createDataFrame([("1:a", None), ("1", "a"), (None, "1:a"), ("", "-"), ("-", "")], "a string, b string")
    assert pairs.select(row_digest(["a", "b"]).alias("d")).distinct().count() == 5


def test_verify_tells_what_became_of_each_run(spark):
    rows = spark.createDataFrame(ROWS, SHAPE)
    manifest = seal(rows, "run", COLUMNS).where("run is null or run = 'r1'").unionByName(spark.createDataFrame([("gone", 4, "x")], "run string, n_rows long, sha256 string"))
    now = rows.withColumn("score", F.when(F.col("run") == "r1", 0.9).otherwise(F.col("score")))
    assert {r.run: (r.n_rows, r.status) for r in verify(now, manifest, "run", COLUMNS).collect()} == {"r1": (3, "CHANGED"), "r2": (1, "UNNAMED"), "gone": (0, "MISSING"), None: (1, "VERIFIED")}


def test_observations_come_back_whole(spark, tmp_path):
    path = f"{tmp_path}/store"
    manifest = save_observations(spark.createDataFrame(ROWS, SHAPE), "run", path)
    assert manifest.count() == 3
    rows, status = load_observations(spark, "run", path)
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, ROWS)) and {r.status for r in status.collect()} == {"VERIFIED"}
    spark.createDataFrame([("r2", 9, 0.1, "late")], SHAPE).write.mode("append").parquet(f"{path}/observations")
    rows, status = load_observations(spark, "run", path)
    assert {r.run for r in rows.collect()} == {"r1", None} and {r.run: r.status for r in status.collect()}["r2"] == "CHANGED"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        save_observations(spark.createDataFrame(ROWS, SHAPE), "run", path)


def test_a_write_that_dies_before_its_manifest(spark, tmp_path):
    spark.createDataFrame(ROWS, SHAPE).write.parquet(f"{tmp_path}/half/observations")
    rows, status = load_observations(spark, "run", f"{tmp_path}/half")
    assert rows.count() == 0 and {r.status for r in status.collect()} == {"UNNAMED"}


def test_runs_newest_first(spark, tmp_path):
    for i, (name, text) in enumerate([("b.json", '{"run_id": "b"}'), ("a.json", '{\n"run_id": "a"}'), ("c.json", "{oops")]):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (1000 + 10 * min(i, 1), 1000 + 10 * min(i, 1)))
    got = list_runs(spark, str(tmp_path), "run_id string").collect()
    assert [(r.file, r.run_id) for r in got] == [("a.json", "a"), ("c.json", None), ("b.json", "b")] and got[1]._corrupt == "{oops"


def test_batches_replace_only_themselves(spark, tmp_path):
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "run_id string")
    save_batch(frame("a", "b"), str(tmp_path), "one")
    save_batch(frame("c"), str(tmp_path), "two")
    save_batch(frame("d"), str(tmp_path), "one")
    assert sorted(r.run_id for r in spark.read.json(f"{tmp_path}/*").collect()) == ["c", "d"]


def test_rendered_pages(spark):
    paths = ["d/slide-1.png", "d/slide-2.JPG", "d/page10.webp", "d/notes.txt", "d/title.png", "e/1.png", "e/s01.png", "e/0.png", "e/v2-3 final.jpeg", "d/99999999999.png"]
    pages, other = rendered_pages(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted((r.deck, r.page) for r in pages.collect()) == [("d", 1), ("d", 2), ("d", 10), ("e", 3)]
    assert {r.path: r.reason for r in other.collect()} == {
        "d/notes.txt": "no page number", "d/title.png": "no page number", "d/99999999999.png": "no page number", "e/1.png": "page named twice", "e/s01.png": "page named twice", "e/0.png": "page below 1",
    }


def test_rendered_pages_are_counted_and_not_joined(spark):
    """A page of one file carries its path through the count of its claims; paths are taken apart in one place."""
    pages, _ = rendered_pages(spark.createDataFrame([("d/1.png",), ("d/2.png",), ("d/02.png",), ("d/0.png",), ("e/1.png",), (None,)], "path string"))
    assert sorted(map(tuple, pages.collect())) == [("d", 1, "d/1.png"), ("e", 1, "e/1.png")]
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_profiles(spark):
    whole = {k: {} if k.endswith("weights") else [] for k in PROFILE_FIELDS} | {"profile_id": "p", "version": "8.3", "scene": "Finished_Deck", "base_weights": {"a": 0.5, "b": 1}, "scene_weights": {"b": 2}, "note": {"x": 1}}
    texts = {
        "whole": json.dumps(whole), "scenario": json.dumps({**whole, "scene": "", "scenario": " summary "}), "old": json.dumps({**whole, "required_oracles": [], "version": 8.2}),
        "bare": "{}", "list": "[1]", "cut": '{"a": ', "null": None, "empty": "", "null version": json.dumps({**whole, "version": None}),
    }
    got = {r.path: r for r in scan_profiles(spark.createDataFrame(list(texts.items()), "path string, content string")).collect()}
    assert got["whole"].valid and (got["whole"].scene, got["whole"].weights, got["whole"].required) == ("ready_made", {"a": 0.5, "b": 2.0}, [])
    want = {"scenario": ["scene: unknown"], "old": ["required_oracles: of an earlier form", "version: not read"], "null version": ["version: not read"]}
    assert {k: got[k].breaches for k in want} == want
    assert got["bare"].breaches == [f"{k}: missing" for k in PROFILE_FIELDS] + ["scene: unknown"]
    assert all(got[k].breaches == ["no JSON object"] for k in ("list", "cut", "null", "empty"))
