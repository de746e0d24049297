"""The contract of model responses: each rule broken by itself."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyscope.operators.contract import accepted, breaches, ground_scores

SHA = hashlib.sha256(b"prompt").hexdigest()


def response(**changes):
    whole = {
        "score": 0.7, "confidence": 0.8, "model": {"provider": "p", "model_id": "m", "version": "1"}, "prompt": {"prompt_id": "a", "version": "2", "sha256": SHA.upper()},
        "usage": {"input_tokens": 10, "output_tokens": 0, "cost": 0},
        "evidence": [
            {"evidence_id": "e1", "kind": "k", "message": "m", "page_number": 1, "object_id": "o1", "bbox": [0.1, 0.2, 0.9, 0.8], "payload": {"x": 1}},
            {"evidence_id": "e2", "kind": "k", "message": "m", "source_uri": "file://a", "bbox": None, "page_number": None},
        ],
    }
    for path, value in changes.items():
        *way, last = path.split("__")
        at = whole
        for step in way:
            at = at[int(step)] if step.isdigit() else at[step]
        if value is ...:
            del at[last]
        else:
            at[int(last) if last.isdigit() else last] = value
    return whole


CASES = [
    ({}, []), ({"score": ...}, ["score: missing"]), ({"extra": 1}, ["extra: unknown"]), ({"score": "high"}, ["score: no number"]), ({"score": True}, ["score: no number"]),
    ({"score": None}, ["score: no number"]), ({"score": 1.01}, ["score: out of range"]), ({"confidence": -0.1}, ["confidence: out of range"]), ({"score": 1}, []),
    ({"model": []}, ["model: no mapping"]), ({"model__provider": "  "}, ["model.provider: blank"]), ({"model__version": 3}, ["model.version: blank"]), ({"model__seed": 3}, ["model.seed: unknown"]),
    ({"prompt__version": "9"}, ["prompt: another one"]), ({"prompt__sha256": "zz"}, ["prompt.sha256: no digest", "prompt: another one"]),
    ({"usage__input_tokens": -1}, ["usage.input_tokens: no count"]), ({"usage__output_tokens": 1.5}, ["usage.output_tokens: no count"]), ({"usage__output_tokens": None}, ["usage.output_tokens: no count"]),
    ({"usage__image_tokens": "2"}, ["usage.image_tokens: no count"]), ({"usage__image_tokens": None}, []), ({"usage__cost": -2}, ["usage.cost: out of range"]),
    ({"usage__cost_known": 1}, ["usage.cost_known: no boolean"]), ({"evidence": "none"}, ["evidence: no list"]), ({"evidence": []}, ["evidence: empty"]),
    ({"evidence__1__evidence_id": "e1"}, ["evidence.evidence_id: repeated"]), ({"evidence__0": 5}, ["evidence: no mapping @0"]), ({"evidence__0__kind": ...}, ["evidence.kind: missing @0"]),
    ({"evidence__0__message": ""}, ["evidence.message: blank @0"]), ({"evidence__0__when": 1}, ["evidence.when: unknown @0"]),
    ({"evidence__0__page_number": 0}, ["evidence.object_id: not on the page @0", "evidence.page_number: no page @0"]), ({"evidence__0__page_number": 9}, ["evidence.object_id: not on the page @0", "evidence.page_number: beyond the deck @0"]),
    ({"evidence__0__page_number": 3, "evidence__0__object_id": "o3"}, ["evidence.page_number: not supplied @0"]), ({"evidence__0__page_number": "1"}, ["evidence.page_number: no page @0"]),
    ({"evidence__1__source_uri": ...}, ["evidence: no location @1"]), ({"evidence__1__source_uri": "file://b"}, ["evidence.source_uri: unknown @1"]), ({"evidence__1__source_uri": " "}, ["evidence.source_uri: blank @1"]),
    ({"evidence__1__object_id": "o1"}, ["evidence.object_id: without page @1"]), ({"evidence__0__object_id": "o2"}, ["evidence.object_id: not on the page @0"]),
    ({"evidence__0__bbox": [0.1, 0.2, 0.3]}, ["evidence.bbox: no box @0"]), ({"evidence__0__bbox": "x"}, ["evidence.bbox: no box @0"]), ({"evidence__0__bbox": [0.1, None, 0.1, 0.1]}, ["evidence.bbox: no box @0"]),
    ({"evidence__0__bbox": [0.1, 0.2, 1.5, 0.1]}, ["evidence.bbox: out of range @0"]), ({"evidence__0__bbox": [0.5, 0.2, 0.6, 0.1]}, ["evidence.bbox: beyond the slide @0"]),
    ({"evidence__0__payload": None}, ["evidence.payload: no mapping @0"]),
    ({"score": 2, "model__provider": 1, "evidence__0__kind": "", "evidence__1__source_uri": "x"}, ["evidence.kind: blank @0", "evidence.source_uri: unknown @1", "model.provider: blank", "score: out of range"]),
]


@pytest.fixture(scope="module")
def told(spark):
    bodies = [(i, 1, json.dumps(response(**changes))) for i, (changes, _) in enumerate(CASES)]
    bodies += [(1000, 1, "not json"), (1001, 1, "[1]"), (1002, 1, None), (1003, 77, json.dumps(response())), (1004, 2, json.dumps(response(evidence__0__page_number=3, evidence__0__object_id="o3")))]
    responses = spark.createDataFrame(bodies, "response_id int, request_id int, body string")
    requests = spark.createDataFrame([(i, 5, i == 1, "a", "2", SHA) for i in (1, 2)], "request_id int, slide_count int, visual boolean, prompt_id string, prompt_version string, prompt_sha256 string")
    pages = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "request_id int, page int")
    objects = spark.createDataFrame([(1, 1, "o1"), (1, 3, "o3"), (2, 3, "o3")], "request_id int, page int, object_id string")
    uris = spark.createDataFrame([(1, "file://a"), (2, "file://a")], "request_id int, uri string")
    found = breaches(responses, requests, pages, objects, uris)
    return {r.response_id: r for r in accepted(responses, found).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_each_rule(told, i):
    assert told[i].codes == sorted(CASES[i][1]) and told[i].valid == (not CASES[i][1]) and told[i].n_breaches == len(CASES[i][1])
    assert (told[i].score is not None) == told[i].valid


def test_whole_responses(told):
    assert told[1000].codes == told[1001].codes == told[1002].codes == ["response: no mapping"]
    assert "request: unknown" in told[1003].codes and not told[1003].valid
    assert told[1004].valid  # a text request supplies no images


def test_grounding(spark):
    rows = [
        (1, "cross_slide_consistency", ["x"], [1], 1, False), (2, "cross_slide_consistency", ["x"], [1, 1], 1, False), (3, "authorship_specificity", ["x"], [1, 2], 1, False),
        (4, "authorship_specificity", [], [], 1, False), (5, "render_integrity", ["x"], [2], 2, True), (6, "render_integrity", ["x"], [2], 1, True), (7, "render_integrity", ["x"], [2], 2, False),
        (8, "color_contrast", ["x"], [], 1, False), (9, "cross_slide_consistency", ["x"], None, None, None), (10, "render_integrity", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, criterion string, codes array<string>, affected array<int>, page int, has_box boolean")
    got = {r.id: r for r in ground_scores(df.withColumns({"score": F.lit(0.5), "observability": F.lit("FULL")}), ["id"]).collect()}
    assert {i for i, r in got.items() if r.reason == "DECK_LEVEL_COMPARISON_GROUNDING_INSUFFICIENT"} == {1, 2, 9}
    assert {i for i, r in got.items() if r.reason == "RENDER_DEFECT_LOCALIZATION_INSUFFICIENT"} == {6, 7}
    assert all((r.score is None) == (r.reason is not None) and (r.observability == "INSUFFICIENT") == (r.reason is not None) for r in got.values())


def test_codes_are_made_before_they_are_exploded(spark):
    import re

    from tallyscope.operators.contract import breaches

    of = lambda schema: spark.createDataFrame([], schema)
    found = breaches(
        of("response_id int, request_id string, body string"),
        of("request_id string, slide_count int, visual boolean, prompt_id string, prompt_version string, prompt_sha256 string"),
        of("request_id string, page long"), of("request_id string, page long, object_id string"), of("request_id string, uri string"),
    )
    made = re.findall(r"Generate explode\((.*)", found._jdf.queryExecution().analyzed().toString())
    assert len(made) == 2 and all(m.startswith("codes#") for m in made)


def test_no_filter_makes_the_codes_anew(spark):
    responses = spark.createDataFrame([(1, 1, json.dumps(response(score=2)))], "response_id int, request_id int, body string")
    requests = spark.createDataFrame([(1, 5, True, "a", "2", SHA)], "request_id int, slide_count int, visual boolean, prompt_id string, prompt_version string, prompt_sha256 string")
    supplied = [spark.createDataFrame([], f"request_id int, {c}") for c in ("page int", "page int, object_id string", "uri string")]
    plan = breaches(responses, requests, *supplied)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not [line for line in filters if "out of range" in line or "size(" in line]
