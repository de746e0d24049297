"""The reducer graph and the quality attributes: values worked out by hand, missing evidence, recovery, caps."""

import pytest

from tallyscope.operators.composites import quality_attributes, reduce_graph

OBS = "run int, metric string, scope string, eff double, importance double, confidence double, severity string, key_unit boolean, critical boolean"
MODELS = [
    ("structured_vlm_composition_layout", 0.88), ("structured_vlm_typography_legibility", 0.86), ("structured_vlm_color_contrast", 0.84),
    ("structured_vlm_imagery_data_visualization", 0.80), ("structured_vlm_cross_slide_consistency", 0.82), ("structured_vlm_authorship_specificity", 0.75),
]


def obs(metric, eff, scope="PAGE", importance=1.0, confidence=0.9, severity="INFO", key=False, critical=False, run=1):
    return (run, metric, scope, eff, importance, confidence, severity, key, critical)


def reduced(spark, rows):
    return {r.reducer: r for r in reduce_graph(spark.createDataFrame(rows, OBS), ["run"]).collect()}


def attributes(spark, rows, models=(), scene="READY_MADE"):
    decks = spark.createDataFrame([(1, scene)], "run int, scene string")
    scored = spark.createDataFrame([(1, m, s, 0.9) for m, s in models], "run int, metric string, score double, confidence double")
    found = quality_attributes(decks, reduce_graph(spark.createDataFrame(rows, OBS), ["run"]), scored, ["run"]).collect()
    assert len(found) == len({r.attribute for r in found})
    return {r.attribute: r for r in found}


def test_every_kind_of_score(spark):
    rows = [obs("slide_reading_load", x, key=k) for x, k in ((1.0, False), (0.8, True), (0.6, True), (0.4, False), (0.2, False))]
    rows += [obs("duplicate_slide", x, "SLIDE_PAIR") for x in (1.0, 0.5)] + [obs("transition_coherence_proxy", 0.0, "SLIDE_PAIR")]
    rows += [obs("media_integrity", 1.0, "OBJECT", 3.0), obs("crop_geometry_risk", 0.0, "OBJECT", 1.0), obs("alt_text", 0.0, "OBJECT")]
    got = reduced(spark, rows)
    assert got["content_structure"].score == pytest.approx(0.60 * 0.6 + 0.25 * 0.2 + 0.15 * 0.6)
    assert got["visual_system_rule"].score == pytest.approx(0.70 * 0.5 + 0.30 * 0.0)
    assert got["visual_communication_rule"].score == 0.75
    # one metric feeds several attributes; what none reads counts nowhere
    assert got["media_integrity"].score == 1.0 and got["crop_image_integrity"].score == 0.0
    assert set(got) == {"content_structure", "visual_system_rule", "visual_communication_rule", "media_integrity", "crop_image_integrity"}


def test_missing_capped_and_misplaced(spark):
    rows = [obs("slide_geometry_integrity", 0.9, importance=5.0), obs("slide_geometry_integrity", None, importance=5.0)]
    rows += [obs("slide_pixel_contrast", 0.9), *[obs("slide_pixel_contrast", None)] * 9]
    rows += [obs("slide_typography_functional", 0.9), obs("slide_typography_functional", 0.7, severity="CRITICAL", key=True), obs("slide_typography_functional", None, importance=0.0, severity="CRITICAL", critical=True)]
    rows += [obs("audience_journey", 0.5, "PAGE")]
    got = reduced(spark, rows)
    assert (got["composition_rule"].status, got["composition_rule"].score, got["composition_rule"].observability, got["composition_rule"].severity) == ("NA", None, 0.5, "INFO")
    assert got["contrast_rule"].status == "SCORED" and got["contrast_rule"].observability == 0.1  # optional
    assert got["typography_rule"].score == 0.34 and got["typography_rule"].uncapped_score > 0.7 and got["typography_rule"].severity == "CRITICAL"
    assert got["audience"].status == "ERROR" and got["audience"].score is None  # a page where a deck is read
    assert reduced(spark, rows[:0]) == {}


def test_bounded_samples(spark):
    pages = lambda metric, n, k: [obs(metric, 0.9, importance=2.0)] * k + [obs(metric, None, importance=1.0)] * (n - k)
    got = reduced(spark, pages("raster_content_structure_vlm", 10, 4) + pages("raster_language_consistency_vlm", 10, 7))
    assert got["raster_content_structure_recovery"].least_observability == pytest.approx(8 / 14, abs=1e-6)  # the sample is complete
    assert got["raster_language_consistency_recovery"].least_observability == 0.6  # 8 pages were due


def test_fusion(spark):
    rows = [obs("slide_geometry_integrity", 0.5), obs("slide_pixel_contrast", 1.0), obs("authorship_specificity_signals", 0.4)]
    got = attributes(spark, rows, MODELS)
    assert len(got) == 9
    assert got["composition_craft"].score == pytest.approx(0.34 + 0.66 * 0.5) and got["composition_craft"].severity == "MINOR"
    assert got["palette_craft"].score == 0.84 and got["palette_craft"].confidence == 0.9
    assert got["typography_craft"].score == 0.86 and got["typography_craft"].rule_score is None  # nothing caps it
    assert got["authorship_specificity_v2"].score == pytest.approx(0.30 * 0.4 + 0.70 * 0.75)
    assert got["authorship_specificity_v2"].confidence == 0.85 and got["authorship_specificity"].score == got["authorship_specificity_v2"].score
    alone = attributes(spark, rows[:2], MODELS)["authorship_specificity_v2"]
    assert (alone.score, alone.mode, alone.confidence) == (0.75, "MODEL_ONLY", 0.85)


def test_a_missing_model_is_no_neutral_score(spark):
    got = attributes(spark, [obs("slide_geometry_integrity", 0.9), obs("authorship_specificity_signals", 0.9)])
    for name in ("composition_craft", "palette_craft", "authorship_specificity_v2"):
        assert (got[name].status, got[name].score, got[name].mode) == ("NA", None, "MODEL_MISSING")
    assert got["content_structure"].status == "NA"


@pytest.mark.parametrize("owner, score, mode", [([0.8] * 3, 0.8, "REDUCED"), ([None] * 3, 0.4, "RASTER_FALLBACK"), ([0.8, None, None], 0.4, "RASTER_FALLBACK"), ([], 0.4, "RASTER_FALLBACK")])
def test_recovery_stands_in_for_a_missing_owner_alone(spark, owner, score, mode):
    rows = [obs("document_structure", x) for x in owner] + [obs("raster_content_structure_vlm", x) for x in (0.4, 0.4, None, None)]
    got = attributes(spark, rows)["content_structure"]
    assert (got.score, got.mode, got.status) == (score, mode, "SCORED")
    assert got.page_coverage == (0.5 if mode == "RASTER_FALLBACK" else None)


def test_an_owner_without_recovery_stays_missing(spark):
    got = attributes(spark, [obs("document_structure", None), obs("raster_content_structure_vlm", None)])["content_structure"]
    assert (got.status, got.score, got.mode) == ("NA", None, "REDUCED")


@pytest.mark.parametrize("scene, own", [("READY_MADE", 0), ("TEXT_TO_PPT", 3), ("PROJECT_SUMMARY", 5), ("MULTIMODAL", 5), (None, 0)])
def test_scenes(spark, scene, own):
    rows = [obs("asset_presence", 0.9, "ASSET"), obs("requirement_satisfaction", 0.7, "REQUIREMENT")]
    got = attributes(spark, rows, scene=scene)
    assert len(got) == 9 + own
    if scene == "MULTIMODAL":
        assert got["asset_coverage"].score == got["asset_presentation"].score == 0.9 and got["chart_fidelity"].status == "NA"
    if scene == "TEXT_TO_PPT":
        assert got["instruction"].score == 0.7


def test_decks_without_observations_and_null_groups(spark):
    decks = spark.createDataFrame([(7, "READY_MADE"), (None, "READY_MADE")], "run int, scene string")
    rows = spark.createDataFrame([obs("slide_geometry_integrity", 0.9, run=None)], OBS)
    models = spark.createDataFrame([(None, *MODELS[0], 0.9)], "run int, metric string, score double, confidence double")
    found = quality_attributes(decks, reduce_graph(rows, ["run"]), models, ["run"]).collect()
    assert {r.status for r in found if r.run == 7} == {"NA"} and len(found) == 18
    assert [r.score for r in found if r.run is None and r.attribute == "composition_craft"] == [0.88]
