"""The contract of model responses: every breach of every response, as rows.

A response is a JSON text. Its own rules (exact keys, kinds, ranges, unique ids) are expressions over the parsed variant;
whether its evidence stands in the request it answers (pages supplied, objects on them, known addresses) are joins with
what was supplied. Nothing stops at the first breach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scores import lit

#: The keys of a response and its parts, those that must be there first.
KEYS = {
    "": (("score", "confidence", "model", "prompt", "usage", "evidence"), ()),
    "model": (("provider", "model_id", "version"), ()),
    "prompt": (("prompt_id", "version", "sha256"), ()),
    "usage": (("input_tokens", "output_tokens", "cost"), ("image_tokens", "cached_tokens", "cache_creation_input_tokens", "request_bytes", "cost_known")),
    "evidence": (("evidence_id", "kind", "message"), ("page_number", "object_id", "bbox", "source_uri", "payload")),
}
#: The criteria that compare pages, whose defects need two of them.
DECK_LEVEL = ("cross_slide_consistency", "authorship_specificity")
EDGE = 1.000001


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _given(v: Column) -> Column:
    """Whether a key is there with a value other than null."""
    return v.isNotNull() & (_kind(v) != "VOID")


def _is_number(v: Column) -> Column:
    return F.coalesce(_kind(v).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\()"), F.lit(False))


def _is_count(v: Column) -> Column:
    whole = F.coalesce(_kind(v).rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))$"), F.lit(False))
    return whole & (F.try_variant_get(v, "$", "double") >= 0)


def _number(v: Column) -> Column:
    return F.when(_is_number(v), F.try_variant_get(v, "$", "double"))


def _text(v: Column) -> Column:
    """The text without blanks around it; null for another kind and for blanks alone."""
    own = F.when(_kind(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string"), F.lit(" \t\n\x0b\f\r")))
    return F.when(own != "", own)


def _breach(broken: Column, code: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.lit(code))


def _held(v: Column) -> Column:
    """The keys of a mapping; null for another kind."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def _keys(held: Column, part: str) -> Column:
    """The codes of keys that lack or don't belong, of those `held`; of a value that is no mapping that alone."""
    needed, optional = KEYS[part]
    lead = f"{part}." if part else ""
    lacks = _codes(*[_breach(~F.array_contains(held, k), f"{lead}{k}: missing") for k in needed])
    others = F.array_except(held, F.array(*map(F.lit, (*needed, *optional))))
    odd = F.when(F.size(others) > 0, F.transform(others, lambda k: F.concat(F.lit(lead), k, F.lit(": unknown")))).otherwise(F.array().cast("array<string>"))
    return F.when(held.isNull(), F.array(F.lit(f"{part or 'response'}: no mapping"))).otherwise(F.concat(lacks, odd))


def _has(v: Column, key: str) -> Column:
    return _part(v, key).isNotNull()


def _in_range(v: Column, key: str, code: str, most: float | None = 1.0) -> list[Column]:
    own = _part(v, key)
    beyond = (_number(own) < 0) | (_number(own) > most) if most is not None else _number(own) < 0
    return [_breach(_has(v, key) & ~_is_number(own), f"{code}: no number"), _breach(beyond, f"{code}: out of range")]


def _codes(*codes: Column) -> Column:
    """Those that aren't null; they hold no line break. A filter by a lambda would not be compiled, nor what is in it."""
    return F.array_remove(F.split(F.concat_ws("\n", *codes), "\n"), "")


PARTS = ("model", "prompt", "usage", "evidence")


def _own_breaches(v: Column) -> Column:
    """The codes of a response that are about itself; its parts and their keys are columns beside it, taken out once."""
    model, prompt, usage, evidence = (F.col(f"of_{p}") for p in PARTS)
    keys = [_keys(F.col("held"), "")] + [F.when(F.col(f"of_{p}").isNotNull(), _keys(F.col(f"held_{p}"), p)).otherwise(F.array().cast("array<string>")) for p in PARTS[:3]]
    blank = [_breach(_has(of, k) & _text(_part(of, k)).isNull(), f"{p}.{k}: blank") for p, of in (("model", model), ("prompt", prompt)) for k in KEYS[p][0]]
    digest = _text(_part(prompt, "sha256"))
    counts = [_breach(_has(usage, k) & ~_is_count(_part(usage, k)), f"usage.{k}: no count") for k in ("input_tokens", "output_tokens")]
    counts += [_breach(_given(_part(usage, k)) & ~_is_count(_part(usage, k)), f"usage.{k}: no count") for k in KEYS["usage"][1][:-1]]
    flag = _part(usage, "cost_known")
    ids = F.col("ids")
    known = F.col("prompt_id").isNotNull()
    another = ~(
        (_text(_part(prompt, "prompt_id")) == F.col("prompt_id")) & (_text(_part(prompt, "version")) == F.col("prompt_version")) & (F.lower(digest) == F.col("prompt_sha256"))
    )
    return F.concat(
        *keys,
        _codes(
            _breach(~known, "request: unknown"),
            *_in_range(v, "score", "score"), *_in_range(v, "confidence", "confidence"), *blank,
            _breach(digest.isNotNull() & ~F.lower(digest).rlike("^[0-9a-f]{64}$"), "prompt.sha256: no digest"),
            _breach(known & another, "prompt: another one"),
            *counts, *_in_range(usage, "cost", "usage.cost", None), _breach(_given(flag) & (_kind(flag) != "BOOLEAN"), "usage.cost_known: no boolean"),
            _breach(evidence.isNotNull() & ids.isNull(), "evidence: no list"), _breach(F.size(ids) == 0, "evidence: empty"),
            _breach(F.size(F.array_distinct(F.array_compact(ids))) < F.size(F.array_compact(ids)), "evidence.evidence_id: repeated"),
        ),
    )


def _item_breaches(e: Column) -> Column:
    """The codes of an evidence item that are about itself and the deck's length."""
    page, thing, uri, box = (_part(e, k) for k in ("page_number", "object_id", "source_uri", "bbox"))
    sides = F.try_variant_get(box, "$", "array<variant>")
    numbers = F.transform(sides, _number)
    no_box = sides.isNull() | (F.size(sides) != 4) | F.exists(numbers, lambda x: x.isNull())
    outside = F.exists(numbers, lambda x: (x < 0) | (x > 1))
    wide = F.try_add(F.get(numbers, F.lit(0)), F.get(numbers, F.lit(2))) > lit(EDGE)
    high = F.try_add(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(3))) > lit(EDGE)
    mapped = F.col("held").isNotNull()
    return F.concat(
        _keys(F.col("held"), "evidence"),
        _codes(
            *[_breach(_has(e, k) & _text(_part(e, k)).isNull(), f"evidence.{k}: blank") for k in KEYS["evidence"][0]],
            *[_breach(_given(_part(e, k)) & _text(_part(e, k)).isNull(), f"evidence.{k}: blank") for k in ("object_id", "source_uri")],
            _breach(_given(page) & ~(_is_count(page) & (_number(page) > 0)), "evidence.page_number: no page"),
            _breach(_is_count(page) & (_number(page) > F.col("slide_count")), "evidence.page_number: beyond the deck"),
            _breach(mapped & ~_given(page).eqNullSafe(True) & ~_given(uri).eqNullSafe(True), "evidence: no location"),
            _breach(_given(thing) & ~_given(page).eqNullSafe(True), "evidence.object_id: without page"),
            _breach(_given(box) & no_box, "evidence.bbox: no box"), _breach(~no_box & outside, "evidence.bbox: out of range"),
            _breach(~no_box & ~outside & (wide | high), "evidence.bbox: beyond the slide"),
            _breach(_has(e, "payload") & _held(_part(e, "payload")).isNull(), "evidence.payload: no mapping"),
        ),
    )


def breaches(responses: DataFrame, requests: DataFrame, pages: DataFrame, objects: DataFrame, uris: DataFrame) -> DataFrame:
    """response_id, place, code: one row for each breach of the contract by each row of `responses` (response_id,
    request_id, body: a JSON text); place counts the evidence items from 0 and is null for what isn't about one.

    `requests` (request_id, slide_count, visual, prompt_id, prompt_version, prompt_sha256) has one row a request; `pages`
    (request_id, page) are those supplied as images, `objects` (request_id, page, object_id) those that stand on them,
    `uris` (request_id, uri) the known addresses. Repeated rows of these count once. A text that is no JSON object breaks
    the contract as a whole. A page need not have been supplied where the request isn't visual. Responses without breach
    have no row; equal breaches of one item are one.
    """
    read = responses.join(requests, "request_id", "left").withColumn("v", F.try_parse_json("body"))
    # each step is a column of its own before it is used often, and codes are one before they are exploded: within an
    # expression of an explode nothing is shared, so every rule would take the text apart anew
    taken = read.withColumns({f"of_{p}": _part(F.col("v"), p) for p in PARTS}).withColumn("held", _held(F.col("v")))
    ids = F.transform(F.try_variant_get("of_evidence", "$", "array<variant>"), lambda x: _text(_part(x, "evidence_id")))
    taken = taken.withColumns({**{f"held_{p}": _held(F.col(f"of_{p}")) for p in PARTS[:3]}, "ids": ids})
    told = taken.select("response_id", F.array_distinct(_own_breaches(F.col("v"))).alias("codes"))
    # outer: below an explode Spark puts a filter on the size of its array, which would make all codes once more for each
    # mention of them
    own = told.select("response_id", F.lit(None).cast("int").alias("place"), F.explode_outer("codes").alias("code")).where("code is not null")
    items = read.select("response_id", "request_id", "slide_count", "visual", F.posexplode_outer(F.try_variant_get("v", "$.evidence", "array<variant>")).alias("place", "e"))
    items = items.where("place is not null").withColumn("held", _held(F.col("e")))
    page, uri, thing = (_part(F.col("e"), k) for k in ("page_number", "source_uri", "object_id"))
    items = items.select(
        "response_id", "request_id", "place", "visual", "slide_count", _item_breaches(F.col("e")).alias("codes"),
        F.when(_is_count(page), F.try_variant_get(page, "$", "long")).alias("page"), _text(uri).alias("uri"), _text(thing).alias("object_id"),
    )
    here = F.lit(True)
    found = (
        items.join(pages.select("request_id", "page").distinct().withColumn("has_page", here), ["request_id", "page"], "left")
        .join(objects.select("request_id", "page", "object_id").distinct().withColumn("has_object", here), ["request_id", "page", "object_id"], "left")
        .join(uris.select("request_id", "uri").distinct().withColumn("has_uri", here), ["request_id", "uri"], "left")
    )
    inside = (F.col("page") > 0) & (F.col("page") <= F.col("slide_count"))
    absent = _codes(
        _breach(F.col("visual") & inside & F.col("has_page").isNull(), "evidence.page_number: not supplied"),
        _breach(F.col("uri").isNotNull() & F.col("has_uri").isNull(), "evidence.source_uri: unknown"),
        _breach(F.col("page").isNotNull() & F.col("object_id").isNotNull() & F.col("has_object").isNull(), "evidence.object_id: not on the page"),
    )
    about = found.select("response_id", "place", F.array_distinct(F.concat("codes", absent)).alias("codes"))
    about = about.select("response_id", "place", F.explode_outer("codes").alias("code")).where("code is not null")
    return own.unionByName(about)


def accepted(responses: DataFrame, found: DataFrame) -> DataFrame:
    """response_id, valid, n_breaches, codes, score, confidence for every row of `responses`; `found` is a result of
    breaches over them. A response with any breach has no score."""
    told = found.groupBy("response_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.concat(F.col("code"), F.when(F.col("place").isNull(), "").otherwise(F.concat(F.lit(" @"), F.col("place").cast("string")))))).alias("codes"),
    )
    v = F.try_parse_json("body")
    valid = F.col("n").isNull()
    return responses.join(told, "response_id", "left").select(
        "response_id", valid.alias("valid"), F.coalesce("n", F.lit(0).cast("long")).alias("n_breaches"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"),
        *[F.when(valid, F.try_variant_get(v, f"$.{c}", "double")).alias(c) for c in ("score", "confidence")],
    )


def grounded(criterion: Column, codes: Column, affected: Column, page: Column, has_box: Column) -> Column:
    """Why an assessment has no score: a defect that compares pages without two of them, or a defect of rendering that is
    not located on an affected page; null if nothing is amiss. Null lists count as empty."""
    n_codes = F.coalesce(F.size(codes), F.lit(0))
    pages = F.array_distinct(F.coalesce(affected, F.array().cast("array<int>")))
    apart = criterion.isin(*DECK_LEVEL) & (n_codes > 0) & (F.size(pages) < 2)
    lost = (criterion == "render_integrity") & (n_codes > 0) & (~F.coalesce(has_box, F.lit(False)) | ~F.coalesce(F.array_contains(pages, page), F.lit(False)))
    return F.when(apart, "DECK_LEVEL_COMPARISON_GROUNDING_INSUFFICIENT").when(lost, "RENDER_DEFECT_LOCALIZATION_INSUFFICIENT")


def ground_scores(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The columns `by`, reason, score, observability of assessments (`by`, criterion, codes, affected, page, has_box,
    score, observability): what isn't grounded loses its score."""
    why = grounded(*(F.col(c) for c in ("criterion", "codes", "affected", "page", "has_box")))
    told = rows.withColumn("reason", why)
    held = F.col("reason").isNull()
    return told.select(*by, "reason", F.when(held, F.col("score")).alias("score"), F.when(held, F.col("observability")).otherwise("INSUFFICIENT").alias("observability"))
