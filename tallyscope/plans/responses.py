"""Queries over `events` read as responses of models: each event is a JSON text that answers the request of its run."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.scores import round6
from tallyscope.operators.contract import DECK_LEVEL, EDGE, KEYS, accepted, breaches, ground_scores
from tallyscope.plans.observations import OBS, observations
from tallyscope.plans.registry import query
from tallyscope.sources.tables import dealt

SLIDES = 18
PROMPT = hashlib.sha256(b"tallyscope").hexdigest()
#: The pieces of a response by k, as SQL that Spark and DuckDB both read.
PIECES = {
    "score": """CASE k % 13 WHEN 0 THEN '"score":"high",' WHEN 1 THEN '"score":1.5,' WHEN 2 THEN '"score":true,' WHEN 3 THEN '' ELSE '"score":0.' || (k % 89 + 10) || ',' END""",
    "confidence": """CASE k % 11 WHEN 0 THEN '"confidence":-0.1,' WHEN 1 THEN '"confidence":null,' ELSE '"confidence":0.' || (k % 50 + 40) || ',' END""",
    "model": """CASE k % 7 WHEN 0 THEN '"model":{"provider":"p","model_id":"  ","version":"1"},' WHEN 1 THEN '"model":{"provider":"p","model_id":"m","seed":1},' ELSE '"model":{"provider":"p","model_id":"m","version":"1"},' END""",
    "prompt": f"""'"prompt":{{"prompt_id":"' || metric || '","version":"' || CASE WHEN k % 9 = 0 THEN '0' ELSE '1' END || '","sha256":"' || CASE WHEN k % 9 = 1 THEN 'zz' ELSE '{PROMPT}' END || '"}},'""",
    "usage": """CASE k % 8 WHEN 0 THEN '"usage":{"input_tokens":-1,"output_tokens":2,"cost":0.5},' WHEN 1 THEN '"usage":{"input_tokens":1,"output_tokens":2,"cost":"free"},' WHEN 2 THEN '"usage":{"input_tokens":1,"output_tokens":2,"cost":0,"image_tokens":2.5},' ELSE '"usage":{"input_tokens":' || k || ',"output_tokens":2,"cost":0.25,"cost_known":true},' END""",
    "note": """CASE WHEN k % 17 = 0 THEN '"note":"x",' ELSE '' END""",
    "first": """'{"evidence_id":"e1","kind":"k","message":"m","page_number":' || page || ',"object_id":"o' || (event_id % 7) || '","bbox":' || CASE k % 6 WHEN 0 THEN '[0.9,0.1,0.2,0.1]' WHEN 1 THEN '[0.1,0.1,0.2]' WHEN 2 THEN 'null' WHEN 3 THEN '[0.1,0.1,1.5,0.1]' ELSE '[0.1,0.1,0.2,0.2]' END || '}'""",
    "second": """'{"evidence_id":"' || CASE WHEN k % 5 = 0 THEN 'e1' ELSE 'e2' END || '","kind":"' || CASE WHEN k % 10 = 3 THEN ' ' ELSE 'k' END || '","message":"m"' || CASE WHEN k % 14 = 0 THEN '' ELSE ',"source_uri":"file://' || (run - CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) || '"' END || CASE WHEN k % 15 = 4 THEN ',"payload":[1]' ELSE ',"payload":{"a":1}' END || '}'""",
}
BODY = (
    f"""'{{' || {" || ".join(f"({PIECES[x]})" for x in ("score", "confidence", "model", "prompt", "usage", "note"))} || '"evidence":' """
    f"""|| CASE k % 12 WHEN 0 THEN '[]' WHEN 1 THEN '"none"' ELSE '[' || {PIECES["first"]} || ',' || {PIECES["second"]} || ']' END || '}}'"""
)

_TEXT = lambda j, k: f"CASE WHEN json_type({j}, '$.{k}') = 'VARCHAR' THEN nullif(regexp_replace(json_extract_string({j}, '$.{k}'), '^\\s+|\\s+$', '', 'g'), '') END"
_NUMERIC = "('DOUBLE', 'UBIGINT', 'BIGINT', 'HUGEINT')"


def _own_sql() -> str:
    """A SELECT for each rule about the response itself."""
    rows = []
    for part, (needed, optional) in KEYS.items():
        if part == "evidence":
            continue
        j, lead = (f"json_extract(body, '$.{part}')", f"{part}.") if part else ("body", "")
        for key in needed:
            rows.append((f"json_type({j}) = 'OBJECT' AND NOT list_contains(json_keys({j}), '{key}')", f"{lead}{key}: missing"))
        for key in ("note", "seed"):  # all that can be unknown here
            rows.append((f"json_type({j}) = 'OBJECT' AND list_contains(json_keys({j}), '{key}')", f"{lead}{key}: unknown"))
    for j, key, code, most in (("body", "score", "score", 1), ("body", "confidence", "confidence", 1), ("json_extract(body, '$.usage')", "cost", "usage.cost", None)):
        kind = f"json_type({j}, '$.{key}')"
        rows.append((f"{kind} NOT IN {_NUMERIC}", f"{code}: no number"))
        own = f"CASE WHEN {kind} IN {_NUMERIC} THEN json_extract_string({j}, '$.{key}')::double END"
        rows.append((f"{own} < 0" + (f" OR {own} > {most}" if most else ""), f"{code}: out of range"))
    for part in ("model", "prompt"):
        for key in KEYS[part][0]:
            j = f"json_extract(body, '$.{part}')"
            rows.append((f"list_contains(json_keys({j}), '{key}') AND {_TEXT(j, key)} IS NULL", f"{part}.{key}: blank"))
    prompt = "json_extract(body, '$.prompt')"
    rows.append((f"NOT regexp_full_match(lower({_TEXT(prompt, 'sha256')}), '[0-9a-f]{{64}}')", "prompt.sha256: no digest"))
    rows.append((f"{_TEXT(prompt, 'prompt_id')} <> metric OR {_TEXT(prompt, 'version')} <> '1' OR lower({_TEXT(prompt, 'sha256')}) <> '{PROMPT}'", "prompt: another one"))
    for key in (*KEYS["usage"][0][:2], *KEYS["usage"][1][:-1]):
        kind = f"json_type(body, '$.usage.{key}')"
        rows.append((f"{kind} NOT IN ('UBIGINT', 'NULL') OR ({kind} = 'NULL' AND '{key}' IN ('input_tokens', 'output_tokens'))", f"usage.{key}: no count"))
    rows.append(("json_type(body, '$.evidence') <> 'ARRAY'", "evidence: no list"))
    rows.append(("json_array_length(body, '$.evidence') = 0 AND json_type(body, '$.evidence') = 'ARRAY'", "evidence: empty"))
    rows.append(("json_extract_string(body, '$.evidence[0].evidence_id') = json_extract_string(body, '$.evidence[1].evidence_id')", "evidence.evidence_id: repeated"))
    return " UNION ALL ".join(f"SELECT event_id, '{code}' AS code FROM bodies WHERE {rule}" for rule, code in rows)


def _items_sql() -> str:
    box = "json_extract(e, '$.bbox')"
    side = lambda i: f"json_extract_string(e, '$.bbox[{i}]')::double"
    four = f"json_type({box}) = 'ARRAY' AND json_array_length({box}) = 4"
    beyond = " OR ".join(f"{side(i)} < 0 OR {side(i)} > 1" for i in range(4))
    rules = (
        (f"list_contains(json_keys(e), 'kind') AND {_TEXT('e', 'kind')} IS NULL", "evidence.kind: blank"),
        (f"page > {SLIDES}", "evidence.page_number: beyond the deck"),
        ("page IS NULL AND uri IS NULL", "evidence: no location"),
        (f"json_type({box}) <> 'NULL' AND NOT ({four})", "evidence.bbox: no box"),
        (f"{four} AND ({beyond})", "evidence.bbox: out of range"),
        (f"{four} AND NOT ({beyond}) AND ({side(0)} + {side(2)} > {EDGE}::double OR {side(1)} + {side(3)} > {EDGE}::double)", "evidence.bbox: beyond the slide"),
        ("json_type(e, '$.payload') <> 'OBJECT'", "evidence.payload: no mapping"),
        (f"page BETWEEN 1 AND {SLIDES} AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.run = items.run AND o.page = items.page AND o.metric = 'view')", "evidence.page_number: not supplied"),
        ("uri IS NOT NULL AND NOT EXISTS (SELECT 1 FROM obs o WHERE uri = 'file://' || o.run AND o.run = items.run)", "evidence.source_uri: unknown"),
        ("page IS NOT NULL AND thing IS NOT NULL AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.run = items.run AND o.page = items.page AND thing = 'o' || (o.event_id % 7) AND o.metric IN ('click', 'error'))", "evidence.object_id: not on the page"),
    )
    return " UNION ALL ".join(f"SELECT event_id, '{code} @' || place AS code FROM items WHERE {rule}" for rule, code in rules)


CONTRACT = f"""{OBS},
bodies AS (SELECT event_id, run, metric, ({BODY})::json AS body FROM obs),
items AS (
  SELECT event_id, run, place, e, json_extract_string(e, '$.page_number')::bigint AS page, {_TEXT("e", "source_uri")} AS uri, json_extract_string(e, '$.object_id') AS thing FROM (
    SELECT event_id, run, unnest([0, 1]) AS place, unnest([json_extract(body, '$.evidence[0]'), json_extract(body, '$.evidence[1]')]) AS e FROM bodies) WHERE e IS NOT NULL),
told AS ({_own_sql()} UNION ALL {_items_sql()}),
listed AS (SELECT event_id, count(*) AS n, list_sort(list(code)) AS codes FROM told GROUP BY event_id)"""


def responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """The responses and what the requests of the runs supplied: seen pages, the objects on them, known addresses."""
    obs = observations(spark, sf_dir)
    asked = F.concat_ws("/", F.col("run").cast("string"), "metric").alias("request_id")
    bodies = dealt(obs, "event_id").select(F.col("event_id").alias("response_id"), asked, F.expr(BODY).alias("body"))
    own = obs.select("run", "metric").distinct()
    requests = own.select(
        asked, F.lit(SLIDES).alias("slide_count"), F.lit(True).alias("visual"), F.col("metric").alias("prompt_id"), F.lit("1").alias("prompt_version"), F.lit(PROMPT).alias("prompt_sha256")
    )
    of_run = lambda rows: rows.distinct().join(own.select("run", asked), "run").drop("run")
    pages = of_run(obs.where("metric = 'view'").select("run", "page"))
    objects = of_run(obs.where("metric in ('click', 'error')").select("run", "page", F.concat(F.lit("o"), (F.col("event_id") % 7).cast("string")).alias("object_id")))
    uris = of_run(obs.select("run", F.concat(F.lit("file://"), F.col("run").cast("string")).alias("uri")))
    return bodies, requests, pages, objects, uris


@query(
    "q85_response_contract",
    f"""WITH {CONTRACT}
SELECT event_id AS response_id, l.n IS NULL AS valid, coalesce(l.n, 0) AS n_breaches, coalesce(array_to_string(l.codes, '; '), '') AS codes,
  round(CASE WHEN l.n IS NULL THEN json_extract_string(body, '$.score')::double END, 6) AS score, round(CASE WHEN l.n IS NULL THEN json_extract_string(body, '$.confidence')::double END, 6) AS confidence
FROM bodies LEFT JOIN listed l USING (event_id)""",
)
def response_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every breach of the contract by each response, and the scores of those without."""
    bodies, requests, pages, objects, uris = responses(spark, sf_dir)
    found = accepted(bodies, breaches(bodies, requests, pages, objects, uris))
    return found.select("response_id", "valid", "n_breaches", F.array_join("codes", "; ").alias("codes"), round6(F.col("score")).alias("score"), round6(F.col("confidence")).alias("confidence"))


CRITERIA = ("cross_slide_consistency", "authorship_specificity", "render_integrity", "color_contrast", "composition_layout")


@query(
    "q86_grounded_scores",
    f"""WITH {OBS},
affected AS (SELECT run, metric, list_sort(list(DISTINCT page)) AS pages FROM obs WHERE severity IN ('MAJOR', 'CRITICAL') AND status = 'SCORED' GROUP BY ALL),
a AS (
  SELECT event_id, eff, page, [{", ".join(f"'{c}'" for c in CRITERIA)}][k % 5 + 1] AS criterion, severity IN ('MAJOR', 'CRITICAL') AS bad, k % 3 <> 0 AS has_box, coalesce(pages, []) AS pages
  FROM obs LEFT JOIN affected USING (run, metric) WHERE status = 'SCORED'),
w AS (
  SELECT *, CASE WHEN bad AND criterion IN ({", ".join(f"'{c}'" for c in DECK_LEVEL)}) AND len(pages[8:]) < 2 THEN 'DECK_LEVEL_COMPARISON_GROUNDING_INSUFFICIENT'
    WHEN bad AND criterion = 'render_integrity' AND NOT (has_box AND list_contains(pages, page)) THEN 'RENDER_DEFECT_LOCALIZATION_INSUFFICIENT' END AS reason FROM a)
SELECT event_id, criterion, reason, round(CASE WHEN reason IS NULL THEN eff END, 6) AS score, CASE WHEN reason IS NULL THEN 'FULL' ELSE 'INSUFFICIENT' END AS observability FROM w""",
)
def grounded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores whose defects aren't grounded on pages are withdrawn; the pages of a comparison are those after the
    seventh on which its run and metric have serious findings."""
    obs = observations(spark, sf_dir)
    serious = F.col("severity").isin("MAJOR", "CRITICAL")
    pages = obs.where(serious & (F.col("status") == "SCORED")).groupBy("run", "metric").agg(F.array_sort(F.collect_set("page")).alias("pages"))  # 20 pages at most
    a = obs.where("status = 'SCORED'").join(pages, ["run", "metric"], "left")
    criterion = F.element_at(F.array(*map(F.lit, CRITERIA)), F.col("k") % 5 + 1)
    whole = F.coalesce("pages", F.array().cast("array<bigint>"))
    affected = F.when(criterion.isin(*DECK_LEVEL), F.slice(whole, 8, 20)).otherwise(whole)
    rows = a.select(
        "event_id", criterion.alias("criterion"), F.when(serious, F.array(F.lit("x"))).alias("codes"), affected.cast("array<int>").alias("affected"), F.col("page").cast("int").alias("page"),
        (F.col("k") % 3 != 0).alias("has_box"), F.col("eff").alias("score"), F.lit("FULL").alias("observability"),
    )
    found = ground_scores(rows, ["event_id", "criterion"])
    return found.withColumn("score", round6(F.col("score")))
