"""Queries over `events` and `customer` read as stored observations and profiles, some of them tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.scores import lit
from tallyscope.plans.observations import OBS, observations
from tallyscope.plans.registry import query
from tallyscope.sources.artifacts import LEGACY_FIELDS, PROFILE_FIELDS, PROFILE_VERSION, SCENE_ALIASES, SCENES, scan_profiles, seal, verify
from tallyscope.sources.tables import table


@query(
    "q104_sealed_observations",
    f"""WITH {OBS}, r AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE k % 25 = 0) AS n_changed, count(*) FILTER (WHERE k % 23 = 4) AS n_lost FROM obs GROUP BY run),
s AS (SELECT run, CASE WHEN run % 11 = 3 THEN 0 WHEN run % 5 = 2 THEN n - n_lost ELSE n END AS n_rows, run % 13 = 5 AS unnamed, (run % 7 = 0 AND n_changed > 0) OR (run % 5 = 2 AND n_lost > 0) AS changed FROM r)
SELECT run, n_rows, CASE WHEN unnamed THEN 'UNNAMED' WHEN n_rows = 0 THEN 'MISSING' WHEN changed THEN 'CHANGED' ELSE 'VERIFIED' END AS status FROM s WHERE NOT (unnamed AND n_rows = 0)""",
)
def sealed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations against the manifest that was made of them, after values of some runs were changed, rows of
    others lost, some lost whole, and some never named."""
    run, k = F.col("run"), F.col("k")
    kept = observations(spark, sf_dir).select("event_id", "run", "metric", "page", "k", "status", "value")
    columns = kept.columns
    manifest = seal(kept, "run", columns).where("run % 13 <> 5")
    value = F.when((run % 7 == 0) & (k % 25 == 0), F.col("value") + lit(1)).otherwise(F.col("value"))
    found = kept.where(~((run % 11 == 3) | ((run % 5 == 2) & (k % 23 == 4)))).withColumn("value", value)
    return verify(found.select(*columns), manifest, "run", columns)


#: A profile's text for each customer, and its pieces, as SQL that Spark and DuckDB both read.
SCENE = "CASE c_nationkey % 6 WHEN 0 THEN ' FINISHED_DECK' WHEN 1 THEN 'Text_To_Ppt' WHEN 2 THEN 'multimodal' WHEN 3 THEN 'unheard_of' WHEN 4 THEN 'PROJECT_SUMMARY' ELSE '' END"
VERSION = "CASE WHEN c_custkey % 10 = 3 THEN '8.2' ELSE '8.3' END"
PROFILE = f"""'{{"profile_id":"p' || c_custkey || '","' || CASE WHEN c_custkey % 2 = 0 THEN 'scene' ELSE 'scenario' END || '":"' || ({SCENE}) || '","base_weights":{{"layout":' || (c_custkey % 5) || ',"content":0.5}},"scene_weights":{{"content":'
  || (c_nationkey % 4) || '.25}},"base_multiplier_metric_ids":["gate"],' || CASE WHEN c_custkey % 9 = 1 THEN '"required_oracles":["x"],' ELSE '' END || CASE WHEN c_custkey % 8 = 0 THEN '' ELSE '"pipeline_nodes":[{{"id":"a"}}],' END
  || CASE WHEN c_custkey % 6 = 1 THEN '' ELSE '"required_metric_ids":["layout","' || c_mktsegment || '"],' END || '"scene_multiplier_metric_ids":[],"version":"' || ({VERSION}) || '"}}'"""
TEXT = f"CASE WHEN c_custkey % 12 = 5 THEN substr({PROFILE}, 1, 25) WHEN c_custkey % 17 = 6 THEN '[1]' ELSE {PROFILE} END"
_KEY = lambda k: f"list_contains(json_keys(j), '{k}')"
_RULES = (
    [f"CASE WHEN NOT {_KEY(k)} THEN '{k}: missing' END" for k in PROFILE_FIELDS] + [f"CASE WHEN {_KEY(k)} THEN '{k}: of an earlier form' END" for k in LEGACY_FIELDS]
    + [f"CASE WHEN scene NOT IN {SCENES} THEN 'scene: unknown' END", f"CASE WHEN {_KEY('version')} AND version <> '{PROFILE_VERSION}' THEN 'version: not read' END"]
)


@query(
    "q105_profile_scan",
    f"""WITH t AS (SELECT c_custkey, {TEXT} AS content FROM customer),
w AS (SELECT c_custkey, CASE WHEN json_valid(content) AND content LIKE '{{%' THEN content::json END AS j FROM t),
f AS (SELECT c_custkey, j, json_extract_string(j, '$.profile_id') AS profile_id, json_extract_string(j, '$.version') AS version,
  lower(trim(coalesce(nullif(json_extract_string(j, '$.scene'), ''), json_extract_string(j, '$.scenario'), ''), ' ')) AS named FROM w),
s AS (SELECT *, CASE named {" ".join(f"WHEN '{a}' THEN '{x}'" for a, x in SCENE_ALIASES.items())} ELSE named END AS scene FROM f),
b AS (SELECT *, CASE WHEN j IS NULL THEN ['no JSON object'] ELSE list_filter([{", ".join(_RULES)}], lambda e: e IS NOT NULL) END AS breaches FROM s)
SELECT 'profiles/' || c_custkey || '.json' AS path, profile_id, scene, version, json_extract_string(j, '$.base_weights.layout')::double AS layout_weight, json_extract_string(j, '$.scene_weights.content')::double AS content_weight,
  coalesce(json_array_length(j, '$.required_metric_ids'), 0)::int AS n_required, array_to_string(breaches, '; ') AS breaches, len(breaches) = 0 AS valid FROM b""",
)
def profile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles of all customers as JSON texts, what each says, and what is wrong with it."""
    files = table(spark, sf_dir, "customer").select(F.expr("'profiles/' || c_custkey || '.json'").alias("path"), F.expr(TEXT).alias("content"))
    found = scan_profiles(files)
    weight = lambda m: F.try_element_at("weights", F.lit(m)).alias(f"{m}_weight")
    return found.select("path", "profile_id", "scene", "version", weight("layout"), weight("content"), F.size("required").alias("n_required"), F.array_join("breaches", "; ").alias("breaches"), "valid")
