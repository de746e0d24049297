"""Queries that choose: issues that several families report, the evidence shown first, the pages a model sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.operators.attention import FAMILIES, OWNER, SOURCES, WORST_FIRST, merge_across, rank_evidence
from tallyscope.operators.sampling import authorship_sample
from tallyscope.plans.documents import LOAD, PAGES, pages, reading_load
from tallyscope.plans.observations import OBS, RAW, observations, raw_issues
from tallyscope.plans.registry import query

CODES = ("COLOR_CONTRAST", "GENERIC_COPY", "UNLISTED", "SMALL_TEXT")
IN_FAMILY = {"layout": "VISUAL_LAYOUT_READABILITY", "typography": "VISUAL_COMMUNICATION", "content": "CONTENT_EXPRESSION", "delivery": "DELIVERY_INTEGRITY"}


def _case(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _place(x: str, names: tuple[str, ...]) -> str:
    return f"coalesce(list_position([{', '.join(repr(n) for n in names)}], {x}), {len(names) + 1})"


@query(
    "q89_cross_family_merge",
    f"""WITH {OBS}, {RAW},
own AS (
  SELECT run * 20 + page AS run, {_case("family", IN_FAMILY)} AS family, metric, code, priority, rank, source, 1 + rank % 3 AS page,
    [{", ".join(f"'{c}'" for c in CODES)}][(run + page) % 4 + 1] AS shared FROM issues),
fam AS (
  SELECT run, family, list_sort(list(DISTINCT page)) AS pages, list_sort(list(DISTINCT shared)) AS codes FROM own GROUP BY run, family),
keyed AS (
  SELECT *, CASE WHEN len(codes) = 1 AND codes[1] IN ({", ".join(f"'{c}'" for c in OWNER)}) THEN '=' || codes[1] || array_to_string(pages, ',') ELSE family END AS bucket,
    CASE WHEN len(codes) = 1 THEN {_case("codes[1]", OWNER)} END AS mapped FROM fam),
met AS (
  SELECT run, bucket, list(family ORDER BY {_place("family", FAMILIES)}) AS families, any_value(mapped) AS mapped FROM keyed GROUP BY run, bucket),
owned AS (SELECT *, CASE WHEN bucket LIKE '=%' AND list_contains(families, mapped) THEN mapped ELSE families[1] END AS owner FROM met),
whole AS (
  SELECT o.run, w.owner AS family, w.families, min(priority) AS priority, max(rank) AS rank, list_sort(list(DISTINCT page)) AS pages, list_sort(list(DISTINCT metric)) AS metrics,
    list_sort(list(DISTINCT shared)) AS codes, count(*) AS n_findings, CASE WHEN bool_or(source = 'CONFLICT') THEN 'CONFLICT' WHEN bool_or(source = 'RULE') AND bool_or(source = 'MODEL') THEN 'AGREED'
      WHEN bool_or(source = 'GAP') THEN 'INSUFFICIENT' ELSE 'SINGLE_SOURCE' END AS consensus
  FROM own o JOIN keyed k USING (run, family) JOIN owned w ON w.run = k.run AND w.bucket = k.bucket GROUP BY o.run, w.owner, w.families)
SELECT run, family, array_to_string(families, ',') AS families, priority, rank, array_to_string(pages, ',') AS pages, array_to_string(metrics, ',') AS metrics, array_to_string(codes, ',') AS codes,
  n_findings, consensus FROM whole""",
)
def cross_family_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of each page of a run, merged across families where they are about the same; what an issue calls
    its pages are the ranks of its findings."""
    raw = raw_issues(spark, sf_dir)
    family = F.create_map(*[F.lit(x) for kv in IN_FAMILY.items() for x in kv])
    rank = F.array_position(F.array(*map(F.lit, ("NONE", "INFO", "MINOR", "MAJOR", "CRITICAL"))), F.col("severity"))
    code = F.element_at(F.array(*map(F.lit, CODES)), ((F.col("run") + F.col("page")) % 4 + 1).cast("int"))
    own = raw.select((F.col("run") * 20 + F.col("page")).alias("run"), F.try_element_at(family, "family").alias("family"), "metric", (1 + rank % 3).alias("page"), code.alias("code"), "priority", "severity", "source")
    found = merge_across(own, tuple(OWNER))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("run", "family", text("families"), "priority", "rank", text("pages"), text("metrics"), text("codes"), "n_findings", "consensus")


KEPT = 3
DEFECTS = ("TITLE", "CROP")


@query(
    "q90_evidence_ranking",
    f"""WITH {OBS},
e AS (
  SELECT run, CASE k % 5 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN 'MODEL' WHEN 2 THEN 'REDUCER' ELSE 'RULE' END AS source, ['OVERLAP', 'TITLE', 'CROP', ''][k % 4 + 1] AS kind,
    CASE WHEN k % 7 = 0 THEN NULL ELSE page END AS page, 'o' || (event_id % 3) AS object, metric AS message, severity, CASE WHEN k % 9 <> 0 THEN confidence END AS confidence, 'e' || (event_id % 50) AS evidence_id,
    CASE WHEN k % 6 = 0 THEN 'null' ELSE '[0.1,0.' || (k % 8 + 1) || ']' END AS box, k, page AS spot FROM obs),
c AS (SELECT *, CASE WHEN k % 10 = 0 THEN (CASE WHEN kind IN ('TITLE', 'CROP') THEN [kind] ELSE [] END) ELSE ['C' || (k % 3)] END AS codes FROM e),
g AS (
  SELECT run, source, kind, page, object, message, list_sort(list_distinct(flatten(list(codes)))) AS codes, list_sort(list(DISTINCT spot)) AS affected,
    min({{'worst': {_place("severity", WORST_FIRST)}, 'sure': coalesce(-confidence, 1), 'evidence_id': evidence_id, 'box': box, 'codes': codes, 'severity': severity, 'confidence': confidence}}) AS x
  FROM c GROUP BY run, source, kind, page, object, message),
r AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY {_place("source", SOURCES)}, x.worst, page IS NULL, page NULLS LAST, x.evidence_id, kind, object, message, x.box, codes, affected) AS rank FROM g)
SELECT run, rank, source, kind, page, object, message, x.severity AS severity, round(x.confidence, 6) AS confidence, x.evidence_id AS evidence_id, x.box AS box,
  array_to_string(codes, ',') AS codes, array_to_string(affected, ',') AS affected FROM r WHERE rank <= {KEPT}""",
)
def evidence_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three pieces of evidence of a run that are shown first."""
    o, k = observations(spark, sf_dir), F.col("k")
    box = F.when(k % 6 != 0, F.array(F.lit(0.1), F.concat(F.lit("0."), (k % 8 + 1).cast("string")).cast("double")))
    rows = o.select(
        "run", F.element_at(F.array(*map(F.lit, ("SYSTEM", "MODEL", "REDUCER", "RULE", "OTHER"))), k % 5 + 1).alias("source"),
        F.element_at(F.array(*map(F.lit, ("OVERLAP", "TITLE", "CROP", ""))), k % 4 + 1).alias("kind"), F.when(k % 7 == 0, 0).otherwise(F.col("page")).alias("page"),
        F.concat(F.lit("o"), (F.col("event_id") % 3).cast("string")).alias("object"), F.col("metric").alias("message"), "severity", F.when(k % 9 != 0, F.col("confidence")).alias("confidence"),
        F.concat(F.lit("e"), (F.col("event_id") % 50).cast("string")).alias("evidence_id"), box.alias("bbox"),
        F.when(k % 10 != 0, F.array(F.concat(F.lit("C"), (k % 3).cast("string")))).alias("codes"), F.array(F.col("page").cast("int")).alias("affected"),
    )
    found = rank_evidence(rows, ["run"], KEPT, DEFECTS)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("run", "rank", "source", "kind", "page", "object", "message", "severity", F.round("confidence", 6).alias("confidence"), "evidence_id", "box", text("codes"), text("affected"))


BUDGET = 6


@query(
    "q91_authorship_sample",
    f"""WITH {PAGES}, {LOAD},
a AS (
  SELECT doc_id, page, n_pages, eff, importance, len(regexp_extract_all(lower(line), '[0-9]')) AS hits, 'page:' || page AS name,
    n_pages <= {BUDGET} OR list_contains(list_transform(range(0, {BUDGET}), lambda i: (i * (n_pages - 1)) // {BUDGET - 1} + 1), page) AS even, page = 1 OR page = n_pages AS is_end FROM loads),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, even, is_end, eff IS NOT NULL ORDER BY eff NULLS FIRST, importance DESC, name) AS nth FROM a),
m AS (SELECT *, eff IS NOT NULL AND NOT is_end AND even AND nth > 1 AND hits > 0 AS held FROM n),
h AS (SELECT *, held AND row_number() OVER (PARTITION BY doc_id, held ORDER BY hits DESC, eff NULLS FIRST, importance DESC, name) = 1 AS marked FROM m),
t AS (
  SELECT *, CASE WHEN is_end THEN 0 WHEN eff IS NOT NULL AND NOT even AND nth <= 2 THEN 1 WHEN eff IS NOT NULL AND even AND nth = 1 THEN 2 WHEN marked THEN 3 WHEN even THEN 4 ELSE 5 END AS tier FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, CASE tier WHEN 0 THEN (page <> 1)::int WHEN 1 THEN nth WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE page END) AS place FROM t)
SELECT doc_id, page, n_pages, tier, place FROM r WHERE place <= {BUDGET}""",
)
def authorship_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each document that a model sees to judge its authorship."""
    loads = reading_load(pages(spark, sf_dir)).withColumn("hits", F.regexp_count(F.lower("line"), F.lit("[0-9]")))
    found = authorship_sample(loads.select(F.col("doc_id").alias("deck"), "page", "n_pages", F.col("eff").alias("score"), "importance", "hits"), BUDGET)
    return found.select(F.col("deck").alias("doc_id"), "page", "n_pages", "tier", "place")
