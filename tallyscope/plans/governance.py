"""Queries over `events` read as proposals and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.canonical import record_digest
from tallyscope.plans.observations import OBS, observations
from tallyscope.plans.registry import query
from tallyscope.session import ship_package
from tallyscope.streaming.proposals import replay_proposals

ACTIONS = {"click": "create", "view": "validate", "purchase": "approve", "signup": "approve", "error": "approve"}


def proposal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVENT: a run and every tenth of its k is a proposal, its events what is done to it."""
    k = F.col("k")
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    actor = F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("a"), (k % 4).cast("string")))
    return observations(spark, sf_dir).select(
        F.concat_ws("/", F.col("run").cast("string"), (k % 10).cast("string")).alias("proposal"), F.col("event_id").alias("seq"), F.try_element_at(action, "metric").alias("action"),
        actor.alias("actor"), (k % 7 != 0).alias("complete"), (k % 11 != 0).alias("passed"),
    )


@query(
    "q96_proposal_governance",
    f"""WITH RECURSIVE {OBS},
e AS (
  SELECT run || '/' || (k % 10) AS proposal, event_id AS seq, CASE metric WHEN 'click' THEN 'create' WHEN 'view' THEN 'validate' ELSE 'approve' END AS action,
    CASE WHEN k % 13 = 0 THEN '' ELSE 'a' || (k % 4) END AS actor, k % 7 <> 0 AS complete, k % 11 <> 0 AS passed, row_number() OVER (PARTITION BY run, k % 10 ORDER BY event_id) AS nth FROM obs),
walk AS (
  SELECT proposal, 0::bigint AS nth, NULL::bigint AS seq, NULL::varchar AS action, NULL::varchar AS reason, NULL::varchar AS status, []::varchar[] AS signed FROM (SELECT DISTINCT proposal FROM e)
  UNION ALL
  SELECT proposal, nth, seq, action, reason,
    CASE WHEN reason IS NOT NULL THEN status WHEN action = 'create' THEN 'DRAFT' WHEN action = 'validate' THEN CASE WHEN passed THEN 'VALIDATED' ELSE 'REJECTED' END
      WHEN len(list_distinct(list_append(signed, actor))) >= 2 THEN 'RELEASE_CANDIDATE' ELSE 'APPROVED' END,
    CASE WHEN reason IS NULL AND action = 'approve' THEN list_distinct(list_append(signed, actor)) ELSE signed END
  FROM (
    SELECT w.proposal, e.nth, e.seq, e.action, e.actor, e.passed, w.status, w.signed,
      CASE WHEN e.action = 'create' THEN CASE WHEN w.status IS NOT NULL THEN 'EXISTS' WHEN NOT e.complete THEN 'INCOMPLETE' END WHEN w.status IS NULL THEN 'NO_PROPOSAL'
        WHEN e.action = 'validate' THEN CASE WHEN w.status <> 'DRAFT' THEN 'NOT_DRAFT' WHEN NOT e.complete THEN 'INCOMPLETE' END WHEN e.actor = '' THEN 'BLANK_APPROVER'
        WHEN w.status NOT IN ('VALIDATED', 'APPROVED') THEN 'NOT_VALIDATED' END AS reason
    FROM walk w JOIN e ON e.proposal = w.proposal AND e.nth = w.nth + 1))
SELECT proposal, seq, action, reason IS NULL AS accepted, reason, status, len(signed)::int AS n_approvers FROM walk WHERE nth > 0""",
)
def proposal_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every proposal, event by event."""
    return replay_proposals(proposal_events(spark, sf_dir))


@query(
    "q97_record_digests",
    f"""WITH {OBS}, r AS (SELECT event_id, sha256('{{"at":{{"page":' || page || ',"run":' || run || '}},"kind":"' || metric || '","value":' || value || ',"é":["ü",' || k || ',null,true]}}') AS digest,
  sha256('{{"at": {{"page": ' || page || ', "run": ' || run || '}}, "kind": "' || metric || '", "value": ' || value || ', "\\u00e9": ["\\u00fc", ' || k || ', null, true]}}') AS plain_digest FROM obs)
SELECT * FROM r""",
)
def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the digests of records by both canonical forms; the records come with their keys in any order."""
    ship_package(spark)
    text = F.format_string('{"é": ["ü", %d, null, true], "value": %s, "kind" : "%s", "at": {"run": %d, "page": %d}}', "k", F.col("value").cast("string"), "metric", "run", "page")
    rows = observations(spark, sf_dir).select("event_id", text.alias("record"))
    return rows.select("event_id", record_digest(F.col("record")).alias("digest"), record_digest(F.col("record"), plain=True).alias("plain_digest"))
