"""Queries over `conversations` read as append-only logs: a conversation is a chain, a turn an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.operators.logs import idempotency, illegal_transitions, latest, verify_chain
from tallyscope.plans.registry import query
from tallyscope.sources.tables import table
from tallyscope.streaming.chains import build_chains


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query(
    "q38_hash_chain_verify",
    """WITH RECURSIVE e AS (SELECT conv_id::varchar AS run, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, turn, coalesce(text, '') AS text FROM conversations),
chain AS (
  SELECT run, conv_id, place, turn, text, '' AS previous_hash, sha256('|' || run || '|' || turn::varchar || '|' || text) AS event_hash FROM e WHERE place = 1
  UNION ALL
  SELECT e.run, e.conv_id, e.place, e.turn, e.text, c.event_hash, sha256(c.event_hash || '|' || e.run || '|' || e.turn::varchar || '|' || e.text) FROM chain c JOIN e ON e.run = c.run AND e.place = c.place + 1),
stored AS (SELECT *, CASE WHEN (conv_id + turn) % 7 = 5 THEN text || '!' ELSE text END AS found FROM chain),
b AS (SELECT *, sha256(previous_hash || '|' || run || '|' || turn::varchar || '|' || found) <> event_hash
  OR previous_hash <> coalesce(lag(event_hash) OVER (PARTITION BY run ORDER BY place), '') AS broken FROM stored)
SELECT conv_id, count(*) AS n_events, count(*) FILTER (WHERE broken) AS n_broken, min(turn) FILTER (WHERE broken) AS first_broken FROM b GROUP BY conv_id""",
)
def hash_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation chained turn by turn; then one turn in seven is changed, and the chain verified."""
    turns = log(spark, sf_dir).select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("payload"))
    conv_id = F.col("run_id").cast("long")
    changed = F.when((conv_id + F.col("seq")) % 7 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    stored = build_chains(turns).withColumn("payload", changed)
    found = verify_chain(stored, "run_id", "seq", ["run_id", "seq", "payload"])
    return found.select(conv_id.alias("conv_id"), "n_events", "n_broken", "first_broken")


@query(
    "q39_latest_state",
    """SELECT conv_id, role AS last_role, length(text) AS n_chars, CASE WHEN role = 'user' THEN 'OPEN' ELSE 'RESOLVED' END AS state
FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each chain decides its state."""
    last = latest(log(spark, sf_dir).withColumn("n_chars", F.length("text")), ["conv_id"], ["turn"], ["role", "n_chars"])
    return last.select("conv_id", F.col("role").alias("last_role"), "n_chars", F.when(F.col("role") == "user", "OPEN").otherwise("RESOLVED").alias("state"))


@query(
    "q40_idempotency_conflicts",
    """WITH k AS (SELECT conv_id // 3 AS key, role AS fingerprint, conv_id * 1000 + turn AS seq FROM conversations), f AS (SELECT key, arg_min(fingerprint, seq) AS first, count(*) AS n FROM k GROUP BY key)
SELECT key, n AS n_appends, count(*) FILTER (WHERE fingerprint = first) - 1 AS n_reused, n - count(*) FILTER (WHERE fingerprint = first) AS n_conflicts FROM k JOIN f USING (key) GROUP BY key, n""",
)
def idempotency_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of a key that reuse the original, and those that contradict it."""
    k = log(spark, sf_dir).select(F.floor(F.col("conv_id") / 3).cast("long").alias("key"), F.col("role").alias("fingerprint"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return idempotency(k, "key", "fingerprint", "seq")


@query(
    "q41_fsm_legality",
    """WITH s AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, before, role FROM s WHERE CASE WHEN before IS NULL THEN role NOT IN ('user') ELSE (before || '>' || role) NOT IN ('user>assistant', 'assistant>user') END""",
)
def fsm_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions that the dialogue's state machine does not allow."""
    allowed = (("user", "assistant"), ("assistant", "user"))
    return illegal_transitions(log(spark, sf_dir), "conv_id", "turn", "role", allowed, ("user",)).select("conv_id", "turn", "before", "role")
