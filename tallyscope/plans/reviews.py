"""Queries over `events` and `conversations` read as issues of runs and what reviewers make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.functions.scores import ladder, severity_rank, stable_id
from tallyscope.operators.attention import GAP_PHRASE, GAPS, OWNED, TOLD_BY, evidence_gap, issue_details, issue_order, merge_issues, semantic_family
from tallyscope.operators.reviews import validate_reviews
from tallyscope.plans.observations import OBS, QUEUE, RAW, observations, raw_issues, tasks
from tallyscope.plans.registry import query
from tallyscope.sources.tables import table

SUBJECTS = ("provider", "author", "transition", "contrast", "palette", "layout", "claim", "title", "security", "depth")
REASONS = ("Provider timed out", GAP_PHRASE, "low score", "one page is missing")

_FAMILY = " ".join(
    [f"WHEN name IN ({', '.join(repr(m) for m in ms)}) THEN '{f}'" for f, ms in OWNED.items()]
    + [f"WHEN {' OR '.join(f'contains(name, {w!r})' for w in ws)} THEN '{f}'" for f, ws in TOLD_BY]
)
_GAP = " OR ".join(f"contains(upper(reason), '{g}')" for g in GAPS)


def named_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, raw_id, name, page, priority, severity, reason: the failures and serious findings of a run, one for each metric
    and page; a metric is named by the page's subject and the event's type, some by an owner's own name."""
    obs = observations(spark, sf_dir).where("status = 'ERROR' or (status = 'SCORED' and severity in ('MAJOR', 'CRITICAL'))")
    subject = F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.col("page") % 10 + 1).cast("int"))
    name = F.when(F.col("page") == 20, F.when(F.col("metric") == "click", "Key_Point").otherwise("typography_craft")).otherwise(F.concat_ws("_", subject, "metric"))
    urgent = ladder((F.col("status") == "ERROR", "P1"), ((F.col("severity") == "CRITICAL") & F.col("critical"), "P0"), (F.col("severity") == "CRITICAL", "P1"), otherwise="P2")
    reason = F.element_at(F.array(*map(F.lit, REASONS)), F.col("k") % 4 + 1)
    rows = obs.select("run", name.alias("name"), "page", urgent.alias("priority"), severity_rank(F.col("severity")).alias("rank"), F.when(F.col("k") % 10 != 0, reason).alias("reason"))
    found = rows.groupBy("run", "name", "page").agg(F.min("priority").alias("priority"), F.max("rank").alias("rank"), F.min("reason").alias("reason"))
    severity = F.element_at(F.array(*map(F.lit, ("NONE", "INFO", "MINOR", "MAJOR", "CRITICAL"))), F.col("rank"))
    return found.select("run", stable_id(12, F.col("run"), F.col("name"), F.col("page")).alias("raw_id"), "name", "page", "priority", severity.alias("severity"), "reason")


@query(
    "q102_issue_details",
    f"""WITH {OBS},
s AS (
  SELECT run, CASE WHEN page = 20 THEN CASE metric WHEN 'click' THEN 'Key_Point' ELSE 'typography_craft' END ELSE {list(SUBJECTS)}[page % 10 + 1] || '_' || metric END AS full_name, page, rank,
    CASE WHEN status = 'ERROR' THEN 'P1' WHEN severity = 'CRITICAL' AND critical THEN 'P0' WHEN severity = 'CRITICAL' THEN 'P1' ELSE 'P2' END AS priority,
    CASE WHEN k % 10 <> 0 THEN {list(REASONS)}[k % 4 + 1] END AS reason FROM obs WHERE status = 'ERROR' OR (status = 'SCORED' AND severity IN ('MAJOR', 'CRITICAL'))),
g AS (SELECT run, full_name, lower(full_name) AS name, page, min(priority) AS priority, max(rank) AS rank, min(reason) AS reason FROM s GROUP BY run, full_name, page),
r AS (SELECT *, sha256(run || '|' || full_name || '|' || page)[1:12] AS raw_id, CASE {_FAMILY} ELSE 'CONTENT_EXPRESSION' END AS family, coalesce({_GAP} OR reason = '{GAP_PHRASE}', false) AS gap FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY priority, rank DESC, page, raw_id) AS place FROM r)
SELECT run, family AS issue_id, min(place)::int AS place, count(*)::int AS n_raw, count(*) FILTER (WHERE gap)::int AS n_gaps, string_agg(raw_id, ',' ORDER BY place) AS raw_ids,
  string_agg(full_name || '@' || page || ':' || priority, ',' ORDER BY place) AS findings FROM p GROUP BY run, family""",
)
def details_of_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of each run by family, with the raw issues behind each in their order.

    A run has at most one raw issue for a metric and page, however many events it has."""
    found = named_issues(spark, sf_dir)
    order = issue_order(F.col("priority"), F.col("severity"), F.array("page"), F.col("raw_id"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(*order))
    raw = found.select("run", "raw_id", "name", "page", "priority", semantic_family(F.col("name")).alias("family"), evidence_gap(F.col("reason")).alias("gap"), place.alias("place"))
    issues = raw.groupBy("run", F.col("family").alias("issue_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw_id"))), lambda x: x["raw_id"]).alias("raw_ids"))
    details = issue_details(issues, raw, ["name", "page", "priority", "gap", "place"])
    said = F.transform("raw", lambda x: F.concat(x["name"], F.lit("@"), x["page"].cast("string"), F.lit(":"), x["priority"]))
    return details.select(
        "run", "issue_id", F.array_min(F.transform("raw", lambda x: x["place"])).alias("place"), "n_raw", F.size(F.filter("raw", lambda x: x["gap"])).alias("n_gaps"),
        F.array_join("raw_ids", ",").alias("raw_ids"), F.array_join(said, ",").alias("findings"),
    )


#: The pieces of a review by the length n of its text and its turn, as SQL that Spark and DuckDB both read.
VERDICT = "CASE n % 4 WHEN 0 THEN ' confirm_system_decision' WHEN 1 THEN 'OVERRIDE_DECISION' WHEN 2 THEN 'REQUEST_MORE_EVIDENCE' ELSE 'APPROVE' END"
TARGET = "CASE floor(n / 4.0) % 4 WHEN 0 THEN ' pass' WHEN 1 THEN 'NOPE' WHEN 2 THEN 'fail' END"
NOTE = "CASE WHEN n % 5 = 0 THEN '  ' ELSE substr(said, 1, 20) END"
REVIEWER = "CASE WHEN turn % 7 = 6 THEN ' ' ELSE role END"
RUN = "CASE WHEN n % 19 = 0 THEN -1 - conv_id ELSE conv_id END"
FIRST = "CASE (n + 1) % 3 WHEN 0 THEN ' confirmed' WHEN 1 THEN 'FALSE_POSITIVE' ELSE 'MAYBE' END"
SECOND = "CASE (n + 2) % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'insufficient_evidence ' ELSE 'FALSE_POSITIVE' END"
OTHER = "CASE floor(n / 3.0) % 4 WHEN 0 THEN 'layout' WHEN 1 THEN 'nowhere' WHEN 2 THEN 'content' ELSE 'delivery' END"
TRACK = "CASE n % 6 WHEN 0 THEN 'visual' WHEN 1 THEN 'colour' ELSE 'layout' END"
STATE = "CASE n % 7 WHEN 0 THEN 'KEEP' ELSE 'train' END"


@query(
    "q103_review_validation",
    f"""WITH {OBS}, {RAW}, {QUEUE},
c AS (SELECT conv_id, turn, role, coalesce(text, '') AS said, length(coalesce(text, '')) AS n FROM conversations),
v AS (
  SELECT conv_id || '/' || turn AS review_id, {RUN} AS run, trim({REVIEWER}, ' ') AS reviewer, upper(trim({VERDICT}, ' ')) AS verdict, upper(trim(coalesce({TARGET}, ''), ' ')) AS target, trim({NOTE}, ' ') AS note,
    (n * 7) % 140 AS n_request, {TRACK} AS track, {STATE} AS kept, [{{'id': 'layout', 'nth': 1, 'res': {FIRST}, 'own': ''}}, {{'id': {OTHER}, 'nth': 2, 'res': {SECOND}, 'own': CASE WHEN n % 2 = 0 THEN 'seen' ELSE '' END}}] AS rs FROM c),
x AS (SELECT review_id, run, note, unnest(rs, recursive := true) FROM v),
i AS (
  SELECT review_id, id, count(*) AS n, bool_or(m.run IS NOT NULL) AS known, bool_and(upper(trim(res, ' ')) IN ('CONFIRMED', 'FALSE_POSITIVE', 'INSUFFICIENT_EVIDENCE')) AS supported,
    bool_and(upper(trim(res, ' ')) = 'CONFIRMED' OR own <> '' OR note <> '') AS explained FROM x LEFT JOIN merged m ON m.run = x.run AND m.family = x.id GROUP BY review_id, id),
w AS (
  SELECT review_id, count(*)::int AS n_issues, flatten(list(list_filter([CASE WHEN NOT known THEN 'issue ' || id || ': unknown' END, CASE WHEN n > 1 THEN 'issue ' || id || ': repeated' END,
    CASE WHEN NOT supported THEN 'issue ' || id || ': unsupported resolution' END, CASE WHEN NOT explained THEN 'issue ' || id || ': needs a note' END], lambda e: e IS NOT NULL) ORDER BY id)) AS wrong FROM i GROUP BY review_id),
a AS (
  SELECT v.*, q.decision, q.coverage, w.n_issues, list_filter([CASE WHEN q.run IS NULL THEN 'run: no report' END, CASE WHEN reviewer = '' THEN 'reviewer: blank' END, CASE WHEN v.verdict = 'APPROVE' THEN 'verdict: unsupported' END,
    CASE WHEN v.verdict IN ('OVERRIDE_DECISION', 'REQUEST_MORE_EVIDENCE') AND note = '' THEN 'note: needed' END, CASE WHEN v.verdict = 'OVERRIDE_DECISION' AND target NOT IN ('PASS', 'REVIEW', 'FAIL', 'ERROR') THEN 'target: no decision' END,
    CASE WHEN n_request > 128 THEN 'request_id: too long' END, CASE WHEN track = 'colour' THEN 'tracks: unknown' END, CASE WHEN kept = 'KEEP' THEN 'tracks: unsupported state' END], lambda e: e IS NOT NULL) || w.wrong AS bad
  FROM v JOIN w USING (review_id) LEFT JOIN queue q ON q.run = v.run)
SELECT review_id, run, reviewer, verdict, CASE WHEN verdict = 'OVERRIDE_DECISION' THEN target END AS target, md5(note) AS note_md5, decision AS machine_decision, coverage AS machine_coverage,
  CASE WHEN decision IS NOT NULL THEN sha256(run || decision) END AS report_hash, n_issues AS n_resolutions, len(bad) = 0 AS accepted, array_to_string(bad, '; ') AS breaches FROM a""",
)
def review_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation is a review of the run of its number; what is wrong with it, and what its
    report adds."""
    said = F.coalesce("text", F.lit(""))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", said.alias("said"), F.length(said).alias("n"))
    review_id = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("review_id")
    reviews = turns.select(
        review_id, F.expr(RUN).alias("run"), F.expr(REVIEWER).alias("reviewer"), F.expr(VERDICT).alias("verdict"), F.expr(TARGET).alias("target"), F.expr(NOTE).alias("note"),
        F.repeat(F.lit("x"), (F.col("n") * 7) % 140).alias("request_id"), F.create_map(F.expr(TRACK), F.expr(STATE)).alias("tracks"),
    )
    own = lambda nth, issue, what, note: F.struct(F.lit(nth).alias("nth"), issue.alias("issue_id"), F.expr(what).alias("resolution"), note.alias("note"))
    seen = F.when(F.col("n") % 2 == 0, "seen").otherwise("")
    resolutions = turns.select(review_id, F.inline(F.array(own(1, F.lit("layout"), FIRST, F.lit("")), own(2, F.expr(OTHER), SECOND, seen))))
    issues = merge_issues(raw_issues(spark, sf_dir)).select("run", F.col("family").alias("issue_id"))
    run = F.col("run").cast("string")
    reports = tasks(spark, sf_dir).select("run", "decision", "coverage", F.sha2(F.concat(run, "decision"), 256).alias("report_hash"), F.sha2(run, 256).alias("observation_hash"))
    found = validate_reviews(reviews, resolutions, reports, issues)
    return found.select(
        "review_id", "run", "reviewer", "verdict", "target", F.md5(F.col("note").cast("binary")).alias("note_md5"), "machine_decision", "machine_coverage", "report_hash",
        F.size("resolutions").alias("n_resolutions"), "accepted", F.array_join("breaches", "; ").alias("breaches"),
    )
