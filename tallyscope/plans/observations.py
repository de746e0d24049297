"""Queries over `events` read as observations: a user is a run, an event type a metric, an event one measured unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.functions.scores import clamp, effective_score, ladder, lit, lookup, round6, severity_band, severity_rank
from tallyscope.operators import reduce as R
from tallyscope.operators.attention import merge_issues, review_state, task_priority, top_issues
from tallyscope.operators.gates import confirm, gate_candidates, gate_multiplier
from tallyscope.operators.scoring import cap_model_score, construct_mean, fuse, fuse_authorship
from tallyscope.plans.registry import query
from tallyscope.sources.tables import table

STATUS = ("NA", "ERROR", "PASS", "FAIL")
WEIGHTS = {"click": 0.30, "view": 0.25, "purchase": 0.20, "signup": 0.15, "error": 0.10}
CONSTRUCT = {"click": "content", "view": "content", "purchase": "visual", "signup": "visual", "error": "visual"}
CONSTRUCT_WEIGHT = {"content": 0.4, "visual": 0.6}
CODES = {"click": "OVERLAP", "view": "CONTRAST", "purchase": "CROP", "signup": "TITLE", "error": "RENDER"}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, run, metric, page, k, status, local_score, eff, importance, confidence, severity, key_unit, critical, ts."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    place = F.col("event_id") % 11
    status = F.coalesce(F.get(F.array(*map(F.lit, STATUS)), place.cast("int")), F.lit("SCORED"))
    score = F.when(F.col("status") == "SCORED", clamp(F.col("value") / lit(97)))
    return (
        e.select("event_id", F.col("user_id").alias("run"), F.col("event_type").alias("metric"), (F.col("event_id") % 20 + 1).alias("page"), "k", status.alias("status"), "value", "ts")
        .withColumn("local_score", score)
        .withColumn("eff", effective_score(F.col("status"), F.col("local_score")))
        .withColumn("importance", F.col("k") / lit(50))
        .withColumn("confidence", lit(0.5) + (F.col("k") % 50) / lit(100))
        .withColumn("key_unit", F.col("k") % 3 == 0)
        .withColumn("critical", F.col("k") % 5 == 0)
        .withColumn("severity", F.coalesce(severity_band(F.col("eff"), 0.02), F.lit("INFO")))
    )


OBS = """
raw_obs AS (
  SELECT event_id, user_id AS run, event_type AS metric, event_id % 20 + 1 AS page, regexp_extract(props, '[0-9]+')::int AS k, value, ts,
    CASE event_id % 11 WHEN 0 THEN 'NA' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'PASS' WHEN 3 THEN 'FAIL' ELSE 'SCORED' END AS status FROM events),
scored_obs AS (
  SELECT *, CASE status WHEN 'SCORED' THEN greatest(0::double, least(1::double, value / 97::double)) WHEN 'PASS' THEN 1::double WHEN 'FAIL' THEN 0::double END AS eff,
    k / 50::double AS importance, 0.5::double + (k % 50) / 100::double AS confidence, k % 3 = 0 AS key_unit, k % 5 = 0 AS critical FROM raw_obs),
obs AS (
  SELECT *, CASE WHEN eff < 0.02 THEN 'CRITICAL' WHEN eff < 0.35 THEN 'MAJOR' WHEN eff < 0.70 THEN 'MINOR' ELSE 'INFO' END AS severity,
    CASE WHEN eff < 0.02 THEN 5 WHEN eff < 0.35 THEN 4 WHEN eff < 0.70 THEN 3 ELSE 2 END AS rank FROM scored_obs)"""

PAGE_QUALITY = """CASE WHEN min(eff) FILTER (WHERE key_unit) IS NULL THEN (0.60::double * avg(eff) + 0.25::double * quantile_disc(eff, 0.2)) / 0.85::double
  ELSE 0.60::double * avg(eff) + 0.25::double * quantile_disc(eff, 0.2) + 0.15::double * min(eff) FILTER (WHERE key_unit) END"""
COVERAGE = "coalesce(sum(eff * importance) / nullif(sum(importance) FILTER (WHERE eff IS NOT NULL), 0), avg(eff))"
OBSERVABILITY = "coalesce(coalesce(sum(importance) FILTER (WHERE eff IS NOT NULL), 0) / nullif(sum(importance), 0), count(eff) / count(*))"
CONFIDENCE = """coalesce(sum(confidence * importance) FILTER (WHERE eff IS NOT NULL) / nullif(sum(importance) FILTER (WHERE eff IS NOT NULL), 0),
  avg(confidence) FILTER (WHERE eff IS NOT NULL), 1::double)"""
HELD = "coalesce(bool_or(severity = 'CRITICAL' AND (critical OR key_unit) AND eff IS NOT NULL), false)"


def reduced_sql(score: str, required: bool) -> str:
    missing = "n_scored = 0 OR observability < 0.6" if required else "n_scored = 0"
    return f"""
reduced AS (
  SELECT run, metric, {score} AS raw, {OBSERVABILITY} AS observability, {CONFIDENCE} AS confidence, max(rank) AS rank, {HELD} AS held,
    count(eff) AS n_scored, count(*) - count(eff) AS n_missing FROM obs GROUP BY run, metric),
metrics AS (
  SELECT run, metric, CASE WHEN {missing} THEN 'NA' ELSE 'SCORED' END AS status,
    CASE WHEN NOT ({missing}) THEN CASE WHEN held THEN least(raw, 0.34::double) ELSE raw END END AS score,
    CASE WHEN NOT ({missing}) THEN raw END AS uncapped_score, observability, confidence,
    ['NONE', 'INFO', 'MINOR', 'MAJOR', 'CRITICAL'][rank] AS severity, n_scored, n_missing FROM reduced)"""


ROUNDED = """SELECT run, metric, status, round(score, 6) AS score, round(uncapped_score, 6) AS uncapped_score, round(observability, 6) AS observability,
  round(confidence, 6) AS confidence, severity, n_scored, n_missing FROM metrics"""


def metrics(spark: SparkSession, sf_dir: str, score, required: bool = True) -> DataFrame:
    return R.reduce_metric(observations(spark, sf_dir), ["run", "metric"], score, required, order=["event_id"])


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: round6(F.col(c)) for c in ("score", "uncapped_score", "observability", "confidence")})


@query("q16_page_quality", f"WITH {OBS}, {reduced_sql(PAGE_QUALITY, True)} {ROUNDED}")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page quality of each metric of a run, with its cap and the rule for what is missing."""
    return rounded(metrics(spark, sf_dir, R.page_quality()))


@query("q17_pair_quality", f"WITH {OBS}, {reduced_sql('0.70::double * avg(eff) + 0.30::double * quantile_disc(eff, 0.2)', False)} {ROUNDED}")
def pair_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair quality; optional metrics stay however little of them was observed."""
    return rounded(metrics(spark, sf_dir, R.pair_quality(), required=False))


@query("q18_importance_coverage", f"WITH {OBS}, {reduced_sql(COVERAGE, True)} {ROUNDED}")
def importance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance-weighted coverage."""
    return rounded(metrics(spark, sf_dir, R.importance_coverage()))


@query(
    "q19_observability_summary",
    f"""WITH {OBS}
SELECT metric, status, count(*) AS n, count(DISTINCT run) AS n_runs FROM obs GROUP BY GROUPING SETS ((metric), (status), ())""",
)
def observability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by metric, by status and in all."""
    obs = observations(spark, sf_dir).select("run", "metric", "status")
    sets = obs.groupingSets([["metric"], ["status"], []], "metric", "status")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("n_runs")).select("metric", "status", "n", "n_runs")


CANDIDATES = """
cands AS (
  SELECT run, metric, count(*) AS n, count(*) FILTER (WHERE severity = 'MAJOR') / count(*) AS major_share,
    count(*) FILTER (WHERE severity = 'MAJOR' AND key_unit) AS n_key_major,
    count(*) FILTER (WHERE severity = 'CRITICAL' AND (critical OR key_unit)) AS n_critical FROM obs WHERE status = 'SCORED' GROUP BY run, metric),
candidates AS (SELECT *, CASE WHEN n_critical > 0 THEN 'CRITICAL' WHEN major_share >= 0.2 OR n_key_major >= 2 THEN 'MAJOR' END AS candidate FROM cands)"""


@query(
    "q20_gate_prevalence",
    f"WITH {OBS}, {CANDIDATES} SELECT run, metric, n, round(major_share, 6) AS major_share, n_key_major, n_critical, candidate FROM candidates",
)
def gate_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How widespread the major defects of a metric are."""
    return gate_candidates(observations(spark, sf_dir)).withColumn("major_share", round6(F.col("major_share")))


VERDICTS = f"""{CANDIDATES},
at_page AS (
  SELECT DISTINCT o.run, o.metric, c.candidate, o.page, bool_or(o.key_unit) OVER (PARTITION BY o.run, o.metric, o.page) AS key_unit
  FROM obs o JOIN candidates c USING (run, metric)
  WHERE o.status = 'SCORED' AND ((c.candidate = 'CRITICAL' AND o.severity = 'CRITICAL' AND (o.critical OR o.key_unit)) OR (c.candidate = 'MAJOR' AND o.severity = 'MAJOR'))),
found AS (
  SELECT run, metric, page, bool_or(k % 2 = 0) AS codes_meet, max(rank) AS frank FROM obs WHERE status = 'FAIL' OR eff < 0.3 GROUP BY ALL HAVING max(event_id) % 4 <> 0),
per AS (
  SELECT a.run, a.metric, a.candidate, count(*) AS n_pages, count(frank) AS n_sampled, count(*) FILTER (WHERE frank >= 4 AND codes_meet) AS n_matching,
    count(*) FILTER (WHERE frank >= 4 AND codes_meet AND key_unit) AS n_key FROM at_page a LEFT JOIN found f USING (run, metric, page) GROUP BY ALL),
verdicts AS (
  SELECT *, CASE WHEN n_sampled = 0 THEN 'UNRESOLVED' WHEN candidate = 'CRITICAL' AND n_matching > 0 THEN 'CONFIRMED'
    WHEN candidate = 'MAJOR' AND n_sampled = n_pages AND n_matching > 0 AND (n_matching / n_pages >= 0.2 OR n_key >= 2) THEN 'CONFIRMED'
    WHEN n_sampled = n_pages AND n_matching = 0 THEN 'REJECTED' ELSE 'UNRESOLVED' END AS verdict FROM per)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the candidate pages, the model's findings being the poor observations of the same page."""
    obs = observations(spark, sf_dir)
    marked = obs.where("status = 'SCORED'").join(gate_candidates(obs).select("run", "metric", "candidate"), ["run", "metric"])
    critical = (F.col("severity") == "CRITICAL") & (F.col("critical") | F.col("key_unit"))
    own = ((F.col("candidate") == "CRITICAL") & critical) | ((F.col("candidate") == "MAJOR") & (F.col("severity") == "MAJOR"))
    pages = marked.where(own).groupBy("run", "metric", "candidate", "page").agg(F.bool_or("key_unit").alias("key_unit"))
    pages = pages.withColumn("codes", F.array(lookup(F.col("metric"), CODES)))
    code = F.when(F.col("k") % 2 == 0, lookup(F.col("metric"), CODES)).otherwise(F.lit("OTHER"))
    found = obs.where("status = 'FAIL' or eff < 0.3").groupBy("run", "metric", "page").agg(
        F.collect_set(code).alias("codes"), R.max_severity().alias("severity"), F.max("event_id").alias("last")
    )
    return confirm(pages, found.where("last % 4 <> 0"))


@query(
    "q21_gate_confirmation",
    f"WITH {OBS}, {VERDICTS} SELECT run, metric, candidate, n_pages, n_sampled, n_matching, verdict FROM verdicts",
)
def gate_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed defects against what the model saw on the same pages."""
    return verdicts(spark, sf_dir)


@query(
    "q52_integrity_gate",
    f"""WITH {OBS}, {VERDICTS}
SELECT run, CASE WHEN bool_or(verdict = 'CONFIRMED' AND candidate = 'CRITICAL') THEN 0::double WHEN bool_or(verdict = 'CONFIRMED') THEN 0.5::double
  WHEN bool_or(verdict = 'UNRESOLVED') THEN NULL ELSE 1::double END AS multiplier FROM verdicts GROUP BY run""",
)
def integrity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiplier of the integrity gate."""
    return gate_multiplier(verdicts(spark, sf_dir))


FUSED = f"""
parts AS (
  SELECT run, {COVERAGE.replace("eff", "reff").replace("importance", "rimp")} AS rule, {COVERAGE.replace("eff", "meff").replace("importance", "mimp")} AS model,
    count(*) FILTER (WHERE meff > 0.5) AS n_positive, max(CASE WHEN meff IS NOT NULL AND critical THEN rank END) AS mrank
  FROM (SELECT run, critical, rank, CASE WHEN metric IN ('click', 'view') THEN eff END AS reff, CASE WHEN metric IN ('click', 'view') THEN importance END AS rimp,
      CASE WHEN metric IN ('purchase', 'signup') THEN eff END AS meff, CASE WHEN metric IN ('purchase', 'signup') THEN importance END AS mimp FROM obs) GROUP BY run)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule score and a model score for each run."""
    rule, model = F.col("metric").isin("click", "view"), F.col("metric").isin("purchase", "signup")
    own = observations(spark, sf_dir).select(
        "run", "critical", "severity", F.when(rule, F.col("eff")).alias("reff"), F.when(rule, F.col("importance")).alias("rimp"),
        F.when(model, F.col("eff")).alias("meff"), F.when(model, F.col("importance")).alias("mimp"),
    )
    return own.groupBy("run").agg(
        R.importance_coverage("reff", "rimp").alias("rule"), R.importance_coverage("meff", "mimp").alias("model"), F.count_if(F.col("meff") > 0.5).alias("n_positive"),
        F.max(F.when(F.col("meff").isNotNull() & F.col("critical"), severity_rank(F.col("severity")))).alias("mrank"),
    )


@query(
    "q22_fusion_cap",
    f"""WITH {OBS}, {FUSED}
SELECT run, round(rule, 6) AS rule, round(model, 6) AS model,
  round(CASE WHEN model IS NOT NULL THEN least(model, CASE WHEN rule IS NULL THEN 1::double ELSE 0.34::double + 0.66::double * rule END) END, 6) AS fused,
  round(CASE WHEN model IS NOT NULL THEN CASE WHEN rule IS NULL THEN model ELSE 0.30::double * rule + 0.70::double * model END END, 6) AS authorship FROM parts""",
)
def fusion_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's score under the cap of the rules, and the mixed authorship score."""
    m, r = F.col("model"), F.col("rule")
    return parts(spark, sf_dir).select(
        "run", round6(r).alias("rule"), round6(m).alias("model"), round6(fuse(m, r)).alias("fused"), round6(fuse_authorship(m, r)).alias("authorship")
    )


@query(
    "q53_model_score_caps",
    f"""WITH {OBS}, {FUSED},
s AS (SELECT run, least(1::double, model * 4) AS x, n_positive, coalesce(mrank, 1) AS r FROM parts),
a AS (SELECT *, CASE WHEN x > 0.79 AND n_positive < 2 THEN 0.79::double ELSE x END AS y FROM s),
b AS (SELECT *, CASE WHEN y > 0.94 AND (n_positive < 3 OR r <> 1) THEN 0.94::double ELSE y END AS z FROM a)
SELECT run, round(x, 6) AS score, round(CASE r WHEN 5 THEN least(z, 0.34::double) WHEN 4 THEN least(z, 0.64::double) ELSE z END, 6) AS capped FROM b""",
)
def model_score_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caps on a model's score."""
    x = F.least(lit(1), F.col("model") * 4)
    severity = F.element_at(F.array(*map(F.lit, ("NONE", "INFO", "MINOR", "MAJOR", "CRITICAL"))), F.coalesce("mrank", F.lit(1)))
    return parts(spark, sf_dir).select("run", round6(x).alias("score"), round6(cap_model_score(x, F.col("n_positive"), severity)).alias("capped"))


@query(
    "q24_construct_mean",
    f"""WITH {OBS}, {reduced_sql(COVERAGE, True)},
w AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {w}::double, '{CONSTRUCT[m]}', {CONSTRUCT_WEIGHT[CONSTRUCT[m]]}::double)" for m, w in WEIGHTS.items())}) t(metric, weight, construct, construct_weight)),
runs AS (SELECT DISTINCT run FROM obs),
joined AS (SELECT r.run, w.*, m.score FROM runs r CROSS JOIN w LEFT JOIN metrics m ON m.run = r.run AND m.metric = w.metric),
inner_ AS (SELECT run, construct, construct_weight, sum(weight * score) / nullif(sum(weight) FILTER (WHERE score IS NOT NULL), 0) AS value,
  list(metric) FILTER (WHERE score IS NULL) AS open FROM joined GROUP BY ALL)
SELECT run, round(sum(construct_weight * value) / nullif(sum(construct_weight) FILTER (WHERE value IS NOT NULL), 0), 6) AS score,
  array_to_string(list_sort(list_concat(coalesce(flatten(list(coalesce(open, []))), []), coalesce(list('construct:' || construct) FILTER (WHERE value IS NULL), []))), ',') AS unresolved
FROM inner_ GROUP BY run""",
)
def construct_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted mean of each construct, and of the constructs, with what is unresolved."""
    found = metrics(spark, sf_dir, R.importance_coverage())
    runs = found.select("run").distinct()
    weights = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), lit(w).alias("weight"), F.lit(CONSTRUCT[m]).alias("construct"), lit(CONSTRUCT_WEIGHT[CONSTRUCT[m]]).alias("construct_weight")) for m, w in WEIGHTS.items()]))
    rows = runs.select("run", weights.alias("w")).select("run", "w.*").join(found.select("run", "metric", "score"), ["run", "metric"], "left")
    rows = rows.withColumns({"required": F.lit(True), "failed": F.lit(False)})
    return construct_mean(rows, ["run"]).select("run", round6(F.col("score")).alias("score"), F.array_join("unresolved", ",").alias("unresolved"))


RAW = f"""
issues AS (
  SELECT run, CASE metric WHEN 'click' THEN 'layout' WHEN 'purchase' THEN 'layout' WHEN 'view' THEN 'typography' WHEN 'signup' THEN 'content' ELSE 'delivery' END AS family,
    metric, page, CASE metric {" ".join(f"WHEN '{m}' THEN '{c}'" for m, c in CODES.items())} END AS code,
    CASE WHEN status = 'ERROR' THEN 'P1' WHEN severity = 'CRITICAL' AND critical THEN 'P0' WHEN severity = 'CRITICAL' THEN 'P1' ELSE 'P2' END AS priority,
    severity, rank, CASE WHEN status = 'ERROR' THEN 'GAP' WHEN k % 17 = 0 THEN 'CONFLICT' WHEN k % 2 = 0 THEN 'MODEL' ELSE 'RULE' END AS source
  FROM obs WHERE status = 'ERROR' OR (status = 'SCORED' AND severity IN ('MAJOR', 'CRITICAL')))"""
FAMILY = {"click": "layout", "purchase": "layout", "view": "typography", "signup": "content", "error": "delivery"}


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed measurements and serious findings, each as a candidate issue."""
    obs = observations(spark, sf_dir)
    shared = [F.col("run"), lookup(F.col("metric"), FAMILY).alias("family"), F.col("metric"), F.col("page"), lookup(F.col("metric"), CODES).alias("code")]
    errors = obs.where("status = 'ERROR'").select(*shared, F.lit("P1").alias("priority"), "severity", F.lit("GAP").alias("source"))
    urgent = ladder(((F.col("severity") == "CRITICAL") & F.col("critical"), "P0"), (F.col("severity") == "CRITICAL", "P1"), otherwise="P2")
    origin = ladder((F.col("k") % 17 == 0, "CONFLICT"), (F.col("k") % 2 == 0, "MODEL"), otherwise="RULE")
    serious = obs.where("status = 'SCORED' and severity in ('MAJOR', 'CRITICAL')").select(*shared, urgent.alias("priority"), "severity", origin.alias("source"))
    return errors.unionByName(serious)


@query("q32_attention_candidates", f"WITH {OBS}, {RAW} SELECT run, priority, source, count(*) AS n, count(DISTINCT page) AS n_pages FROM issues GROUP BY ALL")
def attention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate issues of a run by priority and source."""
    return raw_issues(spark, sf_dir).groupBy("run", "priority", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("n_pages"))


MERGED = """
merged AS (
  SELECT run, family, min(priority) AS priority, max(rank) AS rank, list_sort(list_distinct(list(page))) AS pages, list_sort(list_distinct(list(metric))) AS metrics,
    list_sort(list_distinct(list(code))) AS codes, count(*) AS n_findings,
    CASE WHEN bool_or(source = 'CONFLICT') THEN 'CONFLICT' WHEN bool_or(source = 'RULE') AND bool_or(source = 'MODEL') THEN 'AGREED'
      WHEN bool_or(source = 'GAP') THEN 'INSUFFICIENT' ELSE 'SINGLE_SOURCE' END AS consensus FROM issues GROUP BY run, family)"""


@query(
    "q33_attention_merge",
    f"""WITH {OBS}, {RAW}, {MERGED}
SELECT run, family, priority, rank, array_to_string(pages[1:6], ',') AS focus_pages, array_to_string(metrics, ',') AS metrics, array_to_string(codes, ',') AS codes, n_findings, consensus FROM merged""",
)
def attention_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One issue for each family of a run."""
    m = merge_issues(raw_issues(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return m.select("run", "family", "priority", "rank", text("focus_pages"), text("metrics"), text("codes"), "n_findings", "consensus")


@query(
    "q34_attention_top",
    f"""WITH {OBS}, {RAW}, {MERGED}
SELECT run, family, priority, rank FROM (
  SELECT *, priority IN ('P0', 'P1') AS urgent, count(*) FILTER (WHERE priority IN ('P0', 'P1')) OVER (PARTITION BY run) AS n_urgent FROM merged)
QUALIFY urgent OR row_number() OVER (PARTITION BY run, urgent ORDER BY priority, rank DESC, family) <= greatest(0, 2 - n_urgent)""",
)
def attention_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All urgent issues and others up to a budget of two."""
    return top_issues(merge_issues(raw_issues(spark, sf_dir)), 2).select("run", "family", "priority", "rank")


QUEUE = f"""{reduced_sql(COVERAGE, True)}, {MERGED},
runs AS (SELECT run, avg(score) * 100 AS score, count(*) FILTER (WHERE score IS NULL) AS n_open FROM metrics GROUP BY run),
worst AS (SELECT run, min(priority) AS worst, count(*) AS n_issues FROM merged GROUP BY run),
reviews AS (SELECT conv_id AS run, arg_max(CASE WHEN length(text) % 3 = 0 THEN 'REQUEST_MORE_EVIDENCE' ELSE 'ACCEPT' END, turn) AS verdict FROM conversations GROUP BY conv_id),
tasks AS (
  SELECT r.run, CASE WHEN n_open > 0 THEN 'DEGRADED' ELSE 'FULL' END AS coverage, CASE WHEN n_open > 0 THEN 'REVIEW' WHEN score IS NULL THEN 'ERROR' WHEN score >= 40 THEN 'PASS' WHEN score >= 20 THEN 'REVIEW' ELSE 'FAIL' END AS decision,
    worst, coalesce(n_issues, 0) AS n_issues, verdict FROM runs r LEFT JOIN worst USING (run) LEFT JOIN reviews USING (run)),
queue AS (
  SELECT *, CASE WHEN verdict IS NULL THEN 'OPEN' WHEN verdict = 'REQUEST_MORE_EVIDENCE' THEN 'NEEDS_EVIDENCE' ELSE 'RESOLVED' END AS state,
    CASE WHEN decision IN ('FAIL', 'ERROR') OR worst = 'P0' THEN 'P0' WHEN coverage <> 'FULL' OR decision = 'REVIEW' OR worst = 'P1' THEN 'P1' WHEN worst IS NOT NULL THEN 'P2' ELSE 'P3' END AS priority FROM tasks)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review task for each run: its decision, coverage, worst issue and latest review."""
    found = metrics(spark, sf_dir, R.importance_coverage()).groupBy("run").agg((F.avg("score") * 100).alias("score"), F.count_if(F.col("score").isNull()).alias("n_open"))
    issues = merge_issues(raw_issues(spark, sf_dir)).groupBy("run").agg(F.min("priority").alias("worst"), F.count(F.lit(1)).alias("n_issues"))
    said = F.when(F.length("text") % 3 == 0, "REQUEST_MORE_EVIDENCE").otherwise("ACCEPT")
    reviews = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run")).agg(F.max_by(said, "turn").alias("verdict"))
    score, open_ = F.col("score"), F.col("n_open") > 0
    decision = ladder((open_, "REVIEW"), (score.isNull(), "ERROR"), (score >= 40, "PASS"), (score >= 20, "REVIEW"), otherwise="FAIL")
    t = found.join(issues, "run", "left").join(reviews, "run", "left")
    t = t.withColumns({"coverage": F.when(open_, "DEGRADED").otherwise("FULL"), "decision": decision, "n_issues": F.coalesce("n_issues", F.lit(0)), "state": review_state(F.col("verdict"))})
    return t.withColumn("priority", task_priority(F.col("decision"), F.col("coverage"), F.col("worst"), F.lit(0)))


@query(
    "q35_review_queue",
    f"WITH {OBS}, {RAW}, {QUEUE} SELECT run, state, priority, coverage, decision, n_issues FROM queue WHERE state <> 'RESOLVED' AND priority <> 'P3' ORDER BY state, priority, run LIMIT 50",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the open review tasks."""
    t = tasks(spark, sf_dir).where("state <> 'RESOLVED' and priority <> 'P3'")
    return t.orderBy("state", "priority", "run").limit(50).select("run", "state", "priority", "coverage", "decision", "n_issues")


@query(
    "q36_required_unresolved",
    f"""WITH {OBS}, {RAW}, {MERGED}, resolved AS (SELECT DISTINCT conv_id AS run, CASE turn WHEN 0 THEN 'layout' WHEN 1 THEN 'typography' WHEN 2 THEN 'content' ELSE 'delivery' END AS family FROM conversations)
SELECT run, count(*) AS n_open, min(family) AS first_family FROM merged m ANTI JOIN resolved r ON m.run = r.run AND m.family = r.family WHERE priority IN ('P0', 'P1') GROUP BY run""",
)
def required_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent issues without a resolution."""
    turn = F.col("turn")
    family = F.when(turn == 0, "layout").when(turn == 1, "typography").when(turn == 2, "content").otherwise("delivery")
    resolved = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), family.alias("family"))
    m = merge_issues(raw_issues(spark, sf_dir)).where("priority in ('P0', 'P1')").join(resolved, ["run", "family"], "left_anti")
    return m.groupBy("run").agg(F.count(F.lit(1)).alias("n_open"), F.min("family").alias("first_family"))


@query(
    "q37_unassigned_raw",
    f"""WITH {OBS}, {RAW}, claimed AS (SELECT DISTINCT run, code FROM issues WHERE priority IN ('P0', 'P1'))
SELECT family, count(*) AS n, count(DISTINCT i.run) AS n_runs FROM issues i ANTI JOIN claimed c ON i.run = c.run AND i.code = c.code GROUP BY family""",
)
def unassigned_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no urgent issue of their code claims, by family."""
    raw = raw_issues(spark, sf_dir)
    claimed = raw.where("priority in ('P0', 'P1')").select("run", "code")
    return raw.join(claimed, ["run", "code"], "left_anti").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("n_runs"))


@query(
    "q42_batch_rollup",
    f"""WITH {OBS}, jobs AS (SELECT run, page AS batch, CASE arg_max(status, event_id) WHEN 'NA' THEN 'PENDING' WHEN 'ERROR' THEN 'FAILED' WHEN 'PASS' THEN 'RUNNING' ELSE 'COMPLETED' END AS state, min(ts) AS started FROM obs GROUP BY run, page)
SELECT batch, count(*) AS n_jobs, count(*) FILTER (WHERE state = 'PENDING') AS n_pending, count(*) FILTER (WHERE state = 'RUNNING') AS n_running, count(*) FILTER (WHERE state = 'COMPLETED') AS n_completed, count(*) FILTER (WHERE state = 'FAILED') AS n_failed,
  CASE WHEN bool_or(state = 'RUNNING') THEN 'RUNNING' WHEN bool_or(state = 'PENDING') THEN 'PENDING' WHEN bool_and(state = 'FAILED') THEN 'FAILED' WHEN bool_or(state = 'FAILED') THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
  epoch_us(min(started)) AS started_us FROM jobs GROUP BY batch""",
)
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by the latest state of their jobs."""
    last = F.max_by("status", "event_id")
    state = F.when(last == "NA", "PENDING").when(last == "ERROR", "FAILED").when(last == "PASS", "RUNNING").otherwise("COMPLETED")
    jobs = observations(spark, sf_dir).groupBy("run", F.col("page").alias("batch")).agg(state.alias("state"), F.min(F.col("ts").cast("timestamp")).alias("started"))
    is_ = lambda s: F.col("state") == s
    n = lambda s: F.count_if(is_(s)).alias(f"n_{s.lower()}")
    status = ladder((F.bool_or(is_("RUNNING")), "RUNNING"), (F.bool_or(is_("PENDING")), "PENDING"), (F.bool_and(is_("FAILED")), "FAILED"), (F.bool_or(is_("FAILED")), "PARTIAL"), otherwise="COMPLETED")
    return jobs.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_jobs"), n("PENDING"), n("RUNNING"), n("COMPLETED"), n("FAILED"), status.alias("status"), F.unix_micros(F.min("started")).alias("started_us")
    )


@query(
    "q43_usage_completeness",
    f"""WITH {OBS}, u AS (SELECT run, metric, k AS tokens, CASE WHEN k % 13 <> 0 THEN k * 2 END AS cached, status <> 'ERROR' AS cost_known FROM obs)
SELECT run, metric, count(*) AS n_attempts, sum(tokens)::bigint AS tokens, CASE WHEN count(cached) = count(*) THEN sum(cached)::bigint END AS cached, bool_and(cost_known) AS cost_known FROM u GROUP BY run, metric""",
)
def usage_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of a run's attempts; an optional counter only where every attempt reports it."""
    u = observations(spark, sf_dir).withColumn("cached", F.when(F.col("k") % 13 != 0, F.col("k") * 2))
    full = F.count("cached") == F.count(F.lit(1))
    return u.groupBy("run", "metric").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.sum("k").alias("tokens"), F.when(full, F.sum("cached")).alias("cached"), F.bool_and(F.col("status") != "ERROR").alias("cost_known")
    )


@query(
    "q49_first_occurrence",
    f"""WITH {OBS}, f AS (SELECT run, metric, page, event_id FROM obs WHERE eff < 0.35 QUALIFY row_number() OVER (PARTITION BY run, metric, page ORDER BY event_id) = 1)
SELECT run, count(*) AS n_evidence, array_to_string(list(event_id ORDER BY event_id)[1:20], ',') AS first_ids FROM f GROUP BY run""",
)
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first evidence of each metric and page, in order, the first twenty by name."""
    first = observations(spark, sf_dir).where("eff < 0.35").groupBy("run", "metric", "page").agg(F.min("event_id").alias("event_id"))
    ids = F.transform(F.slice(F.array_sort(F.collect_list("event_id")), 1, 20), lambda x: x.cast("string"))
    return first.groupBy("run").agg(F.count(F.lit(1)).alias("n_evidence"), F.array_join(ids, ",").alias("first_ids"))


@query(
    "q54_rule_model_disagreement",
    f"""WITH {OBS}, {FUSED}
SELECT run, round(model - rule, 6) AS gap, (model > 0.75 AND rule < 0.50) OR (model < 0.50 AND rule > 0.75) AS disagree FROM parts WHERE model IS NOT NULL AND rule IS NOT NULL""",
)
def rule_model_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in which rules and model contradict each other."""
    m, r = F.col("model"), F.col("rule")
    p = parts(spark, sf_dir).where("model is not null and rule is not null")
    return p.select("run", round6(m - r).alias("gap"), (((m > 0.75) & (r < 0.50)) | ((m < 0.50) & (r > 0.75))).alias("disagree"))


@query(
    "q55_tier_routing",
    f"""WITH {OBS}, tiers AS (SELECT run, metric, page, event_id, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS tier, eff, confidence FROM obs)
SELECT run, metric, page, tier, round(eff, 6) AS score FROM tiers WHERE eff IS NOT NULL AND (tier = 1 OR confidence >= 0.60) AND confidence >= 0.55
QUALIFY row_number() OVER (PARTITION BY run, metric, page ORDER BY tier, confidence DESC, event_id) = 1""",
)
def tier_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of the first tier that is fit to be used."""
    o = observations(spark, sf_dir).withColumn("tier", F.when(F.col("k") % 4 == 0, 2).otherwise(1))
    fit = o.where("eff is not null and (tier = 1 or confidence >= 0.60) and confidence >= 0.55")
    order = Window.partitionBy("run", "metric", "page").orderBy("tier", F.desc("confidence"), "event_id")
    return fit.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("run", "metric", "page", "tier", round6(F.col("eff")).alias("score"))
