"""Checks of objects, results and budgets: predicates, set relations, orders and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.functions import text as X
from tallyscope.functions.scores import ladder, lit, round6
from tallyscope.operators.sampling import even_places, running_before
from tallyscope.plans.documents import NORM
from tallyscope.plans.objects import OBJ, objects
from tallyscope.plans.observations import CODES, MERGED, OBS, RAW, merge_issues, observations, raw_issues
from tallyscope.plans.registry import query
from tallyscope.sources.tables import table

#: Names that a program gives to pictures, words that name decoration, kinds of structure and of media.
AUTOMATIC_NAME = r"^(picture|image|photo|图片|图像)[ _-]*[0-9]+$"
DECORATION = r"\b(?:background|connector|decoration|decorative|line|node|oval|rectangle|shape|accent|ornament|arrow)\b"
STRUCTURE = ("connector", "group", "shape", "placeholder", "unknown")
MEDIA = ("chart", "linked_picture", "media", "picture", "table")
BULLET = r"^\s*(?:[-*•]|[0-9]+[.)、]|[一二三四五六七八九十]+[、.])\s*"
RECORD_ID = "^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"


def meaningful_alt_text(alt: Column, name: Column) -> Column:
    """Three characters or more, no automatic name, and not the object's own name."""
    value = F.trim(F.coalesce(alt, F.lit("")))
    return (F.length(value) >= 3) & ~F.lower(value).rlike(AUTOMATIC_NAME) & (F.lower(value) != F.lower(F.trim(F.coalesce(name, F.lit("")))))


def decorative(text: Column, kind: Column, w: Column, h: Column, name: Column) -> Column:
    """Without text, and of a structural kind, very large, small or thin, or named like decoration."""
    area = F.greatest(lit(0), w) * F.greatest(lit(0), h)
    odd = (area > 0.45) | (area < 0.0025) | (w < 0.012) | (h < 0.012)
    named = F.trim(F.regexp_replace(F.lower(name), "[ _-]+", " ")).rlike(DECORATION)
    return (F.coalesce(text, F.lit("")) == "") & (kind.isin(*STRUCTURE) | odd | named)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of an sRGB colour with parts of 0 to 255."""
    part = lambda c: F.when(c / lit(255) <= 0.04045, c / lit(255) / lit(12.92)).otherwise(F.pow((c / lit(255) + lit(0.055)) / lit(1.055), lit(2.4)))
    return lit(0.2126) * part(r) + lit(0.7152) * part(g) + lit(0.0722) * part(b)


def requirements(text: Column) -> Column:
    """The requirements of a request: its lines and sentences without bullets; the whole if none has two characters."""
    parts = F.transform(F.split(text, "[\n\r;；。]+"), lambda p: F.trim(F.regexp_replace(p, BULLET, "")))
    kept = F.filter(parts, lambda p: F.length(X.normalize_text(p)) >= 2)
    whole = F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.array(F.trim(text)))
    return F.when(F.size(kept) > 0, kept).otherwise(whole)


@query(
    "q67_duplicate_titles",
    f"""WITH {OBJ} SELECT deck, count(*) AS n_titles, round(1 - count(DISTINCT lower(trim(text)))::double / count(*), 6) AS ratio FROM obj WHERE kind = 'text' GROUP BY deck""",
)
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a deck's titles that repeat another."""
    titles = objects(spark, sf_dir).where("kind = 'text'").groupBy("deck", F.lower(F.trim("text")).alias("title")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return titles.groupBy("deck").agg(total.alias("n_titles"), round6(lit(1) - F.count(F.lit(1)) / total).alias("ratio"))


@query(
    "q68_alt_text",
    """WITH p AS (SELECT p_partkey, p_type AS name, CASE p_partkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'Picture ' || p_partkey::varchar WHEN 2 THEN lower(p_type) || ' ' ELSE p_name END AS alt FROM part),
m AS (SELECT p_partkey, length(trim(alt)) >= 3 AND NOT regexp_matches(lower(trim(alt)), '^(picture|image|photo|图片|图像)[ _-]*[0-9]+$') AND lower(trim(alt)) <> lower(trim(name)) AS meaningful FROM p)
SELECT p_partkey, meaningful, CASE WHEN meaningful THEN 'INFO' ELSE 'MAJOR' END AS severity FROM m""",
)
def alt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures whose alternative text says something."""
    key = F.col("p_partkey")
    alt = F.when(key % 5 == 0, F.lit("  ")).when(key % 5 == 1, F.concat(F.lit("Picture "), key.cast("string"))).when(key % 5 == 2, F.concat(F.lower("p_type"), F.lit(" "))).otherwise(F.col("p_name"))
    m = table(spark, sf_dir, "part").select("p_partkey", meaningful_alt_text(alt, F.col("p_type")).alias("meaningful"))
    return m.withColumn("severity", F.when(F.col("meaningful"), "INFO").otherwise("MAJOR"))


@query(
    "q69_decorative_objects",
    rf"""WITH {OBJ}, o AS (SELECT *, CASE kind WHEN 'text' THEN text ELSE '' END AS shown, CASE kind WHEN 'decoration' THEN 'shape' WHEN 'image' THEN 'picture' ELSE kind END AS sort,
    ['Accent_Line 1', 'photo', 'my-outline', 'Group'][((ord - 1) % 4 + 1)::int] AS name FROM obj),
d AS (SELECT *, shown = '' AND (sort IN ('connector', 'group', 'shape', 'placeholder', 'unknown') OR w * h > 0.45 OR w * h < 0.0025 OR w < 0.012 OR h < 0.012
  OR regexp_matches(trim(regexp_replace(lower(name), '[ _-]+', ' ', 'g')), '\b(?:background|connector|decoration|decorative|line|node|oval|rectangle|shape|accent|ornament|arrow)\b')) AS decorative FROM o)
SELECT deck, ord, decorative, decorative AND sort NOT IN ('chart', 'linked_picture', 'media', 'picture', 'table') AND (x < -0.005 OR y < -0.005 OR x + w > 1.005 OR y + h > 1.005) AS bleed FROM d""",
)
def decorative_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoration, and decoration that reaches beyond the page on purpose."""
    kind, (x, y, w, h) = F.col("kind"), map(F.col, "xywh")
    shown = F.when(kind == "text", F.col("text")).otherwise("")
    sort = F.when(kind == "decoration", "shape").when(kind == "image", "picture").otherwise(kind)
    name = F.element_at(F.array(*map(F.lit, ("Accent_Line 1", "photo", "my-outline", "Group"))), ((F.col("ord") - 1) % 4 + 1).cast("int"))
    outside = (x < -0.005) | (y < -0.005) | (x + w > 1.005) | (y + h > 1.005)
    found = objects(spark, sf_dir).withColumn("decorative", decorative(shown, sort, w, h, name))
    return found.select("deck", "ord", "decorative", (F.col("decorative") & ~sort.isin(*MEDIA) & outside).alias("bleed"))


@query("q70_result_uniqueness", f"WITH {OBS} SELECT run, metric, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) > 1")
def result_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a run that share a metric."""
    return observations(spark, sf_dir).groupBy("run", "metric").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "q71_forced_pages",
    f"""WITH {OBS}, p AS (SELECT run, page, bool_or(severity = 'CRITICAL' AND eff IS NOT NULL) AS forced FROM obs GROUP BY run, page),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY page) AS rn, count(*) OVER (PARTITION BY run) AS n FROM p)
SELECT run, page, forced FROM r WHERE forced OR n <= 4 OR list_contains(list_transform(range(4), lambda i: floor(i * (n - 1) / 3)::bigint + 1), rn)""",
)
def forced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even sample of four pages, and all critical pages beyond it."""
    forced = F.bool_or((F.col("severity") == "CRITICAL") & F.col("eff").isNotNull())
    p = observations(spark, sf_dir).groupBy("run", "page").agg(F.coalesce(forced, F.lit(False)).alias("forced"))
    rn, n = F.row_number().over(Window.partitionBy("run").orderBy("page")), F.count(F.lit(1)).over(Window.partitionBy("run"))
    r = p.withColumns({"rn": rn.cast("long"), "n": n})
    return r.where(F.col("forced") | F.array_contains(even_places(F.col("n"), 4), F.col("rn"))).select("run", "page", "forced")


@query(
    "q72_worst_region",
    f"""WITH {OBS} SELECT run, page, min({{'e': eff, 'i': event_id}}).i AS event_id, round(min(eff), 6) AS score FROM obs WHERE eff IS NOT NULL GROUP BY run, page""",
)
def worst_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest finding of each page."""
    least = F.min_by("event_id", F.struct("eff", "event_id"))
    return observations(spark, sf_dir).where("eff is not null").groupBy("run", "page").agg(least.alias("event_id"), round6(F.min("eff")).alias("score"))


@query(
    "q73_issue_order",
    f"""WITH {OBS}, {RAW}, {MERGED} SELECT run, family, pages[1] AS first_page, row_number() OVER (PARTITION BY run ORDER BY priority, rank DESC, family, pages[1]) AS place FROM merged""",
)
def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of a run by priority, severity, family and first page."""
    m = merge_issues(raw_issues(spark, sf_dir)).withColumn("first_page", F.get("focus_pages", F.lit(0)))
    order = Window.partitionBy("run").orderBy("priority", F.desc("rank"), "family", "first_page")
    return m.select("run", "family", "first_page", F.row_number().over(order).alias("place"))


@query(
    "q74_set_relations",
    f"""WITH {OBS}, s AS (SELECT run, list_sort(list_distinct(list(metric))) AS metrics, coalesce(list_sort(list_distinct(list(page) FILTER (WHERE metric = 'view'))), []) AS a,
  coalesce(list_sort(list_distinct(list(page) FILTER (WHERE metric = 'click'))), []) AS b FROM obs GROUP BY run)
SELECT run, array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda m: NOT list_contains(metrics, m))), ',') AS missing, a = b AS equal, len(list_filter(a, lambda p: NOT list_contains(b, p))) = 0 AS subset FROM s""",
)
def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that a run lacks, and whether the pages of two metrics are equal or one's among the other's."""
    own = lambda m: F.array_sort(F.collect_set(F.when(F.col("metric") == m, F.col("page")))).alias(m)
    s = observations(spark, sf_dir).groupBy("run").agg(F.collect_set("metric").alias("metrics"), own("view"), own("click"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, sorted(CODES))), "metrics"))
    return s.select("run", F.array_join(missing, ",").alias("missing"), (F.col("view") == F.col("click")).alias("equal"), (F.size(F.array_except("view", "click")) == 0).alias("subset"))


LINEAR = "CASE WHEN {0} / 255::double <= 0.04045 THEN {0} / 255::double / 12.92::double ELSE pow(({0} / 255::double + 0.055::double) / 1.055::double, 2.4::double) END"
LIGHT = " + ".join(f"{w}::double * ({LINEAR.format(c)})" for w, c in ((0.2126, "{0}"), (0.7152, "{1}"), (0.0722, "{2}")))


@query(
    "q75_contrast",
    f"""WITH c AS (SELECT p_partkey, {LIGHT.format("(p_partkey * 7 % 256)", "(p_partkey * 13 % 256)", "(p_partkey * 29 % 256)")} AS l, {LIGHT.format("(p_size * 5 % 256)", "(p_size * 3 % 256)", "(p_size % 256)")} AS d FROM part)
SELECT p_partkey, round((greatest(l, d) + 0.05::double) / (least(l, d) + 0.05::double), 6) AS contrast FROM c""",
)
def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the contrast of two colours."""
    key, size = F.col("p_partkey"), F.col("p_size")
    one, other = luminance(*[key * k % 256 for k in (7, 13, 29)]), luminance(*[size * k % 256 for k in (5, 3, 1)])
    c = table(spark, sf_dir, "part").select("p_partkey", one.alias("l"), other.alias("d"))
    return c.select("p_partkey", round6((F.greatest("l", "d") + lit(0.05)) / (F.least("l", "d") + lit(0.05))).alias("contrast"))


@query(
    "q76_durations_and_ids",
    """WITH e AS (SELECT user_id AS run, count(*) AS n, greatest(0, (epoch_us(arg_max(ts, event_id)) - epoch_us(arg_min(ts, event_id))) // 1000) AS duration_ms FROM events GROUP BY user_id)
SELECT run, duration_ms, regexp_matches('run-' || run::varchar || CASE WHEN run % 3 = 0 THEN '/..' ELSE '' END, '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$') AS valid FROM e""",
)
def durations_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time from a run's first event to its last, 0 at least, and whether its record id is well formed."""
    at = lambda f: F.unix_micros(f(F.col("ts").cast("timestamp"), F.col("event_id")))
    took = ((at(F.max_by) - at(F.min_by)) / 1000).cast("long")
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.greatest(F.lit(0), took).alias("duration_ms"))
    name = F.concat(F.lit("run-"), F.col("run").cast("string"), F.when(F.col("run") % 3 == 0, "/..").otherwise(""))
    return e.select("run", "duration_ms", name.rlike(RECORD_ID).alias("valid"))


@query(
    "q77_cost_budget_stop",
    """WITH c AS (SELECT event_id, user_id AS run, (round(value * 100))::bigint AS cost, event_type = 'error' AS mandatory FROM events),
ran AS (
  SELECT *, mandatory OR coalesce(sum(cost) OVER w, 0) < 50000 AS goes FROM c
  WINDOW w AS (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run, count(*) FILTER (WHERE goes) AS n_run, count(*) FILTER (WHERE NOT goes) AS n_skipped, count(*) FILTER (WHERE goes AND mandatory) AS n_mandatory,
  coalesce(sum(cost) FILTER (WHERE goes), 0)::bigint AS spent FROM ran GROUP BY run""",
)
def cost_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps run while the cost of those before is within the budget, mandatory ones in any case; the rest is
    skipped. A step is skipped only once the budget is spent, and from then on nothing but mandatory steps adds to the
    cost, so the sum over all steps before tells the same as that over those that ran."""
    c = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("run"), F.round(F.col("value") * 100).cast("long").alias("cost"), (F.col("event_type") == "error").alias("mandatory")
    )
    b = running_before(c, "run", "event_id", F.col("cost"), "before")
    goes = F.col("mandatory") | (F.col("before") < 50000)
    return b.groupBy("run").agg(
        F.count_if(goes).alias("n_run"), F.count_if(~goes).alias("n_skipped"), F.count_if(goes & F.col("mandatory")).alias("n_mandatory"),
        F.coalesce(F.sum(F.when(goes, F.col("cost"))), F.lit(0)).alias("spent"),
    )


@query(
    "q78_histogram_percentile",
    f"""WITH {OBS}, h AS (SELECT metric, floor(eff * 20)::bigint AS bin, count(*) AS n FROM obs WHERE eff IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY metric) AS total FROM h)
SELECT metric, min(bin) FILTER (WHERE upto >= greatest(1, round_even(total * 0.2::double, 0))) AS low, min(bin) FILTER (WHERE upto >= greatest(1, round_even(total * 0.8::double, 0))) AS high FROM c GROUP BY metric""",
)
def histogram_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bin at which a histogram has come to a share of its counts."""
    h = observations(spark, sf_dir).where("eff is not null").groupBy("metric", F.floor(F.col("eff") * 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    c = h.withColumns({"upto": F.sum("n").over(Window.partitionBy("metric").orderBy("bin")), "total": F.sum("n").over(Window.partitionBy("metric"))})
    at = lambda f: F.min(F.when(F.col("upto") >= F.greatest(lit(1), F.bround(F.col("total") * lit(f), 0)), F.col("bin")))
    return c.groupBy("metric").agg(at(0.2).alias("low"), at(0.8).alias("high"))


@query(
    "q79_requirement_split",
    rf"""WITH r AS (SELECT item_id, text, list_filter(list_transform(regexp_split_to_array(text, '[\n\r;；。]+'), lambda p: trim(regexp_replace(p, '^\s*(?:[-*•]|[0-9]+[.)、]|[一二三四五六七八九十]+[、.])\s*', ''))),
    lambda p: length({NORM.format("p")}) >= 2) AS kept FROM benchmark WHERE text IS NOT NULL)
SELECT item_id, len(CASE WHEN len(kept) > 0 THEN kept WHEN trim(text) = '' THEN [] ELSE [trim(text)] END) AS n, array_to_string(CASE WHEN len(kept) > 0 THEN kept WHEN trim(text) = '' THEN [] ELSE [trim(text)] END, '|') AS parts FROM r""",
)
def requirement_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the requirements that a request lists."""
    r = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", requirements(F.col("text")).alias("parts"))
    return r.select("item_id", F.size("parts").cast("long").alias("n"), F.array_join("parts", "|").alias("parts"))


@query(
    "q80_criterion_aggregation",
    f"""WITH {OBS}, g AS (SELECT run, metric, avg(eff) AS score, min(confidence) AS confidence, max(rank) FILTER (WHERE eff IS NOT NULL) AS worst, count(eff) AS n_valid, count(*) AS n,
  list_sort(list_distinct(list(page) FILTER (WHERE severity IN ('MAJOR', 'CRITICAL') AND eff IS NOT NULL))) AS pages FROM obs GROUP BY run, metric)
SELECT run, metric, round(CASE WHEN confidence < 0.6 THEN NULL ELSE score END, 6) AS score, round(confidence, 6) AS confidence, coalesce(worst, 0) AS worst, array_to_string(coalesce(pages, []), ',') AS pages,
  CASE WHEN n_valid = 0 THEN 'INSUFFICIENT' WHEN n_valid < n THEN 'PARTIAL' ELSE 'FULL' END AS observability FROM g""",
)
def criterion_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A criterion from its pages: the mean of valid scores, the least confidence, the worst severity, all
    affected pages; no score below a floor of confidence."""
    valid, rank = F.col("eff").isNotNull(), ladder((F.col("severity") == "CRITICAL", F.lit(5)), (F.col("severity") == "MAJOR", F.lit(4)), (F.col("severity") == "MINOR", F.lit(3)), otherwise=F.lit(2))
    hit = valid & F.col("severity").isin("MAJOR", "CRITICAL")
    g = observations(spark, sf_dir).groupBy("run", "metric").agg(
        F.avg("eff").alias("score"), F.min("confidence").alias("confidence"), F.coalesce(F.max(F.when(valid, rank)), F.lit(0)).alias("worst"),
        F.count("eff").alias("n_valid"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(hit, F.col("page")))).alias("pages"),
    )
    seen = ladder((F.col("n_valid") == 0, F.lit("INSUFFICIENT")), (F.col("n_valid") < F.col("n"), F.lit("PARTIAL")), otherwise=F.lit("FULL"))
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")
    return g.select("run", "metric", round6(F.when(F.col("confidence") >= 0.6, F.col("score"))).alias("score"), round6(F.col("confidence")).alias("confidence"), "worst", pages.alias("pages"), seen.alias("observability"))


@query(
    "q81_bounded_sample_floor",
    f"""WITH {OBS}, g AS (SELECT run, metric, count(*) AS n, count(*) FILTER (WHERE status = 'SCORED') AS n_scored, sum(importance) AS total, coalesce(sum(importance) FILTER (WHERE status = 'SCORED'), 0) AS sampled FROM obs GROUP BY run, metric)
SELECT run, metric, round(CASE WHEN n_scored < least(3, n) OR total <= 0 THEN 0.6::double ELSE least(0.6::double, sampled / total) END, 6) AS floor FROM g""",
)
def bounded_sample_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage that a metric needs, less where a full sample of three pages was scored."""
    scored = F.col("status") == "SCORED"
    g = observations(spark, sf_dir).groupBy("run", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(scored).alias("n_scored"), F.sum("importance").alias("total"), F.coalesce(F.sum(F.when(scored, F.col("importance"))), lit(0)).alias("sampled")
    )
    short = (F.col("n_scored") < F.least(F.lit(3), F.col("n"))) | (F.col("total") <= 0)
    return g.select("run", "metric", round6(F.when(short, lit(0.6)).otherwise(F.least(lit(0.6), F.col("sampled") / F.col("total")))).alias("floor"))


@query(
    "q82_language_labels",
    f"""WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\u3400-\u4dbf\u4e00-\u9fff]')) AS han,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '{X.LATIN_WORD.replace("'", "''")}'), lambda w: lower(w) NOT IN ({", ".join(f"'{w}'" for w in X.NEUTRAL_WORDS)}) AND NOT (upper(w) = w AND length(w) <= 5))) AS latin FROM documents)
SELECT doc_id, CASE WHEN han >= 2 AND latin >= 3 THEN 'MIXED' WHEN han >= 2 THEN 'ZH' WHEN latin >= 3 THEN 'EN' ELSE 'UNKNOWN' END AS label FROM n""",
)
def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of a text by its scripts."""
    return table(spark, sf_dir, "documents").select("doc_id", X.language_label(F.coalesce("text", F.lit(""))).alias("label"))
