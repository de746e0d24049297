"""Queries over `documents` read as decks: a document is a deck, each of its lines a page, each sentence an object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.functions import text as X
from tallyscope.functions.scores import clamp, ladder, lit, lookup, piecewise, ratio, round6, severity_band, steady6
from tallyscope.operators.reduce import page_quality
from tallyscope.operators.sampling import active_sampling, budgeted_sample, even_places, running_before
from tallyscope.plans.registry import query
from tallyscope.sources.tables import spread, table, written

IMPORTANCE = {"cover": 1.25, "data": 1.20, "content": 1.00, "section": 0.75, "closing": 0.50}
#: Characters and text objects that a page of each role carries easily (soft) and at all (hard).
LIMITS = {
    "cover": (140, 320, 6, 12), "section": (180, 400, 8, 14), "closing": (180, 400, 8, 14),
    "content": (700, 1200, 18, 30), "data": (700, 1200, 18, 30),
}
CLOSING = ("thank", "danke", "merci", "gracias", "questions")
KNOTS = ((0.0, 0.0), (0.03, 0.5), (0.20, 1.0), (0.45, 0.85), (1.20, 0.0))
RESIDUE = {
    "placeholder": r"lorem ipsum|your text here|click to add",
    "license": r"all rights reserved|licensed under|license, version",
    "credential": r"password ?=|token ?=|akia[0-9a-z]{8}",
    "separator": r" \| ",
    "repeat": r"(?:^|\W)(?:todo|tbd|xxx)(?:\W|$)",
}


def n_objects(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"\."), lambda s: F.trim(s) != ""))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, page, n_pages, line, objects, chars, role, importance, key_unit: one row for each line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    docs = docs.select("doc_id", "lang", "source", lines.alias("lines"))
    each = docs.select("doc_id", "lang", "source", F.size("lines").alias("n_pages"), F.posexplode("lines").alias("pos", "line"))
    each = each.withColumn("page", F.col("pos") + 1).drop("pos")
    each = each.withColumn("objects", n_objects(F.col("line"))).withColumn("chars", X.nonblank_length(F.col("line")))
    low = F.lower("line")
    ends = [low.contains(w) for w in CLOSING]
    said = ends[0]
    for e in ends[1:]:
        said = said | e
    norm = F.length(X.normalize_text(F.col("line")))
    role = ladder(
        (F.col("page") == 1, "cover"),
        ((F.col("page") == F.col("n_pages")) & said, "closing"),
        (F.col("line").rlike("[0-9]"), "data"),
        ((F.col("objects") <= 2) & (norm > 0) & (norm <= 90), "section"),
        otherwise="content",
    )
    return (
        each.withColumn("role", role)
        .withColumn("importance", lookup(F.col("role"), IMPORTANCE))
        .withColumn("key_unit", F.col("role").isin("cover", "data"))
    )


SAID = " OR ".join(f"contains(lower(line), '{w}')" for w in CLOSING)
NORM = "regexp_replace(lower({}), '[^0-9a-z一-鿿]+', '', 'g')"
CASES = lambda i: " ".join(f"WHEN '{k}' THEN {float(v[i])}::double" for k, v in LIMITS.items())
PAGES = rf"""
each_line AS (
  SELECT doc_id, lang, source, len(ls) AS n_pages, unnest(ls) AS line, generate_subscripts(ls, 1) AS page
  FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
counted AS (
  SELECT *, len(list_filter(string_split(line, '.'), lambda s: trim(s) <> '')) AS objects,
    length(regexp_replace(line, '[ \t\r\n\f]', '', 'g')) AS chars, length({NORM.format("line")}) AS norm FROM each_line),
pg AS (
  SELECT *, role IN ('cover', 'data') AS key_unit,
    CASE role {" ".join(f"WHEN '{k}' THEN {v}::double" for k, v in IMPORTANCE.items())} END AS importance
  FROM (SELECT *, CASE WHEN page = 1 THEN 'cover' WHEN page = n_pages AND ({SAID}) THEN 'closing'
      WHEN regexp_matches(line, '[0-9]') THEN 'data' WHEN norm > 0 AND norm <= 90 AND objects <= 2 THEN 'section' ELSE 'content' END AS role
    FROM counted))"""


def reading_load(rows: DataFrame) -> DataFrame:
    """`rows` with eff: 1 less .65 of the load by characters and .35 of that by objects, each from its soft limit (0) to
    its hard one (1); null without characters."""
    limit = lambda i: lookup(F.col("role"), {k: float(v[i]) for k, v in LIMITS.items()})
    load = lambda x, i: clamp((F.col(x) - limit(i)) / (limit(i + 1) - limit(i)))
    score = lit(1) - lit(0.65) * load("chars", 0) - lit(0.35) * load("objects", 2)
    return rows.withColumn("eff", F.when(F.col("chars") > 0, score))


LOAD = f"""
loads AS (
  SELECT *, CASE WHEN chars > 0 THEN 1::double
    - 0.65::double * greatest(0::double, least(1::double, (chars - (CASE role {CASES(0)} END)) / ((CASE role {CASES(1)} END) - (CASE role {CASES(0)} END))))
    - 0.35::double * greatest(0::double, least(1::double, (objects - (CASE role {CASES(2)} END)) / ((CASE role {CASES(3)} END) - (CASE role {CASES(2)} END))))
    END AS eff FROM pg)"""


@query(
    "q01_reading_load_page_quality",
    f"""WITH {PAGES}, {LOAD},
reduced AS (
  SELECT doc_id, count(*) AS n_pages, count(eff) AS n_scored,
    CASE WHEN min(CASE WHEN key_unit THEN eff END) IS NULL THEN (0.60::double * avg(eff) + 0.25::double * quantile_disc(eff, 0.2)) / 0.85::double
      ELSE 0.60::double * avg(eff) + 0.25::double * quantile_disc(eff, 0.2) + 0.15::double * min(CASE WHEN key_unit THEN eff END) END AS score
  FROM loads GROUP BY doc_id)
SELECT doc_id, n_pages, n_scored, floor(score * 1000000 + 0.500001::double) / 1000000 AS score,
  CASE WHEN score IS NULL THEN 'NA' WHEN score >= 0.8 THEN 'PASS' WHEN score >= 0.6 THEN 'REVIEW' ELSE 'FAIL' END AS band FROM reduced""",
)
def reading_load_page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading load of every page, reduced to a page quality and a band for each document."""
    found = reading_load(pages(spark, sf_dir)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count("eff").alias("n_scored"), page_quality().alias("raw")
    )
    raw = F.col("raw")
    band = ladder((raw.isNull(), "NA"), (raw >= 0.8, "PASS"), (raw >= 0.6, "REVIEW"), otherwise="FAIL")
    return found.select("doc_id", "n_pages", "n_scored", steady6(raw).alias("score"), band.alias("band"))


@query(
    "q02_content_presence",
    f"""WITH {PAGES}
SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE chars > 0) AS n_present,
  count(*) FILTER (WHERE chars = 0 AND key_unit) AS n_critical,
  CASE WHEN count(*) FILTER (WHERE chars > 0) = 0 THEN 0.0::double
    WHEN count(*) FILTER (WHERE chars > 0) / count(*) < 0.5 THEN 0.5::double ELSE 1.0::double END AS multiplier
FROM pg GROUP BY doc_id""",
)
def content_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with content, empty key pages, and the visibility gate."""
    has = F.col("chars") > 0
    n, some = F.count(F.lit(1)), F.count_if(has)
    return pages(spark, sf_dir).groupBy("doc_id").agg(
        n.alias("n_pages"),
        some.alias("n_present"),
        F.count_if(~has & F.col("key_unit")).alias("n_critical"),
        F.when(some == 0, lit(0)).when(some / n < 0.5, lit(0.5)).otherwise(lit(1)).alias("multiplier"),
    )


STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS = (
    r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z][a-z0-9_-]{{2,}}|[0-9]+(?:\.[0-9]+)?%?'), lambda t: t NOT IN ("
    + STOP
    + ")))"
)
SIMILAR = "CASE WHEN len({0}) + len({1}) = 0 THEN 1::double ELSE len(list_intersect({0}, {1}))::double / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"


@query(
    "q03_transition_adjacent",
    f"""WITH {PAGES},
steps AS (SELECT doc_id, page, role, importance, chars, {TOKENS.format("line")} AS t FROM pg),
pairs AS (
  SELECT doc_id, page AS right_page, lag(page) OVER w AS left_page, role, t, lag(t) OVER w AS u, chars, lag(chars) OVER w AS before,
    greatest(importance, lag(importance) OVER w) AS importance FROM steps WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
scored AS (
  SELECT *, {SIMILAR.format("t", "u")} AS sim FROM pairs WHERE left_page IS NOT NULL)
SELECT doc_id, left_page, right_page, importance, round(CASE WHEN chars = 0 OR before = 0 THEN NULL WHEN role IN ('section', 'closing') THEN 0.85::double
  WHEN sim >= 0.94 THEN 0.35::double ELSE 0.55::double + 0.45::double * greatest(0::double, least(1::double, sim / 0.20::double)) END, 6) AS score FROM scored""",
)
def transition_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against the one before it."""
    w = Window.partitionBy("doc_id").orderBy("page")
    t = pages(spark, sf_dir).select("doc_id", "page", "role", "importance", "chars", X.tokens(F.col("line")).alias("t"))
    pairs = t.select(
        "doc_id", F.col("page").alias("right_page"), F.lag("page").over(w).alias("left_page"), "role", "t", F.lag("t").over(w).alias("u"),
        "chars", F.lag("chars").over(w).alias("before"), F.greatest("importance", F.lag("importance").over(w)).alias("importance"),
    ).where("left_page is not null")
    # a column of its own, so that the tokens of two pages meet once
    pairs = pairs.withColumn("sim", X.jaccard(F.col("t"), F.col("u")))
    sim = F.col("sim")
    score = ladder(
        ((F.col("chars") == 0) | (F.col("before") == 0), F.lit(None).cast("double")),
        (F.col("role").isin("section", "closing"), lit(0.85)),
        (sim >= 0.94, lit(0.35)),
        otherwise=lit(0.55) + lit(0.45) * clamp(sim / lit(0.20)),
    )
    return pairs.select("doc_id", "left_page", "right_page", "importance", round6(score).alias("score"))


@query(
    "q04_duplicate_pages",
    f"""WITH {PAGES},
u AS (SELECT doc_id, page, {NORM.format("line")} AS norm_text, list_sort({TOKENS.format("line")}) AS t, objects FROM pg),
c AS (
  SELECT *, min(page) OVER w AS class, count(*) OVER w AS n_pages FROM u WHERE norm_text <> '' WINDOW w AS (PARTITION BY doc_id, norm_text, objects, t)),
pairs AS (
  SELECT x.doc_id, least(x.class, y.class) AS left_page, greatest(x.class, y.class) AS right_page, x.norm_text = y.norm_text AS same, x.objects = y.objects AS alike,
    length(x.norm_text) AS n, {SIMILAR.format("x.t", "y.t")} AS sim
  FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.page < y.page),
hits AS (
  SELECT doc_id, left_page, right_page, count(*) AS n_links, CASE WHEN bool_and(same AND alike) THEN 0::double ELSE 0.2::double END AS score FROM pairs
  WHERE (same AND (alike OR n >= 12)) OR (sim >= 0.94 AND alike) GROUP BY doc_id, left_page, right_page)
SELECT d.doc_id, 'deck' AS kind, NULL::bigint AS left_page, NULL::bigint AS right_page, 0 AS n_links, 1::double AS score FROM documents d ANTI JOIN hits h ON d.doc_id = h.doc_id
UNION ALL SELECT doc_id, 'link', left_page, right_page, n_links, score FROM hits UNION ALL SELECT doc_id, 'page', class, page, 0, 1::double FROM c""",
)
def duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate and near duplicate pages of a deck. Pages of one text, number of objects and tokens are a
    class, named after its first page. A `page` row puts a page (right_page) into its class (left_page), one for every
    page that has a text; a `link` row is a link between two classes (or of one with itself) and says how many pairs of
    pages it stands for. A deck without links has a `deck` row of score 1."""
    u = pages(spark, sf_dir).select(
        "doc_id", "page", "objects", X.normalize_text(F.col("line")).alias("norm"), F.array_sort(X.tokens(F.col("line"))).alias("t")
    ).where("norm <> ''")
    marked = u.select("doc_id", "page", "objects", "t", F.xxhash64("norm").alias("mark"), F.length("norm").alias("n"), F.xxhash64("t").alias("set"))
    # written once, as all that follows reads it; the pages of a class are no more than the lines of its deck
    classes = written(
        marked.groupBy("doc_id", "objects", "mark", "n", "set").agg(F.min("page").alias("class"), F.first("t").alias("t"), F.array_sort(F.collect_list("page")).alias("pages")), "classes"
    ).withColumn("n_pages", F.size("pages").cast("long"))
    long = lambda c: c.cast("long")
    members = classes.select("doc_id", F.lit("page").alias("kind"), F.col("class").alias("left_page"), F.explode("pages").alias("right_page"), long(F.lit(0)).alias("n_links"), lit(1).alias("score"))
    link = F.lit("link").alias("kind")
    own = classes.where("n_pages > 1").select(
        "doc_id", link, F.col("class").alias("left_page"), F.col("class").alias("right_page"), long(F.col("n_pages") * (F.col("n_pages") - 1) / 2).alias("n_links"), lit(0).alias("score")
    )
    spots = classes.select("doc_id", "class", "objects", "mark", "n", "n_pages", F.size("t").alias("size"))
    x, y = spots.alias("x"), spots.alias("y")
    ends = (F.col("x.doc_id").alias("doc_id"), link, F.col("x.class").alias("left_page"), F.col("y.class").alias("right_page"), (F.col("x.n_pages") * F.col("y.n_pages")).alias("n_links"))
    alike = F.col("x.objects") == F.col("y.objects")
    in_order = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.class") < F.col("y.class"))
    texts = x.join(y, in_order & (F.col("x.mark") == F.col("y.mark")) & (alike | (F.col("x.n") >= 12))).select(*ends, F.when(alike, lit(0)).otherwise(lit(0.2)).alias("score"))
    # Similar classes meet by their number of objects and a token of the prefix that any two sets of this similarity share
    # (longer tokens first, as they are rarer); only places meet, the sets follow once for each pair.
    ordered = F.transform(F.array_sort(F.transform("t", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda z: z["w"])
    prefix = F.slice(ordered, 1, F.greatest(F.size("t") - F.ceil(F.size("t") * lit(0.94) - lit(1e-9)).cast("int") + 1, F.lit(1)))
    key = F.explode(F.when(F.size("t") == 0, F.array(F.lit(""))).otherwise(prefix))
    keyed = classes.select("doc_id", "objects", "class", "mark", F.size("t").alias("size"), key.alias("key")).withColumn("key", F.xxhash64("key"))
    a, b = keyed.alias("x"), keyed.alias("y")
    fits = F.least("x.size", "y.size") >= lit(0.94) * F.greatest("x.size", "y.size") - lit(1e-9)
    met = a.join(b, in_order & alike & (F.col("x.key") == F.col("y.key")) & (F.col("x.mark") != F.col("y.mark")) & fits)
    met = met.select(F.col("x.doc_id").alias("doc_id"), F.col("x.class").alias("p"), F.col("y.class").alias("q")).distinct()
    side = lambda c: classes.select("doc_id", F.col("class").alias(c), F.col("t").alias(f"t_{c}"), F.col("n_pages").alias(f"n_{c}"))
    near = met.join(side("p"), ["doc_id", "p"]).join(side("q"), ["doc_id", "q"]).where(X.jaccard(F.col("t_p"), F.col("t_q")) >= 0.94)
    near = near.select("doc_id", link, F.col("p").alias("left_page"), F.col("q").alias("right_page"), (F.col("n_p") * F.col("n_q")).alias("n_links"), lit(0.2).alias("score"))
    hits = own.unionByName(texts).unionByName(near)
    hits = written(hits, "links")
    linked = hits.select("doc_id").distinct()
    lone = table(spark, sf_dir, "documents").select("doc_id").join(linked, "doc_id", "left_anti").select(
        "doc_id", F.lit("deck").alias("kind"), F.lit(None).cast("int").alias("left_page"), F.lit(None).cast("int").alias("right_page"), long(F.lit(0)).alias("n_links"), lit(1).alias("score")
    )
    return lone.unionByName(hits).unionByName(members)


@query(
    "q05_language_consistency",
    """WITH per AS (SELECT source, lang, count(*) AS n, sum(length(coalesce(text, ''))) AS units FROM documents WHERE lang IS NOT NULL GROUP BY ALL),
top AS (SELECT source, arg_max(lang, {'u': units, 'l': lang}) AS dominant, sum(n)::bigint AS n_docs FROM per GROUP BY source),
r AS (SELECT t.source, dominant, n_docs, sum(CASE WHEN lang <> dominant THEN n ELSE 0 END)::bigint AS minority FROM top t JOIN per p ON t.source IS NOT DISTINCT FROM p.source GROUP BY ALL)
SELECT source, dominant, n_docs, minority AS n_minority,
  round(greatest(0::double, least(1::double, 1::double - 1.5::double * (0.75::double * minority / n_docs))), 6) AS score,
  CASE WHEN greatest(0::double, least(1::double, 1::double - 1.5::double * (0.75::double * minority / n_docs))) < 0.9 THEN 'MINOR' ELSE 'INFO' END AS severity FROM r""",
)
def language_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant language of a source, by length of text, and how far its documents agree."""
    per = (
        table(spark, sf_dir, "documents").where("lang is not null").groupBy("source", "lang")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("units"))
    )
    rolled = per.groupBy("source").agg(
        F.max_by("lang", F.struct("units", "lang")).alias("dominant"), F.sum("n").alias("n_docs"), F.collect_list(F.struct("lang", "n")).alias("all")
    )
    minority = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.when(x["lang"] != F.col("dominant"), x["n"]).otherwise(F.lit(0)))
    score = clamp(lit(1) - lit(1.5) * (lit(0.75) * minority / F.col("n_docs")))
    return rolled.select(
        "source", "dominant", "n_docs", minority.alias("n_minority"), round6(score).alias("score"), F.when(score < 0.9, "MINOR").otherwise("INFO").alias("severity")
    )


@query(
    "q06_template_residue",
    f"""WITH {PAGES},
codes AS (SELECT doc_id, page, list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(line), '{p}') THEN '{c}' END" for c, p in RESIDUE.items())}], lambda x: x IS NOT NULL) AS c FROM pg),
r AS (SELECT doc_id, sum(len(c))::bigint AS n_hits, count(*) FILTER (WHERE len(c) > 0) AS n_pages_hit, count(*) AS n_pages,
  list_sort(list_distinct(flatten(list(c)))) AS codes FROM codes GROUP BY doc_id)
SELECT doc_id, n_hits, n_pages_hit, array_to_string(codes, ',') AS codes,
  round(CASE WHEN n_hits = 0 THEN 1::double ELSE 1::double - least(0.9::double, 0.30::double + 0.15::double * (n_hits - 1) + 0.20::double * n_pages_hit / n_pages) END, 6) AS score FROM r""",
)
def template_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of left-over text on each page, and the residue score of the document."""
    hit = F.array(*[F.when(F.lower("line").rlike(p), F.lit(c)) for c, p in RESIDUE.items()])
    codes = pages(spark, sf_dir).select("doc_id", F.filter(hit, lambda c: c.isNotNull()).alias("c"))
    r = codes.groupBy("doc_id").agg(
        F.sum(F.size("c")).alias("n_hits"), F.count_if(F.size("c") > 0).alias("n_pages_hit"), F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))), ",").alias("codes"),
    )
    cost = F.least(lit(0.9), lit(0.30) + lit(0.15) * (F.col("n_hits") - 1) + lit(0.20) * F.col("n_pages_hit") / F.col("n"))
    return r.select("doc_id", "n_hits", "n_pages_hit", "codes", round6(F.when(F.col("n_hits") == 0, lit(1)).otherwise(lit(1) - cost)).alias("score"))


def with_cases(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` with the item_id of its case: doc_id modulo the number of items is the item's place in order of item_id,
    so every item has documents at every size. Only the ids are ranked."""
    ids = items.where("item_id is not null").select("item_id").distinct()
    cases = ids.withColumn("case", F.row_number().over(Window.orderBy("item_id")) - 1)
    n_cases = F.broadcast(ids.agg(F.count(F.lit(1)).alias("n_cases")).where("n_cases > 0"))
    placed = docs.crossJoin(n_cases).withColumn("case", F.pmod("doc_id", "n_cases"))
    return placed.join(cases, "case").drop("case", "n_cases")


CASE_OF = """
cases AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n_cases FROM (SELECT DISTINCT item_id FROM benchmark WHERE item_id IS NOT NULL)),
cased AS (SELECT doc_id, item_id FROM documents JOIN cases ON doc_id % n_cases = place)"""


@query(
    "q10_compression_curve",
    f"""WITH {CASE_OF}, r AS (SELECT d.doc_id, length({NORM.format("b.text")})::double / nullif(length({NORM.format("d.text")}), 0) AS x
  FROM documents d JOIN cased USING (doc_id) JOIN benchmark b USING (item_id))
SELECT doc_id, round(x, 6) AS ratio, round(CASE WHEN x IS NULL THEN NULL WHEN x <= 0 THEN 0::double WHEN x <= 0.03 THEN x * (0.5::double / 0.03::double)
  WHEN x <= 0.20 THEN 0.5::double + (x - 0.03::double) * (0.5::double / (0.20::double - 0.03::double))
  WHEN x <= 0.45 THEN 1::double + (x - 0.20::double) * ((0.85::double - 1::double) / (0.45::double - 0.20::double))
  WHEN x <= 1.20 THEN 0.85::double + (x - 0.45::double) * ((0::double - 0.85::double) / (1.20::double - 0.45::double)) ELSE 0::double END, 6) AS score FROM r""",
)
def compression_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of a summary over that of its source, on a curve with a best place."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    size = lambda t: F.length(X.normalize_text(F.col(t)))
    x = ratio(size("b.text").cast("double"), size("d.text"))
    joined = with_cases(docs, items).alias("d").join(items.alias("b"), F.col("d.item_id") == F.col("b.item_id"))
    return joined.select(F.col("d.doc_id").alias("doc_id"), round6(x).alias("ratio"), round6(piecewise(x, KNOTS)).alias("score"))


CLAIMS = r"""
claims AS (
  SELECT item_id, c AS claim, i - 1 AS ord FROM (
    SELECT item_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (
      SELECT item_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\n.!?;。！？；]+'), lambda s: trim(s)), lambda s: length(s) BETWEEN 8 AND 240) AS cs FROM benchmark)))"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.sentences(F.col("text"))).alias("ord", "claim"))


@query(
    "q07_source_claim_alignment",
    f"""WITH {CLAIMS}, {CASE_OF},
d AS (SELECT doc_id, item_id, {TOKENS.format("text")} AS held FROM documents JOIN cased USING (doc_id)),
s AS (SELECT item_id, ord, doc_id, {TOKENS.format("claim")} AS need, held, regexp_matches(claim, '[0-9]') AS numeric FROM claims JOIN d USING (item_id))
SELECT item_id, ord, doc_id, round(CASE WHEN len(need) > 0 THEN len(list_intersect(need, held))::double / len(need) END, 6) AS score,
  CASE WHEN len(need) = 0 THEN NULL WHEN numeric AND len(list_intersect(need, held))::double / len(need) < 0.5 THEN 'CRITICAL'
    WHEN len(list_intersect(need, held))::double / len(need) < 0.35 THEN 'MAJOR' WHEN len(list_intersect(need, held))::double / len(need) < 0.70 THEN 'MINOR' ELSE 'INFO' END AS severity
FROM s""",
)
def source_claim_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each claim's tokens in the sources of its case (each document is a source of one)."""
    held = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("held"))
    s = claims(spark, sf_dir).join(with_cases(held, table(spark, sf_dir, "benchmark")), "item_id")
    score = X.recall(X.tokens(F.col("claim")), F.col("held"))
    severity = F.when(F.col("claim").rlike("[0-9]") & (score < 0.5), "CRITICAL").otherwise(severity_band(score))
    return s.select("item_id", "ord", "doc_id", round6(score).alias("score"), severity.alias("severity"))


@query(
    "q08_numeric_support",
    r"""WITH n AS (
  SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9][0-9.,:-]*[0-9]'))) AS number FROM documents),
held AS (SELECT source, number, count(*) AS n_docs FROM n GROUP BY ALL)
SELECT doc_id, number, n_docs - 1 AS n_support, CASE WHEN n_docs > 1 THEN 'INFO' ELSE 'CRITICAL' END AS severity
FROM n JOIN held USING (source, number)""",
)
def numeric_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of a document, with how many other documents of its source state it too."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9][0-9.,:-]*[0-9]"), F.lit(0)))
    n = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(found).alias("number"))
    held = n.groupBy("source", "number").agg(F.count(F.lit(1)).alias("n_docs"))
    return n.join(held, ["source", "number"]).select(
        "doc_id", "number", (F.col("n_docs") - 1).alias("n_support"), F.when(F.col("n_docs") > 1, "INFO").otherwise("CRITICAL").alias("severity")
    )


@query(
    "q09_key_point_recall",
    f"""WITH {CLAIMS}, {CASE_OF},
d AS (SELECT doc_id, item_id, {TOKENS.format("text")} AS held, {NORM.format("coalesce(text, '')")} AS hay FROM documents JOIN cased USING (doc_id)),
s AS (SELECT item_id, ord, doc_id, {TOKENS.format("claim")} AS need, held, {NORM.format("claim")} AS needle, hay FROM claims JOIN d USING (item_id)),
r AS (SELECT item_id, doc_id, ord, CASE WHEN needle <> '' AND contains(hay, needle) THEN 1::double WHEN len(need) = 0 THEN contains(hay, needle)::int::double ELSE len(list_intersect(need, held))::double / len(need) END AS x FROM s)
SELECT item_id, doc_id, count(*) AS n_points, count(*) FILTER (WHERE x >= 0.5) AS n_covered, round(avg(x), 6) AS score FROM r GROUP BY item_id, doc_id""",
)
def key_point_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of each passage's sentences in each document of its case."""
    text = F.coalesce("text", F.lit(""))
    # each text is normalised and tokenised once, not again for every sentence it meets
    docs = table(spark, sf_dir, "documents").select("doc_id", X.normalize_text(text).alias("hay"), X.tokens(text).alias("held"))
    points = claims(spark, sf_dir).select("item_id", "ord", X.normalize_text(F.col("claim")).alias("needle"), X.tokens(F.col("claim")).alias("needed"))
    s = points.join(with_cases(docs, table(spark, sf_dir, "benchmark")), "item_id")
    s = s.withColumn("x", X.recall_of(F.col("needle"), F.col("needed"), F.col("hay"), F.col("held")))
    return s.groupBy("item_id", "doc_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("x") >= 0.5).alias("n_covered"), round6(F.avg("x")).alias("score")
    )


@query(
    "q29_even_sample",
    """WITH d AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)
SELECT DISTINCT doc_id, n AS n_pages, unnest(CASE WHEN n <= 4 THEN range(1, n + 1) ELSE list_transform(range(0, 4), lambda i: (i * (n - 1)) // 3 + 1) END) AS page FROM d""",
)
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages of each document in even steps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_pages"))
    return docs.select("doc_id", "n_pages", F.explode(even_places(F.col("n_pages"), 4)).alias("page"))


@query(
    "q30_budgeted_risk_sample",
    f"""WITH {PAGES}, {LOAD},
risks AS (SELECT doc_id, page, n_pages, eff, CASE WHEN eff < 0.70 THEN row_number() OVER (PARTITION BY doc_id, coalesce(eff < 0.70, false) ORDER BY eff, importance DESC, page) END AS risk FROM loads),
tiers AS (
  SELECT *, CASE WHEN risk <= 2 THEN 0 WHEN page IN (1, n_pages) THEN 1
      WHEN n_pages <= 4 OR list_contains(list_transform(range(0, 4), lambda i: (i * (n_pages - 1)) // 3 + 1), page) THEN 2 ELSE 3 END AS tier,
    CASE WHEN risk <= 2 THEN risk WHEN page = 1 THEN 0 WHEN page = n_pages THEN 1 ELSE page END AS place FROM risks)
SELECT doc_id, page, n_pages, tier FROM tiers QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier, place, page) <= 4""",
)
def budgeted_risk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages of each document: the two most loaded, the ends, then even steps."""
    loads = reading_load(pages(spark, sf_dir))
    risky = F.coalesce(F.col("eff") < 0.70, F.lit(False))
    rank = F.row_number().over(Window.partitionBy("doc_id", "risky").orderBy("eff", F.desc("importance"), "page"))
    ranked = loads.withColumn("risky", risky).withColumn("risk", F.when(F.col("risky"), rank))
    picked = budgeted_sample(ranked.select(F.col("doc_id").alias("deck"), "page", "n_pages", "risk"), 4)
    return picked.select(F.col("deck").alias("doc_id"), "page", "n_pages", F.col("best.tier").alias("tier"))


@query(
    "q31_active_sampling",
    """WITH r AS (
  SELECT d.doc_id, d.source, coalesce(1 - abs(l.quality - 0.5::double), 1::double) AS uncertainty, coalesce((l.quality = 1 AND l.toxic = 1)::int::double, 0::double) AS disagreement,
    coalesce(l.toxic::double, 0::double) AS severity, least(1::double, length(coalesce(d.text, '')) / 4993::double) AS value,
    ('0x' || sha256(d.doc_id::varchar)[1:8])::bigint / 4294967295::double AS rnd,
    1::double / (1::double + (row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1)) AS bonus
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, round(bonus, 6) AS bonus, round(0.28::double * uncertainty + 0.24::double * disagreement + 0.22::double * severity + 0.16::double * value + 0.10::double * bonus + 0.005::double * rnd, 6) AS score FROM r""",
)
def rank_for_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to label first."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    r = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("record"), F.col("source").alias("diversity_key"), F.col("doc_id").alias("seq"),
        F.coalesce(lit(1) - F.abs(F.col("quality") - lit(0.5)), lit(1)).alias("uncertainty"),
        F.coalesce(((F.col("quality") == 1) & (F.col("toxic") == 1)).cast("double"), lit(0)).alias("disagreement"),
        F.coalesce(F.col("toxic").cast("double"), lit(0)).alias("severity"),
        F.least(lit(1), F.length(F.coalesce("text", F.lit(""))) / lit(4993)).alias("value"),
    )
    return active_sampling(r).select(F.col("record").alias("doc_id"), round6(F.col("bonus")).alias("bonus"), round6(F.col("score")).alias("score"))


@query(
    "q45_byte_budget_prefix",
    """WITH s AS (SELECT doc_id, source, strlen(coalesce(text, '')) AS n, coalesce(sum(strlen(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, count(*) AS n_docs, sum(least(n, 20000 - before))::bigint AS n_bytes FROM s WHERE before < 20000 GROUP BY source""",
)
def byte_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source, by id, that fit a budget of 20,000 bytes, the last one in part."""
    n = F.octet_length(F.coalesce("text", F.lit("")))
    s = table(spark, sf_dir, "documents").select("doc_id", "source", n.cast("long").alias("n"))
    s = running_before(s, "source", "doc_id", F.col("n"), "before").where("before < 20000")
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.least("n", F.lit(20000) - F.col("before"))).alias("n_bytes"))


@query(
    "q44_conflicting_values",
    r"""WITH v AS (
  SELECT DISTINCT source, regexp_extract(m, '^[a-z]+') AS label, regexp_extract(m, '[0-9][0-9.]*$') AS value
  FROM (SELECT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,25}(?:,? version|:|=) ?[0-9]+(?:[.][0-9]+)?')) AS m FROM documents))
SELECT source, label, count(*) AS n_values FROM v GROUP BY ALL HAVING count(*) > 1""",
)
def conflicting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that one source gives more than one value."""
    form = F.lit("[a-z]{2,25}(?:,? version|:|=) ?[0-9]+(?:[.][0-9]+)?")
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), form, F.lit(0))
    v = table(spark, sf_dir, "documents").select("source", F.explode(found).alias("m"))
    v = v.select("source", F.regexp_extract("m", "^[a-z]+", 0).alias("label"), F.regexp_extract("m", "[0-9][0-9.]*$", 0).alias("value")).distinct()
    return v.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


@query(
    "q51_stable_ids_and_excerpts",
    r"""WITH e AS (SELECT doc_id, sha256(concat_ws('|', doc_id::varchar, coalesce(source, ''), coalesce(lang, '')))[1:16] AS evidence_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS one FROM documents)
SELECT doc_id, evidence_id, CASE WHEN length(one) > 120 THEN one[1:119] || '…' ELSE one END AS excerpt FROM e""",
)
def stable_ids_and_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic evidence ids and one-line excerpts."""
    from tallyscope.functions.scores import stable_id

    none = F.lit("")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        stable_id(16, F.col("doc_id"), F.coalesce("source", none), F.coalesce("lang", none)).alias("evidence_id"),
        X.excerpt(F.coalesce("text", none)).alias("excerpt"),
    )
