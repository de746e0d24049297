"""Queries over `lineitem` read as placed objects: an order is a deck, quantity bands are its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.functions.scores import clamp, lit, round6, severity_band
from tallyscope.operators import geometry as G
from tallyscope.plans.registry import query
from tallyscope.sources.tables import table

KINDS = ("text", "image", "chart", "decoration")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deck, page, ord, kind, x, y, w, h, font, text, importance: ord is a total order of the objects of a deck."""
    item = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return item.select(
        F.col("l_orderkey").alias("deck"), (F.col("l_linenumber") % 3).alias("page"), F.row_number().over(order).alias("ord"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 4 + 1).cast("int")).alias("kind"),
        (F.col("l_discount") * lit(9)).alias("x"), (F.col("l_tax") * lit(12)).alias("y"), (F.col("l_quantity") / lit(60)).alias("w"),
        ((F.col("l_suppkey") % 10 + 1) / lit(20)).alias("h"), (F.col("l_partkey") % 30 + 6).cast("double").alias("font"),
        F.concat(F.lit("Title "), F.col("l_returnflag"), F.lit(" "), (F.col("l_partkey") % 5).cast("string")).alias("text"),
    )


OBJ = """
obj AS (
  SELECT l_orderkey AS deck, l_linenumber % 3 AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
    ['text', 'image', 'chart', 'decoration'][(l_partkey % 4 + 1)::int] AS kind, l_discount * 9::double AS x, l_tax * 12::double AS y, l_quantity / 60::double AS w,
    (l_suppkey % 10 + 1) / 20::double AS h, (l_partkey % 30 + 6)::double AS font, 'Title ' || l_returnflag || ' ' || (l_partkey % 5)::varchar AS text FROM lineitem)"""
PAIRS = """
pairs AS (
  SELECT a.deck, a.page, a.kind AS lk, b.kind AS rk,
    greatest(0::double, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0::double, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))
      / greatest(least(greatest(0::double, a.w) * greatest(0::double, a.h), greatest(0::double, b.w) * greatest(0::double, b.h)), 1e-9::double) AS r
  FROM obj a JOIN obj b ON a.deck = b.deck AND a.page = b.page AND a.ord < b.ord WHERE a.w * a.h <= 0.8 AND b.w * b.h <= 0.8),
bad AS (
  SELECT deck, page, count(*) AS n FROM pairs WHERE CASE WHEN lk = 'decoration' OR rk = 'decoration' THEN false WHEN lk = 'text' AND rk = 'text' THEN r > 0.6
    WHEN lk = 'text' OR rk = 'text' THEN false WHEN lk = 'image' AND rk = 'image' THEN r > 0.75 ELSE r > 0.5 END GROUP BY deck, page)"""
OUTSIDE = "(x < -0.005 OR y < -0.005 OR x + w > 1.005 OR y + h > 1.005)"


@query(
    "q11_geometry_overlap",
    f"""WITH {OBJ}, {PAIRS},
per AS (SELECT deck, page, count(*) AS n, count(*) FILTER (WHERE {OUTSIDE}) AS n_out, bool_or({OUTSIDE} AND kind = 'text') AS text_out FROM obj GROUP BY deck, page),
s AS (SELECT deck, page, p.n, n_out, coalesce(b.n, 0) AS n_bad, text_out,
  1::double - least(0.70::double, 2.5::double * n_out / p.n) - least(0.50::double, 1.5::double * coalesce(b.n, 0) / p.n) AS x FROM per p LEFT JOIN bad b USING (deck, page))
SELECT deck, page, n AS n_objects, n_out, n_bad, round(greatest(0::double, least(1::double, x)), 6) AS score,
  CASE WHEN text_out THEN 'CRITICAL' WHEN greatest(0::double, least(1::double, x)) < 0.35 THEN 'MAJOR' WHEN greatest(0::double, least(1::double, x)) < 0.70 THEN 'MINOR' ELSE 'INFO' END AS severity FROM s""",
)
def geometry_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of bounds and defective overlaps of each page."""
    o = objects(spark, sf_dir)
    pairs = G.overlapping_pairs(o)
    bad = pairs.where(G.defective(F.col("left_kind"), F.col("right_kind"), F.col("overlap"))).groupBy("deck", "page").agg(F.count(F.lit(1)).alias("n_bad"))
    out = G.outside()
    per = o.groupBy("deck", "page").agg(
        F.count(F.lit(1)).alias("n_objects"), F.count_if(out).alias("n_out"), F.bool_or(out & (F.col("kind") == "text")).alias("text_out")
    )
    s = per.join(bad, ["deck", "page"], "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0)))
    n = F.col("n_objects")
    score = clamp(lit(1) - F.least(lit(0.70), lit(2.5) * F.col("n_out") / n) - F.least(lit(0.50), lit(1.5) * F.col("n_bad") / n))
    severity = F.when(F.col("text_out"), "CRITICAL").otherwise(severity_band(score))
    return s.select("deck", "page", "n_objects", "n_out", "n_bad", round6(score).alias("score"), severity.alias("severity"))


@query(
    "q12_bounds_and_crop",
    f"""WITH {OBJ}, c AS (
  SELECT *, 1::double - least(0.55::double, 0.8::double * (font / 40::double)) - CASE WHEN w * h < 0.01 OR w / h > 8 OR w / h < 0.125 THEN 0.30::double ELSE 0::double END AS s FROM obj WHERE kind IN ('image', 'chart'))
SELECT deck, page, ord, {OUTSIDE} AS outside, round(greatest(0::double, least(1::double, s)), 6) AS score, round(1::double + least(0.5::double, w * h), 6) AS importance, w * h >= 0.2 AS key_unit FROM c""",
)
def bounds_and_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop risk of each picture, with its importance by area."""
    o = objects(spark, sf_dir).where("kind in ('image', 'chart')")
    area = F.col("w") * F.col("h")
    return o.select(
        "deck", "page", "ord", G.outside().alias("outside"), round6(G.crop_score(F.col("font") / lit(40), F.col("w"), F.col("h"))).alias("score"),
        round6(lit(1) + F.least(lit(0.5), area)).alias("importance"), (area >= 0.2).alias("key_unit"),
    )


@query(
    "q13_title_pick",
    f"WITH {OBJ} SELECT deck, page, ord, text, font FROM obj WHERE y < 0.32 AND length(text) BETWEEN 2 AND 120 QUALIFY row_number() OVER (PARTITION BY deck, page ORDER BY y, font DESC, w DESC, ord) = 1",
)
def title_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each page."""
    return G.titles(objects(spark, sf_dir)).select("deck", "page", "ord", "text", "font")


@query(
    "q14_reading_order",
    f"""WITH {OBJ}, r AS (SELECT deck, page, ord, row_number() OVER (PARTITION BY deck, page ORDER BY round(y, 3), round(x, 3), ord) AS place FROM obj WHERE kind = 'text'),
p AS (SELECT a.deck, a.page, count(*) AS n_pairs, count(*) FILTER (WHERE a.place > b.place) AS n_inversions FROM r a JOIN r b ON a.deck = b.deck AND a.page = b.page AND a.ord < b.ord GROUP BY ALL)
SELECT deck, page, n_pairs, n_inversions, round(1::double - n_inversions / n_pairs, 6) AS score, CASE WHEN 1::double - n_inversions / n_pairs < 0.5 THEN 'MAJOR' ELSE 'INFO' END AS severity FROM p""",
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inversions between file order and visual order."""
    r = G.reading_order(objects(spark, sf_dir).where("kind = 'text'"))
    return r.select("deck", "page", "n_pairs", "n_inversions", round6(F.col("score")).alias("score"), F.when(F.col("score") < 0.5, "MAJOR").otherwise("INFO").alias("severity"))


@query(
    "q15_silhouette_groups",
    f"""WITH {OBJ}, marks AS (SELECT deck AS page, concat_ws(':', kind, round(x * 20)::int, round(y * 20)::int, round(w * 20)::int, round(h * 20)::int) AS mark FROM obj),
sig AS (SELECT o_custkey AS deck, page, array_to_string(list(mark ORDER BY mark), ';') AS signature FROM marks JOIN orders ON page = o_orderkey GROUP BY o_custkey, page),
c AS (SELECT *, count(*) OVER (PARTITION BY deck, signature) AS n_alike, count(*) OVER (PARTITION BY deck) AS n_pages FROM sig)
SELECT deck, any_value(n_pages) AS n_pages, count(DISTINCT signature) AS n_layouts, max(n_alike) AS n_alike, count(*) FILTER (WHERE n_alike >= 3 AND n_alike / n_pages >= 0.12) AS n_flagged FROM c GROUP BY deck""",
)
def silhouette_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts that repeat on a large share of a deck's pages. A customer is a deck and an order a page, with all
    its objects: their kinds and boxes, rounded to twentieths."""
    cell = lambda c: F.round(F.col(c) * 20).cast("int").cast("string")
    mark = F.concat_ws(":", "kind", *map(cell, "xywh"))
    own = objects(spark, sf_dir).groupBy(F.col("deck").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(mark)), ";").alias("signature"))
    decks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("deck"))
    sig = own.join(decks, "page")
    n_pages = F.count(F.lit(1)).over(Window.partitionBy("deck"))
    found = G.silhouettes(sig.withColumn("n_pages", n_pages))
    return found.groupBy("deck").agg(
        F.first("n_pages").alias("n_pages"), F.count_distinct("signature").alias("n_layouts"), F.max("n_alike").alias("n_alike"), F.count_if("flagged").alias("n_flagged")
    )


@query(
    "q56_component_sizes",
    f"""WITH {OBJ}, s AS (SELECT deck, round(w, 1) AS w1, round(h, 1) AS h1, count(*) AS n FROM obj GROUP BY ALL)
SELECT deck, sum(n)::bigint AS n_objects, max(n) AS n_modal FROM s GROUP BY deck""",
)
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest number of objects of one size."""
    s = objects(spark, sf_dir).groupBy("deck", F.round("w", 1).alias("w1"), F.round("h", 1).alias("h1")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("deck").agg(F.sum("n").alias("n_objects"), F.max("n").alias("n_modal"))


@query(
    "q57_typography",
    f"""WITH {OBJ}, t AS (SELECT deck, page, count(*) AS n, count(*) FILTER (WHERE font < 14) AS n_small, min(font) AS least FROM obj WHERE kind = 'text' GROUP BY deck, page)
SELECT deck, page, round(1::double - 0.75::double * n_small / n, 6) AS score, CASE WHEN least < 10 THEN 'CRITICAL' WHEN 1::double - 0.75::double * n_small / n < 0.35 THEN 'MAJOR' WHEN 1::double - 0.75::double * n_small / n < 0.70 THEN 'MINOR' ELSE 'INFO' END AS severity FROM t""",
)
def typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in small type on each page."""
    t = objects(spark, sf_dir).where("kind = 'text'").groupBy("deck", "page").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("font") < 14).alias("n_small"), F.min("font").alias("least")
    )
    score = lit(1) - lit(0.75) * F.col("n_small") / F.col("n")
    return t.select("deck", "page", round6(score).alias("score"), F.when(F.col("least") < 10, "CRITICAL").otherwise(severity_band(score)).alias("severity"))


@query(
    "q58_editability",
    f"""WITH {OBJ}, e AS (SELECT deck, page, count(*) AS n, count(*) FILTER (WHERE kind IN ('text', 'chart')) AS n_native, bool_or(kind = 'image' AND w * h >= 0.2) AS large, count(*) FILTER (WHERE kind IN ('text', 'chart')) = 0 AS none FROM obj WHERE kind <> 'decoration' GROUP BY deck, page)
SELECT deck, page, large AND none AS raster_only, round(CASE WHEN large AND none THEN 0.10::double ELSE 0.55::double + 0.45::double * n_native / n END, 6) AS score FROM e""",
)
def editability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are one large picture, and the share of native objects elsewhere."""
    native = F.col("kind").isin("text", "chart")
    e = objects(spark, sf_dir).where("kind <> 'decoration'").groupBy("deck", "page").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(native).alias("n_native"), F.bool_or((F.col("kind") == "image") & (F.col("w") * F.col("h") >= 0.2)).alias("large")
    )
    raster = F.col("large") & (F.col("n_native") == 0)
    return e.select("deck", "page", raster.alias("raster_only"), round6(F.when(raster, lit(0.10)).otherwise(lit(0.55) + lit(0.45) * F.col("n_native") / F.col("n"))).alias("score"))


@query(
    "q59_title_body_alignment",
    f"""WITH {OBJ}, t AS (SELECT deck, page, ord AS title, x AS tx FROM obj WHERE y < 0.32 QUALIFY row_number() OVER (PARTITION BY deck, page ORDER BY y, font DESC, w DESC, ord) = 1),
b AS (SELECT t.deck, t.page, tx, median(o.x) AS bx, count(o.ord) AS n FROM t LEFT JOIN obj o ON o.deck = t.deck AND o.page = t.page AND o.ord <> t.title GROUP BY ALL)
SELECT deck, page, n AS n_body, round(CASE WHEN n = 0 THEN 0::double ELSE 0.70::double * (1::double - greatest(0::double, least(1::double, abs(tx - bx) / 0.25::double))) + 0.30::double * CASE WHEN n >= 2 THEN 1::double ELSE 0.5::double END END, 6) AS score FROM b""",
)
def title_body_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the body of a page stands off its title."""
    o = objects(spark, sf_dir)
    t = G.titles(o).select("deck", "page", F.col("ord").alias("title"), F.col("x").alias("tx"))
    body = t.join(o.select("deck", "page", "ord", "x"), ["deck", "page"]).where("ord <> title")
    b = body.groupBy("deck", "page").agg(F.median("x").alias("bx"), F.count(F.lit(1)).alias("n"))
    s = t.join(b, ["deck", "page"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    near = lit(1) - clamp(F.abs(F.col("tx") - F.col("bx")) / lit(0.25))
    score = F.when(F.col("n") == 0, lit(0)).otherwise(lit(0.70) * near + lit(0.30) * F.when(F.col("n") >= 2, lit(1)).otherwise(lit(0.5)))
    return s.select("deck", "page", F.col("n").alias("n_body"), round6(score).alias("score"))


@query(
    "q60_style_consistency",
    f"""WITH {OBJ}, t AS (SELECT deck, page, y FROM obj WHERE y < 0.32 QUALIFY row_number() OVER (PARTITION BY deck, page ORDER BY y, font DESC, w DESC, ord) = 1),
v AS (SELECT deck % 500 AS deck, stddev_pop(y) AS sd, count(*) AS n FROM t GROUP BY 1), f AS (SELECT deck % 500 AS deck, count(DISTINCT font) AS fonts FROM obj GROUP BY 1)
SELECT deck, fonts, round(1::double - least(0.45::double, 0.08::double * greatest(0, fonts - 3)) - CASE WHEN n >= 3 THEN least(0.30::double, 2::double * sd) ELSE 0::double END, 5) AS score FROM f JOIN v USING (deck)""",
)
def style_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts in use and the spread of title positions."""
    o = objects(spark, sf_dir)
    group = (F.col("deck") % 500).alias("deck")
    v = G.titles(o).groupBy(group).agg(F.stddev_pop("y").alias("sd"), F.count(F.lit(1)).alias("n"))
    f = o.groupBy(group).agg(F.count_distinct("font").alias("fonts"))
    spread = F.when(F.col("n") >= 3, F.least(lit(0.30), lit(2) * F.col("sd"))).otherwise(lit(0))
    score = lit(1) - F.least(lit(0.45), lit(0.08) * F.greatest(F.lit(0), F.col("fonts") - 3)) - spread
    return f.join(v, "deck").select("deck", "fonts", F.round(score, 5).alias("score"))


@query(
    "q61_effective_resolution",
    f"""WITH {OBJ}, r AS (SELECT deck, page, ord, least((font * 60) / (1600::double * w), (font * 40) / (900::double * h)) AS s, w * h >= 0.2 AS key FROM obj WHERE kind = 'image')
SELECT deck, page, ord, round(greatest(0::double, least(1::double, s)), 6) AS score, CASE WHEN greatest(0::double, least(1::double, s)) < 0.25 THEN 'CRITICAL' WHEN greatest(0::double, least(1::double, s)) < 0.35 THEN 'MAJOR' WHEN greatest(0::double, least(1::double, s)) < 0.70 THEN 'MINOR' ELSE 'INFO' END AS severity, CASE WHEN key THEN 1.5::double ELSE 1::double END AS importance FROM r""",
)
def effective_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a picture against the size it is shown at."""
    o = objects(spark, sf_dir).where("kind = 'image'")
    score = clamp(F.least(F.col("font") * 60 / (lit(1600) * F.col("w")), F.col("font") * 40 / (lit(900) * F.col("h"))))
    key = F.col("w") * F.col("h") >= 0.2
    return o.select("deck", "page", "ord", round6(score).alias("score"), severity_band(score, 0.25).alias("severity"), F.when(key, lit(1.5)).otherwise(lit(1)).alias("importance"))


@query(
    "q48_hierarchical_rollup",
    """WITH s AS (
  SELECT l_orderkey, least(1::double, l_extendedprice * (1 - l_discount) / 100000::double) AS eff, l_quantity AS importance FROM lineitem),
deck AS (SELECT l_orderkey, sum(eff * importance) / sum(importance) AS score, count(*) AS n FROM s GROUP BY l_orderkey)
SELECT r_name, n_name, count(*) AS n_decks, sum(n)::bigint AS n_objects, round(avg(score), 6) AS score
FROM deck JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())""",
)
def hierarchical_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from objects to decks, and from decks to nations, regions and all: lines are summed before any join."""
    t = lambda n: table(spark, sf_dir, n)
    s = t("lineitem").select("l_orderkey", F.least(lit(1), F.col("l_extendedprice") * (1 - F.col("l_discount")) / lit(100000)).alias("eff"), F.col("l_quantity").alias("importance"))
    deck = s.groupBy("l_orderkey").agg((F.sum(F.col("eff") * F.col("importance")) / F.sum("importance")).alias("score"), F.count(F.lit(1)).alias("n"))
    joined = (
        deck.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_decks"), F.sum("n").alias("n_objects"), round6(F.avg("score")).alias("score"))
