"""Queries over `pages` and `embeddings`: markup scans, asset matches, similarity groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.plans.registry import query
from tallyscope.sources.tables import table


@query(
    "q46_markup_scan",
    r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
SELECT lower(tag) AS tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t GROUP BY lower(tag)""",
)
def markup_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of all pages."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    per = table(spark, sf_dir, "pages").select("page_id", F.explode(tags).alias("tag")).groupBy(F.lower("tag").alias("tag"), "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("tag").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_pages"))


@query(
    "q50_asset_or_match",
    """WITH a AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, lower(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1)) AS base FROM pages),
asset AS (SELECT page_id AS asset, digest, base FROM a WHERE page_id % 5 = 0), media AS (SELECT page_id AS media, digest, base FROM a WHERE page_id % 5 <> 0),
hits AS (SELECT asset, media, 0 AS how FROM asset JOIN media USING (digest) UNION ALL SELECT asset, media, 1 FROM asset JOIN media USING (base) WHERE base <> '')
SELECT s.asset, min(media) AS media, min(media) IS NOT NULL AS present FROM asset s LEFT JOIN hits h ON s.asset = h.asset GROUP BY s.asset""",
)
def asset_or_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first media object with an asset's digest or base name: two equi-joins, not one OR."""
    base = F.lower(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1))
    a = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), base.alias("base"))
    asset = a.where("page_id % 5 = 0").withColumnRenamed("page_id", "asset")
    media = a.where("page_id % 5 <> 0").withColumnRenamed("page_id", "media")
    hits = asset.join(media.drop("base"), "digest").select("asset", "media").unionByName(asset.where("base <> ''").join(media.drop("digest"), "base").select("asset", "media"))
    first = hits.groupBy("asset").agg(F.min("media").alias("media"))
    return asset.select("asset").join(first, "asset", "left").select("asset", "media", F.col("media").isNotNull().alias("present"))


@query(
    "q63_external_links",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT page_id, count(*) AS n_links, count(*) FILTER (WHERE contains(target, '://')) AS n_external, CASE WHEN count(*) FILTER (WHERE contains(target, '://')) > 0 THEN 'WARN' ELSE 'OK' END AS finding FROM l GROUP BY page_id""",
)
def external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that leave the page's package; they are counted, never followed."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    out = F.size(F.filter("links", lambda x: x.contains("://")))
    p = table(spark, sf_dir, "pages").select("page_id", found.alias("links")).where(F.size("links") > 0)
    return p.select("page_id", F.size("links").cast("long").alias("n_links"), out.cast("long").alias("n_external"), F.when(out > 0, "WARN").otherwise("OK").alias("finding"))


@query(
    "q64_allowed_hosts",
    r"""WITH h AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages), a(domain) AS (VALUES ('example.com'), ('example.net'))
SELECT h.host, count(*) AS n, bool_or(domain IS NOT NULL) AS allowed FROM h LEFT JOIN a ON h.host = domain OR ends_with(h.host, '.' || domain) GROUP BY h.host""",
)
def allowed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts by an allow-list of domains."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    fits = F.lit(False)
    for d in ("example.com", "example.net"):
        fits = fits | (F.col("host") == d) | F.col("host").endswith("." + d)
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", fits)


@query(
    "q65_media_hash_set",
    """SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def media_hash_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that are stored more than once, by digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("n_sources")).where("n > 1")


@query(
    "q66_label_centroids",
    """WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT label, i AS dimension, round(avg(v::double), 6) AS mean, round(min(v::double), 6) AS low, round(max(v::double), 6) AS high FROM e GROUP BY label, i""",
)
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, by dimension."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    return e.groupBy("label", (F.col("pos") + 1).cast("long").alias("dimension")).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"))
