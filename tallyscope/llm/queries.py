"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.ball_kmeans import ball_kmeans
from tallyscope.llm.decontaminate import find_passages
from tallyscope.llm.digest_index import dedup_once
from tallyscope.llm.langid import identify
from tallyscope.llm.line_dedup import drop_site_boilerplate
from tallyscope.llm.lm_score import score_documents
from tallyscope.llm.mixing import curriculum_mix, in_training_order
from tallyscope.llm.ngram_join import jaccard_components
from tallyscope.llm.pii import KINDS, find_personal_data
from tallyscope.llm.ranked_search import ranked_search
from tallyscope.llm.sharding import assign_shards
from tallyscope.llm.sql import SQL  # noqa: F401
from tallyscope.llm.toxicity import score_toxicity
from tallyscope.llm.url_filters import Rule, filter_urls
from tallyscope.sources.tables import table

RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: host, path, rule and verdict of every page."""
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: the text of every page without its site's boilerplate lines; what follows an unclosed script is read too."""
    return drop_site_boilerplate(table(spark, sf_dir, "pages"), hide_unclosed=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: the passages of `benchmark` that stand in a document, with their places."""
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: numbers and spans of personal data in every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    order = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    merged = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(order(x).alias("at"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return found.select(
        "doc_id", *map(number, KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(merged).alias("spans"),
        F.size(merged).cast("long").alias("n_spans"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: the component of similar documents of every document."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: losses of every document under a model of good documents and one of all."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_documents(table(spark, sf_dir, "documents"), good)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: the predicted language of every document."""
    return identify(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: how much of every document the mix takes, and when."""
    mix = in_training_order(curriculum_mix(table(spark, sf_dir, "documents")))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "position")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: of every document the one that stays of its equals."""
    return dedup_once(table(spark, sf_dir, "documents")).drop("mark")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: a calibrated toxicity score of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: the 20 best documents for every item of `benchmark`."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tier")


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: the cluster of every vector."""
    return ball_kmeans(table(spark, sf_dir, "embeddings")).drop("compared")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: shard and slot of every document."""
    return assign_shards(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_ngram_join": op5_ngram_join,
    "op6_lm_score": op6_lm_score,
    "op7_language_id": op7_language_id,
    "op8_source_mix": op8_source_mix,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_sharding": op13_sharding,
    "pipeline": pipeline,
}
