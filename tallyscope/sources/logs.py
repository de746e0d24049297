"""JSON sources with fixed schemas, and idempotent sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "case_id string, scene string, pptx_path string, request string, audience string, source_materials array<string>, assets array<string>, metadata map<string,string>"
REVIEWS = "review_id string, run_id string, reviewer_id string, verdict string, target_decision string, created_at string, fingerprint string"
AUDIT = "seq long, event_id string, run_id string, event_type string, occurred_at string, actor string, payload string, previous_hash string, event_hash string"
FEEDBACK = "feedback_id string, run_id string, case_id string, accepted boolean, uncertainty double, disagreement double, severity double, value double, diversity_key string"
CLAIMS = "bundle_id string, claims array<struct<claim_id:string,claim:string,verdict:string,confidence:double,sources:array<string>>>"
SCHEMAS = {"cases": CASES, "reviews": REVIEWS, "audit": AUDIT, "feedback": FEEDBACK, "claims": CLAIMS}
SCENES = {"ready-made": "READY_MADE", "ready_made": "READY_MADE", "text": "TEXT", "summary": "SUMMARY", "multimodal": "MULTIMODAL"}


def read_records(spark: SparkSession, kind: str, path: str, lines: bool = True) -> DataFrame:
    """Records of a kind in SCHEMAS, one JSON object a line (or a file); what doesn't parse is kept in _corrupt."""
    schema = SCHEMAS[kind] + ", _corrupt string"
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", not lines)
    return read.json(path)


def split_valid(records: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): a record needs all of `required` and must have parsed."""
    whole = F.col("_corrupt").isNull()
    for c in required:
        whole = whole & F.col(c).isNotNull()
    return records.where(whole).drop("_corrupt"), records.where(~whole)


def claim_support(bundles: DataFrame) -> DataFrame:
    """bundle_id, n_claims, score, confidence: supported claims count 1, undecided ones a quarter."""
    c = bundles.select("bundle_id", F.explode("claims").alias("c"))
    worth = F.when(F.col("c.verdict") == "SUPPORTED", 1.0).when(F.col("c.verdict") == "INSUFFICIENT", 0.25).otherwise(0.0)
    return c.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_claims"), F.avg(worth).alias("score"), F.avg("c.confidence").alias("confidence"))


def save_reports(reports: DataFrame, path: str, partition: str = "run_date") -> None:
    """Reports by date; a rerun replaces the dates it writes and no others."""
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def store_contents(spark: SparkSession, contents: DataFrame, path: str) -> DataFrame:
    """Append the rows of `contents` (content: binary or string) whose digest isn't stored yet, in folders by its first
    two digits; the digests of all of `contents`, with whether each was new."""
    rows = contents.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).dropDuplicates(["sha256"])
    rows = rows.withColumn("prefix", F.substring("sha256", 1, 2))
    try:
        held = spark.read.parquet(path).select("sha256")
    except Exception as missing:  # the first append finds no store
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        held = rows.select("sha256").limit(0)
    fresh = rows.join(held, "sha256", "left_anti")
    told = rows.select("sha256").join(held.withColumn("old", F.lit(True)), "sha256", "left").select("sha256", F.col("old").isNull().alias("is_new"))
    told = told.checkpoint()
    fresh.write.mode("append").partitionBy("prefix").parquet(path)
    return told
