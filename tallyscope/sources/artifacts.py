"""Runs, their observations and their profiles, stored so that a reader can tell whether they are whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields that a profile must have, those of an earlier form, the version that is read, the scenes and
#: their other names.
PROFILE_FIELDS = (
    "profile_id", "version", "base_weights", "scene_weights", "base_multiplier_metric_ids", "scene_multiplier_metric_ids", "required_metric_ids", "pipeline_nodes",
)
LEGACY_FIELDS = ("required_oracles", "optional_oracles")
PROFILE_VERSION = "8.3"
SCENES = ("text_to_ppt", "project_summary", "multimodal", "ready_made")
SCENE_ALIASES = {"text_generation": "text_to_ppt", "multimodal_generation": "multimodal", "finished_deck": "ready_made"}
#: The parts that the digest of a run is put together from, so that no run's rows meet in one place.
PARTS = 256


def row_digest(columns: list[str]) -> Column:
    """The SHA-256 of a row's values: each is preceded by its length, so that neither nulls nor separators can be taken for
    something else."""
    text = lambda c: F.col(c).cast("string")
    part = lambda c: F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-"))
    return F.sha2(F.concat_ws(",", *[part(c) for c in columns]), 256)


def seal(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """`by`, n_rows, sha256 of each group's rows: a manifest. The order of rows doesn't count, repeated rows do.

    The digests of rows are summed up in parts by their first byte, then over the parts, so the rows of a hot group are
    spread over PARTS places, each holding 64 characters a row."""
    each = rows.select(by, row_digest(columns).alias("digest"))
    part = each.groupBy(by, F.substring("digest", 1, 2).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest")
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda p: F.concat(p["part"], p["digest"]))
    return part.groupBy(by).agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(parts, ""), 256).alias("sha256"))


def verify(rows: DataFrame, manifest: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """`by`, n_rows, status of every group that is in `rows` or in `manifest`: VERIFIED, CHANGED, MISSING (named, but not
    there) or UNNAMED (there, but not named). A null group is one like any other."""
    held = seal(rows, by, columns).select(F.col(by).alias("_held"), F.col("n_rows").alias("_n"), F.col("sha256").alias("_sha256"), F.lit(True).alias("_there"))
    named = manifest.select(by, "n_rows", "sha256").withColumn("_named", F.lit(True))
    both = named.join(held, named[by].eqNullSafe(held["_held"]), "full")
    whole = (F.col("n_rows") == F.col("_n")) & (F.col("sha256") == F.col("_sha256"))
    status = F.when(F.col("_named").isNull(), "UNNAMED").when(F.col("_there").isNull(), "MISSING").when(whole, "VERIFIED").otherwise("CHANGED")
    return both.select(F.coalesce(by, "_held").alias(by), F.coalesce("_n", F.lit(0)).alias("n_rows"), status.alias("status"))


def save_observations(rows: DataFrame, by: str, path: str) -> DataFrame:
    """Write the observations of runs and then their manifest; the manifest as written. A write that dies before its
    manifest leaves observations that `load_observations` reports as UNNAMED and doesn't return."""
    rows.write.mode("errorifexists").parquet(f"{path}/observations")
    stored = rows.sparkSession.read.parquet(f"{path}/observations")
    seal(stored, by, stored.columns).write.mode("errorifexists").parquet(f"{path}/manifest")
    return rows.sparkSession.read.parquet(f"{path}/manifest")


def load_observations(spark: SparkSession, by: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(observations of the runs that are verified, the status of each run)."""
    rows = spark.read.parquet(f"{path}/observations")
    try:
        manifest = spark.read.parquet(f"{path}/manifest")
    except Exception as missing:  # a write that died before its manifest
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        manifest = rows.select(by, F.lit(0).cast("long").alias("n_rows"), F.lit("").alias("sha256")).limit(0)
    status = verify(rows, manifest, by, rows.columns)
    sound = status.where("status = 'VERIFIED'").select(F.col(by).alias("_sound"))
    return rows.join(sound, rows[by].eqNullSafe(sound["_sound"]), "left_semi"), status


def save_batch(reports: DataFrame, path: str, batch: str) -> None:
    """The reports of a batch as JSON lines in the folder of its name; a rerun replaces that batch and no other."""
    reports.write.mode("overwrite").json(f"{path}/{batch}")


def list_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored reports (JSON, one object a file) with file and stored_at: newest first, then by name. A file that is no
    JSON has its text in _corrupt."""
    read = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True)
    found = read.json(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("stored_at"))
    return found.orderBy(F.desc("stored_at"), "file")


def rendered_pages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deck, page, path of every rendered page; files that are none, with the reason): `files` has path, such as that of
    binaryFile. The deck is the folder; the page the last number of the name. A page that several files claim goes to
    none of them."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    number = F.regexp_extract(name, r"([0-9]+)[^0-9]*\.(?i:png|jpe?g|webp)$", 1)
    page = F.nullif(number, F.lit("")).try_cast("int")
    known = files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("deck"), page.alias("page"))
    claims = known.where("page is not null").groupBy("deck", "page").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    rendered = claims.where("page >= 1 and n = 1").select("deck", "page", "path")
    told = known.join(claims.drop("path"), ["deck", "page"], "left")
    reason = F.when(F.col("n").isNull(), "no page number").when(F.col("page") < 1, "page below 1").when(F.col("n") > 1, "page named twice")
    return rendered, told.withColumn("reason", reason).where("reason is not null").select("path", "deck", "page", "reason")


def scan_profiles(files: DataFrame) -> DataFrame:
    """One row for each profile of `files` (path, content: JSON text): profile_id, scene, version, weights (map of metric
    to weight, base and scene together), required (array), and breaches, an array that is empty for a valid one.

    Text that is no JSON object has the one breach that says so. Unknown fields are let through; a metric that both weight
    tables name has its scene weight.
    """
    fields = F.from_json("content", "map<string,string>")
    has = lambda k: F.coalesce(F.map_contains_key("fields", F.lit(k)), F.lit(False))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    rows = files.select("path", F.when(F.trim(F.coalesce("content", F.lit(""))).startswith("{"), fields).alias("fields"))
    scene = F.lower(F.trim(F.coalesce(F.nullif(field("scene"), F.lit("")), field("scenario"), F.lit(""))))
    scene = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCENE_ALIASES.items() for x in kv]), scene), scene)
    rules = [(~has(k), f"{k}: missing") for k in PROFILE_FIELDS] + [(has(k), f"{k}: of an earlier form") for k in LEGACY_FIELDS]
    rules += [(~scene.isin(*SCENES), "scene: unknown"), (has("version") & ~(F.coalesce(field("version"), F.lit("")) == PROFILE_VERSION), "version: not read")]
    listed = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in rules]))
    table = lambda k: F.coalesce(F.from_json(field(k), "map<string,double>"), F.create_map().cast("map<string,double>"))
    base = F.map_filter(table("base_weights"), lambda k, _: ~F.map_contains_key(table("scene_weights"), k))
    found = rows.select(
        "path", field("profile_id").alias("profile_id"), scene.alias("scene"), field("version").alias("version"), F.map_concat(base, table("scene_weights")).alias("weights"),
        F.coalesce(F.from_json(field("required_metric_ids"), "array<string>"), F.array().cast("array<string>")).alias("required"),
        F.when(F.col("fields").isNull(), F.array(F.lit("no JSON object"))).otherwise(listed).alias("breaches"),
    )
    return found.withColumn("valid", F.size("breaches") == 0)
