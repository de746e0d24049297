"""From findings to a short, ranked list of issues for each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.scores import ladder, severity_rank

PRIORITIES = ("P0", "P1", "P2", "P3")


def merge_issues(raw: DataFrame) -> DataFrame:
    """One issue for each run and family of `raw` (run, family, metric, page, code, priority, severity, source): the
    most urgent priority, the worst severity, what it covers, and how its sources agree."""
    has = lambda s: F.bool_or(F.col("source") == s)
    merged = raw.groupBy("run", "family").agg(
        F.min("priority").alias("priority"),
        F.max(severity_rank(F.col("severity"))).alias("rank"),
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.array_sort(F.collect_set("metric")).alias("metrics"),
        F.array_sort(F.collect_set("code")).alias("codes"),
        F.count(F.lit(1)).alias("n_findings"),
        ladder(
            (has("CONFLICT"), "CONFLICT"),
            (has("RULE") & has("MODEL"), "AGREED"),
            (has("GAP"), "INSUFFICIENT"),
            otherwise="SINGLE_SOURCE",
        ).alias("consensus"),
    )
    return merged.withColumn("focus_pages", F.slice("pages", 1, 6))


def top_issues(issues: DataFrame, budget: int = 8) -> DataFrame:
    """All P0 and P1 issues of a run and, up to `budget` in all, the next ones by priority, severity and family."""
    urgent = F.col("priority").isin("P0", "P1")
    n_urgent = F.count_if(urgent).over(Window.partitionBy("run"))
    order = Window.partitionBy("run", "urgent").orderBy("priority", F.desc("rank"), "family")
    return (
        issues.withColumn("n_urgent", n_urgent)
        .withColumn("urgent", urgent)
        .withColumn("rn", F.row_number().over(order))
        .where(urgent | (F.col("rn") <= F.greatest(F.lit(0), F.lit(budget) - F.col("n_urgent"))))
        .drop("n_urgent", "urgent", "rn")
    )


def task_priority(decision: Column, cover: Column, worst: Column, open_tracks: Column) -> Column:
    return ladder(
        (decision.isin("FAIL", "ERROR") | (worst == "P0"), "P0"),
        ((cover != "FULL") | (decision == "REVIEW") | (worst == "P1"), "P1"),
        (worst.isNotNull() | (open_tracks > 0), "P2"),
        otherwise="P3",
    )


def review_state(verdict: Column) -> Column:
    return ladder((verdict.isNull(), "OPEN"), (verdict == "REQUEST_MORE_EVIDENCE", "NEEDS_EVIDENCE"), otherwise="RESOLVED")


#: The families of issues in order, the family that owns a code, and the order of sources and severities.
FAMILIES = (
    "SYSTEM_INTEGRITY", "DELIVERY_INTEGRITY", "CONTENT_EXPRESSION", "TASK_FIDELITY", "VISUAL_LAYOUT_READABILITY", "VISUAL_COMMUNICATION", "SEQUENCE_SYSTEM", "AUTHORSHIP",
)
OWNER = {
    "COLOR_CONTRAST": "VISUAL_LAYOUT_READABILITY", "TEXT_CUTOFF": "VISUAL_LAYOUT_READABILITY", "ELEMENT_OVERLAP": "VISUAL_LAYOUT_READABILITY",
    "ELEMENT_MISALIGNMENT": "VISUAL_LAYOUT_READABILITY", "SMALL_TEXT": "VISUAL_LAYOUT_READABILITY", "TYPE_LEGIBILITY": "VISUAL_LAYOUT_READABILITY",
    "MIXED_LANGUAGE": "CONTENT_EXPRESSION", "GARBLED_TEXT": "CONTENT_EXPRESSION", "MISSING_TITLE_ANCHOR": "CONTENT_EXPRESSION",
    "MISSING_SOURCE_REFERENCE": "TASK_FIDELITY", "TEMPLATE_ROUTINE": "AUTHORSHIP", "GENERIC_COPY": "AUTHORSHIP",
}
SOURCES = ("SYSTEM", "MODEL", "REDUCER", "RULE")
WORST_FIRST = ("CRITICAL", "MAJOR", "MINOR", "INFO")


def merge_across(raw: DataFrame, concrete: tuple[str, ...], owner: dict[str, str] = OWNER, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """One issue for what several families of a run report alike: the issues of `raw` (run, family, metric, page, code,
    priority, severity, source), those merged whose families have one and the same code, a `concrete` one, and exactly the
    same pages. The columns of merge_issues, and families: those that contributed, in order.

    The owner of a merged issue is the family that owns the code, if it is among those that meet, else the first of them.
    Its priority, severity, metrics and consensus come from the findings of all. Issues with several codes, or another,
    stay as they are. The order of rows decides nothing. A family that isn't in `families` comes last.
    """
    issues = merge_issues(raw)
    code = F.get("codes", F.lit(0))
    meets = (F.size("codes") == 1) & code.isin(*concrete)
    place = lambda f: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, families)), f), F.lit(0)), F.lit(len(families) + 1))
    bucket = F.when(meets, F.concat_ws("|", F.lit("="), code, F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))).otherwise(F.col("family"))
    rows = issues.select("run", "family", bucket.alias("bucket"), F.when(meets, code).alias("code"))
    met = rows.groupBy("run", "bucket").agg(
        F.array_sort(F.collect_set(F.struct(place(F.col("family")).alias("at"), F.col("family").alias("family")))).alias("own"), F.first("code").alias("code")
    )  # as many families as there are
    names = F.transform("own", lambda x: x["family"])
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in owner.items() for x in kv]), F.col("code"))
    elected = F.when(F.array_contains(names, mapped), mapped).otherwise(F.get(names, F.lit(0)))
    met = met.select("run", names.alias("families"), elected.alias("owner"))
    moves = met.select("run", "owner", F.explode("families").alias("family"))
    moved = raw.join(moves, ["run", "family"]).drop("family").withColumnRenamed("owner", "family")
    return merge_issues(moved).join(met.withColumnRenamed("owner", "family"), ["run", "family"])


def rank_evidence(evidence: DataFrame, by: list[str], keep: int, defects: tuple[str, ...] = ()) -> DataFrame:
    """The `keep` first pieces of evidence of each group, with rank: `evidence` has the columns `by`, source, kind, page,
    object, message, severity, confidence, evidence_id, bbox, codes, affected.

    Pieces of one source, kind, page, object and message are one: the worst, surest, then first by id, box and codes
    stands for it, with the codes and affected pages of all. Sources outside the known ones count as RULE; a page below 1
    is none; a piece without codes whose kind is in `defects` has its kind as code. Then they rank by source, severity,
    page (none last), id, kind, object, message, box, codes and affected pages. Spark keeps no more than `keep` rows of a
    group in a task before the shuffle that ranks them; null objects and messages count as empty.
    """
    at = lambda x, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), x), F.lit(0)), F.lit(len(names) + 1)).cast("int")
    source = F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise("RULE")
    page = F.when(F.col("page") > 0, F.col("page").cast("long"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    none = F.array().cast("array<string>")
    codes = F.array_sort(F.array_distinct(F.coalesce("codes", none)))
    codes = F.when((F.size(codes) == 0) & F.col("kind").isin(*defects), F.array("kind")).otherwise(codes)
    clean = evidence.select(
        *by, source.alias("source"), text("kind"), page.alias("page"), text("object"), text("message"), F.coalesce("severity", F.lit("INFO")).alias("severity"), "confidence",
        text("evidence_id"), F.coalesce(F.to_json("bbox"), F.lit("null")).alias("box"), codes.alias("codes"),
        F.filter(F.coalesce("affected", F.array().cast("array<int>")), lambda p: p > 0).cast("array<long>").alias("affected"),
    )
    sure = F.coalesce(-F.col("confidence"), F.lit(1.0))
    choice = F.struct(at(F.col("severity"), WORST_FIRST).alias("worst"), sure.alias("sure"), "evidence_id", "box", "codes", "severity", "confidence")
    key = [*by, "source", "kind", "page", "object", "message"]
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    merged = clean.groupBy(*key).agg(F.min(choice).alias("x"), union("codes").alias("codes"), union("affected").alias("affected"))
    merged = merged.select(*key, "x.worst", "x.severity", "x.confidence", "x.evidence_id", "x.box", "codes", "affected")
    order = Window.partitionBy(*by).orderBy(
        at(F.col("source"), SOURCES), "worst", F.col("page").isNull(), F.col("page").asc_nulls_last(), "evidence_id", "kind", "object", "message", "box", "codes", "affected"
    )
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).drop("worst")


#: The metrics that a family owns, and the words that tell the family of other metrics; the first that fits.
OWNED = {
    "DELIVERY_INTEGRITY": ("v8_functional_integrity", "file_deliverability"),
    "CONTENT_EXPRESSION": ("content_structure", "language_consistency", "compression_richness", "critical_content_visibility"),
    "TASK_FIDELITY": (
        "instruction", "audience", "fact_claim", "internal_data_consistency", "key_point", "numeric", "source_claim", "traceability", "asset_coverage", "asset_presentation",
        "chart_fidelity", "crop_image_integrity", "media_integrity",
    ),
    "VISUAL_LAYOUT_READABILITY": ("composition_craft", "typography_craft"),
    "VISUAL_COMMUNICATION": ("palette_craft", "visual_communication"),
    "SEQUENCE_SYSTEM": ("visual_system_sequence",),
    "AUTHORSHIP": ("authorship_specificity_v2", "authorship_specificity"),
}
TOLD_BY = (
    ("SYSTEM_INTEGRITY", ("harness", "provider", "evidence_integrity")),
    ("AUTHORSHIP", ("author", "specificity")),
    ("SEQUENCE_SYSTEM", ("sequence", "cross_slide", "transition", "duplicate_slide")),
    ("VISUAL_LAYOUT_READABILITY", ("typograph", "readability", "legibility", "contrast", "reading")),
    ("VISUAL_COMMUNICATION", ("imagery", "palette", "visual_communication", "data_visual")),
    ("VISUAL_LAYOUT_READABILITY", ("layout", "composition", "geometry", "crop", "render_integrity")),
    ("TASK_FIDELITY", ("requirement", "instruction", "audience", "source", "claim", "asset", "chart", "numeric", "key_point", "traceability", "media", "task_fidelity")),
    ("CONTENT_EXPRESSION", ("content", "language", "title", "structure", "expression", "compression")),
    ("DELIVERY_INTEGRITY", ("deliver", "functional", "security")),
)
#: What a reason says when evidence is missing, and a phrase that says so by itself.
GAPS, GAP_PHRASE = ("MISSING", "UNCONFIGURED", "UNAVAILABLE", "PROVIDER", "INSUFFICIENT", "ERROR"), "required metric is unresolved"


def semantic_family(metric: Column) -> Column:
    """The family that a metric's issues belong to: its owner, else the first family that a word in its name tells of,
    else that of content. A null metric counts as empty."""
    name = F.lower(F.coalesce(metric, F.lit("")))
    owned = [(name.isin(*metrics), family) for family, metrics in OWNED.items()]
    told = [(name.rlike("|".join(words)), family) for family, words in TOLD_BY]
    return ladder(*owned, *told, otherwise="CONTENT_EXPRESSION")


def evidence_gap(reason: Column) -> Column:
    """Whether a reason says that evidence is missing; a null one doesn't."""
    said = F.coalesce(reason, F.lit(""))
    return F.upper(said).rlike("|".join(GAPS)) | (said == GAP_PHRASE)


def issue_order(priority: Column, severity: Column, pages: Column, issue_id: Column) -> list[Column]:
    """What raw issues are sorted by: priority, severity, first page (none last), id. Null priorities are P3, null
    severities INFO; unknown ones come last."""
    at = lambda x, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), x), F.lit(0)), F.lit(len(names) + 1))
    first = F.coalesce(F.array_min(pages).cast("long"), F.lit(10**9))
    return [at(F.coalesce(priority, F.lit("P3")), PRIORITIES), at(F.coalesce(severity, F.lit("INFO")), WORST_FIRST), first, F.coalesce(issue_id, F.lit(""))]


def issue_details(issues: DataFrame, raw: DataFrame, shown: list[str]) -> DataFrame:
    """`issues` (run, issue_id, raw_ids) with raw (array of structs of raw_id and `shown`) and n_raw: the raw issues
    (`raw`: run, raw_id and others) of each in the order of its raw_ids; ids that stand for none are left out."""
    named = issues.select("run", "issue_id", F.posexplode("raw_ids").alias("nth", "raw_id"))
    found = named.join(raw.select("run", "raw_id", *shown), ["run", "raw_id"])
    held = found.groupBy("run", "issue_id").agg(F.array_sort(F.collect_list(F.struct("nth", "raw_id", *shown))).alias("raw"))
    parts = lambda x: F.struct(*[x[c].alias(c) for c in ("raw_id", *shown)])
    every = issues.join(held, ["run", "issue_id"], "left")
    return every.withColumn("raw", F.coalesce(F.transform("raw", parts), F.array())).withColumn("n_raw", F.size("raw"))
