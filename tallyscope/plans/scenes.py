"""Queries over `documents` read as decks that were made for a customer from the passage of their case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.scores import lit, steady6
from tallyscope.operators.scenes import CUES, audience_fit, fact_support, render_parity, source_traceability
from tallyscope.plans.documents import CASE_OF, NORM, PAGES, TOKENS, pages, with_cases
from tallyscope.plans.registry import query
from tallyscope.sources.artifacts import rendered_pages
from tallyscope.sources.tables import spread, table, written

PEOPLE = (" board", " engineers", " customers and clients", "")


def audiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deck, text, audience: a deck's audience is the market segment of the customer of its number, and who there reads it."""
    who = F.element_at(F.array(*map(F.lit, PEOPLE)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    name = F.when(F.col("c_nationkey") % 7 != 0, F.concat(F.col("c_mktsegment"), who))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("deck"), name.alias("audience"))
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("deck"), "text"))
    return docs.join(people, "deck", "left")


def _recall(needle: str, need: str, hay: str, held: str) -> str:
    return f"CASE WHEN {needle} <> '' AND contains({hay}, {needle}) THEN 1::double WHEN len({need}) > 0 THEN len(list_intersect({need}, {held}))::double / len({need}) ELSE contains({hay}, {needle})::int::double END"


_NAMED = [" OR ".join(f"contains(lower(audience), '{w}')" for w in words) for words, _ in CUES]
_SOUGHT = " || ".join(f"CASE WHEN {named} THEN {list(cues)} ELSE []::varchar[] END" for named, (_, cues) in zip(_NAMED, CUES, strict=True))


@query(
    "q99_audience_fit",
    f"""WITH p AS (SELECT c_custkey, CASE WHEN c_nationkey % 7 <> 0 THEN c_mktsegment || {list(PEOPLE)}[(c_nationkey % 4 + 1)::int] END AS audience FROM customer),
d AS (SELECT doc_id AS deck, audience, {NORM.format("coalesce(text, '')")} AS hay, {TOKENS.format("text")} AS held, {NORM.format("audience")} AS needle, {TOKENS.format("audience")} AS need, {_SOUGHT} AS sought
  FROM documents LEFT JOIN p ON c_custkey = doc_id),
s AS (SELECT deck, audience, 0.35::double + 0.35::double * ({_recall("needle", "need", "hay", "held")})
  + 0.30::double * CASE WHEN len(sought) > 0 THEN len(list_filter(sought, lambda c: contains(hay, c)))::double / len(sought) ELSE 0.5::double END AS x FROM d)
SELECT deck, CASE WHEN audience IS NULL THEN 'NA' ELSE 'SCORED' END AS status, CASE WHEN audience IS NOT NULL THEN floor(greatest(0::double, least(1::double, x)) * 1000000 + 0.500001::double) / 1000000 END AS score,
  CASE WHEN audience IS NOT NULL THEN 0.62::double END AS confidence FROM s""",
)
def audience_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each deck meets the audience that it was made for."""
    score = audience_fit(F.col("audience"), F.col("text"))
    found = audiences(spark, sf_dir).select("deck", score.alias("raw"))
    told = F.col("raw").isNotNull()
    return found.select("deck", F.when(told, "SCORED").otherwise("NA").alias("status"), steady6(F.col("raw")).alias("score"), F.when(told, lit(0.62)).alias("confidence"))


VERDICT = {"click": "SUPPORTED", "view": "SUPPORTED", "signup": "INSUFFICIENT", "purchase": "CONTRADICTED"}


@query(
    "q100_fact_support",
    rf"""WITH {CASE_OF},
c AS (
  SELECT user_id AS deck, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERDICT.items())} END AS verdict, 0.5::double + (regexp_extract(props, '[0-9]+')::int % 50) / 100::double AS sure FROM events WHERE user_id % 3 = 0),
b AS (
  SELECT deck, count(verdict) AS n, (count(*) FILTER (WHERE verdict = 'SUPPORTED') + 0.25::double * count(*) FILTER (WHERE verdict = 'INSUFFICIENT')) / nullif(count(verdict), 0) AS score, avg(sure) FILTER (WHERE verdict IS NOT NULL) AS sure FROM c GROUP BY deck),
f AS (SELECT item_id, fact FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[\n.!?;。！？；]+')) AS fact FROM benchmark) WHERE trim(fact, ' ') <> ''),
d AS (SELECT doc_id, item_id, {TOKENS.format("text")} AS held, {NORM.format("coalesce(text, '')")} AS hay FROM documents JOIN cased USING (doc_id) WHERE doc_id % 5 <> 0),
r AS (SELECT doc_id AS deck, avg({_recall(NORM.format("fact"), TOKENS.format("fact"), "hay", "held")}) AS score, count(*) AS n FROM d JOIN f USING (item_id) GROUP BY doc_id),
j AS (SELECT doc_id AS deck, b.n AS n_claims, CASE WHEN b.n IS NULL THEN r.score ELSE b.score END AS score, CASE WHEN b.n IS NOT NULL THEN b.sure WHEN r.n IS NOT NULL THEN 0.92::double END AS sure, r.n AS n_facts
  FROM documents LEFT JOIN b ON b.deck = doc_id LEFT JOIN r ON r.deck = doc_id),
o AS (SELECT *, CASE WHEN n_claims = 0 THEN 'NO_MATERIAL_CLAIMS' WHEN n_claims IS NULL AND n_facts IS NULL THEN 'NO_TRUSTED_FACTS' END AS reason FROM j)
SELECT deck, CASE WHEN reason IS NULL THEN 'SCORED' ELSE 'NA' END AS status, reason, floor(score * 1000000 + 0.500001::double) / 1000000 AS score, floor(sure * 1000000 + 0.500001::double) / 1000000 AS confidence,
  coalesce(n_claims, n_facts, 0) AS n_checked FROM o""",
)
def fact_claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of every third user are the checked claims of the deck of that number, an error is none; decks
    without such a bundle are held against the sentences of their passage, one in five has none."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    items = table(spark, sf_dir, "benchmark").where("item_id is not null")
    cased = with_cases(docs.where("doc_id % 5 <> 0").select("doc_id"), items)
    facts = items.select("item_id", F.explode(F.split("text", r"[\n.!?;。！？；]+")).alias("fact"))
    verdict = F.try_element_at(F.create_map(*[F.lit(x) for kv in VERDICT.items() for x in kv]), F.col("event_type"))
    sure = lit(0.5) + (F.get_json_object("props", "$.k").cast("int") % 50) / lit(100)
    claims = table(spark, sf_dir, "events").where("user_id % 3 = 0").select(F.col("user_id").alias("deck"), verdict.alias("verdict"), sure.alias("confidence"))
    own = cased.join(facts, "item_id").select(F.col("doc_id").alias("deck"), "fact")
    found = fact_support(docs.withColumnRenamed("doc_id", "deck"), claims, own)
    return found.withColumns({c: steady6(F.col(c)) for c in ("score", "confidence")})


@query(
    "q101_source_traceability",
    f"""WITH {CASE_OF}, w AS (SELECT item_id, unnest(string_split(text, ' ')[1:4]) AS word, generate_subscripts(string_split(text, ' ')[1:4], 1) AS nth FROM benchmark),
s AS (SELECT item_id, nth, 'file://store/' || item_id || '/' || word AS uri, lower(regexp_extract(regexp_replace('file://store/' || item_id || '/' || word, '/+$', ''), '[^/]*$')) AS label FROM w)
SELECT doc_id AS deck, nth::int AS nth, md5(uri) AS uri_md5, label <> '' AND contains(lower(coalesce(text, '') || chr(10) || coalesce(source, '')), label) AS hit,
  (label <> '' AND contains(lower(coalesce(text, '') || chr(10) || coalesce(source, '')), label))::int::double AS score, 0.88::double AS confidence
FROM documents JOIN cased USING (doc_id) JOIN s USING (item_id)""",
)
def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the sources of its case each deck cites; the files are named after the passage's first words,
    a document's source is its notes."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("notes")))
    items = table(spark, sf_dir, "benchmark").where("item_id is not null")
    words = items.select("item_id", F.posexplode(F.slice(F.split("text", " "), 1, 4)).alias("at", "word"))
    uri = F.concat(F.lit("file://store/"), F.col("item_id").cast("string"), F.lit("/"), F.col("word"))
    own = with_cases(docs.select("doc_id"), items).join(words, "item_id").select(F.col("doc_id").alias("deck"), (F.col("at") + 1).alias("nth"), uri.alias("uri"))
    found = source_traceability(docs.withColumnRenamed("doc_id", "deck"), own)
    return found.select("deck", "nth", F.md5(F.col("uri").cast("binary")).alias("uri_md5"), "hit", "score", "confidence")


@query(
    "q106_render_parity",
    f"""WITH {PAGES}, r AS (SELECT *, doc_id % 4 <> 1 AND chars % 7 <> 3 AS here FROM pg), k AS (SELECT *, bool_or(here) OVER (PARTITION BY doc_id) AS known FROM r)
SELECT doc_id, page, n_pages, importance, CASE WHEN known THEN 'SCORED' ELSE 'NA' END AS status, CASE WHEN known THEN here::int::double END AS score, CASE WHEN known AND NOT here THEN 'CRITICAL' ELSE 'INFO' END AS severity,
  known AND (page = 1 OR page = n_pages) AS key_unit, known AND NOT here AS critical FROM k""",
)
def render_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages of each document were rendered, by the names of the files; some pages and the pages of
    one document in four never were."""
    # written once, as pages are asked for on both sides of each join and their texts are costly to measure
    every = written(pages(spark, sf_dir).select(F.col("doc_id").cast("string").alias("deck"), "page", "n_pages", "importance", "chars", "doc_id"), "pages")
    files = every.where("doc_id % 4 <> 1 and chars % 7 <> 3").select(F.concat("deck", F.lit("/slide-"), F.col("page").cast("string"), F.lit(".png")).alias("path"))
    found = render_parity(every, rendered_pages(files)[0])
    return found.select("doc_id", "page", "n_pages", "importance", "status", "score", "severity", "key_unit", "critical")
