"""Observers of decks that were made from a request or a source: audience, facts, traceability.

Each keeps one row for a deck and brings the few facts, claims or sources of it along as an array, so a text isn't
repeated for each of them; what is derived from the text is bound once and held against every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scores import clamp, lit
from tallyscope.functions.text import normalize_text, recall_of, tokens, tokens_if_any

#: By what an audience is named, and what such an audience looks for.
CUES = (
    (("领导", "高管", "管理", "executive", "board"), ("结论", "价值", "风险", "决策", "roi", "recommendation")),
    (("技术", "研发", "工程", "technical", "engineer"), ("架构", "实现", "接口", "性能", "architecture", "api")),
    (("客户", "用户", "customer", "client"), ("价值", "收益", "案例", "方案", "benefit", "solution")),
)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mean(scores: Column) -> Column:
    return F.aggregate(scores, lit(0), lambda a, s: a + s) / F.size(scores)


def audience_fit(audience: Column, text: Column) -> Column:
    """How well a deck's text meets its audience: .35, .35 of the recall of the audience's name, .30 of the share of the
    cues that such an audience looks for (half without any). Null without an audience."""
    name, shown = F.trim(F.coalesce(audience, F.lit(""))), F.coalesce(text, F.lit(""))
    low = F.lower(name)

    def named(words: tuple[str, ...]) -> Column:
        said = F.lit(False)
        for w in words:
            said = said | F.contains(low, F.lit(w))
        return said

    sought = F.concat(*[F.when(named(words), F.array(*map(F.lit, cues))).otherwise(F.array().cast("array<string>")) for words, cues in CUES])
    found = lambda hay: F.transform(sought, lambda cue: F.contains(hay, cue).cast("double"))
    share = lambda hay: F.when(F.size(sought) > 0, _mean(found(hay))).otherwise(lit(0.5))
    # the text is normalised once, and taken apart only where a word of the name may be one of its tokens
    recalled = lambda need, hay: recall_of(normalize_text(name), need, hay, tokens_if_any(need, shown))
    fit = lambda need: _once(normalize_text(shown), lambda hay: lit(0.35) + lit(0.35) * recalled(need, hay) + lit(0.30) * share(hay))
    return F.when(name != "", _once(_once(tokens(name), fit), clamp))


def fact_support(decks: DataFrame, claims: DataFrame, facts: DataFrame) -> DataFrame:
    """deck, status, reason, score, confidence, n_checked for each of `decks` (deck, text).

    A deck with `claims` (deck, verdict, confidence) has the share of its supported claims, and a quarter for those that
    are neither supported nor contradicted; a null verdict says that its bundle was there and held no claim. Other decks
    have the mean recall of their `facts` (deck, fact; blank ones don't count) in their text. The rest is NA.
    """
    of = lambda v: F.count_if(F.col("verdict") == v)
    n = F.count("verdict")
    bundles = claims.groupBy("deck").agg(
        n.alias("n_claims"),
        F.try_divide(of("SUPPORTED") + lit(0.25) * (n - of("SUPPORTED") - of("CONTRADICTED")), n).alias("claimed"),
        F.avg(F.when(F.col("verdict").isNotNull(), F.col("confidence"))).alias("sure"),
    )
    supplied = facts.where(F.trim("fact") != "").groupBy("deck").agg(F.array_sort(F.collect_list("fact")).alias("facts"))
    every = decks.join(bundles, "deck", "left").join(supplied, "deck", "left")
    told = lambda hay: F.transform("facts", lambda f: recall_of(normalize_text(f), tokens(f), hay["text"], hay["tokens"]))
    text = F.coalesce("text", F.lit(""))
    recalled = _once(F.struct(normalize_text(text).alias("text"), tokens(text).alias("tokens")), lambda hay: _mean(told(hay)))
    bundled = F.col("n_claims").isNotNull()
    reason = F.when(F.col("n_claims") == 0, "NO_MATERIAL_CLAIMS").when(~bundled & F.col("facts").isNull(), "NO_TRUSTED_FACTS")
    scored = every.select(
        "deck", reason.alias("reason"), F.when(bundled, F.col("claimed")).when(F.col("facts").isNotNull(), recalled).alias("score"),
        F.when(bundled, F.col("sure")).when(F.col("facts").isNotNull(), lit(0.92)).alias("confidence"),
        F.coalesce(F.when(bundled, F.col("n_claims")).otherwise(F.array_size("facts").cast("long")), F.lit(0)).alias("n_checked"),
    )
    return scored.select("deck", F.when(F.col("reason").isNull(), "SCORED").otherwise("NA").alias("status"), "reason", "score", "confidence", "n_checked")


def source_traceability(decks: DataFrame, sources: DataFrame) -> DataFrame:
    """deck, nth, uri, label, hit, score, confidence for each source of `sources` (deck, nth, uri): whether its file name
    stands in the text or the notes of the deck (`decks`: deck, text, notes). A source without a name is no hit; sources
    of a deck that isn't there are left out."""
    own = sources.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("nth", "uri"))).alias("own"))
    cited = F.lower(F.concat_ws("\n", F.coalesce("text", F.lit("")), F.coalesce("notes", F.lit(""))))
    label = lambda uri: F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(uri, F.lit("")), "/+$", ""), "[^/]*$", 0))
    seen = lambda hay: F.transform("own", lambda s: F.struct(
        s["nth"].alias("nth"), s["uri"].alias("uri"), label(s["uri"]).alias("label"), ((label(s["uri"]) != "") & F.contains(hay, label(s["uri"]))).alias("hit")
    ))
    rows = decks.join(own, "deck").select("deck", F.inline(_once(cited, seen)))
    return rows.withColumns({"score": F.col("hit").cast("double"), "confidence": lit(0.88)})


def render_parity(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """`pages` (deck, page, n_pages and others) with status, score, severity, key_unit, critical: whether each page is
    among the `rendered` ones (deck, page; repeats count once). A page that isn't is critical; of a deck without any
    rendered page every page is NA. Rendered pages of no deck are left out, pages that a deck doesn't have prove nothing
    but that it was rendered."""
    own = rendered.select("deck", "page").distinct()
    some = own.select("deck").distinct().withColumn("_some", F.lit(True))
    every = pages.join(own.withColumn("_here", F.lit(True)), ["deck", "page"], "left").join(some, "deck", "left")
    here, known = F.coalesce("_here", F.lit(False)), F.col("_some").isNotNull()
    return every.withColumns({
        "status": F.when(known, "SCORED").otherwise("NA"), "score": F.when(known, here.cast("double")), "severity": F.when(known & ~here, "CRITICAL").otherwise("INFO"),
        "key_unit": known & ((F.col("page") == 1) | (F.col("page") == F.col("n_pages"))), "critical": known & ~here,
    }).drop("_here", "_some")
