"""Choosing pages and records for attention."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.scores import hash_fraction, lit


def even_places(n: Column, k: int) -> Column:
    """k places of 1..n in even steps, both ends among them; all of them if n <= k."""
    if k < 2:
        return F.array(F.lit(1).cast("long"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("long") + 1)
    return F.when(n <= k, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array_distinct(steps))


def budgeted_sample(pages: DataFrame, k: int) -> DataFrame:
    """The rows of `pages` (deck, page, n_pages, risk: rank among the deck's risky pages or null) within a budget of k:
    up to k - 2 risky pages by rank, then the first and last, then even steps, then page order; one row a page."""
    risky = F.when(F.col("risk") <= max(1, k - 2), F.struct(F.lit(0).alias("tier"), F.col("risk").cast("long").alias("place")))
    ends = F.when(F.col("page") == 1, F.struct(F.lit(1).alias("tier"), F.lit(0).cast("long").alias("place"))).when(
        F.col("page") == F.col("n_pages"), F.struct(F.lit(1).alias("tier"), F.lit(1).cast("long").alias("place"))
    )
    page = F.col("page").cast("long").alias("place")
    even = F.when(F.array_contains(even_places(F.col("n_pages"), k), F.col("page").cast("long")), F.struct(F.lit(2).alias("tier"), page))
    rest = F.struct(F.lit(3).alias("tier"), page)
    ranked = pages.withColumn("best", F.coalesce(risky, ends, even, rest))
    order = Window.partitionBy("deck").orderBy("best", "page")
    return ranked.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def authorship_sample(pages: DataFrame, k: int) -> DataFrame:
    """The rows of `pages` (deck, page, n_pages, score, importance, hits) within a budget of k, with tier and place: the
    first and the last page; up to two risky pages off the even steps; the riskiest page on them; the page on them with
    most hits, if it has any; then the even steps, then the rest by number. One row a page.

    Risky are pages with a score: the lowest first, then the most important, then by the text of `page:` and number. A
    page stands in the first tier that takes it, so what one tier leaves of the budget goes to the next ones.
    """
    name = F.concat(F.lit("page:"), F.col("page").cast("string"))
    even = F.array_contains(even_places(F.col("n_pages"), k), F.col("page").cast("long"))
    end = (F.col("page") == 1) | (F.col("page") == F.col("n_pages"))
    rows = pages.withColumns({"even": even, "end": end, "risky": F.col("score").isNotNull(), "name": name})
    group = Window.partitionBy("deck", "even", "end", "risky")
    risk = (F.col("score"), F.col("importance").desc(), F.col("name"))
    rows = rows.withColumn("nth", F.row_number().over(group.orderBy(*risk)))
    inner = F.col("risky") & ~F.col("end")
    rows = rows.withColumns({"off": inner & ~F.col("even") & (F.col("nth") <= 2), "on": inner & F.col("even") & (F.col("nth") == 1)})
    held = inner & F.col("even") & ~F.col("on") & (F.col("hits") > 0)
    rows = rows.withColumn("held", F.coalesce(held, F.lit(False)))
    most = Window.partitionBy("deck", "held").orderBy(F.col("hits").desc(), *risk)
    rows = rows.withColumn("marked", F.col("held") & (F.row_number().over(most) == 1))
    number = F.col("page").cast("long")
    tier = lambda t, place: F.struct(F.lit(t).alias("tier"), place.cast("long").alias("place"))
    best = (
        F.when(F.col("page") == 1, tier(0, F.lit(0))).when(F.col("end"), tier(0, F.lit(1))).when(F.col("off"), tier(1, F.col("nth"))).when(F.col("on"), tier(2, F.lit(0)))
        .when(F.col("marked"), tier(3, F.lit(0))).when(F.col("even"), tier(4, number)).otherwise(tier(5, number))
    )
    rows = rows.withColumn("best", best)
    first = Window.partitionBy("deck").orderBy("best")
    rows = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k)
    return rows.select(*pages.columns, "best.tier", F.col("rn").alias("place"))


def running_before(rows: DataFrame, key: str, seq: str, value: Column, name: str, ranges: int = 1024) -> DataFrame:
    """`rows` with `name`: the sum of `value` (a whole number) over the rows of the same `key` before it, by `seq` (a
    number; equal ones count in any order).

    A key may hold most rows: rows are dealt into `ranges` of about equal count, whose bounds are quantiles of `seq` over
    all rows, so neither a hot key nor an outlier puts them into one window; offsets come from the sums of the ranges. Rows
    that share one value of `seq` are in one range. A null key is one of its own; a null seq comes first.
    """
    shares = [i / ranges for i in range(1, ranges)]
    spot, place = F.col(seq).cast("double"), "__place"
    bounds = rows.agg(F.percentile_approx(spot, shares, 10 * ranges).alias("x")).first()["x"] or [0.0]  # one less than ranges
    cut = Bucketizer(splits=[-math.inf, *sorted(set(bounds)), math.inf], inputCol="__spot", outputCol=place, handleInvalid="keep")
    placed = cut.transform(rows.withColumn("__spot", spot))
    placed = placed.withColumns({"__at": F.when(F.col("__spot").isNull(), F.lit(-1)).otherwise(F.col(place).cast("int")), "__value": value.cast("long")}).drop("__spot", place)
    sums = placed.groupBy(F.col(key).alias("__key"), F.col("__at").alias("__range")).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    own = Window.partitionBy(key, "__at").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__at") == F.col("__range")))
    total = F.col("__offset") + F.coalesce(F.sum("__value").over(own), F.lit(0))
    return joined.withColumn(name, total).drop("__key", "__at", "__range", "__offset", "__value")


def active_sampling(records: DataFrame, random_share: float = 0.10) -> DataFrame:
    """`records` (record, diversity_key, seq, uncertainty, disagreement, severity, value) with bonus and score: what to
    label first. The bonus of a record is 1 / (1 + records of its key before it)."""
    records = running_before(records, "diversity_key", "seq", F.lit(1), "__before")
    before = F.col("__before")
    score = (
        lit(0.28) * F.col("uncertainty")
        + lit(0.24) * F.col("disagreement")
        + lit(0.22) * F.col("severity")
        + lit(0.16) * F.col("value")
        + lit(0.10) * F.col("bonus")
        + lit(random_share * 0.05) * hash_fraction(F.col("record"))
    )
    return records.withColumn("bonus", lit(1) / (lit(1) + before)).withColumn("score", score).drop("__before")
