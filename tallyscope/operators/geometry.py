"""Measures of placed objects: overlap, bounds, crops, titles, reading order, repeated layouts.

Objects have deck, page, ord (place in the page), x, y, w, h (as shares of the page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.scores import clamp, lit

LARGEST = 0.80


def overlap_ratio(a: str, b: str) -> Column:
    """Area that two boxes share over the smaller one's."""
    c = lambda t, n: F.col(f"{t}.{n}")
    side = lambda p, s: F.greatest(
        lit(0), F.least(c(a, p) + c(a, s), c(b, p) + c(b, s)) - F.greatest(c(a, p), c(b, p))
    )
    area = lambda t: F.greatest(lit(0), c(t, "w")) * F.greatest(lit(0), c(t, "h"))
    return side("x", "w") * side("y", "h") / F.greatest(F.least(area(a), area(b)), lit(1e-9))


def overlapping_pairs(objects: DataFrame) -> DataFrame:
    """deck, page, left_ord, right_ord, overlap of the pairs of a page, neither object filling it. A page's objects are
    few; the join is on the page with the order of the pair as a residual."""
    small = objects.where(F.col("w") * F.col("h") <= LARGEST)
    a, b = small.alias("a"), small.alias("b")
    on = (F.col("a.deck") == F.col("b.deck")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.ord") < F.col("b.ord"))
    return a.join(b, on).select(
        F.col("a.deck").alias("deck"), F.col("a.page").alias("page"), F.col("a.ord").alias("left_ord"),
        F.col("b.ord").alias("right_ord"), F.col("a.kind").alias("left_kind"), F.col("b.kind").alias("right_kind"),
        overlap_ratio("a", "b").alias("overlap"),
    )


def defective(left_kind: Column, right_kind: Column, overlap: Column) -> Column:
    """Whether an overlap is a defect, by the kinds of the pair: both text over .60, one text never, both media over
    .75, others over .50; decorations never."""
    either = lambda k: (left_kind == k) | (right_kind == k)
    both = lambda k: (left_kind == k) & (right_kind == k)
    return (
        F.when(either("decoration"), F.lit(False))
        .when(both("text"), overlap > 0.60)
        .when(either("text"), F.lit(False))
        .when(both("image"), overlap > 0.75)
        .otherwise(overlap > 0.50)
    )


def outside(tolerance: float = 0.005) -> Column:
    x, y, w, h = map(F.col, ("x", "y", "w", "h"))
    return (x < -tolerance) | (y < -tolerance) | (x + w > 1 + tolerance) | (y + h > 1 + tolerance)


def crop_score(crop: Column, w: Column, h: Column) -> Column:
    """1 less .8 of the crop (.55 at most), less .30 for a tiny or very long picture."""
    aspect = F.try_divide(w, h)
    odd = (w * h < 0.01) | (aspect > 8) | (aspect < 0.125)
    return clamp(lit(1) - F.least(lit(0.55), lit(0.8) * crop) - F.when(odd, lit(0.30)).otherwise(lit(0)))


def titles(objects: DataFrame) -> DataFrame:
    """The title of each page: of the texts of 2 to 120 characters in its upper third the topmost, then the largest
    font, then the widest, then the first."""
    fits = (F.col("y") < 0.32) & F.length("text").between(2, 120)
    order = Window.partitionBy("deck", "page").orderBy("y", F.desc("font"), F.desc("w"), "ord")
    return objects.where(fits).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def reading_order(objects: DataFrame) -> DataFrame:
    """deck, page, n_objects, n_inversions, score: pairs whose order in the file differs from that on the page (by y,
    then x, to three places)."""
    visual = Window.partitionBy("deck", "page").orderBy(F.round("y", 3), F.round("x", 3), "ord")
    ranked = objects.withColumn("place", F.row_number().over(visual)).select("deck", "page", "ord", "place")
    a, b = ranked.alias("a"), ranked.alias("b")
    on = (F.col("a.deck") == F.col("b.deck")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.ord") < F.col("b.ord"))
    pairs = a.join(b, on).groupBy(F.col("a.deck").alias("deck"), F.col("a.page").alias("page")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("a.place") > F.col("b.place")).alias("n_inversions")
    )
    return pairs.select("deck", "page", "n_pairs", "n_inversions", (lit(1) - F.col("n_inversions") / F.col("n_pairs")).alias("score"))


def silhouettes(pages: DataFrame, least_pages: int = 3, least_share: float = 0.12) -> DataFrame:
    """`pages` (deck, page, signature) with n_alike (pages of the deck with the signature) and flagged."""
    alike = F.count(F.lit(1)).over(Window.partitionBy("deck", "signature"))
    all_ = F.count(F.lit(1)).over(Window.partitionBy("deck"))
    return pages.withColumn("n_alike", alike).withColumn(
        "flagged", (F.col("n_alike") >= least_pages) & (F.col("n_alike") / all_ >= least_share)
    )
