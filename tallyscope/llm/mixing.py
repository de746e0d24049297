"""Mixing sources to target weights with a time-varying curriculum.

Each source has a token target and a weight schedule over the training run (time 0 to 1, linear between equally spaced
knots). The integral of its schedule, scaled to its target, is the source's cumulative demand. A source offers its
documents in a fixed pseudo-random order, again from the start for a second pass; inverting the demand at the offset
where a document begins gives its training position, and a range sort by position is the training order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import materialize, word_count

#: Weights of the sources in code-point order, repeating, and their schedules, repeating alike: heavy sources early,
#: light ones late.
WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def source_targets(
    sized: DataFrame, weights: Sequence[float], total_ratio: float, max_epochs: float
) -> DataFrame:
    """source, rank, weight, source_size, target: one row for each source of `sized` (source, size).

    The demand total_ratio * (all sizes) is shared by weight; a target stops at max_epochs * source_size and the
    excess is reshared by weight until none is above. That fixed point is found at once: ordered by cap / weight, a
    source is capped as long as the level that would serve the rest evenly reaches its own ratio. Works on a table of
    one row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("rank", rank).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    every, order = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(total_ratio)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight)
    free = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))
    per = per.withColumn("level_all", F.min(free).over(every)["level"])
    capped = F.col("level_all").isNull() | (F.col("ratio") <= F.col("level_all"))
    target = F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.col("level_all"))
    return per.select("source", "rank", "weight", "source_size", target.alias("target"))


def _demand(schedules: Sequence[Sequence[float]], rank: Column) -> tuple[Column, Column]:
    """Arrays of a source: its normalised schedule at the knots and the integral up to each knot (0 to 1)."""
    levels, sums = [], []
    for knots in schedules:
        if len(knots) < 2 or min(knots) < 0 or max(knots) <= 0:
            raise ValueError("a schedule needs two knots at least, none negative and one positive")
        step, area = 1.0 / (len(knots) - 1), [0.0]
        for a, b in zip(knots, knots[1:], strict=False):
            area.append(area[-1] + step * (a + b) / 2)
        levels.append([k / area[-1] for k in knots])
        sums.append([x / area[-1] for x in area])
    pick = (rank % len(schedules) + 1).cast("int")
    table = lambda rows: F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in rows]), pick)
    return table(levels), table(sums)


def _time(share: Column, levels: Column, sums: Column) -> Column:
    """The time in 0 to 1 at which a source's demand has come to `share` (0 to 1) of its target."""
    segments = F.size(sums) - 1
    k = F.least(F.size(F.filter(F.slice(sums, 2, F.size(sums)), lambda x: x <= share)), segments - 1)
    step = F.lit(1.0) / segments
    a, b = F.get(levels, k), F.get(levels, k + 1)
    rest = F.greatest(share - F.get(sums, k), F.lit(0.0))
    root = F.sqrt(F.greatest(a * a + F.lit(2.0) * (b - a) / step * rest, F.lit(0.0)))
    within = F.when(rest <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (a + root))
    return F.least(k * step + within, F.lit(1.0))


def curriculum_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    total_ratio: float = 1.5,
    max_epochs: int = 2,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, positions for every row of `docs` (doc_id, text,
    source), unsorted.

    A copy of a document is taken if its middle lies within its source's target, so a source's words miss the target
    by half a document at most. `positions` has the training position (0 to 1) of each copy taken. The order within a
    source is that of md5(doc_id), so reruns agree; repeated rows are documents of their own. A null text has size 0;
    a null source is a source of its own, the last; an empty table gives an empty result. Other columns are ignored.

    Offsets come from sums by bucket of the md5, with about as many buckets as documents in each: no source is ever
    gathered in one task.
    """
    sized = materialize(
        docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size")), "sizes"
    ).withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    digits = max(1, round(math.log(max(sized.count(), 1), 16) / 2))
    targets = materialize(source_targets(sized, weights, total_ratio, max_epochs), "targets")
    own = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name")]
    sized = sized.select("*", *own, F.substring("order", 1, digits).alias("bucket"))
    targets = targets.select(*own, "rank", "source_size", "target")
    buckets = sized.groupBy("no_source", "name", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("no_source", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("no_source", "name", "bucket", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("offset"))
    buckets = materialize(buckets.join(targets, ["no_source", "name"]), "offsets")
    run = (
        Window.partitionBy("no_source", "name", "bucket")
        .orderBy("order", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.join(buckets, ["no_source", "name", "bucket"]).withColumn(
        "start", F.col("offset") + F.coalesce(F.sum("size").over(run), F.lit(0))
    )
    levels, sums = _demand(schedules, F.col("rank"))
    begin = lambda epoch: F.col("start") + epoch * F.col("source_size")
    taken = lambda epoch: begin(epoch) + F.col("size") / F.lit(2.0) <= F.col("target")
    copies = sum((taken(e).cast("int") for e in range(max_epochs)), F.lit(0))
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)))
    share = lambda e: F.least(begin(e) / F.col("target"), F.lit(1.0))
    at = F.array(*[_time(share(e), levels, sums) for e in range(max_epochs)])
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("copies") > 0, F.slice(at, 1, F.col("copies"))).otherwise(F.array().cast("array<double>")).alias("positions"),
        (F.lit(1.0) + F.coalesce(F.try_divide(F.col("start"), F.col("source_size")), F.lit(0.0))).alias("__late"),
        F.col("order").alias("__order"),
    )


def in_training_order(mix: DataFrame) -> DataFrame:
    """`mix` range-sorted by first training position; documents that the mix doesn't take follow, spread by offset."""
    mix = materialize(mix, "mix").withColumn("position", F.get("positions", F.lit(0)))
    key = F.coalesce("position", "__late")
    return (
        mix.withColumn("__key", key)
        .repartitionByRange("__key", "__order")
        .sortWithinPartitions("__key", "__order")
        .drop("__key", "__order", "__late")
    )


def training_sequence(mix: DataFrame) -> DataFrame:
    """One row for each copy taken (doc_id, source, size, epoch, position), range-sorted by position."""
    copies = mix.select("doc_id", "source", "size", "__order", F.posexplode("positions").alias("epoch", "position"))
    return copies.repartitionByRange("position", "__order").sortWithinPartitions("position", "__order").drop("__order")
