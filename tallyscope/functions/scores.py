"""Score arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities in rising order; compared by place, never as text.
SEVERITIES = ("NONE", "INFO", "MINOR", "MAJOR", "CRITICAL")


def lit(x: float) -> Column:
    return F.lit(float(x))


def clamp(x: Column) -> Column:
    """`x` held in 0 to 1; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(lit(0), F.least(lit(1), x)))


def round6(x: Column) -> Column:
    return F.round(x, 6)


def steady6(x: Column) -> Column:
    """`x` to six decimals, ties and what sums in another order make of them upwards."""
    return F.floor(x * 1_000_000 + lit(0.500001)).cast("double") / lit(1_000_000)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def effective_score(status: Column, score: Column) -> Column:
    """The number an observation enters arithmetic with: NA and ERROR stay out of it."""
    return (
        F.when(status == "SCORED", score)
        .when(status == "PASS", F.coalesce(score, lit(1)))
        .when(status == "FAIL", F.coalesce(score, lit(0)))
    )


def severity_band(score: Column, critical_below: float | None = None) -> Column:
    """MAJOR below .35, MINOR below .70, else INFO; CRITICAL below `critical_below` where that is given."""
    bands = F.when(score < 0.35, "MAJOR").when(score < 0.70, "MINOR").when(score.isNotNull(), "INFO")
    return bands if critical_below is None else F.when(score < critical_below, "CRITICAL").otherwise(bands)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def ladder(*rungs: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first rung whose condition holds: the order of the rungs is the meaning."""
    first, *rest = rungs
    case = F.when(*first)
    for condition, value in rest:
        case = case.when(condition, value)
    return case.otherwise(otherwise)


def stable_id(length: int, *parts: Column) -> Column:
    """The first `length` hex digits of the SHA-256 of the parts, joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def hash_fraction(x: Column) -> Column:
    """A number in 0 to 1 that depends on `x` alone: its SHA-256's first 8 hex digits over their largest value."""
    return F.conv(F.substring(F.sha2(x.cast("string"), 256), 1, 8), 16, 10).cast("double") / lit(4294967295)


def lookup(key: Column, table: dict[str, float | str]) -> Column:
    """The entry of `key` in a small fixed table; null without one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def piecewise(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The piecewise linear curve through `knots`, constant beyond them."""
    (x0, y0), *rest = knots
    case, (a, b) = F.when(x <= x0, lit(y0)), (x0, y0)
    for c, d in rest:
        case = case.when(x <= c, lit(b) + (x - lit(a)) * lit((d - b) / (c - a)))
        a, b = c, d
    return F.when(x.isNotNull(), case.otherwise(lit(b)))
