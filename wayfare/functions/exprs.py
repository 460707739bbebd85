"""Column expressions shared by the metrics. Built-ins only, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare import labels as L


def rnd(value: Column, digits: int = 0) -> Column:
    """Round a double half away from zero *after* scaling.

    ``F.round(x, 2)`` works on the decimal expansion (0.285 -> 0.29); the published
    figures come from scaled rounding (0.285 * 100 = 28.499... -> 0.28).
    """
    value = value.cast("double")
    if digits == 0:
        return F.round(value, 0)
    scale = F.lit(float(10**digits))
    return F.round(value * scale, 0) / scale


def ratio(part: Column, whole: Column) -> Column:
    """Double division; NULL instead of an error when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def raw_pct(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return rnd(raw_pct(part, whole), digits)


def raw_mean_pct(part: Column, whole: Column) -> Column:
    """A mean of 0-1 flags in %: divided first, then scaled, which rounds 23 of 80 to 28.7."""
    return F.lit(100.0) * ratio(part, whole)


def mean_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return rnd(raw_mean_pct(part, whole), digits)


def n_rows() -> Column:
    return F.count(F.lit(1))


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def mean(total: Column, n: Column) -> Column:
    """Mean from an exact sum; avoids the 4 extra digits a decimal avg is cut to."""
    return ratio(total, n)


def wald_interval(p: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wald interval of a proportion in % points; not clipped to [0, 100]."""
    half = F.lit(L.Z_95) * F.sqrt(p * (F.lit(1.0) - p) / n)
    return (
        rnd(F.lit(100.0) * (p - half), 1).alias("ic95_low"),
        rnd(F.lit(100.0) * (p + half), 1).alias("ic95_high"),
    )


def share_of_total(value: str, digits: int = 1) -> Column:
    """Share of the column total, in %. Only for aggregated results: one partition."""
    everything = Window.partitionBy()
    return pct(F.col(value), F.sum(value).over(everything), digits)


def days_between(start: Column, end: Column) -> Column:
    """Calendar days crossed, so 23:00 -> 00:30 counts 1."""
    return F.datediff(end, start)


def ladder(value: Column, steps: Sequence[tuple[int, str]], otherwise: str) -> Column:
    """Label of the first step whose upper edge (inclusive) is not exceeded.

    NULL satisfies no step and ends in ``otherwise``.
    """
    label = None
    for edge, name in steps:
        condition = value <= F.lit(edge)
        label = F.when(condition, name) if label is None else label.when(condition, name)
    return label.otherwise(otherwise)


def lead_bucket(days: Column, names: Sequence[str]) -> Column:
    return ladder(days, list(zip((7, 30, 90), names)), names[3])


def amount_bucket(amount: Column, edges: Sequence[int] = L.AMOUNT_EDGES) -> Column:
    a, b, c = edges
    return (
        F.when(amount == 0, L.AMOUNT_ZERO)
        .when(amount < a, f"<{a}")
        .when(amount < b, f"{a}-{b}")
        .when(amount < c, f"{b}-{c}")
        .otherwise(f"{c}+")
    )


def party_bucket(people: Column) -> Column:
    one, two, few, many = L.PARTY_SIZES
    return (
        F.when(people.isNull(), L.NULL_GROUP)
        .when(people == 1, one)
        .when(people == 2, two)
        .when(people <= 4, few)
        .otherwise(many)
    )


def period(column: Column, grain: str) -> Column:
    """First day of the week (Monday), month, quarter or day a timestamp falls in."""
    if grain == "day":
        return F.to_date(column)
    return F.trunc(F.to_date(column), grain)


def is_state(*states: str) -> Column:
    return F.col("estado") == states[0] if len(states) == 1 else F.col("estado").isin(*states)

