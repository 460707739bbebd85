"""Rates by group: plain, with a minimum size, with an interval, standardised."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions.exprs import mean_pct, n_rows, raw_pct, ratio, rnd, wald_interval


def repeat_rate(
    customers: DataFrame,
    by: dict[str, Column],
    min_group: int = 0,
    interval: bool = False,
) -> DataFrame:
    """Customers and % that came back per group, best first."""
    grouped = customers.groupBy(*[c.alias(n) for n, c in by.items()]).agg(
        n_rows().alias("clientes"), F.sum("recompra").alias("k")
    )
    return rates_of(grouped, list(by), min_group, interval)


def rates_of(
    grouped: DataFrame, by: Sequence[str], min_group: int = 0, interval: bool = False
) -> DataFrame:
    """The same from groups with their ``clientes`` and the number ``k`` that came back."""
    if min_group:
        grouped = grouped.where(F.col("clientes") >= min_group)
    columns: list[Column] = [F.col(n) for n in by]
    columns += [F.col("clientes"), mean_pct(F.col("k"), F.col("clientes")).alias("pct_recompra")]
    if interval:
        columns += wald_interval(ratio(F.col("k"), F.col("clientes")), F.col("clientes"))
    return grouped.select(*columns).orderBy(F.desc("pct_recompra"), *by)


def retention_rate(customers: DataFrame, factor: Column, name: str, min_group: int) -> DataFrame:
    """Same for the dashboard: fraction unrounded, flag boolean."""
    return (
        customers.groupBy(factor.alias(name))
        .agg(
            n_rows().alias("clientes"),
            ratio(F.count_if("recurrente"), n_rows()).alias("pct_retencion"),
        )
        .where(F.col("clientes") >= min_group)
    )


def repeat_cells(customers: DataFrame, factors: Mapping[str, tuple[Column, ...]]) -> DataFrame:
    """Customers and those that came back by every factor at once, in one pass.

    A factor has a condition for the customers that it looks at, and one or two groups; a row
    of the result is a ``factor`` with its groups ``a`` and ``b``.
    """
    entries = []
    for name, (scope, *groups) in factors.items():
        a, b = [g.cast("string") for g in groups] + [F.lit(None).cast("string")] * (2 - len(groups))
        entries.append(F.when(scope, F.struct(F.lit(name).alias("factor"), a.alias("a"), b.alias("b"))))
    return (
        customers.select("recompra", F.explode(F.array_compact(F.array(*entries))).alias("_cell"))
        .groupBy("_cell.factor", "_cell.a", "_cell.b")
        .agg(n_rows().alias("clientes"), F.sum("recompra").alias("k"))
    )


def standardise(customers: DataFrame, group: str, stratum: str, label: str) -> DataFrame:
    """``standardised`` from one row per customer."""
    cells = customers.groupBy(group, stratum).agg(
        n_rows().alias("n"), F.sum("recompra").alias("k")
    )
    return standardised(cells, group, stratum, label)


def standardised(cells: DataFrame, group: str, stratum: str, label: str) -> DataFrame:
    """Crude rate of each group and the rate it would have with everybody's strata mix.

    ``cells`` have ``n`` customers and ``k`` that came back for each group and stratum. A weight is the stratum's number of customers: the common divisor cancels out.
    Strata a group lacks are left out of its weights and a NULL stratum carries none;
    customers without a group count in the weights but get no row.
    """
    # over cells, not customers: at most one row per group in each partition
    size = F.sum("n").over(Window.partitionBy(stratum))
    weight = F.when(F.col(stratum).isNotNull(), size).cast("double")
    return (
        cells.withColumn("w", weight)
        .where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.sum("k").alias("k"),
            F.sum("n").alias("n"),
            F.sum(ratio(F.col("k"), F.col("n")) * F.col("w")).alias("kw"),
            F.sum("w").alias("w"),
        )
        .where(F.col("w").isNotNull())
        .select(
            group,
            mean_pct(F.col("k"), F.col("n")).alias("pct_crudo"),
            rnd(raw_pct(F.col("kw"), F.col("w")), 1).alias(label),
        )
        .orderBy(F.desc(label), group)
    )
