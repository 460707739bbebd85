"""Running totals within groups of any size, in windows of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fine buckets that one coarse bucket holds.
FAN_OUT = 1024


def totals_before(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    value: str,
    name: str,
) -> DataFrame:
    """``df`` with column ``name``: the sum of ``value`` over the rows before, in its group.

    Rows are in order of ``bucket`` (a whole number from 0, rising with ``order``) and, within
    a bucket, of ``order``. The caller makes buckets of a few hundred rows; no window then
    spans a group: sums are carried from rows to buckets, from buckets to blocks of
    ``FAN_OUT`` buckets, and from blocks to the group.
    """
    fine, coarse = f"_{name}_fine", f"_{name}_coarse"
    part, passed, skipped = f"_{name}_part", f"_{name}_passed", f"_{name}_skipped"

    def before(total: str, keys: Sequence[str], by: Sequence[Column]) -> Column:
        window = Window.partitionBy(*keys).orderBy(*by)
        running = F.sum(total).over(window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(running, F.lit(0))

    df = df.withColumn(fine, bucket)
    buckets = (
        df.groupBy(*groups, fine)
        .agg(F.sum(value).alias(part))
        .withColumn(coarse, F.floor(F.col(fine) / FAN_OUT))
        .withColumn(passed, before(part, [*groups, coarse], [F.col(fine)]))
    )
    blocks = (
        buckets.groupBy(*groups, coarse)
        .agg(F.sum(part).alias(part))
        .withColumn(skipped, before(part, groups, [F.col(coarse)]))
        .drop(part)
    )
    offsets = buckets.join(blocks, [*groups, coarse]).select(
        *groups, fine, (F.col(passed) + F.col(skipped)).alias(passed)
    )
    return (
        df.join(offsets, [*groups, fine])
        .withColumn(name, before(value, [*groups, fine], order) + F.col(passed))
        .drop(fine, passed)
    )
