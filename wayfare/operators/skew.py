"""Left join to a lookup table that stays balanced whatever the key distribution."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.session import shuffle_width

# A key is hot above 1/HOT_SHARE of all rows, or above its share of a shuffle that is wider
# than that. Counts add up to the number of rows, so fewer than that many keys can be hot:
# the list is safe to broadcast whatever the data.
HOT_SHARE = 10_000

# A lookup of at most this many rows and bytes of text is sent to every executor, which
# needs no shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_TEXT = 32 * 1024**2


@dataclass(frozen=True)
class Size:
    """Rows of a table and bytes of its text, counted while it was written."""

    rows: int
    text: int

    def within(self, rows: int) -> bool:
        return 0 < rows and self.rows <= rows and self.text <= BROADCAST_TEXT


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))


def hot_keys(counts: DataFrame, on: Sequence[str], total: Column, share: int) -> DataFrame:
    """Keys above the share, with the number of salts that cuts each to cold size."""
    parts = F.ceil(F.col("_n") * F.lit(share) / total).cast("int")
    return counts.where(F.col("_n") * F.lit(share) > total).select(
        *[F.col(c).alias(f"_hot_{c}") for c in on], parts.alias("_parts")
    )


def _same(on: Sequence[str], left: str, right: str) -> Column:
    """Null-safe, because PARTITION BY groups NULL keys too."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}")) for c in on],
    )


def is_small(df: DataFrame, rows: int) -> bool:
    """Size check before a broadcast, for a table whose size is not known: it is counted, and
    its text measured when there are few rows."""
    if rows <= 0 or df.count() > rows:
        return False
    lengths = [F.octet_length(f.name) for f in df.schema.fields if f.dataType == T.StringType()]
    if not lengths:
        return True
    text = sum((F.coalesce(F.sum(x), F.lit(0)) for x in lengths), F.lit(0))
    return df.agg(text).first()[0] <= BROADCAST_TEXT


def balanced_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: str,
    counts: DataFrame | None = None,
    share: int | None = None,
    broadcast_rows: int | None = None,
    size: Size | None = None,
) -> DataFrame:
    """``facts LEFT JOIN lookup`` on null-safe keys; ``lookup`` holds each key once.

    A lookup counted to be small is broadcast, so the facts stay where they are; ``size`` tells
    how large at most it was when it was written, and spares counting it here. Otherwise
    rows of a hot key get a salt taken from the ``spread_by`` column (a row id, so a re-run
    task sends a row to the same place) and the one lookup row of that key is copied once
    per salt. No partition then has to take more than about 1/share of the rows on account
    of one key, and all copies together are fewer than 2 * share rows.

    ``counts`` (keys + ``_n``) may come from the caller when it already grouped the facts.
    ``broadcast_rows=0`` skips the size check, for lookups that are costly to count.
    """
    values = [c for c in lookup.columns if c not in on]
    keyed = lookup.select(*[F.col(c).alias(f"_key_{c}") for c in on], *values)
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if size.within(limit) if size else is_small(lookup, limit):
        joined = facts.join(F.broadcast(keyed), _same(on, "", "_key_"), "left")
        return joined.select(*facts.columns, *values)

    share = share or max(HOT_SHARE, shuffle_width(facts.sparkSession))
    counts = key_counts(facts, on) if counts is None else counts
    total = counts.agg(F.sum("_n")).scalar()
    hot = hot_keys(counts.select(*on, "_n"), on, total, share)
    hot_names = [f"_hot_{c}" for c in on]

    salted = facts.join(F.broadcast(hot), _same(on, "", "_hot_"), "left").withColumn(
        "_salt",
        F.when(
            F.col("_parts") > 1, F.pmod(F.xxhash64(spread_by), F.col("_parts")).cast("int")
        ).otherwise(F.lit(0)),
    )
    copies = (
        keyed.join(F.broadcast(hot), _same(on, "_key_", "_hot_"), "left")
        .withColumn(
            "_key_salt",
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - F.lit(1))),
        )
        .drop(*hot_names, "_parts")
    )
    joined = salted.drop(*hot_names, "_parts").join(
        copies, _same(on, "", "_key_") & (F.col("_salt") == F.col("_key_salt")), "left"
    )
    return joined.select(*facts.columns, *values)
