"""Web sessions and the usual device of a customer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare import labels as L
from wayfare.operators.cleaning import url_destination

FLAGS = ("ident", "vi", "bc", "pu", "con_reserva")


def session_bookings(events: DataFrame) -> DataFrame:
    """Pairs of a session and a booking that one of its events names; bots left out."""
    return (
        events.where(~F.col("es_bot") & F.col("reserva_id").isNotNull())
        .select("session_id", "reserva_id")
        .distinct()
    )


def session_days(events: DataFrame) -> DataFrame:
    """Flags per (session, day, device) of non-bot events.

    Fine enough for any date filter, small enough that every session report reads this
    instead of events. Grouping by device (one per session, as a rule) keeps all
    aggregates fixed-width, so Spark hashes instead of sorting. A stage flag is NULL when
    no event has a name.
    """
    name = F.col("event_name")
    flags = {
        "ident": F.col("user_id_propagado").isNotNull(),
        "vi": name == L.VIEW_ITEM,
        "bc": name == L.BEGIN_CHECKOUT,
        "pu": name == L.PURCHASE,
        "con_reserva": F.col("reserva_id").isNotNull(),
    }
    return (
        events.where(~F.col("es_bot"))
        .groupBy("session_id", F.to_date("event_date").alias("dia"), "device")
        .agg(
            F.min("event_date").alias("inicio"),
            *[F.max(c).alias(n) for n, c in flags.items()],
        )
    )


def sessions(
    days: DataFrame, since: dt.date | None = None, until: dt.date | None = None
) -> DataFrame:
    """One row per session: start, device and 0/1/NULL flags, from events of the given days."""
    if since is not None:
        days = days.where(F.col("dia").between(F.lit(since), F.lit(until)))
    return days.groupBy("session_id").agg(
        F.min("inicio").alias("inicio"),
        F.min("device").alias("device"),
        *[F.max(F.col(n).cast("int")).alias(n) for n in FLAGS],
    )


def usual_device(events: DataFrame) -> DataFrame:
    """Device with most sessions per customer (own ids only, no bots); ties by name."""
    counted = (
        events.where(F.col("user_id").isNotNull() & ~F.col("es_bot"))
        .groupBy("user_id", "device")
        .agg(F.count_distinct("session_id").alias("n"))
    )
    best = Window.partitionBy("user_id").orderBy(F.desc("n"), F.col("device").asc_nulls_last())
    return (
        counted.withColumn("rn", F.row_number().over(best))
        .where("rn = 1")
        .select("user_id", "device")
    )


def session_numbers(days: DataFrame) -> DataFrame:
    """A whole number for each session, those of one time next to each other.

    Numbers are given within ranges of the sessions' first day, so that the sessions of a day
    fill few blocks of numbers; they follow from the sorted ranges, with no task for all.
    """
    starts = days.where(F.col("session_id").isNotNull()).groupBy("session_id")
    ordered = (
        starts.agg(F.min("dia").alias("_dia"))
        .repartitionByRange("_dia", "session_id")
        .sortWithinPartitions("_dia", "session_id")
    )
    return ordered.select("session_id", F.monotonically_increasing_id().alias("numero"))


def interest_days(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """Which sessions viewed a destination on a day, as bitmaps of their numbers.

    A row holds the sessions of one block of numbers. Bitmaps of any days and destinations
    merge into those of all of them, and their bits are the exact number of sessions.
    """
    place = url_destination(F.col("url"))
    viewed = (
        events.where(~F.col("es_bot") & (F.col("event_name") == L.VIEW_ITEM) & (place != ""))
        .select(place.alias("destino"), F.to_date("event_date").alias("dia"), "session_id")
        .distinct()
    )
    return (
        viewed.join(numbers, "session_id", "left")
        .groupBy("destino", "dia", F.bitmap_bucket_number("numero").alias("bloque"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("numero")).alias("sesiones"))
    )


def sessions_in(interest: DataFrame, by: str) -> DataFrame:
    """Distinct sessions per group, from ``interest_days``."""
    return (
        interest.groupBy(by, "bloque")
        .agg(F.bitmap_count(F.bitmap_or_agg("sesiones")).alias("n"))
        .groupBy(by)
        .agg(F.sum("n").alias("sesiones_interes"))
    )
