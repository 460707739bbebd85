"""First-booking cohorts: who came back after the first activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wayfare import labels as L
from wayfare.functions.exprs import (
    amount_bucket,
    days_between,
    is_state,
    lead_bucket,
    n_rows,
    party_bucket,
    sum_if,
)
from wayfare.operators.skew import HOT_SHARE, hot_keys, key_counts
from wayfare.session import shuffle_width


def booking_order() -> Window:
    """Booking time, then id; bookings without a time come last."""
    return Window.partitionBy("user_id").orderBy(
        F.col("fecha_reserva").asc_nulls_last(), F.col("reserva_id").asc_nulls_last()
    )


# What a first or second booking is shown with, besides its id.
_SHOWN = ("fr", "fa", "tour_id", "tour_conocido", "destino", "canal", "campana", "importe_eur", "personas")
_TOTALS = ("n_confirmadas", "importe_total", "ultima_fr", "tuvo_cancelacion")
AMOUNT = T.DecimalType(28, 2)


def hot_users(bookings: DataFrame) -> DataFrame:
    """Users with so many bookings that they are split, and into how many parts each.

    Reads one column. Fewer users than ``HOT_SHARE``, or than a shuffle has partitions, can
    be among them.
    """
    counts = key_counts(bookings, ["user_id"])
    share = max(HOT_SHARE, shuffle_width(bookings.sparkSession))
    return hot_keys(counts, ["user_id"], counts.agg(F.sum("_n")).scalar(), share)


def _totals(scope: Column, suffix: str) -> list[Column]:
    confirmed = scope & is_state(L.CONFIRMED)
    found = (
        F.count_if(confirmed),
        sum_if(confirmed, F.col("importe_eur")),
        F.max(F.when(confirmed, F.to_date("fecha_reserva"))),
        F.coalesce(F.max(scope & is_state(L.CANCELLED)), F.lit(False)),
    )
    return [column.alias(f"{name}{suffix}") for name, column in zip(_TOTALS, found)]


def user_histories(bookings: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """One row per user: the two earliest confirmed bookings, those of known tours apart from
    the rest, and totals over all bookings and over those of known tours.

    Bookings are read and exchanged once. A part of a user ends up as at most four bookings and
    the totals, and parts merge into the same; the bookings of a ``hot`` user, among them those
    of all unknown users, are dealt to several parts by a hash of their id.
    """
    hot = hot_users(bookings) if hot is None else hot
    parts = F.broadcast(hot)
    salt = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("reserva_id"), F.col("_parts")))
    confirmed = is_state(L.CONFIRMED)
    rows = (
        bookings.select(
            "user_id", "reserva_id", "fecha_reserva", "fecha_actividad", "tour_id", "tour_conocido",
            "destino", "canal", "campana", "importe_eur", "personas", "estado",
        )
        .join(parts, F.col("user_id").eqNullSafe(F.col("_hot_user_id")), "left")
        .withColumn("_part", F.coalesce(salt, F.lit(0)).cast("int"))
        .drop(*hot.columns)
        .repartition("user_id", "_part")
    )
    order = Window.partitionBy("user_id", "_part", "tour_conocido", confirmed).orderBy(
        F.col("fecha_reserva").asc_nulls_last(), F.col("reserva_id").asc_nulls_last()
    )
    booking = F.struct(
        F.col("fecha_reserva").isNull().alias("_sin_fecha"),
        F.col("fecha_reserva").alias("_fecha"),
        F.col("reserva_id").isNull().alias("_sin_id"),
        "reserva_id",
        F.to_date("fecha_reserva").alias("fr"),
        F.to_date("fecha_actividad").alias("fa"),
        *_SHOWN[2:],
    )
    # Plain values, so that rows in the ranking's order are merged as they come, with no hash
    # table and no sort of their own.
    early = {
        f"_{k}_{known}": F.max(
            F.when(confirmed & (F.col("_rank") == k) & (F.col("tour_conocido") == F.lit(known)), booking)
        )
        for known in (True, False)
        for k in (1, 2)
    }
    by_part = (
        rows.withColumn("_rank", F.row_number().over(order))
        .groupBy("user_id", "_part")
        .agg(
            *[found.alias(name) for name, found in early.items()],
            *_totals(F.lit(True), ""),
            *_totals(F.col("tour_conocido"), "_con_tour"),
            F.max(F.to_date("fecha_reserva")).alias("ultimo_dia"),
        )
        .withColumn("primeras", F.array_compact(F.array(*early)))
        .drop(*early)
    )
    merged = {"n_confirmadas": F.sum, "importe_total": F.sum}
    totals = [f"{name}{suffix}" for suffix in ("", "_con_tour") for name in _TOTALS]
    together = F.sort_array(F.flatten(F.collect_list("primeras")))

    def two(known: bool) -> Column:
        return F.slice(F.filter("primeras", lambda b: b["tour_conocido"] == F.lit(known)), 1, 2)

    return (
        by_part.groupBy("user_id")
        .agg(
            together.alias("primeras"),
            *[merged.get(n.removesuffix("_con_tour"), F.max)(n).alias(n) for n in totals],
            F.max("ultimo_dia").alias("ultimo_dia"),
        )
        .withColumns(
            {n: F.col(n).cast(AMOUNT) for n in totals if n.startswith("importe")}
            | {"primeras": F.sort_array(F.concat(two(True), two(False)))}
        )
    )


def first_bookings(histories: DataFrame, with_tour_only: bool = False) -> DataFrame:
    """One row per user: the first confirmed booking next to the second one.

    The report cohort takes every confirmed booking and cuts at the last booking day of any
    state; the dashboard cohort (``with_tour_only``) takes confirmed bookings of known tours and
    cuts at their last day. Unknown users count as one customer but match nothing: no second
    booking, no totals.
    """
    suffix, last_day = ("_con_tour", "ultima_fr_con_tour") if with_tour_only else ("", "ultimo_dia")
    taken = F.filter("primeras", lambda b: b["tour_conocido"]) if with_tour_only else F.col("primeras")
    cutoff = histories.agg(F.max(last_day)).scalar()
    known = F.col("user_id").isNotNull()
    first, second = F.get("_taken", F.lit(0)), F.get("_taken", F.lit(1))
    return (
        histories.withColumn("_taken", taken)
        .where(F.size("_taken") > 0)
        .select(
            "user_id",
            *[first[name].alias(name) for name in ("reserva_id", *_SHOWN)],
            F.when(known, second["reserva_id"]).alias("sig_reserva_id"),
            F.when(known, second["fr"]).alias("sig_fr"),
            F.when(known, second["importe_eur"]).alias("sig_importe"),
            *[F.when(known, F.col(f"{name}{suffix}")).alias(name) for name in _TOTALS],
            cutoff.alias("corte"),
        )
    )


def booking_days(bookings: DataFrame) -> DataFrame:
    """Bookings of known tours by day, channel, destination, state and days in advance: counts
    and sums that add up to those of any period, channels and destinations."""
    lead = days_between(F.to_date("fecha_reserva"), F.to_date("fecha_actividad"))
    band = F.when(lead < 0, L.LEAD_NEGATIVE).otherwise(lead_bucket(lead, L.LEAD_DASHBOARD))
    paid = F.col("importe_eur") > 0
    return (
        bookings.where("tour_conocido")
        .groupBy(
            F.to_date("fecha_reserva").alias("dia"),
            "canal",
            "destino",
            "estado",
            band.alias("antelacion"),
        )
        .agg(
            n_rows().alias("reservas"),
            F.sum("importe_eur").alias("importe"),
            F.count_if(paid).alias("pagadas"),
            sum_if(paid, F.col("importe_eur")).alias("importe_pagado"),
            F.sum("personas").alias("personas"),
            F.count("personas").alias("con_personas"),
        )
    )


def repeated(rule: str = "next") -> Column:
    """Did the customer book again after the first activity?

    ``next`` looks at the earliest later booking, ``any`` at all of them.
    """
    if rule == "next":
        later = F.col("sig_fr")
    elif rule == "any":
        # with a dated later booking, the last day of all is the last day of the later ones
        later = F.when(F.col("sig_fr").isNotNull(), F.col("ultima_fr"))
    else:
        raise ValueError(f"unknown repeat rule: {rule}")
    return F.coalesce(later > F.col("fa"), F.lit(False))


def exposure() -> Column:
    return days_between(F.col("fa"), F.col("corte"))


def cohort(firsts: DataFrame, rule: str = "next") -> DataFrame:
    """Customers whose first activity has taken place, with repeat flag and exposure."""
    return firsts.where(F.col("fa") <= F.col("corte")).withColumns(
        {"recompra": repeated(rule).cast("int"), "dias_exposicion": exposure()}
    )


def mature(cohort_df: DataFrame, days: int = L.MATURE_DAYS) -> DataFrame:
    return cohort_df.where(F.col("dias_exposicion") >= days)


def factors() -> dict[str, tuple[Column, ...]]:
    """What the report splits the mature cohort by: whom it looks at, and one or two groups."""
    everybody, known = F.lit(True), F.col("tour_conocido")
    free = F.col("importe_eur") == 0
    channel, place = F.col("canal"), F.col("destino")
    not_email = channel != L.EXCLUDED_CHANNEL
    lead = days_between(F.col("fr"), F.col("fa"))
    cancelled = F.coalesce("tuvo_cancelacion", F.lit(False))
    return {
        "canal": (not_email & (F.col("importe_eur") > 0), channel),
        "canal_tipo": (not_email, channel, F.when(free, L.FREE).otherwise(L.PAID)),
        "canal_destino": (not_email & known, channel, place),
        "primera_reserva": (everybody, F.when(free, L.FIRST_FREE).otherwise(L.FIRST_PAID)),
        "destino": (known, place),
        "importe": (everybody, amount_bucket(F.col("importe_eur"))),
        "personas": (everybody, party_bucket(F.col("personas"))),
        "antelacion": (everybody, lead_bucket(lead, L.LEAD_FACTOR)),
        "campana": (everybody, F.coalesce("campana", F.lit(L.NO_CAMPAIGN))),
        "cancelacion": (
            everybody,
            F.when(cancelled, L.HAD_CANCELLATION).otherwise(L.NO_CANCELLATION),
        ),
    }
