"""Destinations: volume, demand against bookings, ticket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare import labels as L
from wayfare.functions.exprs import is_state, mean, n_rows, pct, rnd, share_of_total
from wayfare.operators.sessions import sessions_in
from wayfare.sources.warehouse import Warehouse


def _confirmed(wh: Warehouse) -> DataFrame:
    return wh.bookings.where(is_state(L.CONFIRMED) & F.col("tour_conocido"))


def destination_volume(wh: Warehouse) -> DataFrame:
    totals = (
        _confirmed(wh)
        .groupBy("destino")
        .agg(n_rows().alias("reservas"), F.sum("importe_eur").alias("importe"))
    )
    return totals.select(
        "destino",
        "reservas",
        rnd(F.col("importe")).alias("revenue"),
        share_of_total("reservas").alias("pct_reservas"),
        share_of_total("importe").alias("pct_revenue"),
    ).orderBy(F.desc("reservas"), "destino")


def destination_demand(wh: Warehouse) -> DataFrame:
    """Sessions that viewed a destination next to its confirmed bookings.

    Only destinations with both; shares are taken after the join. Sessions are counted in
    bitmaps that are kept by day, so that no event is read and no session shuffled.
    """
    viewed = sessions_in(wh.interest_days, "destino")
    booked = _confirmed(wh).groupBy("destino").agg(n_rows().alias("reservas"))
    return (
        viewed.join(booked, "destino", "inner")
        .select(
            "destino",
            "sesiones_interes",
            "reservas",
            share_of_total("sesiones_interes").alias("pct_interes"),
            share_of_total("reservas").alias("pct_reservas"),
            pct(F.col("reservas"), F.col("sesiones_interes")).alias("reservas_por_100_sesiones"),
        )
        .orderBy(F.desc("reservas_por_100_sesiones"), "destino")
    )


def destination_ticket(wh: Warehouse) -> DataFrame:
    price = "precio_por_persona_eur"
    return (
        _confirmed(wh)
        .groupBy("destino")
        .agg(
            n_rows().alias("reservas"),
            F.sum("importe_eur").alias("importe"),
            F.count("importe_eur").alias("n_importe"),
            F.avg("personas").alias("personas"),
            F.sum(price).alias("precio"),
            F.count(price).alias("n_precio"),
        )
        .select(
            "destino",
            "reservas",
            rnd(F.col("importe")).alias("revenue"),
            rnd(mean(F.col("importe"), F.col("n_importe")), 1).alias("ticket_medio"),
            rnd(F.col("personas"), 2).alias("personas_medias"),
            rnd(mean(F.col("precio"), F.col("n_precio")), 1).alias("precio_pp_medio"),
        )
        .orderBy(F.desc("reservas"), "destino")
    )


def cancel_by_destination(wh: Warehouse) -> DataFrame:
    """Share of decided bookings that were cancelled."""
    return (
        wh.bookings.where(is_state(*L.RESOLVED) & F.col("tour_conocido"))
        .groupBy("destino")
        .agg(
            n_rows().alias("reservas_resueltas"),
            pct(F.count_if(is_state(L.CANCELLED)), n_rows()).alias("pct_cancelacion"),
        )
        .orderBy(F.desc("pct_cancelacion"), "destino")
    )
