"""State of the business: sales, cancellations, bookings at risk."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare import labels as L
from wayfare.functions.exprs import (
    days_between,
    is_state,
    lead_bucket,
    n_rows,
    pct,
    raw_pct,
    rnd,
    sum_if,
)
from wayfare.operators.skew import balanced_lookup
from wayfare.sources.warehouse import Warehouse


def _amount(*states: str):
    return sum_if(is_state(*states), F.col("importe_eur"))


def business_summary(wh: Warehouse) -> DataFrame:
    free = is_state(L.CONFIRMED) & (F.col("importe_eur") == 0)
    return wh.bookings.agg(
        rnd(_amount(L.CONFIRMED)).alias("venta_confirmada"),
        F.count_if(is_state(L.CONFIRMED)).alias("reservas_confirmadas"),
        F.count_if(free).alias("free_tours"),
        rnd(_amount(L.PENDING)).alias("pipeline_pendiente"),
        rnd(_amount(L.CANCELLED)).alias("ingreso_perdido_cancelacion"),
        pct(_amount(L.CANCELLED), _amount(L.CONFIRMED)).alias("pct_cancelado_sobre_venta"),
    )


def sales_by_semester(wh: Warehouse, since: dt.date = L.SALES_START) -> DataFrame:
    day = F.col("fecha_reserva")
    recent = day >= F.lit(since).cast("timestamp_ntz")
    half = F.when(F.month(day) <= 6, "-H1").otherwise("-H2")
    return (
        wh.bookings_between(since, None)
        .where(recent)
        .groupBy(F.concat(F.year(day).cast("string"), half).alias("semestre"))
        .agg(
            F.count_if(is_state(L.CONFIRMED)).alias("reservas"),
            rnd(_amount(L.CONFIRMED)).alias("venta"),
        )
        .orderBy("semestre")
    )


def sales_growth(wh: Warehouse, since: dt.date = L.SALES_START) -> DataFrame:
    """Sales of the last semester against the first."""
    return (
        sales_by_semester(wh, since)
        .agg(
            F.min("semestre").alias("primer_semestre"),
            F.max("semestre").alias("ultimo_semestre"),
            F.min_by("venta", "semestre").alias("venta_primero"),
            F.max_by("venta", "semestre").alias("venta_ultimo"),
        )
        .withColumn(
            "pct_crecimiento",
            rnd(
                raw_pct(F.col("venta_ultimo") - F.col("venta_primero"), F.col("venta_primero")), 1
            ),
        )
    )


def sales_sensitivity(wh: Warehouse) -> DataFrame:
    """How much the sales figure depends on counting pending bookings."""
    confirmed = is_state(L.CONFIRMED)
    return wh.bookings.agg(
        rnd(_amount(L.CONFIRMED)).alias("a_solo_confirmada"),
        rnd(_amount(L.CONFIRMED, L.PENDING)).alias("b_mas_pendiente"),
        pct(_amount(L.PENDING), _amount(L.CONFIRMED)).alias("pct_extra_pendiente"),
        F.count_if(confirmed & (F.col("importe_eur") > 0)).alias("n_confirmada_de_pago"),
        F.count_if(confirmed & (F.col("importe_eur") == 0)).alias("n_free_tours"),
    )


def cancel_by_lead(wh: Warehouse) -> DataFrame:
    """By days between booking and activity. Negative days count as the first bucket and
    missing ones as the last, as published."""
    lead = days_between(F.to_date("fecha_reserva"), F.to_date("fecha_actividad"))
    cancelled = is_state(L.CANCELLED)
    return (
        wh.bookings.where(is_state(*L.RESOLVED))
        .groupBy(lead_bucket(lead, L.LEAD_REPORT).alias("antelacion"))
        .agg(
            n_rows().alias("reservas_resueltas"),
            pct(F.count_if(cancelled), n_rows()).alias("pct_cancelacion"),
            rnd(_amount(L.CANCELLED)).alias("eur_cancelado"),
        )
        .orderBy("antelacion")
    )


def cancel_by_channel(wh: Warehouse) -> DataFrame:
    resolved = F.count_if(is_state(*L.RESOLVED))
    return (
        wh.bookings.groupBy("canal")
        .agg(
            resolved.alias("reservas_resueltas"),
            pct(F.count_if(is_state(L.CANCELLED)), resolved).alias("pct_cancelacion"),
        )
        .orderBy(F.desc("pct_cancelacion"), "canal")
    )


def with_provider_end(wh: Warehouse, bookings: DataFrame) -> DataFrame:
    """Bookings whose provider has left, with the day it left."""
    left = wh.providers.where(F.col("proveedor_id").isNotNull() & F.col("fecha_baja").isNotNull())
    return balanced_lookup(
        bookings.where(F.col("proveedor_id").isNotNull()),
        left.select("proveedor_id", "fecha_baja"),
        on=["proveedor_id"],
        spread_by="reserva_id",
        size=wh.size("proveedores"),
    ).where(F.col("fecha_baja").isNotNull())


def terminated_provider_risk(wh: Warehouse) -> DataFrame:
    """Confirmed bookings made after their provider had left, per provider and in total."""
    confirmed = wh.bookings.where(is_state(L.CONFIRMED)).select(
        "reserva_id", "proveedor_id", F.to_date("fecha_reserva").alias("fr"), "importe_eur"
    )
    by_provider = (
        with_provider_end(wh, confirmed)
        .where(F.col("fr") > F.col("fecha_baja"))
        .groupBy("proveedor_id", "fecha_baja")
        .agg(n_rows().alias("n"), F.sum("importe_eur").alias("importe"))
    )
    columns = [
        F.coalesce("n", F.lit(0).cast("long")).alias("reservas_confirmadas"),
        rnd(F.col("importe")).alias("importe_en_riesgo"),
    ]
    rows = by_provider.select(
        F.col("proveedor_id").cast("string").alias("proveedor_id"),
        F.col("fecha_baja").cast("string").alias("fecha_baja"),
        *columns,
        F.lit(1).alias("orden"),
    )
    # the total exists even when nothing is at risk
    total = by_provider.agg(F.sum("n").alias("n"), F.sum("importe").alias("importe")).select(
        F.lit(L.TOTAL).alias("proveedor_id"),
        F.lit(None).cast("string").alias("fecha_baja"),
        *columns,
        F.lit(0).alias("orden"),
    )
    return (
        total.unionByName(rows)
        .orderBy("orden", F.desc("importe_en_riesgo"), "proveedor_id")
        .drop("orden")
    )
