"""Web traffic: identified sessions, funnels, conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import labels as L
from wayfare.functions.exprs import (
    is_state,
    mean_pct,
    n_rows,
    pct,
    share_of_total,
)
from wayfare.operators import skew
from wayfare.sources.warehouse import Warehouse


def session_type(anonymous: str = L.ANONYMOUS) -> Column:
    return F.when(F.col("ident") == 1, L.IDENTIFIED).otherwise(anonymous)


def sessions_known(wh: Warehouse) -> DataFrame:
    counted = (
        wh.sessions.groupBy(session_type().alias("tipo_sesion"))
        .agg(n_rows().alias("sesiones"))
    )
    share = share_of_total("sesiones").alias("pct")
    return counted.select("tipo_sesion", "sesiones", share).orderBy(F.desc("sesiones"))


def funnel_by_session_type(wh: Warehouse) -> DataFrame:
    return (
        wh.sessions.groupBy(session_type().alias("tipo_sesion"))
        .agg(
            n_rows().alias("sesiones"),
            pct(F.sum("vi"), n_rows()).alias("pct_view_item"),
            pct(F.sum("bc"), n_rows()).alias("pct_begin_checkout"),
            pct(F.sum("pu"), n_rows()).alias("pct_purchase"),
        )
        .orderBy("tipo_sesion")
    )


def funnel_by_device(wh: Warehouse) -> DataFrame:
    """The purchase gap between devices, before and after signing in."""
    viewed, known = F.col("vi") == 1, F.col("ident") == 1
    bought = F.col("pu") == 1
    grouped = (
        wh.sessions.groupBy("device")
        .agg(
            n_rows().alias("sesiones"),
            F.count_if(known).alias("n_ident"),
            F.count_if(viewed).alias("n_vi"),
            F.count_if(viewed & known).alias("n_vi_ident"),
            F.count_if(viewed & bought).alias("n_vi_pu"),
            F.count_if(known & bought).alias("n_ident_pu"),
            F.sum("pu").alias("n_pu"),
            F.sum("bc").alias("n_bc"),
        )
    )
    c = F.col
    return grouped.select(
        "device",
        "sesiones",
        share_of_total("sesiones").alias("pct_trafico"),
        mean_pct(c("n_ident"), c("sesiones")).alias("pct_identificada"),
        mean_pct(c("n_vi_ident"), c("n_vi")).alias("pct_ident_si_interes"),
        mean_pct(c("n_vi_pu"), c("n_vi")).alias("pct_compra_si_interes"),
        mean_pct(c("n_ident_pu"), c("n_ident")).alias("pct_compra_si_identificada"),
        pct(c("n_pu"), c("n_bc")).alias("pct_checkout_a_compra"),
    ).orderBy(F.desc("sesiones"), "device")


def conversion_gross(wh: Warehouse) -> DataFrame:
    """Sessions with an event that carries a booking id."""
    converted = F.sum("con_reserva")
    return wh.sessions.agg(
        n_rows().alias("sesiones"),
        converted.alias("sesiones_con_reserva"),
        pct(converted, n_rows()).alias("pct_conversion_bruta"),
    )


def conversion_net(wh: Warehouse) -> DataFrame:
    """Of the sessions with a booking id, those with a confirmed booking.

    The pairs of session and booking are few beside the bookings. Counted to be small, they
    are broadcast and no booking is shuffled; otherwise they look their bookings up.
    """
    linked = wh.session_bookings
    confirmed = wh.bookings.where(is_state(L.CONFIRMED)).select(
        "reserva_id", F.lit(True).alias("confirmada")
    )
    size = wh.size("sesiones_reservas")
    if size and size.within(skew.BROADCAST_ROWS):
        found = confirmed.join(F.broadcast(linked), "reserva_id").select("session_id", "confirmada")
        none = linked.select("session_id", F.lit(False).alias("confirmada"))
        pairs = found.unionByName(none)
    else:
        pairs = skew.balanced_lookup(
            linked, confirmed, on=["reserva_id"], spread_by="session_id", broadcast_rows=0
        )
    per_session = pairs.groupBy("session_id").agg(
        F.max(F.coalesce("confirmada", F.lit(False))).alias("confirmada")
    )
    kept = F.count_if("confirmada")
    return per_session.agg(
        n_rows().alias("sesiones_con_reserva"),
        kept.alias("sesiones_confirmadas"),
        pct(kept, n_rows()).alias("pct_conversion_neta"),
    )
