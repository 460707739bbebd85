"""Repeat purchase: how many customers come back, and which factors go with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import labels as L
from wayfare.functions.exprs import (
    amount_bucket,
    days_between,
    is_state,
    mean,
    mean_pct,
    n_rows,
    pct,
    period,
    rnd,
)
from wayfare.operators.cohort import booking_order, cohort, mature
from wayfare.operators.rates import rates_of, repeat_rate, standardised
from wayfare.sources.warehouse import Warehouse


def base(wh: Warehouse, rule: str = "next", days: int = L.MATURE_DAYS) -> DataFrame:
    """Customers with enough exposure since their first activity."""
    return mature(cohort(wh.firsts, rule), days)


def repeat_global(wh: Warehouse, rule: str = "next", days: int = L.MATURE_DAYS) -> DataFrame:
    back = F.sum("recompra")
    return base(wh, rule, days).agg(
        n_rows().alias("clientes_elegibles"),
        back.alias("recompran"),
        pct(back, n_rows()).alias("pct_recompra"),
    )


def repeat_by_cohort(wh: Warehouse) -> DataFrame:
    """By quarter of the first activity, recent cohorts included: shows the censoring."""
    return (
        cohort(wh.firsts)
        .groupBy(period(F.col("fa"), "quarter").alias("cohorte_1a_actividad"))
        .agg(
            n_rows().alias("clientes"),
            F.min("dias_exposicion").alias("exposicion_min"),
            mean_pct(F.sum("recompra"), n_rows()).alias("pct_recompra"),
        )
        .orderBy("cohorte_1a_actividad")
    )


def trip_stacking(wh: Warehouse) -> DataFrame:
    """Days between the first two confirmed bookings, same trip against later.

    The exact median keeps a count per distinct gap, a few thousand values at most.
    """
    gap = days_between(F.col("fr"), F.col("sig_fr"))
    kind = F.when(F.col("dias") <= L.SAME_TRIP_DAYS, L.SAME_TRIP).otherwise(L.REAL_REPEAT)
    return (
        wh.firsts.where(F.col("sig_reserva_id").isNotNull())
        .select(gap.alias("dias"))
        .groupBy(kind.alias("tipo"))
        .agg(
            n_rows().alias("clientes"),
            rnd(F.avg("dias")).alias("dias_medios"),
            rnd(F.median("dias")).alias("dias_mediana"),
        )
        .orderBy("tipo")
    )


def customer_value(wh: Warehouse) -> DataFrame:
    kind = F.when(F.col("recompra") == 1, L.REPEATS).otherwise(L.SINGLE)
    known = base(wh).where(F.col("user_id").isNotNull())
    return (
        known.groupBy(kind.alias("tipo"))
        .agg(
            n_rows().alias("clientes"),
            F.sum("importe_total").alias("total"),
            F.count("importe_total").alias("n"),
        )
        .select(
            "tipo",
            "clientes",
            rnd(F.col("total")).alias("revenue"),
            rnd(mean(F.col("total"), F.col("n")), 1).alias("revenue_medio_cliente"),
        )
        .orderBy(F.desc("revenue_medio_cliente"))
    )


def rates_by(
    wh: Warehouse, name: str, *groups: str, min_group: int = 0, interval: bool = False
) -> DataFrame:
    """Repeat rates by one of ``cohort.factors``, which one pass counts for all of them."""
    counted = wh.repeat_cells.where(F.col("factor") == name)
    named = [F.col(c).alias(n) for c, n in zip("ab", groups)]
    return rates_of(counted.select(*named, "clientes", "k"), groups, min_group, interval)


def repeat_by_channel(wh: Warehouse) -> DataFrame:
    """Customers whose first booking was paid, e-mail left out."""
    return rates_by(wh, "canal", "canal", interval=True)


def repeat_channel_by_free(wh: Warehouse) -> DataFrame:
    rates = rates_by(wh, "canal_tipo", "canal", "tipo_primera")
    return rates.orderBy(F.desc("tipo_primera"), F.desc("pct_recompra"), "canal")


def _cells(wh: Warehouse) -> DataFrame:
    """Channel by destination, of known tours, e-mail left out."""
    return wh.repeat_cells.where(F.col("factor") == "canal_destino").select(
        F.col("a").alias("canal"), F.col("b").alias("destino"), F.col("clientes").alias("n"), "k"
    )


def repeat_channel_std(wh: Warehouse) -> DataFrame:
    return standardised(_cells(wh), "canal", "destino", "pct_estandarizado_a_destino")


def destination_std(wh: Warehouse) -> DataFrame:
    return standardised(_cells(wh), "destino", "canal", "pct_estandarizado_a_canal")


def repeat_by_free(wh: Warehouse) -> DataFrame:
    return rates_by(wh, "primera_reserva", "primera_reserva", interval=True)


def repeat_by_destination(wh: Warehouse) -> DataFrame:
    return rates_by(wh, "destino", "destino", interval=True)


def factor(wh: Warehouse, bucket: Column, min_group: int = L.MIN_GROUP_REPORT) -> DataFrame:
    """Repeat rate by any bucket of the first booking, small groups left out."""
    return repeat_rate(base(wh), {"grupo": bucket}, min_group=min_group)


def factor_amount(wh: Warehouse, edges: Sequence[int] = L.AMOUNT_EDGES) -> DataFrame:
    if tuple(edges) == tuple(L.AMOUNT_EDGES):
        return rates_by(wh, "importe", "grupo", min_group=L.MIN_GROUP_REPORT)
    return factor(wh, amount_bucket(F.col("importe_eur"), edges))


def factor_party_size(wh: Warehouse) -> DataFrame:
    return rates_by(wh, "personas", "grupo", min_group=L.MIN_GROUP_REPORT)


def factor_lead_time(wh: Warehouse) -> DataFrame:
    return rates_by(wh, "antelacion", "grupo", min_group=L.MIN_GROUP_REPORT)


def factor_campaign(wh: Warehouse) -> DataFrame:
    return rates_by(wh, "campana", "grupo", min_group=L.MIN_GROUP_REPORT)


def factor_device(wh: Warehouse) -> DataFrame:
    """By usual device; both sides hold one row per customer."""
    customers = base(wh).join(wh.usual_device, "user_id", "inner")
    return repeat_rate(customers, {"grupo": F.col("device")})


AGE_BANDS = ((29, "<30"), (44, "30-44"), (59, "45-59"))


def age_in_years(born: Column, on: Column) -> Column:
    birthday_ahead = F.month(on) * 100 + F.day(on) < F.month(born) * 100 + F.day(born)
    return F.year(on) - F.year(born) - birthday_ahead.cast("int")


def factor_age(wh: Warehouse, min_group: int = L.MIN_GROUP_REPORT) -> DataFrame:
    """By age at the first booking. The bands are ours: <30, 30-44, 45-59, 60+."""
    born = wh.customers.select("user_id", "fecha_nacimiento")
    age = age_in_years(F.col("fecha_nacimiento"), F.col("fr"))
    band = F.when(age.isNull(), L.NULL_GROUP)
    for top, name in AGE_BANDS:
        band = band.when(age <= top, name)
    customers = base(wh).join(born, "user_id", "inner")
    return repeat_rate(customers, {"grupo": band.otherwise("60+")}, min_group=min_group)


def churn_cancelled_flag(wh: Warehouse) -> DataFrame:
    """Do customers who ever cancelled come back less?"""
    return rates_by(wh, "cancelacion", "grupo")


def churn_return_after_cancel(wh: Warehouse) -> DataFrame:
    """Of those whose first decided booking was cancelled, who confirmed one on a later day.

    One row per user leaves the ranking; the last confirmed day is an aggregate. Unknown
    users count as one customer that never returned.
    """
    decided = wh.bookings.where(is_state(*L.RESOLVED)).select(
        "user_id", "reserva_id", "fecha_reserva", is_state(L.CANCELLED).alias("cancelada")
    )
    first = (
        decided.withColumn("rn", F.row_number().over(booking_order()))
        .where("rn = 1")
        .where("cancelada")
        .select("user_id", F.to_date("fecha_reserva").alias("fr"))
    )
    last = (
        wh.bookings.where(is_state(L.CONFIRMED) & F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.max(F.to_date("fecha_reserva")).alias("ultima_fr"))
    )
    came_back = F.coalesce(F.col("ultima_fr") > F.col("fr"), F.lit(False))
    return first.join(last, "user_id", "left").agg(
        n_rows().alias("clientes_cancelan_su_1a"),
        mean_pct(F.count_if(came_back), n_rows()).alias("pct_compra_confirmada_despues"),
    )


def repeat_timing(wh: Warehouse, days: int = L.EARLY_REPEAT_DAYS) -> DataFrame:
    """Share of the repeat purchases made within some days of the first activity."""
    wait = days_between(F.col("fa"), F.col("sig_fr"))
    early = F.count_if(wait <= days)
    return (
        base(wh)
        .where("recompra = 1")
        .agg(
            n_rows().alias("recompran"),
            early.alias("recompran_pronto"),
            pct(early, n_rows()).alias("pct_pronto"),
        )
    )


def free_same_trip(wh: Warehouse, days: int = L.SAME_TRIP_DAYS) -> DataFrame:
    """Customers who started with a free tour and paid for a second one on the same trip."""
    near = days_between(F.col("fr"), F.col("sig_fr")) <= days
    paid = near & (F.col("sig_importe") > 0)
    return (
        wh.firsts.where(F.col("user_id").isNotNull() & (F.col("importe_eur") == 0))
        .agg(
            n_rows().alias("clientes_free"),
            F.count_if(paid).alias("segunda_de_pago"),
            F.sum(F.when(paid, F.col("sig_importe"))).alias("importe"),
        )
        .select(
            "clientes_free",
            "segunda_de_pago",
            pct(F.col("segunda_de_pago"), F.col("clientes_free")).alias("pct_segunda_de_pago"),
            rnd(mean(F.col("importe"), F.col("segunda_de_pago")), 1).alias("ticket_medio"),
        )
    )
