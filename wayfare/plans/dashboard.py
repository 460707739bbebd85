"""Filterable period reports: sales, cohort, destinations, traffic."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import labels as L
from wayfare.functions.exprs import (
    is_state,
    mean,
    n_rows,
    pct,
    period,
    raw_mean_pct,
    raw_pct,
    rnd,
    sum_if,
)
from wayfare.operators.cohort import exposure, repeated
from wayfare.operators.rates import retention_rate
from wayfare.operators.sessions import sessions
from wayfare.plans.traffic import session_type
from wayfare.schemas import BOOKINGS
from wayfare.sources.warehouse import Warehouse


@dataclass(frozen=True)
class Filters:
    """Date range (inclusive), channels, destinations and time grain of a report.

    ``None`` selects every channel or destination there is; an empty tuple selects nothing,
    as an emptied selection does.
    """

    since: dt.date
    until: dt.date
    channels: tuple[str, ...] | None = None
    destinations: tuple[str, ...] | None = None
    grain: str = "month"

    def __post_init__(self):
        if self.grain not in L.GRAINS:
            raise ValueError(f"unknown grain: {self.grain}")

    @classmethod
    def preset(cls, wh: Warehouse, name: str, **more) -> Filters:
        """One of the ready-made ranges of ``date_presets``."""
        if name not in L.PRESETS:
            raise ValueError(f"unknown range: {name}")
        chosen = date_presets(wh).where(F.col("rango") == name).first()
        return cls(chosen["desde"], chosen["hasta"], **more)

    def previous(self) -> Filters:
        """The period of equal length right before this one."""
        length = (self.until - self.since).days + 1
        return replace(
            self,
            since=self.since - dt.timedelta(days=length),
            until=self.since - dt.timedelta(days=1),
        )


def _day(column: str) -> Column:
    return F.to_date(F.col(column))


def _booked_between(f: Filters) -> Column:
    """Booking day in the range, as instants, which the files' footers can be compared with."""
    start = F.lit(f.since).cast("timestamp_ntz")
    end = F.lit(f.until + dt.timedelta(days=1)).cast("timestamp_ntz")
    return (F.col("fecha_reserva") >= start) & (F.col("fecha_reserva") < end)


def _selected(f: Filters) -> Column:
    def among(column: str, values: tuple[str, ...] | None) -> Column:
        return F.col(column).isNotNull() if values is None else F.col(column).isin(*values)

    return among("canal", f.channels) & among("destino", f.destinations)


# --- range and filter choices ------------------------------------------------


def date_bounds(wh: Warehouse) -> DataFrame:
    return wh.bookings.agg(
        F.min(_day("fecha_reserva")).alias("desde"), F.max(_day("fecha_reserva")).alias("hasta")
    )


def volume_start(wh: Warehouse, minimum: int = L.MIN_BOOKINGS_PER_MONTH) -> DataFrame:
    """First month with a relevant number of bookings."""
    return (
        wh.bookings.groupBy(period(F.col("fecha_reserva"), "month").alias("mes"))
        .agg(n_rows().alias("n"))
        .where(F.col("n") >= minimum)
        .agg(F.min("mes").alias("inicio"))
    )


def date_presets(wh: Warehouse) -> DataFrame:
    """The ready-made ranges: with volume, everything, last 12 / 6 months, last 90 days."""
    bounds = date_bounds(wh).withColumn("inicio", volume_start(wh).scalar())
    first, last = F.col("desde"), F.col("hasta")
    starts = [F.col("inicio"), first] + [
        F.greatest(first, F.date_sub(last, days)) for days in L.PRESET_DAYS
    ]
    ranges = F.array(
        *[
            F.struct(F.lit(name).alias("rango"), start.alias("desde"), last.alias("hasta"))
            for name, start in zip(L.PRESETS, starts)
        ]
    )
    return bounds.select(F.inline(ranges))


def filter_domains(wh: Warehouse) -> DataFrame:
    channels = wh.bookings.select(F.lit("canal").alias("filtro"), F.col("canal").alias("valor"))
    places = wh.tours.select(F.lit("destino").alias("filtro"), F.col("destino").alias("valor"))
    return channels.distinct().unionByName(places.distinct()).orderBy("filtro", "valor")


# --- sales -------------------------------------------------------------------


def bookings_filtered(wh: Warehouse, f: Filters) -> DataFrame:
    """Bookings of known tours in the range, channels and destinations."""
    return wh.bookings_between(f.since, f.until).where(
        _booked_between(f) & F.col("tour_conocido") & _selected(f)
    ).select(*BOOKINGS.names, "destino", "precio_por_persona_eur")


def booking_days_filtered(wh: Warehouse, f: Filters) -> DataFrame:
    """The daily counts and sums of the bookings that ``bookings_filtered`` selects."""
    days = F.col("dia").between(F.lit(f.since), F.lit(f.until))
    return wh.booking_days_between(f.since, f.until).where(days & _selected(f))


def _count(*states: str) -> Column:
    return F.coalesce(sum_if(is_state(*states), F.col("reservas")), F.lit(0).cast("long"))


def _paid_ticket() -> Column:
    confirmed = is_state(L.CONFIRMED)
    paid = sum_if(confirmed, F.col("pagadas"))
    return mean(sum_if(confirmed, F.col("importe_pagado")), paid)


def _cancel_rate() -> Column:
    return raw_pct(_count(L.CANCELLED), _count(*L.RESOLVED))


def period_kpis(wh: Warehouse, f: Filters) -> DataFrame:
    def amount(state: str) -> Column:
        return sum_if(is_state(state), F.col("importe")).cast("double")

    return booking_days_filtered(wh, f).agg(
        amount(L.CONFIRMED).alias("venta"),
        _count(L.CONFIRMED).alias("n_confirmada"),
        amount(L.CANCELLED).alias("cancelado"),
        _count(L.CANCELLED).alias("n_cancelada"),
        amount(L.PENDING).alias("pendiente"),
        _paid_ticket().alias("ticket_medio"),
        F.coalesce(_cancel_rate(), F.lit(0.0)).alias("tasa_cancelacion"),
    )


def delta(value: Column, before: Column) -> Column:
    """Change in %; none when there is nothing to compare with."""
    return rnd(raw_pct(F.coalesce(value, F.lit(0)) - before, before), 1)


def kpi_vs_previous(wh: Warehouse, f: Filters) -> DataFrame:
    """Confirmed sales now and in the period before, in one pass over both.

    Changes are left empty when the earlier period starts before there was real volume.
    """
    earlier = f.previous()
    both = replace(f, since=earlier.since)
    now = F.col("dia") >= F.lit(f.since)
    confirmed = is_state(L.CONFIRMED)

    def count(condition: Column) -> Column:
        return F.coalesce(sum_if(condition, F.col("reservas")), F.lit(0).cast("long"))

    totals = booking_days_filtered(wh, both).agg(
        sum_if(confirmed & now, F.col("importe")).cast("double").alias("venta"),
        count(confirmed & now).alias("n_confirmada"),
        sum_if(confirmed & ~now, F.col("importe")).cast("double").alias("venta_previa"),
        count(confirmed & ~now).alias("n_confirmada_previa"),
    )
    comparable = F.lit(earlier.since) >= volume_start(wh).scalar()
    return totals.withColumn("comparable", F.coalesce(comparable, F.lit(False))).select(
        *totals.columns,
        "comparable",
        F.when(F.col("comparable"), delta(F.col("venta"), F.col("venta_previa"))).alias(
            "delta_venta"
        ),
        F.when(
            F.col("comparable"), delta(F.col("n_confirmada"), F.col("n_confirmada_previa"))
        ).alias("delta_n"),
    )


def amount_series(wh: Warehouse, f: Filters) -> DataFrame:
    return (
        booking_days_filtered(wh, f)
        .groupBy(period(F.col("dia"), f.grain).alias("periodo"), "estado")
        .agg(
            F.sum("importe").cast("double").alias("importe"), F.sum("reservas").alias("reservas")
        )
        .orderBy("periodo", "estado")
    )


def cancel_series(
    wh: Warehouse, f: Filters, minimum: int = L.MIN_RESOLVED_PER_PERIOD
) -> DataFrame:
    return (
        booking_days_filtered(wh, f)
        .groupBy(period(F.col("dia"), f.grain).alias("periodo"))
        .agg(_cancel_rate().alias("pct_cancelacion"), _count(*L.RESOLVED).alias("n"))
        .where(F.col("n") >= minimum)
        .drop("n")
        .orderBy("periodo")
    )


def cancel_by_lead_filtered(wh: Warehouse, f: Filters) -> DataFrame:
    return (
        booking_days_filtered(wh, f)
        .groupBy("antelacion")
        .agg(_cancel_rate().alias("pct_cancelacion"), _count(*L.RESOLVED).alias("reservas"))
    )


def cancel_by_channel_filtered(wh: Warehouse, f: Filters) -> DataFrame:
    return (
        booking_days_filtered(wh, f)
        .groupBy("canal")
        .agg(_cancel_rate().alias("pct_cancelacion"), _count(*L.RESOLVED).alias("reservas"))
        .orderBy(F.desc("pct_cancelacion"), "canal")
    )


# --- repeat cohort -----------------------------------------------------------


def cohort_filtered(wh: Warehouse, f: Filters, rule: str = "next") -> DataFrame:
    """Customers whose first activity falls in the range.

    Channel and destination are those of the first booking, so they filter after ranking.
    """
    return wh.firsts_with_tour.where(
        F.col("fa").between(F.lit(f.since), F.lit(f.until)) & _selected(f)
    ).select(
        "user_id",
        "canal",
        "campana",
        "importe_eur",
        "tour_id",
        "destino",
        F.col("fa").alias("fa1"),
        repeated(rule).alias("recurrente"),
        exposure().alias("dias_exposicion"),
    )


def _is_mature() -> Column:
    return F.col("dias_exposicion") >= L.MATURE_DAYS


def _mature(wh: Warehouse, f: Filters) -> DataFrame:
    return cohort_filtered(wh, f).where(_is_mature())


def cohort_kpis(wh: Warehouse, f: Filters) -> DataFrame:
    back, ripe = F.col("recurrente"), _is_mature()
    return cohort_filtered(wh, f).agg(
        n_rows().alias("clientes"),
        mean(F.count_if(back), n_rows()).alias("pct"),
        F.count_if(~ripe).alias("censurados"),
        mean(F.count_if(back & ripe), F.count_if(ripe)).alias("pct_maduros"),
        F.count_if(ripe).alias("n_maduros"),
    )


def cohort_factor(
    wh: Warehouse, f: Filters, factor: Column, minimum: int = L.MIN_GROUP_DASHBOARD
) -> DataFrame:
    return retention_rate(_mature(wh, f), factor, "factor", minimum).orderBy(
        F.desc("pct_retencion"), "factor"
    )


def cohort_factor_channel(wh: Warehouse, f: Filters) -> DataFrame:
    return cohort_factor(wh, f, F.col("canal"))


def cohort_factor_free(wh: Warehouse, f: Filters) -> DataFrame:
    kind = F.when(F.col("importe_eur") == 0, L.DASH_FREE).otherwise(L.DASH_PAID)
    return cohort_factor(wh, f, kind)


def cohort_factor_destination(wh: Warehouse, f: Filters) -> DataFrame:
    return cohort_factor(wh, f, F.col("destino"))


def cohort_factor_campaign(wh: Warehouse, f: Filters) -> DataFrame:
    return cohort_factor(wh, f, F.coalesce("campana", F.lit(L.DASH_NO_CAMPAIGN)))


def cohort_factor_device(wh: Warehouse, f: Filters) -> DataFrame:
    customers = _mature(wh, f).join(wh.usual_device, "user_id", "inner")
    return (
        customers.groupBy(F.col("device").alias("factor"))
        .agg(
            n_rows().alias("clientes"),
            raw_mean_pct(F.count_if("recurrente"), n_rows()).alias("pct_retencion"),
        )
        .orderBy(F.desc("pct_retencion"), "factor")
    )


# --- destinations ------------------------------------------------------------


def destination_table(wh: Warehouse, f: Filters, cohort: Filters | None = None) -> DataFrame:
    """Bookings of the period per destination next to the repeat rate of its cohort.

    The cohort takes the same filters unless others are given.
    """
    confirmed = is_state(L.CONFIRMED)
    people = sum_if(confirmed, F.col("personas"))
    volume = (
        booking_days_filtered(wh, f)
        .groupBy("destino")
        .agg(
            _count(L.CONFIRMED).alias("reservas"),
            sum_if(confirmed, F.col("importe")).cast("double").alias("revenue"),
            _paid_ticket().alias("ticket_medio"),
            mean(people, sum_if(confirmed, F.col("con_personas"))).alias("personas_medias"),
        )
    )
    retention = (
        _mature(wh, cohort or f)
        .groupBy("destino")
        .agg(
            n_rows().alias("clientes"),
            raw_mean_pct(F.count_if("recurrente"), n_rows()).alias("pct_retencion"),
        )
    )
    return volume.join(retention, "destino", "left").orderBy(F.desc("reservas"), "destino")


# --- traffic -----------------------------------------------------------------


def sessions_filtered(wh: Warehouse, f: Filters) -> DataFrame:
    """Sessions built from the events of the range only."""
    return sessions(wh.session_days_between(f.since, f.until), f.since, f.until).select(
        "session_id",
        period(F.col("inicio"), f.grain).alias("periodo"),
        "ident",
        "vi",
        "bc",
        "pu",
        "device",
    )


def traffic_kpis(wh: Warehouse, f: Filters) -> DataFrame:
    known, bought = F.sum("ident"), F.coalesce(F.sum("pu"), F.lit(0).cast("long"))
    return sessions_filtered(wh, f).agg(
        n_rows().alias("sesiones"),
        pct(known, n_rows()).alias("pct_identificadas"),
        pct(bought, known).alias("pct_conversion_identificadas"),
        bought.alias("compras"),
    )


def sessions_series(wh: Warehouse, f: Filters) -> DataFrame:
    return (
        sessions_filtered(wh, f)
        .groupBy("periodo", session_type(L.DASH_ANONYMOUS).alias("tipo"))
        .agg(n_rows().alias("sesiones"))
        .orderBy("periodo", "tipo")
    )


def device_conversion(wh: Warehouse, f: Filters) -> DataFrame:
    """Purchases per session and per identified session, one row per device and measure."""
    bought = F.coalesce(F.sum("pu"), F.lit(0))
    wide = (
        sessions_filtered(wh, f)
        .where(F.col("device").isNotNull())
        .groupBy("device")
        .agg(
            raw_pct(bought, n_rows()).alias(L.GROSS_RATE),
            raw_pct(bought, F.sum("ident")).alias(L.IDENTIFIED_RATE),
        )
    )
    return wide.unpivot("device", [L.GROSS_RATE, L.IDENTIFIED_RATE], "medida", "pct").orderBy(
        "device", "medida"
    )


def funnel_long(wh: Warehouse, f: Filters) -> DataFrame:
    """% of sessions per stage and session type: always six rows.

    One aggregate with both types side by side, so a type without sessions keeps its rows.
    """
    stages = {"vi": L.VIEW_ITEM, "bc": L.BEGIN_CHECKOUT, "pu": L.PURCHASE}
    types = {1: L.IDENTIFIED, 0: L.DASH_ANONYMOUS}
    cells = [
        (stage, kind, F.avg(F.when(F.col("ident") == value, F.col(flag))) * F.lit(100.0))
        for flag, stage in stages.items()
        for value, kind in types.items()
    ]
    one_row = sessions_filtered(wh, f).agg(
        *[rate.alias(f"c{i}") for i, (_, _, rate) in enumerate(cells)]
    )
    rows = [
        F.struct(
            F.lit(stage).alias("etapa"), F.lit(kind).alias("tipo"), F.col(f"c{i}").alias("pct")
        )
        for i, (stage, kind, _) in enumerate(cells)
    ]
    return one_row.select(F.inline(F.array(*rows)))
