"""Every query by name, with the parameters used on the benchmark's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators import cleaning, identity
from wayfare.plans import business, dashboard, quality, repeat
from wayfare.plans.dashboard import Filters
from wayfare.plans.report import CHECKS, metrics, write_report
from wayfare.schemas import BOOKINGS
from wayfare.sources.warehouse import Warehouse, slim_events

# The benchmark's bookings lie in 1995-2001, its amounts are far above travel prices and
# its events lie in January 2024; the product's own defaults would select nothing.
SALES_SINCE = dt.date(1995, 7, 1)
AMOUNT_EDGES = (50_000, 100_000, 200_000)
CHANNELS = ("Afiliados", "Directo", "SEM", "SEO", "Social")
DESTINATIONS = tuple(f"brand-{i}" for i in range(1, 16))
SALES = Filters(dt.date(1996, 1, 1), dt.date(1998, 12, 31), CHANNELS, DESTINATIONS, "month")
ONE_YEAR = Filters(dt.date(1997, 1, 1), dt.date(1997, 12, 31), CHANNELS, DESTINATIONS, "month")
COHORT = Filters(dt.date(1995, 1, 1), dt.date(1998, 12, 31), CHANNELS, DESTINATIONS, "month")
TRAFFIC = Filters(dt.date(2024, 1, 5), dt.date(2024, 1, 25), grain="week")
GAP = (dt.date(1996, 3, 10), dt.date(1996, 3, 15))
BOT_TIMES_AVERAGE = 1.5

Query = Callable[[Warehouse], DataFrame]


def _with_plain_money(query: Query, wh: Warehouse) -> DataFrame:
    """Money as DOUBLE in what leaves the library; tables and sums keep exact decimals."""
    df = query(wh)
    money = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in money}) if money else df


def _clean_bookings(wh: Warehouse) -> DataFrame:
    return wh.clean_bookings


def _canonical_bookings(wh: Warehouse, keep_unknown: bool = False) -> DataFrame:
    raw, clean = wh.raw_bookings, wh.clean_bookings
    crosswalk = wh.crosswalk
    size = wh.size("crosswalk_clientes")
    canonical = identity.canonical_bookings(clean, raw, crosswalk, keep_unknown, size)
    return canonical.select(*BOOKINGS.names)


def _identified_events(wh: Warehouse) -> DataFrame:
    clean = cleaning.clean_events(wh.raw_events)
    identities = wh.identities
    return identity.flag_bots(identity.identify_events(clean, identities, wh.size("identidades")))


def _crosswalk(wh: Warehouse) -> DataFrame:
    groups = wh.document_groups
    size = wh.size("grupos_documento")
    return identity.customer_crosswalk(wh.raw_customers, groups=groups, size=size)


def _report_of_destinations(wh: Warehouse) -> DataFrame:
    """Two tables of the written report, read back and put side by side."""
    paths = write_report(wh, wh.path("informe"), questions=("destinos",))
    at = {path.rsplit("/", 1)[-1]: wh.spark.read.parquet(path) for path in paths}
    volume = at["destination_volume"].select("destino", "reservas", "revenue", "pct_reservas")
    people = at["destination_ticket"].select(F.col("destino").alias("_de"), "personas_medias")
    return volume.join(people, F.col("destino").eqNullSafe(F.col("_de"))).drop("_de")


def _destination_table(wh: Warehouse) -> DataFrame:
    return dashboard.destination_table(wh, SALES, COHORT)


def queries() -> dict[str, Query]:
    prepared: dict[str, Query] = {
        "clean_bookings": _clean_bookings,
        "clean_customers": lambda wh: cleaning.clean_customers(wh.raw_customers),
        "clean_events": lambda wh: cleaning.clean_events(wh.raw_events),
        "clean_tours": lambda wh: cleaning.clean_tours(wh.raw_tours),
        "customer_crosswalk": _crosswalk,
        "customer_crosswalk_distinct_nulls": lambda wh: identity.customer_crosswalk(
            wh.raw_customers, distinct_nulls=True
        ),
        "bookings_canonical": _canonical_bookings,
        "bookings_canonical_keep_unknown": partial(_canonical_bookings, keep_unknown=True),
        "events_identified": _identified_events,
        "events_slim": lambda wh: slim_events(wh.events),
        "bookings_stored": lambda wh: wh.bookings,
        "report_destinations": _report_of_destinations,
    }
    reported = metrics() | {
        "factor_amount": partial(repeat.factor_amount, edges=AMOUNT_EDGES),
        "sales_by_semester": partial(business.sales_by_semester, since=SALES_SINCE),
        "sales_growth": partial(business.sales_growth, since=SALES_SINCE),
    }
    filtered: dict[str, Query] = {
        "date_bounds": dashboard.date_bounds,
        "volume_start": dashboard.volume_start,
        "date_presets": dashboard.date_presets,
        "filter_domains": dashboard.filter_domains,
        "kpi_vs_previous": partial(dashboard.kpi_vs_previous, f=ONE_YEAR),
        "destination_table": _destination_table,
        "destination_table_one_filter": partial(dashboard.destination_table, f=SALES),
    }
    for f, functions in (
        (
            SALES,
            (
                dashboard.bookings_filtered,
                dashboard.period_kpis,
                dashboard.amount_series,
                dashboard.cancel_series,
                dashboard.cancel_by_lead_filtered,
                dashboard.cancel_by_channel_filtered,
            ),
        ),
        (
            COHORT,
            (
                dashboard.cohort_filtered,
                dashboard.cohort_kpis,
                dashboard.cohort_factor_channel,
                dashboard.cohort_factor_free,
                dashboard.cohort_factor_destination,
                dashboard.cohort_factor_campaign,
                dashboard.cohort_factor_device,
            ),
        ),
        (
            TRAFFIC,
            (
                dashboard.sessions_filtered,
                dashboard.traffic_kpis,
                dashboard.sessions_series,
                dashboard.device_conversion,
                dashboard.funnel_long,
            ),
        ),
    ):
        filtered |= {fn.__name__: partial(fn, f=f) for fn in functions}
    checked = CHECKS | {
        "tracking_gap": partial(quality.tracking_gap, since=GAP[0], until=GAP[1]),
        "bot_candidates": partial(quality.bot_candidates, times_average=BOT_TIMES_AVERAGE),
    }
    every = prepared | reported | filtered | checked
    return {name: partial(_with_plain_money, query) for name, query in every.items()}
