"""What the physical plans must and must not contain."""

from __future__ import annotations

import datetime as dt
import os
import re
from dataclasses import replace

import pytest

import __spark_entry__ as entry_module
from wayfare import catalogue
from wayfare.operators.cohort import cohort, factors, first_bookings, mature, user_histories
from wayfare.operators.rates import repeat_cells
from wayfare.plans import dashboard
from wayfare.sources.warehouse import TABLES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables not here")

# a window or an aggregate over everything is fine on these: they hold one row per group
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def wh(spark):
    return entry_module.warehouse(spark, SF_DIR)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_no_cross_joins_and_no_python(wh, name):
    text = plan(catalogue.queries()[name](wh))
    assert not [bad for bad in FORBIDDEN if bad in text]


def test_histories_take_one_scan_and_one_exchange_of_the_bookings(wh):
    """Rankings, totals and cutoffs of both cohorts; what follows is a row per user and part."""
    text = plan(user_histories(wh.bookings, wh.hot_users))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert len([line for line in scans if "fecha_reserva" in line]) == 1
    assert len(scans) == 2 and "_hot_user_id" in "".join(scans)
    exchanges = [line for line in text.splitlines() if " Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and "_part" in exchanges[1] and "_part" not in exchanges[0]
    for cohort in (False, True):
        firsts = plan(first_bookings(wh.histories, with_tour_only=cohort))
        assert "Exchange hashpartitioning" not in firsts and "fecha_reserva" not in firsts


def test_bookings_without_copies_are_not_shuffled_to_find_them(wh):
    """Only those with a shared code reach the aggregate; without a size to go by, Spark plans it."""
    text = plan(wh.clean_bookings)
    exchanges = [line for line in text.splitlines() if " Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "campana" in exchanges[0]
    below = text[text.index(exchanges[0]) :]
    assert below.index("LeftSemi") < below.index("FileScan")


def test_histories_are_merged_in_the_order_of_the_ranking(wh):
    text = plan(user_histories(wh.bookings, wh.hot_users))
    ranked = text[text.rindex("Exchange hashpartitioning", 0, text.index("Window [")) : text.index("Window [")]
    assert "SortAggregate" in ranked and "Sort [" not in ranked
    assert text.count("ObjectHashAggregate") == 2  # the users' parts, which are few


def test_sessions_are_checked_in_one_shuffle(wh):
    text = plan(catalogue.queries()["dq_session_keys"](wh))
    assert "Expand" not in text
    assert text.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in text  # codes of fixed width are kept in place


def test_building_a_query_starts_no_job(spark, wh):
    for name in TABLES:
        getattr(wh, name)
    queries = catalogue.queries()
    del queries["report_destinations"]  # which writes the tables that it reads back
    for query in queries.values():
        query(wh)
    spark.sparkContext.setJobGroup("building", "queries are built, not run")
    try:
        for name, query in queries.items():
            query(wh)
            started = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
            assert not started, name
        wh.bookings.count()
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_report_tables_by_factor_share_one_pass(wh):
    reads = [x for x in plan(repeat_cells(mature(cohort(wh.firsts)), factors())).splitlines() if "FileScan" in x]
    assert len([x for x in reads if "importe_eur" in x]) == 1 and len(reads) <= 2
    for name in (
        "repeat_by_channel", "repeat_channel_by_free", "repeat_by_free", "repeat_by_destination",
        "repeat_channel_std", "destination_std", "factor_party_size", "factor_lead_time",
        "factor_campaign", "churn_cancelled_flag",
    ):
        reads = [x for x in plan(catalogue.queries()[name](wh)).splitlines() if "FileScan" in x]
        assert reads and all("ReadSchema: struct<factor:string" in x for x in reads), name


PERIOD_QUERIES = (
    "period_kpis", "kpi_vs_previous", "amount_series", "cancel_series",
    "cancel_by_lead_filtered", "cancel_by_channel_filtered", "destination_table",
    "destination_table_one_filter",
)


@pytest.mark.parametrize("name", PERIOD_QUERIES)
def test_period_queries_read_no_booking(wh, name):
    """But for the first month with volume, which is not filtered by day."""
    reads = [line for line in plan(catalogue.queries()[name](wh)).splitlines() if "FileScan" in line]
    of_bookings = [line for line in reads if "fecha_reserva" in line]
    assert len(of_bookings) == (1 if name == "kpi_vs_previous" else 0)
    assert not [line for line in reads if "importe_eur" in line and "primeras" not in line and "fr#" not in line]
    assert [line for line in reads if "dia#" in line]


def scan_of(df) -> dict[str, str]:
    """The attributes of the only scan in the formatted plan."""
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    part = re.split(r"\n\(\d+\) ", text)
    scan = next(p for p in part if p.startswith("Scan parquet"))
    return dict(line.split(": ", 1) for line in scan.splitlines() if ": " in line)


def test_filters_and_columns_reach_the_scan(wh):
    scan = scan_of(dashboard.bookings_filtered(wh, catalogue.SALES).select("canal", "estado"))
    pushed = scan["PushedFilters"]
    for condition in ("GreaterThanOrEqual(fecha_reserva", "LessThan(fecha_reserva", "In(canal", "EqualTo(tour_conocido"):
        assert condition in pushed
    for unused in ("campana", "personas", "user_id"):
        assert unused not in scan["ReadSchema"]
    scan = scan_of(dashboard.cancel_by_channel_filtered(wh, catalogue.SALES))
    for condition in ("GreaterThanOrEqual(dia", "LessThanOrEqual(dia", "In(canal"):
        assert condition in scan["PushedFilters"]
    for unused in ("antelacion", "personas", "importe"):
        assert unused not in scan["ReadSchema"]


def test_a_period_opens_only_its_files(wh):
    wide = replace(catalogue.ONE_YEAR, since=dt.date(1900, 1, 1), until=dt.date(2100, 1, 1))
    none = replace(catalogue.ONE_YEAR, since=dt.date(1900, 1, 1), until=dt.date(1900, 2, 1))
    assert dashboard.bookings_filtered(wh, wide).inputFiles() == wh.bookings_between(None, None).inputFiles()
    assert dashboard.bookings_filtered(wh, none).collect() == []


def test_windows_without_a_key_sit_on_aggregates(wh):
    """A single-partition window may only follow an aggregate."""
    for name in ("destination_volume", "destination_demand", "sessions_known", "funnel_by_device"):
        lines = plan(catalogue.queries()[name](wh)).splitlines()
        below = lines[next(i for i, x in enumerate(lines) if "Window [" in x) :]
        assert next(x for x in below if "Aggregate" in x or "FileScan" in x).count("Aggregate")
