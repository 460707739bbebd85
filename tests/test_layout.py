"""Files by ranges of a key, and what is known of a table without reading it."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import day, rows, when
from wayfare.plans import dashboard
from wayfare.plans.dashboard import Filters
from wayfare.sources import layout
from wayfare.sources.layout import file_count, micros, overlapping, write_ranges
from wayfare.sources.warehouse import Warehouse

DAYS = 3650


@pytest.fixture(scope="module")
def long_table(spark, tmp_path_factory):
    """Ten years of bookings: a third of them at one moment, a tenth without a time."""
    kind = F.col("id") % 30
    at = (
        F.when(kind < 10, F.lit("2020-06-01 12:00:00"))
        .when(kind < 27, F.concat(F.date_add(F.lit(dt.date(2015, 1, 1)), (F.col("id") % DAYS).cast("int")), F.lit(" 08:00:00")))
        .cast("timestamp_ntz")
    )
    path = str(tmp_path_factory.mktemp("layout") / "source")
    table = spark.range(60_000).select(F.col("id").alias("reserva_id"), at.alias("fecha_reserva"), F.sha2(F.col("id").cast("string"), 256).alias("texto"))
    table.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def laid_out(spark, long_table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "table")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(layout, "FILE_BYTES", 100_000)
        listed = write_ranges(long_table, path, "fecha_reserva", ["reserva_id"], long_table.columns)
    return path, listed


def test_files_are_cut_by_size_whatever_the_values(spark, long_table, laid_out):
    path, listed = laid_out
    table = spark.read.parquet(path)
    assert rows(table.agg(F.count("*"), F.count("fecha_reserva"), F.sum("reserva_id"))) == rows(
        long_table.agg(F.count("*"), F.count("fecha_reserva"), F.sum("reserva_id"))
    )
    sizes = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == len(listed) > 20
    # one moment holds a third of the rows, and no time a tenth: both fill many files
    assert max(sizes) < 3 * 60_000 / len(sizes)
    busy = micros(dt.date(2020, 6, 1)) + 12 * 3_600_000_000
    assert len([1 for _, first, last in listed if first == last == busy]) > len(listed) / 5


def test_a_range_needs_only_its_share_of_the_files(spark, laid_out):
    path, listed = laid_out
    table = spark.read.parquet(path)
    since, until = dt.date(2017, 3, 1), dt.date(2017, 5, 29)  # 90 days of 3650
    chosen = overlapping(listed, since, until)
    assert 0 < len(chosen) <= len(listed) * 90 / DAYS + 2
    inside = F.col("fecha_reserva").between(F.lit(since), F.lit(until + dt.timedelta(days=1)))
    part = spark.read.parquet(*[f"{path}/{name}" for name in chosen])
    assert part.where(inside).count() == table.where(inside).count() > 0
    # files next to each other share a moment at most
    ends = sorted((first, last) for _, first, last in listed if first is not None)
    assert all(last <= first for (_, last), (first, _) in zip(ends, ends[1:]))


@pytest.mark.parametrize(
    "since, until, expected",
    [
        (None, None, ["a", "b"]),
        (dt.date(1970, 1, 2), None, ["b"]),
        (None, dt.date(1970, 1, 1), ["a"]),
        (dt.date(1970, 1, 1), dt.date(1970, 1, 2), ["a", "b"]),
        (dt.date(1970, 1, 4), dt.date(1970, 1, 9), []),
    ],
)
def test_overlapping_counts_whole_days(since, until, expected):
    listed = [("a", 0, micros(dt.date(1970, 1, 2)) - 1), ("b", micros(dt.date(1970, 1, 2)), micros(dt.date(1970, 1, 3))), ("c", None, None)]
    assert overlapping(listed, since, until) == expected


def test_file_count():
    assert file_count(0, 8) == file_count(layout.LEAST_BYTES, 8) == 1
    assert file_count(3 * layout.LEAST_BYTES, 8) == 3
    assert file_count(100 * layout.LEAST_BYTES, 8) == 8
    assert file_count(100 * 1024**4, 8) == 100 * 1024**4 // layout.FILE_BYTES


def test_a_period_opens_its_files_and_finds_the_same(spark, make, tmp_path, monkeypatch):
    months = [when(f"20{y}-{m:02d}-05 10:00:00") for y in (23, 24) for m in range(1, 13)]
    bookings = [dict(user_id=u, fecha_reserva=t) for t in months for u in range(1, 6)]
    wh = make.warehouse(bookings=bookings + [dict(fecha_reserva=None)])
    whole = wh.bookings
    # the same table in a file for each third of a year
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        monkeypatch.setattr("wayfare.sources.layout.file_bytes", lambda df: 6 * layout.FILE_BYTES)
        cut = Warehouse(spark, str(tmp_path / "cut"))
        cut._write("reservas", whole)
        cut._write("reservas_dia", wh.booking_days)
        cut._write("tours", wh.tours)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    f = Filters(day("2023-06-01"), day("2023-08-31"), ("SEO",), ("madrid",))
    again = Warehouse(spark, str(tmp_path / "cut"))  # what is known is read from the folder
    for copy in (cut, again):
        found = dashboard.bookings_filtered(copy, f)
        assert rows(found) == rows(dashboard.bookings_filtered(wh, f)) and len(rows(found)) == 15
        assert len(found.inputFiles()) < len(copy.bookings.inputFiles()) == 6
        assert rows(dashboard.period_kpis(copy, f)) == rows(dashboard.period_kpis(wh, f))
    empty = Filters(day("1990-01-01"), day("1990-12-31"), ("SEO",), ("madrid",))
    assert rows(dashboard.bookings_filtered(again, empty)) == []


def test_sizes_are_noted_when_a_table_is_written(spark, make, tmp_path):
    wh = make.warehouse(tours=[dict(tour_id=1), dict(tour_id=2, descripcion=None)])
    assert wh.tours.count() == 2
    size = wh.size("tours")
    text = wh.tours.selectExpr("sum(octet_length(url) + coalesce(octet_length(descripcion), 0) + octet_length(destino))").first()[0]
    assert (size.rows, size.text) == (2, text)
    assert Warehouse(spark, wh.folder).size("tours") == size
    assert wh.size("clientes") is None
    assert size.within(2) and not size.within(1) and not size.within(0)


def test_sessions_of_a_destination_are_counted_exactly(spark, make):
    """Bitmaps of days and blocks against ``count(DISTINCT)``, with sessions over many days."""
    from wayfare.operators.sessions import interest_days, session_numbers, sessions_in

    place = lambda k: f"https://h/es/{('madrid', 'roma', 'paris')[k % 3]}/t/"
    events = [
        dict(
            session_id=None if k % 97 == 0 else f"s{k % 700}", url=place(k * k), cookie_id=f"c{k}",
            event_date=f"2025-01-{1 + k % 28:02d} 10:00:00" if k % 50 else None,
        )
        for k in range(3000)
    ]
    wh = make.warehouse(events=events)
    expected = rows(
        wh.events.where("event_name = 'view_item'")
        .groupBy(F.split_part("url", F.lit("/"), F.lit(5)).alias("destino"))
        .agg(F.count_distinct("session_id"))
    )
    assert len(expected) >= 2
    assert rows(sessions_in(wh.interest_days, "destino")) == expected
    # blocks of numbers may be many: here each partition has its own
    numbers = session_numbers(wh.session_days).repartition(5).cache()
    assert numbers.select("numero").distinct().count() == numbers.count() == 700
    assert rows(sessions_in(interest_days(wh.events, numbers), "destino")) == expected
    plan = sessions_in(wh.interest_days, "destino")._jdf.queryExecution().executedPlan().toString()
    assert "session_id" not in plan
