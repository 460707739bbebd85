"""The whole batch job from CSV files."""

from __future__ import annotations

import datetime as dt

from pathlib import Path

import pytest

from tests.conftest import rows
from wayfare import etl, session
from wayfare.operators.cleaning import clean_bookings
from wayfare.plans import business, dashboard, quality
from wayfare.plans.dashboard import Filters
from wayfare.schemas import RAW
from wayfare.session import shared_folder
from wayfare.sources.raw import from_benchmark, from_csv, read_csv
from wayfare.sources.warehouse import LAYOUT, SLIM_EVENT_COLUMNS, Warehouse

FILES = {
    "clientes": """nombre,user_id,dni,email,fecha_nacimiento,fecha_alta,fecha_baja
Ana,1,A1,a@x,1980-01-01,2020-01-01,
Ana,2,a1,b@x,1980-01-01,2021-01-01,
Luis,3,B2,c@x,1900-01-01,2020-01-01,2027-01-01
""",
    "proveedores": """proveedor_id,nombre,fecha_baja
10,P,2025-06-30
11,Q,
""",
    "tours": """tour_id,proveedor_id,url,descripcion,precio_por_persona_eur
5001,10,https://www.example.com/es/madrid/uno/,"Madrid, centro",25.50
5008,1099,https://www.example.com/es/roma/dos/,Roma,30
""",
    "reservas": """reserva_id,user_id,tour_id,proveedor_id,fecha_reserva,fecha_actividad,estado,personas,importe_eur,campana,canal
900001,2,5001,10,2025-01-01 10:15:00,2025-01-05,Confirmada,2,51.00,C1,SEO
1400001,2,5001,10,2025-01-01 10:15:00,2025-01-05,Confirmada,2,51.00,C1,SEO
900002,1,5008,,2025-07-01 09:00:00,2025-07-03,confirmada,-1,0,,SEM
900003,3,5001,10,2025-08-01 09:00:00,2025-09-03,CANCELLED,4,102.00,,SEO
""",
    "ga_eventos": """cookie_id,session_id,temp_client_id,user_id,event_name,event_date,device,url,reserva_id,ip
k1,s1,T1,2,purchase,2025-01-01 10:14:00,Desktp,https://www.example.com/es/madrid/uno/,900001,1.1.1.1
k1,s2,T1,,view_item,05/02/2025 09:30,MOBILE,https://www.example.com/es/roma/dos/,,1.1.1.1
k2,s3,Tbot0000000,,view_item,2025-01-02 00:00:00,mobile,https://www.example.com/,,2.2.2.2
""",
}


@pytest.fixture(scope="module")
def raw_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


@pytest.fixture(scope="module")
def done(spark, raw_folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    etl.run(spark, raw_folder, out)
    return out


def test_types_follow_the_header_not_the_position(spark, raw_folder):
    df = read_csv(spark, f"{raw_folder}/clientes.csv", RAW["clientes"])
    assert df.columns[:2] == ["user_id", "dni"] and "nombre" in df.columns
    first = df.orderBy("user_id").first()
    assert (first.user_id, first.fecha_alta, first.nombre) == (1, dt.date(2020, 1, 1), "Ana")


def test_malformed_lines_are_kept_aside(spark, tmp_path):
    (tmp_path / "p.csv").write_text("proveedor_id,nombre,fecha_baja\n1,a,2025-01-01\nx,b,\n")
    got = read_csv(spark, str(tmp_path / "p.csv"), RAW["proveedores"]).cache()
    bad = got.where("_corrupt_record is not null").collect()
    assert got.count() == 2 and len(bad) == 1 and bad[0].proveedor_id is None


def test_missing_columns_are_an_error(spark, tmp_path):
    (tmp_path / "p.csv").write_text("proveedor_id,nombre\n1,a\n")
    with pytest.raises(ValueError, match="fecha_baja"):
        read_csv(spark, str(tmp_path / "p.csv"), RAW["proveedores"])


def test_tables(spark, done):
    wh = Warehouse(spark, f"{done}/tables")
    assert rows(wh.crosswalk) == [(1, 1), (2, 1), (3, 3)]
    got = rows(wh.bookings.select("reserva_id", "user_id", "fecha_reserva", "estado", "personas", "destino"))
    assert got == [
        (900001, 1, dt.datetime(2025, 1, 1, 10, 15), "confirmada", 2, "madrid"),
        (900002, 1, dt.datetime(2025, 7, 1, 9, 0), "confirmada", None, "roma"),
        (900003, 3, dt.datetime(2025, 8, 1, 9, 0), "cancelada", 4, "madrid"),
    ]
    events = {r.session_id: r for r in wh.events.collect()}
    assert events["s1"].device == "desktop" and events["s1"].ip == "1.1.1.1"
    assert events["s2"].user_id is None and events["s2"].user_id_propagado == 1
    assert events["s2"].event_date == dt.datetime(2025, 2, 5, 9, 30)
    assert events["s3"].es_bot and not events["s1"].es_bot
    assert wh.customers.count() == 2 and wh.providers.count() == 2
    assert "_corrupt_record" not in wh.customers.columns + wh.events.columns


def test_dashboard_copy(spark, done):
    slim = spark.read.parquet(f"{done}/dashboard/ga_eventos")
    assert tuple(slim.columns) == (*SLIM_EVENT_COLUMNS, "dia") and slim.count() == 3
    whole, copy = Warehouse(spark, f"{done}/tables"), Warehouse(spark, f"{done}/dashboard")
    f = Filters(dt.date(2024, 1, 1), dt.date(2026, 12, 31), grain="month")
    for query in (
        dashboard.bookings_filtered, dashboard.period_kpis, dashboard.amount_series,
        dashboard.cancel_series, dashboard.cancel_by_lead_filtered,
        dashboard.cancel_by_channel_filtered, dashboard.cohort_filtered, dashboard.cohort_kpis,
        dashboard.cohort_factor_channel, dashboard.cohort_factor_free,
        dashboard.cohort_factor_destination, dashboard.cohort_factor_campaign,
        dashboard.cohort_factor_device, dashboard.destination_table, dashboard.sessions_filtered,
        dashboard.traffic_kpis, dashboard.sessions_series, dashboard.device_conversion,
        dashboard.funnel_long, dashboard.kpi_vs_previous,
    ):
        assert rows(query(copy, f)) == rows(query(whole, f)), query.__name__
    for query in (dashboard.date_bounds, dashboard.volume_start, dashboard.filter_domains):
        assert rows(query(copy)) == rows(query(whole)), query.__name__
    # small tables are in few files
    assert all(len(list(Path(f"{done}/dashboard/{name}").glob("*.parquet"))) <= 4 for name in LAYOUT)


def test_malformed_lines_are_set_apart(spark, raw_folder, tmp_path):
    clean = Warehouse(spark, str(tmp_path / "clean"), from_csv(spark, raw_folder))
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, text in FILES.items():
        extra = "x,y,z,,not a date,,confirmada,many,much,,SEO\n" if name == "reservas" else ""
        (folder / f"{name}.csv").write_text(text + extra)
    wh = Warehouse(spark, str(tmp_path / "out"), from_csv(spark, str(folder)))
    assert rows(business.business_summary(wh)) == rows(business.business_summary(clean))
    counts = {r.tabla: (r.lineas, r.malformadas) for r in quality.dq_malformed_lines(wh).collect()}
    assert counts["reservas"] == (5, 1) and counts["tours"] == (2, 0)
    assert wh.rejected("bookings").first().linea.startswith("x,y,z")
    assert "_corrupt_record" not in wh.bookings.columns


def test_lines_are_counted_while_they_are_staged(spark, raw_folder, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "counted"), from_csv(spark, raw_folder))
    query = quality.dq_malformed_lines(wh)
    assert "FileScan" not in query._jdf.queryExecution().executedPlan().toString()
    assert {r.tabla: (r.lineas, r.malformadas) for r in query.collect()}["ga_eventos"] == (3, 0)
    again = Warehouse(spark, str(tmp_path / "counted"))
    assert rows(quality.dq_malformed_lines(again)) == rows(query)


def test_equal_lines_are_spread_by_block(spark, tmp_path):
    """Nine in ten lines are equal; their ids differ by block, so that salts spread them."""
    header, line = FILES["ga_eventos"].splitlines()[:2]
    lines = [line if k % 10 else line.replace("k1", f"k{k}") for k in range(20_000)]
    (tmp_path / "ga_eventos.csv").write_text("\n".join([header, *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        raw = read_csv(spark, str(tmp_path / "ga_eventos.csv"), RAW["ga_eventos"])
        blocks = raw.rdd.getNumPartitions()
        equal = raw.where("cookie_id = 'k1'").groupBy("event_id").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 10 and len(equal) == blocks
    assert max(r["count"] for r in equal) < 2 * 18_000 / blocks


def test_parts_with_another_column_order_stop_the_job(spark, tmp_path):
    parts = tmp_path / "proveedores.csv"
    parts.mkdir()
    (parts / "a.csv").write_text("proveedor_id,nombre,fecha_baja\n10,P,2025-06-30\n")
    (parts / "b.csv").write_text("nombre,proveedor_id,fecha_baja\n8,2,2025-06-30\n")
    with pytest.raises(Exception, match="CSV header"):
        read_csv(spark, str(parts), RAW["proveedores"]).collect()


def test_columns_beyond_the_schema_stay(spark, tmp_path):
    header, *lines = FILES["reservas"].splitlines()
    text = "\n".join([f"{header},agencia", *(f"{line},A{k}" for k, line in enumerate(lines))])
    (tmp_path / "reservas.csv").write_text(text)
    raw = read_csv(spark, str(tmp_path / "reservas.csv"), RAW["reservas"])
    kept = {r.reserva_id: r.agencia for r in clean_bookings(raw).collect()}
    assert kept == {900001: "A0", 900002: "A2", 900003: "A3"}


def test_every_documented_metric_is_written(done):
    written = {path.name for path in Path(f"{done}/report").glob("*/*")}
    for name in (
        "repeat_global_any", "repeat_timing", "free_same_trip", "factor_age",
        "cancel_by_destination", "sales_growth", "conversion_gross", "conversion_net",
    ):
        assert name in written


def test_report(spark, done):
    got = spark.read.parquet(f"{done}/report/repeticion/repeat_by_cohort")
    assert rows(got) == [(dt.date(2025, 1, 1), 1, 208, 100.0)]
    risk = spark.read.parquet(f"{done}/report/negocio/terminated_provider_risk")
    assert [r.proveedor_id for r in risk.collect()] == ["TOTAL"]


def test_checks(spark, done):
    copies = spark.read.parquet(f"{done}/checks/dq_duplicate_bookings")
    assert rows(copies) == [(1400001, 900001, True, True)]
    orphans = spark.read.parquet(f"{done}/checks/dq_orphan_provider")
    assert rows(orphans) == [(1099, 1, 1)]


def test_running_again_replaces_the_tables(spark, raw_folder, done):
    before = rows(Warehouse(spark, f"{done}/tables").bookings)
    etl.run(spark, raw_folder, done)
    assert rows(Warehouse(spark, f"{done}/tables").bookings) == before


def test_shuffles_widen_with_the_input(spark, raw_folder):
    before = session.shuffle_width(spark)
    advisory = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        assert session.size_shuffles(spark, 1000) == before  # never narrower
        # 100 TB: as many partitions as 128 MB each take, without an upper limit
        assert session.size_shuffles(spark, 100 * 1024**4) == 100 * 1024**4 * 2 // (128 * 1024**2)
        assert session.size_shuffles(spark, 1000, width=777) == 777
        # a small data set after a large one finds the session as it was
        assert session.size_shuffles(spark, 1000) == before
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == advisory
    finally:
        session.size_shuffles(spark, 0)


def test_scan_bytes_follow_the_columns(spark, small_sf="/root/testdata/sf0.001"):
    orders = spark.read.parquet(f"{small_sf}/orders.parquet")
    whole = session.scan_bytes(orders)
    assert whole == Path(f"{small_sf}/orders.parquet").stat().st_size
    assert session.scan_bytes(orders.select("o_orderkey").where("o_orderkey > 5")) < whole / 3
    assert from_benchmark(spark, small_sf).scan_bytes() > 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_options_reach_the_tables(spark, raw_folder, tmp_path):
    wh = Warehouse.scratch(spark, from_csv(spark, raw_folder), keep_unknown=True, distinct_nulls=True)
    assert {r.user_id for r in wh.bookings.collect()} == {1, 3}
    folder = Path(wh.folder.removeprefix("file:"))
    assert folder.is_dir()
    wh.close()
    assert not folder.exists()
