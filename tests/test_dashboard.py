from __future__ import annotations

import datetime as dt

import pytest

from tests.conftest import by, day, dicts, rows
from tests.test_cohort import booking
from wayfare.plans import dashboard as D
from wayfare.plans.dashboard import Filters

ALL = Filters(day("2025-01-01"), day("2025-12-31"), ("SEO", "SEM"), ("madrid", "roma"))


@pytest.fixture(scope="module")
def wh(make):
    return make.warehouse(
        tours=[dict(tour_id=1), dict(tour_id=2, url="https://h/es/roma/x/")],
        bookings=[
            booking(1, "2025-03-01", "2025-02-27", importe_eur=100),
            booking(2, "2025-03-31", "2025-04-20", importe_eur=0, tour_id=2, personas=0),
            booking(3, "2025-04-01", "2025-04-05", importe_eur=60, canal="SEM", estado="CANCELLED"),
            booking(4, "2025-04-02", "2025-04-05", importe_eur=30, canal="SEM", estado="Pendiente"),
            booking(5, "2025-04-02", "2025-04-05", importe_eur=30, canal="Email"),
            booking(6, "2025-04-02", "2025-04-05", importe_eur=30, tour_id=99),
            booking(7, "2024-12-31", "2025-01-05", importe_eur=80),
        ],
        events=[
            dict(session_id="a", cookie_id="k", user_id=1, event_date="2025-03-02 23:59:59"),
            dict(session_id="a", cookie_id="k", event_date="2025-03-03 00:00:01", event_name="purchase"),
            dict(session_id="b", cookie_id="l", event_date="05/03/2025 10:00", device="desktop"),
            dict(session_id="c", cookie_id="m", event_date="2025-03-05 10:00:00", device=None),
            dict(session_id="d", cookie_id="n", event_date="2025-03-05 10:00:00", temp_client_id="Tbot0000000"),
        ],
    )


def test_filter_bounds_are_inclusive_days(wh):
    f = Filters(day("2025-03-31"), day("2025-04-01"), ALL.channels, ALL.destinations)
    assert {r.user_id for r in D.bookings_filtered(wh, f).collect()} == {2, 3}


def test_empty_selection_keeps_nothing(wh):
    f = Filters(ALL.since, ALL.until, (), ALL.destinations)
    assert D.bookings_filtered(wh, f).count() == 0
    assert rows(D.period_kpis(wh, f)) == [(None, 0, None, 0, None, None, 0.0)]


def test_no_selection_keeps_every_channel_and_destination(wh):
    everything = D.bookings_filtered(wh, Filters(ALL.since, ALL.until))
    assert {r.user_id for r in everything.collect()} == {1, 2, 3, 4, 5}


def test_values_are_not_spliced_into_sql(wh):
    f = Filters(ALL.since, ALL.until, ("SEO' OR '1'='1",), ALL.destinations)
    assert D.bookings_filtered(wh, f).count() == 0


def test_unknown_grain():
    with pytest.raises(ValueError):
        Filters(ALL.since, ALL.until, grain="year")


def test_previous_period():
    f = Filters(day("2025-03-01"), day("2025-03-31")).previous()
    assert (f.since, f.until) == (day("2025-01-29"), day("2025-02-28"))


def test_kpis(wh):
    assert rows(D.period_kpis(wh, ALL)) == [(100.0, 2, 60.0, 1, 30.0, 100.0, 100 / 3)]


def test_change_against_the_period_before(wh):
    got = dicts(D.kpi_vs_previous(wh, ALL))[0]
    assert (got["venta"], got["venta_previa"], got["n_confirmada_previa"]) == (100.0, 80.0, 1)
    # no month reaches 20 bookings: nothing to compare with
    assert got["comparable"] is False and got["delta_venta"] is None


def test_change_when_comparable(make):
    def month(number, n, **more):
        return [booking(u, f"2025-0{number}-{u:02d}", "2025-09-01", **more) for u in range(1, n + 1)]

    wh = make.warehouse(bookings=month(1, 20, importe_eur=10) + month(2, 25, importe_eur=10))
    f = Filters(day("2025-02-01"), day("2025-02-28"), ("SEO",), ("madrid",))
    # the 28 days before start on Jan 4: not before the first busy month, Jan 1
    got = dicts(D.kpi_vs_previous(wh, f))[0]
    assert got["comparable"] and (got["n_confirmada"], got["n_confirmada_previa"]) == (25, 17)
    assert (got["delta_venta"], got["delta_n"]) == (47.1, 47.1)
    g = Filters(day("2025-01-01"), day("2025-01-31"), ("SEO",), ("madrid",))
    assert dicts(D.kpi_vs_previous(wh, g))[0]["comparable"] is False
    presets = by(D.date_presets(wh), "rango")
    assert presets["con_volumen"]["desde"] == day("2025-01-01")
    assert presets["ultimos_365_dias"]["desde"] == day("2025-01-01")  # not before the data
    assert all(p["hasta"] == day("2025-02-25") for p in presets.values())
    chosen = Filters.preset(wh, "ultimos_90_dias", grain="week")
    assert (chosen.since, chosen.until, chosen.grain) == (day("2025-01-01"), day("2025-02-25"), "week")
    with pytest.raises(ValueError):
        Filters.preset(wh, "Ayer")


def test_bounds_and_domains(wh):
    assert rows(D.date_bounds(wh)) == [(day("2024-12-31"), day("2025-04-02"))]
    assert rows(D.volume_start(wh)) == [(None,)]
    assert rows(D.volume_start(wh, 2)) == [(day("2025-03-01"),)]
    assert rows(D.filter_domains(wh)) == [
        ("canal", "Email"), ("canal", "SEM"), ("canal", "SEO"),
        ("destino", "madrid"), ("destino", "roma"),
    ]


def test_series(wh):
    assert rows(D.amount_series(wh, ALL)) == [
        (day("2025-03-01"), "confirmada", 100.0, 2),
        (day("2025-04-01"), "cancelada", 60.0, 1),
        (day("2025-04-01"), "pendiente", 30.0, 1),
    ]
    assert rows(D.cancel_series(wh, ALL)) == []
    assert rows(D.cancel_series(wh, ALL, minimum=1)) == [
        (day("2025-03-01"), 0.0), (day("2025-04-01"), 100.0),
    ]


def test_lead_has_its_own_bucket_below_zero(wh):
    assert rows(D.cancel_by_lead_filtered(wh, ALL)) == [
        ("0-7 días", 100.0, 1), ("8-30 días", 0.0, 1), ("negativo", 0.0, 1),
    ]


def test_channel_rate_is_null_without_decided_bookings(wh):
    f = Filters(day("2025-04-02"), day("2025-04-02"), ALL.channels, ALL.destinations)
    assert rows(D.cancel_by_channel_filtered(wh, f)) == [("SEM", None, 0)]


def test_destination_table(wh):
    got = by(D.destination_table(wh, ALL), "destino")
    assert got["madrid"]["reservas"] == 1 and got["madrid"]["ticket_medio"] == 100.0
    assert got["roma"]["ticket_medio"] is None and got["roma"]["personas_medias"] is None
    assert got["roma"]["clientes"] is None  # no mature cohort: kept by the left join


def test_cohort_kpis(wh):
    got = dicts(D.cohort_kpis(wh, ALL))[0]
    assert got == dict(clientes=3, pct=0.0, censurados=3, pct_maduros=None, n_maduros=0)


MARCH = Filters(day("2025-03-01"), day("2025-03-31"), grain="week")


def test_sessions(wh):
    got = {r.session_id: tuple(r)[1:] for r in D.sessions_filtered(wh, MARCH).collect()}
    assert got == {
        "a": (day("2025-02-24"), 1, 1, 0, 1, "mobile"),
        "b": (day("2025-03-03"), 0, 1, 0, 0, "desktop"),
        "c": (day("2025-03-03"), 0, 1, 0, 0, None),
    }


def test_session_filter_applies_to_events_not_to_sessions(wh):
    f = Filters(day("2025-03-03"), day("2025-03-03"), grain="day")
    assert rows(D.sessions_filtered(wh, f)) == [("a", day("2025-03-03"), 1, 0, 0, 1, "mobile")]


def test_traffic(wh):
    assert rows(D.traffic_kpis(wh, MARCH)) == [(3, 33.3, 100.0, 1)]
    assert rows(D.sessions_series(wh, MARCH)) == [
        (day("2025-02-24"), "identificada", 1), (day("2025-03-03"), "anónima", 2),
    ]
    got = {(r.device, r.medida): r.pct for r in D.device_conversion(wh, MARCH).collect()}
    assert got == {
        ("mobile", "Bruto (todas las sesiones)"): 100.0,
        ("mobile", "Entre sesiones identificadas"): 100.0,
        ("desktop", "Bruto (todas las sesiones)"): 0.0,
        ("desktop", "Entre sesiones identificadas"): None,
    }


def test_funnel_always_has_six_rows(wh):
    f = Filters(dt.date(2025, 3, 5), dt.date(2025, 3, 5))
    got = {(r.etapa, r.tipo): r.pct for r in D.funnel_long(wh, f).collect()}
    assert len(got) == 6
    assert got["view_item", "anónima"] == 100.0 and got["view_item", "identificada"] is None
