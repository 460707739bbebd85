from __future__ import annotations

import pytest

from tests.conftest import by, day, rows
from tests.test_cohort import booking
from wayfare.plans import quality as Q


@pytest.fixture(scope="module")
def wh(make):
    copy = booking(1, "2025-03-10", "2025-04-10", campana=None, canal="SEM")
    return make.warehouse(
        customers=[
            dict(user_id=1, dni="a", fecha_baja=day("2020-01-11")),
            dict(user_id=2, dni="A", fecha_alta=day("2030-01-01")),
            dict(user_id=3, dni=None, fecha_nacimiento=day("1900-01-01"), fecha_baja=day("2031-01-01")),
        ],
        providers=[dict(proveedor_id=1, fecha_baja=day("2025-03-31"))],
        tours=[dict(tour_id=1), dict(tour_id=8, proveedor_id=1099)],
        bookings=[
            {**copy, "reserva_id": 900001},
            {**copy, "reserva_id": 1400001},
            {**copy, "reserva_id": 1499999},
            booking(2, "2025-03-10", "2025-03-20", reserva_id=900003, personas=-1),
            booking(3, "2025-04-01", "2025-04-02", reserva_id=900004, tour_id=8, personas=0),
        ],
        events=[
            dict(cookie_id="k", user_id=1, reserva_id=900001),
            dict(cookie_id="k", user_id=2, device="desktop"),
            dict(cookie_id="k", temp_client_id="T9", event_date="01/02/2025 10:00"),
            dict(cookie_id="l", user_id=3, session_id="s9", reserva_id=1499999),
            dict(cookie_id="k", user_id=3, event_date="?"),
        ]
        + [dict(cookie_id="bot", session_id="s8", temp_client_id="Tbot0000000")] * 20,
    )


def test_copies(wh):
    assert rows(Q.dq_duplicate_bookings(wh)) == [
        (1400001, 900001, True, True), (1499999, 900001, False, False),
    ]
    assert rows(Q.dq_booking_id(wh)) == [("reserva_id repetido", 0, 5, 0.0)]


def test_tracking_gap(wh):
    got = rows(Q.tracking_gap(wh, day("2025-03-10"), day("2025-03-15")))
    assert got == [(day("2025-03-10"), 2, 1, 50.0)]


def test_identity(wh):
    # users 1 and 2 are the same person, user 3 is somebody else
    assert rows(Q.dq_cookie_user(wh)) == [("cookie con varios usuarios", 1, 2, 50.0)]
    got = by(Q.dq_client_cookie(wh), "comprobacion")
    assert got["temp_client_id con varios usuarios"]["n"] == 1
    assert got["temp_client_id en varias cookies"]["n"] == 1
    assert got["temp_client_id en varias cookies"]["total"] == 2
    assert rows(Q.identity_recovery(wh)) == [(25, 21, 20, 1, 4.0, 4.76)]


def test_bots(wh):
    assert rows(Q.bot_candidates(wh, 2.0)) == [("bot", 20)]
    assert rows(Q.bot_candidates(wh, 5.0)) == []


def test_formats(wh):
    got = {k: v["n"] for k, v in by(Q.dq_event_date_formats(wh), "comprobacion").items()}
    assert got == {"aaaa-mm-dd hh:mm:ss": 23, "dd/mm/aaaa hh:mm": 1, "sin interpretar": 1}


def test_session_keys(wh):
    got = {k: v["n"] for k, v in by(Q.dq_session_keys(wh), "comprobacion").items()}
    assert got == {"sesion con varias cookies": 0, "sesion con varios dispositivos": 1}


def test_campaigns(wh):
    assert rows(Q.dq_campaign_missing(wh)) == [("SEM", 1, 1, 100.0), ("SEO", 2, 0, 0.0)]


def test_providers(wh):
    got = by(Q.dq_provider_after_end(wh), "comprobacion")
    assert got["reserva posterior a la baja"]["reservas"] == 1
    assert got["actividad posterior a la baja"]["reservas"] == 2
    assert got["actividad posterior a la baja"]["pct_confirmadas"] == 100.0
    assert rows(Q.dq_orphan_provider(wh)) == [(1099, 1, 1)]


def test_party_size(wh):
    assert rows(Q.dq_party_size(wh)) == [(2, 5, 40.0, 1, 2, 100.0, 50.0)]


def test_customer_dates(wh):
    # the last booking day, 2025-04-01, is today
    assert rows(Q.dq_customer_dates(wh)) == [(3, 1, 1, 10, 4018, 2014.0, 1, 1)]
    assert Q.dq_customer_dates(wh, day("2032-01-01")).first().alta_futura == 0
