from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import by, rows
from wayfare.operators import cleaning as C
from wayfare.operators.skew import Size
from wayfare.schemas import BOOKING_KEY


def test_copies_keep_the_lowest_id(make):
    raw = make.table("bookings", dict(reserva_id=1400001), dict(reserva_id=900001), dict(reserva_id=900002, user_id=2))
    assert [r[0] for r in rows(C.clean_bookings(raw).select("reserva_id"))] == [900001, 900002]


def test_copies_compare_raw_values(make):
    """Rows that only become equal by cleaning are no copies."""
    raw = make.table(
        "bookings",
        dict(estado="CANCELLED"), dict(estado="cancelada"),
        dict(personas=-1), dict(personas=None),
    )
    clean = C.clean_bookings(raw)
    assert rows(clean.select("estado", "personas")) == [
        ("cancelada", 2), ("cancelada", 2), ("confirmada", None), ("confirmada", None),
    ]


def test_copies_with_missing_values(make):
    empty = dict(user_id=None, campana=None, personas=None, tour_id=None)
    assert C.clean_bookings(make.table("bookings", empty, empty)).count() == 1


def test_only_bookings_with_a_shared_code_are_compared(make):
    """Codes may also be those of bookings without a copy; the rows are the same."""
    empty = dict(user_id=None, campana=None, personas=None, tour_id=None)
    raw = make.table(
        "bookings",
        *[dict(user_id=u) for u in (1, 2, 3, 1, 1)], empty, empty, dict(estado="CANCELLED"), dict(estado="cancelada"),
    )
    codes = C.repeated_codes(raw)
    assert codes.count() == 2
    every = raw.select(F.xxhash64(*BOOKING_KEY).alias("codigo")).distinct()
    for found in (codes, every):
        for size in (None, Size(6, 0)):
            kept = [r.reserva_id for r in C.clean_bookings(raw, found, size).orderBy("reserva_id").collect()]
            assert kept == [1, 2, 3, 6, 8, 9]
    assert sorted((r.reserva_id_original, r._n) for r in C.booking_copies(raw, codes).collect()) == [(1, 3), (6, 2)]


def test_states_and_party_size(make):
    states = ("CONFIRMADA", "Cancelled", "cancelada", "Pendiente", None)
    raw = make.table("bookings", *[dict(estado=s, user_id=i) for i, s in enumerate(states)])
    assert [r.estado for r in C.clean_bookings(raw).orderBy("user_id").collect()] == [
        "confirmada", "cancelada", "cancelada", "pendiente", None,
    ]
    raw = make.table("bookings", *[dict(personas=p, user_id=i) for i, p in enumerate((-3, 0, 1, None))])
    assert [r.personas for r in C.clean_bookings(raw).orderBy("user_id").collect()] == [
        None, None, 1, None,
    ]


def test_cleaning_twice_changes_nothing(make):
    raw = make.table("bookings", dict(), dict(), dict(estado="CANCELLED"), dict(personas=0))
    once = C.clean_bookings(raw)
    assert rows(C.clean_bookings(once)) == rows(once)


def test_customers(make):
    raw = make.table(
        "customers",
        dict(user_id=5, dni="ab1"), dict(user_id=3, dni="AB1"), dict(user_id=9, dni="X"),
        dict(user_id=7, dni=None), dict(user_id=8, dni=None, fecha_nacimiento=dt.date(1900, 1, 1)),
        dict(user_id=10, dni="Y", fecha_nacimiento=dt.date(1900, 1, 1)),
    )
    kept = by(C.clean_customers(raw), "user_id")
    assert set(kept) == {3, 7, 9, 10}  # missing documents form one group
    assert kept[10]["fecha_nacimiento"] is None
    assert kept[9]["fecha_nacimiento"] == dt.date(1980, 6, 15)
    assert {r.user_id for r in C.clean_customers(raw, distinct_nulls=True).collect()} == {3, 7, 8, 9, 10}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2025-03-05 09:07:01", dt.datetime(2025, 3, 5, 9, 7, 1)),
        ("05/03/2025 09:07", dt.datetime(2025, 3, 5, 9, 7)),
        ("5/3/2025 9:07", dt.datetime(2025, 3, 5, 9, 7)),
        ("2025-3-5 9:7:1", dt.datetime(2025, 3, 5, 9, 7, 1)),
        (" 05/03/2025  09:07 ", dt.datetime(2025, 3, 5, 9, 7)),
        ("5/3/25 9:07", dt.datetime(25, 3, 5, 9, 7)),
        ("2025-03-05 09:07:01.5", None),
        ("2025-03-05T09:07:01", None),
        ("2025-03-05 09:07", None),
        ("05/03/2025 09:07:11", None),
        ("2025-01-01 24:00:00", None),
        ("12025-01-01 00:00:00", None),
        ("005/03/2025 09:07", None),
        ("31/02/2025 09:07", None),
        ("2025-13-01 00:00:00", None),
        ("", None),
        (None, None),
        ("yesterday", None),
    ],
)
def test_event_timestamps(make, text, expected):
    got = C.clean_events(make.table("events", dict(event_date=text))).first()
    assert got.event_date == expected


def test_devices(make):
    names = ("Desktp", "DESKTOP", "mobile", None)
    raw = make.table("events", *[dict(device=d) for d in names])
    got = [r.device for r in C.clean_events(raw).orderBy("event_id").collect()]
    assert got == ["desktop", "desktop", "mobile", None]


def test_tours(make):
    raw = make.table(
        "tours",
        dict(tour_id=1, proveedor_id=1099, url="https://www.example.com/es/roma/x/"),
        dict(tour_id=2, proveedor_id=4, url="https://www.example.com"),
    )
    got = by(C.clean_tours(raw), "tour_id")
    assert (got[1]["proveedor_id"], got[1]["destino"]) == (None, "roma")
    assert (got[2]["proveedor_id"], got[2]["destino"]) == (4, "")


def test_orphan_tours(make):
    tours = make.table("tours", dict(tour_id=1, proveedor_id=77), dict(tour_id=2, proveedor_id=1), dict(tour_id=3, proveedor_id=None))
    providers = make.table("providers", dict(proveedor_id=1))
    assert [r.tour_id for r in C.orphan_tours(tours, providers).collect()] == [1]
