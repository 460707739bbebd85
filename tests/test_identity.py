from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import rows
from wayfare.operators import identity as I
from wayfare.operators.cleaning import clean_events


def customers(make):
    return make.table(
        "customers",
        dict(user_id=5, dni="ab1"), dict(user_id=3, dni="AB1"), dict(user_id=9, dni="X"),
        dict(user_id=7, dni=None), dict(user_id=8, dni=None),
    )


def test_crosswalk(make):
    raw = customers(make)
    assert rows(I.customer_crosswalk(raw)) == [(3, 3), (5, 3), (7, 7), (8, 7), (9, 9)]
    assert rows(I.customer_crosswalk(raw, distinct_nulls=True)) == [
        (3, 3), (5, 3), (7, 7), (8, 8), (9, 9),
    ]


def test_crosswalk_is_idempotent(make):
    xwalk = I.customer_crosswalk(customers(make))
    again = xwalk.select(F.col("user_id_canonico").alias("user_id")).distinct()
    assert rows(I.translate_users(again, xwalk, "user_id")) == rows(again)


def test_unknown_users_become_null(make):
    xwalk = I.customer_crosswalk(customers(make))
    raw = make.table("bookings", dict(user_id=5), dict(user_id=404), dict(user_id=None))
    ids = lambda df: [r.user_id for r in df.orderBy("reserva_id").collect()]
    assert ids(I.translate_users(raw, xwalk, "reserva_id")) == [3, None, None]
    assert ids(I.translate_users(raw, xwalk, "reserva_id", keep_unknown=True)) == [3, 404, None]


def events(make):
    return make.table(
        "events",
        dict(cookie_id="a", user_id=5), dict(cookie_id="a"), dict(cookie_id="a", user_id=9),
        dict(cookie_id="b"), dict(cookie_id="b", user_id=404),
        dict(cookie_id="c", user_id=9), dict(cookie_id=None, user_id=9), dict(cookie_id=None),
    )


EXPECTED = [
    (1, 3, 9), (2, None, 9), (3, 9, 9), (4, None, None), (5, None, None),
    (6, 9, 9), (7, 9, 9), (8, None, 9),
]


def identified(df):
    return [tuple(r) for r in df.select("event_id", "user_id", "user_id_propagado").orderBy("event_id").collect()]


def test_events_take_the_highest_canonical_id_of_their_cookie(make):
    xwalk = I.customer_crosswalk(customers(make))
    clean = clean_events(events(make))
    identities = I.identity_map(I.cookie_users(clean), xwalk)
    assert identified(I.identify_events(clean, identities)) == EXPECTED


def test_bots(make):
    raw = make.table("events", *[dict(temp_client_id=c) for c in ("Tbot0000000", "T1", None)])
    assert [r.es_bot for r in I.flag_bots(raw).orderBy("event_id").collect()] == [True, False, False]
    assert I.flag_bots(raw, ["T1"]).where("es_bot").count() == 1


def test_destination_of_bookings(make):
    raw = make.table("bookings", dict(tour_id=1), dict(tour_id=99), dict(tour_id=None))
    tours = make.table("tours", dict(tour_id=1)).withColumn("destino", F.lit("madrid"))
    got = I.with_destination(raw, tours, raw).orderBy("reserva_id").collect()
    assert [(r.destino, r.tour_conocido) for r in got] == [
        ("madrid", True), (None, False), (None, False),
    ]
