"""Every query against its statement on random tables full of gaps and oddities.

The raw tables replace the ones derived from the benchmark; dates, channels and
destinations are drawn so that the registered parameters select something.
"""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest

from oracle import statements, views
from tests.test_oracle import assert_same
from wayfare import catalogue
from wayfare.operators import skew
from wayfare.sources.raw import RawTables
from wayfare.sources.warehouse import Warehouse


USERS, BOOKINGS = 500, 4000


def random_rows(rnd: random.Random) -> dict[str, list[dict]]:
    def maybe(value, odds=15):
        return None if rnd.randrange(odds) == 0 else value

    def date(first: int, days: int) -> dt.date:
        return dt.date(first, 1, 1) + dt.timedelta(days=rnd.randrange(days))

    customers = [
        dict(
            user_id=u,
            dni=maybe(rnd.choice("dD") + str(u // 2), 6),
            fecha_nacimiento=maybe(rnd.choice([dt.date(1900, 1, 1), date(1940, 20000)])),
            fecha_alta=maybe(date(1990, 6000)),
            fecha_baja=maybe(date(1990, 6000), 2),
        )
        for u in range(1, USERS + 1)
    ]
    providers = [dict(proveedor_id=p, fecha_baja=maybe(date(1995, 1500), 3)) for p in range(1, 9)]
    tours = [
        dict(
            tour_id=t,
            proveedor_id=maybe(rnd.choice([1099, 77, *range(1, 9)])),
            url=maybe(f"https://h/es/brand-{t % 12}/x/") or rnd.choice([None, "https://h"]),
            precio_por_persona_eur=maybe(rnd.randrange(1, 9000) / 100),
        )
        for t in range(1, 25)
    ]
    bookings = []
    for i in range(BOOKINGS):
        booked = dt.datetime(1995, 1, 1) + dt.timedelta(minutes=rnd.randrange(1900 * 1440))
        activity = booked.date() + dt.timedelta(days=rnd.choice([-3, 0, 7, 8, 30, 31, 90, 91, 200]))
        bookings.append(
            dict(
                reserva_id=900001 + i,
                user_id=maybe(rnd.choice([1] * (USERS // 2) + [404] * 9 + [*range(1, USERS + 1)])),
                tour_id=maybe(rnd.choice([1] * 8 + [99] + [*range(1, 25)])),
                proveedor_id=maybe(rnd.choice([1, 1, 1, 55, *range(1, 9)])),
                fecha_reserva=maybe(booked, 40),
                fecha_actividad=maybe(activity, 40),
                estado=maybe(
                    rnd.choice(["confirmada"] * 4 + ["CONFIRMADA", "Cancelled", "cancelada", "Pendiente"]), 40
                ),
                personas=maybe(rnd.randrange(-1, 7)),
                importe_eur=maybe(rnd.choice([0, 0, rnd.randrange(1, 30000000) / 100])),
                campana=maybe(rnd.choice("ABC"), 4),
                canal=maybe(rnd.choice([*catalogue.CHANNELS, "Email", "Email"])),
            )
        )
    copies = rnd.choices(bookings, k=60) + [bookings[0]] * 300
    bookings += [{**b, "reserva_id": 1400001 + i} for i, b in enumerate(copies)]
    events = [
        dict(
            cookie_id=maybe(rnd.choice(["hot"] * 20 + [f"k{n}" for n in range(60)])),
            session_id=maybe(f"s{rnd.randrange(300)}", 40),
            temp_client_id=maybe(rnd.choice(["T1", "T2", "T3", "Tbot0000000"])),
            user_id=rnd.choice([None] * 6 + [rnd.randrange(1, USERS + 1)] * 3 + [404]),
            event_name=maybe(rnd.choice(["view_item", "begin_checkout", "purchase", "scroll"])),
            event_date=rnd.choice(
                [
                    (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(31 * 1440))).strftime(f)
                    for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M")
                ] * 5 + ["2024-02-31 00:00:00", "31/02/2024 00:00", "?", None]
            ),
            device=maybe(rnd.choice(["Desktp", "desktop", "MOBILE", "mobile", "Tablet"])),
            url=maybe(rnd.choice(["https://h/", *(f"https://h/es/brand-{n}/" for n in range(12))])),
            reserva_id=maybe(rnd.choice([b["reserva_id"] for b in bookings[:40]]), 2),
        )
        for _ in range(1500)
    ]
    return dict(customers=customers, providers=providers, tours=tours, bookings=bookings, events=events)


@pytest.mark.parametrize("seed", [11, 12])
def test_all_queries(spark, make, tmp_path, monkeypatch, seed):
    rnd = random.Random(seed)
    if seed % 2:  # one run with every lookup salted
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(skew, "HOT_SHARE", 20)
    raw = {}
    for name, table in random_rows(rnd).items():
        make.table(name, *table).coalesce(2).write.parquet(f"{tmp_path}/{name}")
        raw[name] = spark.read.parquet(f"{tmp_path}/{name}")
        monkeypatch.setitem(
            views.VIEWS, f"raw_{name}", ((), f"SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        )
    wh = Warehouse.scratch(spark, RawTables(**raw))
    duck, texts, empty, wrong = duckdb.connect(), statements(), [], []
    for name, query in catalogue.queries().items():
        df = query(wh)
        try:
            assert_same(df, duck, name, texts[name])
        except AssertionError as error:
            wrong.append(f"{name}: {error}")
        if not df.take(1):
            empty.append(name)
    assert not wrong, "\n".join(wrong)
    assert empty in ([], ["bot_candidates"])
