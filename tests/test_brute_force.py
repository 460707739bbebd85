"""Random small tables against plain Python loops."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from wayfare.operators.cohort import cohort
from wayfare.operators.identity import customer_crosswalk
from wayfare.schemas import BOOKING_KEY

START = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module", params=[1, 2])
def case(request, make):
    rnd = random.Random(request.param)
    customers = [
        dict(user_id=u, dni=rnd.choice([None, *(f"{c}{u // 2}" for c in "aA")]))
        for u in range(1, 41)
    ]
    bookings = []
    for i in range(600):
        booked = rnd.choice([None, *[START + dt.timedelta(days=rnd.randrange(200))] * 30])
        base = (booked or START).date()
        bookings.append(
            dict(
                # user 1 makes a third of all bookings
                reserva_id=900001 + i,
                user_id=rnd.choice([1] * 20 + [*range(1, 41)] + [None, 404]),
                tour_id=rnd.choice([1, 2, 99, None]),
                fecha_reserva=booked,
                fecha_actividad=base + dt.timedelta(days=rnd.randrange(-2, 40)),
                estado=rnd.choice(["confirmada", "Confirmada", "CANCELLED", "pendiente"]),
                personas=rnd.choice([None, -1, 2]),
                importe_eur=rnd.choice([0, 10, 20]),
            )
        )
    copies = rnd.choices(bookings, k=200) + [bookings[0]] * 100
    bookings += [{**b, "reserva_id": 1400001 + i} for i, b in enumerate(copies)]
    events = [
        dict(
            cookie_id=rnd.choice(["hot"] * 10 + [f"k{n}" for n in range(20)] + [None]),
            session_id=f"s{rnd.randrange(60)}",
            user_id=rnd.choice([None] * 8 + [*range(1, 41)] + [404]),
            device=rnd.choice(["mobile", "Desktp", None]),
            temp_client_id=rnd.choice(["T1", "T1", "Tbot0000000", None]),
            event_name=rnd.choice(["view_item", "begin_checkout", "purchase", "scroll"]),
            event_date=(START + dt.timedelta(hours=rnd.randrange(2000))).strftime(
                rnd.choice(["%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M"])
            ),
        )
        for _ in range(500)
    ]
    wh = make.warehouse(
        customers=customers,
        bookings=bookings,
        events=events,
        tours=[dict(tour_id=1), dict(tour_id=2)],
    )
    return wh, wh.raw_customers.collect(), wh.raw_bookings.collect(), wh.raw_events.collect()


def canonical_ids(customers):
    groups = defaultdict(list)
    for c in customers:
        groups[c.dni.lower() if c.dni else None].append(c.user_id)
    return {u: min(ids) for ids in groups.values() for u in ids}


def clean_device(name):
    return name and name.lower().replace("desktp", "desktop")


def kept_bookings(raw, ids):
    """Lowest id per set of equal values, then cleaned and translated."""
    best = {}
    for b in raw:
        key = tuple(b[c] for c in BOOKING_KEY)
        best[key] = min(best.get(key, b), b, key=lambda x: x.reserva_id)
    out = []
    for b in best.values():
        state = b.estado.lower().replace("cancelled", "cancelada")
        out.append({**b.asDict(), "estado": state, "user_id": ids.get(b.user_id)})
    return out


def test_crosswalk_and_bookings(case):
    wh, customers, bookings, _ = case
    ids = canonical_ids(customers)
    assert {tuple(r) for r in customer_crosswalk(wh.raw_customers).collect()} == set(ids.items())
    got = {r.reserva_id: (r.user_id, r.estado) for r in wh.bookings.collect()}
    want = kept_bookings(bookings, ids)
    assert got == {b["reserva_id"]: (b["user_id"], b["estado"]) for b in want}


@pytest.mark.parametrize("rule", ["next", "any"])
@pytest.mark.parametrize("with_tour", [False, True])
def test_cohort(case, rule, with_tour):
    wh, customers, raw, _ = case
    every = kept_bookings(raw, canonical_ids(customers))
    if with_tour:
        every = [b for b in every if b["tour_id"] in (1, 2)]
    per_user = defaultdict(list)
    for b in every:
        if b["estado"] == "confirmada":
            per_user[b["user_id"]].append(b)
    asked = [x for bs in per_user.values() for x in bs] if with_tour else every
    cutoff = max(b["fecha_reserva"].date() for b in asked if b["fecha_reserva"])
    want = {}
    for user, bs in per_user.items():
        bs.sort(key=lambda b: (b["fecha_reserva"] or dt.datetime.max, b["reserva_id"]))
        first, later = bs[0], bs[1:] if user is not None else []
        days = [b["fecha_reserva"].date() for b in later if b["fecha_reserva"]]
        days = days if rule == "any" else days[:1]
        if first["fecha_actividad"] <= cutoff:
            back = int(any(d > first["fecha_actividad"] for d in days))
            want[user] = (first["reserva_id"], back, (cutoff - first["fecha_actividad"]).days)
    firsts = wh.firsts_with_tour if with_tour else wh.firsts
    got = {
        r.user_id: (r.reserva_id, r.recompra, r.dias_exposicion)
        for r in cohort(firsts, rule).collect()
    }
    assert got == want


def test_events_and_sessions(case):
    wh, customers, _, raw = case
    ids = canonical_ids(customers)
    owner = defaultdict(list)
    for e in raw:
        if e.user_id in ids:
            owner[e.cookie_id].append(ids[e.user_id])
    owner = {k: max(v) for k, v in owner.items()}
    got = {r.event_id: (r.user_id, r.user_id_propagado, r.es_bot) for r in wh.events.collect()}
    assert got == {
        e.event_id: (
            ids.get(e.user_id), owner.get(e.cookie_id), e.temp_client_id == "Tbot0000000"
        )
        for e in raw
    }
    sessions = defaultdict(list)
    for e in raw:
        if e.temp_client_id != "Tbot0000000":
            sessions[e.session_id].append(e)
    stages = ("view_item", "begin_checkout", "purchase")
    want = {
        s: (
            min((clean_device(e.device) for e in es if e.device), default=None),
            int(any(e.cookie_id in owner for e in es)),
            *(int(any(e.event_name == n for e in es)) for n in stages),
        )
        for s, es in sessions.items()
    }
    got = {r.session_id: (r.device, r.ident, r.vi, r.bc, r.pu) for r in wh.sessions.collect()}
    assert got == want


def test_usual_device(case):
    wh, customers, _, raw = case
    ids = canonical_ids(customers)
    seen = {
        (ids[e.user_id], clean_device(e.device), e.session_id)
        for e in raw
        if e.user_id in ids and e.temp_client_id != "Tbot0000000"
    }
    counts = Counter((u, d) for u, d, _ in seen)
    best = {}
    for (user, device), n in counts.items():
        rank = (-n, device is None, device or "")
        if user not in best or rank < best[user][0]:
            best[user] = (rank, device)
    got = {r.user_id: r.device for r in wh.usual_device.collect()}
    assert got == {u: d for u, (_, d) in best.items()}
