from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import by, day, dicts, rows, when
from wayfare.operators.cohort import cohort, mature
from wayfare.plans import dashboard, repeat
from wayfare.plans.dashboard import Filters


def booking(user, booked, activity, **more):
    booked = when(f"{booked} 10:00:00") if booked else None
    return dict(user_id=user, fecha_reserva=booked, fecha_actividad=day(activity), **more)


LAST = booking(29, "2026-06-30", "2026-07-10", estado="pendiente")  # sets the cutoff


def flags(wh, rule="next"):
    return {r.user_id: r.recompra for r in cohort(wh.firsts, rule).collect()}


def test_repeat_looks_at_the_next_booking_only(make):
    wh = make.warehouse(
        bookings=[
            booking(1, "2025-01-01", "2025-02-01"),
            booking(1, "2025-01-05", "2025-02-02"),  # before the first activity
            booking(1, "2025-03-01", "2025-03-02"),  # after it
            booking(2, "2025-01-01", "2025-02-01"),
            booking(2, "2025-02-01", "2025-02-05"),  # on the activity day: not after
            booking(3, "2025-01-01", "2025-02-01"),
            booking(3, "2025-02-02", "2025-02-05"),
            booking(4, "2025-01-01", "2025-02-01"),
            booking(4, "2025-04-01", "2025-04-05", estado="cancelada"),
            LAST,
        ]
    )
    assert flags(wh) == {1: 0, 2: 0, 3: 1, 4: 0}
    assert flags(wh, "any") == {1: 1, 2: 0, 3: 1, 4: 0}


def test_a_single_booking_after_its_activity_is_no_repeat(make):
    wh = make.warehouse(bookings=[booking(1, "2025-02-03", "2025-02-01"), LAST])
    assert flags(wh) == flags(wh, "any") == {1: 0}


def test_ties_go_to_the_lower_id_and_missing_times_come_last(make):
    wh = make.warehouse(
        bookings=[
            booking(1, "2025-01-01", "2025-02-01", reserva_id=20, canal="SEM"),
            booking(1, "2025-01-01", "2025-02-01", reserva_id=10, canal="SEO"),
            booking(2, None, "2025-02-01", reserva_id=1, canal="SEM"),
            booking(2, "2025-01-01", "2025-02-01", reserva_id=2, canal="SEO"),
            LAST,
        ]
    )
    got = by(wh.firsts, "user_id")
    assert got[1]["reserva_id"] == 10 and got[2]["reserva_id"] == 2
    assert got[2]["sig_reserva_id"] == 1 and got[2]["sig_fr"] is None


def test_activity_must_lie_before_the_cutoff_and_exposure_counts_from_it(make):
    wh = make.warehouse(
        bookings=[
            booking(1, "2026-01-01", "2026-07-01"),  # after the cutoff
            booking(2, "2025-12-01", "2026-01-01"),  # 180 days before it
            booking(3, "2025-12-01", "2026-01-02"),  # 179
            LAST,
        ]
    )
    got = by(cohort(wh.firsts), "user_id")
    assert {u: r["dias_exposicion"] for u, r in got.items()} == {2: 180, 3: 179}
    assert {r.user_id for r in mature(cohort(wh.firsts)).collect()} == {2}


def test_unknown_users_are_one_customer_that_never_returns(make):
    wh = make.warehouse(
        bookings=[
            booking(404, "2025-01-01", "2025-02-01"),
            booking(405, "2025-03-01", "2025-03-02"),
            booking(406, "2025-04-01", "2025-04-02", estado="cancelada"),
            LAST,
        ]
    )
    assert flags(wh) == {None: 0} == flags(wh, "any")
    # no second booking, no value, no cancellation either
    assert rows(repeat.trip_stacking(wh)) == []
    assert rows(repeat.customer_value(wh)) == []
    assert rows(repeat.churn_cancelled_flag(wh)) == [("sin cancelaciones", 1, 0.0)]


def test_unknown_rule(make):
    with pytest.raises(ValueError, match="sometimes"):
        repeat.repeat_global(make.warehouse(), rule="sometimes")


def test_no_bookings_at_all(make):
    wh = make.warehouse()
    assert rows(repeat.repeat_global(wh)) == [(0, None, None)]
    assert rows(repeat.repeat_by_channel(wh)) == []


def test_any_never_counts_less_than_next(make):
    wh = make.warehouse(
        bookings=[
            booking(u, f"2025-0{m}-01", f"2025-0{m}-{10 + u}")
            for u in range(1, 6) for m in range(1, 1 + u)
        ] + [LAST]
    )
    nxt, every = flags(wh), flags(wh, "any")
    assert all(every[u] >= nxt[u] for u in nxt)


def test_report_and_dashboard_cohorts_agree_without_filters(make):
    """Holds when every booking has a tour and the last booking is a confirmed one."""
    wh = make.warehouse(
        bookings=[booking(u, f"2025-0{u}-01", f"2025-0{u}-20") for u in range(1, 8)]
        + [booking(3, "2025-09-01", "2025-09-02"), booking(9, "2026-06-30", "2026-06-30")]
    )
    f = Filters(day("2025-01-01"), day("2026-06-30"), ("SEO",), ("madrid",))
    report = rows(cohort(wh.firsts).select("user_id", "fa", F.col("recompra") == 1, "dias_exposicion"))
    board = rows(dashboard.cohort_filtered(wh, f).select("user_id", "fa1", "recurrente", "dias_exposicion"))
    assert report == board


def test_dashboard_cohort_ranks_bookings_of_known_tours_only(make):
    wh = make.warehouse(
        bookings=[
            booking(1, "2025-01-01", "2025-01-05", tour_id=99),
            booking(1, "2025-02-01", "2025-02-05"),
            booking(2, "2025-01-01", "2025-01-05", canal="SEM"),
            booking(2, "2025-03-01", "2025-03-05"),  # second booking: its channel is not asked
            booking(9, "2026-01-01", "2026-01-01", tour_id=99),  # no part in the cutoff
            LAST,
        ]
    )
    f = Filters(day("2025-01-01"), day("2026-12-31"), ("SEO",), ("madrid",))
    assert dicts(dashboard.cohort_filtered(wh, f).select("user_id", "fa1", "recurrente", "dias_exposicion")) == [
        dict(user_id=1, fa1=day("2025-02-05"), recurrente=False, dias_exposicion=24)
    ]
    assert {u: str(r["fa"]) for u, r in by(wh.firsts, "user_id").items()} == {
        1: "2025-01-05", 2: "2025-01-05", 9: "2026-01-01",
    }
