from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, when
from wayfare import labels as L
from wayfare.functions import exprs as X


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "value, digits, expected",
    [
        (0.285, 2, 0.28),
        (1.005, 2, 1.0),
        (2.5, 0, 3.0),
        (-2.5, 0, -3.0),
        (16.25, 1, 16.3),
        (None, 1, None),
    ],
)
def test_rounding_scales_before_it_rounds(spark, value, digits, expected):
    assert one(spark, X.rnd(F.lit(value), digits)) == expected


def test_division_by_zero_is_null(spark):
    assert one(spark, X.pct(F.lit(3), F.lit(0))) is None
    assert one(spark, X.ratio(F.lit(3), F.lit(0))) is None


def test_days_are_calendar_days(spark):
    a, b = F.lit(when("2025-01-01 23:00:00")), F.lit(when("2025-01-02 00:30:00"))
    assert one(spark, X.days_between(F.to_date(a), F.to_date(b))) == 1


def test_wald_interval(spark):
    low, high = X.wald_interval(F.lit(0.5), F.lit(100))
    assert one(spark, low) == 40.2 and one(spark, high) == 59.8
    low, high = X.wald_interval(F.lit(1.0), F.lit(10))
    assert one(spark, low) == one(spark, high) == 100.0
    low, _ = X.wald_interval(F.lit(0.1), F.lit(2))
    assert one(spark, low) < 0  # not clipped


def test_lead_buckets(spark):
    df = spark.createDataFrame([(d,) for d in (-1, 0, 7, 8, 30, 31, 90, 91, None)], "d int")
    got = {r.d: r.b for r in df.select("d", X.lead_bucket(F.col("d"), L.LEAD_REPORT).alias("b")).collect()}
    assert got == {
        -1: "0-7 d", 0: "0-7 d", 7: "0-7 d", 8: "8-30 d", 30: "8-30 d",
        31: "31-90 d", 90: "31-90 d", 91: "90+ d", None: "90+ d",
    }


def test_amount_and_party_buckets(spark):
    df = spark.createDataFrame([(0,), (49,), (50,), (100,), (200,)], "a int")
    assert [r[0] for r in df.select(X.amount_bucket(F.col("a"))).collect()] == [
        "0 (free)", "<50", "50-100", "100-200", "200+",
    ]
    df = spark.createDataFrame([(None,), (1,), (2,), (4,), (5,)], "a int")
    assert [r[0] for r in df.select(X.party_bucket(F.col("a"))).collect()] == [
        "(nulo)", "1", "2", "3-4", "5+",
    ]


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n long")
    assert rows(df.select("k", X.share_of_total("n").alias("p"))) == [("a", 25.0), ("b", 75.0)]


@pytest.mark.parametrize(
    "grain, expected",
    [("day", "2025-03-06"), ("week", "2025-03-03"), ("month", "2025-03-01"), ("quarter", "2025-01-01")],
)
def test_periods(spark, grain, expected):
    assert str(one(spark, X.period(F.lit(when("2025-03-06 23:59:59")), grain))) == expected


def test_a_mean_is_scaled_after_the_division(spark):
    """23 of 80: the mean times 100 lies below 28.75, 100 times the count does not."""
    row = spark.range(1).select(
        X.mean_pct(F.lit(23), F.lit(80)).alias("mean"), X.pct(F.lit(23), F.lit(80)).alias("share")
    )
    assert tuple(row.first()) == (28.7, 28.8)
