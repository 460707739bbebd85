from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from wayfare.operators import skew
from wayfare.operators.skew import hot_keys, key_counts, balanced_lookup


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under key 7, a third without a key, the rest spread."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 2, F.col("id"))
    return spark.range(3000).select("id", key.cast("long").alias("k"))


def test_equals_plain_join(spark, skewed):
    lookup = spark.range(0, 3000, 5).select(
        (F.col("id") + 2).alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v")
    )
    plain = skewed.join(lookup, "k", "left").select("id", "k", "v")
    assert rows(balanced_lookup(skewed, lookup, ["k"], "id", share=20, broadcast_rows=0)) == rows(plain)


def test_only_a_lookup_counted_small_is_broadcast(spark, skewed):
    lookup = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))

    def shuffles(limit):
        df = balanced_lookup(skewed, lookup, ["k"], "id", broadcast_rows=limit)
        return "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()

    assert not shuffles(10)
    assert shuffles(9) and shuffles(0)


def test_few_rows_of_long_text_are_not_small(spark, monkeypatch):
    lookup = spark.createDataFrame([(1, "x" * 50), (2, None)], "k long, v string")
    assert skew.is_small(lookup, 2) and not skew.is_small(lookup, 1)
    monkeypatch.setattr(skew, "BROADCAST_TEXT", 49)
    assert not skew.is_small(lookup, 2)


def test_null_is_a_key(spark, skewed):
    lookup = spark.createDataFrame([(None, "none"), (7, "seven")], "k long, v string")
    got = balanced_lookup(skewed, lookup, ["k"], "id", share=20, broadcast_rows=0).groupBy("v").count()
    assert rows(got) == [(None, 1000), ("none", 1000), ("seven", 1000)]


def test_hot_list_is_bounded_and_cut_to_cold_size(skewed):
    counts = key_counts(skewed, ["k"])
    total = counts.agg(F.sum("_n")).scalar()
    for share in (2, 10, 100):
        hot = hot_keys(counts, ["k"], total, share).collect()
        assert len(hot) < share
        for r in hot:
            assert 1000 / r["_parts"] <= 3000 / share


def test_hot_key_is_spread_over_partitions(spark, skewed):
    """Without broadcast and coalescing, no partition takes the whole hot key."""
    keep = {
        k: spark.conf.get(k)
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lookup = spark.createDataFrame([(7, "seven")], "k long, v string")
        joined = balanced_lookup(skewed, lookup, ["k"], "id", share=50, broadcast_rows=0)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and max(sizes) < 1500
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    keys=st.lists(st.one_of(st.none(), st.integers(0, 4)), min_size=1, max_size=30),
    known=st.sets(st.integers(0, 4)),
    share=st.sampled_from([2, 5, 10_000]),
    broadcast_rows=st.sampled_from([0, 1, 100]),
)
def test_any_distribution(spark, keys, known, share, broadcast_rows):
    facts = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in known], "k long, v string")
    want = [(i, k, f"v{k}" if k in known else None) for i, k in enumerate(keys)]
    rows_out = balanced_lookup(
        facts, lookup, ["k"], "id", share=share, broadcast_rows=broadcast_rows
    ).collect()
    assert sorted(map(tuple, rows_out), key=lambda r: r[0]) == want
