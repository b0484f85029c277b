from __future__ import annotations

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from tidemark.operators import dedup
from tidemark.operators.skew import HOT_SHARE, SHARDS, anti_join, hot_keys, salted_join, semi_join

RECORDS = [("o1", 0, 9), ("o1", 0, 3), ("o2", 1, 4)]


def as_records(spark, rows):
    return spark.createDataFrame(rows, "order_id string, partition int, offset bigint")


def test_first_record_wins(spark):
    assert values(dedup.first_per_key(as_records(spark, RECORDS), "order_id"), "*") == [
        ("o1", 0, 3),
        ("o2", 1, 4),
    ]


def test_rows_are_cut_before_the_shuffle(spark):
    plan = plan_of(dedup.first_per_key(as_records(spark, RECORDS), "order_id"))
    partial, exchange = plan.index("WindowGroupLimit"), plan.index("Exchange")
    assert "Partial" in plan[exchange:] and partial < exchange


def test_new_only_skips_history_and_replays(spark):
    history = as_records(spark, [("o2", 0, 0), ("o7", 0, 0)])
    batch = as_records(spark, [*RECORDS, ("o3", 2, 1), ("o3", 2, 2)])
    assert values(dedup.new_only(batch, history, "order_id"), "*") == [("o1", 0, 3), ("o3", 2, 1)]
    assert dedup.new_only(history, history, "order_id").count() == 0


def test_records_without_a_key_are_set_apart(spark):
    batch = as_records(spark, [("o1", None, None), ("o1", 0, 5), (None, 0, 1), (None, 0, 2), ("o3", None, 1)])
    history = as_records(spark, [("o3", 0, 0), (None, 0, 0)])
    first = dedup.first_per_key(batch, "order_id")
    assert values(first, "*") == [("o1", 0, 5), ("o3", None, 1)]
    assert values(dedup.new_only(batch, history, "order_id"), "*") == [("o1", 0, 5)]
    rejects = dedup.without_key(batch, "order_id")
    assert values(rejects, "*") == [(None, 0, 1), (None, 0, 2)]
    keyed = batch.filter("order_id IS NOT NULL").count()
    assert keyed + rejects.count() == batch.count()


@pytest.fixture
def skewed(spark):
    """A third of all rows on one key, a tenth without a key, the rest spread."""
    key = (
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    )
    return spark.range(30_000).select("id", key.alias("order_id"))


def test_hot_keys_are_found_and_bounded(skewed):
    found = [r[0] for r in hot_keys(skewed, "order_id").collect()]
    assert "hot" in found and None not in found
    assert len(found) <= SHARDS / HOT_SHARE


@pytest.mark.parametrize("with_hot", [True, False])
def test_salted_joins_are_the_plain_joins(spark, skewed, with_hot):
    keys = [(f"k{i}", i) for i in range(0, 30_000, 7)] + ([("hot", -1)] if with_hot else [])
    right = spark.createDataFrame(keys, "order_id string, v bigint")
    twice = right.unionByName(right)
    pairs = [
        (salted_join(skewed, right, "order_id"), skewed.join(right, "order_id", "left")),
        (semi_join(skewed, twice, "order_id"), skewed.join(right, "order_id", "left_semi")),
        (anti_join(skewed, twice, "order_id"), skewed.join(right, "order_id", "left_anti")),
    ]
    for got, want in pairs:
        want = want.select(got.columns)
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == 0


@pytest.mark.parametrize("copies", [False, True])
def test_salted_join_spreads_the_hot_key(spark, skewed, copies):
    if copies:
        skewed = skewed.withColumn("id", F.when(F.col("order_id") != "hot", F.col("id")))
        skewed = skewed.repartition(200, F.rand(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        right = spark.createDataFrame([("hot", 1), ("k1", 2)], "order_id string, v bigint")
        joined = salted_join(skewed, right, "order_id")
        loads = [
            r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        ]
        assert sum(loads) == 30_000
        # 8 tasks: the hot key alone is a third of the rows
        assert max(loads) < 30_000 / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
