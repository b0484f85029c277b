from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import lateness

START = datetime(2026, 1, 3, 10, 0)
SCHEMA = "customer_id string, order_date timestamp, partition int, offset bigint"


def events(spark, seconds):
    """``seconds[p]`` are the event times of partition ``p`` in arrival order."""
    rows = [
        ("c1", START + timedelta(seconds=s), p, i)
        for p, times in enumerate(seconds)
        for i, s in enumerate(times)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_grace(spark):
    df = events(spark, [[50, 69, 55, 70, 58]])
    judged = lateness.judge_lateness(df)
    assert values(judged, "offset", "stream_time", "is_late") == [
        (0, START + timedelta(seconds=50), False),
        (1, START + timedelta(seconds=69), False),
        (2, START + timedelta(seconds=69), False),
        (3, START + timedelta(seconds=70), False),
        (4, START + timedelta(seconds=70), True),
    ]
    assert values(lateness.late_events(df), "offset") == [(4,)]
    counts = lateness.windowed_counts_with_grace(df)
    assert values(counts, "window_start", "order_count") == [
        (START, 2),
        (START + timedelta(minutes=1), 2),
    ]


def brute_force(seconds, size=60, grace=10):
    late = []
    for p, times in enumerate(seconds):
        newest = -1
        for i, s in enumerate(times):
            newest = max(newest, s)
            if s - s % size + size + grace <= newest:
                late.append((p, i))
    return sorted(late)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 400), max_size=40), min_size=1, max_size=3), st.integers(1, 7))
def test_blocks_agree_with_record_by_record_judgement(spark, seconds, block_rows):
    if not any(seconds):
        return
    late = lateness.late_events(events(spark, seconds), block_rows=block_rows)
    assert sorted((r["partition"], r["offset"]) for r in late.collect()) == brute_force(seconds)


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_stream_time_is_the_plain_running_maximum(spark, block_rows):
    df = spark.range(2000).select(
        F.lit("c").alias("customer_id"),
        F.timestamp_seconds(1700000000 + F.pmod(F.xxhash64("id"), F.lit(5000))).alias("order_date"),
        F.lit(0).alias("partition"),
        F.col("id").alias("offset"),
    )
    plain = Window.partitionBy("partition").orderBy("offset")
    expected = df.withColumn("want", F.max("order_date").over(plain)).select("offset", "want")
    timed = lateness.with_stream_time(df, block_rows=block_rows)
    wrong = timed.join(expected, "offset").filter("stream_time <> want OR stream_time IS NULL")
    assert timed.count() == 2000 and wrong.count() == 0


def test_records_without_a_place_are_kept(spark):
    rows = [(0, 0, 50), (0, 1, 200), (0, 2, 55), (None, 3, 10), (0, None, 10), (None, None, 10)]
    df = spark.createDataFrame(rows, "partition int, offset bigint, s int").select(
        F.lit("c").alias("customer_id"), "partition", "offset", F.timestamp_seconds("s").alias("order_date")
    )
    judged = lateness.judge_lateness(df)
    assert judged.count() == len(rows)
    placed = F.col("partition").isNotNull() & F.col("offset").isNotNull()
    apart = judged.filter(~placed)
    assert apart.filter("stream_time = order_date AND NOT is_late").count() == 3
    assert values(judged.filter("is_late"), "offset") == [(2,)]
    # rows in = rows counted + rows late
    counted = lateness.windowed_counts_with_grace(df).agg(F.sum("order_count")).first()[0]
    assert counted + judged.filter("is_late").count() == len(rows)
