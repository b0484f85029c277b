"""State that is read by key, as of a commit, and by its changes."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from tidemark.operators import analytics, dedup
from tidemark.streaming import jobs, live

AT = datetime(2026, 1, 3, 10, 0)
SCHEMA = "order_id string, customer_id string, total_amount decimal(18,2), order_date timestamp"


@pytest.fixture
def orders(spark, tmp_path):
    """A folder of orders, one file per call; a call without rows gives the stream."""
    path = str(tmp_path / "orders")

    def send(rows=None):
        if rows is None:
            return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(path)
        data = [(f"o{n}", c, None, AT + timedelta(seconds=s)) for n, (c, s) in enumerate(rows)]
        return spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    send.path = path
    return send


def run(spark, df, checkpoint, changes=False):
    with jobs.state_on_disk(spark, changes):
        jobs.run_to_state(df, checkpoint).awaitTermination()


def test_point_queries_read_the_partitions_of_their_keys(spark, orders, tmp_path):
    checkpoint = str(tmp_path / "p")
    orders([(f"c{i % 50}", i) for i in range(300)])
    run(spark, analytics.order_counts(orders()), checkpoint)
    asked = spark.createDataFrame([("c7",), ("nobody",)], "customer_id string")
    found = live.value_of_keys(spark, checkpoint, asked, "customer_id", "order_count")
    assert values(found, "customer_id", "order_count") == [("c7", 6), ("nobody", 0)]
    parts = live.committed(spark, checkpoint).numPartitions
    one = live.of_keys(spark, checkpoint, asked.limit(1), ["order_count"])
    # one of the partitions of the state is one task, and no other is read
    assert one.rdd.getNumPartitions() == 1 < parts
    every = spark.createDataFrame([(f"c{i}",) for i in range(50)], "customer_id string")
    whole = values(live.as_of(spark, checkpoint, ["order_count"]), "*")
    assert values(live.of_keys(spark, checkpoint, every, ["order_count"]), "*") == whole
    assert live.of_keys(spark, checkpoint, every.limit(0), ["order_count"]).count() == 0


def test_many_partitions_are_read_as_a_whole(spark, orders, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "MOST_PARTITIONS", 1)
    checkpoint = str(tmp_path / "p")
    orders([(f"c{i % 50}", i) for i in range(300)])
    run(spark, analytics.order_counts(orders()), checkpoint)
    asked = spark.createDataFrame([(f"c{i}",) for i in range(0, 60, 3)], "customer_id string")
    found = live.value_of_keys(spark, checkpoint, asked, "customer_id", "order_count")
    assert values(found, "*") == sorted((f"c{i}", 6 if i < 50 else 0) for i in range(0, 60, 3))


def test_window_range_of_a_customer(spark, orders, tmp_path):
    checkpoint = str(tmp_path / "p")
    orders([(f"c{i % 3}", i * 20) for i in range(100)])
    orders([("c1", i * 45) for i in range(50)])
    run(spark, analytics.windowed_counts(orders()), checkpoint)
    table = spark.read.parquet(orders.path)
    start = spark.range(1).select(F.unix_millis(F.lit(AT).cast("timestamp"))).first()[0]
    assert start % 60_000 == 0
    for a, b in [(0, 0), (1, 59_999), (60_000, 600_000), (-120_000, 10**7)]:
        found = live.windows_of(spark, checkpoint, "c1", start + a, start + b)
        wanted = analytics.windowed_counts_for(table, "c1", start + a, start + b)
        names = ["customer_id", "window_start", "window_end", "order_count"]
        assert values(found, *names) == values(wanted, *names)


def test_reads_as_of_a_commit_and_between_two(spark, orders, tmp_path):
    """A read at batch 1 stays the same; the changes of batches 2 and 3 are the difference."""
    checkpoint = str(tmp_path / "p")
    for batch in ([("a", 0), ("b", 1)], [("a", 2)], [("c", 3), ("a", 4)], [("c", 5)]):
        orders(batch)
    counts = analytics.order_counts(orders())
    run(spark, counts, checkpoint, changes=True)
    early = live.as_of(spark, checkpoint, ["order_count"], batch=1)
    assert values(early, "*") == [("a", 2), ("b", 1)]
    late = values(live.as_of(spark, checkpoint, ["order_count"]), "*")
    assert late == [("a", 3), ("b", 1), ("c", 2)]
    feed = live.changes(spark, checkpoint, ["order_count"], 2, 3)
    newest = feed.groupBy("customer_id").agg(F.max_by("order_count", "batch_id"))
    assert values(newest, "*") == sorted(set(late) - {("a", 2), ("b", 1)})
    assert values(feed, "batch_id", "customer_id", "order_count") == [(2, "a", 3), (2, "c", 1), (3, "c", 2)]
    orders([("b", 6)])
    run(spark, counts, checkpoint, changes=True)
    assert values(early, "*") == [("a", 2), ("b", 1)]
    assert values(live.changes(spark, checkpoint, ["order_count"], 4, 4), "customer_id", "order_count") == [("b", 2)]
    # point queries also work where only some batches are stored as a whole
    asked = spark.createDataFrame([("b",), ("c",)], "customer_id string")
    found = live.value_of_keys(spark, checkpoint, asked, "customer_id", "order_count")
    assert values(found, "*") == [("b", 2), ("c", 2)]


def test_no_state(spark, orders, tmp_path):
    checkpoint = str(tmp_path / "p")
    orders([("a", 0)])
    run(spark, analytics.order_counts(orders()), checkpoint)
    with pytest.raises(ValueError, match="no state"):
        live.committed(spark, checkpoint, operator=5)
    with pytest.raises(ValueError, match="1 values|2 values"):
        live.as_of(spark, checkpoint, ["a", "b", "c", "d"])


# --- idempotent consumption -------------------------------------------------------------

RECORD = "order_id string, n int, partition int, offset bigint, headers map<string,string>"


@pytest.fixture
def records(spark, tmp_path):
    path = str(tmp_path / "records")

    def send(rows=None):
        if rows is None:
            return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", "1").parquet(path)
        data = [(k, n, p, o, {"h": str(n)}) for k, n, p, o in rows]
        return spark.createDataFrame(data, RECORD).coalesce(1).write.mode("append").parquet(path)

    send.path = path
    return send


def passed_on(spark, df, tmp_path):
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    with jobs.state_on_disk(spark):
        jobs.run_updates(df, jobs.updates_table(out), progress, every=None).awaitTermination()
    return spark.read.parquet(out)


def test_every_key_is_passed_on_once(spark, records, tmp_path):
    """By the first batch, and in it by position; over restarts; with columns of any type."""
    records([("a", 1, 0, 9), ("a", 2, 0, 3), ("b", 3, 1, 4), (None, 4, 0, 1), ("c", 5, None, None), ("c", 6, 2, 0)])
    records([("a", 7, 0, 1), ("d", 8, 0, 10), ("d", 9, 0, 11)])
    once = dedup.once_of_stream(records(), "order_id")
    wanted = [("a", 2, 0, 3, {"h": "2"}), ("b", 3, 1, 4, {"h": "3"}), ("c", 6, 2, 0, {"h": "6"}), ("d", 8, 0, 10, {"h": "8"})]
    columns = ["order_id", "n", "partition", "offset", "headers"]
    assert values(passed_on(spark, once, tmp_path), *columns) == wanted
    records([("b", 10, 1, 0), ("e", 11, 0, 12), ("a", 12, 0, 12)])
    again = values(passed_on(spark, once, tmp_path), *columns)
    assert again == sorted([*wanted, ("e", 11, 0, 12, {"h": "11"})])


def test_first_of_stream_carries_maps(spark, records, tmp_path):
    records([("a", 1, 0, 9), ("a", 2, 0, 3)])
    first = dedup.first_of_stream(records(), "order_id")
    assert values(passed_on(spark, first, tmp_path), "n", "headers") == [(2, {"h": "2"})]


def skewed(spark):
    """Half of all records are of one key."""
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 997))
    return spark.range(0, 64_000, 1, 64).select(
        key.alias("order_id"), F.lit(1).alias("n"), (F.col("id") % 3).cast("int").alias("partition"),
        F.col("id").alias("offset"), F.create_map(F.lit("h"), F.col("id").cast("string")).alias("headers"),
    )


def test_a_hot_key_loads_no_task_of_a_stream(spark, records, tmp_path):
    rows = skewed(spark)
    rows.repartition(40, "offset").write.parquet(records.path)
    stream = spark.readStream.schema(RECORD).parquet(records.path)
    # folded in the map tasks: the partial aggregate stands before the shuffle
    plan = plan_of(dedup.once_of_stream(rows, "order_id"))
    assert plan.rindex("partial_min_by") > plan.index("Exchange hashpartitioning(order_id")
    found = passed_on(spark, dedup.once_of_stream(stream, "order_id"), tmp_path)
    names = ["order_id", "partition", "offset"]
    wanted = dedup.first_per_key(spark.read.parquet(records.path), "order_id")
    assert values(found, *names) == values(wanted, *names)


def test_dealt_dedup_spreads_a_hot_key(spark, records, tmp_path):
    rows = skewed(spark)
    rows.write.parquet(records.path)
    # the rows that meet in the first step, by key and the task they come from
    met = rows.withColumn("_salt", F.spark_partition_id() % dedup.SALTS).groupBy("order_id", "_salt").count()
    assert met.agg(F.max("count")).first()[0] < 0.05 * rows.count()
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", "40").parquet(records.path)
    with jobs.state_on_disk(spark):
        jobs.run_to_files(dedup.dedup_stream(stream, "order_id"), out, str(tmp_path / "p")).awaitTermination()
    found = spark.read.parquet(out)
    assert values(found, "order_id") == values(rows.select("order_id").distinct(), "order_id")
