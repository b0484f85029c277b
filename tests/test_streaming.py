from __future__ import annotations

import os
import shutil
import time
from datetime import datetime, timedelta

import pytest
from conftest import values
from pyspark.sql import functions as F

from tidemark import fixed, schemas
from tidemark.functions import headers as hdr
from tidemark.operators import analytics, consistency, dedup, delivery, lookup, payments, saga
from tidemark.plans import streamed
from tidemark.plans.catalog import QUERIES
from tidemark.sinks import writers
from tidemark.sources import records
from tidemark.streaming import jobs

AT = datetime(2026, 1, 3, 10, 0)
ORDER_FIELDS = [f.name for f in schemas.ORDER_PLACED]


@pytest.fixture
def topic(spark, tmp_path):
    """A topic as a folder; ``send(rows)`` adds one file of ``(id, customer, seconds)``."""
    path = str(tmp_path / "topic")
    sent = [0]

    def send(rows):
        data = [
            (o, c, "p", 1, AT + timedelta(seconds=s), i % 3, sent[0] + i)
            for i, (o, c, s) in enumerate(rows)
        ]
        sent[0] += len(rows)
        df = spark.createDataFrame(
            data,
            "order_id string, customer_id string, product_id string, quantity int,"
            " order_date timestamp, partition int, offset bigint",
        )
        amount = F.col("offset").cast("decimal(18,2)") * 50
        out = writers.to_records(
            df.withColumn("total_amount", amount.cast("decimal(18,2)")),
            fixed.TOPIC_ORDERS,
            timestamp="order_date",
        )
        out.coalesce(1).write.mode("append").parquet(path)

    send.path = path
    return send


def orders_of(stream):
    return records.decode(stream, schemas.ORDER_PLACED)


def finish(query):
    query.awaitTermination()
    return query


def batch_orders(spark, path):
    return orders_of(records.read_files(spark, path))


def rows(n, start=0):
    return [(f"o{i}", f"c{i % 4}", i * 7) for i in range(start, start + n)]


def test_enrichment_stream_equals_batch(spark, topic, tmp_path):
    topic(rows(20))
    at = F.lit(AT)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    stream = records.read_files(spark, topic.path, streaming=True)
    finish(
        jobs.run_to_files(
            jobs.enriched_records(stream, processed_at=at), out, progress, ("topic",)
        )
    )
    batch = jobs.enriched_records(records.read_files(spark, topic.path), processed_at=at)
    assert values(spark.read.parquet(out), "key", "value", "topic") == values(
        batch, "key", "value", "topic"
    )
    assert values(batch.select("topic").distinct(), "*") == [
        ("high-value-orders",),
        ("processed-orders",),
    ]


def test_restart_continues_without_double_rows(spark, topic, tmp_path):
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        stream = records.read_files(spark, topic.path, streaming=True)
        finish(jobs.run_to_files(orders_of(stream), out, progress))

    topic(rows(10))
    run()
    assert spark.read.parquet(out).count() == 10  # nothing known before: from the start
    run()
    assert spark.read.parquet(out).count() == 10
    topic(rows(5, start=10))
    run()
    assert values(spark.read.parquet(out), "order_id") == values(
        batch_orders(spark, topic.path), "order_id"
    )


def test_bounded_batches(spark, topic, tmp_path):
    for i in range(3):
        topic(rows(4, start=4 * i))
    stream = records.read_files(spark, topic.path, streaming=True, max_files_per_trigger=1)
    query = finish(
        jobs.run_to_files(orders_of(stream), str(tmp_path / "out"), str(tmp_path / "p"))
    )
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [4, 4, 4]


def test_counts_from_state_follow_the_stream(spark, topic, tmp_path):
    progress = str(tmp_path / "progress")

    def run():
        stream = records.read_files(spark, topic.path, streaming=True)
        finish(jobs.run_to_state(analytics.order_counts(orders_of(stream)), progress))
        state = jobs.state_table(spark, progress, ["order_count"])
        batch = analytics.order_counts(batch_orders(spark, topic.path))
        assert values(state, "customer_id", "order_count") == values(
            batch, "customer_id", "order_count"
        )

    topic(rows(10))
    run()
    topic(rows(7, start=10))
    run()


def test_updates_fold_to_the_batch_result(spark, topic, tmp_path):
    """The update writer, batch by batch, with one batch written twice."""
    path = str(tmp_path / "updates")
    write = jobs.updates_table(path, "counts")
    topic(rows(8))
    early = analytics.windowed_counts(batch_orders(spark, topic.path))
    early.persist().count()
    write(early, 0)
    topic(rows(30, start=4))
    late = analytics.windowed_counts(batch_orders(spark, topic.path))
    write(late, 1)
    write(late, 1)
    keys = ["customer_id", "window_start", "window_end"]

    def latest():
        return values(jobs.latest_updates(spark, path, keys), *keys, "order_count")

    wanted = values(late, *keys, "order_count")
    assert latest() == wanted
    # compacting beside the stream, more than once, with batches after it and one tried again
    jobs.compact_updates(spark, path, keys)
    assert latest() == wanted
    write(late, 1)
    write(early, 2)
    again = latest()
    assert len(again) == len(wanted) and set(values(early, *keys, "order_count")) <= set(again)
    jobs.compact_updates(spark, path, keys)
    assert latest() == again
    # a query with a new checkpoint starts at 0 again and is newer than all before
    jobs.updates_table(path, "counts, begun anew")(late, 0)
    assert latest() == wanted
    jobs.compact_updates(spark, path, keys)
    jobs.compact_updates(spark, path, keys)
    assert latest() == wanted
    early.unpersist()


def test_update_table_of_a_running_stream(spark, topic, tmp_path):
    """The writer knows its query; a new checkpoint on the same table erases nothing."""
    path = str(tmp_path / "updates")
    topic(rows(10))
    topic(rows(2, start=10))

    def run(progress):
        stream = records.read_files(spark, topic.path, streaming=True, max_files_per_trigger=1)
        counts = analytics.order_counts(orders_of(stream))
        finish(jobs.run_updates(counts, jobs.updates_table(path), str(tmp_path / progress), every=None))

    run("first")
    run("first")
    batch = analytics.order_counts(batch_orders(spark, topic.path))
    wanted = values(batch, "customer_id", "order_count")
    assert values(jobs.latest_updates(spark, path, ["customer_id"]), "customer_id", "order_count") == wanted
    stored = spark.read.parquet(path)
    assert stored.select("writer", "batch_id").distinct().count() == 2
    run("second")
    assert spark.read.parquet(path).select("writer").distinct().count() == 2
    assert values(jobs.latest_updates(spark, path, ["customer_id"]), "customer_id", "order_count") == wanted


def test_batches_outside_a_stream_need_a_writer(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs.updates_table(str(tmp_path / "t"))(spark.range(1), 0)


def test_update_stream_emits_every_change(spark, topic):
    """Several values per key arrive, one per batch that changed it; the last one counts."""
    topic(rows(10))
    topic(rows(2, start=10))
    stream = records.read_files(spark, topic.path, streaming=True, max_files_per_trigger=1)
    finish(
        analytics.order_counts(orders_of(stream))
        .writeStream.outputMode("update")
        .format("memory")
        .queryName("order_count_updates")
        .trigger(availableNow=True)
        .start()
    )
    assert values(spark.table("order_count_updates"), "customer_id", "order_count") == [
        ("c0", 3),
        ("c1", 3),
        ("c2", 2),
        ("c2", 3),
        ("c3", 2),
        ("c3", 3),
    ]


def test_closed_windows_and_the_watermark(spark, topic, tmp_path):
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        stream = orders_of(records.read_files(spark, topic.path, streaming=True))
        finish(jobs.run_to_files(jobs.windowed_count_updates(stream), out, progress))
        return values(spark.read.parquet(out), "customer_id", "window_start", "order_count")

    topic([("o1", "c1", 5), ("o2", "c1", 50), ("o3", "c1", 69)])
    assert run() == []  # 69 s: the first window may still change within the grace period
    topic([("o4", "c1", 55), ("o5", "c1", 140)])
    closed = ("c1", AT, 3)
    assert closed in run()
    topic([("o6", "c1", 59)])  # its window is closed
    assert closed in run() and ("c1", AT, 4) not in run()


@pytest.mark.parametrize("within", [None, "10 minutes"])
def test_dedup_stream_drops_replays(spark, topic, tmp_path, within):
    out = str(tmp_path / "out")
    topic([("o1", "c1", 0), ("o2", "c1", 1), ("o1", "c1", 2)])
    topic([("o2", "c1", 3), ("o3", "c1", 4), (None, "c1", 5)])
    topic([("o8", "c1", 90_000)])
    topic([("o9", "c1", 90_001)])
    topic([("o1", "c1", 90_002)])
    stream = orders_of(records.read_files(spark, topic.path, streaming=True, max_files_per_trigger=1))
    with jobs.state_on_disk(spark):
        once = dedup.dedup_stream(stream, "order_id", "order_date", within)
        running = jobs.run_to_files(once, out, str(tmp_path / "p"))
    finish(running)
    # a bounded memory lets a late replay pass again, the unbounded one never does
    again = [("o1",)] if within else []
    assert values(spark.read.parquet(out), "order_id") == sorted([*again, ("o1",), ("o2",), ("o3",), ("o8",), ("o9",)])


def test_the_setting_of_the_state_store_is_given_back(spark):
    before = spark.conf.get(jobs.STATE_STORE, None)
    with jobs.state_on_disk(spark):
        assert spark.conf.get(jobs.STATE_STORE) == jobs.ROCKSDB
    assert spark.conf.get(jobs.STATE_STORE, None) == before


def test_first_of_stream_by_position(spark, topic, tmp_path):
    """A record with an earlier position wins also when it arrives later."""
    path = str(tmp_path / "updates")
    topic([("o1", "late", 0), ("o2", "c1", 1), ("o1", "c1", 2)])
    topic([("o2", "c1", 3), (None, "c1", 4)])
    stream = orders_of(records.read_files(spark, topic.path, streaming=True, max_files_per_trigger=1))
    stream = stream.withColumn("offset", F.when(F.col("customer_id") == "late", 99).otherwise(F.col("offset")))
    first = dedup.first_of_stream(
        stream.select(*ORDER_FIELDS, F.lit(0).alias("partition"), "offset"), "order_id"
    )
    finish(jobs.run_updates(first, jobs.updates_table(path), str(tmp_path / "p"), every=None))
    latest = jobs.latest_updates(spark, path, ["order_id"])
    assert values(latest, "order_id", "customer_id", "offset") == [("o1", "c1", 2), ("o2", "c1", 1)]


def test_bad_records_do_not_stop_the_stream(spark, topic, tmp_path):
    topic(rows(3))
    broken = spark.createDataFrame(
        [("x", "{oops", "orders", 0, 99)],
        "key string, value string, topic string, partition int, offset bigint",
    )
    broken.write.mode("append").parquet(topic.path)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    stream = records.read_files(spark, topic.path, streaming=True)
    finish(jobs.run_to_files(orders_of(stream), good, str(tmp_path / "p1")))
    finish(
        jobs.run_to_files(
            records.decode_rejects(stream, schemas.ORDER_PLACED), bad, str(tmp_path / "p2")
        )
    )
    assert spark.read.parquet(good).count() == 3
    assert values(spark.read.parquet(bad), "key", "value") == [("x", "{oops")]


def test_missing_orders_are_reported_after_the_wait(spark, tmp_path):
    def source(name, rows, schema):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.readStream.schema(schema).parquet(path)

    later = AT + timedelta(hours=2)
    paid = source(
        "payments",
        [("p1", "o1", "c1", AT), ("p2", "o2", "c1", AT), ("p3", "o3", "c1", later), ("p4", None, "c1", later)],
        "payment_id string, order_id string, customer_id string, processed_at timestamp",
    )
    placed = source(
        "orders",
        [("o1", AT + timedelta(minutes=3)), ("o9", later)],
        "order_id string, order_date timestamp",
    )
    found = consistency.stream_inconsistencies(paid, placed, "10 minutes")
    out = str(tmp_path / "out")
    finish(jobs.run_to_files(found, out, str(tmp_path / "p")))
    assert values(spark.read.parquet(out), "payment_id", "order_id") == [
        ("p2", "o2"),
        ("p4", None),
    ]


# The batch writers are called as the stream would call them, with a batch and its number.


def test_dual_write_replaces_a_retried_batch(spark, topic, tmp_path):
    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    write = jobs.dual_write(table, out, now=F.lit(AT), writer="orders")
    topic(rows(6))
    batch = batch_orders(spark, topic.path)
    for batch_id in (0, 0, 1):
        write(batch, batch_id)
    stored = spark.read.parquet(table).filter("batch_id = 0")
    sent = spark.read.parquet(out).filter("batch_id = 0")
    assert values(stored, "order_id") == values(sent, F.col("key").alias("order_id"))
    assert stored.select("id").distinct().count() == 6
    assert spark.read.parquet(table).count() == 12
    back = records.decode(sent, schemas.ORDER_PLACED)
    assert values(back, *ORDER_FIELDS) == values(batch, *ORDER_FIELDS)


def paid_requests(spark, topic):
    topic(rows(30))
    return (
        batch_orders(spark, topic.path)
        .withColumnRenamed("total_amount", "amount")
        .select("order_id", "customer_id", "amount", "order_date")
    )


def test_pairs_are_published_together(spark, topic, tmp_path):
    root = str(tmp_path / "root")
    batch = paid_requests(spark, topic)  # amounts 0, 50, ..., 1450
    write = jobs.publish_pairs(root, atomic=True, writer="pairs")
    write(batch, 0)
    write(batch, 0)
    paid, placed = jobs.read_published(spark, root)
    assert paid.count() == placed.count() == 21
    assert values(paid, "order_id") == values(placed, "order_id")
    # the attempts are there, but not committed
    assert spark.read.parquet(f"{root}/payments").count() == 30
    # a batch that broke off before its end does not count
    other = batch.withColumn("order_id", F.concat(F.lit("x"), "order_id"))
    jobs.publish_pairs(root, atomic=True, writer="pairs")(other, 1)
    shutil.rmtree(f"{root}/finished/writer=000000-pairs/batch_id=1")
    paid, placed = jobs.read_published(spark, root)
    assert paid.count() == placed.count() == 21


def test_without_transaction_payments_stay_alone(spark, topic, tmp_path):
    root = str(tmp_path / "root")
    jobs.publish_pairs(root, atomic=False, writer="pairs")(paid_requests(spark, topic), 0)
    paid, placed = jobs.read_published(spark, root)
    assert (paid.count(), placed.count()) == (30, 21)
    assert consistency.inconsistencies(paid, placed).count() == 9


def read_bytes(query):
    return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]


def test_each_order_is_notified_once(spark, topic, tmp_path):
    """Over restarts, and without reading what was written before."""
    history, progress = str(tmp_path / "history"), str(tmp_path / "p")

    def run():
        stream = orders_of(records.read_files(spark, topic.path, streaming=True))
        with jobs.state_on_disk(spark):
            running = jobs.run_to_files(jobs.new_notifications(stream), history, progress)
        return finish(running)

    topic([("o1", "c1", 0), ("o2", "c1", 1), ("o1", "c1", 2)])
    run()
    topic([("o2", "c1", 3), ("o3", "c1", 4)])
    assert read_bytes(run()) == [2]
    stored = spark.read.parquet(history)
    assert values(stored, "order_id") == [("o1",), ("o2",), ("o3",)]
    assert stored.filter("id IS NULL").count() == 0 and stored.select("id").distinct().count() == 3


def test_payments_and_saga_events_stream_as_in_batch(spark, topic, tmp_path):
    topic(rows(12))
    topic([("o3", "c3", 3), ("o20", "c0", 4)])

    def orders(stream):
        return orders_of(records.read_files(spark, topic.path, streaming=stream))

    def paid(df):
        sent = payments.publish(payments.with_ids(df.withColumnRenamed("total_amount", "amount")), atomic=False)
        return sent.withColumns({"status": F.lit("PROCESSED"), "processed_at": F.col("order_date")})

    with jobs.state_on_disk(spark):
        one = jobs.run_to_files(
            jobs.new_payments(paid(orders(True)), F.lit(AT)), str(tmp_path / "paid"), str(tmp_path / "p1")
        )
        two = jobs.run_to_files(
            jobs.saga_events(orders(True), 700, 300), str(tmp_path / "events"), str(tmp_path / "p2")
        )
    finish(one), finish(two)
    first = orders(False).dropDuplicates(["order_id"])
    wanted = delivery.payment_rows(paid(first), now=F.lit(AT))
    stored = spark.read.parquet(str(tmp_path / "paid"))
    columns = ["payment_id", "order_id", "amount", "status", "created_at"]
    assert values(stored, *columns) == values(wanted, *columns) and stored.count() == 13
    log = spark.read.parquet(str(tmp_path / "events"))
    batch = saga.event_log(saga.run_saga(first, 700, 300))
    kind = ["key", "seq", "topic", "metadata.event_type"]
    assert values(log, *kind) == values(batch, *kind)
    assert values(saga.saga_trace(log), "*") == values(saga.saga_trace(batch), "*")


def test_orders_can_be_read_from_files_both_ways(spark, topic, tmp_path):
    topic(rows(9))
    stream = records.read_orders(spark, topic.path, partitions=[0, 2])
    assert stream.isStreaming
    out = str(tmp_path / "out")
    finish(jobs.run_to_files(stream, out, str(tmp_path / "p")))
    batch = records.read_orders(spark, topic.path, streaming=False, partitions=[0, 2])
    assert values(spark.read.parquet(out), "order_id") == values(batch, "order_id")
    assert batch.count() == 6


def test_every_commit_is_handed_on(spark, topic, tmp_path):
    for i in range(4):
        topic(rows(3, start=3 * i))
    done = []
    listener = jobs.on_acknowledged(spark, done.append)
    try:
        stream = orders_of(records.read_files(spark, topic.path, streaming=True, max_files_per_trigger=1))
        finish(jobs.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "p")))
        until = time.time() + 30
        while sum(b["rows"] for b in done) < 12 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [b["batch"] for b in done if b["rows"]] == [0, 1, 2, 3]
    assert all(b["ends"] for b in done)


def test_stream_lookups_against_a_table(spark, topic, tmp_path):
    topic(rows(6))
    stream = records.read_orders(spark, topic.path)
    known = spark.createDataFrame([("o1",), ("o4",), ("o4",)], "order_id string")
    out = str(tmp_path / "out")
    finish(jobs.run_to_files(lookup.by_order(stream, known), out, str(tmp_path / "p")))
    assert values(spark.read.parquet(out), "order_id") == [("o1",), ("o4",)]


def test_events_are_keyed_by_the_named_column(spark, tmp_path):
    path = str(tmp_path / "topic")
    paid = spark.createDataFrame([("p1", "o1")], "payment_id string, order_id string")
    writers.write_events(
        paid,
        path,
        fixed.TOPIC_PAYMENTS,
        key="payment_id",
        hook=lambda df: hdr.stamp(df, F.lit(5)),
    )
    read = records.read_files(spark, path)
    assert values(read, "key", "topic", hdr.value_of("intercepted-at")) == [("p1", "payments", "5")]


@pytest.mark.parametrize(
    "streamed_query, batch_query",
    [
        ("orders_routed_streamed", "orders_routed"),
        ("orders_deduped_streamed", "orders_first_per_key"),
        ("customer_order_counts_from_state", "customer_order_counts"),
        ("customer_total_amounts_from_state", "customer_total_amounts"),
        ("customer_windowed_counts_streamed", "customer_windowed_counts"),
    ],
)
def test_streamed_queries_over_many_files_and_batches(spark, tmp_path, monkeypatch, streamed_query, batch_query):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    # files in no order of time
    events.repartition(8, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(streamed, "BATCH_BYTES", 12_000)
    batches = []
    listener = jobs.on_acknowledged(spark, batches.append)
    try:
        found = QUERIES[streamed_query](spark, str(tmp_path))
        wanted = QUERIES[batch_query](spark, str(tmp_path))
        assert values(found, *sorted(wanted.columns)) == values(wanted, *sorted(wanted.columns))
        until = time.time() + 30
        while len(batches) < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(b["rows"] > 0 for b in batches) >= 3


def test_streamed_windows_keep_rows_of_files_taken_late(spark, tmp_path, monkeypatch):
    """The newest file is taken first, and the others are more than 60 days behind it.

    A watermark drops rows from the batch after the next one on, hence three batches."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table, now = tmp_path / "events.parquet", time.time()
    table.mkdir()
    for age, days in ((30, 200), (20, 100), (10, 0)):
        moved = events.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {days} DAYS"))
        moved.coalesce(1).write.parquet(str(tmp_path / f"plus{days}"))
        (part,) = (tmp_path / f"plus{days}").glob("*.parquet")
        shutil.copy(part, table / f"plus{days}.parquet")
        os.utime(table / f"plus{days}.parquet", (now - age, now - age))
    monkeypatch.setattr(streamed, "BATCH_BYTES", 1)
    found = QUERIES["customer_windowed_counts_streamed"](spark, str(tmp_path))
    wanted = QUERIES["customer_windowed_counts"](spark, str(tmp_path))
    assert found.agg(F.sum("order_count")).first()[0] == 3 * events.count()
    assert values(found, *sorted(wanted.columns)) == values(wanted, *sorted(wanted.columns))
