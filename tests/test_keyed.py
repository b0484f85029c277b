"""Streams that remember: waiting retries, the time of partitions, commits, sagas, verdicts."""

from __future__ import annotations

import glob
import random
import time
import tracemalloc
from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import analytics, consistency, delivery, folds, lateness, saga
from tidemark.plans import adapters, streamed
from tidemark.plans.catalog import QUERIES
from tidemark.sinks import writers
from tidemark.sources import records
from tidemark.streaming import jobs, keyed

AT = datetime(2026, 1, 3, 10, 0)


@pytest.fixture
def feed(spark, tmp_path):
    """Named folders of rows: ``feed(name, schema, rows)`` adds a file, without rows it gives
    the stream, a file at a time."""

    def give(name, schema, rows=None):
        path = str(tmp_path / name)
        if rows is None:
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)
        df = rows if hasattr(rows, "sparkSession") else spark.createDataFrame(rows, schema)
        return df.coalesce(1).write.mode("append").parquet(path)

    return give


def finish(spark, query_of):
    with jobs.state_on_disk(spark):
        query_of().awaitTermination()


# --- retries ----------------------------------------------------------------------------

ATTEMPT = (
    "order_id string, partition int, offset bigint, attempt int, failed_at timestamp,"
    " total_amount decimal(18,2), headers map<string,string>"
)


def second(n):
    return AT + timedelta(seconds=n)


def second_us(n):
    return n * 1_000_000


def test_failures_come_back_after_their_wait_and_end_as_dead_letters(spark, feed, tmp_path):
    """Three attempts, one and two seconds apart, on the clock of the stream; every run is a
    restart. ``bad`` always fails, ``once`` only the first time."""
    clock_schema = "failed_at timestamp, n int"
    dead, retried = str(tmp_path / "dead"), str(tmp_path / "retried")

    def consume(rows):
        """One pass of the consumer: what failed goes to the failures or to the dead letters."""
        df = spark.createDataFrame(rows, ATTEMPT)
        failing = (F.col("order_id") == "bad") | ((F.col("order_id") == "once") & (F.col("attempt") == 1))
        routed = delivery.route_failures(df, failing)
        feed("failures", routed.schema, routed.filter("next_attempt IS NOT NULL"))
        routed.filter("next_attempt IS NULL").write.mode("append").parquet(dead)
        return routed.schema

    def wait(schema):
        back = keyed.wait_until_due(feed("failures", schema), "failed_at", feed("clock", clock_schema))
        finish(spark, lambda: jobs.run_to_files(back, retried, str(tmp_path / "progress")))
        return spark.read.schema(back.schema).parquet(retried)

    def tick(n):
        feed("clock", clock_schema, [(second(n), 0)])

    first = [("bad", 0, 1, 1, AT, None, {"a": "b"}), ("once", 0, 2, 1, AT, None, {}), ("good", 0, 3, 1, AT, None, {})]
    tick(0)
    schema = consume(first)
    assert wait(schema).count() == 0  # one second has not passed
    tick(0.9)
    assert wait(schema).count() == 0
    tick(1.5)
    back = wait(schema)
    assert values(back, "order_id", "attempt", "failed_at", "headers") == [("bad", 2, AT, {"a": "b"}), ("once", 2, AT, {})]
    assert set(back.columns) == {f.split()[0] for f in ATTEMPT.split(", ")}
    # the second attempt fails at 1.5 s: due at 3.5 s
    consume([("bad", 0, 1, 2, second(1.5), None, {"a": "b"}), ("once", 0, 2, 2, second(1.5), None, {})])
    tick(3)
    assert wait(schema).count() == 2
    tick(4)
    assert values(wait(schema), "order_id", "attempt") == [("bad", 2), ("bad", 3), ("once", 2)]
    consume([("bad", 0, 1, 3, second(4), None, {"a": "b"})])
    tick(60)
    assert wait(schema).count() == 3
    assert values(spark.read.parquet(dead), "order_id", "attempt", "topic") == [("bad", 3, "orders-dlt")]


def test_a_repeated_failure_waits_once_and_a_late_one_does_not_wait_long(spark, feed, tmp_path):
    df = spark.createDataFrame([("x", 0, 1, 1, AT, None, None)] * 2 + [("y", 0, 2, 1, second(-100), None, None)], ATTEMPT)
    routed = delivery.route_failures(df, F.lit(True))
    feed("failures", routed.schema, routed)
    feed("failures", routed.schema, routed.limit(1))
    feed("clock", "failed_at timestamp", [(second(0.9),)])
    out = str(tmp_path / "out")

    def run():
        back = keyed.wait_until_due(feed("failures", routed.schema), "failed_at", feed("clock", "failed_at timestamp"))
        finish(spark, lambda: jobs.run_to_files(back, out, str(tmp_path / "p")))
        return values(spark.read.schema(back.schema).parquet(out), "order_id", "attempt")

    assert run() == [("y", 2)]
    feed("clock", "failed_at timestamp", [(second(9),)])
    assert run() == [("x", 2), ("y", 2)]


# --- the time of partitions -------------------------------------------------------------

LINE = "order_id string, customer_id string, order_date timestamp, partition int, offset bigint, amount decimal(18,2)"


@pytest.mark.parametrize("batches", [1, 10])
def test_grace_by_the_record_rule(spark, feed, tmp_path, batches):
    """As on the table, in one batch and in ten; records without a place are never late."""
    rng = random.Random(3)
    rows = [
        (f"o{i}", f"c{i % 5}", second(i * 2 - rng.choice([0, 0, 0, 30, 90, 300])), i % 3, i // 3, None) for i in range(900)
    ]
    for b in range(batches):
        size = len(rows) // batches
        part = rows[b * size : (b + 1) * size]
        rng.shuffle(part)
        feed("orders", LINE, part + [(f"n{b}", "c0", second(-5000), None, b, None), (f"m{b}", "c1", None, 0, None, None)])
    judged = keyed.judge_lateness(feed("orders", LINE))
    out = str(tmp_path / "out")
    finish(spark, lambda: jobs.run_to_files(judged, out, str(tmp_path / "p")))
    found, table = spark.read.parquet(out), spark.read.schema(LINE).parquet(str(tmp_path / "orders"))
    names = [*table.columns, "stream_time", "is_late"]
    assert values(found, *names) == values(lateness.judge_lateness(table), *names)
    assert found.filter("is_late").count() > 50
    counts = analytics.windowed_counts(found.filter("NOT is_late"))
    assert values(counts, "*") == values(lateness.windowed_counts_with_grace(table), "*")


def test_the_records_of_a_partition_wait_outside_memory():
    """In any order of parts, with equal places, and with a time from the batch before."""

    class State:
        exists, get = True, (second_us(500),)

        def update(self, value):
            self.get = value

    rng = random.Random(5)
    rows = [(second_us(rng.randrange(1000)), rng.randrange(1500), rng.randrange(2)) for _ in range(20_000)]
    text = "x" * 2000

    def parts():
        for start in range(0, len(rows), 500):
            part = pd.DataFrame(rows[start : start + 500], columns=["_time", "_at0", "_at1"])
            yield part.assign(**{keyed.PACKED: [f"{start + i}:{text}" for i in range(len(part))]})

    state, found = State(), {}
    tracemalloc.start()
    try:
        for out in keyed._newest_so_far((True, "0"), parts(), state):
            found.update((int(packed.split(":")[0]), newest) for packed, newest in zip(out[keyed.PACKED], out["_newest"]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    now, wanted = second_us(500), {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i][1:]):
        now = wanted[i] = max(now, rows[i][0])
    assert found == wanted and state.get == (now,)
    assert peak < 15 << 20  # of 40 MB of texts


# --- commits ----------------------------------------------------------------------------

EVENT = "payment_id string, transaction_id string, at timestamp"
COMMIT = "transaction_id string, done timestamp"


@pytest.mark.parametrize("within", [None, "1 hour"])
def test_committed_events_whenever_their_marker_comes(spark, feed, tmp_path, within):
    out = str(tmp_path / "out")

    def run():
        met = records.committed_stream(feed("events", EVENT), feed("commits", COMMIT), "transaction_id", "at", "done", within)
        finish(spark, lambda: jobs.run_to_files(met, out, str(tmp_path / "p")))
        return values(spark.read.parquet(out), "payment_id")

    feed("events", EVENT, [("p1", "t1", AT), ("p2", "t1", AT), ("p3", "t2", AT), ("p9", None, AT)])
    feed("commits", COMMIT, [("t3", AT), (None, AT)])
    assert run() == []
    feed("events", EVENT, [("p4", "t3", AT), ("p5", "t4", AT)])  # the marker was there before
    feed("commits", COMMIT, [("t1", AT), ("t1", AT)])  # after its events, and twice
    assert run() == [("p1",), ("p2",), ("p4",)]
    feed("events", EVENT, [("p6", "t1", second(5))])
    feed("commits", COMMIT, [("t1", second(5)), ("t9", AT)])
    assert run() == [("p1",), ("p2",), ("p4",), ("p6",)]  # t2 and t4 never commit


def test_the_rows_of_the_state_are_not_counted(spark):
    """A count that costs a read for every write, unless the session asks for it."""
    with jobs.state_on_disk(spark):
        assert spark.conf.get(jobs.COUNT_ROWS) == "false"
    assert spark.conf.get(jobs.COUNT_ROWS, None) is None
    spark.conf.set(jobs.COUNT_ROWS, "true")
    try:
        with jobs.state_on_disk(spark):
            assert spark.conf.get(jobs.COUNT_ROWS) == "true"
    finally:
        spark.conf.unset(jobs.COUNT_ROWS)


def test_streams_with_state_spare_the_disk(spark, feed, tmp_path):
    """The state is compressed, and shuffle files do not outlive their batch, unless the session
    asks for something else."""
    names = (jobs.STATE_COMPRESSION, jobs.CLEAN_SHUFFLES)
    with jobs.state_on_disk(spark):
        assert [spark.conf.get(n) for n in names] == ["zstd", "true"]
    assert [spark.conf.get(n, None) for n in names] == [None, None]
    spark.conf.set(jobs.STATE_COMPRESSION, "lz4")
    try:
        with jobs.state_on_disk(spark):
            assert [spark.conf.get(n) for n in names] == ["lz4", "true"]
        assert spark.conf.get(jobs.STATE_COMPRESSION) == "lz4"
    finally:
        spark.conf.unset(jobs.STATE_COMPRESSION)

    env = spark._jvm.org.apache.spark.SparkEnv.get()

    def shuffles():
        folders = env.blockManager().diskBlockManager().localDirs()
        return {f for d in folders for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}

    before = shuffles()
    for batch in range(3):
        feed("numbers", "k bigint, v bigint", [(k, batch) for k in range(100)])
    folded = feed("numbers", "k bigint, v bigint").groupBy("k").agg(F.sum("v").alias("v"))
    path = str(tmp_path / "out")
    finish(spark, lambda: jobs.run_updates(folded, jobs.updates_table(path), str(tmp_path / "p"), every=None))
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert values(jobs.latest_updates(spark, path, ["k"]), "v") == [(3,)] * 100


# --- verdicts that are withdrawn ----------------------------------------------------------

PAID = "payment_id string, order_id string, customer_id string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reports_are_withdrawn_when_the_order_comes(spark, feed, tmp_path, seed):
    """Whatever the order of arrival, and at every point of it."""
    rng = random.Random(seed)
    paid = [(f"p{i}", f"o{i % 12}", "c") for i in range(30)] + [("p98", None, "c")]
    placed = [(f"o{i}",) for i in range(0, 20, 2)] * 2
    rng.shuffle(paid)
    rng.shuffle(placed)
    path = str(tmp_path / "updates")
    reported = 0
    for step in range(3):
        feed("paid", PAID, paid[step::3])
        feed("placed", "order_id string", placed[step::3])
        verdicts = consistency.consistency(feed("placed", "order_id string"), feed("paid", PAID))
        finish(spark, lambda: jobs.run_updates(verdicts, jobs.updates_table(path), str(tmp_path / "p"), every=None))
        payments = spark.read.parquet(str(tmp_path / "paid"))
        orders = spark.read.parquet(str(tmp_path / "placed"))
        found = consistency.open_inconsistencies(payments, jobs.latest_updates(spark, path, ["order_id"]))
        wanted = consistency.inconsistencies(payments, orders)
        assert values(found, "*") == values(wanted, "*")
        reported = max(reported, found.count())
    assert reported > found.count() or seed  # withdrawn reports are no longer there
    updates = spark.read.parquet(path)
    assert updates.filter("has_payment AND NOT has_order").select("order_id").distinct().count() > 6


# --- sagas from events ------------------------------------------------------------------


def test_saga_tables_follow_shuffled_and_repeated_events(spark, make_orders, feed, tmp_path):
    placed = make_orders([(f"o{i}", "c1", 1, str(a)) for i, a in enumerate([10, 1500, 300, 90, 2500, 700, 20, 600])])
    ran = saga.run_saga(placed, 1000, 500)
    sent = saga.envelope_json(saga.event_log(ran)).cache()
    rows = [r.value for r in sent.select("value").collect()]
    for seed in range(4):
        more = rows + random.Random(seed).sample(rows, 5)
        random.Random(seed).shuffle(more)
        name = f"events{seed}"
        for part in (more[::3], more[1::3], more[2::3]):  # a cancellation may come first
            feed(name, "value string", [(v,) for v in part])
        found = saga.courses(saga.dispatch_all(feed(name, "value string")))
        path = str(tmp_path / f"updates{seed}")
        finish(spark, lambda: jobs.run_updates(found, jobs.updates_table(path), str(tmp_path / f"p{seed}"), every=None))
        state = jobs.latest_updates(spark, path, ["order_id"])
        tables = saga.orders_of(state), saga.payments_of(state), saga.reservations_of(state)
        for table, wanted in zip(tables, saga.saga_tables(placed, 1000, 500)):
            assert values(table, *wanted.columns) == values(wanted, "*")
    assert {r.status for r in tables[0].collect()} == {fixed.PENDING, fixed.CANCELLED}
    assert {r.status for r in tables[1].collect()} == {fixed.SUCCESS, fixed.FAILED, fixed.REFUNDED}


def test_a_cancelled_order_stays_cancelled(spark, make_orders):
    """Also when the payment that failed is reported before the order, or again as paid."""
    placed = make_orders([("o1", "c1", 1, "1500")])
    log = saga.event_log(saga.run_saga(placed, 1000, 500))
    paid_again = saga.event_log(saga.run_saga(make_orders([("o1", "c1", 1, "10")]), 1000, 500)).filter("seq = 2")
    later = paid_again.withColumn("metadata", F.col("metadata").withField("timestamp", F.lit("2030-01-01").cast("timestamp")))
    events = saga.dispatch_all(saga.envelope_json(log.unionByName(later)))
    state = saga.courses(events)
    assert values(saga.orders_of(state), "order_id", "status") == [("o1", fixed.CANCELLED)]
    assert values(saga.payments_of(state), "order_id", "status") == [("o1", fixed.FAILED)]
    alone = saga.courses(events.filter("metadata.event_type = 'PaymentProcessed'"))
    assert saga.orders_of(alone).count() == 0 and saga.payments_of(alone).count() == 1


def test_a_saga_holds_and_moves_each_event_once(spark, make_orders, tmp_path):
    """Events are sorted by order as one row each, and only the columns of a table are folded;
    of events at one time the one with the smallest values counts."""
    placed = make_orders([("o1", "c2", 1, "10"), ("o1", "c1", 1, "9"), ("o2", "c1", 1, "1500")])
    events = saga.dispatch_all(saga.envelope_json(saga.event_log(saga.run_saga(placed, 1000, 500))))
    found = saga.courses(events)
    plan = plan_of(found)
    assert "max_by" not in plan and "min_by" not in plan
    sort = plan[plan.rindex("Sort [order_id") :]
    assert "to_json" not in sort.split("from_json")[0]
    path = str(tmp_path / "updates")
    for batch in (0, 1):
        jobs.updates_table(path, writer="w")(found, batch)
    for table_of in (saga.orders_of, saga.payments_of, saga.reservations_of):
        narrow = jobs.latest_updates(spark, path, ["order_id"], lambda updates: table_of(updates, *jobs.PLACE))
        assert values(narrow, "*") == values(table_of(found).select(narrow.columns), "*")
        wide = jobs.latest_updates(spark, path, ["order_id"])
        assert values(narrow, "*") == values(table_of(wide).select(narrow.columns), "*")
        assert plan_of(narrow).count("batch_id") and "reservation_id" not in plan_of(
            jobs.latest_updates(spark, path, ["order_id"], lambda updates: saga.payments_of(updates, *jobs.PLACE))
        )
    assert values(saga.orders_of(found), "order_id", "customer_id") == [("o1", "c1"), ("o2", "c1")]


@pytest.mark.parametrize(
    "name, table_of, kinds",
    [
        ("saga_orders_streamed", saga.orders_of, {"placed", "paid", "cancelled", "refunded"}),
        ("saga_payments_streamed", saga.payments_of, {"paid", "refunded"}),
        ("saga_inventory_streamed", saga.reservations_of, {"reserved"}),
    ],
)
def test_a_saga_keeps_what_its_table_needs(spark, tmp_path, monkeypatch, name, table_of, kinds):
    """In its state and in its updates; over a batch per file, with orders that come again, some
    of them with other amounts, and without an amount or a key."""
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp"
    high, over = float(adapters.INVENTORY_LIMIT) + 1, float(adapters.PAYMENT_LIMIT) + 1
    files = [
        [(1, 1, "O", 10.0, second(1)), (2, 1, "F", high, second(1)), (3, 2, "F", over, second(1)), (7, 2, "F", 5.5, second(2))],
        [(1, 1, "O", 10.0, second(1)), (2, 1, "F", 10.0, second(5)), (4, 3, "P", None, second(2)), (5, None, "F", high, second(2))],
        [(3, 2, "F", 10.0, second(0)), (None, 1, "F", 10.0, second(3)), (6, 4, None, high, None), (7, 2, "F", 5.25, second(2))],
    ]
    table = tmp_path / "orders.parquet"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(table))
    run = tmp_path / "run"
    monkeypatch.setattr(streamed, "BATCH_BYTES", 1)
    monkeypatch.setattr(streamed, "run_dir", lambda spark, name: str(run))
    found = QUERIES[name](spark, str(tmp_path))

    orders = adapters.payment_requests(spark, str(tmp_path)).withColumnRenamed("amount", "total_amount")
    log = saga.event_log(saga.run_saga(orders, adapters.PAYMENT_LIMIT, adapters.INVENTORY_LIMIT))
    wanted = table_of(saga.courses(saga.dispatch_all(saga.envelope_json(log))))
    assert sorted(found.columns) == sorted(wanted.columns)
    assert values(found, *wanted.columns) == values(wanted, *wanted.columns)

    state = spark.read.format("statestore").load(f"{run}/progress").schema["value"].dataType
    assert len(state) == len(kinds)
    updates = spark.read.parquet(f"{run}/out")
    assert set(updates.columns) == {*wanted.columns, *jobs.PLACE}
    assert updates.select("batch_id").distinct().count() == len(files)


# --- folds of users ---------------------------------------------------------------------


def test_fold_by_user_functions(spark):
    """The longest text per pair of keys, with a hot pair, many states per key, and null keys."""

    def longest(rows):
        ordered = rows.assign(n=rows["text"].str.len()).sort_values(["n", "text"])
        return ordered.groupby(["a", "b"]).tail(1)[["a", "b", "text"]]

    df = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("a"),
        F.when(F.col("id") % 50 != 1, F.lit(1)).alias("b"),
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        found = folds.fold_by(df, ["a", "b"], lambda rows: rows, longest, "text string")
        length = folds.fold_by(
            df, ["a", "b"], lambda rows: rows, longest, "text string",
            lambda s: pd.DataFrame({"a": s["a"], "b": s["b"], "n": s["text"].str.len()}), "n int",
        )
        wanted = df.filter("b IS NOT NULL").groupBy("a", "b").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
        assert values(found, "a", "b", "text") == values(wanted, "*")
        assert values(length, "a", "b", "n") == values(wanted.select("a", "b", F.length("text").alias("n")), "*")
        assert folds.fold_by(df.limit(0), ["a", "b"], lambda rows: rows, longest, "text string").count() == 0
        states = found._jdf.queryExecution().executedPlan().toString()
        assert states.rindex("MapInPandas") > states.index("Exchange")  # a partial step before the shuffle
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_without_a_position_are_set_apart(spark, make_orders, tmp_path):
    """They are counted, and do not end the batch."""
    orders = make_orders([("o1", "c", 1, "5"), ("o2", "c", 1, "5"), ("o3", "c", 1, "5")]).withColumns(
        {"partition": F.when(F.col("order_id") != "o2", F.lit(0)), "offset": F.lit(7).cast("bigint")}
    )
    for topic, n in (("orders", 1), ("no-such-topic", 3)):
        rows = delivery.notification_rows(orders, topic=topic)
        stored, rejected = writers.split_by_id(rows)
        assert (stored.count(), rejected.count()) == (3 - n, n)
    table = str(tmp_path / "table")
    jobs.dual_write(table, str(tmp_path / "topic"), now=F.lit(AT), writer="w")(orders, 0)
    assert values(spark.read.parquet(table), "order_id") == [("o1",), ("o3",)]
    assert values(spark.read.parquet(f"{table}_rejected"), "order_id") == [("o2",)]
    assert spark.read.parquet(str(tmp_path / "topic")).count() == 3
