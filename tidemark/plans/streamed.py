"""Catalog queries that run as streams over the stored tables and read back the result.

Each run takes the whole table in batches of at most ``BATCH_BYTES`` of files, ends when it
is consumed, and keeps its files in a folder of its own below the shared folder of the
session. The result is read from there, so the folder stays; whoever owns the shared folder
clears it (a local session clears its own when it ends).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed, schemas
from tidemark.operators import analytics, consistency, dedup, delivery, payments, saga
from tidemark.plans import adapters as a
from tidemark.plans.catalog import ARRIVAL, RANGE_CUSTOMER, RANGE_END_MS, RANGE_START_MS, query
from tidemark.session import run_dir
from tidemark.sinks import writers
from tidemark.sources import records
from tidemark.streaming import jobs, keyed, live


#: Bytes of files in one batch of a stream.
BATCH_BYTES = 16 << 30


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = a.table(spark, sf_dir, name).schema
    # the pattern matches a single file as well as a folder of files
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(BATCH_BYTES))
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def _order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.order_events_of(_stream(spark, sf_dir, "events"))


def _request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.payment_requests_of(_stream(spark, sf_dir, "orders"))


def _finish(running) -> None:
    running.awaitTermination()


@query
def orders_routed_streamed(spark, d):
    folder = run_dir(spark, "routed")
    sent = writers.to_records(
        _order_stream(spark, d), fixed.TOPIC_ORDERS, columns=a.ORDER_COLUMNS
    )
    routed = jobs.enriched_records(sent, processed_at=F.lit("2026-01-01").cast("timestamp"))
    _finish(jobs.run_to_files(routed, f"{folder}/out", f"{folder}/progress", ("topic",)))
    out = spark.read.parquet(f"{folder}/out")
    return records.decode(out, schemas.ENRICHED_ORDER).select(
        "topic", *a.ORDER_COLUMNS, "order_category", "processing_status"
    )


@query
def orders_deduped_streamed(spark, d):
    """The first record of every order by position, also when a replay arrives before it."""
    folder = run_dir(spark, "deduped")
    replayed = a.with_replays(_order_stream(spark, d), "event_id")
    first = dedup.first_of_stream(replayed.select(*a.ORDER_COLUMNS, "partition", "offset"), "order_id")
    with jobs.state_on_disk(spark):
        running = jobs.run_updates(
            first, jobs.updates_table(f"{folder}/out"), f"{folder}/progress", every=None
        )
    _finish(running)
    return jobs.latest_updates(spark, f"{folder}/out", ["order_id"])


@query
def customer_order_counts_from_state(spark, d):
    folder = run_dir(spark, "counts")
    with jobs.state_on_disk(spark):
        running = jobs.run_to_state(analytics.order_counts(_order_stream(spark, d)), folder)
    _finish(running)
    return jobs.state_table(spark, folder, ["order_count"])


@query
def customer_total_amounts_from_state(spark, d):
    folder = run_dir(spark, "totals")
    with jobs.state_on_disk(spark):
        running = jobs.run_to_state(analytics.total_amounts(_order_stream(spark, d)), folder)
    _finish(running)
    return jobs.state_table(spark, folder, ["total_amount"])


@query
def customer_windowed_counts_streamed(spark, d):
    """All windows from the state: files come in no order of time, so none may close."""
    folder = run_dir(spark, "windows")
    with jobs.state_on_disk(spark):
        running = jobs.run_to_state(analytics.windowed_counts(_order_stream(spark, d)), folder)
    _finish(running)
    return jobs.state_table(spark, folder, ["order_count"]).select(
        "customer_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "order_count",
    )


def _updates(spark: SparkSession, df: DataFrame, folder: str) -> str:
    """Run a stream of updates to its end; where they are."""
    with jobs.state_on_disk(spark):
        running = jobs.run_updates(df, jobs.updates_table(f"{folder}/out"), f"{folder}/progress", every=None)
    _finish(running)
    return f"{folder}/out"


def _appended(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """Run a stream to its end; the rows it gave."""
    with jobs.state_on_disk(spark):
        running = jobs.run_to_files(df, f"{folder}/out", f"{folder}/progress")
    _finish(running)
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query
def orders_once_streamed(spark, d):
    """Every order passed on once, with replays in the stream: each update is one order."""
    replayed = a.with_replays(_order_stream(spark, d), "event_id")
    once = dedup.once_of_stream(replayed.select(*a.ORDER_COLUMNS, "partition", "offset"), "order_id")
    out = _updates(spark, once, run_dir(spark, "once"))
    return spark.read.parquet(out).drop(*jobs.PLACE)


@query
def order_keys_deduped_streamed(spark, d):
    """The keys that pass the dealt dedup in append mode."""
    replayed = a.with_replays(_order_stream(spark, d), "event_id").select("order_id", "partition", "offset")
    once = dedup.dedup_stream(replayed, "order_id")
    return _appended(spark, once, run_dir(spark, "dealt")).select("order_id")


def _counted(spark: SparkSession, d: str, changes: bool = False) -> str:
    folder = run_dir(spark, "live")
    with jobs.state_on_disk(spark, changes):
        running = jobs.run_to_state(analytics.order_counts(_order_stream(spark, d)), folder)
    _finish(running)
    return folder


@query
def count_for_customers_live(spark, d):
    """Asked customers, from the partitions of the state that hold them."""
    key = F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))
    asked = a.table(spark, d, "customer").select(key.alias("customer_id"))
    return live.value_of_keys(spark, _counted(spark, d), asked, "customer_id", "order_count")


@query
def windowed_counts_range_live(spark, d):
    folder = run_dir(spark, "windows")
    with jobs.state_on_disk(spark):
        running = jobs.run_to_state(analytics.windowed_counts(_order_stream(spark, d)), folder)
    _finish(running)
    return live.windows_of(spark, folder, RANGE_CUSTOMER, RANGE_START_MS, RANGE_END_MS)


@query
def customer_order_counts_as_of(spark, d):
    """The state after the last commit, which later batches do not change."""
    folder = _counted(spark, d)
    return live.as_of(spark, folder, ["order_count"], live.committed(spark, folder).maxBatchId)


@query
def customer_order_count_changes(spark, d):
    """The changes of all batches, folded to the newest of each key."""
    folder = _counted(spark, d, changes=True)
    feed = live.changes(spark, folder, ["order_count"], 0, live.committed(spark, folder).maxBatchId)
    return feed.groupBy("customer_id").agg(F.max_by("order_count", "batch_id").alias("order_count"))


@query
def windowed_counts_with_grace_streamed(spark, d):
    """Late by the time of the partition, record by record; the rest is counted by a second
    stream."""
    folder = run_dir(spark, "grace")
    orders = a.out_of_order(_order_stream(spark, d)).select(*a.ORDER_COLUMNS, "partition", "arrival", "event_id")
    judged = _appended(spark, keyed.judge_lateness(orders, **ARRIVAL), f"{folder}/judged")
    fresh = spark.readStream.schema(judged.schema).parquet(f"{folder}/judged/out").filter("NOT is_late")
    with jobs.state_on_disk(spark):
        running = jobs.run_to_state(analytics.windowed_counts(fresh), f"{folder}/counts")
    _finish(running)
    return live.as_of(spark, f"{folder}/counts", ["order_count"]).select(
        "customer_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "order_count",
    )


@query
def payments_committed_streamed(spark, d):
    """Two streams, of attempted payments and of commits, which repeat."""
    def published():
        return payments.publish(a.signed(_request_stream(spark, d)), atomic=True, limit=a.PAYMENT_LIMIT)

    attempted = payments.payment_events(published(), "payment_attempted")
    done = payments.commits(published())
    # other columns neither travel nor wait
    met = records.committed_stream(attempted, done.unionByName(done)).select("payment_id", "order_id", "amount")
    return _appended(spark, met, run_dir(spark, "committed"))


@query
def inconsistencies_streamed(spark, d):
    """Reports that later orders withdraw: the newest verdict per order, over the payments."""
    orders, _ = a.two_sides(_request_stream(spark, d))
    _, paid = a.two_sides(_request_stream(spark, d))
    out = _updates(spark, consistency.consistency(orders, paid), run_dir(spark, "verdicts"))
    _, table = a.two_sides(a.payment_requests(spark, d))
    return consistency.open_inconsistencies(table, jobs.latest_updates(spark, out, ["order_id"]))


def _courses(spark: SparkSession, d: str, table_of) -> DataFrame:
    """The events of all orders as records of a stream, some of them twice; the table of what
    they come to. A later update of an order has all that an earlier one has, so rows are taken
    from the updates before these are kept: neither the state nor the files of the updates hold
    what the table does not need."""
    orders = _request_stream(spark, d).withColumnRenamed("amount", "total_amount")
    log = saga.event_log(saga.run_saga(orders, a.PAYMENT_LIMIT, a.INVENTORY_LIMIT))
    sent = saga.envelope_json(log)
    again = sent.filter(F.crc32(F.encode("key", "UTF-8")) % 7 == 0)
    found = saga.courses(saga.dispatch_all(sent.unionByName(again)))
    out = _updates(spark, table_of(found), run_dir(spark, "courses"))
    return jobs.latest_updates(spark, out, ["order_id"])


@query
def saga_orders_streamed(spark, d):
    return _courses(spark, d, saga.orders_of)


@query
def saga_payments_streamed(spark, d):
    return _courses(spark, d, saga.payments_of)


@query
def saga_inventory_streamed(spark, d):
    return _courses(spark, d, saga.reservations_of)


@query
def retries_waited_streamed(spark, d):
    """Errors come back one second after they failed, on the clock of the orders."""
    orders = _order_stream(spark, d).withColumn("attempt", F.lit(1))
    failed = delivery.route_failures(orders, F.col("event_type") == "error")
    columns = ["order_id", "customer_id", "order_date", "partition", "offset", "attempt", *delivery.ROUTE_COLUMNS]
    back = keyed.wait_until_due(failed.select(*columns), "order_date", _order_stream(spark, d))
    return _appended(spark, back, run_dir(spark, "retries")).select("order_id", "customer_id", "order_date", "attempt")


@query
def orders_restarted_streamed(spark, d):
    """Written as records, read from the start in bounded batches, and run again: no order
    is missing and none is there twice."""
    folder = run_dir(spark, "restarted")
    orders = a.order_events(spark, d).repartitionByRange(4, "event_id")
    writers.write_events(orders.select(*a.ORDER_COLUMNS, "partition", "offset"), f"{folder}/topic", fixed.TOPIC_ORDERS)
    for _ in range(2):
        read = records.read_orders(spark, f"{folder}/topic", max_files_per_trigger=1)
        _finish(jobs.run_to_files(read, f"{folder}/out", f"{folder}/progress"))
    return spark.read.parquet(f"{folder}/out").select(*a.ORDER_COLUMNS, "partition", "offset")


@query
def orders_dual_written(spark, d):
    """Each order as a row of a table and as a record; orders without a position are set apart."""
    folder = run_dir(spark, "dual")
    lost = F.when(F.col("event_id") % 11 != 0, F.col("offset"))
    orders = _order_stream(spark, d).withColumn("offset", lost).withColumn("transaction_id", F.col("order_id"))
    write = jobs.dual_write(f"{folder}/table", f"{folder}/topic", now=F.lit("2026-01-01").cast("timestamp"))
    _finish(jobs.run_updates(orders, write, f"{folder}/progress", every=None))
    stored, apart = (spark.read.parquet(f"{folder}/table{s}").select("order_id", "id") for s in ("", "_rejected"))
    sent = records.decode(spark.read.parquet(f"{folder}/topic"), schemas.ORDER_PLACED)
    return (
        stored.withColumn("place", F.lit("table"))
        .unionByName(apart.withColumn("place", F.lit("rejected")))
        .unionByName(sent.select("order_id", F.lit(None).cast("bigint").alias("id"), F.lit("topic").alias("place")))
    )
