"""The batch functions wired to streams.

Every query keeps its progress in ``checkpoint`` and commits a batch after it was written,
so a failed batch is run again: at least once. The writers here replace what an earlier
try of the same batch wrote, and keyed state drops what was consumed before, which together
gives each event one effect. No batch reads what earlier batches wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark import fixed, schemas
from tidemark.operators import analytics, dedup, delivery, enrich, payments, saga
from tidemark.sinks import writers
from tidemark.sources import records

BatchWriter = Callable[[DataFrame, int], None]
UPDATE_EVERY = "1 second"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
#: A count of rows for the progress reports, for which every write is a read as well.
COUNT_ROWS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
#: The state is on disk twice, in the store of its task and in the checkpoint.
STATE_COMPRESSION = "spark.sql.streaming.stateStore.rocksdb.compression"
#: Shuffle files go when the batch that wrote them ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPARING = {COUNT_ROWS: "false", STATE_COMPRESSION: "zstd", CLEAN_SHUFFLES: "true"}


@contextmanager
def state_on_disk(spark: SparkSession, changes: bool = False) -> Iterator[None]:
    """Queries started inside keep their keyed state in RocksDB rather than in executor
    memory; with ``changes`` they also store what each batch changed
    (:func:`tidemark.streaming.live.changes`). Unless the session asks for something else, the
    rows of the state are not counted, it is compressed with zstd, and the shuffle files of a
    batch are removed when it ends. The session has its own settings again afterwards."""
    wanted = {STATE_STORE: ROCKSDB} | ({CHANGELOG: "true"} if changes else {})
    wanted |= {name: value for name, value in SPARING.items() if spark.conf.get(name, None) is None}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


# --- stream -> stream -------------------------------------------------------------------


def enriched_records(
    source: DataFrame,
    threshold=fixed.HIGH_VALUE_THRESHOLD,
    processed_at: Column | None = None,
) -> DataFrame:
    """Order records in; valid, enriched records out, each with the topic of its class."""
    orders = records.decode(source, schemas.ORDER_PLACED).select(
        *[f.name for f in schemas.ORDER_PLACED][:-1]
    )
    enriched = enrich.valid_orders(enrich.enrich(orders, threshold, processed_at))
    routed = writers.route(enriched)
    fields = [f.name for f in schemas.ENRICHED_ORDER]
    return writers.to_records(routed, F.col("topic"), columns=fields)


def windowed_count_updates(
    orders: DataFrame,
    size: str = fixed.WINDOW_SIZE,
    grace: str = fixed.GRACE,
    time_col: str = "order_date",
) -> DataFrame:
    """Windowed counts of a stream; rows behind the watermark are left out."""
    return analytics.windowed_counts(analytics.with_grace(orders, time_col, grace), size, time_col)


def new_notifications(
    orders: DataFrame, method: str = fixed.IDEMPOTENT_ORDER_CONSUMER, salts: int = 1
) -> DataFrame:
    """A notification row for the first record of every order of a stream. Which orders were
    seen is keyed state, so a batch reads nothing but its own records. ``salts`` deals the replays
    of an order over so many tasks (:func:`tidemark.operators.dedup.dedup_stream`)."""
    return delivery.notification_rows(dedup.dedup_stream(orders, "order_id", salts=salts), method)


def new_payments(payments_in: DataFrame, now: Column | None = None, salts: int = 1) -> DataFrame:
    """A payment row for the first record of every payment of a stream."""
    return delivery.payment_rows(dedup.dedup_stream(payments_in, "payment_id", salts=salts), now=now)


def saga_events(
    orders: DataFrame,
    payment_limit=fixed.PAYMENT_LIMIT,
    inventory_limit=fixed.INVENTORY_LIMIT,
    salts: int = 1,
) -> DataFrame:
    """The events of every step for a stream of placed orders, each order once."""
    once = dedup.dedup_stream(orders, "order_id", salts=salts)
    return saga.event_log(saga.run_saga(once, payment_limit, inventory_limit))


# --- running queries --------------------------------------------------------------------


def _trigger(every: str | None) -> dict:
    return {"availableNow": True} if every is None else {"processingTime": every}


def run_to_files(
    df: DataFrame,
    path: str,
    checkpoint: str,
    layout: tuple[str, ...] = (),
    every: str | None = None,
) -> StreamingQuery:
    """Append a stream to files. Without ``every`` it takes what is there and ends."""
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .partitionBy(*layout)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def run_to_kafka(
    df: DataFrame, servers: str, checkpoint: str, every: str | None = UPDATE_EVERY
) -> StreamingQuery:
    """Send records to the topic each of them names."""
    return (
        df.writeStream.outputMode("append")
        .format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("includeHeaders", "true")
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def run_to_state(df: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep an aggregate up to date as keyed state only; :func:`state_table` reads it."""
    return (
        df.writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def run_updates(
    df: DataFrame, write: BatchWriter, checkpoint: str, every: str | None = UPDATE_EVERY
) -> StreamingQuery:
    """Pass on every changed row of an aggregate as it changes."""
    return (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


class Acknowledged(StreamingQueryListener):
    """Hands on every batch that a query commits: its number, its rows, and where each
    source ends. ``query_id`` (as kept in the checkpoint) limits it to one query."""

    def __init__(self, handle: Callable[[dict], None], query_id: str | None = None):
        super().__init__()
        self.handle, self.query_id = handle, query_id

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        if self.query_id in (None, str(progress.id)):
            ends = [source.endOffset for source in progress.sources]
            self.handle({"batch": progress.batchId, "rows": progress.numInputRows, "ends": ends})


def on_acknowledged(
    spark: SparkSession, handle: Callable[[dict], None], query_id: str | None = None
) -> Acknowledged:
    """Call ``handle`` after every committed batch until the listener is removed
    (``spark.streams.removeListener``). Nothing is kept, so nothing is lost to a limit."""
    listener = Acknowledged(handle, query_id)
    spark.streams.addListener(listener)
    return listener


# --- what one batch writes --------------------------------------------------------------


def updates_table(path: str, writer: str | None = None) -> BatchWriter:
    """Keep the updates of each batch; :func:`latest_updates` folds them by key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writers.append_rows(batch, path, batch_id, writer, compression="zstd")

    return write


PLACE = ("writer", "batch_id")
#: Below the table, and hidden from plain reads of it.
COMPACTED = "_compacted"


def _newest(updates: DataFrame, keys: list[str], place: tuple[str, ...] = ()) -> DataFrame:
    """The newest row per key, with the columns of ``place``, each of which is kept once."""
    values = [c for c in updates.columns if c not in (*keys, *PLACE)]
    newest = F.max_by(F.struct(*values, *place), F.struct(*PLACE)).alias("_v")
    return updates.groupBy(*keys).agg(newest).select(*keys, "_v.*")


def _updates(spark: SparkSession, path: str) -> DataFrame:
    """The last compacted rows and the batches after them."""
    later = spark.read.parquet(path).withColumns(
        {"writer": F.col("writer").cast("string"), "batch_id": F.col("batch_id").cast("bigint")}
    )
    done = writers.children(spark, f"{path}/{COMPACTED}", "until=")
    if not done:
        return later
    number, _, last = done[-1].partition("~")
    writer, _, batch_id = last.rpartition("~")
    after = F.struct(*PLACE) > F.struct(F.lit(writer).alias("writer"), F.lit(int(batch_id)).cast("bigint").alias("batch_id"))
    before = spark.read.parquet(f"{path}/{COMPACTED}/until={done[-1]}")
    return later.filter(after).unionByName(before.select(*later.columns))


def latest_updates(
    spark: SparkSession, path: str, keys: list[str], of: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The newest row per key of an updates table: of the writer that came last, the last
    batch. ``of`` names the columns that are wanted, row by row, so that no others are moved; it
    keeps the keys and ``PLACE``, and may leave out rows only where later ones of the key stay."""
    updates = _updates(spark, path)
    return _newest(updates if of is None else of(updates), keys)


def compact_updates(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Fold the batches of an updates table, so that later reads begin there. It can run
    beside the stream, and again at any time: the last batch of the last writer may still be
    tried again and is left alone, and later batches are not touched. A writer that came
    before must have ended."""
    batches = spark.read.parquet(path).select(*PLACE).distinct()
    ordered = batches.select(F.col("writer").cast("string"), F.col("batch_id").cast("bigint"))
    # numbers of batches, not rows of them
    last_two = ordered.orderBy(*[F.col(c).desc() for c in PLACE]).limit(2).collect()
    if len(last_two) < 2:
        return
    writer, batch_id = last_two[1]
    until = F.struct(*PLACE) <= F.struct(F.lit(writer).alias("writer"), F.lit(batch_id).alias("batch_id"))
    folded = _newest(_updates(spark, path).filter(until), keys, PLACE)
    number = len(writers.children(spark, f"{path}/{COMPACTED}", "until="))
    folded.write.parquet(f"{path}/{COMPACTED}/until={number:06d}~{writer}~{batch_id}")


def dual_write(
    table_path: str,
    topic_path: str,
    topic: str = fixed.TOPIC_ORDERS,
    now: Column | None = None,
    writer: str | None = None,
) -> BatchWriter:
    """Write each batch of orders to a table and to a topic.

    A batch that fails between the two is run again and replaces both. Orders whose record
    has no position cannot be rows of the table; they go to ``<table_path>_rejected``, also
    batch by batch, and to the topic.
    """

    fields = [f.name for f in schemas.ORDER_PLACED]

    def write(batch: DataFrame, batch_id: int) -> None:
        orders = batch.select("partition", "offset", *fields).persist()
        try:
            rows = writers.table_rows(records.with_record_metadata(orders), topic, now=now)
            stored, rejected = writers.split_by_id(rows)
            writers.append_rows(stored, table_path, batch_id, writer)
            writers.append_rows(rejected, f"{table_path}_rejected", batch_id, writer)
            out = writers.to_records(orders, topic, columns=fields)
            writers.append_rows(out, topic_path, batch_id, writer)
        finally:
            orders.unpersist()

    return write


def publish_pairs(
    root: str, atomic: bool, limit=fixed.PUBLISH_LIMIT, writer: str | None = None
) -> BatchWriter:
    """Publish payments and orders of a batch under ``root``.

    Every payment is stored with whether its transaction was committed (``sent``), and a
    batch counts for readers once its line in the list of finished batches is there, which
    is written last (:func:`read_published`). So readers see both events of a pair or
    neither with ``atomic``, also when a batch breaks off halfway.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        published = payments.publish(payments.with_ids(batch), atomic, limit).persist()
        try:
            attempted = payments.payment_events(published, "payment_attempted", "payment_sent")
            attempted = attempted.withColumnRenamed("payment_sent", "sent")
            writers.append_rows(attempted, f"{root}/payments", batch_id, writer)
            writers.append_rows(payments.order_events(published), f"{root}/orders", batch_id, writer)
            counts = published.agg(F.count(F.lit(1)).alias("requests"))
            writers.append_rows(counts, f"{root}/finished", batch_id, writer)
        finally:
            published.unpersist()

    return write


def read_published(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(payments, orders)`` of committed transactions: the sent rows of finished batches.

    The list of batches meets the folder columns, so it prunes folders; no row is joined by
    its transaction.
    """
    finished = spark.read.parquet(f"{root}/finished").select(*PLACE).distinct()

    def part(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{name}").join(finished, list(PLACE), "left_semi").drop(*PLACE)

    return part("payments").filter("sent").drop("sent"), part("orders")


# --- state ------------------------------------------------------------------------------


def state_table(spark: SparkSession, checkpoint: str, names: list[str]) -> DataFrame:
    """The keyed state of a query as a table. ``names`` are given to the first values of the
    state, in their order, whatever Spark calls them."""
    state = spark.read.format("statestore").load(checkpoint)
    stored = state.schema["value"].dataType.names[: len(names)]
    values = [F.col("value")[old].alias(new) for old, new in zip(stored, names)]
    return state.select("key.*", *values)
