"""Writing records and tables."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed, schemas
from tidemark.functions.columns import JSON_TIME


def json_of(columns: list[str]) -> Column:
    """The event as JSON with camelCase fields."""
    return F.to_json(F.struct(*[F.col(c).alias(schemas.camel(c)) for c in columns]), JSON_TIME)


def to_records(
    df: DataFrame,
    topic: str | Column,
    key: str = "order_id",
    columns: list[str] | None = None,
    timestamp: str | None = None,
) -> DataFrame:
    """Events as keyed JSON records.

    ``columns`` are the fields of the event (default: all of ``df`` that are not record
    metadata). Position and headers are carried over when ``df`` has them; ``timestamp``
    names the column to use as record time.
    """
    carried = [c for c in ("partition", "offset", "headers") if c in df.columns]
    fields = columns or [c for c in df.columns if c not in (*carried, "topic", "key")]
    topic = F.lit(topic) if isinstance(topic, str) else topic
    out = [F.col(key).alias("key"), json_of(fields).alias("value"), topic.alias("topic")]
    if timestamp is not None:
        out.append(F.col(timestamp).alias("timestamp"))
    return df.select(*out, *carried)


def to_partition(records: DataFrame, partition: Column | int) -> DataFrame:
    """Send to a chosen partition instead of the one the key hashes to."""
    chosen = F.lit(partition) if isinstance(partition, int) else partition
    return records.withColumn("partition", chosen.cast("int"))


def route(df: DataFrame) -> DataFrame:
    """Give every order the topic of its class, so that one query feeds both topics."""
    topic = (
        F.when(F.col("order_category") == fixed.HIGH_VALUE, fixed.TOPIC_HIGH_VALUE)
        .when(F.col("order_category") == fixed.REGULAR, fixed.TOPIC_PROCESSED)
    )
    return df.withColumn("topic", topic)


def write_records(
    records: DataFrame,
    path: str,
    *,
    layout: tuple[str, ...] = ("topic",),
    mode: str = "append",
    hook: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write a batch of records as files, one folder per ``layout`` value.

    ``hook`` sees the records before they are sent and may add headers.
    """
    records = records.transform(hook) if hook else records
    records.write.mode(mode).partitionBy(*layout).parquet(path)


def write_events(
    df: DataFrame, path: str, topic: str, key: str = "order_id", hook=None, **record
) -> None:
    """Write events as keyed JSON records of a topic: orders by order id, payments by
    payment id (``key="payment_id"``)."""
    write_records(to_records(df, topic, key, **record), path, hook=hook)


def write_kafka(records: DataFrame, servers: str, hook=None) -> None:
    """Write a batch to Kafka; the ``topic`` column says where each record goes.

    Kafka's sink has no record-time column: event time has to be a field of the value.
    """
    records = records.transform(hook) if hook else records
    names = [c for c in ("key", "value", "topic", "partition", "headers") if c in records.columns]
    (
        records.select(names)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("includeHeaders", "true")
        .save()
    )


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    """Fill a column at insert time, adding it where it is missing."""
    if column not in df.columns:
        return df.withColumn(column, F.lit(value))
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def row_id(
    topic: str | Column,
    consumer: str | Column,
    partition: str | Column = "partition",
    offset: str | Column = "offset",
) -> Column:
    """A row id from who consumed which record: the same in every run and on every retry,
    and different for every other record, topic and consumer.

    Four bits hold the consumer, three the topic, 14 the partition and 42 the offset. A
    record without a position, or one that does not fit, has no id: null. Such rows are not
    stored but set apart (:func:`split_by_id`).
    """

    def place(value: str | Column, names: tuple[str, ...]) -> Column:
        value = F.lit(value) if isinstance(value, str) else value
        return F.array_position(F.array(*map(F.lit, names)), value) - 1

    at, of = place(topic, fixed.TOPICS), place(consumer, fixed.CONSUMERS)
    partition, offset = (F.col(c) if isinstance(c, str) else c for c in (partition, offset))
    fits = (
        (at >= 0) & (of >= 0) & partition.between(0, 2**14 - 1) & offset.between(0, 2**42 - 1)
    )
    number = ((of * 8 + at) * 2**14 + partition.cast("bigint")) * F.lit(2**42) + offset
    return F.when(fits, number)


def split_by_id(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(stored, rejected)``: rows with an id, and those whose record has no position, a
    position out of bounds, or an unknown topic or consumer."""
    return rows.filter("id IS NOT NULL"), rows.filter("id IS NULL")


def table_rows(
    df: DataFrame,
    topic: str = fixed.TOPIC_ORDERS,
    consumer: str = fixed.IDEMPOTENT_ORDER_CONSUMER,
    now: Column | None = None,
    partition: str = "kafka_partition",
    offset: str = "msg_offset",
) -> DataFrame:
    """Rows as stored: surrogate ``id`` first, ``created_at`` last."""
    created = F.current_timestamp() if now is None else now
    number = row_id(topic, consumer, partition, offset)
    return df.select(number.alias("id"), *df.columns, created.alias("created_at"))


def children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of the folders of a table, sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    names = (s.getPath().getName() for s in files.listStatus(hadoop))
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))


def writer_of(batch: DataFrame) -> str:
    """The id of the streaming query that hands over this batch. It is kept in the
    checkpoint: a restarted query has the same one, a new checkpoint another."""
    found = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise ValueError("outside a streaming query, name the writer of the batch")
    return found


def append_rows(rows: DataFrame, path: str, batch_id: int, writer: str | None = None, **options: str) -> None:
    """Append one batch to a table, with ``options`` of the file format. Writing the same batch again replaces it, so a
    retried batch leaves no double rows.

    A batch is known by its number and its ``writer`` (by default the streaming query that
    hands it over), so a query with a new checkpoint, whose numbers start again, or a second
    query on the same table touches nothing that others wrote. Writers are numbered in the
    order in which they first came.
    """
    spark = rows.sparkSession
    name = quote(writer or writer_of(rows), safe="")
    known = children(spark, path, "writer=")
    own = next((w for w in known if w.partition("-")[2] == name), None)
    own = own or f"{len(known):06d}-{name}"
    rows.write.options(**options).mode("overwrite").parquet(f"{path}/writer={own}/batch_id={batch_id}")
