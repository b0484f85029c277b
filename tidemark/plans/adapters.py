"""The stored tables seen as orders, payment requests and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed, schemas
from tidemark.functions import headers as hdr
from tidemark.functions.columns import whole_seconds_ms
from tidemark.operators.payments import order_events as order_events_of_payments
from tidemark.operators.payments import payment_events, publish, with_ids
from tidemark.sinks.writers import to_records

# The stored prices run to 500,000, so the limits of the order tables are scaled.
PAYMENT_LIMIT = 400_000
INVENTORY_LIMIT = 200_000
HIGH_VALUE_LIMIT = 100_000
REPLAY_OFFSET = 10**12
ORDER_COLUMNS = [
    "order_id",
    "customer_id",
    "product_id",
    "quantity",
    "total_amount",
    "order_date",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(kind: str, number: str) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.col(number).cast("string"))


def _k() -> Column:
    """The number in ``props``. The usual ``{"k": 5}`` is read by pattern, four times as
    fast as by the JSON parser, which takes the rest."""
    plain = F.regexp_extract("props", r'^\{\s*"k"\s*:\s*(-?\d+)\s*\}$', 1)
    parsed = F.get_json_object("props", "$.k")
    return F.coalesce(plain.try_cast("int"), parsed.try_cast("int"))


def order_events_of(events: DataFrame) -> DataFrame:
    """``events`` rows as placed orders with a record position."""
    return events.withColumn("k", _k()).select(
        F.col("event_id").cast("string").alias("order_id"),
        _numbered("customer", "user_id").alias("customer_id"),
        _numbered("product", "k").alias("product_id"),
        (F.col("k") % 6).alias("quantity"),
        F.col("value").cast("decimal(18,2)").alias("total_amount"),
        F.col("ts").cast("timestamp").alias("order_date"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.expr("event_id div 3").alias("offset"),
        "event_id",
        "event_type",
        "k",
    )


def order_events(spark: SparkSession, sf_dir: str, customer: str | None = None) -> DataFrame:
    """All events, or those of one customer: the asked id is turned into the stored number,
    so that the file scan can skip the others."""
    events = table(spark, sf_dir, "events")
    if customer is not None:
        events = events.filter(F.col("user_id") == int(customer.removeprefix("customer-")))
    return order_events_of(events)


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placed orders as JSON records of the ``orders`` topic."""
    return to_records(
        order_events(spark, sf_dir), fixed.TOPIC_ORDERS, columns=ORDER_COLUMNS
    )


def with_order_headers(orders: DataFrame) -> DataFrame:
    """Headers as two kinds of senders write them; every fifth sender writes none."""
    order_id = F.col("order_id")
    sent = whole_seconds_ms(F.col("order_date"))
    kind = F.col("event_id") % 5
    plain = hdr.build(hdr.order_headers(order_id, sent))
    typed = hdr.build(hdr.message_headers(order_id))
    none = F.array().cast(schemas.HEADERS)
    chosen = F.when(kind == 0, none).when(kind == 1, typed).otherwise(plain)
    return orders.withColumn("headers", chosen)


def with_replays(df: DataFrame, number: str) -> DataFrame:
    """The rows, and every seventh a second time at a later offset."""
    again = df.filter(F.col(number) % 7 == 0).withColumn(
        "offset", F.col("offset") + F.lit(REPLAY_OFFSET)
    )
    return df.unionByName(again)


def out_of_order(orders: DataFrame) -> DataFrame:
    """The orders with an arrival place that delays every seventh of them."""
    delay = F.when(F.col("event_id") % 7 == 0, F.lit(10)).otherwise(F.lit(0))
    return orders.withColumn("arrival", F.col("event_id") + delay)


def payment_requests_of(rows: DataFrame) -> DataFrame:
    """``orders`` rows as paid orders with a record position."""
    rows = rows.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        _numbered("customer", "o_custkey").alias("customer_id"),
        F.lit(fixed.DEFAULT_PRODUCT).alias("product_id"),
        F.lit(1).alias("quantity"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("order_date"),
        F.col("o_orderstatus").alias("order_status"),
        (F.col("o_orderkey") % 3).cast("int").alias("partition"),
        F.expr("o_orderkey div 3").alias("offset"),
        "o_orderkey",
    )
    return with_ids(rows)


def payment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payment_requests_of(table(spark, sf_dir, "orders"))


def signed(requests: DataFrame) -> DataFrame:
    """Payment requests of which every fiftieth has a negative amount."""
    amount = F.when(F.col("o_orderkey") % 50 == 0, -F.col("amount")).otherwise(F.col("amount"))
    return requests.withColumn("amount", amount.cast("decimal(18,2)"))


def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed(payment_requests(spark, sf_dir))


def two_sides(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(orders, payments)``. Orders in state O come without a payment; the others are paid
    without a transaction, so that large ones leave a payment without an order."""
    paid = publish(requests.filter("order_status <> 'O'"), atomic=False, limit=PAYMENT_LIMIT)
    order_only = requests.filter("order_status = 'O'").select("order_id")
    return order_only.unionByName(order_events_of_payments(paid).select("order_id")), payment_events(paid)


def saga_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payment_requests(spark, sf_dir).withColumnRenamed("amount", "total_amount")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("day"),
        F.col("value").alias("latency"),
        (F.col("event_type") == "error").alias("is_error"),
    )
