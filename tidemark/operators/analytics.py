"""Per-customer counts and totals, windowed counts, and the reports over them.

Aggregates read the raw orders: an order that fails validation still counts. Every one
combines rows map-side before the shuffle, so a customer with a third of all orders
sends one partial row per map task and no more.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed


def aggregate_by(df: DataFrame, keys: dict[str, Column], **aggregates: Column) -> DataFrame:
    """Group by key expressions and apply aggregate expressions.

    A row whose key is null belongs to no group. Keys and aggregates are Columns, so user
    rules run inside Spark's own aggregation.
    """
    keyed = df.filter(reduce(and_, [key.isNotNull() for key in keys.values()]))
    return keyed.groupBy(*[key.alias(name) for name, key in keys.items()]).agg(
        *[value.alias(name) for name, value in aggregates.items()]
    )


def customer_stats(df: DataFrame) -> DataFrame:
    """Order count and amount total per customer, from one shuffle."""
    return aggregate_by(
        df,
        {"customer_id": F.col("customer_id")},
        order_count=F.count(F.lit(1)),
        total_amount=F.coalesce(F.sum("total_amount"), F.lit(0).cast("decimal(28,2)")),
    )


def order_counts(df: DataFrame) -> DataFrame:
    return customer_stats(df).select("customer_id", "order_count")


def total_amounts(df: DataFrame) -> DataFrame:
    return customer_stats(df).select("customer_id", "total_amount")


def windowed_counts(
    df: DataFrame, size: str = fixed.WINDOW_SIZE, time_col: str = "order_date"
) -> DataFrame:
    """Orders per customer and tumbling window, windows aligned to the epoch."""
    counts = aggregate_by(
        df,
        {"window": F.window(time_col, size), "customer_id": F.col("customer_id")},
        order_count=F.count(F.lit(1)),
    )
    return counts.select(
        "customer_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "order_count",
    )


def with_grace(
    df: DataFrame, time_col: str = "order_date", grace: str = fixed.GRACE
) -> DataFrame:
    """Accept events up to ``grace`` behind the newest one (streams only)."""
    return df.withWatermark(time_col, grace)


def windowed_counts_for(
    df: DataFrame,
    customer: str,
    start_ms: int | None = None,
    end_ms: int | None = None,
    *,
    now: Column | None = None,
    size: str = fixed.WINDOW_SIZE,
    time_col: str = "order_date",
) -> DataFrame:
    """Windows of one customer that start within ``[start, end]``, both ends included.

    Without bounds: the hour up to ``now``. Customer and time are filtered before the
    windows are built, so the scan only reads what can matter.
    """
    now = F.current_timestamp() if now is None else now
    start = F.timestamp_millis(F.lit(start_ms)) if start_ms is not None else now - F.expr("INTERVAL 1 HOUR")
    end = F.timestamp_millis(F.lit(end_ms)) if end_ms is not None else now
    wanted = df.filter(
        (F.col("customer_id") == F.lit(customer))
        & (F.col(time_col) >= start)
        & (F.col(time_col) < end + F.expr(f"INTERVAL {size}"))
    )
    return windowed_counts(wanted, size, time_col).filter(F.col("window_start").between(start, end))


def dashboard_totals(df: DataFrame) -> DataFrame:
    """Totals over all customers; zeros when there are no orders."""
    money = "decimal(38,2)"
    return customer_stats(df).agg(
        F.coalesce(F.sum("order_count"), F.lit(0)).cast("bigint").alias("total_orders"),
        F.coalesce(F.sum("total_amount").cast(money), F.lit(0).cast(money)).alias("total_revenue"),
        F.count(F.lit(1)).alias("customer_count"),
    )


def notification_stats(df: DataFrame) -> DataFrame:
    """Counts by status from one pass; the total covers every status."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == fixed.SENT).alias("sent"),
        F.count_if(F.col("status") == fixed.FAILED).alias("failed"),
        F.count_if(F.col("status") == fixed.PENDING).alias("pending"),
    )


def count_by_status(df: DataFrame, status: str) -> DataFrame:
    return df.filter(F.col("status") == status).agg(F.count(F.lit(1)).alias("n"))


def batch_ids(
    df: DataFrame,
    batch_rows: int = fixed.BATCH_ROWS,
    id_col: str = "order_id",
    partition: str = "partition",
    offset: str = "offset",
) -> DataFrame:
    """The ids of each consumed batch as one text, in offset order.

    A batch is ``batch_rows`` consecutive offsets of one partition. Positions are unique
    within a partition, so no group can hold more than ``batch_rows`` ids. Records without
    a position belong to no batch: :func:`batch_rejects`.
    """
    df = df.filter(F.col(partition).isNotNull() & F.col(offset).isNotNull())
    entry = F.struct(F.col(offset).alias("at"), F.col(id_col).alias("id"))
    ids = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["id"])
    return (
        df.groupBy(partition, F.expr(f"`{offset}` div {int(batch_rows)}").alias("batch"))
        .agg(F.array_join(ids, ", ").alias("ids"))
    )


def batch_rejects(df: DataFrame, partition: str = "partition", offset: str = "offset") -> DataFrame:
    """The records :func:`batch_ids` leaves out."""
    return df.filter(F.col(partition).isNull() | F.col(offset).isNull())


def as_map(df: DataFrame, key: str, value: str, pages: int) -> DataFrame:
    """A keyed table in map shape, spread over ``pages`` rows by the hash of the key.

    One map of all keys would have to fit in one row; choose ``pages`` so that
    keys / pages stays small.
    """
    page = F.pmod(F.xxhash64(key), F.lit(pages)).alias("page")
    entries = F.collect_list(F.struct(F.col(key), F.col(value)))
    return df.groupBy(page).agg(F.map_from_entries(entries).alias("entries"))
