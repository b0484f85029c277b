"""Classify, enrich, validate and split orders. All of it is narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.columns import derived_id


def category(threshold=fixed.HIGH_VALUE_THRESHOLD, amount: str = "total_amount") -> Column:
    """Class of an order; an order without an amount has none."""
    return F.when(
        F.col(amount).isNotNull(),
        F.when(F.col(amount) >= F.lit(threshold), fixed.HIGH_VALUE).otherwise(fixed.REGULAR),
    )


def categorize(df: DataFrame, threshold=fixed.HIGH_VALUE_THRESHOLD) -> DataFrame:
    return df.withColumn("order_category", category(threshold))


def enrich(
    df: DataFrame,
    threshold=fixed.HIGH_VALUE_THRESHOLD,
    processed_at: Column | None = None,
) -> DataFrame:
    """Add class, processing time and status, one row out per row in."""
    now = F.current_timestamp() if processed_at is None else processed_at
    return df.withColumns(
        {
            "order_category": category(threshold),
            "processed_at": now,
            "processing_status": F.lit(fixed.PROCESSED),
        }
    )


def reject_reason() -> Column:
    """Why an order is refused; null for a valid one."""
    return (
        F.when(F.col("quantity").isNull(), "quantity missing")
        .when(F.col("quantity") <= 0, "quantity not positive")
        .when(F.col("total_amount").isNull(), "amount missing")
        .when(F.col("total_amount") <= 0, "amount not positive")
    )


def valid_orders(df: DataFrame) -> DataFrame:
    # A comparison with null is not true, so this also drops missing values; comparisons of
    # stored columns reach the file scan.
    return df.filter((F.col("quantity") > 0) & (F.col("total_amount") > 0))


def rejected_orders(df: DataFrame) -> DataFrame:
    """Exactly the rows :func:`valid_orders` leaves out, with the reason."""
    return df.withColumn("reject_reason", reject_reason()).filter("reject_reason IS NOT NULL")


def observe_validity(df: DataFrame, observation: Observation) -> DataFrame:
    """Count valid and rejected rows while the data passes, without another scan."""
    bad = reject_reason().isNotNull()
    return df.observe(
        observation, F.count_if(~bad).alias("valid"), F.count_if(bad).alias("rejected")
    )


def of_category(df: DataFrame, wanted: str) -> DataFrame:
    return df.filter(F.col("order_category") == wanted)


def split_by_category(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(high value, regular)``. To write both, :func:`tidemark.sinks.writers.route`
    reads the input once instead of twice."""
    return of_category(df, fixed.HIGH_VALUE), of_category(df, fixed.REGULAR)


def to_events(requests: DataFrame, key: str, now: Column) -> DataFrame:
    """Order events from requests: derived ids, ``now`` as the order date."""
    request_key = F.col(key).cast("string")
    return requests.select(
        derived_id("order", request_key).alias("order_id"),
        "customer_id",
        "product_id",
        "quantity",
        "total_amount",
        now.alias("order_date"),
        derived_id("transaction", request_key).alias("transaction_id"),
    )
