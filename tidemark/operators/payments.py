"""Publishing a payment and its order together, or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.columns import derived_id


def _refused():
    # Zero is accepted although the text asks for a positive amount.
    return F.col("amount").isNull() | (F.col("amount") < 0)


def check_amount(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)``; refused rows carry the reason."""
    refused = requests.filter(_refused()).withColumn("reason", F.lit(fixed.REFUSED_AMOUNT))
    return requests.filter(~_refused()), refused


def publish(requests: DataFrame, atomic: bool, limit=fixed.PUBLISH_LIMIT) -> DataFrame:
    """What becomes of every request.

    The payment goes out first; above ``limit`` the order then fails. ``atomic`` takes
    the payment back in that case, otherwise it stays without an order. Adds

    - ``payment_attempted``: the payment was handed to the topic,
    - ``payment_sent`` / ``order_sent``: readers of committed events see it,
    - ``reason``: why the pair is not complete.
    """
    refused = _refused()
    too_large = F.coalesce(F.col("amount") > F.lit(limit), F.lit(False))
    order_sent = ~refused & ~too_large
    payment_sent = order_sent if atomic else ~refused
    return requests.withColumns(
        {
            "payment_attempted": ~refused,
            "payment_sent": payment_sent,
            "order_sent": order_sent,
            "reason": F.when(refused, fixed.REFUSED_AMOUNT).when(
                too_large, fixed.ORDER_EVENT_FAILED
            ),
        }
    )


def with_ids(requests: DataFrame) -> DataFrame:
    """Payment and transaction ids, derived from the order id."""
    return requests.withColumns(
        {
            "payment_id": derived_id("payment", F.col("order_id")),
            "transaction_id": derived_id("transaction", F.col("order_id")),
        }
    )


def payment_events(published: DataFrame, sent: str = "payment_sent", *extra: str) -> DataFrame:
    """The payments for which ``sent`` holds, with ``extra`` columns of the publication."""
    return published.filter(F.col(sent)).select(
        "payment_id",
        "order_id",
        "customer_id",
        "amount",
        F.lit(fixed.PROCESSED).alias("status"),
        F.col("order_date").alias("processed_at"),
        "transaction_id",
        *extra,
    )


def order_events(published: DataFrame) -> DataFrame:
    """One unit of the default product per published order."""
    return published.filter("order_sent").select(
        "order_id",
        "customer_id",
        F.lit(fixed.DEFAULT_PRODUCT).alias("product_id"),
        F.lit(1).alias("quantity"),
        F.col("amount").alias("total_amount"),
        "order_date",
        "transaction_id",
    )


def commits(published: DataFrame) -> DataFrame:
    """The transactions that were committed."""
    return published.filter("order_sent").select("transaction_id")
