"""Do the payments and the orders tell the same story?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.skew import anti_join, salted_join, semi_join


def with_order_flag(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Every payment with ``has_order``; one order may have any number of payments."""
    known = orders.select("order_id").distinct().withColumn("_known", F.lit(True))
    joined = salted_join(payments, known, "order_id")
    return joined.withColumn("has_order", F.col("_known").isNotNull()).drop("_known")


def consistency(orders: DataFrame, payments: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One verdict per order id: of the asked ``ids``, or of every id on either side.

    The sides are stacked and folded by order id in one aggregation, so repeated orders
    or payments neither multiply rows nor load one task.
    """

    def side(df: DataFrame, asked: bool, order: bool, payment: bool) -> DataFrame:
        return df.select(
            "order_id",
            F.lit(asked).alias("asked"),
            F.lit(order).alias("has_order"),
            F.lit(payment).alias("has_payment"),
        )

    sides = side(orders, False, True, False).unionByName(side(payments, False, False, True))
    if ids is not None:
        sides = sides.unionByName(side(ids, True, False, False))
    folded = (
        sides.filter("order_id IS NOT NULL")
        .groupBy("order_id")
        .agg(*[F.max(c).alias(c) for c in ("asked", "has_order", "has_payment")])
    )
    if ids is not None:
        folded = folded.filter("asked")
    both = F.col("has_order") & F.col("has_payment")
    message = (
        F.when(both, fixed.CONSISTENT)
        .when(F.col("has_payment"), fixed.PAYMENT_ONLY)
        .when(F.col("has_order"), fixed.ORDER_ONLY)
        .otherwise(fixed.NEITHER)
    )
    return folded.select(
        "order_id",
        both.alias("is_consistent"),
        "has_order",
        "has_payment",
        message.alias("message"),
    )


def _detail(payments: DataFrame) -> DataFrame:
    return payments.select(
        F.lit("PAYMENT_WITHOUT_ORDER").alias("type"),
        "payment_id",
        "order_id",
        "customer_id",
        F.lit(fixed.PAYMENT_ONLY).alias("issue"),
    )


def inconsistencies(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per payment that has no order."""
    return _detail(anti_join(payments, orders, "order_id"))


def _summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.when(F.col("total") == 0, fixed.NO_INCONSISTENCIES)
        .otherwise(F.format_string(fixed.FOUND_INCONSISTENCIES, F.col("total").cast("string")))
        .alias("message"),
    )


def inconsistency_summary(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Their number and a message; the details are :func:`inconsistencies`."""
    return _summary(inconsistencies(payments, orders))


def inconsistency_report(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Every detail as a row, with the number of all and the message beside it; one row
    without a detail if there is none. The summary is one row, so it goes to every task."""
    found = inconsistencies(payments, orders)
    return F.broadcast(_summary(found)).join(found, F.col("total") > 0, "left")


def open_inconsistencies(payments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """:func:`inconsistencies` as a stream stands, without a bound on the wait for an order.

    ``verdicts`` are the newest updates per order id of :func:`consistency` run over a stream
    of orders and one of payments (in update mode): a payment is reported with the verdict that
    its order is missing, and withdrawn by a later verdict once the order has come, whichever
    side comes first. The stream keeps one row per order id, an order once; the payments
    themselves stay in their table (``payments``), where those of one order may be any number. A
    payment without an order id has no order and is reported at once.
    """
    missing = verdicts.filter("has_payment AND NOT has_order").select("order_id")
    reported = semi_join(payments, missing, "order_id", unique=True)
    return _detail(reported).unionByName(_detail(payments.filter("order_id IS NULL")))


def stream_inconsistencies(
    payments: DataFrame,
    orders: DataFrame,
    within: str = "10 minutes",
    payment_time: str = "processed_at",
    order_time: str = "order_date",
    salts: int = 16,
) -> DataFrame:
    """Payments of a stream whose order does not show up within ``within`` of them, before or
    after; an order further away counts as missing. :func:`open_inconsistencies` has no bound.

    The verdict waits until the watermark rules out a later order, since the two topics
    are not in step. The payments of one order are dealt over ``salts`` tasks, for which
    each order is kept that many times. A payment without an order id has no order, however
    long one waits, and is reported at once.
    """
    astray = payments.filter("order_id IS NULL")
    payments = payments.filter("order_id IS NOT NULL")
    dealt = F.pmod(F.xxhash64("payment_id"), F.lit(salts)).cast("int")
    pay = payments.withColumn("_salt", dealt).withWatermark(payment_time, within)
    placed = orders.select(
        F.col("order_id").alias("_order_id"),
        F.col(order_time).alias("_placed"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_for"),
    ).withWatermark("_placed", within)
    near = F.expr(
        "order_id = _order_id AND _salt = _for"
        f" AND _placed BETWEEN {payment_time} - INTERVAL {within}"
        f" AND {payment_time} + INTERVAL {within}"
    )
    missing = pay.join(placed, near, "left_outer").filter("_order_id IS NULL")
    return _detail(missing).unionByName(_detail(astray))
