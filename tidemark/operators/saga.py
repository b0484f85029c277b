"""The order -> payment -> inventory chain with refund and cancellation.

Each order's whole course depends on its own row, so :func:`run_saga` derives it in one
narrow pass and the tables and events are projections of that. The step functions do the
same on separate tables, for steps that run as jobs of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed, schemas
from tidemark.functions.columns import JSON_TIME, derived_id, whole_units
from tidemark.operators.skew import semi_join
from tidemark.sinks.writers import with_default
from tidemark.sources.records import parsed_once

OUTCOME_CONFIRMED = "CONFIRMED"
OUTCOME_REFUNDED = "INVENTORY_UNAVAILABLE"
OUTCOME_FAILED = "PAYMENT_FAILED"
#: How a trace names events that are no step.
OTHER_STEP = "other"


def _payment_status(amount: Column, limit) -> Column:
    # A missing amount ends in the error branch: a failed payment event.
    paid = F.coalesce(amount <= F.lit(limit), F.lit(False))
    return F.when(paid, fixed.SUCCESS).otherwise(fixed.FAILED)


def _stock_status(amount: Column, limit) -> Column:
    return F.when(amount > F.lit(limit), fixed.UNAVAILABLE).otherwise(fixed.RESERVED)


def run_saga(
    orders: DataFrame,
    payment_limit=fixed.PAYMENT_LIMIT,
    inventory_limit=fixed.INVENTORY_LIMIT,
    at: Column | None = None,
) -> DataFrame:
    """Every order with its course: no shuffle, one row per order.

    ``orders`` holds one row per order id (see ``first_per_key``). ``at`` is the time the
    steps are stamped with, the order date unless given.
    """
    order_id = F.col("order_id")
    amount = F.col("total_amount")
    transaction = (
        F.col("transaction_id")
        if "transaction_id" in orders.columns
        else derived_id("transaction", order_id)
    )
    charged = orders.withColumns(
        {
            "transaction_id": transaction,
            "step_at": F.col("order_date") if at is None else at,
            "payment_id": derived_id("payment", order_id),
            "payment_result": _payment_status(amount, payment_limit),
        }
    )
    paid = F.col("payment_result") == fixed.SUCCESS
    stocked = charged.withColumns(
        {
            "reservation_id": F.when(paid, derived_id("reservation", order_id)),
            "stock_status": F.when(paid, _stock_status(amount, inventory_limit)),
            "stock_quantity": F.when(paid, whole_units(amount)),
        }
    )
    outcome = (
        F.when(F.col("payment_result") == fixed.FAILED, OUTCOME_FAILED)
        .when(F.col("stock_status") == fixed.UNAVAILABLE, OUTCOME_REFUNDED)
        .otherwise(OUTCOME_CONFIRMED)
    )
    return stocked.withColumn("outcome", outcome)


def _is(outcome: str) -> Column:
    return F.col("outcome") == outcome


# --- final tables -----------------------------------------------------------------------


def order_table(saga: DataFrame) -> DataFrame:
    """Orders keep their status, PENDING where they have none, unless the chain cancelled
    them."""
    saga = with_default(saga, "status", fixed.PENDING)
    status = F.when(_is(OUTCOME_CONFIRMED), F.col("status")).otherwise(fixed.CANCELLED)
    return saga.select(
        "order_id",
        "customer_id",
        "product_id",
        "quantity",
        "total_amount",
        status.alias("status"),
        "order_date",
        "transaction_id",
    )


def payment_table(saga: DataFrame) -> DataFrame:
    """Payments in their final state; an order without an amount has none."""
    status = F.when(_is(OUTCOME_REFUNDED), fixed.REFUNDED).otherwise(F.col("payment_result"))
    return saga.filter(F.col("total_amount").isNotNull()).select(
        "payment_id",
        "order_id",
        "customer_id",
        F.col("total_amount").alias("amount"),
        status.alias("status"),
        F.col("step_at").alias("processed_at"),
        "transaction_id",
    )


def reservation_table(saga: DataFrame) -> DataFrame:
    return saga.filter(F.col("stock_status").isNotNull()).select(
        "reservation_id",
        "order_id",
        F.lit(fixed.DEFAULT_PRODUCT).alias("product_id"),
        F.col("stock_quantity").alias("quantity"),
        F.col("stock_status").alias("status"),
        F.col("step_at").alias("reserved_at"),
        "transaction_id",
    )


def saga_tables(
    orders: DataFrame, payment_limit=fixed.PAYMENT_LIMIT, inventory_limit=fixed.INVENTORY_LIMIT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(orders, payments, reservations)`` in their final state."""
    saga = run_saga(orders, payment_limit, inventory_limit)
    return order_table(saga), payment_table(saga), reservation_table(saga)


def refund_events(saga: DataFrame) -> DataFrame:
    return saga.filter(_is(OUTCOME_REFUNDED)).select(
        "payment_id",
        "order_id",
        F.col("total_amount").alias("amount"),
        F.col("step_at").alias("refunded_at"),
    )


def cancel_events(saga: DataFrame) -> DataFrame:
    """Cancel events exist for refunds only: a failed payment cancels without one."""
    return saga.filter(_is(OUTCOME_REFUNDED)).select(
        "order_id",
        F.lit(fixed.REASON_PAYMENT_REFUNDED).alias("reason"),
        F.col("step_at").alias("cancelled_at"),
    )


def confirmation_emails(reservations: DataFrame) -> DataFrame:
    text = F.format_string(fixed.CONFIRMATION_TEXT, F.col("order_id"), F.col("transaction_id"))
    return reservations.filter(F.col("status") == fixed.RESERVED).select(
        "order_id", "transaction_id", text.alias("text")
    )


def saga_outcomes(saga: DataFrame) -> DataFrame:
    """Number and amount of orders per outcome."""
    return saga.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.coalesce(F.sum("total_amount"), F.lit(0).cast("decimal(28,2)")).alias("amount"),
    )


# --- the event log ----------------------------------------------------------------------


def envelope(event_type: str, source: str, transaction: Column, at: Column) -> Column:
    """Metadata of an event, as a struct."""
    return F.struct(
        F.lit(event_type).alias("event_type"),
        F.lit(fixed.EVENT_VERSION).alias("event_version"),
        F.lit(source).alias("source"),
        transaction.alias("transaction_id"),
        at.alias("timestamp"),
    )


def payload_json(fields: dict[str, Column]) -> Column:
    """JSON payload; a missing field is left out, which reads back as null."""
    return F.to_json(
        F.struct(*[value.alias(schemas.camel(name)) for name, value in fields.items()]), JSON_TIME
    )


def wrap(
    df: DataFrame,
    event_type: str,
    source: str,
    at: Column,
    transaction: str = "transaction_id",
) -> DataFrame:
    """Events wrapped with metadata: ``key, metadata, payload``, keyed by order id."""
    fields = {f.name: F.col(f.name) for f in schemas.PAYLOADS[event_type]}
    return df.select(
        F.col("order_id").alias("key"),
        envelope(event_type, source, F.col(transaction), at).alias("metadata"),
        payload_json(fields).alias("payload"),
    )


def envelope_json(df: DataFrame) -> DataFrame:
    """``value`` as it travels: ``{"metadata": {...}, "payload": {...}}``."""
    metadata = F.struct(
        *[F.col("metadata")[f.name].alias(schemas.camel(f.name)) for f in schemas.METADATA]
    )
    # the payload already is JSON
    value = F.concat(
        F.lit('{"metadata":'),
        F.to_json(metadata, JSON_TIME),
        F.lit(',"payload":'),
        F.col("payload"),
        F.lit("}"),
    )
    return df.withColumn("value", value)


def _metadata(struct: Column) -> Column:
    return F.struct(*[struct[schemas.camel(f.name)].alias(f.name) for f in schemas.METADATA])


def read_envelopes(records: DataFrame) -> DataFrame:
    """``metadata`` and ``payload`` (JSON text) of wrapped events."""
    shape = T.StructType(
        [
            T.StructField("metadata", schemas.wire(schemas.METADATA)),
            T.StructField("payload", T.StringType()),
        ]
    )
    return parsed_once(records, F.from_json("value", shape)).withColumn(
        "metadata", _metadata(F.col("metadata"))
    )


# The events of one order by outcome, as step numbers.
_COURSES = {
    OUTCOME_FAILED: [1, 2],
    OUTCOME_CONFIRMED: [1, 2, 3],
    OUTCOME_REFUNDED: [1, 2, 3, 4, 5],
}
_SENDERS = {
    fixed.ORDER_PLACED: (fixed.TOPIC_ORDERS, fixed.ORDER_SERVICE),
    fixed.PAYMENT_PROCESSED: (fixed.TOPIC_PAYMENTS, fixed.PAYMENT_SERVICE),
    fixed.INVENTORY_RESERVED: (fixed.TOPIC_INVENTORY, fixed.INVENTORY_SERVICE),
    fixed.PAYMENT_REFUNDED: (fixed.TOPIC_PAYMENTS, fixed.PAYMENT_SERVICE),
    fixed.ORDER_CANCELLED: (fixed.TOPIC_ORDERS, fixed.ORDER_SERVICE),
}


def _payload_fields(event_type: str) -> dict[str, Column]:
    """Where the payload of an event comes from in a :func:`run_saga` row."""
    at = F.col("step_at")
    renamed = {
        fixed.PAYMENT_PROCESSED: {
            "amount": F.col("total_amount"),
            "status": F.col("payment_result"),
            "processed_at": at,
        },
        fixed.INVENTORY_RESERVED: {
            "product_id": F.lit(fixed.DEFAULT_PRODUCT),
            "quantity": F.col("stock_quantity"),
            "status": F.col("stock_status"),
            "reserved_at": at,
        },
        fixed.PAYMENT_REFUNDED: {"amount": F.col("total_amount"), "refunded_at": at},
        fixed.ORDER_CANCELLED: {
            "reason": F.lit(fixed.REASON_PAYMENT_REFUNDED),
            "cancelled_at": at,
        },
    }.get(event_type, {})
    return {f.name: renamed.get(f.name, F.col(f.name)) for f in schemas.PAYLOADS[event_type]}


def event_log(saga: DataFrame) -> DataFrame:
    """All events of all topics, in the order of their steps (``seq``).

    An order is repeated once per step it took and the event columns are filled in by
    step: one read of the orders, no shuffle, and no JSON for a reader that does not ask
    for the payload.
    """
    courses = [
        F.when(_is(outcome), F.array(*[F.lit(n) for n in steps]))
        for outcome, steps in _COURSES.items()
    ]
    steps = saga.withColumn("seq", F.explode(F.coalesce(*courses)))

    def by_step(value):
        chosen = F.when(F.col("seq") == 1, value(fixed.SAGA_STEPS[0]))
        for n, event_type in enumerate(fixed.SAGA_STEPS[1:], start=2):
            chosen = chosen.when(F.col("seq") == n, value(event_type))
        return chosen

    return steps.select(
        "seq",
        by_step(lambda e: F.lit(_SENDERS[e][0])).alias("topic"),
        F.col("order_id").alias("key"),
        F.struct(
            by_step(F.lit).alias("event_type"),
            F.lit(fixed.EVENT_VERSION).alias("event_version"),
            by_step(lambda e: F.lit(_SENDERS[e][1])).alias("source"),
            "transaction_id",
            F.col("step_at").alias("timestamp"),
        ).alias("metadata"),
        by_step(lambda e: payload_json(_payload_fields(e))).alias("payload"),
    )


def dispatch(envelopes: DataFrame, event_type: str) -> DataFrame:
    """Events of one type with their payload columns; other types are ignored."""
    schema = schemas.PAYLOADS[event_type]
    wanted = envelopes.filter(F.col("metadata.event_type") == event_type)
    return wanted.withColumn("_p", F.from_json("payload", schemas.wire(schema))).select(
        "metadata", *[F.col("_p")[schemas.camel(f.name)].alias(f.name) for f in schema]
    )


def dispatch_all(records: DataFrame) -> DataFrame:
    """Events of every known type from one parse of the records: the columns of all
    payloads, null where a type does not have them."""
    fields = {f.name: f for schema in schemas.PAYLOADS.values() for f in schema}
    shape = T.StructType(
        [
            T.StructField("metadata", schemas.wire(schemas.METADATA)),
            T.StructField("payload", schemas.wire(T.StructType(list(fields.values())))),
        ]
    )
    parsed = parsed_once(records.select("value"), F.from_json("value", shape))
    return parsed.filter(F.col("metadata.eventType").isin(*schemas.PAYLOADS)).select(
        _metadata(F.col("metadata")).alias("metadata"),
        *[F.col("payload")[schemas.camel(n)].alias(n) for n in fields],
    )


def saga_trace(log: DataFrame) -> DataFrame:
    """Course of each transaction: number of events, and the steps in the order of the log.

    A step stands where it first came; one that came more than once shows how often
    (``PaymentProcessed*2``). Events of other types stand together as ``other`` where the
    first of them came; steps without a place in the log come last.

    A place and a count per step is all that is kept of a transaction: the rows fold
    map-side, also when one transaction id holds a large part of the log.
    """
    kind = F.col("metadata.event_type")
    other = F.coalesce(~kind.isin(*fixed.SAGA_STEPS), F.lit(True))
    steps = [(step, kind == step) for step in fixed.SAGA_STEPS] + [(OTHER_STEP, other)]
    folded = log.groupBy(F.col("metadata.transaction_id").alias("transaction_id")).agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.min(F.when(here, F.col("seq"))).alias(f"_at{i}") for i, (_, here) in enumerate(steps)],
        *[F.count_if(here).alias(f"_n{i}") for i, (_, here) in enumerate(steps)],
    )
    shown = F.array(
        *[
            F.struct(
                F.col(f"_at{i}").isNull().alias("last"),
                F.col(f"_at{i}").alias("at"),
                F.lit(i).alias("step"),
                F.col(f"_n{i}").alias("n"),
                F.when(F.col(f"_n{i}") > 1, F.concat(F.lit(f"{step}*"), F.col(f"_n{i}").cast("string")))
                .otherwise(step)
                .alias("text"),
            )
            for i, (step, _) in enumerate(steps)
        ]
    )
    taken = F.array_sort(F.filter(shown, lambda s: s["n"] > 0))
    path = F.array_join(F.transform(taken, lambda s: s["text"]), ">")
    return folded.select("transaction_id", "n_events", path.alias("path"))


# --- the steps as separate jobs ----------------------------------------------------------


def pay(orders: DataFrame, limit=fixed.PAYMENT_LIMIT) -> DataFrame:
    """Payment events for placed orders, the failed fallback for a missing amount included.
    The payment table is the part of them that has an amount."""
    return orders.select(
        derived_id("payment", F.col("order_id")).alias("payment_id"),
        "order_id",
        "customer_id",
        F.col("total_amount").alias("amount"),
        _payment_status(F.col("total_amount"), limit).alias("status"),
        F.col("order_date").alias("processed_at"),
        "transaction_id",
    )


def reserve(payments: DataFrame, limit=fixed.INVENTORY_LIMIT) -> DataFrame:
    """Reservations for successful payments; a payment without an amount cannot be
    reserved and gets an UNAVAILABLE event of quantity 0."""
    known = F.col("amount").isNotNull()
    return payments.filter(F.col("status") == fixed.SUCCESS).select(
        derived_id("reservation", F.col("order_id")).alias("reservation_id"),
        "order_id",
        F.lit(fixed.DEFAULT_PRODUCT).alias("product_id"),
        F.when(known, whole_units(F.col("amount"))).otherwise(0).alias("quantity"),
        F.when(known, _stock_status(F.col("amount"), limit))
        .otherwise(fixed.UNAVAILABLE)
        .alias("status"),
        F.col("processed_at").alias("reserved_at"),
        "transaction_id",
    )


def refunds(inventory: DataFrame, payments: DataFrame) -> DataFrame:
    """One refund event per payment whose order has no stock, however often that was
    reported."""
    unavailable = inventory.filter(F.col("status") == fixed.UNAVAILABLE).select("order_id")
    return semi_join(payments, unavailable, "order_id", unique=True).select(
        "payment_id", "order_id", "amount", F.col("processed_at").alias("refunded_at")
    )


def apply_refunds(payments: DataFrame, refunded: DataFrame) -> DataFrame:
    """The payment table after the refunds. It has one row per payment id."""
    ids = refunded.select("payment_id").distinct().withColumn("_refunded", F.lit(True))
    status = F.when(F.col("_refunded"), fixed.REFUNDED).otherwise(F.col("status"))
    return (
        payments.join(ids, "payment_id", "left")
        .withColumn("status", status)
        .select(payments.columns)
    )


def cancel_failed(payments: DataFrame) -> DataFrame:
    """Status changes for failed payments. No cancel event goes with them."""
    return payments.filter(F.col("status") == fixed.FAILED).select(
        "order_id",
        F.lit(fixed.CANCELLED).alias("status"),
        F.lit(2).alias("seq"),
        F.lit(fixed.REASON_PAYMENT_FAILED).alias("reason"),
    )


def cancel_refunded(refunded: DataFrame) -> DataFrame:
    """Status changes for refunds; each is also published as a cancel event."""
    return refunded.select(
        "order_id",
        F.lit(fixed.CANCELLED).alias("status"),
        F.lit(5).alias("seq"),
        F.lit(fixed.REASON_PAYMENT_REFUNDED).alias("reason"),
    )


def placed(orders: DataFrame) -> DataFrame:
    """The first status of every order."""
    return orders.select(
        "order_id",
        F.lit(fixed.PENDING).alias("status"),
        F.lit(1).alias("seq"),
        F.lit(None).cast("string").alias("reason"),
    )


def latest_status(changes: DataFrame) -> DataFrame:
    """Fold status changes to one row per order. CANCELLED is final: a later change has
    no effect, and a second cancellation keeps the first reason."""
    cancelled = F.col("status") == fixed.CANCELLED
    return (
        changes.groupBy("order_id")
        .agg(
            F.bool_or(cancelled).alias("_cancelled"),
            F.max_by("status", "seq").alias("_last"),
            F.min_by(F.when(cancelled, F.col("reason")), F.when(cancelled, F.col("seq"))).alias(
                "reason"
            ),
        )
        .select(
            "order_id",
            F.when(F.col("_cancelled"), fixed.CANCELLED).otherwise(F.col("_last")).alias("status"),
            "reason",
        )
    )


# --- tables kept by the events --------------------------------------------------------


#: The events whose payload is a row of a table: orders, payments, reservations.
_ROWS_OF = {
    fixed.ORDER_PLACED: "placed",
    fixed.PAYMENT_PROCESSED: "paid",
    fixed.INVENTORY_RESERVED: "reserved",
    fixed.PAYMENT_REFUNDED: "refunded",
    fixed.ORDER_CANCELLED: "cancelled",
}


def courses(events: DataFrame) -> DataFrame:
    """What the events of each order (:func:`dispatch_all`) say so far: one row per order, with
    a struct of the payload of each kind of event, null while there is none.

    Of repeated events the earliest counts, of those the one with the smallest values, and the
    order of arrival does not matter, so the fold is the same in one batch and in many; on a stream (in update mode) its state is the
    state machine of the order. Events of one order are one row per task before the shuffle.
    Events without an order id belong to no order.
    """
    kind, at = F.col("metadata.event_type"), F.col("metadata.timestamp")
    rows = {}
    for event_type, name in _ROWS_OF.items():
        payload = [f.name for f in schemas.PAYLOADS[event_type] if f.name != "order_id"]
        row = F.struct(
            F.coalesce(at, F.lit(0).cast("timestamp")).alias("_at"),
            *payload,
            F.col("metadata.transaction_id").alias("transaction_id"),
        )
        # null where the event is another one, and nulls are passed over
        rows[name] = F.when(kind == event_type, row)
    # an event has one row and is sorted as that
    events = events.filter(F.col("order_id").isNotNull()).select("order_id", *[r.alias(n) for n, r in rows.items()])
    found = events.groupBy("order_id").agg(*[F.min(n).alias(n) for n in rows])
    return found.select("order_id", *[F.col(n).dropFields("_at").alias(n) for n in rows])


def _order_status() -> Column:
    """CANCELLED is final: no event takes it back, and none is needed twice."""
    failed = F.coalesce(F.col("paid.status") == fixed.FAILED, F.lit(False))
    ended = failed | F.col("cancelled").isNotNull() | F.col("refunded").isNotNull()
    return F.when(ended, fixed.CANCELLED).otherwise(fixed.PENDING)


def orders_of(found: DataFrame, *extra: str) -> DataFrame:
    """The order table of :func:`courses`: orders that were placed, with ``extra`` columns."""
    fields = ("customer_id", "product_id", "quantity", "total_amount")
    return found.filter("placed IS NOT NULL").select(
        "order_id",
        *[F.col(f"placed.{c}") for c in fields],
        _order_status().alias("status"),
        "placed.order_date",
        "placed.transaction_id",
        *extra,
    )


def payments_of(found: DataFrame, *extra: str) -> DataFrame:
    """The payment table of :func:`courses`, with ``extra`` columns. REFUNDED is final."""
    status = F.when(F.col("refunded").isNotNull(), fixed.REFUNDED).otherwise(F.col("paid.status"))
    return found.filter("paid IS NOT NULL").select(
        "paid.payment_id",
        "order_id",
        "paid.customer_id",
        "paid.amount",
        status.alias("status"),
        "paid.processed_at",
        "paid.transaction_id",
        *extra,
    )


def reservations_of(found: DataFrame, *extra: str) -> DataFrame:
    """The reservation table of :func:`courses`, with ``extra`` columns."""
    fields = ("product_id", "quantity", "status", "reserved_at", "transaction_id")
    return found.filter("reserved IS NOT NULL").select(
        "reserved.reservation_id", "order_id", *[F.col(f"reserved.{c}") for c in fields], *extra
    )
