"""Every operator as a query over the stored tables.

Money leaves as ``decimal(38,2)`` and times as ``timestamp_ntz``; no query depends on the
current time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed, schemas
from tidemark.functions import headers as hdr
from tidemark.functions.columns import derived_id, money_text, whole_seconds_ms
from tidemark.operators import (
    analytics,
    consistency,
    dedup,
    delivery,
    enrich,
    folds,
    lateness,
    lookup,
    payments,
    saga,
    sla,
)
from tidemark.plans import adapters as a
from tidemark.session import run_dir, use_utc
from tidemark.sinks import writers
from tidemark.sources import records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

POSITION = ["partition", "offset"]
RANGE_CUSTOMER = "customer-7"
RANGE_START_MS = 1704412800000  # 2024-01-05 00:00:00
RANGE_END_MS = 1705276800000  # 2024-01-15 00:00:00
HISTORY_ENDS = "2024-01-16 00:00:00"
ARRIVAL = {"partition": "partition", "position": "arrival", "ties": ("event_id",)}


def _result(df: DataFrame) -> DataFrame:
    """Output types that do not depend on the engine."""
    types = {
        T.DecimalType: schemas.WIDE_MONEY,
        T.TimestampType: T.TimestampNTZType(),
    }
    return df.select(
        *[
            F.col(f.name).cast(types[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in types
            else F.col(f.name)
            for f in df.schema
        ]
    )


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _result(fn(use_utc(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return run


def _two_largest(rows):
    """The two largest amounts of each customer, which differ."""
    rows = rows.drop_duplicates().sort_values(["customer_id", "total_amount"])
    return rows.groupby("customer_id", sort=True).tail(2)


def _second(states):
    found = states.groupby("customer_id", sort=True)["total_amount"]
    second = found.min().where(found.size() > 1)
    return second.rename("second_amount").reset_index()


@query
def customer_second_amounts(spark, d):
    """A fold of the user's own: the second largest amount that a customer ever paid."""
    return folds.fold_by(
        a.order_events(spark, d).select("customer_id", "total_amount").filter("total_amount IS NOT NULL"),
        ["customer_id"],
        add=lambda rows: rows,
        merge=_two_largest,
        state="total_amount decimal(18,2)",
        finish=_second,
        result="second_amount decimal(18,2)",
    )


@query
def notifications_without_position(spark, d):
    """Rows that cannot be stored: their record has no place in the log."""
    lost = F.when(F.col("event_id") % 11 != 0, F.col("partition"))
    rows = delivery.notification_rows(a.order_events(spark, d).withColumn("partition", lost))
    _, rejected = writers.split_by_id(rows)
    return rejected.select("order_id", "customer_id", "message", "msg_offset")


@query
def orders_sent_with_hook(spark, d):
    """A hook sees the records before they are sent and adds a header."""
    folder = run_dir(spark, "hooked")

    def stamp(df):
        return hdr.stamp(df.withColumn("headers", F.array().cast(schemas.HEADERS)), F.lit(RANGE_START_MS))

    orders = a.order_events(spark, d).select(*a.ORDER_COLUMNS, *POSITION)
    writers.write_events(orders, folder, fixed.TOPIC_ORDERS, hook=stamp)
    return records.header_rows(records.read_files(spark, folder), "key", "partition", "offset")


@query
def saga_fallback_events(spark, d):
    """Orders without an amount: a failed payment event, and no row in the payment table."""
    amount = F.when(F.col("o_orderkey") % 50 != 0, F.col("total_amount")).cast("decimal(18,2)")
    orders = a.saga_orders(spark, d).withColumn("total_amount", amount)
    ran = saga.run_saga(orders, a.PAYMENT_LIMIT, a.INVENTORY_LIMIT).filter("total_amount IS NULL")
    rows = saga.payment_table(ran).select("order_id", F.lit(True).alias("in_table"))
    log = saga.event_log(ran).select("seq", "topic", F.col("key").alias("order_id"), F.col("metadata.event_type"))
    return log.join(rows, "order_id", "left").select("seq", "topic", "order_id", "event_type", "in_table")


# --- sources and sinks ------------------------------------------------------------------


@query
def orders_decode(spark, d):
    decoded = records.decode(a.order_records(spark, d), schemas.ORDER_PLACED)
    return decoded.select(*a.ORDER_COLUMNS, *POSITION)


def _with_broken_values(df: DataFrame) -> DataFrame:
    """Errors lose the end of their JSON."""
    cut = F.expr("substring(value, 1, length(value) - 1)")
    return df.withColumn("value", F.when(F.col("event_type") == "error", cut).otherwise(F.col("value")))


@query
def orders_decode_rejected(spark, d):
    orders = a.order_events(spark, d)
    broken = orders.withColumns(
        {"key": F.col("order_id"), "value": writers.json_of(a.ORDER_COLUMNS)}
    ).transform(_with_broken_values)
    return records.decode_rejects(broken, schemas.ORDER_PLACED).select(
        "key", *POSITION, "reject_reason"
    )


def _json_fields(columns: list[str], value: str = "value") -> list:
    """What a reader finds in the JSON under the names of the fields: text, and money."""
    found = {c: F.get_json_object(value, f"$.{schemas.camel(c)}") for c in columns}
    money = [c for c in columns if c.endswith("amount")]
    return [(f.cast(schemas.MONEY) if c in money else f).alias(c) for c, f in found.items()]


@query
def orders_encode(spark, d):
    return a.order_records(spark, d).select(
        "key", "topic", "partition", *_json_fields(a.ORDER_COLUMNS)
    )


@query
def payments_encode(spark, d):
    events = payments.payment_events(
        payments.publish(a.payment_requests(spark, d), atomic=True, limit=a.PAYMENT_LIMIT)
    )
    out = writers.to_records(events, fixed.TOPIC_PAYMENTS, key="payment_id")
    return out.select("key", "topic", *_json_fields([f.name for f in schemas.PAYMENT_PROCESSED]))


@query
def orders_from_partition(spark, d):
    return records.from_partitions(a.order_events(spark, d), [1]).select(
        *a.ORDER_COLUMNS, *POSITION
    )


@query
def orders_to_partition(spark, d):
    orders = a.order_events(spark, d)
    return writers.to_partition(orders, F.col("k") % 4).select("order_id", *POSITION)


@query
def order_headers(spark, d):
    sent = a.with_order_headers(a.order_events(spark, d)).transform(
        lambda df: hdr.stamp(df, whole_seconds_ms(F.col("order_date")) + 1)
    )
    read = sent
    for name in (
        fixed.HEADER_CORRELATION,
        fixed.HEADER_SOURCE,
        fixed.HEADER_VERSION,
        fixed.HEADER_MESSAGE_TYPE,
        fixed.HEADER_INTERCEPTED,
    ):
        read = records.header(read, name)
    return read.select(
        "order_id",
        "correlation_id",
        "source",
        "event_version",
        "message_type",
        "intercepted_at",
        delivery.header_message().alias("message"),
    )


@query
def order_headers_exploded(spark, d):
    return records.header_rows(a.with_order_headers(a.order_events(spark, d)), "order_id")


@query
def orders_event_timestamp(spark, d):
    return a.order_events(spark, d).select(
        "order_id", whole_seconds_ms(F.col("order_date")).alias("event_ms")
    )


# --- projections and filters ------------------------------------------------------------

ENRICHED = [*a.ORDER_COLUMNS, "order_category", "processing_status"]


def _enriched(spark, d):
    return enrich.enrich(a.order_events(spark, d))


@query
def orders_enriched(spark, d):
    return _enriched(spark, d).select(ENRICHED)


@query
def orders_valid(spark, d):
    return enrich.valid_orders(_enriched(spark, d)).select(ENRICHED)


@query
def orders_rejected(spark, d):
    return enrich.rejected_orders(a.order_events(spark, d)).select(
        "order_id", "quantity", "total_amount", "reject_reason"
    )


@query
def orders_high_value(spark, d):
    return enrich.split_by_category(enrich.valid_orders(_enriched(spark, d)))[0].select(ENRICHED)


@query
def orders_regular(spark, d):
    return enrich.split_by_category(enrich.valid_orders(_enriched(spark, d)))[1].select(ENRICHED)


@query
def orders_routed(spark, d):
    return writers.route(enrich.valid_orders(_enriched(spark, d))).select("topic", *ENRICHED)


@query
def orders_from_requests(spark, d):
    requests = a.payment_requests(spark, d).withColumnRenamed("amount", "total_amount")
    events = enrich.to_events(requests, "o_orderkey", F.col("order_date"))
    return events.select(
        "order_id",
        "customer_id",
        "product_id",
        "quantity",
        F.col("total_amount").alias("amount"),
        "transaction_id",
    )


# --- notification and payment tables ----------------------------------------------------


def _notifications(spark, d):
    consumed = dedup.first_per_key(
        a.with_replays(a.with_order_headers(a.order_events(spark, d)), "event_id"), "order_id"
    )
    kind = F.col("event_type")
    methods = F.array(*map(F.lit, fixed.CONSUMER_METHODS))
    method = F.element_at(methods, (F.col("event_id") % len(fixed.CONSUMER_METHODS) + 1).cast("int"))
    status = (
        F.when(kind == "error", fixed.FAILED)
        .when(kind == "signup", fixed.PENDING)
        .otherwise(fixed.SENT)
    )
    return delivery.notification_rows(consumed, method, status)


@query
def notifications(spark, d):
    return _notifications(spark, d)


@query
def payments_table(spark, d):
    sent = payments.publish(a.payment_requests(spark, d), atomic=False, limit=a.PAYMENT_LIMIT)
    events = sent.withColumns(
        {"status": F.lit(fixed.PROCESSED), "processed_at": F.col("order_date")}
    )
    return delivery.payment_rows(events.filter("payment_sent"), now=F.col("order_date"))


@query
def find_by_order(spark, d):
    # many ids at once: those of the orders in the other table
    wanted = a.payment_requests(spark, d).select("order_id")
    return lookup.by_order(_notifications(spark, d), wanted, unique=True)


@query
def find_by_customer(spark, d):
    return lookup.by_customer(_notifications(spark, d), RANGE_CUSTOMER)


@query
def find_by_status(spark, d):
    return lookup.by_status(_notifications(spark, d), fixed.PENDING)


@query
def find_by_method(spark, d):
    return lookup.by_method(_notifications(spark, d), "batch")


@query
def find_by_payment(spark, d):
    # the payment of order 7: its id is made from the number of the order, which is stored
    orders = a.saga_orders(spark, d).filter("o_orderkey = 7")
    table = saga.payment_table(saga.run_saga(orders, a.PAYMENT_LIMIT, a.INVENTORY_LIMIT))
    return lookup.by_key(table.drop("processed_at"), "payment_id", derived_id("payment", F.lit("7")))


@query
def find_payment_by_order(spark, d):
    """At most one payment per asked order; the asked ones are the orders of one state."""
    wanted = a.payment_requests(spark, d).filter("order_status = 'P'").select("order_id")
    table = saga.payment_table(_saga(spark, d))
    return lookup.one_by_order(table, wanted).select("order_id", "payment_id", "amount", "status")


@query
def find_reservation_by_order(spark, d):
    wanted = a.payment_requests(spark, d).filter("order_status = 'P'").select("order_id")
    table = saga.reservation_table(_saga(spark, d))
    return lookup.one_by_order(table, wanted).select("order_id", "reservation_id", "quantity", "status")


@query
def find_order(spark, d):
    table = saga.order_table(_saga(spark, d))
    return lookup.by_order(table, ["7", "12", "no such order"]).select("order_id", "customer_id", "status")


# --- analytics --------------------------------------------------------------------------


@query
def customer_order_counts(spark, d):
    return analytics.order_counts(a.order_events(spark, d))


@query
def customer_total_amounts(spark, d):
    return analytics.total_amounts(a.order_events(spark, d))


@query
def customer_windowed_counts(spark, d):
    return analytics.windowed_counts(a.order_events(spark, d))


@query
def windowed_counts_range(spark, d):
    return analytics.windowed_counts_for(
        a.order_events(spark, d, RANGE_CUSTOMER), RANGE_CUSTOMER, RANGE_START_MS, RANGE_END_MS
    )


@query
def late_events(spark, d):
    late = lateness.late_events(a.out_of_order(a.order_events(spark, d)), **ARRIVAL)
    return late.select(*a.ORDER_COLUMNS, "arrival", "stream_time")


@query
def windowed_counts_with_grace(spark, d):
    return lateness.windowed_counts_with_grace(
        a.out_of_order(a.order_events(spark, d)), **ARRIVAL
    )


def _asked_customers(spark, d):
    key = F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))
    return a.table(spark, d, "customer").select(key.alias("customer_id"))


@query
def count_for_customers(spark, d):
    table = analytics.order_counts(a.order_events(spark, d))
    return lookup.state_get(_asked_customers(spark, d), table, "customer_id", "order_count")


@query
def total_for_customers(spark, d):
    table = analytics.total_amounts(a.order_events(spark, d))
    return lookup.state_get(_asked_customers(spark, d), table, "customer_id", "total_amount")


@query
def dashboard_totals(spark, d):
    return analytics.dashboard_totals(a.order_events(spark, d))


#: Customers on a page of the table in map shape, about.
PAGE_KEYS = 10_000


@query
def order_counts_as_maps(spark, d):
    """The counts in map shape, a page per row; entries are shown in the order of their keys."""
    counts = analytics.order_counts(a.order_events(spark, d))
    number = max(1, -(-counts.count() // PAGE_KEYS))
    pages = analytics.as_map(counts, "customer_id", "order_count", number)
    entries = F.array_sort(F.map_entries("entries"))
    return pages.select(F.inline(entries).alias("customer_id", "order_count"))


@query
def money_format(spark, d):
    totals = analytics.total_amounts(a.order_events(spark, d))
    return totals.select("customer_id", money_text(F.col("total_amount")).alias("total_text"))


@query
def notification_stats(spark, d):
    return analytics.notification_stats(_notifications(spark, d))


@query
def count_by_status(spark, d):
    return analytics.count_by_status(_notifications(spark, d), fixed.FAILED)


@query
def notification_texts(spark, d):
    return delivery.notification_texts(a.order_events(spark, d))


@query
def batch_order_ids(spark, d):
    return analytics.batch_ids(a.order_events(spark, d), batch_rows=10)


# --- idempotent consumption -------------------------------------------------------------


@query
def orders_first_per_key(spark, d):
    replayed = a.with_replays(a.order_events(spark, d), "event_id")
    return dedup.first_per_key(replayed, "order_id").select(*a.ORDER_COLUMNS, *POSITION)


@query
def payments_first_per_key(spark, d):
    replayed = a.with_replays(a.payment_requests(spark, d), "o_orderkey")
    return dedup.first_per_key(replayed, "payment_id").select(
        "payment_id", "order_id", "customer_id", "amount", *POSITION
    )


@query
def orders_new_only(spark, d):
    orders = a.order_events(spark, d)
    history = orders.filter(F.col("order_date") < F.lit(HISTORY_ENDS).cast("timestamp"))
    batch = a.with_replays(orders, "event_id")
    return dedup.new_only(batch, history, "order_id").select(*a.ORDER_COLUMNS, *POSITION)


# --- publication and consistency --------------------------------------------------------


def _published(spark, d, atomic: bool):
    return payments.publish(a.signed_requests(spark, d), atomic=atomic, limit=a.PAYMENT_LIMIT)


@query
def payments_atomic(spark, d):
    return payments.payment_events(_published(spark, d, True)).select("payment_id", "order_id", "amount")


@query
def payments_non_atomic(spark, d):
    return payments.payment_events(_published(spark, d, False)).select("payment_id", "order_id", "amount")


@query
def payments_committed(spark, d):
    published = _published(spark, d, True)
    attempted = payments.payment_events(published, "payment_attempted")
    return records.committed_only(attempted, payments.commits(published), unique=True).select(
        "payment_id", "order_id", "amount"
    )


@query
def orders_published(spark, d):
    return payments.order_events(_published(spark, d, False)).select(
        "order_id", "customer_id", "product_id", "quantity", F.col("total_amount").alias("amount")
    )


@query
def payments_refused(spark, d):
    refused = payments.check_amount(a.signed_requests(spark, d))[1]
    return refused.select("order_id", "amount", "reason")


def _two_sides(spark, d):
    return a.two_sides(a.payment_requests(spark, d))


@query
def payments_with_order(spark, d):
    orders, paid = _two_sides(spark, d)
    return consistency.with_order_flag(paid, orders).select("payment_id", "order_id", "has_order")


@query
def order_consistency(spark, d):
    orders, paid = _two_sides(spark, d)
    known = a.payment_requests(spark, d).select("order_id")
    unknown = a.table(spark, d, "customer").select(
        F.concat(F.lit("unknown-"), F.col("c_custkey").cast("string")).alias("order_id")
    )
    return consistency.consistency(orders, paid, known.unionByName(unknown))


@query
def order_consistency_all(spark, d):
    orders, paid = _two_sides(spark, d)
    return consistency.consistency(orders, paid)


@query
def inconsistencies(spark, d):
    orders, paid = _two_sides(spark, d)
    return consistency.inconsistencies(paid, orders)


@query
def inconsistency_report(spark, d):
    """Every detail beside the number and the message of all of them."""
    orders, paid = _two_sides(spark, d)
    return consistency.inconsistency_report(paid, orders)


@query
def inconsistency_summary(spark, d):
    orders, paid = _two_sides(spark, d)
    return consistency.inconsistency_summary(paid, orders)


# --- delivery ---------------------------------------------------------------------------


#: Classes of failures that are tried again; the events tell which class a failure has.
RETRIED = ("error", "view")


def _attempts(spark, d):
    """The events as recorded attempts: their number, whether they failed, and of what class."""
    return a.order_events(spark, d).withColumns(
        {
            "attempt": (F.col("k") % 4 + 1).cast("int"),
            "failed": F.col("event_type") != "purchase",
            "failure_class": F.col("event_type"),
        }
    )


@query
def retry_schedule(spark, d):
    tries = delivery.retry_schedule(_attempts(spark, d))
    return tries.select("order_id", "attempt", "delay_ms", "last_attempt")


@query
def dead_letters(spark, d):
    dead = delivery.dead_letters(_attempts(spark, d), F.col("failed"), include=RETRIED)
    return dead.select(*a.ORDER_COLUMNS, "attempt", "failure_class")


@query
def failure_routes(spark, d):
    routed = delivery.route_failures(_attempts(spark, d), F.col("failed"), include=RETRIED)
    return routed.select("order_id", "attempt", "failure_class", "topic", "next_attempt", "next_delay_ms")


# --- saga -------------------------------------------------------------------------------


def _saga(spark, d):
    return saga.run_saga(a.saga_orders(spark, d), a.PAYMENT_LIMIT, a.INVENTORY_LIMIT)


@query
def saga_orders(spark, d):
    return saga.order_table(_saga(spark, d))


@query
def saga_payments(spark, d):
    return saga.payment_table(_saga(spark, d))


@query
def saga_inventory(spark, d):
    return saga.reservation_table(_saga(spark, d))


@query
def saga_refunds(spark, d):
    return saga.refund_events(_saga(spark, d))


@query
def saga_refunds_by_step(spark, d):
    paid = saga.pay(a.saga_orders(spark, d), a.PAYMENT_LIMIT)
    stock = saga.reserve(paid, a.INVENTORY_LIMIT)
    return saga.refunds(stock, paid)


@query
def saga_orders_by_step(spark, d):
    orders = a.saga_orders(spark, d)
    paid = saga.pay(orders, a.PAYMENT_LIMIT)
    refunded = saga.refunds(saga.reserve(paid, a.INVENTORY_LIMIT), paid)
    changes = (
        saga.placed(orders)
        .unionByName(saga.cancel_failed(paid))
        .unionByName(saga.cancel_refunded(refunded))
    )
    return saga.latest_status(changes)


@query
def saga_cancellations(spark, d):
    return saga.cancel_events(_saga(spark, d))


@query
def saga_emails(spark, d):
    return saga.confirmation_emails(saga.reservation_table(_saga(spark, d)))


@query
def saga_event_log(spark, d):
    return saga.event_log(_saga(spark, d)).select(
        "topic",
        F.col("key").alias("order_id"),
        "seq",
        F.col("metadata.event_type").alias("event_type"),
        F.col("metadata.event_version").alias("event_version"),
        F.col("metadata.source").alias("source"),
        F.col("metadata.transaction_id").alias("transaction_id"),
        F.col("metadata.timestamp").alias("timestamp"),
    )


@query
def saga_event_dispatch(spark, d):
    sent = saga.envelope_json(saga.event_log(_saga(spark, d))).select("value")
    events = saga.dispatch_all(sent)
    return events.select(
        F.col("metadata.event_type").alias("event_type"),
        "order_id",
        "payment_id",
        "reservation_id",
        F.coalesce("total_amount", "amount").alias("amount"),
        "quantity",
        "status",
        "reason",
    )


def _disturbed(log):
    """The log with swapped places, repeats, and events of another type."""
    number = F.col("key").cast("bigint")
    swapped = (
        F.when((number % 5 == 0) & (F.col("seq") == 2), 3)
        .when((number % 5 == 0) & (F.col("seq") == 3), 2)
        .otherwise(F.col("seq"))
    )
    log = log.withColumn("seq", swapped)
    paid = F.col("metadata.event_type") == fixed.PAYMENT_PROCESSED
    again = log.filter(paid & (number % 7 == 0)).withColumn("seq", F.lit(6))
    shipped = F.col("metadata").withField("event_type", F.lit("OrderShipped"))
    foreign = log.filter(paid & (number % 11 == 0)).withColumns(
        {"seq": F.when(number % 2 == 0, 0).otherwise(7), "metadata": shipped}
    )
    return log.unionByName(again).unionByName(foreign)


@query
def saga_trace(spark, d):
    return saga.saga_trace(_disturbed(saga.event_log(_saga(spark, d))))


@query
def saga_outcomes(spark, d):
    return saga.saga_outcomes(_saga(spark, d))


# --- service levels ---------------------------------------------------------------------


@query
def sla_report(spark, d):
    return sla.sla_report(a.request_log(spark, d), max_fail=0.2, max_p95=150)
