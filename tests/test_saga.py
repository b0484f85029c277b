from __future__ import annotations

import json

import pytest
from conftest import values
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import saga

AMOUNTS = ["99.99", "500.00", "500.01", "600.00", "1000.00", "1000.01", "1500.00", None]


@pytest.fixture
def orders(make_orders):
    return make_orders([(f"o{i}", "c1", 1, a) for i, a in enumerate(AMOUNTS)])


@pytest.fixture
def outcome(orders):
    return saga.run_saga(orders)


def test_final_tables(orders):
    placed, paid, stock = saga.saga_tables(orders)
    assert [r[1] for r in values(placed, "order_id", "status")] == ["PENDING"] * 2 + ["CANCELLED"] * 6
    assert values(paid, "order_id", "status") == [
        ("o0", "SUCCESS"),
        ("o1", "SUCCESS"),
        ("o2", "REFUNDED"),
        ("o3", "REFUNDED"),
        ("o4", "REFUNDED"),
        ("o5", "FAILED"),
        ("o6", "FAILED"),
    ]
    assert values(stock, "order_id", "status", "quantity", "product_id") == [
        ("o0", "RESERVED", 99, "product-123"),
        ("o1", "RESERVED", 500, "product-123"),
        ("o2", "UNAVAILABLE", 500, "product-123"),
        ("o3", "UNAVAILABLE", 600, "product-123"),
        ("o4", "UNAVAILABLE", 1000, "product-123"),
    ]


def test_events(outcome):
    assert values(saga.refund_events(outcome), "order_id") == [("o2",), ("o3",), ("o4",)]
    assert values(saga.cancel_events(outcome), "order_id", "reason") == [
        ("o2", "Payment refunded"),
        ("o3", "Payment refunded"),
        ("o4", "Payment refunded"),
    ]
    mails = saga.confirmation_emails(saga.reservation_table(outcome))
    assert values(mails, "order_id", "text")[0] == (
        "o0",
        "Your order o0 has been confirmed and inventory reserved! TransactionId: t-o0",
    )
    assert values(mails, "order_id") == [("o0",), ("o1",)]


def test_trace_and_outcomes(outcome):
    trace = saga.saga_trace(saga.event_log(outcome))
    failed = "OrderPlaced>PaymentProcessed"
    stocked = failed + ">InventoryReserved"
    refunded = stocked + ">PaymentRefunded>OrderCancelled"
    assert values(trace, "transaction_id", "n_events", "path") == [
        ("t-o0", 3, stocked),
        ("t-o1", 3, stocked),
        ("t-o2", 5, refunded),
        ("t-o3", 5, refunded),
        ("t-o4", 5, refunded),
        ("t-o5", 2, failed),
        ("t-o6", 2, failed),
        ("t-o7", 2, failed),
    ]
    assert [r[:2] for r in values(saga.saga_outcomes(outcome), "outcome", "n_orders")] == [
        ("CONFIRMED", 2),
        ("INVENTORY_UNAVAILABLE", 3),
        ("PAYMENT_FAILED", 3),
    ]


def test_the_log_is_narrow(outcome):
    from conftest import plan_of

    assert "Exchange" not in plan_of(saga.event_log(outcome))


def test_log_topics(outcome):
    log = saga.event_log(outcome).filter("key = 'o2'")
    rows = log.select("seq", "topic", "metadata.event_type", "metadata.source").collect()
    assert sorted(tuple(r) for r in rows) == [
        (1, "orders", "OrderPlaced", "order-service"),
        (2, "payments", "PaymentProcessed", "payment-service"),
        (3, "inventory", "InventoryReserved", "inventory-service"),
        (4, "payments", "PaymentRefunded", "payment-service"),
        (5, "orders", "OrderCancelled", "order-service"),
    ]


def test_payment_event_before_the_refund_is_a_success(outcome):
    envelopes = saga.event_log(outcome)
    paid = saga.dispatch(envelopes, fixed.PAYMENT_PROCESSED)
    assert values(paid, "order_id", "status") == [
        ("o0", "SUCCESS"),
        ("o1", "SUCCESS"),
        ("o2", "SUCCESS"),
        ("o3", "SUCCESS"),
        ("o4", "SUCCESS"),
        ("o5", "FAILED"),
        ("o6", "FAILED"),
        ("o7", "FAILED"),
    ]


def test_envelopes_travel_as_nested_json(outcome):
    sent = saga.envelope_json(saga.event_log(outcome))
    first = json.loads(sent.filter("key = 'o0' AND seq = 1").first()["value"])
    assert first["metadata"]["eventType"] == "OrderPlaced"
    assert first["metadata"]["eventVersion"] == "1.0"
    assert first["payload"]["totalAmount"] == 99.99
    assert "transactionId" not in first["payload"]
    read = saga.read_envelopes(sent.select("key", "value"))
    for event_type in fixed.SAGA_STEPS:
        direct = saga.dispatch(saga.event_log(outcome), event_type)
        again = saga.dispatch(read, event_type)
        assert values(again, "*") == values(direct, "*")
    assert saga.dispatch_all(sent).count() == sent.count()


def test_wrap_single_events(orders):
    at = F.col("order_date")
    wrapped = saga.wrap(orders, fixed.ORDER_PLACED, fixed.ORDER_SERVICE, at)
    back = saga.dispatch(wrapped, fixed.ORDER_PLACED)
    assert values(back, "order_id", "total_amount") == values(orders, "order_id", "total_amount")


def test_steps_lead_to_the_same_tables(orders, outcome):
    paid = saga.pay(orders)
    stored = paid.filter("amount IS NOT NULL")
    stock = saga.reserve(paid)
    refunded = saga.refunds(stock.unionByName(stock), stored)
    assert values(refunded, "*") == values(saga.refund_events(outcome), *refunded.columns)
    assert values(saga.apply_refunds(stored, refunded), "*") == values(
        saga.payment_table(outcome), *stored.columns
    )
    assert values(stock, "*") == values(saga.reservation_table(outcome), *stock.columns)
    changes = (
        saga.placed(orders)
        .unionByName(saga.cancel_failed(paid))
        .unionByName(saga.cancel_refunded(refunded))
    )
    latest = saga.latest_status(changes)
    assert values(latest, "order_id", "status") == values(
        saga.order_table(outcome), "order_id", "status"
    )


def test_cancelled_is_final_and_keeps_its_first_reason(spark):
    changes = spark.createDataFrame(
        [
            ("a", "PENDING", 1, None),
            ("a", "CANCELLED", 2, "first"),
            ("a", "CANCELLED", 3, "second"),
            ("a", "PENDING", 4, None),
            ("b", "PENDING", 1, None),
            ("b", "CONFIRMED", 2, None),
        ],
        "order_id string, status string, seq int, reason string",
    )
    assert values(saga.latest_status(changes), "*") == [
        ("a", "CANCELLED", "first"),
        ("b", "CONFIRMED", None),
    ]


def test_payment_without_amount_gets_no_stock(spark):
    paid = spark.createDataFrame(
        [("p", "o", "c", None, "SUCCESS", None, "t")],
        "payment_id string, order_id string, customer_id string, amount decimal(18,2),"
        " status string, processed_at timestamp, transaction_id string",
    )
    assert values(saga.reserve(paid), "quantity", "status") == [(0, "UNAVAILABLE")]


def test_derived_transaction_when_orders_have_none(orders):
    out = saga.run_saga(orders.drop("transaction_id"))
    assert out.select("transaction_id").distinct().count() == len(AMOUNTS)


def test_an_order_keeps_its_status(make_orders):
    orders = make_orders([("a", "c1", 1, "10.00"), ("b", "c1", 1, "10.00"), ("c", "c1", 1, "9999.00")])
    stored = orders.withColumn("status", F.when(F.col("order_id") != "b", "SHIPPED"))
    tables = saga.order_table(saga.run_saga(stored))
    assert values(tables, "order_id", "status") == [("a", "SHIPPED"), ("b", "PENDING"), ("c", "CANCELLED")]


def test_trace_follows_the_log(spark):
    def log(rows):
        df = spark.createDataFrame(rows, "t string, seq int, kind string")
        return df.select("seq", F.struct(F.col("t").alias("transaction_id"), F.col("kind").alias("event_type")).alias("metadata"))

    events = ["OrderPlaced", "InventoryReserved", "PaymentProcessed", "PaymentProcessed", "OrderShipped"]
    rows = [("a", i + 1, e) for i, e in enumerate(events)]
    rows += [("b", 2, "OrderPlaced"), ("b", 1, "x"), ("b", 3, None), ("b", None, "OrderCancelled")]
    assert values(saga.saga_trace(log(rows[::-1])), "*") == [
        ("a", 5, "OrderPlaced>InventoryReserved>PaymentProcessed*2>other"),
        ("b", 4, "other*2>OrderPlaced>OrderCancelled"),
    ]
