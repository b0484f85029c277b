from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import PLACED, values

from tidemark.operators import consistency, payments

BOTH = "Order and payment both exist - consistent state"
PAYMENT = "INCONSISTENCY: Payment exists but order does not (non-transactional issue!)"
ORDER = "INCONSISTENCY: Order exists but payment does not"
NEITHER = "Neither order nor payment found"


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([("both",), ("both",), ("order",), (None,)], "order_id string")


@pytest.fixture
def paid(spark):
    rows = [("p1", "both"), ("p2", "both"), ("p3", "payment"), ("p4", None)]
    return spark.createDataFrame(
        [(p, o, "c1") for p, o in rows], "payment_id string, order_id string, customer_id string"
    )


def test_four_cases(spark, orders, paid):
    ids = spark.createDataFrame(
        [("both",), ("payment",), ("order",), ("none",), ("none",)], "order_id string"
    )
    assert values(consistency.consistency(orders, paid, ids), "*") == [
        ("both", True, True, True, BOTH),
        ("none", False, False, False, NEITHER),
        ("order", False, True, False, ORDER),
        ("payment", False, False, True, PAYMENT),
    ]


def test_only_asked_ids_are_answered(spark, orders, paid):
    ids = spark.createDataFrame([("order",)], "order_id string")
    assert values(consistency.consistency(orders, paid, ids), "order_id") == [("order",)]
    assert values(consistency.consistency(orders, paid), "order_id") == [
        ("both",),
        ("order",),
        ("payment",),
    ]


def test_order_flag_keeps_every_payment(orders, paid):
    assert values(consistency.with_order_flag(paid, orders), "payment_id", "has_order") == [
        ("p1", True),
        ("p2", True),
        ("p3", False),
        ("p4", False),
    ]


def test_inconsistencies(orders, paid):
    found = consistency.inconsistencies(paid, orders)
    assert values(found, "*") == [
        ("PAYMENT_WITHOUT_ORDER", "p3", "payment", "c1", PAYMENT),
        ("PAYMENT_WITHOUT_ORDER", "p4", None, "c1", PAYMENT),
    ]
    assert values(consistency.inconsistency_summary(paid, orders), "*") == [
        (2, "Found 2 inconsistency(ies)")
    ]
    report = consistency.inconsistency_report(paid, orders)
    assert values(report, "total", "type", "payment_id") == [
        (2, "PAYMENT_WITHOUT_ORDER", "p3"),
        (2, "PAYMENT_WITHOUT_ORDER", "p4"),
    ]
    none = consistency.inconsistency_report(paid.filter("payment_id = 'p1'"), orders).collect()
    assert [(r["total"], r["type"]) for r in none] == [(0, None)]
    none = none[0]
    assert none["message"] == "No inconsistencies found - all payments have corresponding orders"


@pytest.fixture
def requests(spark):
    rows = [("neg", "-1.00"), ("zero", "0.00"), ("edge", "1000.00"), ("over", "1000.01"), ("none", None)]
    data = [(o, "c1", None if a is None else Decimal(a), PLACED) for o, a in rows]
    return payments.with_ids(
        spark.createDataFrame(
            data, "order_id string, customer_id string, amount decimal(18,2), order_date timestamp"
        )
    )


@pytest.mark.parametrize(
    ("atomic", "sent"), [(True, ["edge", "zero"]), (False, ["edge", "over", "zero"])]
)
def test_publish(requests, atomic, sent):
    published = payments.publish(requests, atomic=atomic)
    assert [r[0] for r in values(payments.payment_events(published), "order_id")] == sent
    assert values(payments.order_events(published), "order_id", "product_id", "quantity") == [
        ("edge", "product-123", 1),
        ("zero", "product-123", 1),
    ]
    assert values(published, "order_id", "reason") == [
        ("edge", None),
        ("neg", "Invalid amount - must be positive"),
        ("none", "Invalid amount - must be positive"),
        ("over", "Amount too large - order event failed"),
        ("zero", None),
    ]


def test_check_amount(requests):
    accepted, refused = payments.check_amount(requests)
    assert values(accepted, "order_id") == [("edge",), ("over",), ("zero",)]
    assert values(refused, "order_id") == [("neg",), ("none",)]
