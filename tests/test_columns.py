from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as c


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("amount", "text"),
    [("99.99", "₹99.99"), ("1234567.80", "₹1.234.567.80"), ("0.50", "₹0.50"), (None, "₹0.00")],
)
def test_money_text(spark, amount, text):
    assert one(spark, c.money_text(F.lit(amount).cast("decimal(18,2)"))) == text


@pytest.mark.parametrize(
    ("amount", "whole"),
    [("99.99", 99), ("-1.50", -1), ("2147483648.00", -(2**31)), ("4294967301.20", 5)],
)
def test_whole_units_cut_and_wrap(spark, amount, whole):
    assert one(spark, c.whole_units(F.lit(Decimal(amount)))) == whole


def test_whole_seconds(spark):
    at = F.lit(datetime(2026, 1, 3, 10, 0, 5, 999999))
    assert one(spark, c.whole_seconds_ms(at)) == 1767434405000


def test_derived_ids_differ_by_kind(spark):
    a, b = one(spark, c.derived_id("a", F.lit("1"))), one(spark, c.derived_id("b", F.lit("1")))
    assert a != b and len(a) == 64


def test_texts(spark):
    order, amount = F.lit("o1"), F.lit(Decimal("20.90"))
    assert one(spark, c.notification_text("EMAIL", order, amount)) == (
        "Your order o1 for $20.90 has been placed successfully!"
    )
    assert one(spark, c.notification_text("SMS", order, amount)) == "Order o1 confirmed. Amount: $20.90"
    assert one(spark, c.notification_text("PUSH", order, amount)) == "New order o1 placed!"
    with pytest.raises(ValueError):
        c.notification_text("FAX", order, amount)


def test_defaults_and_bytes(spark):
    assert one(spark, c.or_default(F.lit(None).cast("string"), "N/A")) == "N/A"
    assert bytes(one(spark, c.utf8(F.lit("₹")))) == "₹".encode()
