"""Scalar helpers. Every one of them is a built-in Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed

# Written without a zone, in microseconds, as the existing consumers parse it.
JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def money_text(amount: Column) -> Column:
    """``1234567.8`` -> ``₹1.234.567.80``; a missing amount reads ``₹0.00``."""
    digits = F.translate(F.format_number(amount, 2), ",", ".")
    return F.coalesce(F.concat(F.lit(fixed.CURRENCY), digits), F.lit("₹0.00"))


def derived_id(kind: str, *keys: Column) -> Column:
    """A repeatable id: the same input row gets the same id when a task is retried."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *keys), 256)


def whole_seconds_ms(time: Column) -> Column:
    """Epoch milliseconds of ``time`` cut to whole seconds."""
    return F.unix_timestamp(time) * 1000


def whole_units(amount: Column) -> Column:
    """``amount`` cut to a 32-bit integer; larger values wrap instead of failing."""
    units = amount.cast("bigint")
    half, full = F.lit(2**31), F.lit(2**32)
    return (F.pmod(units + half, full) - half).cast("int")


def utf8(text: Column) -> Column:
    return F.encode(text.cast("string"), "UTF-8")


def or_default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def notification_text(channel: str, order_id: Column, amount: Column) -> Column:
    if channel == "EMAIL":
        return F.format_string(fixed.EMAIL_TEXT, order_id, amount.cast("string"))
    if channel == "SMS":
        return F.format_string(fixed.SMS_TEXT, order_id, amount.cast("string"))
    if channel == "PUSH":
        return F.format_string(fixed.PUSH_TEXT, order_id)
    raise ValueError(f"unknown channel {channel!r}")
