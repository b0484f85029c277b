"""Message headers: ``array<struct<key string, value binary>>``, as Kafka carries them.

A key may occur more than once; the last one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed, schemas
from tidemark.functions.columns import utf8


def build(values: dict[str, Column]) -> Column:
    """A headers column from name -> text expression."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("key"), utf8(value).alias("value"))
            for name, value in values.items()
        ]
    ).cast(schemas.HEADERS)


def with_headers(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Append headers to those a record already has."""
    added = build(values)
    if "headers" not in df.columns:
        return df.withColumn("headers", added)
    return df.withColumn("headers", append(F.col("headers"), added))


def append(headers: Column, added: Column) -> Column:
    return F.concat(F.coalesce(headers, F.array().cast(schemas.HEADERS)), added)


def order_headers(order_id: Column, sent_ms: Column) -> dict[str, Column]:
    """The headers of an order sent as a plain record."""
    return {
        fixed.HEADER_CORRELATION: order_id,
        fixed.HEADER_SOURCE: F.lit(fixed.ORDER_SERVICE),
        fixed.HEADER_TIMESTAMP: sent_ms,
        fixed.HEADER_VERSION: F.lit(fixed.EVENT_VERSION),
    }


def message_headers(order_id: Column) -> dict[str, Column]:
    """The headers of an order sent as a typed message."""
    return {
        fixed.HEADER_CORRELATION: order_id,
        fixed.HEADER_SOURCE: F.lit(fixed.ORDER_SERVICE),
        fixed.HEADER_MESSAGE_TYPE: F.lit(fixed.ORDER_MESSAGE_TYPE),
    }


def stamp(df: DataFrame, time_ms: Column) -> DataFrame:
    """The before-send hook: note when the record passed it."""
    return with_headers(df, {fixed.HEADER_INTERCEPTED: time_ms})


def value_of(name: str, headers: Column | None = None) -> Column:
    """Text of one header, null where the record does not have it."""
    headers = F.col("headers") if headers is None else headers
    hits = F.filter(headers, lambda h: h["key"] == name)
    return F.try_element_at(hits, F.lit(-1))["value"].cast("string")


def as_map(headers: Column | None = None) -> Column:
    """All headers of a record as ``map<string, string>``."""
    headers = F.col("headers") if headers is None else headers
    last = F.filter(
        headers,
        lambda h, i: ~F.exists(
            F.slice(headers, i + 2, F.size(headers)), lambda later: later["key"] == h["key"]
        ),
    )
    return F.map_from_entries(
        F.transform(last, lambda h: F.struct(h["key"], h["value"].cast("string")))
    )
