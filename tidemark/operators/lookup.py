"""Lookups. For given values they are filters that reach the file scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import semi_join


def by_key(df: DataFrame, column: str, value, unique: bool = False) -> DataFrame:
    """Rows with one value, or with any of a list, or with any in a key table. ``unique`` says
    that ``df`` has one row per key."""
    if isinstance(value, DataFrame):
        return semi_join(df, value, column, unique)
    if isinstance(value, (list, tuple, set)):
        return df.filter(F.col(column).isin(list(value)))
    # lit() leaves a Column as it is
    return df.filter(F.col(column) == F.lit(value))


def by_order(df: DataFrame, ids, unique: bool = False) -> DataFrame:
    return by_key(df, "order_id", ids, unique)


def one_by_order(df: DataFrame, ids) -> DataFrame:
    """At most one row per asked order; an order that has more of them ends the query, as a
    lookup that promises one row has no right answer then."""
    found = by_order(df, ids)
    rows = found.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in found.columns if c != "order_id"]
    )
    stop = F.raise_error("more than one row for an order").cast("boolean")
    return rows.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(stop)).select(*found.columns)


def by_customer(df: DataFrame, customer_id) -> DataFrame:
    return by_key(df, "customer_id", customer_id)


def by_status(df: DataFrame, status) -> DataFrame:
    return by_key(df, "status", status)


def by_method(df: DataFrame, method) -> DataFrame:
    return by_key(df, "consumer_method", method)


def state_get(keys: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """One answer per asked key; a key the table does not hold answers 0."""
    zero = F.lit(0).cast(table.schema[value].dataType)
    return (
        keys.select(key)
        .distinct()
        .join(table.select(key, value), key, "left")
        .select(key, F.coalesce(F.col(value), zero).alias(value))
    )
