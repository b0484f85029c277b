"""Column lists of the events, records and tables.

Tables use snake_case columns; the JSON on a topic uses the camelCase of the same names.
Money is ``decimal(18,2)`` and times are ``timestamp`` under a UTC session.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
# Sums and query results carry money at full width.
WIDE_MONEY = T.DecimalType(38, 2)


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "money": MONEY,
}


def _schema(text: str) -> T.StructType:
    """``name type, name type`` as a schema, without needing a session at import."""
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


ORDER_PLACED = _schema(
    "order_id string, customer_id string, product_id string, quantity int,"
    " total_amount money, order_date timestamp, transaction_id string"
)
ENRICHED_ORDER = _schema(
    "order_id string, customer_id string, product_id string, quantity int,"
    " total_amount money, order_date timestamp, order_category string,"
    " processed_at timestamp, processing_status string"
)
PAYMENT_PROCESSED = _schema(
    "payment_id string, order_id string, customer_id string, amount money,"
    " status string, processed_at timestamp, transaction_id string"
)
PAYMENT_REFUNDED = _schema(
    "payment_id string, order_id string, amount money, refunded_at timestamp"
)
INVENTORY_RESERVED = _schema(
    "reservation_id string, order_id string, product_id string, quantity int,"
    " status string, reserved_at timestamp"
)
ORDER_CANCELLED = _schema("order_id string, reason string, cancelled_at timestamp")
METADATA = _schema(
    "event_type string, event_version string, source string, transaction_id string,"
    " timestamp timestamp"
)
HEADERS = T.ArrayType(_schema("key string, value binary"))
RECORD = T.StructType(
    _schema(
        "key string, value string, topic string, partition int, offset bigint,"
        " timestamp timestamp"
    ).fields
    + [T.StructField("headers", HEADERS)]
)

# The payload that belongs to each envelope type. Envelope payloads carry no transaction
# id of their own: it travels in the metadata.
PAYLOADS = {
    "OrderPlaced": T.StructType(ORDER_PLACED.fields[:-1]),
    "PaymentProcessed": T.StructType(PAYMENT_PROCESSED.fields[:-1]),
    "InventoryReserved": INVENTORY_RESERVED,
    "PaymentRefunded": PAYMENT_REFUNDED,
    "OrderCancelled": ORDER_CANCELLED,
}


def camel(name: str) -> str:
    """``total_amount`` -> ``totalAmount``."""
    head, *rest = name.split("_")
    return head + "".join(word.capitalize() for word in rest)


def wire(schema: T.StructType) -> T.StructType:
    """The same columns under their JSON names."""
    return T.StructType([T.StructField(camel(f.name), f.dataType) for f in schema])
