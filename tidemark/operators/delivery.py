"""Notification rows and texts, retries and dead letters."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import headers as hdr
from tidemark.functions.columns import notification_text, or_default
from tidemark.sinks.writers import row_id

CHANNELS = ("EMAIL", "SMS", "PUSH")
#: What :func:`route_failures` adds.
ROUTE_COLUMNS = ("topic", "next_attempt", "next_delay_ms")


def _by_method(method: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])[method]


def header_message(headers: Column | None = None) -> Column:
    """Audit message of the header-reading consumer; ``N/A`` without a correlation id."""
    correlation = or_default(hdr.value_of(fixed.HEADER_CORRELATION, headers), fixed.NOT_AVAILABLE)
    return F.format_string(fixed.CONSUMER_METHODS[fixed.WITH_HEADERS][1], correlation)


def notification_rows(
    df: DataFrame,
    method: str | Column = fixed.IDEMPOTENT_ORDER_CONSUMER,
    status: str | Column = fixed.SENT,
    notification_type: str = fixed.EMAIL,
    topic: str | Column = fixed.TOPIC_ORDERS,
) -> DataFrame:
    """Audit rows of consumed orders: who consumed the record, from where, with what
    result. ``method`` names the consumer method and decides group and message. The ``id``
    comes from the position of the record itself, also where the row leaves it empty; without a
    position there is none, and :func:`tidemark.sinks.writers.split_by_id` sets the row apart."""
    method = F.lit(method) if isinstance(method, str) else method
    status = F.lit(status) if isinstance(status, str) else status
    groups = {m: group for m, (group, _) in fixed.CONSUMER_METHODS.items()}
    messages = {m: text for m, (_, text) in fixed.CONSUMER_METHODS.items()}
    message = _by_method(method, messages)
    if "headers" in df.columns:
        message = F.when(method == fixed.WITH_HEADERS, header_message()).otherwise(message)
    no_partition = method.isin(*fixed.METHODS_WITHOUT_PARTITION)
    no_offset = method.isin(*fixed.METHODS_WITHOUT_OFFSET)
    return df.select(
        row_id(topic, method).alias("id"),
        "order_id",
        "customer_id",
        F.lit(notification_type).alias("notification_type"),
        status.alias("status"),
        message.alias("message"),
        F.when(~no_partition, F.col("partition")).alias("kafka_partition"),
        F.when(~no_offset, F.col("offset")).alias("msg_offset"),
        _by_method(method, groups).alias("consumer_group"),
        method.alias("consumer_method"),
    )


def payment_rows(
    df: DataFrame, group: str = fixed.PAYMENT_CONSUMER_GROUP, now: Column | None = None
) -> DataFrame:
    """Payment table rows with the consumer's record position."""
    created = F.current_timestamp() if now is None else now
    return df.select(
        row_id(fixed.TOPIC_PAYMENTS, fixed.PAYMENT_CONSUMER).alias("id"),
        "payment_id",
        "order_id",
        "customer_id",
        "amount",
        "status",
        "processed_at",
        "transaction_id",
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.lit(group).alias("consumer_group"),
        created.alias("created_at"),
    )


def notification_texts(df: DataFrame) -> DataFrame:
    """The text for every channel, one row each."""
    texts = F.array(
        *[
            F.struct(
                F.lit(channel).alias("channel"),
                notification_text(channel, F.col("order_id"), F.col("total_amount")).alias("text"),
            )
            for channel in CHANNELS
        ]
    )
    return df.select("order_id", F.inline(texts))


def _delay_before(attempt: Column, delay_ms: int, multiplier: float) -> Column:
    """Wait before an attempt: none before the first, then growing by ``multiplier``."""
    grown = F.lit(float(delay_ms)) * F.pow(F.lit(float(multiplier)), attempt - 2)
    return F.when(attempt <= 1, F.lit(0)).otherwise(grown).cast("bigint")


def retry_schedule(
    attempts_made: DataFrame,
    attempts: int = fixed.RETRY_ATTEMPTS,
    delay_ms: int = fixed.RETRY_DELAY_MS,
    multiplier: float = fixed.RETRY_MULTIPLIER,
) -> DataFrame:
    """Recorded attempts (``attempt`` counts from 1) with the wait before each, and whether
    it was the ``last_attempt``. An attempt that the schedule does not have gets no wait."""
    known = F.col("attempt").between(1, attempts)
    return attempts_made.withColumns(
        {
            "delay_ms": F.when(known, _delay_before(F.col("attempt"), delay_ms, multiplier)),
            "last_attempt": F.coalesce(F.col("attempt") >= attempts, F.lit(False)),
        }
    )


def _again(attempts: int, include: tuple[str, ...] | None, failure: str) -> Column:
    """Whether a failed record is tried again: below the last attempt, and of a named class
    where classes are named. A failure without a class, or without an attempt number, is not."""
    again = F.coalesce(F.col("attempt") < attempts, F.lit(False))
    if include is None:
        return again
    return again & F.coalesce(F.col(failure).isin(*include), F.lit(False))


def route_failures(
    df: DataFrame,
    is_failure: Column,
    topic: str = fixed.TOPIC_ORDERS,
    attempts: int = fixed.RETRY_ATTEMPTS,
    delay_ms: int = fixed.RETRY_DELAY_MS,
    multiplier: float = fixed.RETRY_MULTIPLIER,
    include: tuple[str, ...] | None = None,
    failure: str = "failure_class",
) -> DataFrame:
    """Where the failed records of one pass go next; ``attempt`` counts the tries so far.

    The retry topics are numbered from 0, the dead letters have one topic. With ``include``
    only failures of these classes are tried again; all others are dead letters at once.
    """
    again = _again(attempts, include, failure)
    retry = F.format_string(f"{topic}-retry-%s", (F.greatest("attempt", F.lit(1)) - 1).cast("string"))
    following = F.greatest("attempt", F.lit(1)) + 1
    return df.filter(is_failure).withColumns(
        {
            "topic": F.when(again, retry).otherwise(f"{topic}-dlt"),
            "next_attempt": F.when(again, following),
            "next_delay_ms": F.when(again, _delay_before(following, delay_ms, multiplier)),
        }
    )


def dead_letters(
    df: DataFrame,
    is_failure: Column,
    attempts: int = fixed.RETRY_ATTEMPTS,
    include: tuple[str, ...] | None = None,
    failure: str = "failure_class",
) -> DataFrame:
    """The failed records of recorded attempts that are not tried again."""
    return df.filter(is_failure & ~_again(attempts, include, failure))
