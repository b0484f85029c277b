"""Late events, judged record by record against the newest time seen in the partition.

A streaming query drops late rows by one watermark for the whole query, moved between
batches. These functions apply the finer rule to stored records: the time of a partition
is the highest event time up to and including the record, and a record is late once its
window has been closed for ``grace``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.analytics import windowed_counts
from tidemark.operators.blocks import block_starts, inside_block

BLOCK_ROWS = 250_000


def with_stream_time(
    df: DataFrame,
    time_col: str = "order_date",
    partition: str = "partition",
    position: str = "offset",
    ties: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``stream_time``: the highest ``time_col`` of the partition so far.

    ``position`` is the whole-number place of a record in its partition, ``ties`` decide
    between records at one place. A task sorts one block of about ``block_rows`` records,
    however large the partition is.

    A record without a partition or place was never in line: its own time is its stream
    time, so it moves no other record and is itself never late.
    """
    in_line = F.col(partition).isNotNull() & F.col(position).isNotNull()
    apart = df.filter(~in_line).withColumn("stream_time", F.col(time_col))
    rows = df.filter(in_line).withColumn("_block", F.expr(f"`{position}` div {int(block_rows)}"))
    newest = rows.groupBy(partition, "_block").agg(F.max(time_col).alias("_newest"))
    starts = block_starts(newest, [partition], "_block", F.max("_newest"), "_before")
    running = F.max(time_col).over(inside_block([partition], "_block", [position, *ties]))
    # A task's share of the starts is one row per block it holds, so hashing them is safe,
    # and the rows are shuffled and sorted once, for the window.
    return (
        rows.join(starts.drop("_newest").hint("shuffle_hash"), [partition, "_block"])
        # greatest() skips the null of a first block
        .withColumn("stream_time", F.greatest(running, F.col("_before")))
        .select(*df.columns, "stream_time")
        .unionByName(apart)
    )


def is_late(time: Column, stream_time: Column, size: str = fixed.WINDOW_SIZE, grace: str = fixed.GRACE) -> Column:
    """Whether the window of ``time`` has been closed for ``grace`` at ``stream_time``."""
    closes = F.window(time, size)["end"] + F.expr(f"INTERVAL {grace}")
    return F.coalesce(closes <= stream_time, F.lit(False))


def judge_lateness(
    df: DataFrame,
    size: str = fixed.WINDOW_SIZE,
    grace: str = fixed.GRACE,
    time_col: str = "order_date",
    **position,
) -> DataFrame:
    """Add ``stream_time`` and ``is_late``."""
    timed = with_stream_time(df, time_col, **position)
    return timed.withColumn("is_late", is_late(F.col(time_col), F.col("stream_time"), size, grace))


def late_events(df: DataFrame, *args, **kwargs) -> DataFrame:
    """The events a windowed count leaves out."""
    return judge_lateness(df, *args, **kwargs).filter("is_late").drop("is_late")


def windowed_counts_with_grace(
    df: DataFrame,
    size: str = fixed.WINDOW_SIZE,
    grace: str = fixed.GRACE,
    time_col: str = "order_date",
    **position,
) -> DataFrame:
    """Windowed counts of the events that are not late."""
    judged = judge_lateness(df, size, grace, time_col, **position)
    return windowed_counts(judged.filter(~F.col("is_late")), size, time_col)
