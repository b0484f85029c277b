"""Idempotent consumption: the first record of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD_ORDER = ("partition", "offset")
#: Tasks over which a stream deals the replays of a key.
SALTS = 32


def without_key(df: DataFrame, key: str) -> DataFrame:
    """Records without a key. They are neither first nor known; every function here leaves
    them out, so that they can be counted and looked at."""
    return df.filter(F.col(key).isNull())


def first_per_key(
    df: DataFrame, key: str, order_by: tuple[str, ...] = RECORD_ORDER
) -> DataFrame:
    """Keep the earliest record of every key, in (partition, offset) order; records without
    a position come last, records without a key are in :func:`without_key`.

    Spark cuts every key to one row per map task before the shuffle (window group
    limit), so replays of one key do not pile up in one task.
    """
    order = [F.col(c).asc_nulls_last() for c in order_by]
    first = Window.partitionBy(key).orderBy(*order)
    return df.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def new_only(
    batch: DataFrame,
    history: DataFrame,
    key: str,
    order_by: tuple[str, ...] = RECORD_ORDER,
) -> DataFrame:
    """First record per key of a batch, without the keys the history already holds.

    Both sides are down to one row per key before they are joined, and the anti-join
    reuses their partitioning by ``key``.
    """
    known = history.select(key).distinct()
    return first_per_key(batch, key, order_by).join(known, key, "left_anti")


def dedup_stream(
    stream: DataFrame,
    key: str,
    time_col: str | None = None,
    within: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """One record per key of a stream in append mode, the first that arrives (any of those
    that arrive in one batch). Keys are never forgotten; the state (keep it on disk) grows
    with their number.

    The replays of a key are dealt over ``salts`` tasks by the task they come from. Each of
    those passes on the first record it sees, once and for all, so the task that knows the
    key itself sees ``salts`` of its records at most; a key is remembered twice for that.

    With ``within`` a key is forgotten that long after its event time, and a later replay
    passes again; all records of a key go to one task then, as event times of different tasks
    must not decide which is forgotten. :func:`once_of_stream` decides by position.
    """
    keyed = stream.filter(F.col(key).isNotNull())
    if within is not None:
        return keyed.withWatermark(time_col, within).dropDuplicatesWithinWatermark([key])
    if salts > 1:
        dealt = keyed.withColumn("_salt", F.spark_partition_id() % salts)
        keyed = dealt.dropDuplicates([key, "_salt"]).drop("_salt")
    return keyed.dropDuplicates([key])


def _earliest(stream: DataFrame, key: str, order_by: tuple[str, ...]) -> Column:
    """All columns but the key of the record that comes first. Columns of any type may be
    carried, only those of the position are compared."""
    # a struct compares field by field and a null is the smallest, so places without a value go last
    order = [f for c in order_by for f in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    return F.min_by(F.struct(*[c for c in stream.columns if c != key]), F.struct(*order))


def _unpacked(folded: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return folded.select(*[F.col(c) if c == key else F.col(f"_first.{c}") for c in columns])


def once_of_stream(
    stream: DataFrame, key: str, order_by: tuple[str, ...] = RECORD_ORDER
) -> DataFrame:
    """The first record of every key, passed on once (in update mode): with the batch in which
    the key shows up first, and of that batch the first by position.

    A batch has one time, which the checkpoint keeps for a second try. A key is new if all of
    its records so far have the time of this batch. Both are aggregates, as is the earliest
    record, so the replays of a key are one row per task before the shuffle, and a key with
    half of all records loads no task. The state (keep it on disk) is one record per key.
    """
    now = F.current_timestamp()
    folded = (
        stream.filter(F.col(key).isNotNull())
        .withColumn("_batch_time", now)
        .groupBy(key)
        .agg(
            _earliest(stream, key, order_by).alias("_first"),
            F.min("_batch_time").alias("_since"),
            F.max("_batch_time").alias("_until"),
        )
    )
    new = folded.filter((F.col("_since") == F.col("_until")) & (F.col("_until") == now))
    return _unpacked(new, key, stream.columns)


def first_of_stream(
    stream: DataFrame, key: str, order_by: tuple[str, ...] = RECORD_ORDER
) -> DataFrame:
    """:func:`first_per_key` kept up to date over a stream: the earliest record by position,
    in whatever order the records arrive.

    The earliest record is an aggregate, so all records of a key in a batch are one row
    before the shuffle, and the state is one record per key.
    """
    keyed = stream.filter(F.col(key).isNotNull())
    folded = keyed.groupBy(key).agg(_earliest(stream, key, order_by).alias("_first"))
    return _unpacked(folded, key, stream.columns)
