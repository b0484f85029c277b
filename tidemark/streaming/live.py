"""Queries on the state of a streaming query while it runs, by key.

State is kept in partitions, and the hash of a key names its partition. So a query for some
keys reads the partitions of these keys and no other. Every read is of one commit: the last
one by default, so the stream may go on meanwhile, or an earlier one that is still kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import lookup

#: More partitions than these are not read one by one.
MOST_PARTITIONS = 64
DEFAULT_STORE = "default"


def committed(spark: SparkSession, checkpoint: str, operator: int = 0) -> Row:
    """``numPartitions, minBatchId, maxBatchId`` of the state of an operator: what can be read."""
    meta = spark.read.format("state-metadata").load(checkpoint)
    own = meta.filter((F.col("operatorId") == operator) & (F.col("stateStoreName") == DEFAULT_STORE))
    found = own.select("numPartitions", "minBatchId", "maxBatchId").first()
    if found is None:
        raise ValueError(f"{checkpoint} has no state of operator {operator}")
    return found


def _reader(spark: SparkSession, operator: int, **options):
    reader = spark.read.format("statestore").option("operatorId", str(operator))
    return reader.options(**{k: str(v) for k, v in options.items()})


def _snapshot(spark: SparkSession, checkpoint: str, operator: int, partition: int, batch: int) -> int | None:
    """The newest batch up to ``batch`` for which the whole state of a partition is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state/{operator}/{partition}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = (f.getPath().getName() for f in files)
    numbers = (n.partition(".")[0] for n in names if n.endswith((".zip", ".snapshot")))
    # version n is the state after batch n - 1
    return max((int(n) - 1 for n in numbers if n.isdigit() and int(n) - 1 <= batch), default=None)


def partition_of(key: list[Column], partitions: int) -> Column:
    """The state partition of a key, given as the columns of the state key in their order."""
    return F.pmod(F.hash(*key), F.lit(partitions))


def _named(state: DataFrame, names: list[str]) -> list[Column]:
    stored = state.schema["value"].dataType.names
    if len(names) > len(stored):
        raise ValueError(f"the state has {len(stored)} values, not {len(names)}")
    return [F.col("value")[old].alias(new) for old, new in zip(stored, names)]


def as_of(
    spark: SparkSession, checkpoint: str, names: list[str], batch: int | None = None, operator: int = 0
) -> DataFrame:
    """The whole state after ``batch`` (the last commit by default): keys and values. ``names``
    are given to the first values, in their order. A later commit changes nothing in it."""
    batch = committed(spark, checkpoint, operator).maxBatchId if batch is None else batch
    state = _reader(spark, operator, batchId=batch).load(checkpoint)
    return state.select("key.*", *_named(state, names))


def changes(
    spark: SparkSession, checkpoint: str, names: list[str], first: int, last: int, operator: int = 0
) -> DataFrame:
    """``batch_id, change_type``, keys and values of every key that batches ``first`` to
    ``last`` changed. The query must have run with
    :func:`tidemark.streaming.jobs.state_on_disk` and ``changes=True``."""
    feed = _reader(
        spark, operator, readChangeFeed="true", changeStartBatchId=first, changeEndBatchId=last
    ).load(checkpoint)
    return feed.select("batch_id", "change_type", "key.*", *_named(feed, names))


def of_keys(
    spark: SparkSession,
    checkpoint: str,
    asked: DataFrame,
    names: list[str],
    batch: int | None = None,
    operator: int = 0,
) -> DataFrame:
    """The rows of the asked keys, from their partitions alone.

    ``asked`` has the columns of the state key and as many rows as a caller asks for at
    once; its distinct partitions, whose number is bounded by that of the state, come to the
    driver. Above ``MOST_PARTITIONS`` of them, or where the state of a batch is not stored as a
    whole yet, the whole state is read. Keys that the state does not hold are not in the
    result.
    """
    meta = committed(spark, checkpoint, operator)
    batch = meta.maxBatchId if batch is None else batch
    whole = _reader(spark, operator, batchId=batch).load(checkpoint)
    fields = whole.schema["key"].dataType.names
    keys = asked.select(*[F.col(f).cast(whole.schema["key"].dataType[f].dataType).alias(f) for f in fields])
    number = partition_of([F.col(f) for f in fields], meta.numPartitions)
    wanted = sorted(r.p for r in keys.select(number.alias("p")).distinct().collect())
    state = whole if wanted else whole.limit(0)
    if 0 < len(wanted) <= MOST_PARTITIONS:
        starts = {p: _snapshot(spark, checkpoint, operator, p, batch) for p in wanted}
        if None not in starts.values():
            state = reduce(
                DataFrame.unionByName,
                (
                    _reader(spark, operator, batchId=batch, snapshotStartBatchId=start, snapshotPartitionId=p).load(checkpoint)
                    for p, start in starts.items()
                ),
            )
    rows = state.select("key.*", *_named(state, names))
    return rows.join(keys.distinct(), fields, "left_semi")


def value_of_keys(
    spark: SparkSession, checkpoint: str, asked: DataFrame, key: str, value: str, **at
) -> DataFrame:
    """One answer per asked key, from the state of a run; a key it does not hold answers 0."""
    found = of_keys(spark, checkpoint, asked, [value], **at)
    return lookup.state_get(asked, found, key, value)


def windows_of(
    spark: SparkSession,
    checkpoint: str,
    customer: str,
    start_ms: int,
    end_ms: int,
    size: str = fixed.WINDOW_SIZE,
    **at,
) -> DataFrame:
    """The windowed counts of one customer that start within ``[start, end]``, both ends
    included, from the state of a run of
    :func:`tidemark.operators.analytics.windowed_counts`. The keys are the windows of the
    range, so a narrow range reads few partitions."""
    start, end = (F.timestamp_millis(F.lit(ms)) for ms in (start_ms, end_ms))
    times = F.explode(F.sequence(start, end + F.expr(f"INTERVAL {size}"), F.expr(f"INTERVAL {size}")))
    asked = (
        spark.range(1)
        .select(times.alias("t"))
        .select(F.window("t", size).alias("window"), F.lit(customer).alias("customer_id"))
        .filter(F.col("window.start").between(start, end))
    )
    found = of_keys(spark, checkpoint, asked, ["order_count"], **at)
    return found.select(
        "customer_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "order_count",
    )
