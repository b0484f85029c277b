"""Reading keyed JSON records from Kafka or from files with the same columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed, schemas
from tidemark.functions import headers as hdr
from tidemark.operators.skew import semi_join

CORRUPT = "_corrupt"
METADATA_COLUMNS = ("key", "topic", "partition", "offset", "timestamp", "headers")


def kafka_options(
    servers: str,
    topic: str = fixed.TOPIC_ORDERS,
    *,
    partitions: list[int] | None = None,
    starting: str = "earliest",
    max_per_trigger: int | None = None,
    committed_only: bool = False,
) -> dict[str, str]:
    """Options of Spark's Kafka source.

    ``starting`` only applies where the checkpoint knows no offset yet. ``partitions``
    reads those partitions alone, ``committed_only`` hides records of open or aborted
    transactions.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "startingOffsets": starting,
        "includeHeaders": "true",
    }
    if partitions is None:
        options["subscribe"] = topic
    else:
        options["assign"] = json.dumps({topic: sorted(partitions)})
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if committed_only:
        options["kafka.isolation.level"] = "read_committed"
    return options


def read_kafka(spark: SparkSession, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """Records of a topic; key and value become text."""
    reader = spark.readStream if streaming else spark.read
    return (
        reader.format("kafka")
        .options(**options)
        .load()
        .withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})
        .select([f.name for f in schemas.RECORD])
    )


def read_files(
    spark: SparkSession,
    path: str,
    *,
    streaming: bool = False,
    partitions: list[int] | None = None,
    max_files_per_trigger: int | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """Records written by :func:`tidemark.sinks.writers.write_records`.

    A folder laid out by ``partition`` is pruned to the wanted partitions before any
    file is opened; other folders get the same rows through a pushed filter.
    """
    reader = (spark.readStream if streaming else spark.read).format(file_format)
    reader = reader.schema(schemas.RECORD)
    if streaming and max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    records = reader.load(path)
    return records if partitions is None else from_partitions(records, partitions)


def from_partitions(records: DataFrame, partitions: list[int]) -> DataFrame:
    return records.filter(F.col("partition").isin(list(partitions)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Every row of a stored table."""
    return spark.read.parquet(path)


def parsed_once(df: DataFrame, event: Column) -> DataFrame:
    """Add the fields of a parsed struct, parsing every row once.

    The row goes through a generator of exactly one element. A filter on a plain
    projection would be pushed below it and parse the JSON a second time.
    """
    return df.select("*", F.inline_outer(F.array(event)))


def _parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    shape = schemas.wire(schema).add(CORRUPT, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # an empty value is not reported as corrupt, the JSON null is
    text = F.when(F.trim("value") != "", F.col("value")).otherwise("null")
    return parsed_once(records, F.from_json(text, shape, options))


def _named(schema: T.StructType) -> list[Column]:
    return [F.col(schemas.camel(f.name)).alias(f.name) for f in schema]


def _kept(records: DataFrame) -> list[str]:
    return [name for name in METADATA_COLUMNS if name in records.columns]


def decode(records: DataFrame, schema: T.StructType, on_error: str = "reject") -> DataFrame:
    """Event columns of the records that parse, with the record metadata beside them.

    The type is fixed by ``schema``; headers naming another type are ignored, and a field
    the JSON lacks is null. ``on_error="reject"`` leaves bad records out (they are in
    :func:`decode_rejects`); ``"fail"`` ends the query at the first of the same records.
    """
    good = F.col(CORRUPT).isNull()
    if on_error == "fail":
        stop = F.raise_error("a record is not a valid event").cast("boolean")
        parsed = _parsed(records, schema).filter(F.when(good, F.lit(True)).otherwise(stop))
    elif on_error == "reject":
        parsed = _parsed(records, schema).filter(good)
    else:
        raise ValueError("on_error is 'reject' or 'fail'")
    return parsed.select(*_named(schema), *_kept(records))


def decode_rejects(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The records :func:`decode` leaves out, as they came, with the reason."""
    empty = F.coalesce(F.trim("value") == "", F.lit(True))
    reason = F.when(empty, "empty value").otherwise("not a valid event")
    bad = _parsed(records, schema).filter(F.col(CORRUPT).isNotNull())
    return bad.select(*_kept(records), "value", reason.alias("reject_reason"))


def read_orders(
    spark: SparkSession, source: str | dict[str, str], *, streaming: bool = True, **files
) -> DataFrame:
    """Placed orders with their record position, bad records left out.

    ``source`` is a folder of record files (``files`` goes to :func:`read_files`) or the
    :func:`kafka_options` of a topic.
    """
    if isinstance(source, dict):
        found = read_kafka(spark, source, streaming)
    else:
        found = read_files(spark, source, streaming=streaming, **files)
    return decode(found, schemas.ORDER_PLACED)


def with_record_metadata(df: DataFrame) -> DataFrame:
    """Name the position of a record as the audit tables do."""
    return df.withColumnsRenamed({"partition": "kafka_partition", "offset": "msg_offset"})


def header(df: DataFrame, name: str, column: str | None = None) -> DataFrame:
    """One header as a text column; null where the record does not carry it."""
    return df.withColumn(column or name.replace("-", "_"), hdr.value_of(name))


def headers_map(df: DataFrame) -> DataFrame:
    return df.withColumn("headers_map", hdr.as_map())


def header_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row per header of a record."""
    return df.select(*keep, F.explode(hdr.as_map()).alias("header", "value"))


def committed_stream(
    events: DataFrame,
    commits: DataFrame,
    key: str = "transaction_id",
    event_time: str | None = None,
    commit_time: str | None = None,
    within: str | None = None,
) -> DataFrame:
    """The events of a stream whose transaction was committed, by a stream of commits (in
    append mode).

    An event waits in the state until the commit of its transaction arrives, on either side
    of it, and passes once; what is never committed never passes. Commits may repeat. The
    state (keep it on disk) holds events and transactions; with ``within``, events and commits
    further apart than that by ``event_time`` and ``commit_time`` do not meet, and both are let
    go of after it.
    """
    known = commits.filter(F.col(key).isNotNull())
    if within is None:
        done = known.select(F.col(key).alias("_committed")).dropDuplicates(["_committed"])
        met = F.col(key) == F.col("_committed")
        return events.join(done, met, "inner").select(*events.columns)
    done = known.select(F.col(key).alias("_committed"), F.col(commit_time).alias("_at")).withWatermark("_at", within)
    done = done.dropDuplicatesWithinWatermark(["_committed"])
    near = F.expr(
        f"`{key}` = _committed AND _at BETWEEN `{event_time}` - INTERVAL {within} AND `{event_time}` + INTERVAL {within}"
    )
    return events.withWatermark(event_time, within).join(done, near, "inner").select(*events.columns)


def committed_only(
    events: DataFrame, commits: DataFrame, key: str = "transaction_id", unique: bool = False
) -> DataFrame:
    """Events whose transaction was committed; ``unique`` if each transaction has one event."""
    return semi_join(events, commits, key, unique)
