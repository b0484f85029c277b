"""Streams that remember more than an aggregate does: records that wait for their time, and the
time of each source partition.

The functions that work on state are Python, called once per key and batch with all rows of
the key; the columns they do not look at travel as one JSON text each.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import fixed
from tidemark.functions.columns import JSON_TIME
from tidemark.operators import delivery, lateness

PACKED = "_packed"
#: Records without a place in a partition are dealt over so many groups.
LOOSE_GROUPS = 64
#: Before every time that can be stored.
NEVER = -(2**62)
#: Groups in which records wait for a time of the stream.
WAIT_GROUPS = 32


def _pack(df: DataFrame) -> Column:
    """All columns as one text that :func:`_unpack` reads."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON_TIME).alias(PACKED)


def _unpack(df: DataFrame, schema: T.StructType, *extra: Column) -> DataFrame:
    row = F.from_json(PACKED, schema, JSON_TIME)
    return df.select(row.alias("_row"), *extra).select("_row.*", *[f"`{n}`" for n in _names(df, extra)])


def _names(df: DataFrame, columns: tuple[Column, ...]) -> list[str]:
    return df.select(*columns).columns if columns else []


# --- records that wait ------------------------------------------------------------------


def _held_for_a_while(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Holds a record until the clock of the machine has passed its time."""
    if state.hasTimedOut:
        (packed,) = state.get
        state.remove()
        yield pd.DataFrame({PACKED: [packed]})
        return
    row = pd.concat(list(parts)).iloc[0]
    if not state.exists:  # a replay of what waits changes nothing
        state.update((row[PACKED],))
        state.setTimeoutDuration(max(1, int(row["_due"])))


WAITING = "now bigint, due array<bigint>, keys array<string>, records array<string>"


def _held_until_seen(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Holds the records of a group until a time has been seen that is not before theirs."""
    now, *lists = state.get if state.exists else (NEVER, [], [], [])
    waiting = {k: (due, packed) for due, k, packed in zip(*lists)}
    for rows in parts:
        now = max(now, int(rows["_now"].max()))
        new = rows[rows["_key"].notna()]
        for k, due, packed in zip(new["_key"], new["_due"], new[PACKED]):
            waiting.setdefault(k, (int(due), packed))
    passed = [k for k, (due, _) in waiting.items() if due <= now]
    out = pd.DataFrame({PACKED: [waiting.pop(k)[1] for k in passed]})
    state.update((now, [d for d, _ in waiting.values()], list(waiting), [r for _, r in waiting.values()]))
    yield out


def _newest_time(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        if len(rows):
            yield pd.DataFrame({"_now": [rows["_now"].max()]})


def wait_until_due(
    failures: DataFrame,
    time_col: str | None = None,
    clock: DataFrame | None = None,
    delay_col: str = "next_delay_ms",
    attempt_col: str = "next_attempt",
    key: tuple[str, ...] = ("partition", "offset"),
    groups: int = WAIT_GROUPS,
) -> DataFrame:
    """The failed records of a stream, each held back for its delay and then passed on with
    ``attempt`` set to the next one (in append mode): what goes to the retry topic.

    ``failures`` is what :func:`tidemark.operators.delivery.route_failures` gives; ``key`` and
    the attempt tell records apart, and records that have no next attempt are left out. A
    record that waits already is not held twice.

    With ``time_col`` the wait is on the clock of the stream: a record is due ``delay_col``
    milliseconds after its time and passes with the batch in which a time not before that is
    seen, in ``failures`` or in the column of that name of ``clock``, a stream of any columns
    that goes on while nothing fails. Records wait in ``groups`` groups by the hash of their
    key, each of which holds what fails within a delay; the clock reaches every group as one
    row per batch of rows read. A record without a time passes at once.

    Without ``time_col`` the wait is by the clock of the machines, a record per state. Either
    way what waits is state, so a restart loses nothing.
    """
    schema = failures.schema
    name = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    own = F.concat_ws("|", *name, F.col(attempt_col).cast("string")).alias("_key")
    held = failures.filter(F.col(attempt_col).isNotNull())
    if time_col is None:
        waiting = held.select(own, F.col(delay_col).alias("_due"), _pack(failures))
        due = waiting.groupBy("_key").applyInPandasWithState(
            _held_for_a_while,
            f"{PACKED} string",
            f"{PACKED} string",
            "append",
            GroupStateTimeout.ProcessingTimeTimeout,
        )
    else:
        now = F.coalesce(F.unix_millis(F.col(time_col).cast("timestamp")), F.lit(NEVER)).alias("_now")
        waiting = held.select(own, now, F.col(delay_col).alias("_due"), _pack(failures)).withColumns(
            {
                "_due": F.col("_now") + F.col("_due"),
                "_group": F.pmod(F.xxhash64("_key"), F.lit(groups)).cast("int"),
            }
        )
        ticks = failures.select(now) if clock is None else failures.select(now).unionByName(clock.select(now))
        ticks = ticks.mapInPandas(_newest_time, "_now bigint").select(
            F.lit(None).cast("string").alias("_key"),
            "_now",
            F.lit(None).cast("bigint").alias("_due"),
            F.lit(None).cast("string").alias(PACKED),
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"),
        )
        due = (
            waiting.unionByName(ticks)
            .groupBy("_group")
            .applyInPandasWithState(
                _held_until_seen, f"{PACKED} string", WAITING, "append", GroupStateTimeout.NoTimeout
            )
        )
    back = _unpack(due, schema)
    return back.withColumn("attempt", F.col(attempt_col).cast(schema["attempt"].dataType)).drop(
        *delivery.ROUTE_COLUMNS
    )


# --- the time of a partition ------------------------------------------------------------


def _newest_so_far(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds to each record the newest time of its partition up to it, over all batches.

    Only the places and times of the records are held, as numbers; the records themselves wait
    in a file of the task until all places are known.
    """
    if not key[0]:  # never in line: its own time
        for rows in parts:
            yield pd.DataFrame({PACKED: rows[PACKED].to_numpy(), "_newest": rows["_time"].to_numpy(dtype=np.int64)})
        return
    with tempfile.TemporaryFile() as waiting:
        shape = pa.schema([(PACKED, pa.string())])
        numbers: list[np.ndarray] = []
        with pa.ipc.new_stream(waiting, shape, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
            for rows in parts:
                order = [c for c in rows.columns if c.startswith("_at")]
                numbers.append(rows[["_time", *order]].to_numpy(dtype=np.int64).T)
                sink.write_batch(pa.RecordBatch.from_arrays([pa.array(rows[PACKED], pa.string())], schema=shape))
        times, *places = np.concatenate(numbers, axis=1)
        numbers.clear()
        line = np.lexsort(places[::-1])  # of equal places, the one that came first
        before = state.get[0] if state.exists else NEVER
        newest = np.empty_like(times)
        newest[line] = np.maximum(np.maximum.accumulate(times[line]), before)
        state.update((int(newest[line[-1]]),))
        del times, places, line
        waiting.seek(0)
        start = 0
        for batch in pa.ipc.open_stream(waiting):
            stop = start + batch.num_rows
            yield pd.DataFrame({PACKED: batch.column(0).to_pandas(), "_newest": newest[start:stop]})
            start = stop


def with_stream_time(
    stream: DataFrame,
    time_col: str = "order_date",
    partition: str = "partition",
    position: str = "offset",
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """:func:`tidemark.operators.lateness.with_stream_time` on a stream: ``stream_time`` is the
    highest ``time_col`` of the partition so far, over all batches.

    The state is one time per partition. The records of a partition are taken in order within
    a batch, so a batch has to hold whole stretches of it, as those of a log do; the
    partition is the unit of work, as it is for the source. A task holds three or more numbers
    per record of a batch in memory and the records in a temporary file of its own.
    Records without a partition or place are dealt over groups of their own and keep their
    own time.
    """
    in_line = F.col(partition).isNotNull() & F.col(position).isNotNull()
    loose = F.pmod(F.xxhash64(PACKED), F.lit(LOOSE_GROUPS)).cast("string")
    places = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(f"_at{i}") for i, c in enumerate((position, *ties))]
    rows = stream.select(
        in_line.alias("_in_line"),
        F.col(partition).cast("string").alias("_partition"),
        F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(NEVER)).alias("_time"),
        *places,
        _pack(stream),
    ).withColumn("_group", F.when(F.col("_in_line"), F.col("_partition")).otherwise(loose))
    timed = rows.groupBy("_in_line", "_group").applyInPandasWithState(
        _newest_so_far, f"{PACKED} string, _newest bigint", "newest bigint", "append", GroupStateTimeout.NoTimeout
    )
    newest = F.when(F.col("_newest") > NEVER, F.timestamp_micros("_newest")).cast(stream.schema[time_col].dataType)
    return _unpack(timed, stream.schema, newest.alias("stream_time"))


def judge_lateness(
    stream: DataFrame,
    size: str = fixed.WINDOW_SIZE,
    grace: str = fixed.GRACE,
    time_col: str = "order_date",
    **position,
) -> DataFrame:
    """:func:`tidemark.operators.lateness.judge_lateness` on a stream, record by record: adds
    ``stream_time`` and ``is_late`` (in append mode). A second query over the output counts the
    records that are not late."""
    timed = with_stream_time(stream, time_col, **position)
    return timed.withColumn("is_late", lateness.is_late(F.col(time_col), F.col("stream_time"), size, grace))
