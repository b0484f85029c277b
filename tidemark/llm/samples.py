"""Bounded samples of labelled rows, to fit models on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 1 << 30
#: More distinct labels than these are an error, not a sample.
MOST_LABELS = 1000


def fold(id_column: Column, n: int) -> Column:
    """``crc32(id as text) mod n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


def by_label(
    rows: DataFrame, id_col: str, label: str, limit: int, ties: tuple[Column, ...] = ()
) -> tuple[DataFrame, dict]:
    """About ``limit`` rows, as many of each label as there are or an equal share, and the
    number of rows of each label.

    Rows are chosen by the hash of their id, so the sample is the same in every run. Rows that
    repeat an id are one: the one with the smallest ``ties`` and label. Only the counts of the
    labels reach the driver here.
    """
    counts = rows.groupBy(label).count().limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"{label} has more than {MOST_LABELS} values")
    sizes = {r[label]: r["count"] for r in counts}
    if not sizes:
        return rows.limit(0), sizes
    share = -(-limit // len(sizes))
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(STEPS))
    chosen = [
        (F.col(label) == value) & (chance < int(min(1.0, share / n) * STEPS)) for value, n in sizes.items()
    ]
    smallest = F.min_by(F.struct(*rows.columns), F.struct(*ties, F.col(label))).alias("_row")
    sampled = rows.filter(reduce(lambda a, b: a | b, chosen)).groupBy(F.col(id_col).alias("_id")).agg(smallest)
    return sampled.select("_row.*"), sizes
