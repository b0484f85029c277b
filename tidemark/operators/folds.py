"""Aggregates that users write: an initial state, how rows go into it, how two states become one.

The functions get pandas frames with many keys at once, so they can be written for all keys
together (``groupby``) rather than key by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fold = Callable[[pd.DataFrame], pd.DataFrame]


def fold_by(
    df: DataFrame,
    keys: list[str],
    add: Fold,
    merge: Fold,
    state: str,
    finish: Fold | None = None,
    result: str | None = None,
) -> DataFrame:
    """One row per key: the keys and what ``finish`` makes of the state (the state itself by
    default).

    - ``add`` turns rows into states: keys and the columns of ``state``, a row or more per key;
    - ``merge`` turns states into fewer, one row per key, in any order: it has to give the same
      however the states are grouped;
    - ``finish`` turns each state into the columns of ``result``.

    Rows are added up batch by batch in the task that reads them, so a key with a third of all
    rows sends one state per batch and no more. Behind the shuffle states are merged as they
    come, in the order of keys, and a task holds a batch of them. Rows with a null key belong to no
    group. An empty table gives no rows.
    """
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    partial = f"{names}, {state}"

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if len(rows):
                yield merge(add(rows))

    def last(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows = None
        for rows in parts:
            if not len(rows):
                continue
            end = rows.iloc[-1][keys]
            merged = merge(rows if open_rows is None else pd.concat([open_rows, rows]))
            # rows come in the order of keys, so only the last key can go on
            goes_on = (merged[keys] == end).all(axis=1)
            open_rows, done = merged[goes_on], merged[~goes_on]
            if len(done):
                yield done if finish is None else finish(done)
        if open_rows is not None:
            yield open_rows if finish is None else finish(open_rows)

    keyed = df
    for key in keys:
        keyed = keyed.filter(F.col(key).isNotNull())
    states = keyed.mapInPandas(first, partial)
    ordered = states.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInPandas(last, partial if finish is None else f"{names}, {result}")
