"""Exact duplicates by looking digests up in a minimal perfect hash of those seen before.

The history is a table with one row per bucket of digests. A bucket holds a perfect hash of
its distinct digests (levels of bits; a digest sits in the first level where it alone hits
its bit, and its slot is the rank of that bit), and per slot the full digest, the locator of
the row that stays, and the number of rows. A lookup goes to one slot and compares all 32
bytes, so a digest that is not in the history is never taken for one that is. Digests
without a slot form groups of their own and are the next history's new slots.

Scale: only digests and ids leave a task, never texts. Rows are folded to one per distinct
digest before the shuffle (with a map-side step, so a text that is a third of all rows is one
row per task). Buckets are cut by the hash of the digest, and their number follows the
number of digests, so every bucket is about ``BUCKET_KEYS`` slots whatever the input.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import clean_text, keep, with_rows

BUCKET_KEYS = 50_000
#: Bits per digest that is left at a level.
GAMMA = 2.0

GROUP = "digest binary, best struct<doc_id: bigint, _row: struct<file: bigint, row: bigint>>, size bigint"
HISTORY = (
    "bucket bigint, levels array<bigint>, bits binary, digests binary, ids array<bigint>, "
    "files array<bigint>, rows array<bigint>, sizes array<bigint>"
)


def normal_digest(text_col: str) -> Column:
    """SHA-256 (binary) of the text with A-Z, and no other letters, in lower case."""
    lower = F.translate(clean_text(text_col), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(lower, 256))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, doc_id, digest``: a narrow step in the JVM."""
    rows = with_rows(
        df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    )
    return rows.select("_row", "doc_id", normal_digest("text").alias("digest"))


def groups(found: DataFrame) -> DataFrame:
    """One row per distinct digest: the row that stays (largest id, then last place), the size."""
    return found.groupBy("digest").agg(
        F.max(F.struct("doc_id", "_row")).alias("best"), F.count("*").alias("size")
    )


def _words(digest: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digest).view("<u8").reshape(-1, 4)


def _bit(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest at a level: digests are uniform, so two of their words do."""
    a, b = words[:, level % 4], words[:, (level + 1) % 4]
    with np.errstate(over="ignore"):
        return ((a + b * np.uint64(2 * level + 1)) >> np.uint64(7)) % np.uint64(size)


def perfect_hash(digest: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """``(level sizes, bits, slot of each digest)`` for distinct digests (n x 32 bytes)."""
    words, left = _words(digest), np.arange(len(digest))
    sizes, bits, place = [], [], np.zeros(len(digest), dtype=np.int64)
    while len(left):
        size = int(len(left) * GAMMA) + 1
        bit = _bit(words[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(bit, minlength=size) == 1
        hit = alone[bit]
        place[left[hit]] = sum(sizes) + bit[hit]
        sizes.append(size)
        bits.append(alone)
        left = left[~hit]
    whole = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
    rank = np.cumsum(whole) - 1
    return sizes, whole, rank[place] if len(digest) else place


def slots(digest: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The one slot in which each digest may be, -1 if it has none; the caller compares bytes."""
    words, left = _words(digest), np.arange(len(digest))
    rank, start = np.cumsum(bits) - 1, 0
    out = np.full(len(digest), -1, dtype=np.int64)
    for level, size in enumerate(sizes):
        place = start + _bit(words[left], level, size).astype(np.int64)
        hit = bits[place]
        out[left[hit]] = rank[place[hit]]
        left, start = left[~hit], start + size
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, 32)


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n))


def bucket_count(keys: int) -> int:
    return max(1, -(-keys // BUCKET_KEYS))


def build(found: DataFrame, n_buckets: int) -> DataFrame:
    """The history of digest groups (:func:`groups`), one row per bucket."""

    def work(key, table):
        digest = _matrix(table["digest"])
        sizes, bits, slot = perfect_hash(digest)
        order = np.empty(len(slot), dtype=np.int64)
        order[slot] = np.arange(len(slot))
        best = table["best"].combine_chunks().take(pa.array(order))
        row = best.field("_row")
        lists = [best.field("doc_id"), row.field("file"), row.field("row")]
        lists.append(table["size"].combine_chunks().take(pa.array(order)))
        columns = [
            pa.array([key[0].as_py()], pa.int64()),
            pa.array([sizes], pa.list_(pa.int64())),
            pa.array([np.packbits(bits).tobytes()], pa.binary()),
            pa.array([digest[order].tobytes()], pa.binary()),
            *(pa.array([x.to_pylist()], pa.list_(pa.int64())) for x in lists),
        ]
        names = ["bucket", "levels", "bits", "digests", "ids", "files", "rows", "sizes"]
        return pa.Table.from_arrays(columns, names=names)

    return found.withColumn("bucket", _bucket(n_buckets)).groupBy("bucket").applyInArrow(work, HISTORY)


def look_up(found: DataFrame, history: DataFrame, n_buckets: int) -> DataFrame:
    """The groups of the history and of ``found`` together, one row per distinct digest.

    ``n_buckets`` is that of the history: choose it for the digests of both
    (:func:`bucket_count`), and build the history anew when it has outgrown its buckets.
    """

    def work(key, new, old):
        if not old.num_rows:
            return new.select(["digest", "best", "size"])
        row = old.to_pylist()[0]
        sizes = row["levels"]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool)
        known = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        digest = _matrix(new["digest"])
        slot = slots(digest, sizes, bits)
        member = slot >= 0
        member[member] = (known[slot[member]] == digest[member]).all(axis=1)
        winners = list(zip(row["ids"], row["files"], row["rows"]))
        counts = list(row["sizes"])

        def rank(w):
            return (w[0] is not None, w[0] or 0, w[1], w[2])

        at = np.flatnonzero(member)
        for s, group in zip(slot[at].tolist(), new.take(pa.array(at)).to_pylist()):
            best = group["best"]
            mine = (best["doc_id"], best["_row"]["file"], best["_row"]["row"])
            winners[s] = max(winners[s], mine, key=rank)
            counts[s] += group["size"]
        fresh = new.take(pa.array(np.flatnonzero(~member))).select(["digest", "best", "size"])
        ids, files, rows = ([w[i] for w in winners] for i in range(3))
        row_array = pa.StructArray.from_arrays(
            [pa.array(files, pa.int64()), pa.array(rows, pa.int64())], names=["file", "row"]
        )
        merged = pa.Table.from_arrays(
            [
                pa.array([x.tobytes() for x in known], pa.binary()),
                pa.StructArray.from_arrays(
                    [pa.array(ids, pa.int64()), row_array], names=["doc_id", "_row"]
                ),
                pa.array(counts, pa.int64()),
            ],
            names=["digest", "best", "size"],
        )
        return pa.concat_tables([merged, fresh.cast(merged.schema)])

    new = found.withColumn("bucket", _bucket(n_buckets)).groupBy("bucket")
    return new.cogroup(history.groupBy("bucket")).applyInArrow(work, GROUP)


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    in_history: Column | None = None,
) -> DataFrame:
    """``_row, doc_id, digest, keep_id, group_size, kept`` for every row of ``df``.

    ``in_history`` (a condition on ``doc_id``) tells the rows that came first; the others are
    looked up in the history built from them. Without it, the rows are dealt into two batches
    by the hash of the id. The result is the same for every such split. To carry a history from
    run to run, store what :func:`build` returns and call :func:`look_up`.

    Texts are equal when they are the same after lower-casing A-Z; a null text is empty. Of
    equal texts the row with the largest id stays (``kept``); of rows that repeat it, the
    last by place; a row without an id stays only if no row of its group has one, and
    ``keep_id`` is null then. An empty table gives an empty result. Other columns of ``df`` are not touched.
    """
    found = keep(digests(df, id_col, text_col), "digests")
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if in_history is None else in_history
    first = F.coalesce(first, F.lit(False))
    before = keep(groups(found.filter(first)), "history_groups")
    after = keep(groups(found.filter(~first)), "batch_groups")
    n_buckets = bucket_count(before.count() + after.count())
    verdicts = look_up(after, keep(build(before, n_buckets), "history"), n_buckets)
    return found.join(verdicts, "digest", "left").select(
        "_row",
        "doc_id",
        "digest",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("_row") == F.col("best._row")).alias("kept"),
    )
