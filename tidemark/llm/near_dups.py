"""Near-duplicate documents by SimHash: one-wildcard segment variants, equality join, check.

Two fingerprints that differ in at most ``k`` bits, cut into ``k // 2 + 1`` segments, have a
segment in which they differ in at most one bit. So every fingerprint is filed once per bit
under the segment of that bit with this bit left out: such two meet in a bucket, and what
meets is compared in full.

Cost: 64 short rows per *distinct* fingerprint are shuffled once. Copies share a fingerprint
and are one row before anything is shuffled. Buckets are compared in numpy from sorted
partitions. A bucket larger than ``TILE`` (many distinct fingerprints that agree in a whole
segment) is cut into tiles, and each pair of tiles is a bucket of its own, so no task holds
more than two tiles of one. A large bucket yields a spanning forest of its links, not all its
pairs, which is all that components need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import ROW, clean_text, keep, slices, with_rows

BITS = 64
TILE = 16384
#: Buckets up to this size are compared by shifts over all buckets of a batch at once.
SHIFTED = 24


def simhash(text: str, words: int) -> int:
    """The fingerprint of a text: majority bits of the hashes of its word shingles.

    Words are split at ASCII white space, A-Z are lower-cased; fewer words than a shingle
    has are one shingle, and a text without words has fingerprint 0.
    """
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(found) - words + 1].tolist()
        of = xxhash.xxh64_intdigest
        hashes = [of(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]
    counts = np.zeros(BITS, dtype=np.int64)
    array = np.array(hashes, dtype=np.uint64)
    for start in range(0, len(array), 1 << 16):
        part = array[start : start + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(array))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4
) -> DataFrame:
    """``_row, doc_id, fp`` (as a signed bigint) for every row; a narrow step."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            found = np.fromiter((simhash(t, words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
                names=["_row", "doc_id", "fp"],
            )

    rows = with_rows(df.select(F.col(id_col).cast("bigint").alias("doc_id"), clean_text(text_col).alias("text")))
    return rows.select("_row", "doc_id", "text").mapInArrow(
        work, f"_row {ROW}, doc_id bigint, fp bigint"
    )


def segments(max_bits: int) -> list[tuple[int, int]]:
    """``(first bit, width)`` of the segments, as even as they come."""
    n = max_bits // 2 + 1
    edges = [round(i * BITS / n) for i in range(n + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def _signed(value: int) -> int:
    value &= (1 << BITS) - 1
    return value - (1 << BITS) if value >> (BITS - 1) else value


def buckets(fps: DataFrame, max_bits: int, tile: int = TILE) -> DataFrame:
    """``p, v, i, j, fp``: the buckets of distinct fingerprints, large ones as pairs of tiles."""
    whole = [((1 << width) - 1) << first for first, width in segments(max_bits)]
    of_bit = [mask for mask, (_, width) in zip(whole, segments(max_bits)) for _ in range(width)]
    masks = F.array(*(F.lit(_signed(mask & ~(1 << p))) for p, mask in enumerate(of_bit)))
    flips = F.array(*(F.lit(_signed(~(1 << p))) for p in range(BITS)))
    filed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("p")).select(
        "p", F.col("fp").bitwiseAND(F.element_at(masks, F.col("p") + 1)).alias("v"), "fp"
    )
    # A bucket unites two segment values at most, so one above ``tile`` has one above half.
    values = fps.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v"))
                    for s, m in enumerate(whole)
                )
            )
        ).alias("x")
    ).select("x.s", "x.v")
    crowded = values.groupBy("s", "v").count().filter(F.col("count") > tile // 2)
    positions = F.array(
        *(F.sequence(F.lit(first), F.lit(first + width - 1)) for first, width in segments(max_bits))
    )
    large = (
        crowded.select("v", "count", F.explode(F.element_at(positions, F.col("s") + 1)).alias("p"))
        .select("p", F.col("v").bitwiseAND(F.element_at(flips, F.col("p") + 1)).alias("v"), "count")
        .groupBy("p", "v")
        .agg(F.ceil((F.sum("count") + tile // 2) / (tile // 2)).cast("int").alias("tiles"))
    )
    cut = filed.join(large, ["p", "v"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    return (
        cut.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("p", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )


def _forest(fps: np.ndarray, linked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join each node to its component: every node is compared with those not yet
    reached, so a dense group costs little more than its size."""
    rest = fps
    while len(rest):
        wave, rest = [rest[0]], rest[1:]
        while wave and len(rest):
            node = wave.pop()
            hit = linked(node, rest)
            if hit.any():
                near, rest = rest[hit], rest[~hit]
                yield np.full(len(near), node, dtype=np.uint64), near
                wave.extend(near)


def link(fps: DataFrame, max_bits: int = 4, tile: int = TILE) -> DataFrame:
    """``a, b``: links between distinct fingerprints with at most ``max_bits`` differing bits.

    All links of small buckets and a spanning forest of large ones: the components are those
    of all links. A pair is taken in one bucket only, the first in which it meets.
    """
    layout = segments(max_bits)

    def first_place(x: np.ndarray) -> np.ndarray:
        """The bit under which a pair with difference x meets first."""
        place = np.full(len(x), -1, dtype=np.int64)
        for first, width in reversed(layout):
            part = (x >> np.uint64(first)) & np.uint64((1 << width) - 1)
            one = np.bitwise_count(part) <= 1
            bit = np.where(part == 0, 0, np.bitwise_count(part - np.uint64(1) * (part > 0)))
            place[one] = first + bit[one]
        return place

    def near(p, x: np.ndarray) -> np.ndarray:
        hit = np.bitwise_count(x) <= max_bits
        if hit.any():
            at = np.flatnonzero(hit)
            hit[at] = first_place(x[at]) == (p if np.isscalar(p) else p[at])
        return hit

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b):
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        def compare(keys: np.ndarray, fps: np.ndarray):
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.append(starts, len(keys)))
            size = np.repeat(sizes, sizes)
            group = np.repeat(np.arange(len(starts)), sizes)
            for shift in range(1, SHIFTED):
                at = np.flatnonzero((size[:-shift] > shift) & (size[:-shift] <= SHIFTED))
                at = at[group[at] == group[at + shift]]
                if not len(at):
                    break
                hit = at[near(keys[at, 0], fps[at] ^ fps[at + shift])]
                if len(hit):
                    yield out(fps[hit], fps[hit + shift])
            for g in np.flatnonzero(sizes > SHIFTED):
                own = np.unique(fps[starts[g] : starts[g] + sizes[g]])
                p = int(keys[starts[g], 0])
                for a, b in _forest(own, lambda node, rest, p=p: near(p, rest ^ node)):
                    yield out(a, b)

        held_keys, held = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            keys = np.concatenate([held_keys, np.stack(columns[:4], axis=1).astype(np.int64)])
            fps = np.concatenate([held, columns[4].astype(np.int64).view(np.uint64)])
            if not len(keys):
                continue
            last = len(keys) - int((keys[::-1] != keys[-1]).any(axis=1).argmax())
            if (keys == keys[-1]).all():
                last = 0
            yield from compare(keys[:last], fps[:last]) if last else ()
            held_keys, held = keys[last:], fps[last:]
        if len(held):
            yield from compare(held_keys, held)

    keys = ["p", "v", "i", "j"]
    filed = buckets(fps, max_bits, tile)
    return filed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "a bigint, b bigint")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    max_bits: int = 4,
    tile: int = TILE,
) -> DataFrame:
    """``_row, doc_id, fingerprint, component_id, kept`` for every row of ``df``.

    ``component_id`` is the smallest id reachable over fingerprints that differ in at most
    ``max_bits`` bits; ``kept`` marks one row of each component, that with the smallest id
    (of rows that repeat it, the first by place).

    Null and blank texts have fingerprint 0 and are linked like any other. Rows without an
    id belong to a component but never name it; a component of such rows only has a null id,
    and its first row is kept. Texts of any length are hashed whole. An empty table gives an
    empty result. Other columns of ``df``
    are not touched, whatever their names.
    """
    if not 0 <= max_bits <= 62:
        raise ValueError("max_bits must be between 0 and 62")
    fps = keep(fingerprints(df, id_col, text_col, words), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    own = keep(fps.groupBy("fp").agg(F.min(order).alias("best")), "distinct_fingerprints")
    linked = components(keep(link(own.select("fp"), max_bits, tile), "near"))
    linked = linked.select(F.col("node").alias("fp"), "component")
    best = linked.join(own, "fp").groupBy("component").agg(F.min("best").alias("top"))
    tops = linked.join(best, "component").select("fp", "top")
    classes = own.join(tops, "fp", "left").select("fp", F.coalesce("top", "best").alias("top"))
    return fps.join(classes, "fp", "left").select(
        "_row",
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("top.doc_id").alias("component_id"),
        (F.col("_row") == F.col("top._row")).alias("kept"),
    )
