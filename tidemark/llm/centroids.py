"""Exact integer clustering by a shallot search.

Every vector remembers its centroid, the second nearest one, at most how far the first is and
at least how far all others are. When the centroids have moved, the bounds move with them; a
vector whose first is still surely nearest is left alone. For the others the search begins at
the closer of the two remembered centroids and runs over its neighbours, nearest first. A
centroid that beats the second must lie in the ball around the start whose radius is the
distance of the start and that of the second together; each better second shrinks the ball,
and a neighbour outside ends the search. What is inside is compared in integers, so ties and
sums are exact; the bounds, in doubles, have a margin and only ever spare comparisons.

A round reads the table of vectors with their bounds and writes it again in the shared folder,
in tasks that need nothing but the centroids. The same tasks write the sums of their clusters,
which Spark adds up; only sums and centroids, ``k`` rows of them, reach the driver. The table
before is deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import keep, remove

SCALE = 256
WIDTH = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: Components have to stay below this size for squared distances to fit into 64 bits.
LARGEST = 1 << 27
MARGIN = 1e-12
#: Vectors that are compared at a time.
TOGETHER = 4096

STATE = "vec_id bigint, v array<int>, a int, b int, upper double, lower double, n bigint, sums array<bigint>"
FINAL = "vec_id bigint, cluster int, distance bigint"


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def _at_most(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float)) * (1 + MARGIN)


def _at_least(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float)) * (1 - MARGIN)


class Centroids:
    """The centroids of a round, how far they moved, and each one's neighbours by distance."""

    def __init__(self, values: list[list[int]], before: list[list[int]] | None = None):
        self.values = np.array(values, dtype=np.int64)
        k = len(values)
        gaps = np.stack([_squared(self.values, self.values[i]) for i in range(k)])
        np.fill_diagonal(gaps, -1)  # itself comes first and is left out
        order = np.argsort(gaps, axis=1, kind="stable")
        self.near = order[:, 1:]
        self.reach = _at_least(np.take_along_axis(gaps, self.near, axis=1))
        self.half = self.reach[:, 0] / 2 if k > 1 else np.full(1, np.inf)
        old = self.values if before is None else np.array(before, dtype=np.int64)
        self.moved = _at_most(_squared(self.values, old))
        # the largest move among the others
        largest = np.argmax(self.moved)
        rest = np.delete(self.moved, largest)
        self.others = np.full(k, self.moved[largest])
        self.others[largest] = rest.max() if len(rest) else 0.0

    def assign(self, v: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings a batch up to date, in place; the number of vectors that were searched."""
        upper += self.moved[a]
        lower -= self.others[a]
        todo = np.flatnonzero(~(upper < np.maximum(lower, self.half[a])))
        upper[todo] = _at_most(_squared(v[todo], self.values[a[todo]]))
        todo = todo[~(upper[todo] < np.maximum(lower[todo], self.half[a[todo]]))]
        if len(todo) and len(self.values) > 1:
            self._search(v, todo, a, b, upper, lower)
        return len(todo)

    def _search(self, v, todo, a, b, upper, lower) -> None:
        one, two = a[todo], b[todo]
        d1, d2 = _squared(v[todo], self.values[one]), _squared(v[todo], self.values[two])
        swap = (d2 < d1) | ((d2 == d1) & (two < one))
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, radius = one.copy(), _at_most(d1)
        live = np.arange(len(todo))
        for step in range(self.near.shape[1]):
            inside = self.reach[start[live], step] <= radius[live] + _at_most(d2[live])
            live = live[inside]
            if not len(live):
                break
            c = self.near[start[live], step]
            new = c != two[live]
            at, c = live[new], c[new]
            d = _squared(v[todo[at]], self.values[c])
            first = (d < d1[at]) | ((d == d1[at]) & (c < one[at]))
            second = ~first & (d < d2[at])
            i, j = at[first], at[second]
            two[i], d2[i] = one[i], d1[i]
            one[i], d1[i] = c[first], d[first]
            two[j], d2[j] = c[second], d[second]
        a[todo], b[todo] = one, two
        upper[todo], lower[todo] = _at_most(d1), _at_least(d2)


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, width).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(start, TOGETHER)


def _updated(centroids: Centroids, batch: pa.RecordBatch, width: int) -> tuple:
    # copies: Arrow's own memory is read-only
    state = [np.array(batch.column(c)) for c in ("a", "b", "upper", "lower")]
    v = _vectors(batch, width)
    centroids.assign(v, *state)
    return v, state


def _round(centroids: Centroids, width: int) -> Callable:
    """One round of a task: its vectors with new bounds, then the sums of its clusters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.values)
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        names = ["vec_id", "v", "a", "b", "upper", "lower", "n", "sums"]
        wide = pa.list_(pa.int64())
        for batch in _batches(batches):
            v, (a, b, upper, lower) = _updated(centroids, batch, width)
            counts += np.bincount(a, minlength=k)
            np.add.at(sums, a, v)
            bounds = [pa.array(x) for x in (a, b, upper, lower)]
            n = len(a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), *bounds, pa.nulls(n, pa.int64()), pa.nulls(n, wide)],
                names=names,
            )
        own = np.flatnonzero(counts)
        n = len(own)
        empty = [pa.nulls(n, t) for t in (pa.int64(), pa.list_(pa.int32()))]
        rest = [pa.nulls(n, t) for t in (pa.int32(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [*empty, pa.array(own, pa.int32()), *rest, pa.array(counts[own]), pa.array(sums[own].tolist(), wide)],
            names=names,
        )

    return work


def _last(centroids: Centroids, width: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            v, (a, *_) = _updated(centroids, batch, width)
            distance = _squared(v, centroids.values[a])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(a, pa.int32()), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return work


def _moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The means of the clusters, rounded down; a cluster without vectors stays."""
    parts = table.filter("sums IS NOT NULL").select("a", "n", F.posexplode("sums").alias("i", "s"))
    out = [list(c) for c in centroids]
    for r in parts.groupBy("a", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out[r.a][r.i] = r.s // r.n
    return out


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, width: int, scale: int) -> DataFrame:
    """``vec_id, v``: the vectors with ``width`` finite components, as integers rounded down
    from ``scale`` times each."""
    vector = F.col(vec_col).cast("array<double>")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("e", lambda x: F.floor(x * scale))
    stop = F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")
    fits = F.forall("w", lambda x: (x < LARGEST) & (x > -LARGEST))
    return (
        df.select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("e"))
        .filter((F.size("e") == width) & finite)
        .select("vec_id", whole.alias("w"))
        .select("vec_id", F.when(fits, F.col("w").cast("array<int>")).otherwise(stop).alias("v"))
    )


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256`` for
    every vector of exactly ``width`` components, none null or non-finite; other rows are left
    out.

    The first centroids are the ``k`` vectors with the smallest hashes of seed and id, fewer
    if there are fewer vectors; of equal hashes (repeated ids), the vector that sorts first. A
    null id counts as an empty text there. Vectors go to the nearest centroid, of equally near
    ones to that with the smallest number; equal vectors, repeated ids and null ids are rows
    like others, and an empty cluster keeps its centroid. ``distance`` is squared. An empty
    table, or one without such vectors, gives an empty result; components of
    2**27 / ``scale`` or more are an error, as distances would not fit into 64 bits. Other
    columns are not touched.
    """
    vectors = keep(integer_vectors(df, id_col, vec_col, width, scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.v) for r in vectors.orderBy(order, "v").limit(k).select("v").collect()]
    second = F.lit(min(1, max(0, len(centroids) - 1))).alias("b")
    start = [F.lit(0).alias("a"), second, F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")]
    state, before = vectors.select("vec_id", "v", *start), None
    columns = state.columns
    if not centroids:
        rounds = 0
    kept = vectors
    for _ in range(rounds):
        work = _round(Centroids(centroids, before), width)
        table = keep(state.mapInArrow(work, STATE), "vectors")
        remove(kept)
        before, centroids = centroids, _moved(table, centroids)
        kept, state = table, table.filter("sums IS NULL").select(*columns)
    if not centroids:
        found = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        centroids = [[0] * width]
    else:
        found = keep(state.mapInArrow(_last(Centroids(centroids, before), width), FINAL), "clusters")
        remove(kept)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    own = {r.cluster: int(r.s) for r in sums.collect()}
    texts = [",".join(map(str, c)) for c in centroids]

    def by_cluster(values: list, kind: str):
        lookup = F.from_json(F.lit("[" + ",".join(values) + "]"), f"array<{kind}>")
        return F.element_at(lookup, F.col("cluster") + 1)

    digests = [f'"{hashlib.sha256(t.encode()).hexdigest()}"' for t in texts]
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster([str(own.get(i, 0)) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(own.values())).cast("bigint").alias("inertia"),
        by_cluster([f"[{t}]" for t in texts], "array<bigint>").alias("centroid"),
        by_cluster(digests, "string").alias("centroid_sha256"),
    )
