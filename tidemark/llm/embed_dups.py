"""Near-duplicate embeddings: tiles in principal-component order, with bounds that stop early.

Vectors are scaled to length one and turned into principal components, largest first. Equal
vectors are one row with a count. The rows are sorted into tiles along the leading components and
each tile keeps its box in them. Two tiles whose boxes are further apart than two linked
vectors can be are never compared. In the others, the products of the leading dimensions of
all pairs are summed first; what the rest can add is at most the product of the norms of the
remaining parts, and pairs that cannot reach the threshold stop there. The rest goes on with
further dimensions, and pairs within rounding of the threshold are computed once more from
the vectors themselves.

Comparing everything with everything is quadratic by nature; what a task holds is two tiles,
whatever the input. Each task emits one count per row and a spanning forest of its links.
The rotation is fitted on a bounded sample and steers only the order of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import ROW, keep, with_rows

#: Vectors on which the rotation is fitted.
FIT_ROWS = 4096
#: Vectors of a tile, about; no tile has more than twice as many.
TILE = 4096
#: Leading components along which vectors are sorted into tiles.
SORTED = 3
STRIP = 512
EPS = 1e-9


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one; large and small magnitudes do not overflow."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column, width: int) -> np.ndarray:
    """Lists of doubles as rows; shorter ones are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def rotation(distinct: DataFrame, width: int, rows: int = FIT_ROWS) -> np.ndarray:
    """Principal components (columns, largest first) of at most ``rows`` vectors, chosen by
    the hash of their values."""
    sample = distinct.select("v").orderBy(F.xxhash64("v")).limit(rows).toArrow()
    x = _unit(_matrix(sample["v"], width)) if sample.num_rows else np.zeros((0, width))
    values, vectors = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")])


def _steps(width: int) -> list[int]:
    out = [min(16, width)]
    while out[-1] < width:
        out.append(min(width, out[-1] * 2))
    return out


def compare(
    a: np.ndarray, b: np.ndarray, same: bool, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rotated unit rows with a cosine of at least ``threshold``; for a tile with
    itself only i < j. Strips of ``STRIP`` rows keep the work in bounds."""
    steps = _steps(a.shape[1])
    rest_a = [np.linalg.norm(a[:, s:], axis=1) for s in steps]
    rest_b = [np.linalg.norm(b[:, s:], axis=1) for s in steps]
    first = steps[0]
    for i0 in range(0, len(a), STRIP):
        own = slice(i0, i0 + STRIP)
        for j0 in range(i0 if same else 0, len(b), STRIP):
            other = slice(j0, j0 + STRIP)
            part = a[own, :first] @ b[other, :first].T
            reach = part + np.outer(rest_a[0][own], rest_b[0][other])
            i, j = np.nonzero(reach >= threshold - EPS)
            done = part[i, j]
            if same and i0 == j0:
                upper = i < j
                i, j, done = i[upper], j[upper], done[upper]
            i, j = i + i0, j + j0
            for k in range(1, len(steps)):
                if not len(i):
                    break
                more = slice(steps[k - 1], steps[k])
                done = done + np.einsum("ij,ij->i", a[i, more], b[j, more])
                able = done + rest_a[k][i] * rest_b[k][j] >= threshold - EPS
                i, j, done = i[able], j[able], done[able]
            if len(i):
                yield i, j, done


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each node its smallest reachable node, as links; nodes that reach no other are left out."""
    label = np.arange(n)
    a = np.concatenate([x for x, _ in links]) if links else np.zeros(0, dtype=np.int64)
    b = np.concatenate([y for _, y in links]) if links else a
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def tiles(points: DataFrame, rows: int, tile: int) -> tuple[DataFrame, int]:
    """``points`` with ``tile`` (bigint): sorted by ranges of the leading components, and cut by
    hash where a range holds more than ``tile`` rows (vectors that agree in all of them)."""
    wanted = max(1, -(-rows // tile))
    dims = min(SORTED, max(1, wanted.bit_length() - 1))
    per_dim = max(1, round(wanted ** (1 / dims)))
    cuts = [i / per_dim for i in range(1, per_dim)]
    columns = [f"c{d}" for d in range(dims)]
    edges = points.approxQuantile(columns, cuts, 0.01) if cuts and rows else [[] for _ in columns]
    cell = F.lit(0).cast("bigint")
    for name, own in zip(columns, edges):
        place = sum(((F.col(name) > e).cast("bigint") for e in own), F.lit(0).cast("bigint"))
        cell = cell * per_dim + place
    celled = points.withColumn("cell", cell)
    sizes = celled.groupBy("cell").count().withColumn("parts", F.ceil(F.col("count") / tile))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    most = per_dim**dims
    return (
        # the table of cells has rows / tile rows
        celled.join(sizes, "cell").withColumn("tile", F.col("cell") + part * most),
        most,
    )


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    tile: int = TILE,
) -> DataFrame:
    """``_row, vec_id, n_links, component_id, kept`` for every row of ``df``.

    Two vectors are linked if their cosine, in double precision, is at least ``threshold``
    (which must be positive). ``n_links`` counts the other rows linked directly, copies
    included; ``component_id`` is the smallest id reachable, the own id for a vector without
    links. Vectors that are null, empty or zero, or hold null or non-finite components, link
    with nothing. Of vectors of different lengths the shorter counts as padded with zeros.

    Rows without an id are linked and counted like others but never name a component; a
    component of such rows only has a null id. ``kept`` means that the row has the id of its
    component. An empty table gives an empty result; other columns are not touched.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    v = F.col(vector_col).cast("array<double>")
    rows = with_rows(df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")))
    fine = F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    rows = keep(rows.withColumn("v", F.when(fine, F.col("v"))), "vectors")
    distinct = rows.filter("v IS NOT NULL").groupBy("v").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    # the number is given once and written, so it stays
    distinct = keep(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct_vectors")
    shape = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = shape.width or 1
    turn = rotation(distinct, width)

    lead = min(SORTED, width)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(1), width)) @ turn if batch.num_rows else np.zeros((0, width))
            points = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(x) * width + 1, width), pa.int32()), pa.array(x.ravel())
            )
            zeros = np.zeros(len(x))
            leads = [pa.array(x[:, d] if d < lead else zeros) for d in range(SORTED)]
            names = ["node", "copies", "p", *(f"c{d}" for d in range(SORTED))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), points, *leads], names=names)

    schema = "node bigint, copies bigint, p array<double>, " + ", ".join(f"c{d} double" for d in range(SORTED))
    points = keep(distinct.select("node", "v", "copies").mapInArrow(project, schema), "points")
    tiled, _ = tiles(points, shape.n, tile)
    tiled = keep(tiled.select("node", "copies", "p", "tile", *(f"c{d}" for d in range(SORTED))), "tiles")

    # pairs of tiles that may hold links: boxes that come near in every leading component
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    boxes = tiled.groupBy("tile").agg(
        *(f(f"c{d}").alias(f"{n}{d}") for d in range(SORTED) for n, f in (("lo", F.min), ("hi", F.max)))
    )
    strips = boxes.withColumn(
        "strip",
        F.explode(F.sequence(F.floor(F.col("lo0") / far), F.floor((F.col("hi0") + far) / far))),
    )
    right = strips.select(*(F.col(c).alias(f"r_{c}") for c in strips.columns))
    near = (F.col("strip") == F.col("r_strip")) & (F.col("tile") <= F.col("r_tile"))
    for d in range(SORTED):
        near &= (F.col(f"lo{d}") <= F.col(f"r_hi{d}") + far) & (F.col(f"r_lo{d}") <= F.col(f"hi{d}") + far)
    pairs = strips.join(right, near).select(F.col("tile").alias("i"), F.col("r_tile").alias("j")).distinct()
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    dealt = sides.join(tiled.select("tile", "node", "copies", "p"), "tile")

    def work(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        of = table["tile"].to_numpy()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        p = _matrix(table["p"], width)
        left, right = np.flatnonzero(of == i), np.flatnonzero(of == j)
        counts = np.zeros(len(node), dtype=np.int64)
        links, unsure = [], []
        for a, b, cosine in compare(p[left], p[right], i == j, threshold):
            close = np.abs(cosine - threshold) <= EPS
            if close.any():
                # rounding decides: leave these to the vectors themselves
                exact = np.flatnonzero(close)
                unsure.append((left[a[exact]], right[b[exact]]))
                a, b = a[~close], b[~close]
            a, b = left[a], right[b]
            counts += np.bincount(a, copies[b], len(node)).astype(np.int64)
            counts += np.bincount(b, copies[a], len(node)).astype(np.int64)
            # links of a strip are thinned to a forest at once
            links = [_forest(len(node), [*links, (a, b)])]
        roots = links[0] if links else (np.zeros(0, dtype=np.int64),) * 2
        linked = np.flatnonzero(counts)
        rows = [
            (node[linked], np.full(len(linked), -1), counts[linked], np.zeros(len(linked), dtype=bool)),
            (node[roots[0]], node[roots[1]], np.zeros(len(roots[0])), np.zeros(len(roots[0]), dtype=bool)),
        ]
        for a, b in unsure:
            rows.append((node[a], node[b], np.zeros(len(a)), np.ones(len(a), dtype=bool)))
        columns = [np.concatenate([r[k] for r in rows]) for k in range(4)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["a", "b", "n", "unsure"]
        return pa.Table.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds)], names=names)

    found = keep(
        dealt.groupBy("i", "j").applyInArrow(work, "a bigint, b bigint, n bigint, unsure boolean"), "links"
    )

    # pairs within rounding of the threshold, from the vectors as they are
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, p: s + p)

    largest = F.array_max(F.transform("v", F.abs))
    own = distinct.select("node", "copies", F.transform("v", lambda x: x / largest).alias("v"))
    left = own.select(F.col("node").alias("a"), F.col("copies").alias("ca"), F.col("v").alias("va"))
    other = own.select(F.col("node").alias("b"), F.col("copies").alias("cb"), F.col("v").alias("vb"))
    cosine = dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))
    exact = keep(
        found.filter("unsure").join(left, "a").join(other, "b").filter(cosine >= threshold).select("a", "b", "ca", "cb"),
        "exact_links",
    )
    links = found.filter("NOT unsure AND b >= 0").select("a", "b").union(exact.select("a", "b"))
    reach = components(links)
    counts = (
        found.filter("n > 0").select(F.col("a").alias("node"), "n")
        .union(exact.select(F.col("a").alias("node"), F.col("cb").alias("n")))
        .union(exact.select(F.col("b").alias("node"), F.col("ca").alias("n")))
        .groupBy("node").agg(F.sum("n").alias("n"))
    )
    least = reach.join(distinct.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("top"))
    tops = reach.join(least, "component").select("node", "top")
    judged = (
        distinct.select("node", "v", "copies", "least")
        .join(counts, "node", "left")
        .join(tops, "node", "left")
        .select(
            F.col("v").alias("of"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.when(F.col("top").isNull(), F.col("least")).otherwise(F.least("top", "least")).alias("top"),
        )
    )
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("top"))
    return rows.join(judged, rows["v"] == judged["of"], "left").select(
        "_row",
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
