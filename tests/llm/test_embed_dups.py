from __future__ import annotations

import numpy as np
import pytest
from conftest import values
from tidemark.llm import embed_dups

from .conftest import SF_DIR, smallest_reachable

SCHEMA = "vec_id bigint, embedding array<double>, node int, tile string"


def expected(rows, threshold):
    fine = []
    width = max((len(v) for _, v in rows if v), default=1)
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.append((i, np.pad(np.array(v, float) / np.abs(v).max(), (0, width - len(v)))))
    links = []
    for a, (i, x) in enumerate(fine):
        for j, y in fine[:a]:
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links.append((i, j))
    counts = np.bincount([i for pair in links for i in pair], minlength=len(rows))
    roots, least = smallest_reachable(len(rows), links), {}
    for (vec, _), root in zip(rows, roots):
        if vec is not None:
            least[root] = min(vec, least.get(root, vec))
    out = [(vec, int(n), least.get(r)) for (vec, _), n, r in zip(rows, counts, roots)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def found(df, **options):
    return values(embed_dups.near_vectors(df, **options), "vec_id", "n_links", "component_id")


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert found(df) == expected(rows, 0.95)


@pytest.mark.parametrize("tile", [40, 4096])
def test_clusters(spark, tile):
    """Clusters of many densities, copies and scaled copies, in small tiles and in one."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [c + rng.normal(size=24) * s for c in centres for s in (0.02, 0.15, 0.2, 0.25, 0.4) for _ in range(6)]
    rows += [rows[0]] * 40 + [rows[1] * 7.0] * 3
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows)]
    df = spark.createDataFrame([(*r, 0, "t") for r in rows], SCHEMA)
    assert found(df, tile=tile, threshold=0.9) == expected(rows, 0.9)


def test_border_is_taken_from_the_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [3.0, 4.0]), (4, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found(df, threshold=0.6) == expected(rows, 0.6)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (None, [2.0, 4.0, 6.0]), (3, None),
        (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [nan, 2.0, 3.0]), (8, [inf, 2.0, 3.0]),
        (9, [1e200, 2e200, 3e200]), (10, [5.0]), (11, [7.0, 0.0]), (None, [-1.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 0, "t") for r in rows], SCHEMA)
    assert found(df) == expected(rows, 0.95)
    assert found(df.limit(0)) == []


def test_bounds_lose_nothing():
    rng = np.random.default_rng(4)
    a = embed_dups._unit(rng.normal(size=(700, 40)) + 3 * rng.normal(size=(1, 40)))
    whole = a @ a.T
    pairs = {(i, j) for x, y, _ in embed_dups.compare(a, a, True, 0.9) for i, j in zip(x.tolist(), y.tolist())}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(whole >= 0.9 - 1e-9)) if i < j}
