from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from conftest import values
from tidemark.llm import near_dups
from tidemark.llm.components import components

from .conftest import ODD, smallest_reachable


def slow_simhash(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, max_bits, words=4):
    fps = np.array([slow_simhash(t, words) for _, t in rows], dtype=np.uint64)
    links = [
        (i, i + 1 + int(j))
        for i in range(len(rows))
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= max_bits)
    ]
    roots = smallest_reachable(len(rows), links)
    least = {}
    for (doc, _), root in zip(rows, roots):
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    return [(doc, format(int(f), "016x"), least.get(r)) for (doc, _), f, r in zip(rows, fps, roots)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_whole_table(real_docs):
    docs, rows = real_docs
    found = near_dups.near_duplicates(docs)
    wanted = expected([(d, t) for d, t, _ in rows], 4)
    assert values(found, "doc_id", "fingerprint", "component_id") == ordered(wanted)


@pytest.mark.parametrize("tile", [4, near_dups.TILE])
@pytest.mark.parametrize("max_bits", [3, 4])
def test_dense_groups(spark, max_bits, tile):
    """Many fingerprints around few centres, in small tiles and in one."""
    rng = random.Random(max_bits)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = near_dups.link(spark.createDataFrame(signed, "fp bigint"), max_bits, tile)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= max_bits for a, b in pairs)
    at = {f: i for i, f in enumerate(fps)}
    every = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= max_bits]
    got = smallest_reachable(len(fps), [(at[a], at[b]) for a, b in pairs])
    assert got == smallest_reachable(len(fps), every)


def test_odd_rows(odd_docs):
    found = near_dups.near_duplicates(odd_docs)
    wanted = expected([(r[0], r[1]) for r in ODD], 4)
    assert values(found, "doc_id", "fingerprint", "component_id") == ordered(wanted)
    kept = found.filter("kept").collect()
    assert sorted((r.doc_id, r.component_id) for r in kept) == [(i, i) for i in (1, 3, 6, 7, 8, 9)]


def test_empty_table(no_docs):
    assert near_dups.near_duplicates(no_docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 180)]
    star = [(5, i) for i in range(200, 260)] + [(7, 7), (200, 5)]
    links = spark.createDataFrame(path + star, "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 5 for i in [5, *range(200, 260)]}}
