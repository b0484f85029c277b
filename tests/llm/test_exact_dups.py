from __future__ import annotations

import hashlib
import string

import numpy as np
from conftest import values
from pyspark.sql import functions as F
from tidemark.llm import exact_dups

from .conftest import ODD

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def digest(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).digest()


def expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(digest(text), []).append(doc)
    best = {d: max((x for x in g if x is not None), default=None) for d, g in groups.items()}
    return [(doc, best[digest(t)], len(groups[digest(t)])) for doc, t in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    sizes, bits, slot = exact_dups.perfect_hash(keys)
    assert sorted(slot) == list(range(5000))
    assert (exact_dups.slots(keys, sizes, bits) == slot).all()
    others = exact_dups.slots(rng.integers(0, 256, (5000, 32), dtype=np.uint8), sizes, bits)
    assert others.max() < 5000 and (others == -1).any() and (others >= 0).any()
    assert exact_dups.perfect_hash(np.zeros((0, 32), np.uint8))[0] == []


def test_every_split_gives_the_same(real_docs):
    docs, rows = real_docs
    wanted = ordered(expected([(d, t) for d, t, _ in rows]))
    for split in (None, F.col("doc_id") < 300, F.lit(True), F.lit(False)):
        found = exact_dups.exact_duplicates(docs, in_history=split)
        assert values(found, "doc_id", "keep_id", "group_size") == wanted
        assert found.filter("kept").count() == len({digest(t) for _, t, _ in rows})


def test_small_buckets(real_docs, monkeypatch):
    monkeypatch.setattr(exact_dups, "BUCKET_KEYS", 40)
    docs, rows = real_docs
    found = exact_dups.exact_duplicates(docs)
    assert values(found, "doc_id", "keep_id", "group_size") == ordered(expected([(d, t) for d, t, _ in rows]))


def test_odd_rows(odd_docs):
    found = exact_dups.exact_duplicates(odd_docs)
    rows = [(r[0], r[1]) for r in ODD]
    assert values(found, "doc_id", "keep_id", "group_size") == ordered(expected(rows))
    kept = [r.digest for r in found.filter("kept").collect()]
    assert sorted(map(bytes, kept)) == sorted({digest(t) for _, t in rows})


def test_empty_table(no_docs):
    assert exact_dups.exact_duplicates(no_docs).count() == 0
