from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Every odd case at once: nulls, empty and blank texts, repeats, clashing column names.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "the quick brown FOX jumps over the lazy dog", "en", "b", 43),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "  \n\t ", "fr", "a", 5),
    (6, "x", "fr", None, 1),
    (None, "the quick brown fox jumps over the lazy dog", "de", "c", 43),
    (None, None, None, "c", None),
    (7, "7", "de", "c", 1),
    (7, "7", "de", "c", 1),
    (8, "long " * 20_000, "en", "a", 100_000),
    (9, "é" * 50_000 + " 1" * 1000, "fr", "a", 52_000),
]
EXTRA = "_row struct<a: int>, fp string, digest string, spans string, node string, value string, ids string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, (0,), "f", "d", "s", "n", "v", "i") for r in ODD]
    return spark.createDataFrame(rows, f"{SCHEMA}, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real_docs(spark):
    """All documents of the small table, as Spark and as rows."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return docs, [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]


def smallest_reachable(n, links):
    """Union-find over row numbers: the smallest number that each one reaches."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
