from __future__ import annotations

from conftest import values

from tidemark.plans import adapters


def test_number_in_props(spark):
    texts = ['{"k": 5}', '{"k":-7}', '{"a": 1, "k": 8}', '{"a": {"k": 1}}', "{}", None, "oops", '{"k": "9"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, props string")
    assert values(df, "i", adapters._k().alias("k")) == [
        (0, 5),
        (1, -7),
        (2, 8),
        (3, None),
        (4, None),
        (5, None),
        (6, None),
        (7, 9),
    ]


def test_replays_keep_the_rows(spark):
    df = spark.range(15).selectExpr("id", "id AS offset")
    replayed = adapters.with_replays(df, "id")
    assert replayed.count() == 18
    assert replayed.filter(f"offset >= {adapters.REPLAY_OFFSET}").count() == 3
