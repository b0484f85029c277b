"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import keep, remove


def _to_smallest(links: DataFrame, own: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them.

    ``links`` has rows (u, v): v is a neighbour of u. With ``own``, u is hung there as well
    and only its smaller neighbours count; without, only the larger neighbours are hung.
    """
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    if own:
        near = links.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return near.union(smallest.select("u", F.col("m").alias("v"))).filter("u <> v")
    smallest = smallest.select("u", F.least("u", "m").alias("m"))
    near = links.join(smallest, "u").filter("v > u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links``; the component is its smallest node.

    ``links`` has two bigint columns, one row or more per link. Alternates two steps until
    the links stay the same: every node passes its larger neighbours to its smallest
    neighbour, then every node passes its smaller ones and itself. The number of rounds
    grows with the logarithm of the largest component, no row holds more than one link, and
    a node with very many links is a skewed join key, which adaptive execution splits. Each
    round is a table in the shared folder; the table before it is deleted.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    stars = keep(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v")
        .distinct(),
        "links",
    )
    state = None
    while True:
        seen = stars.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, own=False).distinct()
        found = keep(_to_smallest(large, own=True).distinct(), "links")
        remove(stars)
        stars = found
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
