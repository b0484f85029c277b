"""Joins by key that stay balanced when single keys hold much of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS = 64
#: A key is hot if it holds at least this share of the rows of its shard.
HOT_SHARE = 0.02
TRACKED_PER_SHARD = 256
SALTS = 64


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that hold a share of ``HOT_SHARE`` or more of their shard: never
    more than ``SHARDS / HOT_SHARE`` rows, whatever the input.

    One pass over the key column with sketches of fixed size; the rows themselves are not
    shuffled, and the sketches of all tasks are merged in ``SHARDS`` tasks. Which keys are
    named only steers the work, never the result.
    """
    most = int(1 / HOT_SHARE)
    sketch = F.expr(f"approx_top_k(`{key}`, {most}, {TRACKED_PER_SHARD})")
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.pmod(F.xxhash64(key), F.lit(SHARDS)).alias("_shard"))
        .agg(sketch.alias("top"), F.count(F.lit(1)).alias("n"))
        .select(F.explode("top").alias("t"), "n")
        .filter((F.col("t.count") >= F.col("n") * HOT_SHARE) & (F.col("t.count") > 1))
        .select(F.col("t.item").alias(key))
    )


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "left", unique: bool = False
) -> DataFrame:
    """``left JOIN right USING (key)`` for ``left``, ``left_semi`` and ``left_anti``.

    ``right`` has one row per key. Left rows of a hot key are dealt over ``SALTS`` tasks,
    and the right row of that key is repeated for each; all other keys are joined as
    usual. Rows without a key match nothing and are dealt out as well. Only the hot-key
    table is broadcast: its size is fixed.

    With ``unique`` the caller knows that the left side, too, has one row per key: no key can
    be hot, and the plain join reuses the partitioning that made it so.

    A row is dealt by its content and its input partition. Both are the same when a task
    is run again, and copies of one row in different partitions still part.
    """
    if unique:
        added = [c for c in right.columns if c != key] if how == "left" else []
        return left.join(right, key, how).select(*left.columns, *added)
    content = [f.name for f in left.schema if not isinstance(f.dataType, T.MapType)]
    hot = F.broadcast(hot_keys(left, key).withColumn("_hot", F.lit(True)))
    is_hot = F.coalesce(F.col("_hot"), F.col(key).isNull())
    dealt = F.pmod(F.xxhash64(F.spark_partition_id(), *content), F.lit(SALTS)).cast("int")
    salted = left.join(hot, key, "left").withColumn("_salt", F.when(is_hot, dealt).otherwise(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    added = [c for c in right.columns if c != key] if how == "left" else []
    return salted.drop("_hot").join(repeated, [key, "_salt"], how).select(*left.columns, *added)


def _key_join(left: DataFrame, right: DataFrame, key: str, how: str, unique: bool) -> DataFrame:
    keys = right.select(key).distinct()
    if left.isStreaming:
        # a batch of a stream cannot be looked at before it is joined
        return left.join(keys, key, how).select(left.columns)
    return salted_join(left, keys, key, how, unique)


def semi_join(left: DataFrame, right: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """Left rows whose key occurs on the right, however often."""
    return _key_join(left, right, key, "left_semi", unique)


def anti_join(left: DataFrame, right: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """Left rows whose key does not occur on the right."""
    return _key_join(left, right, key, "left_anti", unique)
