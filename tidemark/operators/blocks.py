"""Running values over a long order, without sorting the whole of it in one task.

The order of a group is cut into blocks by its position. A block is one value to the
blocks after it, so running over the (few) block values gives every block its start, and
the rows then only have to be ordered inside their own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window


def block_starts(
    blocks: DataFrame, keys: list[str], block: str, running: Column, name: str
) -> DataFrame:
    """``running`` over all earlier blocks of the group; null for the first block.

    ``blocks`` holds one row per group and block, so it has rows / block size rows.
    """
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(block)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return blocks.withColumn(name, running.over(earlier))


def inside_block(keys: list[str], block: str, order: list[str]):
    """Window from the start of the block to the current row."""
    return (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
