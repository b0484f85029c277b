"""Service-level report over a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.blocks import block_starts, inside_block

P = 0.95
#: Ranks (as shares) around the wanted one at which a group is cut into blocks.
NEAR = (0.0002, 0.0004, 0.001, 0.003, 0.01, 0.05)


def _verdict(report: DataFrame, group: str, max_fail: float, max_p95: float) -> DataFrame:
    fail_rate = F.col("errors") / F.col("n")
    return report.select(
        group,
        "n",
        F.round(fail_rate, 6).alias("fail_rate"),
        F.round("p95", 6).alias("p95"),
        ((fail_rate < max_fail) & (F.col("p95") < max_p95)).alias("ok"),
    )


def sla_report(
    log: DataFrame,
    group: str = "day",
    latency: str = "latency",
    is_error: str = "is_error",
    max_fail: float = fixed.MAX_FAILURE_RATE,
    max_p95: float = fixed.MAX_P95_MS,
    accuracy: int = 20_000,
) -> DataFrame:
    """Requests, failure rate and exact 95th percentile (interpolated) per group.

    No group is gathered in one task, however its latencies lie. Approximate quantiles close
    to the wanted rank cut a group into blocks, the narrower the closer; requests are
    folded to counts per distinct latency, the counts of the blocks tell which one or two
    hold the wanted ranks, and only those blocks are ordered: a few ``1 / accuracy`` of the
    group each. The cuts steer the work, never the result.
    """
    cuts = sorted({min(1.0, max(0.0, P + side * d)) for d in NEAR for side in (-1, 1)})
    edges = log.groupBy(group).agg(F.percentile_approx(latency, cuts, accuracy).alias("_edges"))
    edges = edges.withColumnRenamed(group, "_group")
    histogram = log.groupBy(group, latency).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(is_error)).alias("_errors")
    )
    block = F.size(F.filter("_edges", lambda e: e < F.col(latency)))
    # one row of edges per group
    histogram = histogram.join(edges, F.col(group).eqNullSafe(F.col("_group")), "left").select(
        group, latency, "_n", "_errors", F.when(F.col(latency).isNotNull(), block).alias("_block")
    )
    blocks = histogram.groupBy(group, "_block").agg(
        F.sum(F.when(F.col(latency).isNotNull(), F.col("_n"))).alias("_n"),
        F.sum("_n").alias("_requests"),
        F.sum("_errors").alias("_errors"),
    )
    whole = Window.partitionBy(group)
    values = F.sum("_n").over(whole)
    low, high = F.floor("_rank"), F.ceil("_rank")

    def holds(rank):
        return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))

    # The block table is small: one row per group and latency block.
    wanted = (
        block_starts(blocks, [group], "_block", F.sum("_n"), "_start")
        .select(
            group,
            "_block",
            "_n",
            F.coalesce("_start", F.lit(0)).alias("_before"),
            ((values - 1) * F.lit(P)).alias("_rank"),
            F.sum("_requests").over(whole).alias("n"),
            F.sum("_errors").over(whole).alias("errors"),
        )
        # a group without any latency keeps its counts
        .filter(holds(low) | holds(high) | F.col("_rank").isNull())
        .drop("_n")
    )
    up_to = F.sum("_n").over(inside_block([group], "_block", [latency]))
    ends = (
        wanted.hint("shuffle_hash")
        .join(histogram.select(group, "_block", latency, "_n"), [group, "_block"], "left")
        .withColumn("_upto", up_to + F.col("_before"))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .groupBy(group, "n", "errors", "_rank")
        .agg(
            F.max(F.when(holds(low), F.col(latency))).alias("_low"),
            F.max(F.when(holds(high), F.col(latency))).alias("_high"),
        )
    )
    part = F.col("_rank") - low
    p95 = F.col("_low") * (F.lit(1.0) - part) + F.col("_high") * part
    return _verdict(ends.withColumn("p95", p95), group, max_fail, max_p95)


def sla_report_approx(
    log: DataFrame,
    group: str = "day",
    latency: str = "latency",
    is_error: str = "is_error",
    max_fail: float = fixed.MAX_FAILURE_RATE,
    max_p95: float = fixed.MAX_P95_MS,
    accuracy: int = 10_000,
) -> DataFrame:
    """The same report with a percentile within ``1/accuracy`` of the rank, in one pass."""
    report = log.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(is_error)).alias("errors"),
        F.percentile_approx(latency, P, accuracy).alias("p95"),
    )
    return _verdict(report, group, max_fail, max_p95)
