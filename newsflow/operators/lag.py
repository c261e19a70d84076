"""Consumer lag from committed and end offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: messages of total lag above which a group is reported.
DEFAULT_THRESHOLD = 1000


def partition_lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """Lag per group and partition. A partition without a known end has none; no commit is offset -1."""
    behind = F.coalesce("end_offset", F.lit(0)) - F.col("committed")
    return committed.join(ends, ["topic", "partition"], "left").select(
        "group_id", "topic", "partition", F.greatest(behind, F.lit(0)).alias("lag")
    )


def group_lag(lags: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Total lag per group, whether it is above the threshold, and its partitions in order.

    The list holds one entry per topic partition of the group, a number fixed by the topic's layout.
    """
    parts = F.array_sort(F.collect_list(F.struct("topic", "partition", "lag")))
    return (
        lags.groupBy("group_id")
        .agg(F.sum("lag").alias("total_lag"), parts.alias("partitions"))
        .withColumn("breached", F.col("total_lag") > threshold)
    )
