"""Connected components of links between documents, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import staged
from newsflow.operators.joins import join_group_totals


def _star(links: DataFrame, only_smaller: bool, number: int) -> DataFrame:
    """Hang the neighbours of every node (the larger ones, or the smaller ones) below its smallest neighbour.
    ``number`` is the number of links or somewhat more."""
    if not only_smaller:
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"), F.count("*").alias("links"))
    hung = join_group_totals(links, least, ["u"], "links", spread=F.col("v"), number=number)
    if only_smaller:
        ends = F.explode(F.array("u", "v"))
        return hung.select(ends.alias("u"), F.col("least").alias("v")).filter("u != v")
    return hung.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Every round keeps what is connected and brings nodes nearer to the smallest of theirs; it ends when a round changes
    nothing, after about as many rounds as the logarithm of the longest chain. Links are (u, v) with u > v; every round
    is written to the shared folder. Links that are null or join a node with itself count as none.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = staged(ends.filter("a is not null and b is not null and u != v").distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = seen
        # Each link is seen from both ends, so twice their number bounds the rows of either step.
        now = staged(_star(_star(now, False, 2 * seen[0]), True, 2 * seen[0]).distinct(), "links")
