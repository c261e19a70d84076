"""Sharding by a hypergeometric communication matrix, under the law ``rows``.

A uniform shuffle sends a random part of every block to every shard. How many rows go from each block to each
shard is drawn first, from the multivariate hypergeometric law, so that the shards' sizes come out exactly (counts
at most one apart). Every block then permutes its own rows and cuts them by its line of the matrix, the rows are
exchanged, and every shard permutes what it received.

A block is a hash of the row's content, so a lost task draws the same rows again, and reruns agree. Rows that are
equal in id, text checksum and size share a block and are interchangeable. The matrix has 2048 lines at any data
size; only the blocks' row counts come to the driver. The slots of a shard are its rows' places in 2048 sub-blocks
after the rows of the sub-blocks before, so no shard is sorted in one task.

A null text has no bytes and the checksum of the empty text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import packed

BLOCKS = 2048
SHARDS = 8
SEED = 20240601
IDENTITY = ("doc_id", "text_crc32", "size")


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows taken without return are good. Inverts the law over 40 deviations round its mode.

    Counts may be of any size, which the library's own generator does not allow.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(max(int((drawn + 1) * (good + 1) // (total + 2)), low), high)
    deviation = (drawn * (good / total) * (bad / total) * max(total - drawn, 1) / max(total - 1, 1)) ** 0.5
    reach = int(40 * deviation) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    chances = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(chances, rng.random() * chances[-1], side="right").clip(0, last - first))


def communication_matrix(block_rows: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows that each block sends to each shard; the column sums are the shards' sizes, at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(block_rows)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(block_rows), shards), dtype=np.int64)
    for b, rows in enumerate(block_rows):
        left, others = rows, sum(free)
        for s in range(shards):
            others -= free[s]
            sent = draw_hypergeometric(rng, free[s], others, left)
            matrix[b, s], left = sent, left - sent
        for s in range(shards):
            free[s] -= int(matrix[b, s])
    return matrix


def _draw(salt: int) -> Column:
    return F.xxhash64(F.lit(SEED + salt), *IDENTITY)


def _assigned(docs: DataFrame, shards: int, blocks: int) -> DataFrame:
    text = F.col("text")
    rows = (
        packed(
            docs,
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        )
        .withColumn("block", F.pmod(_draw(0), F.lit(blocks)).cast("int"))
        .withColumn("sub", F.pmod(_draw(2), F.lit(blocks)).cast("int"))
    )
    counts = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}  # at most ``blocks`` numbers
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shards)
    bounds = rows.sparkSession.createDataFrame(
        [(b, [int(x) for x in line[:-1]]) for b, line in enumerate(np.cumsum(matrix, axis=1))],
        "block int, bounds array<long>",
    )
    local = Window.partitionBy("block").orderBy(_draw(1), *IDENTITY)
    return (
        rows.withColumn("place", F.row_number().over(local) - 1)
        .join(F.broadcast(bounds), "block")
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("place"))))
        .drop("block", "place", "bounds")
    )


def shard(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """Each row in a struct ``_row`` with doc_id, size, text_crc32, its shard and its slot there, from 0 without gaps."""
    assigned = _assigned(docs, shards, blocks)
    earlier = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        assigned.groupBy("shard", "sub")
        .count()
        .select("shard", "sub", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    )
    own = Window.partitionBy("shard", "sub").orderBy(_draw(3), *IDENTITY)
    placed = assigned.withColumn("place", F.row_number().over(own) - 1)
    slots = placed.join(F.broadcast(starts), ["shard", "sub"])  # at most shards * blocks rows
    return slots.withColumn("slot", F.col("start") + F.col("place")).drop("sub", "place", "start")


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return shard(docs, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
