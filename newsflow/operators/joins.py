"""Join of rows with totals of their own groups, where one group may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# No task of the join gets more than about this part of all rows because of one key.
PARTS = 2000


def join_group_totals(
    rows: DataFrame,
    totals: DataFrame,
    on: Sequence[str],
    count: str,
    spread: Column,
    parts: int = PARTS,
    number: int | None = None,
) -> DataFrame:
    """Inner join of ``rows`` with ``totals``, which has one row per key and the key's row count in ``count``.

    A key is cut into as many shares as it holds ``1/parts`` of all rows, and its total is repeated once per
    share; ``spread`` (an id) deals the rows out. Fewer than ``parts`` keys can have more than one share, since
    their counts add up to the total, so the list of those keys is safe to broadcast at any data size. ``number``, if the
    caller knows it, is the number of all rows or somewhat more; else the counts are summed.
    """
    everything = totals.select(F.sum(count)).scalar() if number is None else F.lit(max(1, number))
    cut = totals.withColumn("_shares", F.ceil(F.col(count) * F.lit(parts) / everything).cast("int"))
    large = cut.filter(F.col("_shares") > 1).select(*on, "_shares")
    dealt = rows.join(F.broadcast(large), list(on), "left").withColumn(
        "_share", F.pmod(F.xxhash64(spread), F.coalesce("_shares", F.lit(1))).cast("int")
    )
    copies = cut.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    return dealt.drop("_shares").join(copies, [*on, "_share"]).drop("_share")
