"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in a shuffle that its id alone decides. The virtual finish time of a
document is the number of words of its source up to and including it, divided by the source's target; further
rounds through a source follow the first. All documents of all sources are then ordered by finish time and cut
where the total budget is used up, so that every source is near its target at every point of the order.

Running totals never need one sorted task: a source is cut into 4096 places by the shuffle key, each place is
summed, and the place's own order is a window over (source, place). The global cut is found in the same way, by
two levels of 4096 bins of the finish time; only the documents of the last bin are ordered.

A null source is a source of its own and comes last. A null text has no words and is taken with zero words.
Rows that agree in id, source and size are one unit: each of them is taken as often as the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import packed, staged, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BINS = 4096
PLACE_DIGITS = 3  # hex digits: 4096 places
SEED = "mix-1"
KEYS = ("doc_id", "source", "size")


def source_targets(by_source: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Adds ``target``: the share of all words that the source's weight asks for, at most ``most`` times its size.

    The excess of a capped source goes to the others by weight. Sources in order of cap per weight: the capped ones
    come first, and the rate of the first that keeps below its cap is the rate of all that do.
    """
    every, before = Window.partitionBy(), Window.orderBy("_per_weight", "_rank")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    rates = (
        by_source.withColumn("_rank", rank)
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1)))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_per_weight", F.col("_cap") / F.col("_weight"))
        .withColumn(
            "_rate",
            (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
            / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))),
        )
    )
    below = F.when(F.col("_rate") * F.col("_weight") <= F.col("_cap"), F.struct("_per_weight", "_rank", "_rate"))
    rate = F.min(below).over(every)["_rate"]
    cap = F.col("_cap").cast("double")
    target = F.least(cap, F.coalesce(rate * F.col("_weight"), cap))
    return rates.select("source", "source_size", target.alias("target"))


def _units(docs: DataFrame) -> DataFrame:
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (
        docs.groupBy(*KEYS)
        .agg(F.count("*").alias("rows"))
        .withColumn("words", F.col("size") * F.col("rows"))
        .withColumn("key", key)
        .withColumn("place", F.substring("key", 1, PLACE_DIGITS))
    )


def _ranked(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``running``: the words of the source up to and including the unit, and the source's totals."""
    places = units.groupBy("source", "place").agg(F.sum("words").alias("place_words"))
    earlier = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        places.withColumn("start", F.coalesce(F.sum("place_words").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_s"), F.col("place").alias("_p"), "start", "source_size", "target")
    )
    own = Window.partitionBy("source", "place").orderBy("key", "doc_id", "size")
    ranked = units.withColumn("running", F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("place") == F.col("_p"))
    return ranked.join(starts, same).select(
        *KEYS, "words", (F.col("running") + F.col("start")).alias("running"), "source_size", "target"
    )


def _finish(copy: Column) -> Column:
    return F.try_divide(copy * F.col("source_size") + F.col("running"), F.col("target"))


def _bin(finish: Column, scale: int) -> Column:
    """Bins of the finish time; all that finish after four times the targets share the last one."""
    return F.least(F.floor(finish * scale), F.lit(4 * scale)).cast("long")


def _cut_bin(copies: DataFrame, scale: int, budget: int) -> tuple[int, int] | None:
    """The first bin that does not fit into the budget, and the words of the bins before it."""
    bins = copies.groupBy(_bin(F.col("finish"), scale).alias("bin")).agg(F.sum("words").alias("words"))
    sums = bins.withColumn("upto", F.sum("words").over(Window.orderBy("bin")))
    row = sums.filter(F.col("upto") > budget).agg(F.min(F.struct("bin", "upto", "words")).alias("cut")).first()
    return None if row is None or row.cut is None else (row.cut.bin, row.cut.upto - row.cut.words)


def _taken_test(ranked: DataFrame, most: int) -> tuple[Column, DataFrame]:
    """Whether one copy (a struct of finish time, id, source, size and round) is among those taken."""
    order = F.struct("finish", "doc_id", "source", "size", "copy")
    copies = (
        ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("finish", _finish(F.col("copy")))
        .filter("words > 0 and finish is not null")
    )
    total = ranked.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first().words
    coarse = _cut_bin(copies, BINS, total)
    if coarse is None:
        return lambda copy: F.lit(True), copies
    within = copies.filter(_bin(F.col("finish"), BINS) == coarse[0])
    fine = _cut_bin(within, BINS * BINS, total - coarse[1])
    last = within.filter(_bin(F.col("finish"), BINS * BINS) == fine[0])
    used = F.sum("words").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    fits = last.withColumn("used", used).filter(F.col("used") <= total - coarse[1] - fine[1])
    end = fits.agg(F.max(order).alias("end")).first().end

    def taken(copy: Column) -> Column:
        finish = _finish(copy)
        by_coarse, by_fine = _bin(finish, BINS), _bin(finish, BINS * BINS)
        before = (by_coarse < coarse[0]) | ((by_coarse == coarse[0]) & (by_fine < fine[0]))
        if end is None:
            return before
        types = [copies.schema[c].dataType for c in ("finish", "doc_id", "source", "size", "copy")]
        limit = F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(end, types, end.__fields__, strict=True)])
        own = F.struct(finish.alias("finish"), "doc_id", "source", "size", copy.alias("copy"))
        return before | ((by_coarse == coarse[0]) & (by_fine == fine[0]) & (own <= limit))

    return taken, copies


def mix_decisions(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per (doc_id, source, size): source_size, target and ``copies``, how often the mix takes the document."""
    units = _units(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    by_source = units.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = staged(_ranked(units, source_targets(by_source, weights, most)), "mix")
    taken, _ = _taken_test(ranked, most)
    copies = sum(
        (F.coalesce(taken(F.lit(i)), F.lit(False)).cast("int") for i in range(1, most)),
        F.coalesce(taken(F.lit(0)), F.lit(False)).cast("int"),
    )
    copies = F.when(F.col("words") > 0, copies).otherwise(1)
    return ranked.select(*KEYS, "source_size", "target", copies.alias("copies"))


def _with_decisions(docs: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    rows = packed(docs, "doc_id", "source", word_count(F.col("text")).alias("size"))
    decisions = mix_decisions(docs, weights, most)
    for c in KEYS:
        decisions = decisions.withColumnRenamed(c, f"_{c}")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS]
    return rows.join(decisions, same)


def mix_report(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    joined = _with_decisions(docs, weights, most)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return joined.select("doc_id", "size", "source_size", "target", taken, "copies")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns. Wordless ones stay once."""
    joined = _with_decisions(docs, weights, most).filter("copies > 0")
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
