"""Target-distribution importance resampling over hashed n-grams.

Texts are cut into words and n-grams by Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode``. Indices into the dictionary, set one against the other, form n-grams; each distinct n-gram of a
slice gets its CRC once. A first pass counts the buckets of all documents, another those of the target texts. The gain
of a bucket is the logarithm of how much more frequent it is in the target. A second pass takes the gains by the
dictionary's indices and reduces them to one sum for each document. With Gumbel noise made from the document's id added,
the highest scores are a sample without replacement that follows the target's distribution.

The counts are one number for each of ``BUCKETS`` buckets, whatever the size of the corpus. Ranks need no sort of
everything: scores are whole thousandths, whose number grows only with the logarithm of the corpus (weights lie within
1000 ln(10000 S) of nought, noise between -3,200 and 23,000), so a table of the documents at each score gives the place
where a score's ranks begin, and only documents with equal scores are sorted by id, those above the cut alone.

Null and empty texts have no n-grams and weight 0. A null id counts as empty text in the noise and stands behind all
others of its score; repeated rows get ranks one after the other. Without documents the result is empty; without target
texts, or with empty ones, every bucket counts as if it had been seen once there. Very long texts are read whole; a
slice ends after ``SLICE`` bytes, or with the one text that is longer. Columns that clash with the names used here are
carried in a struct and come back unchanged.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsflow.llm.common import packed, staged

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10
SLICE = 8 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCORED = ("n_features", "n_words", "weight", "score")


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """Parts of at most ``most`` bytes, or of one text, with the place where each begins."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        size = max(1, int(np.searchsorted(ends, before + most, side="right")) - at)
        yield at, texts.slice(at, size)
        at += size


def grams(texts: pa.Array, buckets: int, longest: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each length the text and the bucket of every n-gram; and the number of words of every text."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), NOT_WORD)
    words, of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.not_equal(words, "")
    coded, of = words.filter(there).dictionary_encode(), of.filter(there).to_numpy()
    spelled = [w.encode() for w in coded.dictionary.to_pylist()]
    ids = coded.indices.to_numpy().astype(np.int64)
    crc = np.fromiter((zlib.crc32(w) for w in spelled), dtype=np.int64, count=len(spelled))
    found, codes = [(of, (crc % buckets)[ids])], ids
    for length in range(2, longest + 1):
        # A longer n-gram is the one before and the word behind it, within one text.
        size = max(0, len(of) - length + 1)
        inside = of[:size] == of[len(of) - size :]
        pairs = codes[:size][inside] * len(spelled) + ids[len(ids) - size :][inside]
        distinct, at = np.unique(pairs, return_inverse=True)
        heads, tails = (distinct // len(spelled)).tolist(), (distinct % len(spelled)).tolist()
        crc = np.fromiter(
            (zlib.crc32(b" " + spelled[w], int(crc[h])) for h, w in zip(heads, tails, strict=True)), np.int64, len(heads)
        )
        found.append((of[:size][inside], (crc % buckets)[at]))
        codes = np.zeros(size, dtype=np.int64)
        codes[inside] = at
    return found, np.bincount(of, minlength=len(texts))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Number of n-grams in each bucket, over all rows of a DataFrame with the one column of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                for _, found in grams(part, buckets, longest)[0]:
                    sums += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(buckets, dtype=np.int64)  # one row for each bucket at most
    for row in rows:
        totals[row["bucket"]] = row["n"]
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What an n-gram of each bucket adds to a weight: thousandths of the logarithm of the smoothed ratio."""
    s, t, buckets = int(source.sum()), int(target.sum()), len(source)
    each = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in each])


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """Each row of ``docs`` in a struct ``_row`` with ``n_features``, ``n_words``, ``weight`` and ``score``."""
    gain = gains(bucket_counts(docs.select("text"), buckets, longest), bucket_counts(target.select("text"), buckets, longest))
    rows = packed(docs, F.col("text").alias("_text"), F.col("doc_id").alias("_id"))
    row, key = (rows.schema[c].dataType.simpleString() for c in ("_row", "_id"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1)):
                found, words = grams(part, buckets, longest)
                sums, number = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
                for of, bucket in found:
                    if len(of):
                        first = np.flatnonzero(np.diff(of, prepend=-1))
                        sums[of[first]] += np.add.reduceat(gain[bucket], first)
                        number += np.bincount(of, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)),
                        batch.column(2).slice(at, len(part)),
                        *(pa.array(a.astype(np.int64)) for a in (number, words, sums // np.maximum(number, 1))),
                    ],
                    names=["_row", "_id", "n_features", "n_words", "weight"],
                )

    weighed = rows.mapInArrow(weigh, f"_row {row}, _id {key}, n_features long, n_words long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    chance = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(chance))))


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Scored rows with ``rank``: 1, 2, 3... over the drawn ones, else null. Reads ``rows`` three times; stage them."""
    fit = F.col("n_words") >= least_words
    # One row for each score: bounded, see above.
    places = (
        rows.filter(fit).groupBy(F.col("score").alias("_score")).agg(F.count(F.lit(1)).alias("_here"))
        .withColumn("_before", F.sum("_here").over(W.orderBy(F.desc("_score"))) - F.col("_here"))
        .withColumn("_drawn", F.floor(F.sum("_here").over(W.partitionBy()) * percent / 100))
        .filter("_before < _drawn").select("_score", "_before", "_drawn")
    )
    placed = rows.join(F.broadcast(places), fit & (F.col("score") == F.col("_score")), "left").drop("_score")
    order = W.partitionBy("score").orderBy(F.col("_id").asc_nulls_last())
    near = placed.filter("_drawn is not null").withColumn("rank", F.col("_before") + F.row_number().over(order))
    near = near.withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")))
    rest = placed.filter("_drawn is null").withColumn("rank", F.lit(None).cast("long"))
    return near.unionByName(rest).drop("_before", "_drawn")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST) -> DataFrame:
    """The drawn rows of ``docs`` with their own columns; the scored rows are staged in the shared folder."""
    rows = staged(scored(docs, target, longest=longest), "importance")
    return ranked(rows, percent).filter("rank is not null").select("_row.*")


def resample_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank."""
    rows = staged(scored(docs.select("doc_id", "text"), target).drop("_row"), "importance")
    return ranked(rows).select(F.col("_id").alias("doc_id"), "n_features", "weight", "score", "rank")
