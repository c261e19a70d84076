"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed bigram model of the training documents. Its states are the words and the start of a text. A
state has an arc for every word seen after it, with the probability (c(hw) + M p(w)) / (c(h) + M), and a failure arc of
weight M / (c(h) + M) to the root state, whose arcs p(w) know every word: (c + 0.5) / (N + 0.5 (V + 1)). The
probabilities of a state add up to one. A text is read from left to right: take the word's arc, or the failure arc and
the root's arc, add up the logarithms, and go on in the word's state. That state is the word just read, so the steps of
all texts are known beforehand and are looked up together.

The model grows with the corpus and is never whole in one place. Documents are dealt into blocks of about
``BLOCK_BYTES`` of text. Each block names the n-grams it holds with its own training counts; these are summed by n-gram
over all blocks; every block gets back the totals of its own n-grams, builds the part of the automaton its texts can
reach, and scores them. N-grams travel in order of their numbers, cut into as many buckets as there are blocks; a bucket
is a row of packed arrays, and the totals come back in the same order without the numbers.

Null and empty texts consist of the end token alone. Without training documents every probability is one.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import WORD, is_in_fold, lower_ascii

FOLDS, HELD_OUT = 5, 1
PRIOR = 500.0  # M
BLOCK_BYTES = 16 << 20
END, START = b"\n", b" "  # no word holds white space
SEED = 42  # of Spark's xxhash64, so that both sides give a word the same number
MASK = (1 << 64) - 1
GRAMS = "block long, bucket long, size long, keys binary, n binary"
TOTALS = "block long, bucket long, size long, n binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def word_key(word: bytes) -> int:
    """The number of a word, as Spark's xxhash64 has it."""
    key = xxhash.xxh64_intdigest(word, SEED)
    return key - (1 << 64) if key >> 63 else key


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of word pairs."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).astype(np.int64)


class Texts:
    """Texts of one block as arrays of word numbers: START, words, END."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        vocabulary: dict[bytes, int] = {START: 0, END: 1}
        number = vocabulary.setdefault
        self.ids = []
        for chunk in texts.chunks:
            for text in chunk:
                words = (text.as_py() or "").encode().lower().split()
                self.ids.append(np.array([0, *[number(w, len(vocabulary)) for w in words], 1], dtype=np.int64))
        self.keys = np.array([word_key(w) for w in vocabulary], dtype=np.int64)


class Grams:
    """The words and the word pairs of one block, with their counts in its training documents."""

    def __init__(self, table: pa.Table) -> None:
        self.texts = Texts(table.column("text"))
        ids, self.size = self.texts.ids, len(self.texts.keys)
        flat = np.concatenate(ids)
        used = np.repeat(np.array(table.column("training").to_pylist(), dtype=bool), [len(i) for i in ids])
        self.words = np.bincount(flat[used], minlength=self.size)
        steps = flat[1:] != 0  # not from one text to the next
        self.codes, self.step = np.unique((flat[:-1] * self.size + flat[1:])[steps], return_inverse=True)
        self.pairs = np.bincount(self.step[used[1:][steps]], minlength=len(self.codes))
        self.first, self.second = self.codes // self.size, self.codes % self.size

    def in_order(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words and then pairs, and the places that put them in order."""
        pairs = pair_keys(self.texts.keys[self.first], self.texts.keys[self.second])
        keys = np.concatenate((self.texts.keys, pairs)).view(np.uint64)
        return keys, np.argsort(keys)


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers as bytes: all lowest bytes, then all second ones and so on, compressed."""
    planes = np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view(np.uint64).ravel()


def block_grams(table: pa.Table, number: int) -> pa.Table:
    """The block's words and word pairs with their counts in its training documents, a row for each bucket."""
    grams = Grams(table)
    keys, order = grams.in_order()
    keys, counts = keys[order], np.concatenate((grams.words, grams.pairs))[order]
    bucket = ((keys >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)
    buckets, starts, sizes = np.unique(bucket, return_index=True, return_counts=True)
    parts = [slice(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return pa.table(
        {
            "block": np.full(len(buckets), table.column("block")[0].as_py(), dtype=np.int64),
            "bucket": buckets.astype(np.int64),
            "size": sizes.astype(np.int64),
            "keys": pa.array([pack(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()),
            "n": pa.array([pack(counts[p]) for p in parts], pa.binary()),
        }
    )


def bucket_totals(table: pa.Table) -> pa.Table:
    """The counts of one bucket's n-grams over all blocks, in each block's own order."""
    rows = table.to_pylist()
    keys = np.concatenate([np.cumsum(unpack(r["keys"], r["size"]), dtype=np.uint64) for r in rows])
    counts = np.concatenate([unpack(r["n"], r["size"]) for r in rows]).astype(np.int64)
    distinct, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(sums, at, counts)
    parts = np.split(sums[at], np.cumsum([r["size"] for r in rows])[:-1])
    kept = table.select(["block", "bucket", "size"])
    return kept.append_column("n", pa.array([pack(p) for p in parts], pa.binary()))


class Automaton:
    """The part of the model that the texts of one block can reach."""

    def __init__(self, grams: Grams, totals: pa.Table, tokens: int, distinct: int) -> None:
        self.grams = grams
        _, order = grams.in_order()
        counts = np.empty(len(order), dtype=np.int64)
        rows = sorted(totals.to_pylist(), key=lambda r: r["bucket"])
        counts[order] = np.concatenate([unpack(r["n"], r["size"]) for r in rows])
        self.counts, seen = counts[: grams.size], counts[grams.size :]
        if not tokens:
            self.root, self.arcs = np.zeros(grams.size), np.zeros(len(seen))
            return
        self.root = np.log10((self.counts + 0.5) / (tokens + 0.5 * (distinct + 1)))
        # What follows a word, the end token included, is counted once for each of its occurrences.
        failure = np.log10(PRIOR / (self.counts + PRIOR))
        fallen = failure[grams.first] + self.root[grams.second]
        self.arcs = np.where(seen > 0, np.log10(seen / (self.counts[grams.first] + PRIOR) + 10.0**fallen), fallen)

    def scores(self) -> np.ndarray:
        """Log10 probability of every text: the sum over its steps."""
        lengths = np.array([len(i) - 1 for i in self.grams.texts.ids])
        return np.add.reduceat(self.arcs[self.grams.step], np.cumsum(lengths) - lengths)


def score_block(table: pa.Table, totals: pa.Table, tokens: int, distinct: int) -> pa.Table:
    grams = Grams(table)
    model, ids = Automaton(grams, totals, tokens, distinct), grams.texts.ids
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "held_out": pa.array([not t for t in table.column("training").to_pylist()], pa.bool_()),
            "n_tokens": pa.array([len(i) - 1 for i in ids], pa.int64()),
            "n_known": pa.array([int((model.counts[i[1:]] > 0).sum()) for i in ids], pa.int64()),
            "base_score": pa.array([float(model.root[i[1:]].sum()) for i in ids], pa.float64()),
            "score": pa.array(model.scores(), pa.float64()),
        }
    )


def corpus_counts(docs: DataFrame) -> tuple[int, int, int]:
    """Training tokens, distinct ones, and the bytes of all texts."""
    training = docs.filter("training")
    words = training.select(F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))).alias("w"))
    counts = words.groupBy(F.xxhash64("w").alias("key")).count()
    texts = docs.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.count_if("training").alias("ends")
    ).first()
    sums = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    return sums.n + texts.ends, sums.v + (1 if texts.ends else 0), texts.size


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        (~is_in_fold(F.col("doc_id"), FOLDS, HELD_OUT)).alias("training"),
    )
    tokens, distinct, size = corpus_counts(rows)
    number = max(1, -(-size // BLOCK_BYTES))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(number)))

    def grams_of(table: pa.Table) -> pa.Table:
        return block_grams(table, number)

    def scores_of(table: pa.Table, totals: pa.Table) -> pa.Table:
        return score_block(table, totals, tokens, distinct)

    grams = blocks.groupBy("block").applyInArrow(grams_of, GRAMS)
    totals = grams.groupBy("bucket").applyInArrow(bucket_totals, TOTALS)
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(scores_of, SCORES)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
