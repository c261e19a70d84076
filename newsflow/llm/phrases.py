"""Phrase collocations by dynamic itemset counting.

The documents are dealt into ``SHARDS`` shards, which are scanned in a circle. The first steps count words. As soon as a
phrase has reached the threshold it is active, and from the next step on a longer phrase is counted if both phrases that
it begins and ends with are active. Lengths are thus counted side by side in one scan, and every phrase is done when it has
been counted for one full cycle of ``SHARDS`` steps, wherever in the circle it began.

Which phrases are active is told by one table of ``CELLS`` bytes for each length, indexed by a phrase's hash, that holds the
step since which the cell is active. Its size does not depend on the corpus, so it may be sent to all tasks. Phrases that
share a cell can only make a longer phrase start too early, never late: its first step is the later one of its two cells, the
same in every task, and cells once set never change. Whatever collides, each phrase is thus counted in every shard just
once, and its count is exact. A crowded table merely lets more phrases be counted than would be needed; raise ``CELLS``
with the corpus. Counts are summed by Spark, by language and phrase, and the open ones are staged after every step.

A phrase is scored by its weakest cut: the share of its own count in those of the two parts. It is left out if a longer
phrase around it has nearly as many occurrences.

Null and empty texts have no words; a null language is ``und``. Repeated rows count each time. Without documents or
frequent phrases the result is empty. Very long texts are cut at the ends of their pieces, where no phrase goes across, and
so are counted whole in bounded memory, but for one piece that alone is larger than ``SLICE``. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsflow.llm.common import staged
from newsflow.llm.importance import slices

LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
SHARDS, CELLS = 2, 1 << 22
SLICE = 4 << 20
NEVER = 255
ENDS, NO_LANG = r"[.,;:!?\x0A-\x0D]", "und"
# ``kind`` is the number of words and the first step, as n * FIRST + started: a phrase has just one.
COUNTS = "lang string, kind int, phrase string, occurrences long"
FIRST = 256
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return numbers ^ (numbers >> np.uint64(27))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit number for every word, from its bytes."""
    words = words.cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return np.zeros(len(words), dtype=np.uint64)
    sizes = np.diff(ends, prepend=0)
    base = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset]
    letters = np.frombuffer(words.buffers()[2], dtype=np.uint8)[base : base + ends[-1]].astype(np.uint64)
    powers = np.cumprod(np.full(int(sizes.max()), MULTIPLIER))
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    sums, full = np.zeros(len(words), dtype=np.uint64), sizes > 0
    sums[full] = np.add.reduceat((letters + np.uint64(1)) * powers[place], (ends - sizes)[full])
    return mixed(sums)


def joined_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The number of a phrase from those of the phrases without its last and without its first word."""
    return mixed(first * MULTIPLIER + second)


def in_language(words: np.ndarray, languages: np.ndarray) -> np.ndarray:
    return mixed(words ^ (languages * MULTIPLIER))


def cell_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes % np.uint64(cells)).astype(np.int64)


def phrase_counts(
    texts: pa.Array, langs: pa.Array, step: int, shards: int, since: list[np.ndarray]
) -> Iterator[pa.RecordBatch]:
    """Rows of ``COUNTS`` for the phrases that are being counted at this step."""
    for begin, some in slices(texts, SLICE):
        lists = pc.split_pattern_regex(pc.replace_substring(pc.ascii_lower(some), "\t", " "), ENDS)
        every, text_of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        del lists
        for at, pieces in slices(every, SLICE):  # several only where one text is larger
            split = pc.split_pattern(pieces, " ")
            words, of = pc.list_flatten(split), pc.list_parent_indices(split)
            there = pc.not_equal(words, "")
            words, of = words.filter(there).dictionary_encode(), of.filter(there).to_numpy()
            del split, there
            if len(of):
                lang = langs.take(pa.array(begin + text_of[at + of])).dictionary_encode()
                yield from _slice_counts(words, of.astype(np.int32), lang, step, shards, since)


def _distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, and for each number the place of its own among them."""
    coded = pa.array(numbers).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _slice_counts(words, of, lang, step: int, shards: int, since: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    ids, langs = words.indices.to_numpy().astype(np.int64), lang.indices.to_numpy().astype(np.int64)
    # Words of one language are numbered by ``code``; ``spelled`` has the words of every code.
    codes, at = _distinct(langs * len(words.dictionary) + ids)
    totals = np.bincount(langs, minlength=len(lang.dictionary))
    del ids, langs
    lang_of, spelled = codes // len(words.dictionary), (codes % len(words.dictionary))[:, None]
    hashes = in_language(word_hashes(words.dictionary)[spelled[:, 0]], word_hashes(lang.dictionary)[lang_of])
    started = np.zeros(len(codes), dtype=np.int64)
    if step < shards:
        yield _batch(lang.dictionary, 0, pa.array([""] * len(totals)), np.zeros(len(totals), dtype=np.int64), totals)
    place = np.arange(len(at))  # where the phrase of each entry of ``at`` begins
    for length in range(1, len(since) + 2):
        counts = np.bincount(at, minlength=len(codes))
        now = np.flatnonzero((started <= step) & (step < started + shards))
        if len(now):
            phrase = pc.binary_join_element_wise(
                *[words.dictionary.take(pa.array(spelled[now, i])) for i in range(length)], " "
            )
            yield _batch(lang.dictionary.take(pa.array(lang_of[now])), length, phrase, started[now], counts[now])
        if length > len(since):
            return
        table = since[length - 1]
        # A cell may be active before the phrase itself is counted, set by another phrase; the phrase is not.
        active = np.maximum(table[cell_of(hashes, len(table))], started)
        # Two active phrases that begin at neighbouring words of one piece make a longer one.
        code_at = np.full(len(of) + 1, -1, dtype=np.int32)
        use = active[at] <= step
        code_at[place[use]] = at[use]
        place = np.flatnonzero((code_at[:-1] >= 0) & (code_at[1:] >= 0))
        place = place[of[place] == of[place + 1]]
        first, second = code_at[place].astype(np.int64), code_at[place + 1].astype(np.int64)
        # Of those counted before, only the active ones are still looked at: longer phrases begin or end with them.
        over = np.flatnonzero(np.maximum(active[first], active[second]) + shards <= step)
        needed = np.ones(len(place), dtype=bool)
        needed[over] = False
        if length < len(since) and len(over):
            cells = cell_of(joined_hashes(hashes[first[over]], hashes[second[over]]), len(since[length]))
            needed[over] = since[length][cells] <= step
        place, first, second = place[needed], first[needed], second[needed]
        pairs, at = _distinct(first * len(codes) + second)
        first, second = pairs // len(codes), pairs % len(codes)
        started = np.maximum(active[first], active[second])
        hashes = joined_hashes(hashes[first], hashes[second])
        lang_of, spelled = lang_of[first], np.column_stack((spelled[first], spelled[second, -1]))
        codes = pairs


def _batch(lang: pa.Array, n: int, phrase: pa.Array, started: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    columns = [lang, pa.array((n * FIRST + started).astype(np.int32)), phrase.cast(pa.string()), pa.array(counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "phrase", "occurrences"])


def _cell_words(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The cells of phrases (lang, n, phrase), as bits of 64-bit words."""
    for batch in batches:
        lang = word_hashes(batch.column("lang"))
        lengths = batch.column("n").to_numpy()
        for n in np.unique(lengths):
            chosen = np.flatnonzero(lengths == n)
            words = pc.list_flatten(pc.split_pattern(batch.column("phrase").take(pa.array(chosen)), " "))
            hashes = in_language(word_hashes(words), np.repeat(lang[chosen], n)).reshape(-1, n)
            while hashes.shape[1] > 1:
                hashes = joined_hashes(hashes[:, :-1], hashes[:, 1:])
            found = np.unique(cell_of(hashes[:, 0], cells))
            bits = np.left_shift(np.uint64(1), (found & 63).astype(np.uint64)).view(np.int64)
            columns = [pa.array(np.full(len(found), n, dtype=np.int32)), pa.array(found >> 6), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "word", "bits"])


def _activate(since: list[np.ndarray], rows: list, step: int) -> bool:
    """Set the cells named by rows (n, word, bits) that were not set before; whether there were any."""
    new = False
    for n in {r["n"] for r in rows}:
        mine = [r for r in rows if r["n"] == n]
        bits = np.array([r["bits"] for r in mine], dtype=np.int64).view(np.uint64)
        which = (bits[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        row, bit = np.nonzero(which)
        cells = np.array([r["word"] for r in mine], dtype=np.int64)[row] * 64 + bit
        cells = cells[since[n - 1][cells] == NEVER]
        since[n - 1][cells] = step
        new = new or len(cells) > 0
    return new


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, cells: int = CELLS
) -> DataFrame:
    """Phrases of up to ``longest`` words with ``least`` or more occurrences: lang, n (words), phrase, occurrences.

    The row with n = 0 holds the number of all words of a language, if it is no less than ``least``.
    """
    if shards * longest >= NEVER or cells % 64:
        raise ValueError(f"shards times longest must be below {NEVER}, cells a multiple of 64")
    spark = docs.sparkSession
    dealt = docs.filter("text is not null").select(
        "text",
        F.coalesce("lang", F.lit(NO_LANG)).alias("lang"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"),
    )

    since = [np.full(cells, NEVER, dtype=np.uint8) for _ in range(longest - 1)]
    open_counts, done, newest = None, [], 0
    for step in range(shards * longest):
        if step >= newest + shards:
            break  # all phrases have been counted for a full cycle
        tables = spark.sparkContext.broadcast(since)

        def count(batches: Iterator[pa.RecordBatch], step: int = step, tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from phrase_counts(batch.column(0), batch.column(1), step, shards, tables.value)

        found = dealt.filter(F.col("shard") == step % shards).select("text", "lang").mapInArrow(count, COUNTS)
        if open_counts is not None:
            found = found.unionByName(open_counts)
        ended = F.col("kind") % FIRST + shards == step + 1
        often = F.col("occurrences") >= least
        # Rare phrases that have been counted in all shards are not needed any more.
        totals = staged(
            found.groupBy("lang", "kind", "phrase").agg(F.sum("occurrences").alias("occurrences")).filter(~ended | often),
            f"phrases-{step}",
        )
        tables.destroy()
        n = F.expr(f"kind div {FIRST}").cast("int").alias("n")
        done.append(totals.filter(ended).select("lang", n, "phrase", "occurrences"))
        open_counts = totals.filter(~ended)
        # Those that were frequent before have their cells, which stay as they are.
        words = totals.filter(often).select("lang", n, "phrase").filter(F.col("n").between(1, longest - 1))
        words = words.mapInArrow(lambda b: _cell_words(b, cells), "n int, word long, bits long")
        rows = words.groupBy("n", "word").agg(F.bit_or("bits").alias("bits")).collect()  # at most cells / 64 of each n
        if _activate(since, rows, step + 1):
            newest = step + 1
    return reduce(DataFrame.unionByName, done)


def scored_phrases(frequent: DataFrame) -> DataFrame:
    """Phrases of two or more words with the counts of the parts at their weakest cut: lang, n, phrase, a, l, r, score."""
    counts = frequent.filter("n >= 1").select("lang", "phrase", "occurrences")
    candidates = frequent.filter("n >= 2").withColumnRenamed("occurrences", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    sides = {s: counts.select("lang", F.col("phrase").alias(s), F.col("occurrences").alias(c)) for s, c in (("first", "l"), ("rest", "r"))}
    cuts = cuts.join(sides["first"], ["lang", "first"]).join(sides["rest"], ["lang", "rest"])
    # Decimals, because two million occurrences times two million pass 64 bits in a large corpus.
    score = F.expr("cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)")
    weakest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    cuts = cuts.withColumn("score", score)
    return cuts.groupBy("lang", "n", "phrase", "a").agg(weakest).select("lang", "n", "phrase", "a", "cut.*")


def without_covered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Without the phrases inside a longer one that has at least ``covered`` percent as many occurrences."""
    words = F.split("phrase", " ")
    inner = candidates.filter("n >= 3").select("lang", "n", "a", words.alias("words"))
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)))
    inner = inner.withColumn("phrase", F.array_join(F.slice("words", F.col("start"), F.col("size")), " "))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    percent = F.expr(f"cast(100 as decimal(10, 0)) * cast(around as decimal(20, 0)) >= {covered} * cast(a as decimal(20, 0))")
    return candidates.join(most, ["lang", "phrase"], "left").filter(~F.coalesce(percent, F.lit(False))).drop("around")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n (words of the language), score."""
    frequent = staged(frequent_phrases(docs, least, longest, shards, cells), "phrases")
    kept = without_covered(scored_phrases(frequent)).drop("n")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = frequent.filter("n = 0").select("lang", F.col("occurrences").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
