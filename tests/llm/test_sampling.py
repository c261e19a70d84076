"""Importance resampling, the compression classifier and phrase mining against plain Python, and their edge rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.llm import importance, phrases, quality

SCHEMA = "doc_id long, text string, lang string, score double, rank string, shard int, _text string, n int"
random.seed(11)
VOCABULARY = ["".join(random.choices("abcdéß7", k=random.randint(1, 4))) for _ in range(60)]


def prose(n, words=VOCABULARY):
    return " ".join(random.choices(words, k=n))


TEXTS = [
    None,
    "",
    " \t\n.;",
    "ÀB ab\tAB.ab ab\x0bab ab, cd",
    "x" * 40_000,
    "new york times. " * 50,
    prose(30_000, VOCABULARY[:5]),
    *[prose(random.randint(1, 90), VOCABULARY[:20]) for _ in range(60)],
    *["the same text stands here, the same text " + prose(3)] * 8,
]


def table(spark, texts=TEXTS, langs=("en", None, "de")):
    rows = [(i, t, langs[i % len(langs)], 0.5, "r", 1, "t", 2) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Importance resampling


def plain_words(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_buckets(text, longest, buckets):
    words = plain_words(text)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_resample(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    source, wanted = collections.Counter(), collections.Counter()
    for _, text in rows:
        source.update(plain_buckets(text, longest, buckets))
    for text in target:
        wanted.update(plain_buckets(text, longest, buckets))
    s, t = sum(source.values()), sum(wanted.values())
    found = []
    for ident, text in rows:
        each = [
            math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets))))
            for b in plain_buckets(text, longest, buckets)
        ]
        weight = sum(each) // len(each) if each else 0
        digest = hashlib.sha256(f"2024:{'' if ident is None else ident}".encode()).hexdigest()
        noise = math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))
        found.append([ident, len(each), weight, weight + noise, len(plain_words(text))])
    fit = sorted((f for f in found if f[4] >= least), key=lambda f: (-f[3], f[0] is None, f[0]))
    ranks = {id(f): i + 1 for i, f in enumerate(fit[: percent * len(fit) // 100])}
    return sorted((tuple(f[:4]) + (ranks.get(id(f)),) for f in found), key=str)


TARGET = [prose(40, VOCABULARY[10:25]), "new york", None, ""]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample_equals_brute_force(spark, docs, longest):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scored = importance.scored(docs, target, longest=longest).cache()
    found = importance.ranked(scored, least_words=5).select("_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, found), key=str) == plain_resample(rows, TARGET, longest, least=5)


def test_resample_report_and_rows(spark, docs):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    report = importance.resample_report(docs, target)
    wanted = plain_resample(rows, TARGET)
    assert sorted(map(tuple, report.collect()), key=str) == wanted
    drawn = importance.resample(docs, target)
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(w[0] for w in wanted if w[4] is not None)


def test_equal_scores_are_ranked_by_id(spark):
    schema = "_id long, n_features long, n_words long, weight long, score long"
    rows = [(i, 30, 30, 0, 7) for i in range(30)] + [(99, 30, 30, 0, 9), (100, 3, 3, 0, 50)]
    ranks = {r._id: r["rank"] for r in importance.ranked(spark.createDataFrame(rows, schema)).collect()}
    assert ranks[99] == 1 and ranks[0] == 2 and ranks[1] == 3 and ranks[100] is None
    assert sum(r is not None for r in ranks.values()) == 3


def test_resample_of_nothing(spark, docs, none):
    target = spark.createDataFrame([], "text string")
    assert importance.resample_report(none, target).count() == 0
    assert importance.resample_report(docs, target).count() == docs.count()


def test_slices_cover_every_text():
    texts = pa.array(["a" * 5, None, "b" * 50, "", "cc"])
    parts = [(at, part.to_pylist()) for at, part in importance.slices(texts, 8)]
    assert [t for _, p in parts for t in p] == texts.to_pylist()
    assert all(sum(len(t or "") for t in p) <= 8 or len(p) == 1 for _, p in parts)


# Compression classifier


def labelled(spark, size=240):
    rows, labels = [], []
    for i in range(size):
        bad = i % 3 == 0
        text = " | ".join(prose(12).upper().split()) + " !!" if bad else prose(60) + "."
        rows.append((i, text, "en", 0.5, "r", 1, "t", 2))
        labels.append((i, int(not bad), 0))
    rows += [(size, None, None, None, None, None, None, None), (size + 1, "", "", 0.0, "", 0, "", 0), (None, "no id", "", 0.0, "", 0, "", 0)]
    rows += [(size + 2, prose(20_000), "en", 0.5, "r", 1, "t", 2)] * 2
    return (
        spark.createDataFrame(rows, SCHEMA).repartition(4),
        spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int"),
    )


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    found = quality.quality_report(docs, labels).collect()
    assert len(found) == docs.count()
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id in known]
    assert len(held) > 20 and [(r.doc_id, r.score) for r in held if r.predicted != known[r.doc_id]] == []
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
    again = {r.doc_id: r.score for r in quality.quality_report(docs.repartition(7), labels).collect()}
    assert {r.doc_id: r.score for r in found} == pytest.approx(again)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled(spark)
    rows = [(r.doc_id, 1 - r.quality if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality)
            for r in labels.collect() if r.quality is not None]
    other = spark.createDataFrame(rows, "doc_id long, quality int")
    assert quality.fit(docs, labels) == quality.fit(docs, other)


def test_scores_are_those_of_the_plain_model(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    packer = quality.Packer(model.good, model.bad)
    scored = quality.score_texts(docs, model).select("_row.*", "predicted")
    assert scored.columns == [*docs.columns, "predicted"]
    for r in quality.quality_report(docs, labels).join(docs.select("doc_id", "text"), "doc_id").limit(40).collect():
        x = (np.array(packer.features(r.text)) - model.middle) / model.spread
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.weights[0] + x @ model.weights[1:]))))


def test_good_rows_keep_their_columns(spark):
    docs, labels = labelled(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(240) if i % 3}


def test_quality_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_report(none, labels).count() == 0
    assert {r.score for r in quality.quality_report(docs, labels).collect()} == {0.5}
    one = spark.createDataFrame([(6, 1), (7, 1)], "doc_id long, quality int")
    scores = {r.score for r in quality.quality_report(docs, one).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1


# Phrases


def plain_counts(rows, longest):
    counts = collections.Counter()
    for lang, text in rows:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts[lang or "und", 0, ""] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang or "und", n, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts


@pytest.mark.parametrize(("shards", "cells"), [(1, 64), (3, 64), (4, 1 << 12)])
def test_frequent_phrases_equal_brute_force(docs, shards, cells):
    """With 64 cells nearly all phrases collide, and the counts must be the same."""
    counts = plain_counts([(r.lang, r.text) for r in docs.collect()], 4)
    found = phrases.frequent_phrases(docs, 30, 4, shards, cells).collect()
    wanted = sorted((*k, n) for k, n in counts.items() if n >= 30)
    assert sorted(map(tuple, found)) == wanted and any(w[1] == 4 for w in wanted)


def test_a_phrase_in_a_foreign_cell_waits_for_its_words(spark):
    """A longer phrase whose parts lie in cells that others have set earlier is still counted for a full cycle."""
    r = random.Random(209)
    shards, cells, many = r.choice([2, 2, 3]), r.choice([64, 128, 256, 512]), r.choice([6, 12, 20])
    words, often = [f"w{i}" for i in range(many)], [1 / (i + 1) for i in range(many)]
    texts = [[" ".join(r.choices(words, often, k=r.randint(0, 30))) for _ in range(r.randint(0, 12))] for _ in range(shards)]
    least = r.choice([2, 3, 5])
    dealt = spark.range(1000).select("id", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")).collect()
    rows = [(d.id, text, "en") for i in range(shards) for d, text in zip([d for d in dealt if d.shard == i], texts[i], strict=False)]
    found = phrases.frequent_phrases(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least, 4, shards, cells)
    counts = plain_counts([(lang, text) for _, text, lang in rows], 4)
    assert sorted(map(tuple, found.collect())) == sorted((*k, n) for k, n in counts.items() if n >= least)


def plain_collocations(counts, least, top):
    candidates = {k: n for k, n in counts.items() if k[1] >= 2 and n >= least}
    found = []
    for (lang, n, phrase), a in candidates.items():
        words = phrase.split(" ")
        cuts = []
        for k in range(1, n):
            left, right = counts[lang, k, " ".join(words[:k])], counts[lang, n - k, " ".join(words[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        around = [
            b for (other, m, longer), b in candidates.items()
            if other == lang and m > n and any(longer.split(" ")[i : i + n] == words for i in range(m - n + 1))
        ]
        if not any(100 * b >= 80 * a for b in around):
            score, _, left, right = min(cuts)
            found.append((lang, -score, -a, phrase.encode(), left, right))
    rows, rank = [], collections.Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, counts[lang, 0, ""], -score))
    return rows


@pytest.mark.parametrize("top", [5, 2000])
def test_collocations_equal_brute_force(docs, top):
    counts = plain_counts([(r.lang, r.text) for r in docs.collect()], 4)
    found = sorted(map(tuple, phrases.collocations(docs, 30, 4, top).collect()))
    assert found == plain_collocations(counts, 30, top)


def test_large_counts_do_not_overflow(spark):
    rows = [("en", 1, "a", 9 * 10**17), ("en", 1, "b", 8 * 10**17), ("en", 2, "a b", 7 * 10**17), ("en", 3, "a b b", 6 * 10**17), ("en", 2, "b b", 6 * 10**17)]
    frequent = spark.createDataFrame(rows, "lang string, n int, phrase string, occurrences long")
    found = {r.phrase: (r.l, r.r, r.score) for r in phrases.scored_phrases(frequent).collect()}
    assert found["a b"] == (9 * 10**17, 8 * 10**17, 2_000_000 * 7 // 17)
    assert found["a b b"] == (9 * 10**17, 6 * 10**17, 800_000)
    assert [r.phrase for r in phrases.without_covered(phrases.scored_phrases(frequent)).collect()] == ["a b b"]


def test_phrases_of_nothing(spark, none):
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "one two", "en")], "doc_id long, text string, lang string")).count() == 0


def test_word_hashes_depend_on_bytes_alone():
    words = pa.array(["ab", "", "é", "ab", "ba", "a" * 300])
    hashes = phrases.word_hashes(words)
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 5
    assert phrases.word_hashes(words.slice(2, 3)).tolist() == hashes[2:5].tolist()
    assert phrases.word_hashes(pa.array([], pa.string())).tolist() == []
