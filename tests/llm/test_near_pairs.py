"""The last comparison of near-duplicate classes: it loses no pair, and a shared passage does not bring all together."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from newsflow.llm import near_dedup

random.seed(17)
SETS = "node long, shingles array<long>"


def number():
    return random.getrandbits(62)


def pairs_of(spark, sets, component=lambda i: i):
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], SETS)
    nodes = spark.createDataFrame([(i, component(i)) for i in range(len(sets))], "node long, component long")
    return near_dedup._near_pairs(nodes, rows), rows


def alike(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def test_no_similar_pair_is_lost(spark):
    sets = []
    for _ in range(25):
        base = [number() for _ in range(random.randint(1, 40))]
        for _ in range(6):
            kept = [s for s in base if random.random() < 0.93] or base
            sets.append(set(kept + [number() for _ in range(random.randint(0, max(1, len(base) // 8)))]))
    found, rows = pairs_of(spark, sets)
    links = {(r.a, r.b) for r in near_dedup._confirmed(found, rows).collect()}
    assert links == {(i, j) for i, j in combinations(range(len(sets)), 2) if alike(sets[i], sets[j])} and len(links) > 50


def test_nodes_of_one_component_are_not_compared(spark):
    base = [number() for _ in range(30)]
    sets = [set([*base, number()]) for _ in range(6)]
    found, _ = pairs_of(spark, sets, lambda i: i // 3)
    assert {(r.a, r.b) for r in found.collect()} == {(i, j) for i in range(3) for j in range(3, 6)}


def test_a_shared_passage_gives_few_pairs(spark):
    """1,000 unlike texts with one passage of 46 shingles in common, from a fifth to four fifths of the text."""
    passage = [number() for _ in range(46)]
    sets = [set(passage + [number() for _ in range(12 + i % 180)]) for i in range(1000)]
    found, _ = pairs_of(spark, sets)
    assert found.count() <= len(sets)


def test_texts_with_a_shared_passage_stay_apart(spark):
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(random.choices(words, k=60))
    texts = [f"{' '.join(random.choices(words, k=40 + i % 50))} {passage}" for i in range(80)]
    texts += [texts[3] + " tail", texts[3] + " other tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    found = {r.doc_id: r.component_id for r in near_dedup.near_components(docs).collect()}
    assert found == {i: 3 if i >= 80 else i for i in range(82)}
