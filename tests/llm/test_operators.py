"""Edge rows and brute-force versions of the training-text operators on small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from newsflow.llm import bpe, exact_dedup, fingerprints, licenses, lm_scoring, mixing, near_dedup, sharding, toxicity, warc
from newsflow.llm.catalog import tokenizer_path
from newsflow.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, key string"
random.seed(3)
WORDS = ["".join(random.choices("abcdeè", k=random.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(random.choices(WORDS, k=n))


BASE = prose(120)
TEXTS = [
    None,
    "",
    "  \t\n",
    "word",
    "one two three four",
    BASE,
    "".join(c.upper() if c.isascii() else c for c in BASE),
    BASE,
    BASE + " tail",
    "x" * 30_000,
    "Released under the MIT License and the Apache License, Version 2.0. all rights reserved",
    "SPDX-License-Identifier: GPL-2.0 <|endoftext|> é́ Σας",
    *[prose(random.randint(1, 300)) for _ in range(25)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b"][i % 3], 0, True, 1, "k") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, None, None, None)] * 2  # repeated rows without an id
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def test_exact_copies(docs, none):
    found = {r.doc_id: r for r in exact_dedup.mark_copies(docs).collect() if r.doc_id is not None}
    assert found[0].keep_id == found[1].keep_id == 1 and found[0].group_size == 2 and not found[0].kept
    assert found[5].keep_id == 7 and found[6].group_size == 3 and found[7].kept
    assert found[5].text_sha256 == hashlib.sha256(BASE.encode()).hexdigest()
    assert exact_dedup.mark_copies(none).count() == 0


def test_dropped_copies_keep_all_columns_and_one_of_repeated_rows(docs):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in left.collect())
    assert ids[None] == 1 and ids[7] == 1 and 5 not in ids and max(ids.values()) == 1


def test_full_filter_changes_nothing(docs):
    def rows(blocks):
        return sorted(map(str, exact_dedup.mark_copies(docs, blocks).collect()))

    assert rows(1) == rows(1 << 16)


def test_mix_keeps_to_targets(docs, none):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.taken == r.size * r.copies and r.copies <= 3
    assert sum(r.taken for r in rows) <= sum(r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(docs.repartition(5)).collect()))
    assert mixing.mix_report(none).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_targets_share_out_the_excess(rows):
    sizes = rows([("a", 100), ("b", 900), ("c", 1000)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(sizes, (5, 2, 1), 3).collect()}
    assert found["a"] == 300 and found["b"] == pytest.approx(1700 * 2 / 3) and sum(found.values()) == pytest.approx(2000)


def closed_syncmers(text):
    hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    windows = [signed[i : i + 5] for i in range(max(1, len(signed) - 4))] if signed else []
    return [w for w in windows if min(w) in (w[0], w[-1])]


def test_fingerprints(docs):
    own = docs.filter("doc_id is not null")
    found = {r.doc_id: r for r in fingerprints.fingerprints(own).collect()}
    last = max(found)
    for i, text in enumerate(TEXTS):
        after = TEXTS[i - 1 if i else last] or ""
        third = len(text or "") // 3
        edited = (text or "")[: len(text or "") - third] + after[:third]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(found[i].fingerprint.split()) == len(closed_syncmers(text or ""))
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    assert found[5].fingerprint == found[7].fingerprint and found[1].fingerprint == ""


def test_fingerprints_of_one_and_no_document(docs, none):
    one = fingerprints.fingerprints(docs.filter("doc_id = 5")).first()
    assert one.near_next == 1 and fingerprints.fingerprints(none).count() == 0


def test_license_places_and_labels(docs, none):
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (found[10].n_base, found[10].first_word, found[10].last_word) == (2, 3, 7)
    assert found[10].base_labels == "apache,mit" and found[10].labels == "all-rights-reserved,apache,mit"
    assert found[11].labels == "gpl" and found[11].base_labels == "" and found[11].first_word is None
    assert found[0].n_words == 0 and found[0].score == 0
    for i, text in enumerate(TEXTS):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        assert found[i].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered))
    assert licenses.scan(none).count() == 0
    assert len(licenses.signature_rules()) > 200


def test_sentences_of_mit_and_isc_texts(rows):
    texts = [
        "MERCHANTABILITY AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM",
        "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted",
    ]
    found = licenses.scan(rows(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in found] == ["mit", "isc"]


def mention(expression):
    """A shortest text that a rule's expression matches, with other separators than blanks."""
    short = re.sub(r"\(\?:[^()]*\)(?:\?|\{\d,\d\})| \?|v\?", lambda m: " " if m[0] == " ?" else "", expression)
    while "(?:" in short:
        short = re.sub(r"\(\?:([^()]*)\)", lambda m: random.choice(m[1].split("|")), short)
    short = short.replace("[sc]", random.choice("sc")).replace(r"\d+", "2")
    return re.sub(" +", lambda m: random.choice([" ", "\n", "-", ", "]), short).title()


def spans_of_all_rules(text):
    """Label and place of every match of every rule, suppressed in order of start, longest first, strongest first."""
    listed = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    joined, found, kept = f" {' '.join(listed)} ", [], []
    for _, expression, label, priority, weight in licenses.signature_rules():
        for m in re.finditer(f"(?<= )(?:{expression})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((start, -(start + m[0].count(" ")), priority, label, weight))
    for new in sorted(found):
        if not kept or new[0] > -kept[-1][1]:
            kept.append(new)
        elif new[1] < kept[-1][1] and new[2] < kept[-1][2]:
            kept[-1] = new
    return [(label, start, -end) for start, end, _, label, _ in kept]


def test_every_rule_is_found_where_a_scan_without_gates_finds_it(rows):
    alone = [mention(rule[1]) for rule in licenses.signature_rules()]
    mixed = [f"{prose(5)} {random.choice(alone)}. {random.choice(alone)} {prose(3)}" for _ in range(100)]
    texts = [*alone, *mixed, "dedicated to the public\nDomain", "Released under the GPL v3.", "mar\u212aed \u0130sc \u212a license mit"]
    found = licenses.scan(rows(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert len(found) == len(texts) and all(r.labels for r in found[: len(alone)])
    for r in found:
        assert [tuple(s) for s in r.spans] == spans_of_all_rules(texts[r.doc_id]), texts[r.doc_id]


def test_shards_are_exact_and_repeatable(docs, none):
    rows = sharding.shard_report(docs).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_report(docs.repartition(4)).collect()))
    assert {r.doc_id: r.text_crc32 for r in rows}[5] == zlib.crc32(BASE.encode())
    assert sharding.shard_report(none).count() == 0


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    draws = [sharding.draw_hypergeometric(rng, 300, 700, 100) for _ in range(4000)]
    assert abs(np.mean(draws) - 30) < 0.3 and abs(np.var(draws) - 18.92) < 2
    assert 0 <= sharding.draw_hypergeometric(rng, 10**10, 10**10, 10**9) - 499_000_000 <= 2_000_000
    matrix = sharding.communication_matrix([5, 0, 9, 3], 3)
    assert matrix.sum(axis=1).tolist() == [5, 0, 9, 3] and matrix.sum(axis=0).tolist() == [6, 6, 5]


def test_bpe_equals_the_library(docs, none):
    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    own.no_truncation()
    own.no_padding()
    found = {r.doc_id: r for r in bpe.encode_report(docs, tokenizer_path()).collect()}
    for i, text in enumerate(TEXTS):
        ids = own.encode(text or "", add_special_tokens=False).ids
        decoded = own.decode(ids, skip_special_tokens=False)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_report(none, tokenizer_path()).count() == 0


def test_bpe_keeps_ids_alone():
    def held(value):
        return sys.getsizeof(value) + (sum(map(held, value)) if isinstance(value, tuple) else 0)

    tokenizer = bpe.Tokenizer(tokenizer_path())
    for i in range(2000):
        tokenizer.run(f"word{i}".encode())
    assert sum(held(k) + held(v) for k, v in tokenizer.known.items()) < 120 * len(tokenizer.known)


def test_bpe_sends_on_no_more_tokens_than_allowed(monkeypatch):
    monkeypatch.setattr(bpe, "OUTPUT_TOKENS", 50)
    texts = [*[t or "" for t in TEXTS], "", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["_row", "_text"])
    made = list(bpe.encode_batches(tokenizer_path(), [batch]))
    assert [i for b in made for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert all(sum(map(len, b.column(1).to_pylist()[:-1])) < 50 for b in made)


def test_bpe_report_gets_no_text_back(docs):
    plan = bpe.encode_report(docs, tokenizer_path())._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    assert "text" not in plan.output().head().dataType().simpleString()
    assert bpe.encode(docs, tokenizer_path()).schema["_row"].dataType.names == docs.columns


def test_warc_round_trip_with_records_inside_payloads(rows):
    inner = "a WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\nzz"
    html = ["<p>é", inner, None, "", "<p>é", "end WARC/1.0", "\r\n\r\nWARC/1.0\r\n\r\n\r\n", inner]
    pages = rows([(i, "u\r\nv", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.archive_report(pages).collect()}
    assert sorted(found) == list(range(len(html)))
    for i, h in enumerate(html):
        payload = (h or "").encode()
        assert found[i].payload_bytes == len(payload)
        assert found[i].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = [x or "" for x in html].index(h or "")
        assert (found[i].record_type, found[i].refers_to) == (("response", None) if first == i else ("revisit", first))


def test_near_copies(docs, none):
    found = {r.doc_id: r for r in near_dedup.near_components(docs).collect()}
    assert found[5].component_id == found[6].component_id == found[8].component_id == 5
    assert found[5].kept and not found[8].kept and found[8].n_shingles == len(
        {tuple(w) for w in zip(*[words(TEXTS[8])[i:] for i in range(5)], strict=False)}
    )
    assert found[0].component_id == 0 and found[1].component_id == 1 and found[0].n_shingles == 0
    assert found[3].n_shingles == 1 and found[4].n_shingles == 1
    assert near_dedup.drop_near_copies(docs).columns == docs.columns
    assert near_dedup.near_components(none).count() == 0


def test_components_of_a_chain_and_a_star(rows):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in components(rows(links, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 130)} == {100}


def test_language_model_against_counts(docs, none):
    rows = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    training = [t for i, t in data if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    counts = collections.Counter(w for t in training for w in [*words(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for i, text in enumerate(TEXTS):
        tokens = [*words(text), b"\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert rows[i].base_score == pytest.approx(base) and rows[i].train_tokens == n
        assert rows[i].n_tokens == len(tokens) and rows[i].n_known == sum(counts[w] > 0 for w in tokens)
        assert rows[i].score < 0
    assert lm_scoring.score_texts(none).count() == 0


def bigram_scores(data):
    """Scores by a plain Python model with the counts of all word pairs; data are (id, text)."""
    training = [[b" ", *words(t), b"\n"] for i, t in data if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    single = collections.Counter(w for t in training for w in t)
    pairs = collections.Counter(p for t in training for p in zip(t, t[1:]))
    n, v = sum(len(t) - 1 for t in training), len(single) - 1
    for i, text in data:
        read = [b" ", *words(text), b"\n"]
        root = [(single[w] + 0.5) / (n + 0.5 * (v + 1)) for w in read]
        steps = zip(read, read[1:], root[1:])
        yield i, sum(math.log10((pairs[h, w] + 500 * p) / (single[h] + 500)) for h, w, p in steps)


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_language_model_counts_pairs_of_rare_words(rows, monkeypatch, block_bytes):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
    rare = "a lone zebra crossing"
    data = [(0, "the same words " * 50_000), (1, rare), (2, rare), (3, "zebra crossing again"), (4, "Crossing zebra"), (5, None)]
    data += [(i, prose(random.randint(1, 40))) for i in range(6, 40)]
    found = {r.doc_id: r.score for r in lm_scoring.score_texts(rows(data, "doc_id long, text string")).collect()}
    assert found == pytest.approx(dict(bigram_scores(data)))


def brute_distance(term, word):
    row = list(range(len(word) + 1))
    for i, a in enumerate(term, 1):
        row, old = [i], row
        for j, b in enumerate(word, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (a != b)))
    return row[-1]


def test_lexicon_finds_what_edit_distance_finds():
    terms = ["abcd", "abcde", "bdacbdacb", "ddd"]
    lexicon = toxicity.Lexicon([(t, False) for t in terms])
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 10))) if rng.random() < 0.5 else rng.choice(terms) + "a"
        near = [d for t in terms if (d := brute_distance(t, word)) <= toxicity.allowed_edits(t, False)]
        assert lexicon.edits(word) == (min(near) if near else None)


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon([("moron", False)])
    assert toxicity.hit_counts(lexicon, "you moron and morom") == (1, 1, 0, 0, 0)
    assert toxicity.hit_counts(lexicon, 'the sign had "moron" on it') == (0, 0, 1, 0, 0)
    assert toxicity.hit_counts(lexicon, "") == (0, 0, 0, 0, 0)


def test_toxicity_learns_and_survives_missing_labels(spark, none):
    data = [(i, prose(40) + (" worthless scum" if i % 4 == 0 else ""), None) for i in range(200)]
    data += [(900, None, None), (901, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert all(rows[i].predicted == (i % 4 == 0) for i in range(200)) and rows[900].predicted == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity_report(docs, labels.limit(0)).filter(F.col("predicted") == 1).count() == 0
    assert toxicity.toxicity_report(none, labels).count() == 0
