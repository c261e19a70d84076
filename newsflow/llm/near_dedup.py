"""MinHash near-deduplication by a multi-index Hamming join.

A document's set is its distinct five-word shingles, as 64-bit hashes. Its signature has 48 symbols of 16 bits, each the
hash of the smallest shingle under one of 48 orders; two sets differ in a symbol with a chance of one less their
similarity. The signature is split into 12 chunks of 4 symbols. By the pigeonhole principle, signatures that differ
in fewer than 24 symbols differ in at most one symbol of some chunk; so each chunk is indexed with each of its
symbols left out, 48 keys in all, and all pairs below that distance share a key. Two sets of similarity 0.75 fail to
share one with a chance of 0.262^12, one in ten million, of similarity 0.8 one in 800 million.

Documents with equal sets are one class, and only classes are indexed. Whoever shares a key is a candidate; links are
confirmed on the full sets. Since the result is components, not links, candidates are taken in rounds. First every class
is compared with one class of each of its keys, drawn by a hash. What that confirms is connected. Where a key still holds
several components, the classes outside its most frequent component are compared with one class of that.

The classes of keys that are still open then meet by their rarest shingles. In one order by frequency, two sets of
similarity 0.75 share a shingle among the first n - ceil(6n/7) + 1 of the smaller one and the first n - ceil(3n/4) + 1 of the
larger one, at places that leave room for the rest of what they share. So no pair is lost, and a passage that
thousands of unlike texts have in common brings none together: it is frequent, and its shingles come last. Every pair is
thus compared or known to be connected already; a group of thousands of near copies costs a few comparisons for each member.

Null ids can't be linked: such rows are their own component (null) and stay. Rows that share an id are one document.
Null, empty and wordless texts have empty sets and are linked with nothing.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsflow.llm.common import packed, staged, unpacked
from newsflow.llm.components import components
from newsflow.operators.joins import join_group_totals

SHINGLE = 5
CHUNKS, CHUNK = 12, 4
SYMBOLS = CHUNKS * CHUNK
LINK_OF_100 = 75
KEPT_WORDS = 1_000_000
SKETCHES = "doc_id long, n_shingles long, set_key binary, keys array<long>"
SETS = "node long, shingles array<long>"

_RANDOM = np.random.default_rng(5)
MIXERS = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
ORDERS = _RANDOM.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
PLACES = _RANDOM.integers(1, 1 << 63, (CHUNKS, CHUNK), dtype=np.uint64) | np.uint64(1)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; every step can be undone, so no two values meet."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns texts into sets of shingle hashes. Word hashes are kept, up to a fixed number of words."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def hash_of(self, word: bytes) -> int:
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        found = self.words[word] = xxhash.xxh64_intdigest(word)
        return found

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        known = self.words.get
        hashes = np.array([known(w) or self.hash_of(w) for w in words], dtype=np.uint64)
        if not words:
            return hashes
        width = min(SHINGLE, len(words))
        mixed = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            mixed = _scrambled(mixed + hashes[i : len(words) - width + 1 + i] * MIXERS[i])
        return np.unique(mixed)


def index_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of a set: every chunk of its signature with each symbol left out once."""
    least = np.array([(shingles * order).min() for order in ORDERS], dtype=np.uint64)
    symbols = (_scrambled(least) & np.uint64(0xFFFF)).reshape(CHUNKS, CHUNK) + np.uint64(1)
    weighed = symbols * PLACES
    keys = weighed.sum(axis=1, keepdims=True, dtype=np.uint64) - weighed
    numbers = np.arange(1, SYMBOLS + 1, dtype=np.uint64).reshape(CHUNKS, CHUNK)
    return _scrambled(_scrambled(keys) + numbers).reshape(-1).astype(np.int64)


def _arrays(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    values = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)))


def sketch_batches(batches):
    shingler, none = Shingler(), np.empty(0, dtype=np.int64)
    for batch in batches:
        sizes, keys, marks = [], [], []
        for text in batch.column(1):
            found = shingler.shingles(text.as_py())
            sizes.append(len(found))
            marks.append(xxhash.xxh3_128_digest(found.tobytes()))
            keys.append(index_keys(found) if len(found) else none)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), _arrays(keys)],
            names=["doc_id", "n_shingles", "set_key", "keys"],
        )


def set_batches(batches):
    """Full sets, sent on in parts of at most about four megabytes."""
    shingler = Shingler()
    for batch in batches:
        cuts = [0]
        room = 0
        for i, size in enumerate(pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()):
            room += size
            if room > 1 << 22:
                cuts.append(i + 1)
                room = 0
        for begin, end in pairwise([*cuts, batch.num_rows] if cuts[-1] < batch.num_rows else cuts):
            part = batch.slice(begin, end - begin)
            sets = [shingler.shingles(t.as_py()).astype(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), _arrays(sets)], names=["node", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    every = F.size("of_a") + F.size("of_b") - common
    return pairs.join(left, "a").join(right, "b").filter(100 * common >= LINK_OF_100 * every).select("a", "b")


def _shared(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (set_key, node, copies), and (key, node, star) of each key that several classes share."""
    classes = staged(
        sketches.filter("doc_id is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("keys").alias("keys")
        ),
        "classes",
    )
    indexed = classes.select(F.explode("keys").alias("key"), "node")
    groups = indexed.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("star"), F.count("*").alias("members"))
    several = groups.filter("members > 1")
    return classes.drop("keys"), staged(
        join_group_totals(indexed, several, ["key"], "members", spread=F.col("node")).drop("members"), "shared-keys"
    )


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _open_keys(shared: DataFrame, found: DataFrame, salt: int) -> DataFrame:
    """(key, node, component, most, star) of the keys that still hold several components.

    ``most`` is the most frequent component of the key and ``star`` one of its classes there.
    """
    labelled = (
        shared.select("key", "node")
        .join(found, "node", "left")
        .select("key", "node", F.coalesce("component", "node").alias("component"))
    )
    parts = labelled.groupBy("key", "component").agg(
        F.count("*").alias("members"), F.min_by("node", F.xxhash64("key", "node", F.lit(salt))).alias("star")
    )
    size = F.struct("members", "component")
    split = (
        parts.groupBy("key")
        .agg(F.max_by(F.struct("component", "star"), size).alias("top"), F.count("*").alias("parts"), F.sum("members").alias("members"))
        .filter("parts > 1")
        .select("key", F.col("top.component").alias("most"), F.col("top.star").alias("star"), "members")
    )
    return staged(join_group_totals(labelled, split, ["key"], "members", spread=F.col("node")).drop("members"), "open-keys")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links. What was found goes in as a link of every node to its component, not as all links
    that led there; few rounds are left for such stars. Without further links nothing changes."""
    links = staged(links, "confirmed")
    if links.isEmpty():
        return found
    known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.unionByName(links))


def _rare_shingles(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(shingle, node, component, n, place) of the shingles that several of the nodes have, as far as the larger set of a pair
    needs them. ``place`` counts from 1, the rarest shingle of the set first."""
    own = nodes.join(sets, "node").select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    several = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    common = join_group_totals(own, several, ["shingle"], "members", spread=F.col("node"))
    of_node = W.partitionBy("node")
    # Shingles of one node alone come first and are left out; their number is known.
    place = F.col("n") - F.count(F.lit(1)).over(of_node) + F.row_number().over(of_node.orderBy("members", "shingle"))
    reach = F.col("n") - F.ceil(F.col("n") * LINK_OF_100 / 100) + 1
    return common.withColumn("place", place).filter(F.col("place") <= reach).drop("members")


def _near_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes in different components that may be similar enough, none of them left out."""
    rare = staged(_rare_shingles(nodes, sets), "rare-shingles")
    left = rare.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 2 * LINK_OF_100 / (100 + LINK_OF_100)) + 1).alias("x")
    right = rare.alias("y")
    x, y = ({c: F.col(f"{side}.{c}") for c in rare.columns} for side in "xy")
    smaller = (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["node"] < y["node"]))
    alike = 100 * x["n"] >= LINK_OF_100 * y["n"]
    room = F.least(x["n"] - x["place"], y["n"] - y["place"]) + 1
    fits = (100 + LINK_OF_100) * room >= LINK_OF_100 * (x["n"] + y["n"])
    met = left.join(right, (x["shingle"] == y["shingle"]) & smaller & alike & fits & (x["component"] != y["component"]))
    return met.select(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")).distinct()


def _connected(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of all classes that are linked with others."""
    found = components(_confirmed(_ordered(shared, "node", "star"), sets))
    fewer = _open_keys(shared, found, 1).filter("component != most")
    found = _joined(found, _confirmed(_ordered(fewer, "node", "star"), sets))
    still_open = _open_keys(shared, found, 0).select("node", "component").distinct()
    pairs = staged(_near_pairs(still_open, sets), "remaining")
    return _joined(found, _confirmed(pairs, sets))


def near_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = staged(texts.mapInArrow(sketch_batches, SKETCHES), "sketches")
    classes, shared = _shared(sketches)
    nodes = shared.select("node").distinct()
    # Classes that share no key need no set. A node's text is the one whose set it stands for.
    members = texts.join(nodes, texts["doc_id"] == nodes["node"]).select("node", "text")
    sets = staged(members.mapInArrow(set_batches, SETS), "sets")
    found = _connected(shared, sets)
    labelled = classes.join(found, "node", "left").select(
        "set_key", "copies", F.coalesce("component", "node").alias("of_class")
    )
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows = sketches.select("doc_id", "n_shingles", "set_key")
    joined = join_group_totals(rows.filter(linked), labelled, ["set_key"], "copies", spread=F.col("doc_id"))
    alone = rows.filter(~linked).withColumn("of_class", F.col("doc_id"))
    every = joined.select("doc_id", "n_shingles", "of_class").unionByName(alone.drop("set_key"))
    return every.select(
        "doc_id",
        "n_shingles",
        F.col("of_class").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("of_class")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with their own columns."""
    gone = near_components(docs).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = packed(docs, F.col("doc_id").cast("long").alias("_id"))
    return unpacked(rows.join(gone, rows["_id"] == gone["_gone"], "left_anti"))
