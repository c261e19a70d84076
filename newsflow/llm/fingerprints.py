"""Document fingerprints by closed syncmers.

A text is a sequence of tokens (runs of non-space characters, cut after eight). A window of five tokens is a
closed syncmer if the smallest token hash in it stands at its first or last place. That depends on the window
alone, so the same passage yields the same anchors wherever it stands, and a fingerprint is the sequence of the
anchors' 32-bit hashes in text order, as hexadecimal words.

Two fingerprints are alike by their common anchors over all their anchors (Jaccard); two empty ones are equal.
A text with fewer than five tokens is one window; an empty or null text has an empty fingerprint.

``edited_texts`` pairs each document with the next one in descending order of ids. A single shuffle deals the
documents by bins of 1024 ids; the first document of each bin is sent to the bin before it as well. A null id
comes last; rows of one id are ordered by their text's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[^\s]{1,8}"
WINDOW = 5
BIN_BITS = 10
NO_ID = -(1 << 63)


def with_anchors(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds, for each (new column: text column), the hashes of the text's closed syncmers in text order.

    The token hashes are a column of their own, used twice below: written in place, they would be computed again
    for each window.
    """
    hashes = {
        f"_{new}": F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
        for new, text in texts.items()
    }

    def windows(own: str) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own) - WINDOW + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.slice(own, i, WINDOW))

    def closed(w: Column) -> Column:
        least = F.array_min(w)
        return (F.size(w) > 0) & ((F.get(w, F.lit(0)) == least) | (F.element_at(w, -1) == least))

    chosen = {
        new: F.transform(F.filter(windows(f"_{new}"), closed), lambda w: F.shiftrightunsigned(F.xxhash64(w), 32))
        for new in texts
    }
    return rows.withColumns(hashes).withColumns(chosen).drop(*hashes)


def fingerprint_text(anchor_hashes: Column) -> Column:
    return F.array_join(F.transform(anchor_hashes, lambda h: F.lower(F.hex(h))), " ")


def likeness(left: Column, right: Column) -> Column:
    """Common anchors over all anchors, 0 to 1."""
    common = F.size(F.array_intersect(left, right))
    every = F.size(F.array_union(left, right))
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def with_next_text(docs: DataFrame) -> DataFrame:
    """Adds ``next_text``: the text of the next document, descending doc_id, the first again after the last."""
    order = F.coalesce("doc_id", F.lit(NO_ID))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"order": order, "tie": F.xxhash64("text"), "bin": F.shiftright(order, BIN_BITS)}
    )
    first = F.max_by("text", F.struct("order", "tie"))
    heads = rows.groupBy("bin").agg(first.alias("head")).withColumn("group", F.shiftright("bin", BIN_BITS))
    # The bin to which a head belongs as next text is the next larger one: within its group of 1024 bins, or the
    # smallest bin of the next larger group; the largest bin's head closes the circle at the smallest bin.
    in_group = Window.partitionBy("group").orderBy("bin")
    ends = heads.groupBy("group").agg(F.min("bin").alias("smallest"))
    circle = Window.orderBy("group")
    ends = ends.select(
        "group",
        F.coalesce(F.lead("smallest").over(circle), F.first("smallest").over(circle)).alias("after"),
    )
    to = (
        heads.select("bin", "group", F.lead("bin").over(in_group).alias("larger"))
        .join(ends, "group")
        .select("bin", F.coalesce("larger", "after").alias("to"))
    )
    sent = to.join(heads, "bin").select(F.col("to").alias("bin"), F.col("head").alias("last_next"))
    own = Window.partitionBy("bin").orderBy(F.desc("order"), F.desc("tie"))
    within = rows.withColumn("own_next", F.lead("text").over(own))
    joined = within.join(sent, "bin", "left")
    return joined.select("doc_id", "text", F.coalesce("own_next", "last_next").alias("next_text"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """Adds n_chars, next_text and ``edited``: the last third replaced by the beginning of the next text."""
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third)
    taken = F.substring("next_text", F.lit(1), third)
    return (
        with_next_text(docs)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(kept, taken))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, the edited text's, and their likeness, also to the next document."""
    texts = {"own": "text", "changed": "edited", "following": "next_text"}
    anchored = with_anchors(edited_texts(docs), texts)
    anchored = anchored.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *texts)
    return anchored.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("own")).alias("fingerprint"),
        fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
