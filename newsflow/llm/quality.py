"""Quality scores by compression: texts are measured with two zstandard dictionaries.

One dictionary is trained on good, the other on bad labelled text. A text is cut into windows of ``WINDOW`` bytes, and all
of them are compressed with either dictionary. The difference of the two sizes in all, over the larger one, tells which
kind of text it is like; the least difference of a window tells of a bad part in a good text. The share of its size that is
left tells text that repeats itself, which every dictionary packs alike. A logistic regression turns the three into a
probability. It is fitted on labelled documents that the dictionaries have not seen.

The fit takes at most ``SAMPLE`` documents and, for the dictionaries, ``WINDOWS`` windows of either label, the first by a
hash of their ids (a bound on the fit alone). Documents with an even hash train the dictionaries, the others calibrate.

Null and empty texts have no bytes, difference 0 and the share 1. If one label has fewer than ``LEAST`` windows, every score is
the share of good labels. A document with several labels is good if all say so. Labels without a document are left out.
Repeated rows get equal scores, and clashing columns come back from a struct. Very long texts are read whole, one window
after the other. The lengths of the windows alone are kept, so a text needs little more memory than its own bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import is_in_fold, packed
from newsflow.llm.toxicity import regression

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SAMPLE, WINDOWS, LEAST = 4_000, 4_096, 8
WINDOW, LEVEL = 2048, 3
DICTIONARY_BYTES, SEGMENT, LETTERS = 112_640, 128, 8  # size; parameters k and d of the dictionary's builder
POOR = 0.2  # a text packed below this share repeats itself
SHORTEST = 64  # bytes of a window worth training on


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from windows. What is too little for the builder serves as it is."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=LETTERS, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def windows_of(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]


class Packer:
    """The two compressors of one task."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by = [self.compressor(d) for d in (good, bad)]

    @staticmethod
    def compressor(data: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(data)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False
        )

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Difference of the sizes, its least value in a window, share left, and that share up to ``POOR``."""
        windows = windows_of(text)
        if not windows:
            return 0.0, 0.0, 1.0, POOR
        good, bad = (np.array([len(c.compress(w)) for w in windows]) for c in self.by)
        most = max(good.sum(), bad.sum())
        left = good.sum() / sum(map(len, windows))
        return (bad.sum() - good.sum()) / most, float(((bad - good) / np.maximum(good, bad)).min()), left, min(left, POOR)


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    middle: list[float]
    spread: list[float]
    weights: list[float]  # the constant first

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.good:
            return np.full(len(features), 1 / (1 + math.exp(-self.weights[0])))
        sums = self.weights[0] + ((features - self.middle) / self.spread) @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def _measured(batches: Iterator[pa.RecordBatch], good: bytes, bad: bytes, keep: str) -> Iterator[pa.RecordBatch]:
    packer = Packer(good, bad) if good else None
    for batch in batches:
        rows = [packer.features(t.as_py()) if packer else (0.0,) * 4 for t in batch.column("_text")]
        columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(keep), *columns], names=[keep, "all", "least", "left", "poor"])


MEASURES = "all double, least double, left double, poor double"


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Model:
    """Learn from the labelled documents outside the held-out fold."""
    known = (
        labels.filter("doc_id is not null and quality is not null").filter(~is_in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .withColumn("_hash", F.xxhash64("doc_id"))
    )
    order = ["_hash", "doc_id"]
    taken = [known.filter(F.col("quality") == q).orderBy(*order).limit(sample) for q in (1, 0)]
    chosen = F.broadcast(taken[0].unionByName(taken[1]))  # at most twice ``sample`` rows
    texts = docs.select("doc_id", F.col("text").alias("_text")).join(chosen, "doc_id")
    counted = {r["quality"]: r["count"] for r in texts.groupBy("quality").count().collect()}
    share = math.log((counted.get(1, 0) + 0.5) / (counted.get(0, 0) + 0.5))

    cut = texts.filter("_hash % 2 = 0").select("quality", "doc_id", F.col("_text").cast("binary").alias("_bytes"))
    starts = F.sequence(F.lit(0), F.octet_length("_bytes") - 1, F.lit(WINDOW))
    each = cut.filter(F.octet_length("_bytes") > 0).select("*", F.explode(starts).alias("_at"))
    pieces = each.withColumn("_window", F.substring("_bytes", F.col("_at") + 1, F.lit(WINDOW))).drop("_bytes")
    pieces = pieces.filter(F.octet_length("_window") >= SHORTEST).dropDuplicates(["quality", "_window"])
    first = [F.xxhash64("doc_id", "_at"), "doc_id", "_at", "_window"]
    samples = {
        q: [bytes(r["_window"]) for r in pieces.filter(F.col("quality") == q).orderBy(*first).limit(windows).collect()]
        for q in (1, 0)
    }  # at most ``windows`` of WINDOW bytes
    if min(map(len, samples.values())) < LEAST:
        return Model(b"", b"", [], [], [share])
    good, bad = dictionary(samples[1]), dictionary(samples[0])
    rest = texts.filter("_hash % 2 <> 0").select("_text", "quality").mapInArrow(
        lambda b: _measured(b, good, bad, "quality"), f"quality int, {MEASURES}"
    )
    found = rest.toPandas()  # at most twice ``sample`` rows of five numbers
    if found["quality"].nunique() < 2:
        return Model(b"", b"", [], [], [share])
    found = found.sort_values(list(found.columns))  # in one order, so that sums agree between runs
    x, y = found[["all", "least", "left", "poor"]].to_numpy(), found["quality"].to_numpy(dtype=float)
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(good, bad, middle.tolist(), spread.tolist(), regression((x - middle) / spread, y))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Each row in a struct ``_row`` with its score and ``predicted``."""
    rows = packed(docs, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _measured(batches, model.good, model.bad, "_row"):
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            scores = model.score(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["_row", "score"])

    scored = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are found good, with their own columns."""
    return score_texts(docs, fit(docs, labels)).filter("predicted = 1").select("_row.*")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score_texts(docs.select("doc_id", "text"), fit(docs, labels)).withColumn("doc_id", F.col("_row.doc_id"))
    return scored.select("doc_id", is_in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", "predicted")
