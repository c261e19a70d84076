"""The operators of this folder as named queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsflow.llm import (
    bpe,
    exact_dedup,
    fingerprints,
    importance,
    licenses,
    lm_scoring,
    mixing,
    near_dedup,
    phrases,
    quality,
    sharding,
    toxicity,
    warc,
)
from newsflow.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """The tokenizer file that ships with the tokenizer package; ``TOKENIZER_DIR`` names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, TOKENIZER)
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_report(documents(spark, sf_dir), tokenizer_path())


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(documents(spark, sf_dir))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def registry() -> dict[str, Query]:
    queries = (
        op1_mix_sources,
        op2_fingerprints,
        op3_toxicity,
        op4_exact_dedup,
        op5_sharding,
        op6_bpe,
        op7_licenses,
        op8_warc,
        op9_near_dedup,
        op10_lm_scoring,
        op11_importance,
        op12_quality,
        op13_phrases,
    )
    return {q.__name__: q for q in queries}


MIX = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk, 3 * source_size AS cap FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
l AS (
  SELECT *, cap::DOUBLE / weight AS per_weight,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS rate
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT arg_min(rate, (per_weight, rk)) FILTER (WHERE rate * weight <= cap) AS rate FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(q.rate * weight, cap::DOUBLE)) AS target FROM l, q),
k AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source
                           ORDER BY md5('mix-1' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
                           ROWS UNBOUNDED PRECEDING)::BIGINT AS running
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT k.*, n.copy, (n.copy * k.source_size + k.running)::DOUBLE / k.target AS finish
  FROM k, (SELECT unnest([0, 1, 2]) AS copy) n WHERE k.size > 0),
u AS (
  SELECT doc_id, count(*) AS copies FROM (
    SELECT doc_id, sum(size) OVER (ORDER BY finish, doc_id, source, size, copy ROWS UNBOUNDED PRECEDING) AS used FROM c)
  WHERE used <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT k.doc_id, k.size::BIGINT AS size, k.source_size, k.target, (k.size * coalesce(u.copies, 0))::BIGINT AS taken,
       CASE WHEN k.size = 0 THEN 1 ELSE coalesce(u.copies, 0) END::INTEGER AS copies
FROM k LEFT JOIN u ON k.doc_id = u.doc_id
"""

COPIES = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""

SHINGLES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)),
                                              lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM d WHERE len(w) > 0),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
c AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT c.node, e.b FROM c JOIN e ON c.other = e.a)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, m.least AS component_id, d.doc_id = m.least AS kept
FROM d LEFT JOIN s USING (doc_id) JOIN (SELECT node, min(other) AS least FROM c GROUP BY node) m ON d.doc_id = m.node
"""


RESAMPLED = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
t AS (
  SELECT doc_id, true AS ours, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
w AS (
  SELECT doc_id, ours,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM t),
f AS (SELECT doc_id, ours, unnest(words) AS word FROM w),
b AS (
  SELECT word, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(len(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)),
           lambda c, o: xor(c >> 8, steps[(xor(c, o) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM f), crc),
n AS (SELECT bucket, count(*) FILTER (WHERE ours) AS s, count(*) FILTER (WHERE NOT ours) AS t FROM f JOIN b USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain
  FROM n),
m AS (
  SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE ours GROUP BY doc_id),
r AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM w LEFT JOIN m USING (doc_id) WHERE ours),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS fit FROM r WHERE n_features >= 20)
SELECT r.*, CASE WHEN k.rank <= 10 * k.fit // 100 THEN k.rank END AS rank FROM r LEFT JOIN k USING (doc_id)
"""

COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE i + k - 1 <= len(words) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM g WHERE k >= 2 AND f >= 30),
u AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.cut], ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1:], ' ')),
s AS (
  SELECT lang, phrase, any_value(a) AS a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score
  FROM u GROUP BY lang, phrase),
o AS (
  SELECT lang, array_to_string(words[i:j], ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM c))
  WHERE j - i + 1 < k GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s LEFT JOIN o USING (lang, phrase) JOIN n USING (lang)
WHERE around IS NULL OR 100 * around::HUGEINT < 80 * a
QUALIFY rank <= 2000
"""


def statements() -> dict[str, str]:
    return {
        "op1_mix_sources": MIX,
        "op4_exact_dedup": COPIES,
        "op9_near_dedup": SHINGLES,
        "op11_importance": RESAMPLED,
        "op13_phrases": COLLOCATIONS,
    }
