"""Toxicity scores by a lexicon, Levenshtein automata and context windows.

Fitting uses at most ``SAMPLE`` labelled documents of each class, the first by a hash of their ids (a bound on the
fit alone). Terms are words and word beginnings that stand in one percent or more of the toxic documents and are at
least 20 times as frequent there as in the others, and six times at the lower end of the ratio's 95 percent interval.
A term counts once for each word that stands before it, so that near copies of one document do not make its words
telling. Of a word and its beginnings the longest that keeps 95 percent of the documents is taken. Terms that are only four times
as frequent (twice at the lower end) are weak terms: harmless once, telling when they pile up. A logistic regression over the counts of hits gives the score.

The terms form a trie. Its intersection with the Levenshtein automata of the words read is built state by state as
texts ask for it: a state is the set of (trie node, edits so far), so one walk along a word's letters finds every term
within its number of edits: none below five letters, one below nine, two from there on; one less for beginnings.
Words of the labelled clean documents that come near a term are known to be harmless.

A hit counts by its window: it is a quotation if it stands between quotation marks or a word of reporting comes
shortly before it, unless the window addresses somebody; otherwise it is abuse. Exact abuse, misspelled abuse,
quotations and weak terms (by number and by share of the text) are separate counts.

Null and empty texts have no hits and get the score of such a text. Without labels of both classes the lexicon is
empty and every score is the share of toxic labels. A document with several labels is toxic if one of them says so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import is_in_fold, packed

FOLDS, HELD_OUT = 3, 1
SAMPLE = 20_000
THRESHOLD = 0.7
LEAST_DOCUMENTS, KEPT_SHARE = 3, 0.95
STRONG, WEAK = (0.01, 20.0, 6.0), (0.03, 4.0, 2.0)  # share of the toxic documents, ratio, its lower end
BEGINNINGS = (4, 5, 6, 7)
MOST_CANDIDATES, MOST_HARMLESS = 50_000, 50_000
WINDOW, REPORT_WINDOW = 6, 4
KEPT_WORDS, KEPT_STATES = 150_000, 30_000
RIDGE = 0.01
WORD = re.compile(r"[^\W_]+(?:[@$*!]+[^\W_]+)*")
ADDRESS = frozenset("you your youre u ur du dich dir dein euch ihr tu te toi vous votre vos tú usted ustedes".split())
REPORT = frozenset(
    "said says called calls word words term terms quote quoted wrote slur insult sagte schrieb nannte wort dit écrit mot "
    "appelle dijo escribió palabra llamó".split()
)
QUOTES = '"“”„«»'


WEAK_TERM = 9  # in the place of a number of edits


def allowed_edits(term: str, beginning: bool) -> int:
    return max(0, (len(term) >= 5) + (len(term) >= 9) - beginning)


class Lexicon:
    """Terms in a trie, intersected with the Levenshtein automata of the words that are looked up."""

    def __init__(
        self, terms: list[tuple[str, bool]], harmless: frozenset[str] = frozenset(), weak: list[tuple[str, bool]] = ()
    ) -> None:
        self.harmless = harmless
        self.weak_words = frozenset(t for t, beginning in weak if not beginning)
        self.weak_beginnings = tuple(t for t, beginning in weak if beginning)
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}  # node: edits that its word allows
        self.begin: dict[int, int] = {}
        self.most = [0]  # edits that some term below the node allows
        for term, beginning in terms:
            node, edits = 0, allowed_edits(term, beginning)
            self.most[0] = max(self.most[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], edits)
            (self.begin if beginning else self.whole)[node] = edits
        self.words: dict[str, int | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """Letters of a term may be left out; of equal nodes the fewest edits remain."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            if edits > self.most[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def _step(self, state: int, letter: str) -> int:
        reached = set()
        for node, edits in self.states[state]:
            reached.add((node, edits + 1))
            for own, child in self.children[node].items():
                reached.add((child, edits + (own != letter)))
        found = self.steps[state, letter] = self._number(self._closed(reached))
        return found

    def _edits(self, state: int, ends: dict[int, int]) -> int | None:
        return min((e for node, e in self.states[state] if e <= ends.get(node, -1)), default=None)

    def edits(self, word: str) -> int | None:
        """The fewest edits that make the word, or its beginning, a term; ``WEAK_TERM``; None if no term is near."""
        if word in self.words:
            return self.words[word]
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        if len(self.states) >= KEPT_STATES:
            self._forget()
        state, best = self.start, None
        for letter in word:
            to = self.steps.get((state, letter))
            state = self._step(state, letter) if to is None else to
            if not self.states[state]:
                break
            if self.begin and (found := self._edits(state, self.begin)) is not None:
                best = found if best is None else min(best, found)
        else:
            if (found := self._edits(state, self.whole)) is not None:
                best = found if best is None else min(best, found)
        if best and word in self.harmless:
            best = None
        if best is None and (word in self.weak_words or word.startswith(self.weak_beginnings)):
            best = WEAK_TERM
        self.words[word] = best
        return best


def _quoted(text: str, at: int) -> bool:
    """Whether the place stands between quotation marks on its line."""
    line = text[text.rfind("\n", 0, at) + 1 : at]
    rest = text[at : (text.find("\n", at) + 1 or len(text) + 1) - 1]
    opened = sum(line.count(q) for q in '"“”„') % 2 == 1 or line.count("«") > line.count("»")
    return opened and any(q in rest for q in QUOTES)


def hit_counts(lexicon: Lexicon, text: str) -> tuple[int, int, int, int, int]:
    """Exact abuse, misspelled abuse, quotations, distinct weak words, and these for 10,000 words."""
    text = text.lower()
    words = WORD.findall(text)
    missing, known, look = -1, lexicon.words.get, lexicon.edits
    hits = [
        (i, edits)
        for i, w in enumerate(words)
        if (edits := known(w, missing)) is not None and (edits != missing or (edits := look(w)) is not None)
    ]
    if not hits:
        return 0, 0, 0, 0, 0
    places = [m.start() for m in WORD.finditer(text)]
    counts = [0, 0, 0, 0]
    weak = set()
    for i, edits in hits:
        window = words[max(0, i - WINDOW) : i + WINDOW + 1]
        reported = not REPORT.isdisjoint(words[max(0, i - REPORT_WINDOW) : i])
        quotation = (reported or _quoted(text, places[i])) and ADDRESS.isdisjoint(window)
        if edits == WEAK_TERM:
            weak.add(words[i])
        else:
            counts[2 if quotation else min(edits, 1)] += 1
    return counts[0], counts[1], counts[2], len(weak), 10_000 * len(weak) // (20 + len(words))


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    harmless: frozenset[str]
    weak: list[tuple[str, bool]]
    weights: list[float]  # constant, and one for each of the features
    _lexicon: Lexicon | None = field(default=None, repr=False)

    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.terms, self.harmless, self.weak)
        return self._lexicon

    def score(self, text: str | None) -> float:
        counts = hit_counts(self.lexicon(), text or "")
        row = features(np.array([counts], dtype=float))[0] if any(counts) else []
        total = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], row, strict=False))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, total))))


def _term_counts(batches, wanted: frozenset[str] | None):
    """In how many texts of a batch each word (w:...) and word beginning (b:...) stands."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(0):
            words = set(WORD.findall((text.as_py() or "").lower()))
            terms = {f"w:{w}" for w in words} | {f"b:{w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}
            counts.update(terms if wanted is None else terms & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])


def _term_contexts(batches, wanted: frozenset[str]):
    """Wanted terms with a number of the word before them, once for each in a batch."""
    for batch in batches:
        found = set()
        for text in batch.column(0):
            words = ["", *WORD.findall((text.as_py() or "").lower())]
            for before, word in pairwise(words):
                for term in (f"w:{word}", *(f"b:{word[:n]}" for n in BEGINNINGS if len(word) >= n)):
                    if term in wanted:
                        found.add((term, before))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["term", "before"])


def _near_words(batches, lexicon: Lexicon):
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(0):
            counts.update(w for w in set(WORD.findall((text.as_py() or "").lower())) if lexicon.edits(w) in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])


def _hit_rows(batches, lexicon: Lexicon):
    for batch in batches:
        counts = [hit_counts(lexicon, t.as_py() or "") for t in batch.column(0)]
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["toxic", "exact", "near", "quoted", "weak", "dense"])


def log_ratio(n: int, others: int, n_toxic: int, n_clean: int) -> tuple[float, float]:
    """Logarithm of how much more frequent a term is in toxic documents, and its lower end."""
    ratio = math.log((n + 0.5) / (n_toxic + 1)) - math.log((others + 0.5) / (n_clean + 1))
    return ratio, ratio - 2 * math.sqrt(1 / (n + 0.5) + 1 / (others + 0.5))


def telling_terms(
    toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: tuple[float, float, float]
) -> dict[str, int]:
    """The terms frequent enough in toxic documents, and ``least`` (share, ratio, ratio at the lower end) against the others."""
    found = {}
    for term, n in toxic.items():
        ratio, sure = log_ratio(n, clean.get(term, 0), n_toxic, n_clean)
        often = n >= max(LEAST_DOCUMENTS, least[0] * n_toxic)
        if often and ratio >= math.log(least[1]) and sure >= math.log(least[2]):
            found[term] = n
    return found


def without_variants(strong: dict[str, int], weak: dict[str, int]) -> dict[str, int]:
    """Strong terms but for those that are one form among several of a weak beginning."""
    return {
        term: n
        for term, n in strong.items()
        if not any(weak.get(f"b:{term[2 : 2 + i]}", 0) >= 2 * n for i in BEGINNINGS if i < len(term) - 2)
    }


def choose_terms(telling: dict[str, int]) -> list[tuple[str, bool]]:
    """Words and beginnings without needless ones, as (text, is a beginning)."""
    # A term gives way to a longer one, or a whole word, that stands in nearly as many documents.
    rank = {t: (len(t), t.startswith("w:")) for t in telling}
    chosen: list[str] = []
    for term in sorted(telling, key=lambda t: rank[t], reverse=True):
        rivals = [c for c in chosen if c[2:].startswith(term[2:])]
        if any(telling[c] >= KEPT_SHARE * telling[term] for c in rivals):
            continue
        if term.startswith("b:"):
            # A beginning that tells more than the longer terms below it stands for them.
            chosen = [c for c in chosen if c not in rivals or c.startswith("w:") and telling[c] >= KEPT_SHARE * telling[term]]
        chosen.append(term)
    return sorted((c[2:], c.startswith("b:")) for c in chosen)


def features(counts: np.ndarray) -> np.ndarray:
    """Whether there is exact abuse, and the logarithms of all counts."""
    return np.column_stack((counts[:, 0] > 0, np.log1p(counts)))


def regression(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton's method; the constant is not shrunk."""
    x = np.column_stack((np.ones(len(y)), x))
    weights, ridge = np.zeros(x.shape[1]), np.array([1e-6] + [RIDGE] * (x.shape[1] - 1))
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - chance) - ridge * weights
        curve = (x * (chance * (1 - chance))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return weights.tolist()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents outside the held-out fold."""
    known = (
        labels.filter("doc_id is not null and toxic is not null").filter(~is_in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    taken = [known.filter(F.col("toxic") == c).orderBy(*order).limit(sample) for c in (1, 0)]
    chosen = F.broadcast(taken[0].unionByName(taken[1]))  # at most twice ``sample`` rows
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"))
    counted = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = counted.get(1, 0), counted.get(0, 0)
    if not n_toxic or not n_clean:
        return Model([], frozenset(), [], [math.log((n_toxic + 0.5) / (n_clean + 0.5)), *[0.0] * 6])

    def totals(rows: DataFrame, function, most: int, least: float = 1) -> dict[str, int]:
        sums = rows.mapInArrow(function, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        top = sums.filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(most)
        return {r["term"]: r["n"] for r in top.collect()}

    toxic_texts, clean_texts = texts.filter("toxic = 1"), texts.filter("toxic = 0")
    in_toxic = totals(toxic_texts, lambda b: _term_counts(b, None), MOST_CANDIDATES, max(LEAST_DOCUMENTS, STRONG[0] * n_toxic))
    wanted = frozenset(in_toxic)
    in_clean = totals(clean_texts, lambda b: _term_counts(b, wanted), MOST_CANDIDATES)
    often = frozenset(telling_terms(in_toxic, in_clean, n_toxic, n_clean, (STRONG[0], *WEAK[1:])))
    contexts = toxic_texts.mapInArrow(lambda b: _term_contexts(b, often), "term string, before string")
    counted_once = contexts.groupBy("term").agg(F.count_distinct("before").alias("n")).collect()  # one row per term
    apart = {r["term"]: min(r["n"], in_toxic[r["term"]]) for r in counted_once}
    weak_terms = telling_terms(apart, in_clean, n_toxic, n_clean, WEAK)
    strong_terms = telling_terms(apart, in_clean, n_toxic, n_clean, STRONG)
    weak = choose_terms(weak_terms)
    terms = choose_terms(without_variants(strong_terms, weak_terms))
    near = totals(clean_texts, lambda b: _near_words(b, Lexicon(terms)), MOST_HARMLESS)
    harmless = frozenset(near)
    counts = texts.mapInArrow(
        lambda b: _hit_rows(b, Lexicon(terms, harmless, weak)), "toxic long, exact long, near long, quoted long, weak long, dense long"
    ).toPandas()  # at most twice ``sample`` rows of six numbers
    wanted_counts = counts[["exact", "near", "quoted", "weak", "dense"]].to_numpy(dtype=float)
    weights = regression(features(wanted_counts), counts["toxic"].to_numpy(dtype=float))
    return Model(terms, harmless, weak, weights)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Each row in a struct ``_row`` with its score and ``predicted``."""
    rows, place = packed(docs), docs.columns.index("text")
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, score double"

    def run(batches):
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(0).field(place)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["_row", "score"])

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score_texts(docs.select("doc_id", "text"), fit(docs, labels)).withColumn("doc_id", F.col("_row.doc_id"))
    return scored.select("doc_id", is_in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not found toxic, with their own columns."""
    return score_texts(docs, fit(docs, labels)).filter("predicted = 0").select("_row.*")
