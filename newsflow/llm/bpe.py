"""BPE encoding and decoding with a public tokenizer, by dynamic programming over prefixes.

Every prefix of a word's symbols has one encoding, so it has one last token. For each prefix the tokens that end
there come from a suffix automaton over the vocabulary, longest first; the one sought is the first that is
compatible with the last token of what stands before it, that is, merging the two tokens' symbols gives just these
two again. Following the last tokens back from the end gives the word's ids.

The tokenizer file names its parts (normalizer NFC, white space and lower case; split into words; bytes; merges with
an end-of-word mark; no decoder). A file of another build is refused. Null texts count as empty. Decoding joins the tokens
by blanks, which is what a file without a decoder asks for.

Words repeat, so each Python worker keeps the encodings of runs between blanks it met, up to a fixed number: their ids
alone, from which Arrow's kernels make the decoded texts.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = "\t-\r \x85\xa0  -     　"
# Fixed value: the split pattern of the tokenizer file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KEPT_RUNS = 300_000
KEPT_PAIRS = 400_000
OUTPUT_TOKENS = 250_000
END = "\n"  # stands for the end-of-word mark; no byte is written as this character
ID_BYTES = 4


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class SuffixAutomaton:
    """For each symbol read: the state whose string is the longest suffix read that begins some token."""

    def __init__(self, tokens: dict[str, int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, str], ...]] = [()]  # the tokens that end in the state with their lengths, longest first
        for token in tokens:
            state = 0
            for letter in token:
                if letter not in self.next[state]:
                    self.next[state][letter] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                state = self.next[state][letter]
            self.ends[state] = ((len(token), token),)
        self.fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            self.ends[state] += self.ends[self.fail[state]]
            for letter, child in self.next[state].items():
                queue.append(child)
                self.fail[child] = self.step(self.fail[state], letter)

    def step(self, state: int, letter: str) -> int:
        while (found := self.next[state].get(letter)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return found


class Tokenizer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        expected = (
            splits[0]["pattern"]["Regex"] == SPLIT
            and steps == ["NFC", "Replace", "Lowercase"]
            and spec["decoder"] is None
            and model["end_of_word_suffix"] == "</w>"
        )
        if not expected:
            raise ValueError(f"{path} is not built like the word tokenizer this operator reads")
        mark = model["end_of_word_suffix"]

        def own(token: str) -> str:
            return token[: -len(mark)] + END if token.endswith(mark) else token

        self.ids = {own(t): i for t, i in model["vocab"].items()}
        self.ranks = {(own(a), own(b)): r for r, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.shown = pa.array([shown.get(i) for i in range(max(shown) + 1)], pa.string())  # by id
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.words = regex.compile(SPLIT.replace(r"\s", SPACES))
        self.automaton = SuffixAutomaton({t: i for t, i in self.ids.items() if t != END})
        self.letters = byte_letters()
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.after: defaultdict[str, dict[str, bool]] = defaultdict(dict)  # whether a token may follow another
        self.pairs = 0
        self.known: dict[bytes, bytes] = {}

    def symbols(self, word: str) -> list[str]:
        """Letters of bytes; the last one carries the end mark."""
        return [*word[:-2], word[-2:]] if word.endswith(END) else [*word]

    def spines(self, token: str) -> tuple[list, list] | None:
        """Merge the token's own symbols, lowest rank first, the leftmost of equals.

        Returns the pieces that stood at its left and at its right edge on the way, each with the rank of the merge
        that ended it; None if the symbols do not end as this one token.
        """
        if token in self.edges:
            return self.edges[token]
        pieces, none = self.symbols(token), len(self.ranks)
        left, right = [], []
        while len(pieces) > 1:
            ranks = [self.ranks.get(p, none) for p in zip(pieces, pieces[1:], strict=False)]
            rank = min(ranks)
            if rank == none:
                break
            at = ranks.index(rank)
            if at == 0:
                left.append((pieces[0], rank))
            if at == len(pieces) - 2:
                right.append((pieces[-1], rank))
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        whole = (left + [(token, none)], right + [(token, none)]) if len(pieces) == 1 else None
        self.edges[token] = whole
        return whole

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens' symbols, merged together, give just these two.

        They do unless, at some time, the pieces on both sides of the border merge before either of them is
        merged into its own token. Of equal ranks the leftmost merge goes first. An empty left tests the right alone.
        """
        ends, starts = self.spines(left) if left else None, self.spines(right)
        if self.pairs >= KEPT_PAIRS:
            for row in self.after.values():
                row.clear()
            self.pairs = 0
        self.pairs += 1
        known = self.after[left]
        if starts is None or not left:
            known[right] = starts is not None
            return known[right]
        none, i, j = len(self.ranks), 0, 0
        (before, own), (after, other) = ends[1][0], starts[0][0]
        while True:
            across = self.ranks.get((before, after), none)
            if across < own and across <= other and across < none:
                known[right] = False
                return False
            if own == none and other == none:
                known[right] = True
                return True
            if own <= other:
                i += 1
                before, own = ends[1][i]
            else:
                j += 1
                after, other = starts[0][j]

    def last_tokens(self, word: str) -> list[str | None]:
        """The last token of every prefix of the word; a prefix that cuts the end mark off has none."""
        n, state = len(word), 0
        children, fail, ends, after = self.automaton.next, self.automaton.fail, self.automaton.ends, self.after
        last: list[str | None] = [None] * (n + 1)
        follows: list[dict[str, bool] | None] = [None] * (n + 1)  # what may follow the last token of each prefix
        last[0], follows[0] = "", after[""]
        for end, letter in enumerate(word, 1):
            while (found := children[state].get(letter)) is None and state:
                state = fail[state]
            state = found or 0
            if end == n - 1:
                continue  # the last letter and its mark are one symbol
            for length, token in ends[state]:
                row = follows[end - length]
                if row is None:
                    continue
                fits = row.get(token)
                if fits or fits is None and self.compatible(last[end - length], token):
                    last[end], follows[end] = token, after[token]
                    break
        return last

    def encode_word(self, word: str) -> list[str]:
        """Tokens of one word of letters with its end mark."""
        last, tokens, at = self.last_tokens(word), [], len(word)
        while at:
            token = last[at]
            if token is None:
                raise ValueError(f"no token ends {word[:at]!r}")
            tokens.append(token)
            at -= len(token)
        return tokens[::-1]

    def run(self, run: bytes) -> bytes:
        """The ids, as 32-bit integers, of a run without ASCII white space."""
        text, tokens = run.decode(), []
        # Letters alone are one word.
        for word in [text] if text.isascii() and text.isalpha() else self.words.findall(text):
            # Printable ASCII is written as itself.
            spelled = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            tokens += self.encode_word(spelled + END)
        if len(self.known) >= KEPT_RUNS:
            self.known.clear()
        found = self.known[run] = array("i", [self.ids[t] for t in tokens]).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text's runs and special tokens in order; no token spans white space."""
        if "<|" not in text:
            return self.plain(text)
        found, at = [], 0
        for special in self.cut.finditer(text):
            found.append(self.plain(text[at : special.start()]))
            found.append(np.int32(self.special[special.group()]).tobytes())
            at = special.end()
        return b"".join([*found, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            # The tokenizer lowers letter by letter; Python has one rule for a sigma that ends a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        known, run = self.known.get, self.run
        return b"".join([run(w) if (ids := known(w)) is None else ids for w in text.lower().encode().split()])


@cache
def load(path: str) -> Tokenizer:
    """One tokenizer per Python worker."""
    return Tokenizer(path)


def _arrays(encoded: list[bytes], shown: pa.StringArray) -> list[pa.Array]:
    """The ids of each text as a list, and the texts decoded from them."""
    offsets = pa.array(np.cumsum([0, *map(len, encoded)]) // ID_BYTES, pa.int32())
    ids = pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32), pa.int32())
    decoded = pa.compute.binary_join(pa.ListArray.from_arrays(offsets, shown.take(ids)), " ")
    return [pa.ListArray.from_arrays(offsets, ids), decoded]


def encode_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ids and decoded to each batch; sends it on in parts of about ``OUTPUT_TOKENS`` tokens."""
    tokenizer = load(path)
    for batch in batches:
        encoded, pending, first = [], 0, 0
        texts = batch.column(batch.schema.get_field_index("_text"))
        for at in range(batch.num_rows):
            ids = tokenizer.encode(texts[at].as_py())
            encoded.append(ids)
            pending += len(ids) // ID_BYTES
            if pending >= OUTPUT_TOKENS or at == batch.num_rows - 1:
                kept = batch.slice(first, len(encoded)).column(batch.schema.get_field_index("_row"))
                yield pa.RecordBatch.from_arrays([kept, *_arrays(encoded, tokenizer.shown)], names=["_row", "ids", "decoded"])
                encoded, pending, first = [], 0, at + 1


def encode(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None) -> DataFrame:
    """Each row in a struct ``_row``, of all columns or those in ``keep``, with its token ids and the text decoded from them."""
    kept = F.struct(*[docs[f"`{c}`"] for c in keep or docs.columns]).alias("_row")
    rows = docs.select(kept, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encode_batches(tokenizer_path, batches)

    return rows.mapInArrow(run, schema)


def encode_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    encoded = encode(docs, tokenizer_path, keep=["doc_id"])  # the text goes to Python once and does not come back
    return encoded.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
