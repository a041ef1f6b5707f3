"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie whose words begin with a word mark.  Greedy
longest-match-first splitting of a word is one walk along its characters: where
the trie has no edge for the next character, the longest piece read so far and
those that must follow it are popped and the walk goes on at the failure link,
which spells what was read but not popped.  Since only the number of popped
pieces is stored per node, a word's length in pieces comes out without building
any piece, in time linear in its characters.

A word (run of characters other than white space) that cannot be split is one
unknown piece.  Counts of words that a worker has met are remembered.

Defined results: a null or empty text has no words and no tokens; rows equal in
all columns are counted each; very long words and texts are read whole; extra
columns are passed over; no rows give no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bazaar.llm.common import table

WORD_MARK = "▁"
#: Words a worker remembers at a time, and the longest of them.
REMEMBERED, LONGEST = 500_000, 48


class LongestMatch:
    """Automaton over a vocabulary: piece counts of greedy longest-match-first splits."""

    def __init__(self, vocabulary: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for ch in piece:
                to = self.edges[node].get(ch)
                if to is None:
                    to = self.edges[node][ch] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                node = to
            final[node] = node != 0
        # Failure link (-1: none) and number of pieces popped on the way, breadth first.
        self.fail, self.pops = [-1] * len(self.edges), [0] * len(self.edges)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for ch, child in self.edges[node].items():
                if final[child]:
                    self.fail[child], self.pops[child] = 0, 1
                else:
                    popped, z = self.pops[node], self.fail[node]
                    while z >= 0 and ch not in self.edges[z]:
                        popped, z = popped + self.pops[z], self.fail[z]
                    if z >= 0:
                        self.fail[child], self.pops[child] = self.edges[z][ch], popped
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of ``word``; 0 if it cannot be split."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = n = 0
        for ch in word:
            to = edges[node].get(ch)
            while to is None:
                n, node = n + pops[node], fail[node]
                if node < 0:
                    return 0
                to = edges[node].get(ch)
            node = to
        while node:
            n, node = n + pops[node], fail[node]
            if node < 0:
                return 0
        return n


def vocabulary(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece file (no control, unknown or byte pieces)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class _Counter:
    _by_path: dict[str, _Counter] = {}

    def __init__(self, path: str):
        self.match, self.known = LongestMatch(vocabulary(path)), {}

    @classmethod
    def of(cls, path: str) -> _Counter:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def text(self, text: str | None) -> tuple[int, int, int]:
        """(words, pieces, unknown words) of a text."""
        words = (text or "").split()
        known, count = self.known, self.match.count
        found = list(map(known.get, words))
        if None in found:
            if len(known) > REMEMBERED:
                known.clear()
            for i, n in enumerate(found):
                if n is None:
                    found[i] = n = count(WORD_MARK + words[i])
                    if len(words[i]) <= LONGEST:
                        known[words[i]] = n
        unknown = found.count(0)
        return len(words), sum(found) + unknown, unknown


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of each text under a vocabulary file."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter.of(path)
        for batch in batches:
            rows = [counter.text(x.as_py()) for x in batch.column("text")]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece length of every whole text of ``documents``."""
    return token_counts(table(spark, sf_dir, "documents"))
