"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie of bytes. Every node has a failure link and the number of pieces that taking it pops
(leftmost-longest matching, as in Song et al., "Fast WordPiece Tokenization", 2021), so a word's number of pieces
comes from one pass over its bytes, without backtracking and without building a piece. Words are what stands
between ASCII white space, each read with a space before it, which is how the vocabulary marks word starts. A
worker remembers the counts of words.

Vocabularies are rank files (a base64 token and a number a line); the path is a parameter. A word with bytes that
no piece covers counts as one unknown piece.

Defined results: null and empty texts have no words and no pieces; very long texts and words are read whole; repeated
rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import as_bytes, pieces, released, table

#: Words remembered by a worker.
REMEMBERED = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class PieceCounter:
    """Counts the pieces of greedy longest-match for byte strings."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.next: dict[int, int] = {}
        ends, n = set(), 1
        for token in vocabulary:
            at = 0
            for b in token:
                key = at << 8 | b
                if key not in self.next:
                    self.next[key] = n
                    n += 1
                at = self.next[key]
            if at:
                ends.add(at)
        # fail: the node after popping, -1 if nothing can be popped; pops: how many pieces that takes.
        self.fail, self.pops = [-1] * n, [0] * n
        below: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, to in self.next.items():
            below[key >> 8].append((key & 255, to))
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in below[u]:
                queue.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                if u == 0:
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z != -1 and (z << 8 | b) not in self.next:
                    popped += self.pops[z]
                    z = self.fail[z] if z else -1
                if z != -1:
                    self.fail[v], self.pops[v] = self.next[z << 8 | b], popped
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of a word; an unknown word is one piece."""
        step, fail, pops = self.next.get, self.fail, self.pops
        u = n = 0
        for b in word:
            while (v := step(u << 8 | b)) is None:
                if u == 0 or fail[u] == -1:
                    return 1
                n += pops[u]
                u = fail[u]
            u = v
        while u:
            if fail[u] == -1:
                return 1
            n += pops[u]
            u = fail[u]
        return n

    def counts(self, words: list[bytes]) -> int:
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[w] = self.count(b" " + w)
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(read_ranks(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of each document's whole text."""
    path = path or default_vocabulary()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in pieces(batch, 1):
                split = [x.split() for x in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, split), pa.int64()), pa.array(map(counter.counts, split), pa.int64())],
                    ["doc_id", "n_words", "n_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
