"""Counts of word pieces by a linear longest-match automaton.

The vocabulary is a trie over bytes with two roots, one for the start of a word and one for what follows. Every node has
a failure link: after the pieces that a failed match pops, matching goes on from there without reading a byte twice. Only the
number of popped pieces is kept, so the count of greedy longest-match pieces comes without building a piece.

Vocabulary: tokens of a rank table with a leading space start a word, the others follow; single bytes are added to both, so
every word can be split. Words are runs of anything but white space.

Results: a null or blank text has 0 words and 0 pieces; rows are independent, so repeated rows, ties and null ids need no
treatment; a very long text or word is read whole, in time linear in its length; an empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import read_ranks
from pulsegrid.llm.common import doc_text, slices

REMEMBERED = 1 << 18
SCHEMA = "doc_id long, n_words long, n_pieces long"


def vocabulary_of(ranks: dict[bytes, int]) -> tuple[set[bytes], set[bytes]]:
    """Pieces that start a word and pieces that follow."""
    single = {bytes([b]) for b in range(256)}
    first = {t[1:] for t in ranks if t[:1] == b" " and len(t) > 1 and not t[1:].isspace()}
    return first | single, {t for t in ranks if not t[:1].isspace()} | single


class Automaton:
    """``child[node][byte]`` is the trie; ``link[node]`` and ``popped[node]`` say where a failed match goes on."""

    def __init__(self, first: set[bytes], follow: set[bytes]):
        self.child: list[dict[int, int]] = [{}, {}]  # node 0 starts a word, node 1 follows
        piece = [False, False]
        order = [(0, 0), (1, 0)]
        for root, pieces in ((0, first), (1, follow)):
            for p in sorted(pieces):
                at = root
                for i, b in enumerate(p):
                    if b not in self.child[at]:
                        self.child[at][b] = len(self.child)
                        self.child.append({})
                        piece.append(False)
                        order.append((len(self.child) - 1, i + 1))
                    at = self.child[at][b]
                piece[at] = True
        self.link, self.popped = [-1] * len(self.child), [0] * len(self.child)
        parent = {c: (n, b) for n, kids in enumerate(self.child) for b, c in kids.items()}
        for node, depth in sorted(order, key=lambda x: x[1]):
            if not depth:
                continue
            if piece[node]:
                self.link[node], self.popped[node] = 1, 1
                continue
            above, b = parent[node]
            at, pops = self.link[above], self.popped[above]
            while at > 0 and b not in self.child[at]:
                at, pops = self.link[at], pops + self.popped[at]
            if at > 0:
                self.link[node], self.popped[node] = self.child[at][b], pops

    def count(self, word: bytes) -> int:
        child, link, popped = self.child, self.link, self.popped
        at = n = 0
        for b in word:
            while (to := child[at].get(b)) is None:
                n += popped[at]
                at = link[at]
            at = to
        while at > 1:
            n += popped[at]
            at = link[at]
        return n


@functools.lru_cache(2)
def automaton(vocabulary: bytes) -> Automaton:
    return Automaton(*vocabulary_of(read_ranks(vocabulary)))


def count_pieces(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_pieces`` of each row; the vocabulary file is of fixed size and broadcast."""
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(shared.value)
        seen: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, 1 << 20):
                n_words, n_pieces = [], []
                if len(seen) > REMEMBERED:
                    seen.clear()
                for text in part.column("text").to_pylist():
                    words = text.encode().split()
                    for w in words:
                        if w not in seen:
                            seen[w] = own.count(w)
                    n_words.append(len(words))
                    n_pieces.append(sum([seen[w] for w in words]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())], ["doc_id", "n_words", "n_pieces"])

    return doc_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
