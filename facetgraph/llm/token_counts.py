"""Word-piece counts by a linear longest-match automaton: a vocabulary trie with failure links.

Each trie node knows how many pieces are popped when it can't go on, and where the match resumes, so the greedy
longest-match count of a word takes time linear in its length and no piece is ever built.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import word_pattern

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_words", "n_tokens", "n_unknown")])
_automata: dict[tuple, PieceCounter] = {}


def load_pieces(path: str, marker: str = "▁") -> tuple[list[str], list[str]]:
    """Word-initial pieces (without the marker, which alone is '') and inner pieces of a sentencepiece vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    usual = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[len(marker) :] for p in usual if p.startswith(marker)], [p for p in usual if not p.startswith(marker)]


class PieceCounter:
    """Counts of greedy longest-match pieces of a word; a word that can't be spelt counts as one unknown.

    With '' among the initial pieces a word may start with the bare marker, a piece of its own, and go on with inner ones.
    """

    INITIAL, INNER = 0, 1  # the two roots

    def __init__(self, initial: list[str], inner: list[str], entries: int = 500_000):
        self.children: list[dict[str, int]] = [{}, {}]
        whole: list[bool] = [False, False]
        for root, pieces in ((self.INITIAL, initial), (self.INNER, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    below = self.children[node].get(c)
                    if below is None:
                        below = self.children[node][c] = len(self.children)
                        self.children.append({})
                        whole.append(False)
                    node = below
                whole[node] = True
        # fail[v]: the node from which the match goes on, -1 if it can't; popped[v]: pieces that are done by then
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        if whole[self.INITIAL]:
            self.fail[self.INITIAL], self.popped[self.INITIAL] = self.INNER, 1
        queue = deque([self.INITIAL, self.INNER])
        while queue:
            parent = queue.popleft()
            for c, node in self.children[parent].items():
                queue.append(node)
                if whole[node]:
                    self.fail[node], self.popped[node] = self.INNER, 1
                    continue
                z, pops = self.fail[parent], self.popped[parent]
                while z >= 0 and c not in self.children[z]:
                    pops += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.children[z][c], pops
        # rest[v]: pieces from v to the word's end, -1 if the word can't end here
        self.rest = [self._rest(v) for v in range(len(whole))]
        self.known: dict[str, int] = {}
        self.entries = entries

    def _rest(self, node: int) -> int:
        pops = 0
        while node != self.INNER:
            if self.fail[node] < 0:
                return -1
            pops += self.popped[node]
            node = self.fail[node]
        return pops

    def count(self, word: str) -> int:
        """Pieces of a non-empty word; -1 if it can't be spelt."""
        children, fail, popped = self.children, self.fail, self.popped
        node, pops = self.INITIAL, 0
        for c in word:
            below = children[node].get(c)
            while below is None:
                if fail[node] < 0:
                    return -1
                pops += popped[node]
                node = fail[node]
                below = children[node].get(c)
            node = below
        rest = self.rest[node]
        return -1 if rest < 0 else pops + rest

    def counts(self, words: list[str]) -> list[int]:
        """count() of each word, remembered; what is remembered is bounded."""
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            fresh = {w for w in words if w not in known}
            if len(known) + len(fresh) > self.entries:
                known.clear()
                fresh = set(words)
            count = self.count
            known.update((w, count(w)) for w in fresh)
            return [known[w] for w in words]


def count_tokens(docs: DataFrame, vocabulary_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each row: pieces of all words, an unspellable word being one token.

    Words are runs of non-blanks of the whole text, however long. Null and empty texts count 0; repeated rows and null
    ids pass through; other columns are not read; an empty table gives no rows. No shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary_path, os.getpid())
        if key not in _automata:
            _automata[key] = PieceCounter(*load_pieces(vocabulary_path))
        counter = _automata[key]
        for batch in batches:
            totals = []
            for value in batch.column(1).to_pylist():
                words = word_pattern.findall(value) if value else []
                counts = counter.counts(words)
                unknown = counts.count(-1)
                totals.append((len(words), sum(counts) + 2 * unknown, unknown))
            columns = list(zip(*totals, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=COUNTS.names)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, COUNTS)
