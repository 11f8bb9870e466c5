"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie.  Each node carries a failure link and the number of
pieces that taking the link pops, so a word's greedy longest-match length comes
from one pass over its bytes and no piece is ever built.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a word's last
byte is the vocabulary's word-end form of that byte.  Null or empty text: 0
tokens.  A word that the vocabulary cannot spell counts as one token.  Repeated
rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bpe import Memo, as_word, word_end_vocabulary
from ._common import frugal, small_batches

_automata: dict[str, LongestMatch] = {}


class LongestMatch:
    def __init__(self, tokens):
        self.goto: list[dict[str, int]] = [{}]
        ends = [False]
        for t in tokens:
            at = 0
            for c in t or "":
                nxt = self.goto[at].get(c)
                if nxt is None:
                    nxt = self.goto[at][c] = len(self.goto)
                    self.goto.append({})
                    ends.append(False)
                at = nxt
            if t:
                ends[at] = True
        n = len(self.goto)
        #: Failure link (-1: the word cannot be spelt) and pieces popped by taking it.
        self.link, self.popped = [-1] * n, [0] * n
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.goto[u].items():
                    below.append(v)
                    if ends[v]:
                        self.link[v], self.popped[v] = 0, 1
                        continue
                    z, k = self.link[u], self.popped[u]
                    while z >= 0 and c not in self.goto[z]:
                        k += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.goto[z][c], k
            level = below

    def count(self, word: str) -> int:
        at = total = 0
        for c in word:
            while c not in self.goto[at]:
                if self.link[at] < 0:
                    return 1
                total += self.popped[at]
                at = self.link[at]
            at = self.goto[at][c]
        while at:
            if self.link[at] < 0:
                return 1
            total += self.popped[at]
            at = self.link[at]
        return total


def automaton(path: str) -> LongestMatch:
    if path not in _automata:
        _automata[path] = LongestMatch(word_end_vocabulary(path)[0])
    return _automata[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    small_batches(docs.sparkSession)

    def run(batches):
        own = automaton(path)
        known = Memo(lambda w: own.count(as_word(w)))
        for b in batches:
            words = [(t or "").encode().lower().split() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(map(len, words), pa.int64()), pa.array([sum(map(known.__getitem__, w)) for w in words], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, n_words long, n_tokens long")
