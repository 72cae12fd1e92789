"""Token counts by greedy longest match, in time linear in the text, without building pieces.

The vocabulary is a trie over bytes and an end-of-word mark. Each node has a failure link: where matching goes on after
the longest pieces of the node's string are popped, and how many pieces that pops (Song et al. 2021, "Fast WordPiece
Tokenization"). A word's count is the sum of popped pieces along its walk. Each batch counts its distinct words once.

The vocabulary file is a public word-level BPE file: its pieces that end words carry a mark, and its letters stand for
bytes. Only its pieces are used here, not its merges: this is the greedy word-piece length, not the BPE length.

Defined cases: a null, empty or white-space text has no words and 0 tokens; a word that the vocabulary can't cover is
one unknown token; repeated rows are counted each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.shared import by_bytes, split_words

END = 256
#: The vocabulary's own splitting of lower-cased text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CACHE_ENTRIES = 500_000


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.child: list[dict[int, int]] = [{}]
        final = [False]
        parent, symbol = [0], [0]
        for piece in pieces:
            v = 0
            for s in piece:
                if s not in self.child[v]:
                    self.child[v][s] = len(self.child)
                    self.child.append({})
                    final.append(False)
                    parent.append(v)
                    symbol.append(s)
                v = self.child[v][s]
            final[v] = True
        n = len(self.child)
        self.fail, self.pops = [-1] * n, [0] * n  # -1: no way on
        level = list(self.child[0].values())
        while level:
            below: list[int] = []
            for v in level:
                if final[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    z, popped = self.fail[parent[v]], self.pops[parent[v]]
                    while z > 0 and symbol[v] not in self.child[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0 and parent[v] and symbol[v] in self.child[z]:
                        self.fail[v], self.pops[v] = self.child[z][symbol[v]], popped
                below += self.child[v].values()
            level = below
        self.known: dict[str, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of the word by greedy longest match, 1 if there is no such cover."""
        child, fail, pops = self.child, self.fail, self.pops
        v = total = 0
        for s in (*word, END):
            while s not in child[v]:
                if v == 0 or fail[v] < 0:
                    return 1
                total += pops[v]
                v = fail[v]
            v = child[v][s]
        while v:
            if fail[v] < 0:
                return 1
            total += pops[v]
            v = fail[v]
        return total

    def words(self, chunk: str) -> tuple[int, int]:
        """Words and tokens of a white-space separated chunk."""
        n = total = 0
        for w in WORD.findall(chunk.lower()):
            c = self.known.get(w)
            if c is None:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                c = self.known[w] = self.count(w.encode())
            n += 1
            total += c
        return n, total


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark, to_byte = model["end_of_word_suffix"], byte_letters()
    return Automaton([(*(to_byte[c] for c in p.removesuffix(mark)), *([END] if p.endswith(mark) else [])) for p in model["vocab"] if all(c in to_byte for c in p.removesuffix(mark))])


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = automaton(path)
        known: dict[bytes, tuple[int, int]] = {}
        for batch in by_bytes(batches, "text"):
            codes, distinct, offsets = split_words(batch.column("text"))
            if len(known) > CACHE_ENTRIES:
                known.clear()
            per = np.zeros((len(distinct) + 1, 2), np.int64)
            for i, chunk in enumerate(distinct):
                c = known.get(chunk)
                if c is None:
                    c = known[chunk] = of.words(chunk.decode())
                per[i] = c
            sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(per[codes], axis=0)])[offsets]
            n = np.diff(sums, axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and greedy word-pieces of each text: id, n_words, n_tokens. `vocabulary`: a file that every executor has."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_count(vocabulary), "id long, n_words long, n_tokens long")
