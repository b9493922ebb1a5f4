"""Token counts by a linear longest-match automaton, without building the pieces.

A trie over the vocabulary gets, per node, a failure link and the number of pieces that following it pops: if the walk
cannot go on from a node, its longest-match pieces are known in advance and the walk resumes at the node for what is
left. Every byte of a word is read once, so the count of greedy longest-match pieces takes time linear in the word,
whatever the longest piece is.

A word is a run of characters that ``str.split`` gives (white space separates and is not counted); its bytes follow a
leading space, as word-initial pieces of a byte-level vocabulary have one. A vocabulary that lacks some byte gives
``unknown`` = 1 piece for the whole word.

Edge cases: null and empty texts have 0 words and 0 tokens; ids (null, repeated) are carried along; extra columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import chunks

SLICE_BYTES = 8 << 20  # texts counted at once: the memory's look-up is made anew for each slice


class LongestMatch:
    """``count(word bytes)``: the number of pieces of greedy longest match, or None where a byte is in no piece."""

    def __init__(self, vocabulary: list[bytes]):
        self.child: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in vocabulary:
            v = 0
            for c in piece:
                nxt = self.child[v].get(c)
                if nxt is None:
                    nxt = self.child[v][c] = len(self.child)
                    self.child.append({})
                    whole.append(False)
                v = nxt
            whole[v] = True
        self.fail: list[int | None] = [None] * len(self.child)
        self.pops = [0] * len(self.child)
        level = [0]
        while level:  # breadth first: a link leads to a node that is less deep
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    below.append(v)
                    if whole[v]:
                        self.fail[v], self.pops[v] = 0, 1
                        continue
                    at, popped = self.fail[u], self.pops[u]
                    while at is not None and c not in self.child[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at is not None:
                        self.fail[v], self.pops[v] = self.child[at][c], popped
            level = below

    def count(self, word: bytes) -> int | None:
        child, fail, pops = self.child, self.fail, self.pops
        v = n = 0
        for c in word:
            while c not in child[v]:
                n += pops[v]
                v = fail[v]
                if v is None:
                    return None
            v = child[v][c]
        while v:
            n += pops[v]
            v = fail[v]
            if v is None:
                return None
        return n


class Counter:
    """Words and tokens of chunks by a rank file; a chunk may hold several words, as white space beyond ASCII splits."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.match = LongestMatch([base64.b64decode(line.split()[0]) for line in f])
        self.memory = chunks.Memory(self.learn)

    def learn(self, keys: pa.Array) -> pa.Array:
        found = np.zeros((len(keys), 2), np.uint32)
        for i, key in enumerate(keys.to_pylist()):
            words = key.decode().split()
            counts = [self.match.count(b" " + w.encode()) for w in words]
            found[i] = len(words), sum(1 if n is None else n for n in counts)
        return chunks.binaries(found.reshape(-1).view(np.uint8), 8 * np.arange(len(keys) + 1))

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words and the tokens of each text."""
        data, offsets = chunks.flat(texts)
        numbers, ends = chunks.encoded(data, offsets, chunks.after_spaces(data, offsets), self.memory)
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(numbers.reshape(-1, 2), axis=0, dtype=np.int64)])
        of_text = np.diff(sums[ends // 2], axis=0)
        return of_text[:, 0], of_text[:, 1]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens. ``vocabulary`` is the path of a rank file (base64 piece and rank per line)."""

    def run(batches):
        counter = chunks.codec(Counter, vocabulary)
        for ids, texts in chunks.slices(batches, SLICE_BYTES):
            n_words, n_tokens = counter.counts(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_tokens)],
                                             ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
