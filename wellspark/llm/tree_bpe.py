"""BPE with word ends: encoding by tree concatenation for text that is never split, and decoding.

Texts are cut at white space, which such a vocabulary drops; each distinct chunk is encoded once per worker and
remembered (:mod:`wellspark.llm.chunks`). A stretch without white space may be as long as the text. Beyond ``leaf``
characters it is prepared by the file's own normaliser and splitter, and what is still unsplit there becomes a tree:

1. its symbols are cut into leaves, which are rows of a table and are encoded in parallel, only the last one with the
   end-of-word mark;
2. neighbours are joined level by level. Around a join a window of tokens on both sides is encoded anew and doubled
   until its first token is the left side's old one at that place and its last token the right side's. Then every two
   neighbouring tokens of window and rest have been neighbours in the encoding of some stretch, and a BPE sequence in
   which no two neighbours would merge differently is the encoding of the whole, so the join is exact;
3. levels are written tables, so a lost executor costs one level at most.

``ids`` equal ``Tokenizer.encode(text, add_special_tokens=False)`` of the ``tokenizers`` library; strings of special
tokens in a text get their own ids, as the file says. Decoding gives what its ``decode(ids, skip_special_tokens=False)``
does for a file without a decoder: the tokens joined by spaces.

Edge cases: null and empty texts have no ids (an empty array) and decode to the empty text; null ids decode to null; an
id beyond the vocabulary raises; a null or repeated doc_id is carried and never used as a key; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm import chunks
from wellspark.session import materialize

LEAF = 1 << 15  # symbols of a leaf: some tens of milliseconds of encoding
WINDOW = 8  # tokens on each side of a join that are encoded anew at first
PARTS = "row long, doc_id long, part int, leaf int, leaves int, symbols string, ids array<int>"
NODES = "row long, doc_id long, part int, node int, last boolean, ids array<int>"


class WordEnds:
    """The vocabulary file: ids of chunks, and of stretches of symbols with or without the end of their word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between = next(iter(self.special), None)
        self.memory = chunks.Memory(self.learn)

    @cached_property
    def names(self) -> list[str]:
        return [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]

    @cached_property
    def models(self):
        """The file's model for stretches that do not end their word, and for those that do."""
        from tokenizers import Tokenizer, models

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        options = {"end_of_word_suffix": self.suffix} if self.suffix else {}
        return (Tokenizer(models.BPE(vocab=model["vocab"], merges=merges)),
                Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, **options)))

    def whole(self, text: str) -> np.ndarray:
        [found] = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)  # without offsets
        return np.array(found.ids, np.uint32)

    def learn(self, keys: pa.Array) -> pa.Array:
        """The unseen chunks as one text with a special token between them, by whose id the ids are told apart."""
        texts = keys.cast(pa.large_string()).to_pylist()
        found: list = [None] * len(texts)
        mark = self.between
        plain = [i for i, t in enumerate(texts) if mark and not any(s[0] in t for s in self.special)]
        if plain:
            ids = self.whole(mark.join([texts[i] for i in plain]))
            for i, part in zip(plain, np.split(ids, np.flatnonzero(ids == self.special[mark])), strict=True):
                found[i] = part[1:] if i != plain[0] else part
        found = [self.whole(t) if ids is None else ids for t, ids in zip(texts, found)]
        ends = np.concatenate([[0], np.cumsum([len(ids) for ids in found])])
        return chunks.binaries(np.concatenate([*found, np.zeros(0, np.uint32)]).view(np.uint8), 4 * ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = chunks.flat(texts)
        return chunks.encoded(data, offsets, chunks.after_spaces(data, offsets), self.memory)

    def words(self, text: str):
        """The pre-tokens of ``text`` as strings of symbols, and the ids of special tokens, in order."""
        every = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        for part in re.split(f"({every})", text) if every else [text]:
            if part in self.special:
                yield self.special[part]
            elif part:
                ready = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                yield from (word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(ready))

    def symbols(self, ids: list[int], last: bool) -> str:
        text = "".join(map(self.names.__getitem__, ids))
        return text.removesuffix(self.suffix) if last and self.suffix else text

    def stretch(self, symbols: str, last: bool) -> list[int]:
        """The ids of a stretch of symbols; ``last`` if a word ends with it."""
        [found] = self.models[last].encode_batch_fast([symbols], add_special_tokens=False)
        return found.ids

    def join(self, left: list[int], right: list[int], last: bool, window: int = WINDOW) -> list[int]:
        """The encoding of two neighbouring stretches from those of each; ``last`` if a word ends with the right one."""
        while True:
            a, b = left[-window:], right[:window]
            all_left, all_right = window >= len(left), window >= len(right)
            end = last and all_right
            found = self.stretch(self.symbols(a, False) + self.symbols(b, end), end)
            if (all_left or found[0] == a[0]) and (all_right or found[-1] == b[-1]):
                return left[: len(left) - len(a)] + found + right[len(b) :]
            window *= 2


def is_unsplit(text: Column, leaf: int) -> Column:
    """Whether a text has a stretch of ``leaf`` characters or more without ASCII white space."""
    stretches = F.transform(F.split(text, "[ \t\n\x0b\f\r]"), F.length)
    return F.when(F.length(text) >= leaf, F.array_max(stretches) >= leaf).otherwise(False)


def cut(rows: DataFrame, path: str, leaf: int) -> DataFrame:
    """The parts of each text in order: ids of what is encoded at once, and leaves of the unsplit rest."""

    def run(batches):
        codec = chunks.codec(WordEnds, path)
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part, rest, out = 0, [], []

                def done():
                    ids = codec.encode(pa.array([" ".join(rest)]))[0].tolist()
                    return (row, doc_id, part, 0, 1, None, ids)

                for stretch in re.split("[ \t\n\x0b\f\r]+", text):
                    if len(stretch) < leaf:
                        rest.append(stretch)
                        continue
                    out.append(done())
                    part, rest, ids = part + 1, [], []
                    for word in codec.words(stretch):
                        if isinstance(word, int):
                            ids.append(word)
                        elif len(word) < leaf:
                            ids += codec.stretch(word, True)
                        else:
                            out.append((row, doc_id, part, 0, 1, None, ids))
                            n = -(-len(word) // leaf)
                            out += [(row, doc_id, part + 1, k, n, word[k * leaf : (k + 1) * leaf], None)
                                    for k in range(n)]
                            part, ids = part + 2, []
                    out.append((row, doc_id, part, 0, 1, None, ids))
                    part += 1
                out.append(done())
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 [c.split()[0] for c in PARTS.split(", ")])

    return rows.mapInArrow(run, PARTS)


def concatenated(leaves: DataFrame, path: str, levels: int) -> DataFrame:
    """Encode leaves (PARTS with symbols) and join them level by level; NODES with node 0 only."""

    def encode_leaves(batches):
        codec = chunks.codec(WordEnds, path)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                last = row.column("leaf")[0].as_py() + 1 == row.column("leaves")[0].as_py()
                ids = codec.stretch(row.column("symbols")[0].as_py(), last)
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in ("row", "doc_id", "part", "leaf")), pa.array([last]),
                     pa.array([ids], pa.list_(pa.int32()))], ["row", "doc_id", "part", "node", "last", "ids"])

    def join_two(table: pa.Table) -> pa.Table:
        codec = chunks.codec(WordEnds, path)
        nodes = sorted(table.to_pylist(), key=lambda n: n["node"])
        node = nodes[0] if len(nodes) == 1 else nodes[0] | {
            "last": nodes[1]["last"], "ids": codec.join(nodes[0]["ids"], nodes[1]["ids"], nodes[1]["last"])}
        return pa.Table.from_pylist([node | {"node": node["node"] // 2}], schema=table.schema)

    spread = leaves.repartition("row", "part", "leaf")
    nodes = materialize(spread.mapInArrow(encode_leaves, NODES), "leaves")
    for _ in range(levels):
        pairs = nodes.groupBy("row", "part", F.expr("node div 2"))
        nodes = materialize(pairs.applyInArrow(join_two, NODES), "joined")
    return nodes


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (array of int). ``path``: a ``tokenizers`` file on every machine."""

    def run(batches):
        codec = chunks.codec(WordEnds, path)
        for ids, texts in chunks.slices(batches):
            yield pa.RecordBatch.from_arrays([ids, chunks.int_lists(*codec.encode(texts))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    unsplit = is_unsplit(F.col("text"), leaf)
    split = rows.where(~unsplit).mapInArrow(run, "doc_id long, ids array<int>")
    long = rows.where(unsplit).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    long = materialize(long, "unsplit")
    if long.isEmpty():
        return split
    parts = materialize(cut(long, path, leaf), "parts")
    width = parts.agg(F.max("leaves")).first()[0]
    nodes = concatenated(parts.where("symbols IS NOT NULL"), path, (width - 1).bit_length())
    pieces = parts.where("symbols IS NULL").select("row", "doc_id", "part", "ids").unionByName(
        nodes.select("row", "doc_id", "part", "ids"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "ids")))  # the parts of one text
    joined = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"),
                                       F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    return split.unionByName(joined.select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text."""

    def run(batches):
        names = pa.array(chunks.codec(WordEnds, path).names, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(1)
                tokens = names.take(lists.flatten())
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens), " ")
                texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts], ["doc_id", "ids", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")
