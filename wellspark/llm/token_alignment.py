"""Alignment of two tokenizers over a corpus: exact texts once, pair counts weighted by their copies.

1. Documents are grouped by their full text (counts are combined before the shuffle, so that a text with many copies is
   one row per task). Each distinct text is tokenized by both vocabularies and aligned once; a block of texts (a few
   megabytes, or one longer text) becomes one row of a written table: the texts' measures and SHA-256, the block's
   distinct id pairs with the number of documents that hold them linked, and each text's pairs by number.
2. Pair counts are a grouped sum over the blocks' pairs; a pair is one row of a block at most, so no key is hot. The
   counts go back to the blocks by joins on the pair and the block: nothing is broadcast.
3. Each block scores its texts against its own pairs' counts, and the measures meet the doc_ids by the text's SHA-256.
   Texts that hold over a thousandth of all documents (so a thousand of them at most) are joined by broadcast, the
   others by a shuffle.

Tokens of ``a`` (a byte-level file of ``tokenizers``) and ``b`` (a SentencePiece model file) are byte ranges of a space
and the text. The ends of both cut the bytes into elementary segments: each is the overlap of just one token of ``a``
with one of ``b``, that is one link, and ends that both share close a group.

Edge cases: null and empty texts, and texts that the joined bytes of either vocabulary do not give back, have no tokens:
zero measures and an empty ``groups``; null and repeated doc_ids keep their rows; strings of special tokens are plain
text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import chunks
from wellspark.session import materialize

MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
HOT_SHARE = 1000  # texts that more than one in so many documents hold are joined by broadcast
BLOCKS = pa.schema(
    [("block", pa.binary())] + [(c, pa.list_(t)) for c, t in (
        ("digest", pa.binary()), ("n_docs", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("n_pairs", pa.int32()),
        ("pair", pa.int32()), ("times", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()))])
BLOCK_TYPES = ("block binary, digest array<binary>, n_docs array<long>, n_a array<long>, n_b array<long>, n_groups "
               "array<long>, n_links array<long>, groups array<string>, n_pairs array<int>, pair array<int>, times "
               "array<int>, a array<int>, b array<int>, docs array<long>")


class Pieces:
    """Ids of chunks by a SentencePiece model whose pieces hold no space behind another character and no newline."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                         for i, p in ((i, model.id_to_piece(i)) for i in range(model.vocab_size()))]
        self.memory = chunks.Memory(self.learn)

    def learn(self, keys: pa.Array) -> pa.Array:
        texts = keys.cast(pa.large_string()).to_pylist()
        found = self.model.encode([t.removeprefix(" ") for t in texts], num_threads=1)
        for i, text in enumerate(texts):
            if not text.startswith(" "):  # the model put a space in front of a chunk that has none
                found[i] = found[i][1:]
        ends = np.concatenate([[0], np.cumsum([len(ids) for ids in found])])
        body = np.fromiter(chain.from_iterable(found), np.uint32, ends[-1])
        return chunks.binaries(body.view(np.uint8), 4 * ends)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = chunks.ByteLevel(path_a), Pieces(path_b)
        backward = byte_values()
        names = [self.a.tokenizer.id_to_token(i) or "" for i in range(len(self.a.n_bytes))]
        special = self.a.tokenizer.get_added_tokens_decoder()
        self.bytes_a = pa.array([n.encode() if i in special else bytes(map(backward.__getitem__, n))
                                 for i, n in enumerate(names)], pa.large_binary())
        self.bytes_b = pa.array(self.b.bytes_of, pa.large_binary())
        self.decimal = pa.array(list(map(str, range(max(len(self.bytes_a), len(self.bytes_b))))))

    def tokens(self, texts: pa.Array):
        """For both vocabularies the ids of all texts, their texts' offsets and each token's last byte's end."""
        data, offsets = chunks.flat(texts, " ")
        starts = chunks.before_separators(data, offsets)
        good, out = np.ones(len(texts), bool), []
        for codec, table in ((self.a, self.bytes_a), (self.b, self.bytes_b)):
            ids, at = chunks.encoded(data, offsets, starts, codec.memory)
            joined, ends = chunks.parts(table.take(pa.array(ids)))
            if not np.array_equal(joined, data):
                good &= [ends[at[i + 1]] - ends[at[i]] == offsets[i + 1] - offsets[i]
                         and np.array_equal(joined[ends[at[i]] : ends[at[i + 1]]], data[offsets[i] : offsets[i + 1]])
                         for i in range(len(texts))]
            out.append((ids, at, ends[1:]))
        return good, offsets, out

    def groups(self, ids: np.ndarray, last: np.ndarray) -> pa.Array:
        """The decimal ids of each group joined by commas; ``last`` are the places of the groups' last tokens."""
        ends = np.concatenate([[0], last + 1]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.decimal.take(pa.array(ids))), ",")

    def block(self, digests: pa.Array, texts: pa.Array, n_docs: np.ndarray, as_digest: bool) -> dict:
        good, offsets, found = self.tokens(texts)
        whole, n = good, len(texts)
        if not good.all():  # what is left aligns text by text
            kept = np.flatnonzero(good)
            good, offsets, found = self.tokens(texts.take(pa.array(kept)))
        else:
            kept = np.arange(n)
        (ids_a, at_a, ends_a), (ids_b, at_b, ends_b) = found
        marks = np.zeros(int(offsets[-1]) + 1, np.uint8)
        marks[ends_a] |= 1
        marks[ends_b] |= 2
        ends = np.flatnonzero(marks)  # of the elementary segments: one link each
        closes_a, closes_b = (marks[ends] & 1).astype(bool), (marks[ends] & 2).astype(bool)
        a, b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b  # the tokens a segment lies in
        both = closes_a & closes_b
        at_link = np.searchsorted(ends, offsets, "right")
        at_group = np.concatenate([[0], np.cumsum(both)])[at_link]
        strings = pc.binary_join_element_wise(self.groups(ids_a, a[both]), self.groups(ids_b, b[both]), "|")
        strings = pc.binary_join(pa.ListArray.from_arrays(pa.array(at_group.astype(np.int32)), strings), ";")
        if as_digest:
            strings = pa.array([hashlib.sha256(s.as_buffer()).hexdigest() for s in strings], pa.string())

        pairs = pa.array((ids_a[a].astype(np.int64) << 32) | ids_b[b]).dictionary_encode()
        code, width = pairs.dictionary.to_numpy(), max(1, len(pairs.dictionary))
        of_text = np.repeat(np.arange(len(kept)), np.diff(at_link))
        own, times = np.unique(of_text * width + pairs.indices.to_numpy(), return_counts=True)
        text, pair = own // width, own % width
        docs = np.bincount(pair, n_docs[kept][text], len(code)).astype(np.int64)

        def placed(values):
            out = np.zeros(n, np.int64)
            out[kept] = values
            return out

        texts_of = np.full(n, None, object)
        texts_of[kept] = strings.to_pylist()
        texts_of[~whole] = ""
        return {"block": digests[0].as_py(), "digest": digests, "n_docs": n_docs, "n_a": placed(np.diff(at_a)),
                "n_b": placed(np.diff(at_b)), "n_groups": placed(np.diff(at_group)),
                "n_links": placed(np.diff(at_link)), "groups": texts_of,
                "n_pairs": placed(np.bincount(text, minlength=len(kept))), "pair": pair, "times": times,
                "a": code >> 32, "b": code & 0xFFFFFFFF, "docs": docs}


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others
    in order from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def one_row(values: dict, schema: pa.Schema) -> pa.RecordBatch:
    def cell(value, kind):
        if not pa.types.is_list(kind):
            return pa.array([value], kind)
        flat = value.cast(kind.value_type) if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

    return pa.RecordBatch.from_arrays([cell(values[f.name], f.type) for f in schema], schema=schema)


def aligned_blocks(distinct: DataFrame, a: str, b: str, as_digest: bool) -> DataFrame:
    """(digest, text, n_docs), one row per distinct text that is not empty, as rows of blocks."""

    def run(batches):
        aligner = chunks.codec(Aligner, a, b)
        for batch in batches:
            numbers = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], ["no", "text"])
            for rows, texts in chunks.slices([numbers]):
                digests, n_docs = batch.column(0).take(rows), batch.column(2).take(rows).to_numpy()
                yield one_row(aligner.block(digests, texts, n_docs, as_digest), BLOCKS)

    return distinct.select("digest", "text", "n_docs").mapInArrow(run, BLOCK_TYPES)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best (whether n is the highest of its ``a``)."""
    pairs = blocks.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).select("p.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """digest, n_docs, groups and MEASURES per distinct text."""
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("pair_no", "p"))
    pairs = pairs.select("block", "pair_no", "p.a", "p.b").join(counts, ["a", "b"])
    known = pairs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair_no", "n", "best"))).alias("known"))
    known = known.select(F.col("block").alias("known_block"), F.col("known.n").alias("n"),
                         F.col("known.best").alias("best"))
    columns = ["digest", "n_docs", "n_a", "n_b", "n_groups", "n_links", "groups", "n_pairs", "pair", "times"]
    joined = blocks.join(known, F.col("block") == F.col("known_block"), "left").select(*columns, "n", "best")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in batch.schema.names}
                numbers = {c: row[c].to_numpy(zero_copy_only=False)
                           for c in ("n_pairs", "pair", "times", "n", "best") if row[c] is not None}
                text = np.repeat(np.arange(len(row["digest"])), numbers["n_pairs"])
                pair, times = numbers["pair"], numbers["times"].astype(np.int64)
                sums = np.zeros((2, len(row["digest"])), np.int64)
                if len(pair):
                    np.add.at(sums[0], text, times * numbers["best"][pair].astype(np.int64))
                    np.add.at(sums[1], text, times * numbers["n"][pair])
                keep = ["digest", "n_docs", "n_a", "n_b", "n_groups", "n_links"]
                yield pa.RecordBatch.from_arrays(
                    [*(row[c] for c in keep), pa.array(sums[0]), pa.array(sums[1]), row["groups"]],
                    [*keep, "n_best", "count_sum", "groups"])

    return joined.mapInArrow(run, "digest binary, n_docs long, n_a long, n_b long, n_groups long, n_links long, "
                                  "n_best long, count_sum long, groups string")


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text",
          groups_as_digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: decimal ids of both vocabularies by group, or with ``groups_as_digest`` the
    lowercase hex SHA-256 of that text, which keeps the written tables small.
    """
    text = F.when(F.length(text_col) > 0, F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    copies = rows.where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("n_docs"))
    distinct = copies.select(digest.alias("digest"), "text", "n_docs")
    blocks = materialize(aligned_blocks(distinct, a, b, groups_as_digest), "aligned")
    measures = materialize(scored(blocks, materialize(pair_counts(blocks), "pairs")), "scored")

    ids = materialize(rows.select("doc_id", digest.alias("digest")), "ids")
    hot = measures.where(F.col("n_docs") * HOT_SHARE > F.lit(ids.count()))
    hot = F.broadcast(hot.select("digest", F.lit(True).alias("hot"), *MEASURES, "groups"))
    marked = ids.where("digest IS NOT NULL").join(hot, "digest", "left")
    cold = marked.where("hot IS NULL").select("doc_id", "digest").join(
        measures.select("digest", *MEASURES, "groups"), "digest")
    none = ids.where("digest IS NULL").select(
        "doc_id", *(F.lit(0).cast("long").alias(m) for m in MEASURES), F.lit("").alias("groups"))
    out = ["doc_id", *MEASURES, "groups"]
    return marked.where("hot").select(*out).unionByName(cold.select(*out)).unionByName(none)
