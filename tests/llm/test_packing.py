import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wellspark.llm import chunks, packing
from wellspark.llm.queries import op1_best_fit_packing

from .conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")  # what the ids are held against
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def bpe():
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return tok


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        bisect.insort(gaps, gaps.pop(i) - x if i < len(gaps) else capacity - x)
    return len(gaps)


def check_layout(rows, capacity):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("text", [
    "", "a b", " a", "a ", "a\n\nb", "a  b", "x\ty z", "it's a 'test 's", "<|endoftext|> hi\r\n there",
    "a b c　d", "½ x² y_z\n-- ok", "é x", " \n ", " 's  x", "a ́b", "日本 語\n😀 ok", "\n", "\na\nb",
    "x  y z\n\nw z\tq r \n s", "a \x1cb c", "\u0120 x \u010a\ny", "a\u0085b c\x0bd e "])
def test_ids_of_a_text_equal_the_tokenizer(text):
    want = np.array(bpe().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert chunks.ByteLevel(PATH).encode(pa.array([text]))[0].tobytes() == want


def test_query_against_the_tokenizer_and_the_layout(spark, texts):
    rows = op1_best_fit_packing(spark, SF).collect()
    tok, by_doc = bpe(), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p["start"] == at
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
        assert all(p["length"] == 1024 for p in pieces[1:])
    n = check_layout(rows, 1024)
    lengths = [r["length"] for r in rows]
    assert n <= 1.005 * best_fit_decreasing(lengths, 1024) + 1
    assert n >= -(-sum(lengths) // 1024)


def test_pieces_against_the_tokenizer_as_loaded(spark):
    texts = ["<|endoftext|>", "one <|endoftext|> two<|endoftext|>\nthree", "<|endoftext |> and < |endoftext|>", "one two\n",
             "word " * 1500 + "<|endoftext|>" + " word" * 1500, "x<|endoftext|><|endoftext|> \n y", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.token_pieces(docs, PATH, 1024, 2).collect()
    tok = Tokenizer.from_file(PATH)
    for doc, text in enumerate(texts):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())


@pytest.mark.parametrize("lengths", [[], [1], [10] * 7, [3] * 50, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10] * 9, [6, 4, 6, 4, 5]])
def test_pack_small_cases(spark, lengths):
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    out = packing.pack(spark.createDataFrame(rows, PIECES), 10).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(lengths)))
    assert check_layout(out, 10) <= best_fit_decreasing(lengths, 10) + 1


def test_pack_random_is_close_to_best_fit_decreasing(spark):
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 100), 7, 33]) for _ in range(3000)]
    rows = [(None if i % 50 == 0 else i // 2, 0, 0, n, 0) for i, n in enumerate(lengths)]
    out = packing.pack(spark.createDataFrame(rows, PIECES), 100).collect()
    assert sorted(r["length"] for r in out) == sorted(lengths)
    assert check_layout(out, 100) <= 1.01 * best_fit_decreasing(lengths, 100) + 1


def test_odd_rows(spark, odd):
    rows = packing.pack(packing.token_pieces(odd, PATH, 1024, 2), 1024).collect()
    check_layout(rows, 1024)
    assert sum(r["doc_id"] == 5 for r in rows) == 2
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == len(
        bpe().encode("word " * 30_000 + "end", add_special_tokens=False).ids) + 1
    assert packing.pack(packing.token_pieces(odd.limit(0), PATH), 1024).count() == 0
