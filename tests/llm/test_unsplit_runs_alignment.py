"""Tree concatenation, periodic runs and token alignment against plain versions of the same definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from wellspark.llm import chunks, periodic_runs, token_alignment, tree_bpe
from wellspark.llm.queries import op11_tree_bpe, op12_periodic_runs, op13_token_alignment

from .conftest import LONG, SF

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*" \n\t\r\x0b\x1c 　 \u0085ab'sé日1.!́▁—İ\0", "  ", "\n\n", "<|endoftext|>", "<s>", "<0x41>", "'re"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    return sorted({"".join(rng.choices(ALPHABET, k=rng.randrange(25))) for _ in range(20_000)})


# ---- chunks ------------------------------------------------------------------------------------------------------

def test_chunk_ids_equal_the_library(odd_texts):
    from tokenizers import Tokenizer

    for as_loaded in (True, False):
        plain = Tokenizer.from_file(BYTES)
        plain.encode_special_tokens = not as_loaded
        ids, at = chunks.ByteLevel(BYTES, as_loaded).encode(pa.array(odd_texts))
        for i, found in enumerate(plain.encode_batch(odd_texts, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == found.ids, odd_texts[i]


def test_memory_is_bounded_and_right_when_full():
    asked = Counter()

    def learn(keys):
        asked.update(keys.to_pylist())
        ends = np.arange(len(keys) + 1) * 4
        return chunks.binaries(np.array([len(k) for k in keys.to_pylist()], np.uint32).view(np.uint8), ends)

    memory = chunks.Memory(learn, budget=4_000)
    for k in range(50):
        keys = pa.array([b"often", b"x" * 500, *(b"%d-%d" % (k, i) for i in range(40))], pa.large_binary())
        rows, at = memory(keys)
        assert chunks.gather(rows, at)[0].tolist() == [len(key) for key in keys.to_pylist()]
        assert memory.keys.nbytes + memory.rows.nbytes <= 4_000
    assert asked[b"often"] == 1 and asked[b"x" * 500] == 50  # the frequent one stays, a long one is never kept


# ---- tree concatenation ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def codec():
    return tree_bpe.WordEnds(WORDS)


def test_encoding_of_odd_texts(codec, odd_texts):
    ids, at = codec.encode(pa.array(odd_texts))
    for i, found in enumerate(codec.tokenizer.encode_batch(odd_texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == found.ids, odd_texts[i]


@pytest.mark.parametrize("letters,n", [("a", 3000), ("ab", 3000), ("theinandertion", 5000), ("日本語中文", 1500)])
def test_joins_of_halves_are_exact(codec, letters, n):
    rng = random.Random(n)
    for word in (letters * (n // len(letters)), "".join(rng.choices(letters, k=n))):
        [(symbols, _)] = codec.tokenizer.pre_tokenizer.pre_tokenize_str(word)
        want = codec.tokenizer.encode(word, add_special_tokens=False).ids
        for leaf in (1, 2, 5, 333):
            nodes = [codec.stretch(symbols[i : i + leaf], i + leaf >= len(symbols))
                     for i in range(0, len(symbols), leaf)]
            while len(nodes) > 1:
                nodes = [codec.join(*nodes[i : i + 2], i + 2 >= len(nodes), window=1) if i + 1 < len(nodes)
                         else nodes[i] for i in range(0, len(nodes), 2)]
            assert nodes[0] == want


def test_long_unsplit_texts_through_the_tree(spark, codec):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghé日", k=5_000)), "a" * 3_001, "x " + "y" * 700 + "<|endoftext|>" + "z" * 900,
             "ÀÉ" * 800 + "'re" + "1" * 400 + " \n end", "short", "", None, LONG, " ".join(["word" * 90] * 9),
             "q" * 256, "q" * 255]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1), (0, texts[0], 1)],
                                 "doc_id long, text string, ids int")
    got = tree_bpe.decode(tree_bpe.encode(docs, WORDS, leaf=256), WORDS).collect()
    want = []
    for i, text in [*enumerate(texts), (None, texts[0]), (0, texts[0])]:
        ids = codec.tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((i, ids, codec.tokenizer.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, len(r[1]))
    assert sorted(((r["doc_id"], r["ids"], r["text"]) for r in got), key=key) == sorted(want, key=key)


def test_query_of_tree_bpe(spark, codec, texts):
    rows = op11_tree_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = codec.tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False)
        assert r["n_tokens"] == len(found.ids) and r["ids_sha256"] == sha(" ".join(map(str, found.ids)))
        assert r["decoded_sha256"] == sha(codec.tokenizer.decode(found.ids, skip_special_tokens=False))


def test_odd_rows_of_tree_bpe(spark, odd):
    encoded = tree_bpe.encode(odd, WORDS)
    got = Counter((r["doc_id"], len(r["ids"])) for r in encoded.collect())
    assert got[5, 7] == 2 and got[7, 30_001] == 1 and got[1, 0] == got[2, 0] == got[3, 0] == got[None, 0] == 1
    assert tree_bpe.encode(odd.limit(0), WORDS).count() == 0
    assert [r["text"] for r in tree_bpe.decode(encoded.selectExpr("doc_id", "CAST(NULL AS array<int>) AS ids"),
                                               WORDS).collect()] == [None] * 12


# ---- periodic runs -----------------------------------------------------------------------------------------------

def brute_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # the smallest period of a stretch comes first
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(3_000):
        words = rng.choices(range(rng.choice([1, 2, 2, 3, 6])), k=rng.randrange(50))
        at, period = rng.randrange(len(words) + 1), rng.choices(range(3), k=rng.randrange(1, 9))
        words[at:at] = (period * 30)[: rng.choice([0, 0, rng.randrange(70)])]
        for least, times in ((6, 4), (4, 3), (20, 3), (30, 5)):
            got = periodic_runs.runs_of(np.array(words, np.int64), least, times)
            assert [tuple(r) for r in got.tolist()] == brute_runs(words, least, times), words


def test_query_of_periodic_runs(spark, texts):
    rows = {r["doc_id"]: r for r in op12_periodic_runs(spark, SF).collect()}
    assert set(rows) == set(texts)
    with_runs = 0
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        crc = zlib.crc32(str(doc_id).encode())
        g, n = crc // 10, len(words)
        if crc % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, r = brute_runs(words), rows[doc_id]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        with_runs += bool(runs)
    assert with_runs > 20


def test_odd_rows_of_periodic_runs(spark, odd):
    got = periodic_runs.find_runs(odd).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert len(got) == 12 and all(r["n_words"] == 0 and r["runs"] == [] and r["collapsed"] == ""
                                  for i in (1, 2, 3) for r in by_id[i])
    [long] = by_id[7]
    assert [tuple(x) for x in long["runs"]] == [(0, 30_000, 1)] and long["collapsed"] == "word end"
    assert len(by_id[5]) == len(by_id[None]) == 2
    assert periodic_runs.find_runs(odd.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "a b " * 50_000 + "c " + "x" * 100_000)], "doc_id long, text string")
    [r] = periodic_runs.find_runs(docs).collect()
    assert [tuple(x) for x in r["runs"]] == [(0, 100_000, 2)] and r["collapsed"] == "a b c " + "x" * 100_000


# ---- alignment ---------------------------------------------------------------------------------------------------

class PlainAlignment:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.values = token_alignment.byte_values()

    def __call__(self, text):
        """(ids a, ids b, groups, links as id pairs), or None for a text without tokens."""
        whole = (" " + (text or "")).encode()
        found = self.a.encode(whole.decode(), add_special_tokens=False)
        a, b = found.ids, self.b.encode(text or "")
        bytes_a = [bytes(self.values[c] for c in t) for t in found.tokens]
        bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                   else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(max(0, i - 60), len(b))
                 if max(ends_a[i] - len(bytes_a[i]), ends_b[j] - len(bytes_b[j])) < min(ends_a[i], ends_b[j])] \
            if len(a) < 300 else self.sweep(a, b, ends_a, ends_b)
        cuts = sorted(set(ends_a) & set(ends_b))
        group = lambda ids, ends: [[str(x) for x, e in zip(ids, ends) if low < e <= high]
                                   for low, high in zip([0, *cuts], cuts)]
        if len(a) >= 300:
            group = lambda ids, ends: self.split(ids, ends, set(cuts))
        return a, b, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(group(a, ends_a), group(b, ends_b))), links

    @staticmethod
    def split(ids, ends, cuts):
        out = [[]]
        for x, e in zip(ids, ends):
            out[-1].append(str(x))
            if e in cuts:
                out.append([])
        return out[:-1]

    @staticmethod
    def sweep(a, b, ends_a, ends_b):
        i = j = 0
        links = []
        while i < len(a):
            links.append((a[i], b[j]))
            i, j = i + (ends_a[i] <= ends_b[j]), j + (ends_b[j] <= ends_a[i])
        return links


def expected(rows, plain):
    """doc rows (doc_id, text) to the measures by definition."""
    found = [(i, plain(t)) for i, t in rows]
    count = Counter(p for _, x in found if x for p in set(x[3]))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        out.append((i, len(a), len(b), groups.count(";") + 1, len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), sha(groups)))
    return out


COLUMNS = ["doc_id", *token_alignment.MEASURES, "groups"]


def test_query_of_alignment(spark, texts):
    got = [tuple(r) for r in op13_token_alignment(spark, SF).collect()]
    assert sorted(got) == sorted(expected(texts.items(), PlainAlignment()))


def test_alignment_of_odd_texts(spark, odd_texts):
    plain = PlainAlignment()
    rows = [*enumerate(odd_texts[::7]), *((-1, "copy of a text"),) * 40, (None, None), (None, "x y"), (-2, "")]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, digest string, n int")
    got = token_alignment.align(docs, BYTES, PIECES, groups_as_digest=True)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=key) == sorted(expected(rows, plain), key=key)
    whole = {r["doc_id"]: r["groups"] for r in token_alignment.align(docs, BYTES, PIECES).collect()}
    for i, text in rows[:200]:
        assert whole[i] == (plain(text) or [0, 0, ""])[2]


def test_odd_rows_of_alignment(spark, odd):
    got = token_alignment.align(odd, BYTES, PIECES).collect()
    assert len(got) == 12 and sum(r["doc_id"] == 5 for r in got) == 2
    assert all(r["n_a"] == 0 and r["groups"] == "" for r in got if r["doc_id"] in (1, 2))
    assert token_alignment.align(odd.limit(0), BYTES, PIECES).count() == 0
