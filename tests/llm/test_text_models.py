import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from wellspark.llm import language_id, pii, pii_examples, piece_codec, quality_model, quality_rules, token_counts, toxicity
from wellspark.llm.queries import (op4_language_id, op5_quality_classifier, op6_token_counts, op7_sentencepiece_codec,
                                   op8_quality_rules, op9_pii, op10_toxicity)

from .conftest import LONG, SF

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ---- language ----------------------------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark, documents):
    got = {r["doc_id"]: r for r in op4_language_id(spark, SF).collect()}
    langs = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert set(got) == set(langs)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [d for d, r in got.items() if r["held_out"] and langs[d]]
    assert sum(got[d]["lang_pred"] == langs[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_known_word_before_ngrams():
    model = [("a", 0, "x", 1.0), ("b", 0, "x", 2.0), ("a", 1, "z", 3.0), ("b", 1, "z", 1.0), ("b", 2, "zz", 0.5)]
    b = language_id.Backoff(model)
    assert list(b.cost("x")) == [1.0, 2.0]  # known as a word
    assert list(b.cost("zz")) == [7.0, 0.5]  # unknown: the longest known n-gram
    assert list(b.cost("z")) == [3.0, 1.0]
    assert list(b.cost("q")) == [7.0, 7.0]
    assert b.predict("x 12")[0] == "a" and b.predict("12 ½")[0] == "und"


def test_language_against_plain_counting(spark, documents):
    from pyspark.sql import functions as F

    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = language_id.learn(documents, train)
    rows = documents.collect()
    words = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"]:
            words.setdefault(r["lang"], Counter()).update(re.findall(r"[^\W\d_]+", r["text"].lower()))
    want = {}
    for lang, counted in words.items():
        tables = {0: counted, **{k: Counter() for k in range(1, 7)}}
        for word, n in counted.items():
            spaced = f" {word} "
            for k in range(1, 7):
                for i in range(len(spaced) - k + 1):
                    tables[k][spaced[i : i + k]] += n
        for k, table in tables.items():
            total, kept = sum(table.values()), sorted(((-n, g) for g, n in table.items() if n > 1))[:20_000]
            want |= {(lang, k, g): -math.log10(-n / total) for n, g in kept}
    got = {(lang, k, g): cost for lang, k, g, cost in model}
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)

    langs = sorted(words)
    cost = lambda lang, k, g: want.get((lang, k, g), 7.0)
    found = {r["doc_id"]: r for r in language_id.identify(documents.limit(60), model).collect()}
    for r in rows:
        if r["doc_id"] not in found:
            continue
        means = []
        text_words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        for lang in langs:
            total = 0.0
            for w in text_words:
                if any((x, 0, w) in want for x in langs):
                    total += cost(lang, 0, w)
                    continue
                for k in range(6, 0, -1):
                    grams = [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)]
                    some = [g for g in grams if any((x, k, g) in want for x in langs)]
                    if some:
                        total += sum(cost(lang, k, g) for g in some) / len(some)
                        break
                else:
                    total += 7.0
            means.append(total / len(text_words) if text_words else 0)
        order = sorted(means)
        if text_words and (len(order) < 2 or order[1] - order[0] > 1e-4):
            assert found[r["doc_id"]]["lang_pred"] == langs[means.index(order[0])]


def test_odd_rows_of_language(spark, odd):
    from pyspark.sql import functions as F

    got = language_id.identify(odd, language_id.learn(odd, F.lit(True))).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    nothing = language_id.identify(odd, language_id.learn(odd, F.lit(False))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language_id.identify(odd.limit(0), []).count() == 0


# ---- token counts and pieces -------------------------------------------------------------------------------------

def test_token_counts_against_greedy_longest_match(spark, texts):
    vocabulary = {base64.b64decode(line.split()[0]) for line in open(RANKS, "rb")}
    longest = max(map(len, vocabulary))

    def greedy(word):
        n = at = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
            n += 1
        return n

    counts = {w: greedy(b" " + w.encode()) for t in texts.values() for w in (t or "").split()}
    for r in op6_token_counts(spark, SF).collect():
        words = (texts[r["doc_id"]] or "").split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(counts[w] for w in words))


def test_longest_match_where_nothing_fits():
    match = token_counts.LongestMatch([b"a", b"abcd", b"bc", b"b", b"cd"])
    assert [match.count(w) for w in (b"", b"abcd", b"abc", b"abcdab", b"bcd", b"x", b"abcx")] == [
        0, 1, 2, 3, None, None, None]


def test_odd_rows_of_token_counts(spark, odd):
    got = [(r["doc_id"], r["n_words"]) for r in token_counts.token_counts(odd, RANKS).collect()]
    assert Counter(got)[5, 7] == 2 and (7, 30_001) in got and (1, 0) in got and (None, 0) in got


def viterbi(codec, text):
    """Whole-text dynamic programme over all pieces, without windows or memory."""
    pieces = {}

    def walk(kids, prefix):
        for c, (below, found, gain) in kids.items():
            if found >= 0:
                pieces[prefix + c] = (found, gain)
            walk(below, prefix + c)

    walk(codec.trie, "")
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        steps = [(j, *pieces[text[i:j]]) for j in range(i + 1, min(len(text), i + codec.longest) + 1)
                 if text[i:j] in pieces]
        if text[i] not in pieces:
            steps.append((i + 1, -1, codec.unknown))
        for j, found, gain in steps:
            if best[i] + gain > best[j]:
                best[j], back[j] = best[i] + gain, (i, found)
    ids, j = [], len(text)
    while j:
        i, found = back[j]
        ids += [found] if found >= 0 else [codec.byte_ids[b] for b in reversed(text[i].encode())]
        j = i
    return ids[::-1]


TEXTS = ["", "a", " a", "a ", "hello  world\n\nfoo \n bar", "  x  ", "日本語 テスト 🙂", "x\0y", "\n", "word\n",
         "the\nThe and 123 4", "é é", "a" * 900, "ab" * 700 + " " + "日" * 300]


def ids_of(codec, text):
    import numpy as np

    return np.frombuffer(codec.encode(text), dtype=np.uint32).tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_streaming_viterbi_equals_the_whole_search(text):
    codec = piece_codec.pieces_of(MODEL)
    want = viterbi(codec, "▁" + text.replace(" ", "▁")) if text else []
    assert ids_of(codec, text) == want and codec.decode(want) == text


def test_pieces_of_documents(spark, texts):
    codec = piece_codec.pieces_of(MODEL)
    rows = {r["doc_id"]: r for r in op7_sentencepiece_codec(spark, SF).collect()}
    for k, (doc, text) in enumerate(texts.items()):
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert rows[doc]["n_ids"] == len(rows[doc]["ids"])
        if k < 25:
            assert list(rows[doc]["ids"]) == viterbi(codec, "▁" + text.replace(" ", "▁"))


def test_odd_rows_of_pieces(spark, odd):
    rows = piece_codec.decode(piece_codec.encode(odd, MODEL), MODEL).collect()
    want = [(r["doc_id"], r["text"]) for r in odd.collect()]
    key = lambda x: (x[0] or 0, x[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=key) == sorted(want, key=key)
    codec = piece_codec.pieces_of(MODEL)
    assert codec.decode(ids_of(codec, "a▁b ▁")) == "a▁b ▁"


# ---- quality -----------------------------------------------------------------------------------------------------

def base_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def test_quality_rules_statistics_and_verdicts(spark, texts, labels):
    rows = {r["doc_id"]: r for r in op8_quality_rules(spark, SF).collect()}
    assert set(rows) == set(texts)
    for doc, r in rows.items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                r["base_failed"]) == base_statistics(texts[doc])
        assert not (r["base_failed"] and r["kept"])
    known = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect() if not rows[r["doc_id"]]["base_failed"]]
    assert sum(r["kept"] == bool(q) for q, r in known) >= 0.95 * len(known)


def test_odd_rows_of_quality_rules(spark, odd, labels):
    rows = quality_rules.judge(odd, quality_rules.learn(odd, labels.limit(0))).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"]}
    for r in rows:
        if r["doc_id"]:
            assert tuple(r)[1:7] == base_statistics(texts[r["doc_id"]])
    assert quality_rules.judge(odd.limit(0), []).count() == 0


def test_quality_rules_run_no_python(spark, odd):
    rule = [[("symbols", ">", 0.5), ("log_words", "<=", 9.0)], [("upper", ">", 0.9)]]
    plan = quality_rules.judge(odd, rule)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_decision_list_finds_the_rule():
    rows = [{"a": i % 10, "b": i % 7, "bad": int(i % 10 > 6 and i % 7 <= 2), "prune": i % 3 == 0} for i in range(2000)]
    rules = quality_rules.learn_list(rows, ["a", "b"])
    assert all(any(quality_rules.holds(r, rule) for rule in rules) == bool(r["bad"]) for r in rows)


def test_quality_model_on_labelled_documents(spark, labels):
    rows = {r["doc_id"]: r for r in op5_quality_classifier(spark, SF).collect()}
    known = [(r["quality"], rows[r["doc_id"]]["kept"]) for r in labels.collect()]
    assert sum(k == bool(q) for q, k in known) >= 0.95 * len(known)
    assert all(0 < r["p_path"] < 1 and 0 <= r["quality"] <= 1 for r in rows.values())


def test_quality_of_held_out_labels(spark, documents, labels):
    """Evidence and site records from three quarters of the labels; the others are judged without theirs."""
    from pyspark.sql import functions as F

    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    used = labels.where(~held)
    found = quality_model.classify(documents, quality_model.learn(documents, used), used, F.col("source"),
                                   F.concat_ws("/", "source", "lang"))
    pairs = labels.where(held & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    pairs = pairs.join(found, "doc_id").select("label", "kept").collect()
    assert len(pairs) > 50 and sum(r["kept"] == bool(r["label"]) for r in pairs) >= 0.95 * len(pairs)


def test_site_records_against_brute_force(spark):
    from pyspark.sql import functions as F

    rows = [(i, "word " * 60, f"h{i % 7 % 3}", f"p{i % 7}") for i in range(300)]
    rows += [(999, "x", "tiny", "q"), (None, None, None, None), (None, "y", "h0", "p0"), (5, "again", "h2", "p5"), (5, "again", "h2", "p5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    marked = [(i, int(i % 7 != 0)) for i in range(0, 300, 2)] + [(4, 0), (None, 1), (7, None), (12345, 1)]
    labels = spark.createDataFrame(marked, "doc_id long, quality int")
    evidence = F.when(F.col("n_words") > 50, F.lit(1.0)).otherwise(F.lit(-1.0))
    got = quality_model.classify(docs, evidence, labels, F.col("host"), F.col("path")).collect()
    assert len(got) == len(rows)
    mark = {}
    for i, q in marked:
        if i is not None and q is not None:
            mark[i] = min(q, mark.get(i, 1))
    sites = {(i, h or "", p or "") for i, _, h, p in rows if i in mark}
    hosts, paths = {}, {}
    for i, h, p in sites:
        paths.setdefault((h, p), []).append(mark[i])
    for i, h in {(i, h) for i, h, _ in sites}:
        hosts.setdefault(h, []).append(mark[i])
    mu = sum(map(sum, hosts.values())) / sum(map(len, hosts.values()))

    def strength(groups):  # [(labels of the group, prior)]
        n = [len(g) for g, _ in groups]
        seen = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in groups)
        noise = sum(m * (1 - m) for _, m in groups)
        between = max((seen - noise) / max(sum(n) - sum(x * x for x in n) / sum(n), 1.0), 1e-4)
        return max(1.0, min(1e4, sum(m * (1 - m) for _, m in groups) / len(groups) / between - 1))

    kh = strength([(g, mu) for g in hosts.values()])
    whole = {h: (sum(g) + kh * mu) / (len(g) + kh) for h, g in hosts.items()}
    kp = strength([(g, whole[h]) for (h, _), g in paths.items()])
    text = {(i, h, p): t for i, t, h, p in rows}
    for r in got:
        for i, h, p in {(i, h or "", p or "") for i, _, h, p in rows if i == r["doc_id"]}:
            own = mark.get(i)
            hs, ps = hosts.get(h, []), paths.get((h, p), [])
            less = lambda g: (sum(g) - (own or 0), len(g) - (own is not None))
            p_host = (less(hs)[0] + kh * mu) / (less(hs)[1] + kh)
            p_path = (less(ps)[0] + kp * p_host) / (less(ps)[1] + kp)
            if r["p_host"] == pytest.approx(p_host) and r["p_path"] == pytest.approx(p_path):
                site = max(0.001, min(0.999, p_path))  # the documented bound
                odds = math.log(r["p_doc"] / (1 - r["p_doc"])) + math.log(site / (1 - site)) - math.log(mu / (1 - mu))
                assert r["quality"] == pytest.approx(1 / (1 + math.exp(-odds)))
                break
        else:
            raise AssertionError(r)
    tiny = next(r for r in got if r["doc_id"] == 999)
    assert tiny["p_host"] == tiny["p_path"] == pytest.approx(mu)  # a site without labels is what its parent is
    assert len(text) < len(rows)


def test_odd_rows_of_quality(spark, odd, labels):
    from pyspark.sql import functions as F

    mixed = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (4, None), (5, 1), (7, 1)], "doc_id long, quality int")
    for marks in (mixed, labels.limit(0)):
        found = quality_model.classify(odd, quality_model.learn(odd, marks), marks, F.col("source"), F.col("lang"))
        rows = found.collect()
        assert len(rows) == odd.count() and all(0 < r["p_path"] < 1 and 0 <= r["quality"] <= 1 for r in rows)
    assert all(r["kept"] for r in rows)  # no labels, no ground to drop any
    none = odd.limit(0)
    assert quality_model.classify(none, F.lit(0.0), mixed, F.col("source"), F.col("lang")).count() == 0


# ---- personal data -----------------------------------------------------------------------------------------------

def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            d = int(c) * (1 + i % 2)
            total += d // 10 + d % 10
        return total % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m.group())]


ODD_PII = [
    "a@b.c d@e.f@g.hh", "x@y.z@w.v", "@a.b .@a.b", "a@b a@b.c.", "1.2.3.4.5.6.7.8 01.002.0255.1 256.1.1.1", "1..2.3.4",
    "4111 1111-1111 1111 4111  1111 1111 1111", "+1 (234) 555-1234. +12 +1-2-3-4-5-6-7-8 +", "x" * 5000 + "@",
    "1" * 5000, "4111111111111111@4111111111111111.4111111111111111", "😀 a@b.cd 😀 10.0.0.1", "+1 2345678 a+1@b.co",
]


@pytest.mark.parametrize("text", ODD_PII)
def test_base_spans_of_odd_texts(text):
    assert pii.spans(text, {})[0] == base_spans(text)


def test_personal_data_of_documents(spark, texts):
    rows = {r["doc_id"]: r for r in op9_pii(spark, SF).collect()}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        want = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = rows[doc]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        found = r["spans"].split(",") if r["spans"] else []
        assert [s for s in found if not s.startswith("secret")] == (joined.split(",") if joined else [])
        for m in re.finditer(r'token = "([0-9a-f]{40})"', text):  # planted credentials
            assert f"secret:{m.start(1)}:{m.end(1)}" in found
    assert any("secret:" in r["spans"] for r in rows.values())


def test_segments_are_the_best_ones():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(60):
        found = sorted(((a, a + rng.randint(1, 6), rng.choice("xy"), True, [f"f{i}"]) for i, a in
                        enumerate(rng.sample(range(20), 6))), key=lambda c: (c[1], c[0], c[2]))
        w = {f"f{i}": rng.uniform(-1, 2) for i in range(6)}
        total = lambda s: sum(w[c[4][0]] for c in s)
        apart = lambda s: all(a[1] <= b[0] for a, b in zip(s, s[1:]))
        best = max(total(s) for k in range(7) for s in itertools.combinations(found, k) if apart(s))
        got = pii.segment(found, w)
        assert apart(got) and total(got) == pytest.approx(best)


def test_expected_counts_equal_those_of_all_segmentations():
    import itertools
    import math
    import random

    rng = random.Random(2)
    for _ in range(30):
        found = sorted(((a, a + rng.randint(1, 6), rng.choice("xy"), True, [f"f{i}", "all"]) for i, a in
                        enumerate(rng.sample(range(20), 6))), key=lambda c: (c[1], c[0], c[2]))
        w = {f: rng.uniform(-1, 1) for f in [*(f"f{i}" for i in range(6)), "all", "None>x", "x>x", "x>y", "y>x"]}
        whole, counts = 0.0, {}
        for k in range(7):
            for s in itertools.combinations(found, k):
                if all(a[1] <= b[0] for a, b in zip(s, s[1:])):
                    feats = [f for last, c in zip([None, *[c[2] for c in s]], s) for f in (*c[4], f"{last}>{c[2]}")]
                    mass = math.exp(sum(w.get(f, 0.0) for f in feats))
                    whole += mass
                    for f in feats:
                        counts[f] = counts.get(f, 0.0) + mass
        log_whole, got = pii.expectations(found, w)
        assert log_whole == pytest.approx(math.log(whole))
        assert got == pytest.approx({f: c / whole for f, c in counts.items()})


def test_learned_field_finds_named_and_issued_secrets():
    key, hexes = "AKIA" + "Q7ZP" * 4, "0123456789abcdef" * 2
    texts = [f"some words {key} more", f'token = "{hexes}" end', f"see {hexes}/page_one for a list", "mail a@b.cd now"]
    lists = [pii.candidates(t) for t in texts * 20]
    weights = pii.fit(lists)
    found = [[s[0] for s in pii.spans(t, weights)[1]] for t in texts]
    assert found == [["secret"], ["secret"], [], ["email"]]
    assert pii.masked(texts[0], weights) == "some words [SECRET] more"
    assert pii.spans(f"an unseen {key.lower()} here", weights)[1]
    alone = pii.fit([pii.candidates(texts[3])])  # a sample without secrets
    assert [s[0] for s in pii.spans(texts[0], alone)[1]] == ["secret"]
    assert pii.fit([]) == pii.PRIOR


@pytest.mark.parametrize("form", ["commit {:040x} end", "see page-{:04d}-of-the-long-list-of-pages there"])
def test_vouched_secrets_do_not_rest_on_the_sample(form):
    weights = pii.fit([pii.candidates(form.format(i * 7919)) for i in range(1, 201)])  # unvouched strings, no credential
    key, value = "AKIA" + "Q7ZP" * 4, "0123456789abcdef" * 2
    text = f'some {key} and token = "{value}" end'
    assert [text[a:b] for kind, a, b in pii.spans(text, weights)[1] if kind == "secret"] == [key, value]
    assert pii.spans(form.format(7), weights)[1] == []
    crossing = "password=abcdefghijkl4111 1111 1111 1111 end"  # a card that starts inside the value
    assert pii.masked(crossing, weights) == "password=[SECRET] end"
    assert [k for k, *_ in pii.spans("password: firstname.lastname@x.com", weights)[1]] == ["email"]


@pytest.mark.parametrize("n", [256, 257, 800, 100_000])
def test_long_secrets_are_whole_segments(n):
    value = ("eyJhbGciOi4x.aB3-" * (n // 17 + 1))[: n - 1] + "Z"
    assert pii.masked(f"token = {value} end", pii.PRIOR) == "token = [SECRET] end"
    free = value.replace(".", "_")
    assert [c[:3] for c in pii.candidates(f"see {free} end")] == [(4, 4 + n, "secret")]


KEY = "AKIA" + "Q7ZP" * 4


@pytest.mark.parametrize("text, secret", [
    (f"AWSAccessKeyId={KEY}&Expires=1", KEY), (f"id={KEY}", KEY), (f"user={KEY.lower()} x", KEY.lower()),
    (f"path/{KEY}", KEY), (f"s3://{KEY}/", KEY), (f"{KEY}_ x", KEY), (f"+{KEY}-", KEY), (f"see {KEY}.", KEY),
    ("ASIA" + "QZPX" * 4, "ASIA" + "QZPX" * 4), (f"a/glpat-{'x1' * 10}/b", "glpat-" + "x1" * 10),
    ("env: API_KEY=abcdefghijkl", "abcdefghijkl"), ("a=b_c=user_token='abc.defghijkl'", "abc.defghijkl"),
    (f"env: API_KEY=x/{KEY}", f"x/{KEY}"), (f"x{KEY}", None), (f"{KEY}7", None)])
def test_issued_and_named_secrets_wherever_they_stand(text, secret):
    weights = {"secret|bias": -9.0}
    assert [text[a:b] for _, a, b in pii.spans(text, weights)[1]] == ([secret] if secret else [])
    assert pii.masked(text, weights) == (text.replace(secret, "[SECRET]") if secret else text)


def test_many_assignments_in_one_run_take_linear_time():
    text = "key=" * 100_000 + "abcdefghijklmnop " + "abc=" * 100_000 + f"{KEY}/" * 10_000
    found = [s for s in pii.spans(text, {})[1] if s[0] == "secret"]
    assert (found[0][1:], len(found)) == ((4, 400_016), 10_001)


def test_field_on_unseen_examples():
    weights = pii.learn()
    unseen = pii_examples.examples(2000, seed=77)
    found = [sorted((k, t[a:b]) for k, a, b in pii.spans(t, weights)[1]) == sorted(g) for t, g in unseen]
    assert sum(found) >= 0.995 * len(found)
    free = [ok for ok, (t, g) in zip(found, unseen) if not any(c[3] for c in pii.candidates(t))]  # nothing vouches
    assert len(free) > 800 and sum(free) >= 0.99 * len(free)


@pytest.mark.parametrize("text, secret", [
    ("commit 0123456789abcdef0123456789abcdef01234567 fixes it", None),
    ("md5 D41D8CD98F00B204E9800998ECF8427E of the file", None),
    ("job 550e8400-e29b-41d4-a716-446655440000 is done", None),
    ("see page-0007-of-the-long-list-of-pages there", None),
    ("at usr/lib/python3/site/packages/spark there", None),
    ("use wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEYx9 here", "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEYx9"),
    ("password: 0123456789abcdef0123456789abcdef end", "0123456789abcdef0123456789abcdef")])
def test_look_alikes_are_judged_by_the_field(text, secret):
    assert [text[a:b] for k, a, b in pii.spans(text, pii.learn())[1] if k == "secret"] == ([secret] if secret else [])


def test_fixed_segments_stand_in_the_best_segmentation():
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(40):
        found = sorted(((a, a + rng.randint(1, 6), rng.choice("xy"), True, [f"f{i}"]) for i, a in
                        enumerate(rng.sample(range(20), 7))), key=lambda c: (c[1], c[0], c[2]))
        w = {f"f{i}": rng.uniform(-2, 2) for i in range(7)}
        fixed = frozenset([rng.choice(found)[:3]])
        apart = lambda s: all(a[1] <= b[0] for a, b in zip(s, s[1:]))
        holds = [s for k in range(8) for s in itertools.combinations(found, k) if apart(s) and fixed <= {c[:3] for c in s}]
        best = max(sum(w[c[4][0]] for c in s) for s in holds)
        got = pii.segment(found, w, fixed)
        assert fixed <= {c[:3] for c in got} and sum(w[c[4][0]] for c in got) == pytest.approx(best)


def test_odd_rows_of_personal_data(spark, odd):
    rows = pii.find(odd, {}).collect()
    assert len(rows) == odd.count()
    masked = {r["doc_id"]: r for r in pii.mask(odd, {}).collect()}
    assert masked[9]["text"] == "mail [EMAIL] or [IP] and 300.1.1.1" and masked[9]["n_chars"] == len(masked[9]["text"])
    assert masked[1]["text"] is None and masked[7]["text"] == LONG
    assert pii.mask(odd, {}).columns == odd.columns
    assert pii.mask(odd.limit(0), pii.learn()).count() == 0


# ---- toxicity ----------------------------------------------------------------------------------------------------

def test_toxicity_of_labelled_documents(spark, labels):
    rows = {r["doc_id"]: r for r in op10_toxicity(spark, SF).collect()}
    known = [(r["toxic"], rows[r["doc_id"]]) for r in labels.collect()]
    assert all(r["rejected"] == (r["p_toxic"] >= 0.5) and 0 <= r["severity"] <= 3 for r in rows.values())
    assert sum(r["rejected"] for t, r in known if not t) <= 0.01 * len(known)
    assert sum(r["rejected"] for t, r in known if t) >= 0.7 * sum(t for t, _ in known)


def test_toxicity_of_held_out_labels(spark):
    from pyspark.sql import functions as F

    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.learn(documents, labels.where(~held))
    found = toxicity.score(documents, model)
    pairs = labels.where(held).select("doc_id", "toxic").join(found, "doc_id").collect()
    bad = [r["rejected"] for r in pairs if r["toxic"]]
    good = [r["rejected"] for r in pairs if r["toxic"] == 0]
    assert len(bad) > 80 and sum(bad) >= 0.7 * len(bad) and sum(good) <= 0.01 * len(good)
    assert all(r["p_toxic"] == pytest.approx(model.severity(model.find(t))[1]) for r, t in zip(
        *(lambda rows: (rows, [r["text"] for r in rows]))(found.join(documents.select("doc_id", "text"), "doc_id").limit(50).collect())))


def test_cumulative_link_orders_the_grades():
    import numpy as np

    x = np.repeat(np.eye(4)[:, 1:], 50, axis=0)
    y = np.repeat([0, 1, 2, 3], 50)
    w, cuts = toxicity.fit_cumulative(x, y, np.ones(len(y)))
    assert w[0] < w[1] < w[2] and cuts == sorted(cuts)
    model = toxicity.Model({"a": w[0], "b": w[1], "c": w[2]}, cuts)
    assert [max(range(4), key=model.grades(v).__getitem__) for v in (0, *w)] == [0, 1, 2, 3]
    assert sum(model.grades(0.3)) == pytest.approx(1)


def test_odd_rows_of_toxicity(spark, odd, labels):
    model = toxicity.Model({"seven": 9.0}, [3.0, 4.0, 5.0])
    got = toxicity.score(odd, model).collect()
    assert Counter(r["doc_id"] for r in got if r["rejected"]) == {4: 1, 5: 2, 6: 1}
    kept = toxicity.keep_harmless(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    none = toxicity.learn(odd, labels.limit(0))
    assert toxicity.keep_harmless(odd, none).count() == odd.count()
