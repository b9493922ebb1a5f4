import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from wellspark.llm import exact_dedup, ngram_join
from wellspark.llm.components import components
from wellspark.llm.queries import OP2_SQL, op2_exact_dedup, op3_ngram_jaccard_join
from wellspark.session import scratch_path

from .conftest import LONG, SF


def test_exact_dedup_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.sql(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({OP2_SQL})").fetchall())
    got = op2_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_dedup_plan_has_no_python(spark, odd):
    plan = exact_dedup.dedup(odd, exact_dedup.new_index(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_odd_rows_of_dedup(spark, odd):
    got = {(r["doc_id"], r["digest"].hex()): r for r in exact_dedup.dedup(odd, exact_dedup.new_index(spark)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    seven = sha("one two three four five six seven")
    assert [got[i, seven]["kept"] for i in (4, 5, 6)] == [False, False, True]
    assert got[4, seven]["group_size"] == 4 and got[4, seven]["keep_id"] == 6
    assert got[None, sha("")]["keep_id"] == 2 and not got[None, sha("")]["kept"]
    assert got[None, sha("one two")]["kept"]
    # only A-Z are lower-cased
    assert (8, sha("Été à l'école, où ça? 日本 😀")) in got
    assert exact_dedup.dedup(odd.limit(0), exact_dedup.new_index(spark)).count() == 0


def test_kept_rows_keep_their_columns(spark, odd):
    kept = exact_dedup.keep_first_copies(odd, exact_dedup.new_index(spark))
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert Counter(t for t in texts if t and "six" in t.lower()) == {"ONE TWO three four five six seven": 1}
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 6, 7, 8, 9]


def test_later_batches_are_checked_against_the_index(spark):
    path = scratch_path(spark, "index/test_batches")
    index = exact_dedup.DigestIndex(spark, "digest_index_test", path, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "A"), (4, "c"), (5, "C")], "doc_id long, text string")
    assert exact_dedup.dedup(first, index).where("kept").count() == 2
    spark.sql("DROP TABLE digest_index_test")  # as in a new session: the files stay, the name is registered again
    index = exact_dedup.DigestIndex(spark, "digest_index_test", path, buckets=4)
    got = {r["doc_id"]: r for r in exact_dedup.dedup(second, index).collect()}
    assert (got[3]["kept"], got[3]["keep_id"], got[3]["seen_before"]) == (False, 1, True)
    assert (got[4]["kept"], got[5]["kept"], got[5]["keep_id"]) == (False, True, 5)
    assert index.read().count() == 3


def test_the_anti_join_does_not_shuffle_the_index(spark):
    index = exact_dedup.new_index(spark, buckets=4)
    groups = spark.createDataFrame([(b"x", 1)], "digest binary, first_id long")
    index.append(groups)
    plan = index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_the_index_is_neither_shuffled_nor_sorted_after_three_appends(spark):
    index = exact_dedup.new_index(spark, buckets=4)
    for k in range(3):
        index.append(spark.createDataFrame([(b"%d" % (100 * k + i), i) for i in range(50)], "digest binary, first_id long"))
    assert index.generations == [0, 1, 2]
    groups = spark.createDataFrame([(b"%d" % i, i) for i in range(40, 160)], "digest binary, first_id long")
    with exact_dedup.sorted_bucket_scans(spark):
        plan = index.found(groups)._jdf.queryExecution().executedPlan().toString()
        got = {bytes(r["digest"]): r["seen_id"] for r in index.found(groups).collect()}
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("Exchange hashpartitioning") == 1 and len([x for x in plan.split("\n") if "Sort [" in x]) == 1
    assert got == {b"%d" % i: i % 100 if i % 100 < 50 else None for i in range(40, 160)}


def test_a_batch_that_is_run_again_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_GENERATIONS", 2)
    index = exact_dedup.new_index(spark, buckets=4)
    batches = [spark.createDataFrame([(10 * b + i, f"text {i % 4 + b}") for i in range(6)], "doc_id long, text string")
               for b in range(4)]
    first = [sorted(map(tuple, exact_dedup.dedup(docs, index).collect())) for docs in batches]
    rows = index.read().count()
    again = [sorted(map(tuple, exact_dedup.dedup(docs, index).collect())) for docs in batches]
    assert again == first and index.read().count() == rows == 7
    assert len(index.generations) <= exact_dedup.MOST_GENERATIONS  # merged on the way
    reopened = exact_dedup.DigestIndex(spark, index.table, index.path, 4)
    assert reopened.generations == index.generations
    other = exact_dedup.dedup(batches[0], reopened, batch="another").collect()
    assert all(r["seen_before"] and not r["kept"] for r in other)


def brute_groups(texts):
    sets = {}
    for doc, text in texts.items():
        w = (text or "").lower().split()
        k = min(5, len(w))
        sets[doc] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    classes = defaultdict(list)
    for doc, s in sets.items():
        if s:
            classes[s].append(doc)
    reps = {min(v): s for s, v in classes.items()}
    root = {r: r for r in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, where, common = Counter(), defaultdict(list), Counter()
    for r, s in reps.items():
        for g in s:
            where[g].append(r)
    for rs in where.values():
        for i, a in enumerate(rs):
            for b in rs[:i]:
                common[min(a, b), max(a, b)] += 1
    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(reps[a]) + len(reps[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = {}
    for doc, s in sets.items():
        rep = min(classes[s]) if s else doc
        out[doc] = (find(rep), rep, len(classes[s]), links[rep]) if s else (doc, doc, 1, 0)
    return out


def test_ngram_join_against_brute_force(spark, texts):
    got = {r["doc_id"]: (r["class_id"], r["set_id"], r["n_copies"], r["n_links"])
           for r in op3_ngram_jaccard_join(spark, SF).collect()}
    assert got == brute_groups(texts)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(150):  # a chain of near copies: similar to some, not to all of the group
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 120))] = f"x{int(rng.integers(0, 50))}"
        texts[d] = " ".join(w)
    texts |= {200 + i: t for i, t in enumerate(list(texts.values())[:20])}
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 16)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["set_id"], r["n_copies"], r["n_links"])
           for r in ngram_join.ngram_join(docs).collect()}
    want = brute_groups(texts)
    assert got == want and max(v[3] for v in want.values()) > 20
    kept = {r["doc_id"] for r in ngram_join.keep_one_per_group(docs).collect()}
    assert kept == {v[0] for v in want.values()}


@pytest.mark.parametrize("chained", [4, 10 ** 6])
def test_a_long_chain_of_shared_buckets_is_compared_bucket_by_bucket(spark, monkeypatch, chained):
    """Windows that slide over one text: neighbours are similar, the ends have nothing in common."""
    words = [f"w{i}" for i in range(1400)]
    texts = {i: " ".join(words[6 * i : 6 * i + 120]) for i in range(200)}
    texts |= {1000 + i: t for i, t in enumerate(list(texts.values())[:30])}
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(ngram_join, "CHAINED", chained)
    compared = []
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    real = ngram_join._blocks
    monkeypatch.setattr(ngram_join, "_blocks", lambda grouped, *a: compared.append(grouped) or real(grouped, *a))
    got = {r["doc_id"]: (r["class_id"], r["set_id"], r["n_copies"], r["n_links"])
           for r in ngram_join.ngram_join(docs, small=2).collect()}
    assert got == brute_groups(texts) and len({v[0] for v in got.values()}) == 1
    sizes = [r["count"] for r in compared[0].groupBy("grp").count().collect()]
    assert max(sizes) < 40 if chained == 4 else max(sizes) > 150  # the work is that of the buckets, not of the chain


def test_odd_rows_of_the_join(spark, odd):
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(odd).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert {got[i]["class_id"] for i in (4, 5, 6)} == {4}
    assert all(got[i]["class_id"] == i and got[i]["n_links"] == 0 for i in (1, 2, 3, 7, 8, 9))
    kept = ngram_join.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sum(r["doc_id"] is None for r in rows) == 2 and any(r["text"] == LONG for r in rows)
    assert ngram_join.ngram_join(odd.limit(0)).count() == 0


def test_banding_reaches_the_target():
    bands, rows = ngram_join.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, components(df).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}}
    assert components(df.limit(0)).count() == 0
