import os

import corpus_pipeline
from wellspark.llm import toxicity
from wellspark.llm.queries import ORACLES, QUERIES

from .conftest import SF
from .test_dedup_and_join import brute_groups
from .test_packing import check_layout


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "pii",
                                                      "best_fit_packing"]
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)] and set(ORACLES) <= set(QUERIES)


def test_stages_against_brute_force(spark, documents, tmpdir_path):
    docs, before = documents, None
    for name, stage in corpus_pipeline.STAGES:
        out = os.path.join(tmpdir_path, name)
        stage(spark, docs, SF).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        old = {r["doc_id"]: r for r in before.collect()}
        if name != "best_fit_packing":
            assert docs.columns == documents.columns
            new = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            model = toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {i for i, r in old.items() if model.severity(model.find(r["text"]))[1] < 0.5}
            assert set(new) == want and 0 < len(want) < len(old)
            assert all(new[i] == old[i] for i in new)
        if name == "exact_dedup":
            upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
            best = {}
            for i, r in old.items():
                key = r["text"].translate(str.maketrans(upper, lower))
                best[key] = max(i, best.get(key, -1))
            assert set(new) == set(best.values())
        if name == "ngram_jaccard_join":
            groups = brute_groups({i: r["text"] for i, r in old.items()})
            assert set(new) == {g[0] for g in groups.values()}
        if name == "pii":
            assert set(new) == set(old)
            changed = [i for i in new if new[i]["text"] != old[i]["text"]]
            assert changed and all("[" in new[i]["text"] and new[i]["n_chars"] == len(new[i]["text"]) for i in changed)
        if name == "best_fit_packing":
            check_layout(docs.collect(), 1024)
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(old)


def test_run_on_odd_documents(spark, odd, tmpdir_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmpdir_path}/labels.parquet")
    assert corpus_pipeline.run(spark, tmpdir_path).count() > 0
    empty = os.path.join(tmpdir_path, "none")
    odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
