"""Quality by hierarchical empirical Bayes: a document's own evidence and the record of its host and path.

1. A logistic model over the text's statistics gives each document a probability of being good. It is fitted by
   Newton steps on a sample of labelled documents of a documented bound.
2. Grouped aggregation counts the good and bad labels per path and per host. A host's share of good ones is shrunk to
   the global share and a path's to its host's (Beta priors around the parent); the strength of the shrinkage is
   estimated from the spread between the groups (method of moments), so that a site with few labels says little and
   one without labels what its parent says. A labelled document's own label is left out of the counts that judge it.
3. The document's log odds and those of its path, relative to the global share, are added: the text speaks through the
   first only, the site's labels through the second only.

Host and path come from a URL column, or from any two columns; for tables without URLs, ``source`` is the host and
``source/lang`` the path below it.

Edge cases: null texts have no words and are judged on that; null hosts or paths form a group of their own. Of several
labels of one document the lowest counts, null labels and labels of null or unknown ids are left out; a document that
occurs in several rows of one path counts once there. Without labels of both kinds a document's own evidence is 0.5;
without any label all are kept. Ids are carried along, null and repeated ones too; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm.text_stats import features, sampled_texts, with_stats
from wellspark.session import materialize

#: the statistics used here (the repeated windows are left to the quality rules)
INPUTS = ["log_words", "word_length", "symbols", "dup_lines", "distinct", "upper"]


def fit(rows: np.ndarray, good: np.ndarray, ridge: float = 1.0, steps: int = 30):
    """Weights (intercept first), means and deviations of a ridge logistic regression, by Newton steps."""
    mean, dev = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    x = np.column_stack([np.ones(len(rows)), (rows - mean) / dev])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-3] + [ridge] * rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (good - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, dev


def marks_of(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, good 0 or 1), one row per labelled id."""
    return (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("good")))


def learn(docs: DataFrame, labels: DataFrame, most: int = 6000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Column:
    """The document evidence as a column expression over the statistics (log odds), from about ``most`` labels."""
    marks = marks_of(labels, id_col, label_col)
    million = 1_000_000
    share = math.ceil(million * most / max(marks.count(), 1))
    sample = marks.where(F.pmod(F.xxhash64("id"), F.lit(million)) < share)
    stats = with_stats(sampled_texts(docs, sample, id_col, text_col), "id", "text")
    known = features()
    rows = (stats.join(sample, F.col("doc_id") == F.col("id"))
            .select("good", *[known[k].alias(k) for k in INPUTS]).collect())
    table = np.array([tuple(r) for r in rows], dtype=float).reshape(len(rows), 1 + len(INPUTS))
    if len(set(table[:, 0])) < 2:
        return F.lit(0.0)
    w, mean, dev = fit(table[:, 1:], table[:, 0])
    logit = F.lit(float(w[0]))
    for k, wk, m, d in zip(INPUTS, w[1:], mean, dev):
        logit = logit + F.lit(float(wk)) * (known[k] - F.lit(float(m))) / F.lit(float(d))
    return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), logit))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame, total: str, n: str, prior: Column) -> Column:
    """The number of pseudo-documents that the prior counts as, from the spread of the groups' means around it."""
    mean = F.col(total) / F.col(n)
    seen = F.sum(F.col(n) * (mean - prior) ** 2)  # weighted spread between the groups
    noise = F.sum(prior * (1 - prior))  # what it would be without any difference
    size = F.sum(F.col(n)) - F.sum(F.col(n) * F.col(n)) / F.sum(F.col(n))
    between = F.greatest((seen - noise) / F.greatest(size, F.lit(1.0)), F.lit(1e-4))
    found = groups.agg(F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.avg(prior * (1 - prior)) / between - 1)).alias("k"))
    k = found.first()["k"]
    return F.lit(1.0 if k is None else k)


def classify(docs: DataFrame, evidence: Column, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, p_doc, p_host, p_path, quality, kept. ``labels``: id_col and label_col (0 or 1). In the odds a record below
    0.001 or above 0.999 counts as these, so that no site outweighs every text."""
    plain = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"),
                        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                        F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    # the text's statistics with host and path carried through as one struct beside the id
    packed = with_stats_and(plain)
    scored = materialize(packed.select("doc_id", "host", "path", (1 / (1 + F.exp(-evidence))).alias("p_doc")), "scored")
    marks = marks_of(labels, id_col, label_col)
    known = scored.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("id"), "left").drop("id")
    nameless = scored.where("doc_id IS NULL").withColumn("good", F.lit(None).cast("int"))  # they would all meet in one task
    judged = materialize(known.unionByName(nameless), "judged")

    once = judged.where("good IS NOT NULL").select("doc_id", "host", "path", "good").distinct()
    paths = materialize(once.groupBy("host", "path").agg(F.sum("good").alias("s"), F.count("*").alias("n")), "paths")
    hosts = once.select("doc_id", "host", "good").distinct().groupBy("host").agg(
        F.sum("good").alias("hs"), F.count("*").alias("hn"))
    hosts = materialize(hosts, "hosts")
    mean = hosts.agg((F.sum("hs") / F.sum("hn")).alias("mu")).first()["mu"]
    bound = lambda c: F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), c))
    mu = F.lit(0.5 if mean is None else min(max(mean, 1e-3), 1 - 1e-3))  # one number; None without labels
    k_host = strength(hosts, "hs", "hn", mu)
    of_host = lambda s, n: (s + k_host * mu) / (n + k_host)
    k_path = strength(paths.join(hosts.select("host", of_host(F.col("hs"), F.col("hn")).alias("p_host")), "host"),
                      "s", "n", F.col("p_host"))
    # sites are joined on skewed keys: adaptive execution splits a hot one on the documents' side
    joined = judged.join(hosts, "host", "left").join(paths, ["host", "path"], "left")
    own, has = F.coalesce(F.col("good"), F.lit(0)), F.col("good").isNotNull().cast("int")
    less = lambda total, part: F.greatest(F.coalesce(F.col(total), F.lit(0)) - part, F.lit(0))
    joined = joined.withColumn("p_host", of_host(less("hs", own), less("hn", has)))
    joined = joined.withColumn("p_path", (less("s", own) + k_path * F.col("p_host")) / (less("n", has) + k_path))
    odds = logit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p_doc")))) + logit(bound(F.col("p_path"))) - logit(mu)
    return (joined.withColumn("quality", 1 / (1 + F.exp(-odds)))
            .select("doc_id", "p_doc", "p_host", "p_path", "quality", (F.col("quality") >= 0.5).alias("kept")))


def with_stats_and(plain: DataFrame) -> DataFrame:
    """The statistics of ``text_`` beside id, host and path."""
    keyed = plain.withColumn("key_", F.struct("id_", "host", "path"))
    return with_stats(keyed, "key_", "text_", keep_key=True).select(
        F.col("doc_id.id_").cast("long").alias("doc_id"), F.col("doc_id.host").alias("host"),
        F.col("doc_id.path").alias("path"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "n_distinct", "n_upper", "n_chars")
