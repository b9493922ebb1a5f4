"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

A feature is a word, or the first four or five letters of one, that labelled toxic documents hold far more often than
others (a lower bound of its log odds ratio decides). Grades are 0 for documents labelled harmless and 1 to 3 for toxic
ones, by how many of these words they hold (the labels say only toxic or not, so the upper grades rest on that count).
One weight per feature is shared by the three ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w.x). The
document's severity is the expected grade; it is rejected if a grade of 1 or more is likelier than 0.

Learning reads a sample of labelled documents of a documented bound (``most``) and keeps at most ``top`` features that at
least ``least_docs`` toxic documents hold and whose bound exceeds ``least_odds``, so the model is small whatever the
corpus; every document's whole text is scored, in batches.

Edge cases: null and empty texts have no features. Without toxic labels nothing is rejected. Null labels are not
learned from; a document with several labels is toxic if any says so. Ids are carried along; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm.text_stats import sampled_texts

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)
GRADES = 3


def tokens(text: str | None) -> Counter:
    """Counts of a whole text's lower-case words and of their stems (marked by a hyphen)."""
    words = Counter(WORD.findall((text or "").lower()))
    out = Counter(words)
    for word, n in words.items():
        for k in STEMS:
            if len(word) > k:
                out[word[:k] + "-"] += n
    return out


class Model:
    """Feature weights and ordered thresholds."""

    def __init__(self, weights: dict[str, float], cuts: list[float]):
        self.weights, self.cuts = weights, cuts

    def grades(self, x: float) -> list[float]:
        """P(grade = 0), ..., P(grade = GRADES) at the linear score x."""
        below = [1 / (1 + math.exp(-max(-40.0, min(40.0, c - x)))) for c in self.cuts] + [1.0]
        return [b - a for a, b in zip([0.0, *below], below)]

    def severity(self, found: dict[str, float]) -> tuple[float, float]:
        """(expected grade, P(grade >= 1)) for counts of features."""
        x = sum(w * math.log1p(found[f]) for f, w in self.weights.items() if f in found) if found else 0.0
        p = self.grades(x)
        return sum(k * q for k, q in enumerate(p)), 1 - p[0]

    def find(self, text: str | None) -> dict[str, float]:
        """Counts of the model's features in a whole text."""
        if not text or not self.weights:
            return {}
        words = WORD.findall(text.lower())
        hits: dict[str, float] = {}
        for word in set(words):
            own = [f for f in (word, *[word[:k] + "-" for k in STEMS if len(word) > k]) if f in self.weights]
            if own:
                n = words.count(word)
                for f in own:
                    hits[f] = hits.get(f, 0) + n
        return hits


def fit_cumulative(x: np.ndarray, y: np.ndarray, times: np.ndarray, grades: int = GRADES, ridge: float = 0.02,
                   steps: int = 600):
    """Weights and thresholds that minimise the cumulative-link loss of rows that count ``times`` each (by Adam).

    Thresholds are a first one and positive steps (by exponentials), so they stay ordered.
    """
    (rows_, m), n = x.shape, times.sum()
    theta = np.concatenate([np.zeros(m), [2.0], np.zeros(grades - 1)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, gaps = theta[:m], np.exp(theta[m + 1 :])
        cuts = theta[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = x @ w
        cdf = 1 / (1 + np.exp(-np.clip(cuts[None, :] - s[:, None], -30, 30)))
        padded = np.column_stack([np.zeros(rows_), cdf, np.ones(rows_)])
        slope = padded * (1 - padded)
        rows = np.arange(rows_)
        p = np.maximum(padded[rows, y + 1] - padded[rows, y], 1e-12)
        up, low = times * slope[rows, y + 1] / p, times * slope[rows, y] / p
        gw = x.T @ (up - low) / n + ridge * w / n
        gc = np.zeros(grades)
        for k in range(grades):
            gc[k] = (-(up[y == k]).sum() + (low[y == k + 1]).sum()) / n
        tail = np.cumsum(gc[::-1])[::-1]
        grad = np.concatenate([gw, [tail[0]], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    gaps = np.exp(theta[m + 1 :])
    return theta[:m], list(theta[m] + np.concatenate([[0.0], np.cumsum(gaps)]))


def learn(docs: DataFrame, labels: DataFrame, most: int = 10_000, top: int = 800, least_docs: int = 3,
          least_odds: float = 2.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Choose the features and fit the model on about ``most`` labelled documents."""
    harmless = Model({}, [20.0, 21.0, 22.0])
    marks = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic")))
    million = 1_000_000
    share = math.ceil(million * most / max(marks.count(), 1))
    sample = marks.where(F.pmod(F.xxhash64("id"), F.lit(million)) < share)
    known = sampled_texts(docs, sample, id_col, text_col).join(F.broadcast(sample), "id").where("text is not null")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return harmless

    def features(batches):
        for batch in batches:
            found = [list(tokens(t)) for t in batch.column(1).to_pylist()]
            names = [f for fs in found for f in fs]
            marks_ = np.repeat(batch.column(0).to_numpy(), [len(fs) for fs in found])
            yield pa.RecordBatch.from_arrays([pa.array(marks_, pa.int32()), pa.array(names, pa.string())],
                                             ["toxic", "feature"])

    counted = (known.select("toxic", "text").mapInArrow(features, "toxic int, feature string")
               .groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
               .where(F.col("a") >= least_docs))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (bad + 1 - a)) - F.log(b / (good + 1 - b))
    bound = odds - F.sqrt(1 / a + 1 / b)
    chosen = [r["feature"] for r in counted.withColumn("bound", bound).where(F.col("bound") > least_odds)
              .orderBy(F.desc("bound"), "feature").limit(top).collect()]
    if not chosen:
        return harmless
    finder = Model(dict.fromkeys(chosen, 1.0), [0.0] * GRADES)

    def vectors(batches):
        for batch in batches:
            hits = [finder.find(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(h) for h in hits], pa.list_(pa.string())),
                 pa.array([[float(v) for v in h.values()] for h in hits], pa.list_(pa.float64()))],
                ["toxic", "names", "counts"])

    rows = (known.select("toxic", "text")
            .mapInArrow(vectors, "toxic int, names array<string>, counts array<double>").collect())
    at = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(rows), len(at)), dtype=np.float32)
    for i, r in enumerate(rows):
        for f, n in zip(r["names"], r["counts"]):
            x[i, at[f]] = math.log1p(n)
    y = np.array([r["toxic"] for r in rows])
    strength = np.array([sum(1 for f in r["names"] if not f.endswith("-")) for r in rows])
    levels = np.quantile(strength[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (strength > levels[0]).astype(int) + (strength > levels[1]), 0)
    # documents without any feature differ in their grade only: one row for each grade, which counts as often
    some = x.any(axis=1)
    plain = np.bincount(grade[~some], minlength=GRADES + 1)
    x = np.concatenate([x[some], np.zeros((GRADES + 1, x.shape[1]), dtype=np.float32)])
    grade = np.concatenate([grade[some], np.arange(GRADES + 1)])
    weights, cuts = fit_cumulative(x, grade, np.concatenate([np.ones(some.sum()), plain]))
    return Model({f: float(weights[i]) for f, i in at.items() if abs(weights[i]) > 1e-6}, [float(c) for c in cuts])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic, rejected."""

    def run(batches):
        for batch in batches:
            found = [model.severity(model.find(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[1] >= 0.5 for f in found], pa.bool_())],
                ["doc_id", "severity", "p_toxic", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, p_toxic double, rejected boolean")


def keep_harmless(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns: a filter inside one pass over the rows."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [model.severity(model.find(t.as_py()))[1] < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
