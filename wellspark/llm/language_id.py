"""Language identification by word-first backoff.

A known word scores every language by the negative log of its relative frequency there; a word that no language knows
is scored by its character n-grams instead, of the longest length of which at least one is known (n-grams run over the
word with a space at each end). A language that lacks a word or n-gram others know gets a fixed penalty. A document's
score per language is the mean over all its words; the smallest mean wins.

Learning is grouped counting over a sample of labelled documents with a documented bound per language
(``docs_per_lang``, by a hash of the id); of each language the ``top`` most frequent words and n-grams of each length
are kept, and of these only what the sample holds twice or more, as a single sighting is no frequency. So the model's
size depends on these parameters and the number of languages, not on the corpus. Prediction reads whole texts, row by
row.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be
learned. Null languages and null texts are not learned from. Ties go to the alphabetically first language. Ids are
carried along only; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
PENALTY = 7.0  # negative log10 of the frequency that an absent word or n-gram counts as
LONGEST = 6
CACHE_WORDS = 500_000
UNKNOWN = "und"


def learn(docs: DataFrame, train: Column, docs_per_lang: int = 3000, top: int = 20_000, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, int, str, float]]:
    """(language, n, gram, cost) rows: n = 0 for words, else the n-gram length; ``train`` selects the rows to use."""
    rows = (docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    million = 1_000_000
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(max(1, math.ceil(million * docs_per_lang / n))))
                         for k, n in sizes.items()])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(million)) < share)
    words = (sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("gram"))
             .groupBy("lang", "gram").agg(F.count("*").alias("n")))
    spaced = F.concat(F.lit(" "), "gram", F.lit(" "))
    pieces = F.expr(
        f"flatten(transform(sequence(1, {LONGEST}), k -> if(length(p) < k, array(), transform("
        "sequence(1, length(p) - k + 1), i -> struct(k as len, substr(p, i, k) as gram)))))")
    grams = (words.withColumn("p", spaced).select("lang", "n", F.explode(pieces).alias("g"))
             .groupBy("lang", F.col("g.len").alias("len"), F.col("g.gram").alias("gram")).agg(F.sum("n").alias("n")))
    counted = words.select("lang", F.lit(0).alias("len"), "gram", "n").unionByName(grams)
    total = counted.groupBy("lang", "len").agg(F.sum("n").alias("total"))
    place = Window.partitionBy("lang", "len").orderBy(F.desc("n"), "gram")
    kept = (counted.where((F.col("n") > 1)).withColumn("place", F.row_number().over(place))
            .where(F.col("place") <= top).join(F.broadcast(total), ["lang", "len"])
            .select("lang", "len", "gram", (-F.log10(F.col("n") / F.col("total"))).alias("cost")))
    return [tuple(r) for r in kept.collect()]


class Backoff:
    """Scores words for all languages; see the module's text."""

    def __init__(self, model: list[tuple[str, int, str, float]]):
        self.langs = sorted({m[0] for m in model})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for lang, n, gram, cost in model:
            row = self.tables[n].get(gram)
            if row is None:
                row = self.tables[n][gram] = np.full(len(at), PENALTY, dtype=np.float32)
            row[at[lang]] = cost
        self.rows: dict[str, int] = {}
        self.costs = np.empty((CACHE_WORDS, len(at)), dtype=np.float32)

    def cost(self, word: str) -> np.ndarray:
        known = self.tables[0].get(word)
        if known is not None:
            return known
        spaced = f" {word} "
        for n in range(min(LONGEST, len(spaced)), 0, -1):
            table = self.tables[n]
            found = [g for g in (table.get(spaced[i : i + n]) for i in range(len(spaced) - n + 1)) if g is not None]
            if found:
                return np.mean(found, axis=0)
        return np.full(len(self.langs), PENALTY, dtype=np.float32)

    def row(self, word: str) -> int:
        at = len(self.rows)
        self.costs[at] = self.cost(word)
        self.rows[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text and self.langs else []
        if not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        for a in range(0, len(words), CACHE_WORDS // 4):
            part = words[a : a + CACHE_WORDS // 4]
            if len(self.rows) > CACHE_WORDS - len(part):
                self.rows.clear()
            get, new = self.rows.get, self.row
            at = [get(w) for w in part]
            if None in at:
                at = [new(w) if get(w) is None else get(w) for w in part]
            total += self.costs[np.array(at)].sum(axis=0, dtype=np.float64)
        mean = total / len(words)
        best = int(mean.argmin())
        # confidence: the languages' likelihoods as if the text had at most 20 independent words
        odds = np.exp((mean[best] - mean) * math.log(10) * min(len(words), 20))
        return self.langs[best], float(1 / odds.sum())


def identify(docs: DataFrame, model: list[tuple[str, int, str, float]], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        backoff = Backoff(shared.value)
        for batch in batches:
            found = [backoff.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
