"""Quality rules learned as a decision list by sequential covering.

Rules for rejecting a document are learned one after another: a rule grows by adding the threshold condition with the
best FOIL gain on two thirds of the labelled documents still uncovered, is pruned on the other third (trailing
conditions go while that raises the rule's worth there), and is kept if it is right more often than not on the pruning
part. The documents it covers leave, and the next rule is learned. The list becomes one Spark expression: ordered
``when`` branches of comparisons over built-in statistics, so scoring is a plain projection of the scan.

Learning reads a sample of labelled documents of a documented bound (``most``, by a hash of the id), whose statistics
are computed by the same expressions; only those few numbers per sampled document reach the driver.

Edge cases: without labels the list is empty and only the base rules decide. Null labels are not learned from; a
document with several labels counts as low quality if any says so. Null and empty texts have no words and fail the
base rule of 50 words. Ids are carried along; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm.text_stats import features, sampled_texts, with_stats

Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold


def holds(row: dict, rule: list[Condition]) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in rule)


def counts(rows: list[dict], rule: list[Condition]) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if holds(r, rule)]
    return sum(hit), len(hit) - sum(hit)


def thresholds(rows: list[dict], feature: str, bins: int) -> list[float]:
    """At most ``bins`` cut points at equal ranks of the distinct values, between neighbouring values."""
    values = sorted({r[feature] for r in rows})
    step = max(1, (len(values) - 1) // bins)
    return [(a + b) / 2 for a, b in list(zip(values, values[1:]))[::step]]


def grow(rows: list[dict], names: list[str], bins: int, longest: int) -> list[Condition]:
    rule: list[Condition] = []
    covered = rows
    while len(rule) < longest:
        p0, n0 = counts(covered, [])
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for name in names:
            ordered = sorted((r[name], r["bad"]) for r in covered)
            for cut in thresholds(covered, name, bins):
                low = [bad for v, bad in ordered if v <= cut]
                p, n = sum(low), len(low) - sum(low)
                for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                    if pp:
                        g = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = (name, op, cut), g
        if best is None:
            break
        rule.append(best)
        covered = [r for r in covered if holds(r, [best])]
    return rule


def worth(rows: list[dict], rule: list[Condition]) -> float:
    p, n = counts(rows, rule)
    return (p - n) / (p + n) if p + n else -1.0


def learn_list(rows: list[dict], names: list[str], bins: int = 24, longest: int = 4, most_rules: int = 12):
    """Ordered rules for rejecting; ``rows`` hold the features, ``bad`` (0 or 1) and ``prune`` (bool)."""
    rules: list[list[Condition]] = []
    left = rows
    while len(rules) < most_rules and any(r["bad"] for r in left):
        growing, pruning = [r for r in left if not r["prune"]], [r for r in left if r["prune"]]
        rule = grow(growing, names, bins, longest)
        while len(rule) > 1 and worth(pruning, rule[:-1]) >= worth(pruning, rule):
            rule = rule[:-1]
        if not rule or worth(pruning, rule) <= 0 or worth(growing, rule) <= 0:
            break
        rules.append(rule)
        left = [r for r in left if not holds(r, rule)]
    return rules


def as_expression(rules: list[list[Condition]]) -> Column:
    """True for a document to keep: the first rule that holds rejects it, none keeps it."""
    known = features()
    verdict = None
    for rule in rules:
        hit = F.lit(True)
        for name, op, cut in rule:
            hit = hit & (known[name] <= F.lit(cut) if op == "<=" else known[name] > F.lit(cut))
        verdict = F.when(hit, F.lit(False)) if verdict is None else verdict.when(hit, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, most: int = 6000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", bins: int = 24, longest: int = 4, most_rules: int = 12) -> list[list[Condition]]:
    """Learn the decision list from at most about ``most`` labelled documents (quality 1: good, 0: bad): at most
    ``most_rules`` rules of ``longest`` conditions, whose thresholds are among ``bins`` quantiles of a statistic."""
    marks = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias("id")).agg((1 - F.min(label_col)).cast("int").alias("bad")))
    n = marks.count()
    million = 1_000_000
    share = math.ceil(million * most / max(n, 1))
    sample = marks.where(F.pmod(F.xxhash64("id"), F.lit(million)) < share)
    stats = with_stats(sampled_texts(docs, sample, id_col, text_col), "id", "text")
    known = features()
    rows = (stats.join(sample, F.col("doc_id") == F.col("id"))
            .select("bad", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("prune"),
                    *[c.alias(k) for k, c in known.items()]).collect())
    return learn_list([r.asDict() for r in rows], list(known), bins, longest, most_rules)


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed and kept."""
    stats = with_stats(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (stats.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & as_expression(rules))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "kept"))
