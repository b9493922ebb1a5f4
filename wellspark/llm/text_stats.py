"""Per-document statistics of whole texts as built-in column expressions (no Python on the executors).

Words are runs of characters other than space and U+0009 to U+000D. A null text has no words and no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words of a text; an array without entries for a text that has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_words(words: str) -> str:
    """SQL for the number of words in 3-word windows that occur twice or more, the first occurrence included.

    Only a text with fewer distinct windows than windows is looked at further: its windows are sorted together with
    their places, equal neighbours are the repeated ones, and the words they cover are counted run by run (a window
    adds the words behind the end of the window before it).
    """
    windows = f"transform(sequence(0, size({words}) - 3), i -> concat_ws(' ', slice({words}, i + 1, 3)))"
    placed = f"array_sort(transform({windows}, (w, i) -> struct(w as w, i as i)))"
    equal = ("(i > 0 and element_at(s, i).w = x.w) or (i + 1 < size(s) and element_at(s, i + 2).w = x.w)")
    # `transform(array(..), s -> ..)` names the sorted array, so that it is made once
    places = f"flatten(transform(array({placed}), s -> transform(filter(s, (x, i) -> {equal}), x -> x.i)))"
    covered = (f"aggregate(array_sort({places}), named_struct('n', 0L, 'end', -1), "
               "(a, p) -> named_struct('n', a.n + (p + 3 - greatest(a.end, p)), 'end', p + 3), a -> a.n)")
    return (f"case when size({words}) < 4 then 0L "
            f"when size(array_distinct({windows})) = size({words}) - 2 then 0L else {covered} end")


def sampled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the sampled ids (column ``id``, of a bounded number, so that it may be broadcast). An id that
    several rows have stands once, with its least text, so that the rows are bounded by the sample too."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(sample.select("id")), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_key: bool = False) -> DataFrame:
    """doc_id (``keep_key``: of any type, as it is), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_upper, n_chars."""
    key = F.col(id_col) if keep_key else F.col(id_col).cast("long")
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    full = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    arrays = rows.withColumn("w", words_of(F.col("t"))).withColumn("l", full)
    without = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    return arrays.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(repeated_words("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        without(r"\p{Lu}+").cast("long").alias("n_upper"),
        F.length("t").cast("long").alias("n_chars"),
    )


def ratio(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def features() -> dict[str, Column]:
    """What learners see, over :func:`with_stats`; ratios, so that a very long text is no outlier."""
    return {
        "log_words": F.log1p("n_words"),
        "word_length": F.least(ratio("word_chars", "n_words"), F.lit(50.0)),
        "symbols": ratio("n_symbols", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "distinct": ratio("n_distinct", "n_words"),
        "upper": ratio("n_upper", "word_chars"),
    }
