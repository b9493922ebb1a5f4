"""Periodic runs of words within each text, from maximal pairs of its LCP-interval tree.

A run is a stretch of consecutive words with smallest period q whose words q apart are equal, of length at least
``max(least, times * q)``, that no neighbouring word extends keeping q. A *maximal pair* is two places i < j with the
same next l words, different words before them and different words after those l: the stretch from i to j + l then has
the period j - i and cannot be extended. So the maximal pairs with ``l >= max(least - q, (times - 1) * q)`` are exactly
the runs (a run also shows as pairs at multiples of its period; the smallest counts), and no extension step is needed.

Per batch of texts:

1. Arrow numbers the words; suffixes are ranked by prefix doubling in NumPy over all texts of the batch, where words of
   different texts differ, and only suffixes that still share their rank go on. LCPs of neighbours come from the ranks
   of each doubling.
2. Suffixes that share fewer words than the shortest pair of a run needs (five, for runs of six) with any other are in
   no pair; the others form forests of LCP intervals, walked bottom-up. An interval of LCP l joins the lists of its children, the smaller into the larger,
   and reports pairs across children up to l / (times - 1) apart whose words before differ. The class lists of the
   words before are kept as one list in order of place: places that near share their next l words and hence a period,
   so that all of them but the first stand in one run and have one class. The class test is one comparison, and the
   work of a text of n words is O(n log n) steps besides what it reports.

Edge cases: null and empty texts have 0 words and no runs; words are maximal runs of bytes other than ASCII white space
(space, tab to carriage return); ids are carried (null and repeated ones too); other columns are ignored; texts of any
length are read whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import chunks

LEAST, TIMES = 6, 4
RUN = "struct<start:long,length:long,period:long>"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffixes in order, and per doubling (h, rank by the next h symbols; equal ranks are equal symbols)."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    steps, h = [], 1
    keys = symbols[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    rank = np.empty(n + 1, np.int32)  # one copy a doubling is kept
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        steps.append((h, rank.copy()))
        single = new & np.append(new[1:], True)
        shared = np.flatnonzero(~single)  # places of the order whose suffixes share their rank
        if not len(shared):
            return order, steps
        at = order[shared]
        first, then = rank[at], rank[np.minimum(at + h, n)]
        inside = np.lexsort((then, first))
        order[shared] = at = at[inside]
        first, then = first[inside], then[inside]
        differ = np.concatenate([[True], (first[1:] != first[:-1]) | (then[1:] != then[:-1])])
        new[shared] = differ
        rank[at] = np.maximum.accumulate(np.where(differ, shared, 0))
        h *= 2


def common_prefixes(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share, pair by pair."""
    length, n = np.zeros(len(a), np.int64), len(steps[0][1]) - 1
    for h, rank in reversed(steps):
        same = rank[np.minimum(a + length, n)] == rank[np.minimum(b + length, n)]
        same &= np.maximum(a, b) + length < n
        length += h * same
    return length


def join_children(x: list[int], y: list[int], lcp: int, before: list[int], apart: int, found: list) -> list[int]:
    """Report the maximal pairs (place, distance, lcp) between two children's places; the joined list of places."""
    if len(x) < len(y):
        x, y = y, x
    for p in y:
        low = bisect_left(x, p - apart)
        at = bisect_left(x, p, low)
        if low < at and before[x[low]] != before[p]:
            found.append((x[low], p - x[low], lcp))
        if at < len(x) and x[at] <= p + apart and before[x[at]] != before[p]:
            while at < len(x) and x[at] <= p + apart:
                found.append((p, x[at] - p, lcp))
                at += 1
    if len(y) < 32:
        for p in y:
            insort(x, p)
    else:
        x += y
        x.sort()
    return x


def maximal_pairs(places: list[int], lcps: list[int], before: list[int], times: int, found: list) -> None:
    """The pairs of one tree: ``lcps[k]`` is that of the suffixes at ``places[k]`` and ``places[k + 1]``."""
    stack, child = [], [places[0]]  # [lcp, places] of the open intervals, and their last child
    for place, lcp in zip(places[1:], lcps):
        while stack and stack[-1][0] > lcp:
            depth, others = stack.pop()
            child = join_children(others, child, depth, before, depth // (times - 1), found)
        if stack and stack[-1][0] == lcp:
            stack[-1][1] = join_children(stack[-1][1], child, lcp, before, lcp // (times - 1), found)
        else:
            stack.append([lcp, child])
        child = [place]
    while stack:
        depth, others = stack.pop()
        child = join_children(others, child, depth, before, depth // (times - 1), found)


def runs_of(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """The runs (start, length, period) of a sequence of symbols in order of start and period, as rows."""
    if times < 3:
        raise ValueError("periods of a near pair coincide from three repeats on")
    if len(symbols) < least:
        return np.zeros((0, 3), np.int64)
    order, steps = suffix_array(symbols)
    lcp = common_prefixes(order[:-1], order[1:], steps)
    shallowest = min(max(least - q, (times - 1) * q) for q in range(1, max(2, least)))
    deep = np.flatnonzero(lcp >= shallowest)
    if not len(deep):
        return np.zeros((0, 3), np.int64)
    breaks = np.flatnonzero(np.diff(deep) > 1) + 1
    lows, highs = deep[np.concatenate([[0], breaks])], deep[np.append(breaks - 1, len(deep) - 1)] + 1
    before = np.concatenate([[-1], symbols[:-1]]).tolist()
    found: list[tuple[int, int, int]] = []
    for low, high in zip(lows.tolist(), highs.tolist()):
        maximal_pairs(order[low : high + 1].tolist(), lcp[low:high].tolist(), before, times, found)
    if not found:
        return np.zeros((0, 3), np.int64)
    start, period, shared = np.array(found, np.int64).T
    length = period + shared
    fits = length >= np.maximum(least, times * period)
    start, length, period = start[fits], length[fits], period[fits]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    smallest = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(length) != 0)])[: len(start)]
    start, length, period = start[smallest], length[smallest], period[smallest]
    by = np.lexsort((period, start))
    return np.stack([start[by], length[by], period[by]], axis=1)


def collapsed(words: pa.Array, of_text: np.ndarray, n_texts: int, runs: np.ndarray) -> pa.Array:
    """Each text's words joined by a space, without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(gone)[:-1] == 0
    ends = np.searchsorted(of_text[kept], np.arange(n_texts + 1)).astype(np.int32)
    rows = words.filter(pa.array(kept)).cast(pa.binary()).cast(pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), rows), " ")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
              times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (structs of start, length, period in words, by start and period), collapsed (text)."""

    def run(batches):
        for ids, texts in chunks.slices(batches):
            data, offsets = chunks.flat(texts)
            space = chunks.SPACE[data]
            begins = chunks.text_starts(data, offsets)
            begins[1:] |= space[:-1]
            starts = np.flatnonzero(begins & ~space)
            of_text = np.searchsorted(offsets, starts, "right") - 1
            solid = np.concatenate([[0], np.cumsum(~space)])
            words = chunks.binaries(data[~space], np.append(solid[starts], solid[-1]))
            numbered = words.dictionary_encode()
            symbols = of_text * max(1, len(numbered.dictionary)) + numbered.indices.to_numpy().astype(np.int64)
            found = runs_of(symbols, least, times)
            first = np.searchsorted(of_text, np.arange(len(texts) + 1))
            owner = of_text[found[:, 0]]
            ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(found[:, 0] - first[owner]), pa.array(found[:, 1]),
                                               pa.array(found[:, 2])], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(ends), rows),
                 collapsed(words, of_text, len(texts), found)], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
