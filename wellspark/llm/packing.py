"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk-synchronous rounds.

Method. Pieces are range-sorted by length and every piece gets its rank within its length (its place in its range plus
the counts of the ranges before). Open sequences are kept the same way, by the gap they have left and a rank within that
gap. One round is

1. a successor sweep from the longest waiting length to the shortest: each length takes the smallest gaps that hold
   it (:func:`successor_sweep`). The sweep works on *runs* of equal lengths and equal gaps, so it needs the number of
   rows per length and per gap only: at most ``capacity`` numbers each, whatever the size of the corpus;
2. conflict resolution by rank: several pieces that want the same gap class are dealt to its gaps in rank order, a
   gap taking as many equal pieces as it holds;
3. the gap update: a distributed join of pieces and gaps on (gap, rank) places the pieces, and all gaps that took
   something move to their new class with a new rank.

Pieces without a gap wait, but the longest of them open as many sequences as the waiting tokens need at least. Rounds
repeat until nothing waits. No step collects rows: the driver holds counts per length and the runs of one round
(bounded by the capacity), and only those runs are broadcast.

Edge cases: null text is an empty document (one piece holding just the end id); a null or repeated document id is
carried along and never used as a key; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspark.llm import chunks
from wellspark.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document's ids (text ids by the tokenizer as loaded from its file, without the special
    tokens it would add, then ``end_id``).

    Only documents longer than ``capacity`` are cut, into pieces of exactly ``capacity`` ids of which the first may be
    shorter. ``ids_crc32`` is the CRC of the piece's ids as unsigned little-endian 32-bit numbers.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        codec = chunks.codec(chunks.ByteLevel, tokenizer, True)
        for ids, texts in chunks.slices(batches):
            tokens, at = codec.encode(texts)
            at = at.tolist()
            rows = []
            for doc_id, low, high in zip(ids.to_pylist(), at, at[1:]):
                body = tokens[low:high].tobytes() + end
                n = len(body) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(body[4 * a : 4 * b]))
                         for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def ranked(rows: DataFrame, cls: str, order: list[str]) -> DataFrame:
    """Add ``rank``: 0, 1, 2, ... within each value of ``cls``, by a range sort.

    Rows are dealt to ranges of (value, hash of ``order``), so that a value that most rows share lies in many ranges, and
    are sorted there. A row's rank is its place among its value's rows of the range plus their number in the ranges
    before. Ranges follow each other, so there are at most as many (value, range) runs as values and ranges together:
    few enough to be broadcast. The sorted rows are a written table, as the places must not change between reads.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(cls).desc(), F.xxhash64(*order)]
    dealt = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by, *order)
    row_of_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(dealt.withColumns({"range_": F.spark_partition_id(), "place_": row_of_task}), "sorted")
    before = Window.partitionBy("cls_").orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)
    runs = (placed.groupBy(F.col(cls).alias("cls_"), F.col("range_").alias("r_"))
            .agg(F.count("*").alias("n_"), F.min("place_").alias("first_"))
            .withColumn("base_", F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")))
    joined = placed.join(F.broadcast(runs), (F.col(cls) == F.col("cls_")) & (F.col("range_") == F.col("r_")))
    return joined.select(*rows.columns, (F.col("base_") + F.col("place_")).alias("rank"))


def successor_sweep(waiting: dict[int, tuple[int, int]], gaps: dict[int, int]):
    """Match runs of equal lengths to runs of equal gaps, longest length first, smallest sufficient gap first.

    ``waiting`` maps a length to the [low, high) ranks that wait; ``gaps`` maps a gap to the number of sequences that
    have it, of ranks 0 to that number. Returns the moves (length, first item rank, items, gap, first gap rank, items
    per gap) and the item ranks still waiting. Each gap takes part in one move at most; of one length it takes as
    many as it holds, as best fit in descending order would do.
    """
    sizes = sorted(gaps, reverse=True)
    stack: list[list[int]] = []  # [gap, next rank, end rank], the smallest gap that is large enough on top
    moves, left, at = [], {}, 0
    for length in sorted(waiting, reverse=True):
        low, high = waiting[length]
        while at < len(sizes) and sizes[at] >= length:
            stack.append([sizes[at], 0, gaps[sizes[at]]])
            at += 1
        while low < high and stack:
            gap, nxt, end = stack[-1]
            per = gap // length
            take = min(end - nxt, (high - low) // per)  # gaps that are filled with `per` pieces
            if take:
                moves.append((length, low, take * per, gap, nxt, per))
            else:  # one gap takes the few that are left
                per, take = high - low, 1
                moves.append((length, low, per, gap, nxt, per))
            low += take * per
            stack[-1][1] += take
            if stack[-1][1] == end:
                stack.pop()
        if low < high:
            left[length] = (low, high)
    return moves, left


def openings(left: dict[int, tuple[int, int]], free: int, capacity: int) -> dict[int, tuple[int, int]]:
    """Of the waiting ranks, those that open a sequence of their own: the longest, as many as the waiting tokens need
    sequences at least beyond the ``free`` places of open gaps that the next sweep can still fill, and all that are
    longer than half a sequence (no two of them share one)."""
    need = max(0, -(-(sum(n * (b - a) for n, (a, b) in left.items()) - free) // capacity))
    need = max(need, sum(b - a for n, (a, b) in left.items() if 2 * n > capacity))
    opened = {}
    for length in sorted(left, reverse=True):
        a, b = left[length]
        take = min(b - a, need)
        if take:
            opened[length] = (a, a + take)
            need -= take
    return opened


def usable(moves, gaps: dict[int, int], left: dict[int, tuple[int, int]]) -> int:
    """Tokens that the gaps still hold after ``moves`` for the shortest waiting length or longer ones."""
    least, after = min(left, default=0), dict(gaps)
    for length, _, n, gap, _, per in moves:
        after[gap] -= n // per
        after[gap - per * length] = after.get(gap - per * length, 0) + n // per
    return sum(g * n for g, n in after.items() if g >= least)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of ``length`` 1 to ``capacity``; see the module's text.

    ``pieces`` needs the columns doc_id, piece, start, length, ids_crc32 as :func:`token_pieces` gives them.
    """
    spark = pieces.sparkSession
    raw = materialize(pieces, "pieces")
    items = materialize(ranked(raw, "length", ["doc_id", "piece", "start", "ids_crc32"]), "ranked")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    waiting = {n: (0, c) for n, c in counts.items()}  # at most `capacity` entries
    gaps, gap_rows, next_seq, placed = {}, None, 0, []
    out = pieces.columns
    while waiting:
        moves, waiting = successor_sweep(waiting, gaps)
        opened = openings(waiting, usable(moves, gaps, waiting), capacity)
        waiting = {n: (opened.get(n, (a, a))[1], b) for n, (a, b) in waiting.items()}
        waiting = {n: r for n, r in waiting.items() if r[0] < r[1]}
        sizes: dict[int, int] = {}  # the gap classes after this round

        def admitted(gap, n):
            sizes[gap] = sizes.get(gap, 0) + n
            return sizes[gap] - n

        starts, shifts = [], []
        for length, (a, b) in opened.items():
            starts.append((length, a, b, next_seq, capacity - length, admitted(capacity - length, b - a)))
            next_seq += b - a
        used: dict[int, int] = {}
        for length, _, n, gap, first, per in moves:
            taken = n // per
            used[gap] = max(used.get(gap, 0), first + taken)
            shifts.append((gap, first, first + taken, gap - per * length, admitted(gap - per * length, taken)))
        for gap, n in gaps.items():
            if used.get(gap, 0) < n:
                shifts.append((gap, used.get(gap, 0), n, gap, admitted(gap, n - used.get(gap, 0))))

        old = gap_rows
        heads = None
        if starts:
            runs = F.broadcast(spark.createDataFrame(
                starts, "l_ long, lo_ long, hi_ long, seq0_ long, gap long, rank0_ long"))
            mine = items.where(F.col("length").isin([s[0] for s in starts]))
            heads = (mine.join(runs, (F.col("length") == F.col("l_")) & (F.col("rank") >= F.col("lo_"))
                               & (F.col("rank") < F.col("hi_")))
                     .withColumn("nth_", F.col("rank") - F.col("lo_"))
                     .withColumn("sequence_id", F.col("seq0_") + F.col("nth_")))
            placed.append(heads.select(*out, "sequence_id", F.lit(0).cast("long").alias("offset")))
        if moves:
            runs = F.broadcast(spark.createDataFrame(
                moves, "l_ long, lo_ long, n_ long, g_ long, g0_ long, per_ long"))
            mine = items.where(F.col("length").isin(sorted({m[0] for m in moves})))
            dealt = (mine.join(runs, (F.col("length") == F.col("l_")) & (F.col("rank") >= F.col("lo_"))
                               & (F.col("rank") < F.col("lo_") + F.col("n_")))
                     .withColumn("nth_", F.col("rank") - F.col("lo_"))
                     .withColumn("to_", F.col("g0_") + F.expr("nth_ div per_"))
                     .withColumn("offset", capacity - F.col("g_") + F.col("nth_") % F.col("per_") * F.col("length")))
            seqs = old.select("sequence_id", F.col("gap").alias("gap_"), F.col("rank").alias("rank_"))
            joined = dealt.join(seqs, (F.col("g_") == F.col("gap_")) & (F.col("to_") == F.col("rank_")))
            placed.append(materialize(joined.select(*out, "sequence_id", "offset"), "placed"))
        if not waiting:
            break
        parts = []
        if shifts:
            runs = F.broadcast(spark.createDataFrame(
                shifts, "g_ long, lo_ long, hi_ long, to_gap_ long, rank0_ long"))
            moved = old.join(runs, (F.col("gap") == F.col("g_")) & (F.col("rank") >= F.col("lo_"))
                             & (F.col("rank") < F.col("hi_")) & (F.col("to_gap_") > 0))
            parts.append(moved.select("sequence_id", F.col("to_gap_").alias("gap"),
                                      (F.col("rank") - F.col("lo_") + F.col("rank0_")).alias("rank")))
        if heads is not None:
            parts.append(heads.where("gap > 0").select(
                "sequence_id", "gap", (F.col("nth_") + F.col("rank0_")).alias("rank")))
        gap_rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        gap_rows = materialize(gap_rows, "gaps")
        gaps = {g: n for g, n in sizes.items() if g > 0}
    if not placed:
        return items.select(*out, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    result = placed[0]
    for p in placed[1:]:
        result = result.unionByName(p)
    return result
