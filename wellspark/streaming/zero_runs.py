"""ST4 by zero runs: a session reaches from the start of one run of zero readings to the start of the next one.

The batch rule (``operators.ppg``): a run starts at a zero reading whose predecessor is none; a segment reaches from one
start to the next, both included. On a stream, rows of a key wait in its state until the watermark says that nothing
earlier can come, and are then walked in order of (time, tie). What the walk carries is one small value per key: whether
the last row was zero, and the open session's start, rows and sum. Each micro-batch's rows are one packed element of
the waiting list, so the state is read and written per batch and not per row; it holds the rows of the delay, or of one
micro-batch if that is longer (``maxFilesPerTrigger`` / ``maxBytesPerTrigger`` of the source bound it).

Rows without a time have no place on the stream and are left out. NULL keys are a key of their own; a NULL value adds
nothing to the sum; rows of equal time are ordered by ``tie``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROW = np.dtype([("us", "<i8"), ("tie", "<i8"), ("zero", "?"), ("value", "<f8")])
OPEN = "zero boolean, start_us long, start_tie long, n long, total double"
SESSION = "start_us long, start_tie long, end_us long, end_tie long, n long, total double"


def walk(rows: np.ndarray, carried: tuple) -> tuple[list[tuple], tuple]:
    """The sessions that ``rows`` (in order) close, and what is carried on: (last row zero, start, tie, rows, sum)."""
    zero, start, tie, n, total = carried
    before = np.concatenate([[bool(zero)], rows["zero"][:-1]])
    values = np.nan_to_num(rows["value"], nan=0.0)
    cuts = np.flatnonzero(rows["zero"] & ~before)
    closed, at = [], 0
    for cut in cuts.tolist():
        if start is not None:
            part = values[at : cut + 1]
            closed.append((start, tie, int(rows["us"][cut]), int(rows["tie"][cut]), n + len(part),
                           total + float(part.sum())))
        start, tie, n, total, at = int(rows["us"][cut]), int(rows["tie"][cut]), 1, float(values[cut]), cut + 1
    if start is not None:
        n, total = n + len(rows) - at, total + float(values[at:].sum())
    return closed, (bool(rows["zero"][-1]) if len(rows) else zero, start, tie, n, total)


class ZeroRuns(StatefulProcessor):
    """Keys' columns, then :data:`SESSION`, one row per closed session."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows, timerValues):
        parts = []
        for part in rows:
            packed = np.zeros(len(part), ROW)
            for c in ("us", "tie"):
                packed[c] = part[c].to_numpy()
            packed["zero"], packed["value"] = part["zero"].fillna(False).to_numpy(bool), part["value"].to_numpy(float)
            parts.append(packed)
        new = np.concatenate(parts) if parts else np.zeros(0, ROW)
        if len(new):
            self.waiting.appendValue((new.tobytes(),))
            self.wake(int(new["us"].min()))
        yield from ()

    def wake(self, us: int) -> None:
        """Come back when the watermark has passed the earliest waiting row."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        parts = [np.frombuffer(packed, ROW) for (packed,) in self.waiting.get()]
        if not parts:  # a second timer of the same rows
            return
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["tie"], rows["us"]))]
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        ready = int(np.searchsorted(rows["us"], limit, "left"))
        closed, carried = walk(rows[:ready], tuple(self.open.get() or (False, None, None, 0, 0.0)))
        self.open.update(carried)
        self.waiting.clear()
        if ready < len(rows):
            self.waiting.put([(rows[ready:].tobytes(),)])
            self.wake(int(rows["us"][ready]))
        if closed:
            out = pd.DataFrame(closed, columns=["start_us", "start_tie", "end_us", "end_tie", "n", "total"])
            for i, name in enumerate(self.keys):
                out.insert(i, name, [key[i]] * len(out))
            yield out

    def close(self) -> None:
        pass


def zero_run_sessions(stream: DataFrame, keys: Sequence[str], ts: str, tie: str, is_zero: Column, value: str,
                      delay: str = "1 hour") -> DataFrame:
    """Closed sessions: keys, session_start, start_tie, session_end, end_tie, n (rows, both starts included), total.

    Sessions appear once the watermark has passed the start that closes them; the last, unclosed one of a key is not a
    session, as in the batch rule.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(
        *keys, ts, F.unix_micros(ts).alias("us"), F.col(tie).cast("long").alias("tie"),
        F.coalesce(is_zero, F.lit(False)).alias("zero"), F.col(value).cast("double").alias("value"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + SESSION
    found = rows.groupBy(*keys).transformWithStateInPandas(ZeroRuns(keys), schema, "Append", "EventTime")
    return found.select(*keys, F.timestamp_micros("start_us").alias("session_start"), "start_tie",
                        F.timestamp_micros("end_us").alias("session_end"), "end_tie", "n", "total")
