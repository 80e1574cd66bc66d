"""Queues of scans that wait to be sent: a cap, batches, failures that are counted, and a limit of tries.

An operation is a scan that is queued or the outcome of sending the queue's first batch. One rule (`apply`) serves a batch
table and a stream; a queue holds `cap` scans at most, so a task never holds more than that of any queue.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FATES = "queue long, item long, fate string, retries int, seq long"


@dataclass(frozen=True)
class Rules:
    """Scans a queue holds, scans sent at once, and failures after which a scan is dropped."""

    cap: int = 100
    batch: int = 50
    tries: int = 3


def apply(pending: list[list], op: str, item: int | None, at: float | None, ok: bool | None, rules: Rules = Rules()) -> list[tuple[int, str, int]]:
    """Changes pending, a list of [item, at, retries] in queued order; what leaves it: (item, fate, retries).

    A scan that finds the queue full evicts the one of the earliest time. A sending that did well takes the first batch
    out; one that failed counts against each scan of it, and those that failed `tries` times are dropped.
    """
    if op == "scan":
        gone = []
        if len(pending) >= rules.cap:
            oldest = min(range(len(pending)), key=lambda i: pending[i][1])
            out = pending.pop(oldest)
            gone = [(out[0], "evicted", out[2])]
        pending.append([item, at, 0])
        return gone
    sent = pending[: rules.batch]
    if ok:
        del pending[: rules.batch]
        return [(i, "sent", r) for i, _, r in sent]
    for x in sent:
        x[2] += 1
    pending[: rules.batch] = [x for x in sent if x[2] < rules.tries]
    return [(i, "dropped", r) for i, _, r in sent if r >= rules.tries]


def fates(operations: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """queue, item, fate (sent, evicted, dropped or pending), retries, seq of every scan of a table of operations.

    operations: queue, seq, op ('scan' or 'send'), item, at, ok. A queue's operations are taken in order of seq, as each
    rests on the one before; Spark sorts them, and a task streams through with one queue's scans in hand. A null time
    counts as the earliest, a null outcome as a failure; other ops, and those of no queue, do nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, pending, seq = None, [], 0
        names = [c.split()[0] for c in FATES.split(", ")]
        for b in batches:
            out: list[tuple] = []
            for q, seq_, op, item, at, ok in zip(*(b.column(c).to_pylist() for c in ("queue", "seq", "op", "item", "at", "ok"))):
                if q != queue:
                    out += [(queue, i, "pending", r, seq) for i, _, r in pending]
                    queue, pending = q, []
                seq = seq_
                out += [(q, i, fate, r, seq) for i, fate, r in apply(pending, op, item, at, ok, rules)]
            yield _rows(out, names)
        yield _rows([(queue, i, "pending", r, seq) for i, _, r in pending], names)

    known = operations.filter("queue is not null and op in ('scan', 'send')")
    plain = known.select(F.col("queue").cast("long"), F.col("seq").cast("long"), "op", F.col("item").cast("long"), F.coalesce(F.col("at").cast("double"), F.lit(float("-inf"))).alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return plain.repartition("queue").sortWithinPartitions("queue", "seq", "item").mapInArrow(run, FATES)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


class ScanQueue(StatefulProcessor):
    """The same over a stream. Scans that wait are a list state; a timer reports queues that still hold some."""

    def __init__(self, rules: Rules = Rules(), remind_ms: int | None = None):
        self.rules, self.remind_ms = rules, remind_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "item long, at double, retries int")

    def _held(self) -> list[list]:
        return [list(x) for x in self.pending.get()] if self.pending.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue, pending, out = key[0], self._held(), []
        operations = pd.concat(list(rows)).sort_values(["seq", "item"], kind="stable")
        for seq, op, item, at, ok in operations[["seq", "op", "item", "at", "ok"]].itertuples(index=False):
            item, at = (None if pd.isna(item) else int(item)), (float("-inf") if pd.isna(at) else float(at))
            out += [(queue, i, fate, r, int(seq)) for i, fate, r in apply(pending, op, item, at, bool(ok) and not pd.isna(ok), self.rules)]
        if pending:
            self.pending.put([tuple(x) for x in pending])
            if self.remind_ms is not None and not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.remind_ms)
        else:
            self.pending.clear()
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending = self._held()
        if pending:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.remind_ms)
        yield _frame([(key[0], i, "due", r, -1) for i, _, r in pending[: self.rules.batch]])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = dict(zip((c.split()[0] for c in FATES.split(", ")), ("int64", "int64", "object", "int32", "int64")))
    return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)


def fates_stream(operations: DataFrame, rules: Rules = Rules(), remind_ms: int | None = None) -> DataFrame:
    """What leaves the queues of a stream of operations; those that wait stay in its state.

    remind_ms reports a queue's next batch (fate 'due') whenever it has waited so long; such a query goes on without data
    and is for a processing-time trigger. The session needs the RocksDB state store. Operations of one micro-batch are
    taken in order of seq.
    """
    known = operations.filter("queue is not null and op in ('scan', 'send')").withColumn("queue", F.col("queue").cast("long"))
    return known.groupBy("queue").transformWithStateInPandas(ScanQueue(rules, remind_ms), FATES, "append", "processingTime" if remind_ms is not None else "none")
