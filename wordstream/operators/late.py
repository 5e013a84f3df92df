"""Per-period aggregates of late and out-of-order events by checkpoint and replay.

Arrival order of a key is cut into blocks of equal length. A first pass takes the greatest clock of each block; the
running maximum over the earlier blocks is the frontier that a block starts from, so that blocks run in parallel and
a key with most of the rows is spread over many tasks. A block also gets the events before it that can still be
corrected, which are the log of the checkpoint that it starts from. Within a block the ordered state is snapshotted at
intervals; events older than the latest snapshot restore the one before their period, the sorted suffix is replayed,
and the affected outputs are replaced. The output of a period is that of the last block that changed it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ticks import R, div, hit_time
from ..session import checkpoint, ship, shuffle_partitions

#: Arrival positions (frames) of one key in one block.
BLOCK = 1 << 12
#: Most blocks whose ends are broadcast, a few MB; beyond, Spark joins them by a shuffle.
MOST_BROADCAST = 200_000
#: Period of an event without a time.
NEVER = -(1 << 63)


class PeriodLog:
    """Ordered state of one key: period outputs, snapshots of the position in the sorted log, and the log itself.

    ``offer`` takes a batch of accepted events in arrival order. Events not older than the last snapshot extend the
    log; older ones restore the snapshot before their period and the suffix after it is sorted and replayed.
    """

    def __init__(self, keep: int) -> None:
        self.keep = keep  # periods behind the frontier that can still change
        self.period = np.empty(0, np.int64)
        self.value = np.empty(0, np.float64)
        self.snapshots: list[tuple[int, int]] = []  # (first period after the snapshot, log length before it)
        self.out: dict[int, tuple[int, float, int]] = {}
        self.revision: dict[int, int] = {}

    def resume(self, period: np.ndarray, value: np.ndarray, frontier: int) -> None:
        """Start from the checkpoint of an earlier block: its events that can still be corrected, their outputs, and a snapshot before each of their periods."""
        order = np.argsort(period, kind="stable")
        self.period, self.value = period[order], value[order]
        if len(order):
            self._replay(0)
        self.snapshots = [(p, int(np.searchsorted(self.period, p, "left"))) for p in range(frontier - self.keep + 1, frontier + 2)]

    def arrive(self, period: np.ndarray, value: np.ndarray, running: np.ndarray) -> np.ndarray:
        """Apply or reject each event of a batch in arrival order, by the frontier at its arrival: 0 on time, 1 late, 2 too late and rejected."""
        late = running - period
        outcome = np.where(late >= self.keep, 2, np.where(late >= 1, 1, 0))
        ok = outcome < 2
        self.offer(period[ok], value[ok], int(running[-1]) + 1)
        return outcome

    def offer(self, period: np.ndarray, value: np.ndarray, frontier: int) -> list[int]:
        """Apply one batch, replace the affected outputs and take a snapshot at the frontier; returns replaced periods."""
        if len(period):
            oldest, cut = int(period.min()), 0
            while self.snapshots and self.snapshots[-1][0] > oldest:
                self.snapshots.pop()  # it already holds later periods
            if self.snapshots:
                cut = self.snapshots[-1][1]
            suffix = np.concatenate([self.period[cut:], period])
            values = np.concatenate([self.value[cut:], value])
            order = np.argsort(suffix, kind="stable")
            self.period = np.concatenate([self.period[:cut], suffix[order]])
            self.value = np.concatenate([self.value[:cut], values[order]])
            replaced = self._replay(cut)
        else:
            replaced = []
        self._snapshot(frontier)
        return replaced

    def _replay(self, cut: int) -> list[int]:
        periods, start, n = np.unique(self.period[cut:], return_index=True, return_counts=True)
        known = ~np.isnan(self.value[cut:])
        sums = np.add.reduceat(np.where(known, self.value[cut:], 0.0), start)
        with_value = np.add.reduceat(known.astype(np.int64), start)
        changed = []
        for p, k, s, v in zip(periods.tolist(), n.tolist(), sums.tolist(), with_value.tolist()):
            if self.out.get(p) != (k, s, v):
                self.out[p] = (k, s, v)
                self.revision[p] = self.revision.get(p, -1) + 1
                changed.append(p)
        return changed

    def _snapshot(self, frontier: int) -> None:
        """Position of the first period that the frontier has not passed; older snapshots than ``keep`` are dropped."""
        at = int(np.searchsorted(self.period, frontier, "left"))
        self.snapshots.append((frontier, at))
        final = [s for s in self.snapshots if s[0] <= frontier - self.keep]
        if len(final) > 1:  # all before the last of these can't change any more
            drop = final[-1][1]
            self.snapshots = [(p, k - drop) for p, k in self.snapshots[len(final) - 1 :]]
            self.period, self.value = self.period[drop:], self.value[drop:]


def _distinct(t: pa.Table) -> dict[str, np.ndarray]:
    """Events in order of arrival, repeated rows once."""
    col = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("seq", "word_idx", "clock", "period", "value")}
    order = np.lexsort((col["value"], col["period"], col["clock"], col["word_idx"], col["seq"]))
    col = {c: v[order] for c, v in col.items()}
    same = np.ones(max(len(order) - 1, 0), bool)
    for v in col.values():
        same &= (v[1:] == v[:-1]) | ((v[1:] != v[1:]) & (v[:-1] != v[:-1]))
    keep = np.r_[np.ones(min(len(order), 1), bool), ~same]
    return {c: v[keep] for c, v in col.items()}


def _block(every: int, allowed: int, events: bool):
    """Body of one block: the checkpoint it starts from, then checkpoint and replay of each interval of arrival time, which is at most the allowed lateness."""

    def run(key: tuple, t: pa.Table, before: pa.Table) -> pa.Table:
        iog = key[0].as_py()
        col, state = _distinct(t), _distinct(before)
        carry = int(state["clock"].max(initial=0))
        seq = col["seq"]
        running = np.maximum(np.maximum.accumulate(col["clock"]) if len(seq) else col["clock"], carry)
        if len(seq):
            running = running[np.searchsorted(seq, seq, "right") - 1]  # all words of a frame arrive together
        log = PeriodLog(allowed + 1)
        known = state["period"] != NEVER
        log.resume(state["period"][known], state["value"][known], carry)
        timed = col["period"] != NEVER
        seq, word = seq[timed], col["word_idx"][timed]
        period, value, arrival = col["period"][timed], col["value"][timed], running[timed]
        outcome = np.zeros(len(period), np.int64)
        step = arrival // max(1, min(every, allowed))
        edges = np.r_[0, np.flatnonzero(np.diff(step)) + 1, len(step)] if len(step) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            outcome[a:b] = log.arrive(period[a:b], value[a:b], arrival[a:b])
        if events:
            hit = outcome > 0
            return pa.table({"iog": pa.array(np.full(hit.sum(), iog), pa.int32()), "seq": seq[hit], "word_idx": pa.array(word[hit], pa.int32()), "outcome": np.where(outcome[hit] == 1, "late", "too_late").astype(object)}, schema=EVENTS)
        of = [dict(zip(*(x.tolist() for x in np.unique(period[outcome == k], return_counts=True)))) for k in range(3)]
        periods = sorted(of[0].keys() | of[1].keys() | of[2].keys())
        out = [log.out[p] if p in of[0] or p in of[1] else (None, None, None) for p in periods]  # only rejected events change nothing
        cols = [[iog] * len(periods), [key[1].as_py()] * len(periods), periods, *(list(x) for x in zip(*out)), *([of[k].get(p, 0) for p in periods] for k in (1, 2))] if periods else [[]] * len(PERIODS)
        return pa.table([pa.array(v, f.type) for v, f in zip(cols, PERIODS)], schema=PERIODS)

    return run


EVENTS = pa.schema([("iog", pa.int32()), ("seq", pa.int64()), ("word_idx", pa.int32()), ("outcome", pa.string())])
PERIODS = pa.schema([("iog", pa.int32()), ("block", pa.int64()), ("period", pa.int64()), ("n", pa.int64()), ("total", pa.float64()), ("valued", pa.int64()), ("late", pa.int64()), ("too_late", pa.int64())])


def _apply(hits: DataFrame, allowed: int, block: int, body, schema: str) -> DataFrame:
    """Run ``body`` over each (iog, block of arrival) with the state it starts from: the frontier, and the events of earlier blocks that can still be corrected."""
    ship(hits.sparkSession)
    t = hit_time(F.col("timestamp"), F.col("receipt_timestamp"), F.col("message_seconds"))
    clock = F.greatest(F.coalesce(F.col("message_seconds").cast("bigint"), F.lit(0)), F.lit(0))
    never = F.lit(NEVER).cast("bigint")
    rows = hits.where("iog IS NOT NULL AND seq IS NOT NULL").select(
        F.col("iog").cast("int").alias("iog"), div(F.col("seq").cast("bigint"), block).alias("block"), F.col("seq").cast("bigint").alias("seq"), F.coalesce(F.col("word_idx").cast("int"), F.lit(-1)).alias("word_idx"),
        clock.alias("clock"), F.coalesce(div(t, R), never).alias("period"), F.coalesce(F.col("adc").cast("double"), F.lit(float("nan"))).alias("value"),
    )
    by = Window.partitionBy("iog").orderBy("block")
    tops = checkpoint(rows.groupBy("iog", "block").agg(F.max("clock").alias("top"), F.count(F.lit(1)).alias("n")))  # a row a block
    frontier = tops.select("iog", "block", F.coalesce(F.max("top").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"), F.max("top").over(by).alias("end"))
    n, blocks = (int(x or 0) for x in tops.agg(F.sum("n"), F.count(F.lit(1))).first())
    parts = shuffle_partitions(hits.sparkSession, n)
    ends = frontier.select("iog", "block", "end")
    start = frontier.select("iog", "block", F.lit(-1).cast("bigint").alias("seq"), F.lit(-1).alias("word_idx"), F.col("carry").alias("clock"), never.alias("period"), F.lit(float("nan")).alias("value"))
    # an event whose second is no more than the lateness behind the end of its block was accepted there, and is state of each later block that starts as near to it
    tail = rows.join(F.broadcast(ends) if blocks <= MOST_BROADCAST else ends, ["iog", "block"]).where(F.col("period") + allowed >= F.col("end"))
    near = tail.withColumn("carry", F.explode(F.sequence(F.col("end"), F.col("period") + allowed))).withColumnRenamed("block", "own")
    state = near.join(frontier.select("iog", "block", "carry"), ["iog", "carry"]).where("block > own").select(*start.columns)
    left, right = rows.repartition(parts, "iog", "block"), start.unionByName(state).repartition(parts, "iog", "block")
    return left.groupBy("iog", "block").cogroup(right.groupBy("iog", "block")).applyInArrow(body, schema)


def late_events(hits: DataFrame, allowed: int = 3, block: int = BLOCK, every: int = 1) -> DataFrame:
    """Each hit that arrives at least one second after its own second, as 'late' (applied) or 'too_late' (cut off) by the replaying pass.

    Rows without iog or seq are left out; rows without a hit time move the frontier by their header second only;
    repeated rows count once; an empty table gives no rows; other columns of hits are ignored.
    """
    return _apply(hits, allowed, block, _block(every, allowed, True), "iog int, seq bigint, word_idx int, outcome string")


def late_periods(hits: DataFrame, allowed: int = 3, block: int = BLOCK, every: int = 1) -> DataFrame:
    """Hits and mean adc of each iog and second of hit time, corrected by hits up to ``allowed`` seconds late.

    ``late_hits`` of them came late; ``too_late_hits`` came later and are left out. A second with only hits that
    came too late has no row. The mean is over the hits that have an adc, and null without any.
    """
    parts = _apply(hits, allowed, block, _block(every, allowed, False), "iog int, block bigint, period bigint, n bigint, total double, valued bigint, late bigint, too_late bigint")
    # the last block that applied an event to a period replaces what earlier ones gave
    newest = F.max_by(F.struct("n", "total", "valued"), F.when(F.col("n").isNotNull(), F.col("block"))).alias("out")
    total = parts.groupBy("iog", "period").agg(newest, F.sum("late").alias("late"), F.sum("too_late").alias("too_late")).select("iog", "period", "out.*", "late", "too_late")
    return total.where("n > 0").select("iog", F.col("period").alias("second"), F.col("n").alias("hits"), F.when(F.col("valued") > 0, F.col("total") / F.col("valued")).alias("mean_adc"), F.col("late").alias("late_hits"), F.col("too_late").alias("too_late_hits"))
