"""Streaming forms: clocks unrolled with state, trigger matching by an interval join, and period aggregates with replay.

Micro-batches may cut the stream anywhere: the rows of a source come out the same for any cut, provided that its
frames arrive in order of seq. State is kept per source, which bounds the parallelism of these stages by the sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Timing, Windows
from ..functions.ticks import R, div, hit_time
from ..operators.epochs import FRESH
from ..operators.late import PeriodLog
from ..session import ship

#: Store of keyed state; needed by the stateful operators.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
UNROLLED = "iog int, seq bigint, word_idx int, tick bigint, receipt_tick bigint, valid boolean, crossed boolean"


class Unroller(StatefulProcessor):
    """Offset and last step of a source, carried from batch to batch."""

    def __init__(self, period: int, sync_type: int) -> None:
        self.period, self.sync_type = period, sync_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clock", "offset bigint, prev bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        offset, prev = self.state.get() if self.state.exists() else (0, self.period)
        p = self.period
        w = pd.concat(list(rows)).drop_duplicates().sort_values(["seq", "word_idx"], kind="stable")
        aux = w["aux"].astype("float64").to_numpy()
        step = np.where(np.isnan(aux), 0, np.rint(np.nan_to_num(aux) / p) * p).astype(np.int64)
        sync = (w["kind"] == "S").to_numpy() & (w["io"] == self.sync_type).to_numpy()
        good = sync & ~np.isnan(aux) & (step > 0) & (np.abs(np.nan_to_num(aux) - step) <= max(1, p // 20))
        steps = np.where(good, step, 0)
        off = offset + np.cumsum(steps) - steps
        at = np.maximum.accumulate(np.where(good, np.arange(len(w)), -1))
        before = np.concatenate([[-1], at[:-1]])
        last = np.where(before >= 0, step[np.maximum(before, 0)], prev)
        d = (w["kind"] == "D").to_numpy()
        raw = w["raw"].to_numpy()[d].astype(np.int64)
        receipt = w["receipt"].to_numpy()[d].astype(np.int64)
        crossed = receipt < raw
        tick = raw % p + off[d] - np.where(crossed, last[d], 0)
        rec = off[d] + receipt
        valid = (off[d] > 0) & (tick >= 0) & (rec >= tick) & (receipt < 32 * p)
        self.state.update((int(offset + steps.sum()), int(step[at[-1]]) if len(at) and at[-1] >= 0 else int(prev)))
        yield pd.DataFrame({"iog": np.full(len(raw), key[0], np.int32), "seq": w["seq"].to_numpy()[d], "word_idx": w["word_idx"].to_numpy()[d].astype(np.int32), "tick": tick, "receipt_tick": rec, "valid": valid, "crossed": crossed})

    def close(self) -> None:
        pass


def unroll_stream(words: DataFrame, cfg: Timing = Timing()) -> DataFrame:
    """Ticks of the D words of a streaming word stream (iog, seq, word_idx, kind, io, receipt, aux, raw)."""
    ship(words.sparkSession)
    rows = words.select("iog", "seq", "word_idx", "kind", "io", "receipt", "aux", "raw")
    return rows.groupBy("iog").transformWithStateInPandas(Unroller(cfg.period, cfg.sync_type), UNROLLED, "append", "none")


ALIGNED = "iog int, seq bigint, word_idx int, tick bigint, second bigint, usable boolean, status string, offset_ticks bigint"


class Aligner(StatefulProcessor):
    """Alignment of a source by its PPS labels, one row a sync word: the last label, the last good observation and the pinned offset are carried."""

    FIELDS = ("after", "last_tick", "last_second", "fresh", "stored", "b_good", "b_candidate", "pinned")

    def __init__(self, period: int, sync_type: int) -> None:
        self.period, self.sync_type = period, sync_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alignment", "after bigint, last_tick bigint, last_second bigint, fresh bigint, stored bigint, b_good boolean, b_candidate bigint, pinned bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = dict(zip(self.FIELDS, self.state.get())) if self.state.exists() else dict.fromkeys(self.FIELDS) | {"after": 0, "b_good": False}
        w = pd.concat(list(rows)).drop_duplicates().sort_values(["seq", "word_idx"], kind="stable")
        alone = w.groupby("seq")["seq"].transform("size").to_numpy() == 1
        p, out = self.period, []
        for seq, word, second, aux, single in zip(w["seq"].tolist(), w["word_idx"].tolist(), w["second"].astype("Int64").tolist(), w["aux"].astype("Int64").tolist(), alone.tolist()):
            step = None if aux is pd.NA else round(aux / p) * p
            plausible = step is not None and step > 0 and abs(aux - step) <= max(1, p // 20)
            s["after"] += step if plausible else 0
            usable = plausible and single and second is not pd.NA and second > 0
            tick = s["after"] if plausible else None
            good = usable and (s["last_tick"] is None or (tick > s["last_tick"] and second > s["last_second"]))
            candidate = second * p - tick if usable else None
            follows = good and s["b_good"] and s["b_candidate"] == candidate and second - s["fresh"] <= FRESH
            if follows and s["pinned"] is None:
                s["pinned"] = candidate
            fits = good and (s["pinned"] is None or candidate == s["pinned"])
            status = "suspect" if not fits else "aligned" if follows else "warming"
            out.append((key[0], seq, word, tick, None if second is pd.NA else second, usable, status, s["pinned"] if status == "aligned" else None))
            if usable:
                s["last_tick"], s["last_second"] = tick, second
            if good:
                s["fresh"], s["stored"] = second, candidate
            s["b_good"], s["b_candidate"] = good, candidate
        self.state.update(tuple(s[f] for f in self.FIELDS))
        kinds = {"iog": "int32", "seq": "int64", "word_idx": "int32", "tick": "Int64", "second": "Int64", "offset_ticks": "Int64"}
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ALIGNED.split(", ")]).astype(kinds)

    def close(self) -> None:
        pass


def align_stream(words: DataFrame, cfg: Timing = Timing()) -> DataFrame:
    """Status and offset of each source after each of its selected S words, from a streaming word stream; the rows are those of ``epochs.align``."""
    ship(words.sparkSession)
    rows = words.where((F.col("kind") == "S") & (F.col("io") == cfg.sync_type)).select("iog", "seq", "word_idx", F.col("header_second").alias("second"), "aux")
    return rows.groupBy("iog").transformWithStateInPandas(Aligner(cfg.period, cfg.sync_type), ALIGNED, "append", "none")


def match_stream(hits: DataFrame, triggers: DataFrame, win: Windows) -> DataFrame:
    """Hits (iog, seq, word_idx, tick, ...) inside a window of a trigger (iog, source, tick), once for each source.

    Either side may come first. A hit or trigger is forgotten when the watermark, the history behind the newest event
    of both sides, has passed its window; the watermark is common to all sources.
    """
    pre, post, _ = win.ticks()
    keep = f"{win.history_seconds + (pre + post) / 1e7:.3f} seconds"
    stamp = lambda c: F.timestamp_micros(F.call_function("div", F.col(c), F.lit(10).cast("bigint")))
    h = hits.withColumn("at", stamp("tick")).withWatermark("at", keep)
    t = triggers.select(F.col("iog").alias("t_iog"), "source", F.col("tick").alias("t_tick"), stamp("tick").alias("t_at")).withWatermark("t_at", keep)
    slack = lambda n: F.expr(f"INTERVAL '{(n // 10 + 1) / 1e6:.6f}' SECOND")
    near = (F.col("iog") == F.col("t_iog")) & (F.col("at") >= F.col("t_at") - slack(pre)) & (F.col("at") <= F.col("t_at") + slack(post))
    exact = (F.col("tick") >= F.col("t_tick") - pre) & (F.col("tick") < F.col("t_tick") + post)
    joined = h.join(t, near & exact).drop("t_iog", "t_tick", "t_at")  # one event-time column may remain
    return joined.dropDuplicatesWithinWatermark(["iog", "seq", "word_idx", "source"])


PERIODS = "iog int, second bigint, hits bigint, total double, valued bigint, revision int"


class LatePeriods(StatefulProcessor):
    """Ordered log, snapshots and outputs of a source; late events restore a snapshot and replay the suffix."""

    def __init__(self, allowed: int) -> None:
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("log", "frontier bigint, period array<bigint>, value array<double>, snap_period array<bigint>, snap_at array<bigint>, out_period array<bigint>, out_n array<bigint>, out_total array<double>, out_valued array<bigint>, out_revision array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log, frontier = PeriodLog(self.allowed + 1), 0
        if self.state.exists():
            frontier, period, value, sp, sa, op, on, ot, ov, orev = self.state.get()
            log.period, log.value = np.array(period, np.int64), np.array(value, np.float64)
            log.snapshots = list(zip(sp, sa))
            log.out = {p: (n, t, v) for p, n, t, v in zip(op, on, ot, ov)}
            log.revision = dict(zip(op, orev))
        w = pd.concat(list(rows)).drop_duplicates().sort_values(["seq", "word_idx"], kind="stable")
        running = np.maximum(np.maximum.accumulate(w["clock"].to_numpy()), frontier)
        seq = w["seq"].to_numpy()
        running = running[np.searchsorted(seq, seq, "right") - 1]
        period, value = w["period"].to_numpy(), w["value"].to_numpy()
        ok = (period >= 0) & (running - period <= self.allowed)
        changed: set[int] = set()
        edges = np.r_[0, np.flatnonzero(np.diff(running)) + 1, len(running)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            changed.update(log.offer(period[a:b][ok[a:b]], value[a:b][ok[a:b]], int(running[b - 1]) + 1))
        frontier = int(running[-1])
        out = [(key[0], p, *log.out[p], log.revision[p]) for p in sorted(changed)]
        oldest = min([frontier - self.allowed, *log.period[:1].tolist()])
        live = [p for p in log.out if p >= oldest]  # others are final
        cols = list(zip(*((p, *log.out[p], log.revision[p]) for p in live))) or [[]] * 5
        self.state.update((frontier, log.period.tolist(), log.value.tolist(), [p for p, _ in log.snapshots], [a for _, a in log.snapshots], *(list(c) for c in cols)))
        yield pd.DataFrame(out, columns=["iog", "second", "hits", "total", "valued", "revision"]).astype({"iog": "int32", "second": "int64", "hits": "int64", "total": "float64", "valued": "int64", "revision": "int32"})

    def close(self) -> None:
        pass


def late_stream(hits: DataFrame, allowed: int = 3) -> DataFrame:
    """Period aggregates of a stream of hits in update mode: each row replaces the earlier one of its iog and second."""
    ship(hits.sparkSession)
    t = hit_time(F.col("timestamp"), F.col("receipt_timestamp"), F.col("message_seconds"))
    rows = hits.where("iog IS NOT NULL AND seq IS NOT NULL").select(
        F.col("iog").cast("int"), F.col("seq").cast("bigint"), F.coalesce(F.col("word_idx").cast("int"), F.lit(-1)).alias("word_idx"), F.greatest(F.coalesce(F.col("message_seconds").cast("bigint"), F.lit(0)), F.lit(0)).alias("clock"),
        F.coalesce(div(t, R), F.lit(-1)).alias("period"), F.coalesce(F.col("adc").cast("double"), F.lit(float("nan"))).alias("value"),
    )
    return rows.groupBy("iog").transformWithStateInPandas(LatePeriods(allowed), PERIODS, "update", "none")


def publish(stream: DataFrame, path: str, checkpoint: str, every: str = "100 milliseconds", once: bool = False):
    """Start a query that appends each micro-batch, marked with its number, to a table; readers pin a batch number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(write)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime=every)).start()
