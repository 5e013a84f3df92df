"""Nearest trigger of each hit of the same source within a tolerance.

Both tables are repartitioned by source and a slab of time, triggers also into neighbouring slabs within the tolerance,
so that one source with most of the rows is spread over many tasks. Rows are sorted within partitions and one merge
pass walks both together, holding only the hits whose next trigger has not come yet and the trigger before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ticks import R, div, hit_time, trigger_time
from ..session import ship

#: Ticks of a slab.
SLAB = R
COLS = ("iog", "slab", "t", "is_hit", "seq", "word_idx", "tol")
OUT = pa.schema([("iog", pa.int32()), ("seq", pa.int64()), ("word_idx", pa.int32()), ("trigger_seq", pa.int64()), ("trigger_word_idx", pa.int32()), ("distance", pa.int64())])


def _pairs(col: dict[str, np.ndarray], reach: int, final: bool, unmatched: bool) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
    """Pairs of the hits of sorted rows; and what must wait for later rows: undecided hits and the trigger before them."""
    n = len(col["t"])
    at, iog, slab, t = np.arange(n), col["iog"], col["slab"], col["t"]
    hit, trigger = col["is_hit"], ~col["is_hit"]
    twin = np.zeros(n, bool)  # of triggers at one time the first in order counts
    twin[1:] = (iog[1:] == iog[:-1]) & (slab[1:] == slab[:-1]) & (t[1:] == t[:-1]) & trigger[1:] & trigger[:-1]
    before = np.maximum.accumulate(np.where(trigger & ~twin, at, -1))
    after = np.minimum.accumulate(np.where(trigger, at, n)[::-1])[::-1]
    never = np.iinfo(np.int64).max

    def distance(j: np.ndarray) -> np.ndarray:
        k = np.clip(j, 0, n - 1)
        d = np.where((j >= 0) & (j < n) & (iog[k] == iog) & (slab[k] == slab), np.abs(t[k] - t), never)
        return np.where(d <= col["tol"][k], d, never)

    hold = n
    if not final:
        waiting = np.flatnonzero(hit & (after == n) & (iog == iog[-1]) & (slab == slab[-1]) & (t[-1] - t <= reach))
        hold = int(waiting[0]) if len(waiting) else n
    d0, d1 = distance(before), distance(after)
    best, chosen = np.minimum(d0, d1), np.clip(np.where(d0 <= d1, before, after), 0, n - 1)
    give = hit & ((best < never) | unmatched) & (at < hold)
    j, no = chosen[give], best[give] == never
    out = [pa.array(iog[give], pa.int32()), pa.array(col["seq"][give], pa.int64()), pa.array(col["word_idx"][give], pa.int32()), pa.array(col["seq"][j], pa.int64(), mask=no), pa.array(col["word_idx"][j], pa.int32(), mask=no), pa.array(best[give], pa.int64(), mask=no)]
    keep = np.r_[before[hold - 1 : hold][before[hold - 1 : hold] >= 0], at[hold:]] if hold else at
    return pa.RecordBatch.from_arrays(out, schema=OUT), {c: v[keep] for c, v in col.items()}


def _merge(reach: int, unmatched: bool):
    """Merge pass over the sorted rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.empty(0, k) for c, k in zip(COLS, (np.int32, np.int64, np.int64, bool, np.int64, np.int32, np.int64))}
        last = {c: v[:0] for c, v in held.items()}
        for b in batches:
            if not b.num_rows:
                continue
            new = {c: b.column(c).to_numpy(zero_copy_only=False) for c in COLS}
            repeated = np.ones(b.num_rows, bool)
            for c, v in new.items():
                before = np.concatenate([last[c], v[:-1]]) if len(last[c]) else np.concatenate([v[:1], v[:-1]])
                repeated &= v == before
            repeated[0] &= len(last["t"]) > 0
            last = {c: v[-1:] for c, v in new.items()}
            col = {c: np.concatenate([held[c], new[c][~repeated]]) for c in COLS}
            if len(col["t"]):
                out, held = _pairs(col, reach, False, unmatched)
                yield out
        if len(held["t"]):
            yield _pairs(held, reach, True, unmatched)[0]

    return run


def nearest_triggers(hits: DataFrame, words: DataFrame, config: DataFrame, unmatched: bool = False) -> DataFrame:
    """(iog, seq, word_idx, trigger_seq, trigger_word_idx, distance): nearest T word of the same iog of each hit.

    Nearest before or after, at most post_us of the iog away; of two equally near the earlier one, of two at the same
    time the lower (seq, word_idx). Hits and triggers without a time or iog, and iogs without post_us, have no match;
    ``unmatched`` also gives the hits with a time that have none, with nulls. Repeated rows count once; of several
    settings of an iog the greatest post_us holds; an empty table gives no matches; other columns are ignored.
    """
    ship(hits.sparkSession)
    post = config.where("iog IS NOT NULL AND post_us >= 0").groupBy(F.col("iog").cast("int").alias("iog")).agg(F.max(F.floor(F.col("post_us") * 10)).cast("bigint").alias("tol"))
    reach = post.agg(F.max("tol")).first()[0]
    reach = 0 if reach is None else int(reach)
    key = [F.col(c).cast(k).alias(c) for c, k in (("iog", "int"), ("seq", "bigint"), ("word_idx", "int"))]
    named = "iog IS NOT NULL AND seq IS NOT NULL AND word_idx IS NOT NULL AND t IS NOT NULL"
    left = hits.select(*key, hit_time(F.col("timestamp"), F.col("receipt_timestamp"), F.col("message_seconds")).alias("t")).where(named)
    left = left.select("iog", div(F.col("t"), SLAB).alias("slab"), "t", F.lit(True).alias("is_hit"), "seq", "word_idx", F.lit(0).cast("bigint").alias("tol"))
    right = words.where("kind = 'T'").select(*key, trigger_time(F.col("aux"), F.col("header_second")).alias("t")).where(named).join(post, "iog")
    slabs = F.explode(F.sequence(div(F.col("t") - F.col("tol"), SLAB), div(F.col("t") + F.col("tol"), SLAB)))
    right = right.select("iog", slabs.alias("slab"), "t", F.lit(False).alias("is_hit"), "seq", "word_idx", "tol")
    both = left.unionByName(right).repartition("iog", "slab").sortWithinPartitions("iog", "slab", "t", "is_hit", "seq", "word_idx")
    return both.mapInArrow(_merge(reach, unmatched), "iog int, seq bigint, word_idx int, trigger_seq bigint, trigger_word_idx int, distance bigint")
