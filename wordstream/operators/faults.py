"""Implausible readings by a hidden Markov model per source.

States are normal, spike, out of range and stuck, the last with a least duration: it is a chain of RUN phases, each of
which emits only the value before it. Emissions carry the hard bounds of the data. The state with the greatest
posterior of the forward-backward pass is the fault of a hit.

Sources are cut into slabs of time, as many as their rows ask for, and slabs are gathered in buckets of even size, so
that no task holds a whole source. A first pass over the buckets gives, for the few sources with more than one slab,
their value counts and edge rows; they are joined by source with windows over the slabs and meet the buckets in a
cogroup over the same shuffled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ticks import RAW_LIMIT, hit_time
from ..session import checkpoint, ship, shuffle_partitions

#: Fixed values of the fault rules.
TOP, RUN, LEAST, TIMES = 255, 20, 100, 12
#: Rows of a source in one slab, and rows of a bucket of slabs, on average.
SLAB, BUCKET = 1 << 17, 1 << 15
#: Rows on either side that a strip of rows sees, and rows of a strip. A row of another value with no stuck run around
#: it separates what is before it from what is after it; within a stuck run the weight of what lies beyond falls by
#: MOST_REPEAT / STAY_STUCK a row, so 64 rows are past the precision of a double.
EDGE, STRIP = 64, 256
#: Strips that are held in memory at once.
AT_ONCE = 1 << 10
#: Most sources with more than one slab that are broadcast; beyond, Spark joins them by a shuffle.
MOST_BROADCAST = 100_000
#: Model: chance to go to spike, to out of range and to stuck, to stay in stuck and in spike.
TO_SPIKE, TO_OUT, TO_STUCK, STAY_STUCK, STAY_SPIKE = 1e-3, 1e-3, 1e-3, 0.98, 0.2
#: A normal source is not expected to repeat itself with more than this chance.
MOST_REPEAT = 0.25
#: States of a posterior; the phases of stuck count as one.
NORMAL, SPIKE, OUT, STUCK = range(4)
#: Faults in the order in which the first that applies is taken, and the state of each.
FAULTS = {"impossible": OUT, "stuck": STUCK, "spike": SPIKE}
SOURCE = ("iog", "chip", "channel")
ROW = (*SOURCE, "slab", "timed", "t", "seq", "word_idx", "adc", "bad", "valued")


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Prior and transition matrix over normal, spike, out of range, and the phases of stuck; only the last phase may be left."""
    n = OUT + 1 + RUN
    move = np.zeros((n, n))
    leave = np.zeros(n)
    leave[[SPIKE, OUT, STUCK]] = TO_SPIKE, TO_OUT, TO_STUCK
    leave[NORMAL] = 1 - leave.sum()
    move[NORMAL] = move[OUT] = leave
    move[SPIKE] = leave * (1 - STAY_SPIKE)
    move[SPIKE, SPIKE] += STAY_SPIKE
    for k in range(RUN - 1):
        move[STUCK + k, STUCK + k + 1] = 1.0
    move[-1] = leave * (1 - STAY_STUCK)
    move[-1, -1] += STAY_STUCK
    return leave, move


def forward_backward(emit: np.ndarray, equal: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Posteriors of normal, spike, out of range and stuck for many sequences laid end to end.

    emit: (n, 3) likelihoods of the first three states; equal: whether a value is the one before it; first and last mark
    the ends of sequences. The rows are cut into strips that run side by side.
    """
    n = len(emit)
    strips = -(-n // STRIP)
    out = [_strips(emit, equal, first, last, np.arange(s, min(s + AT_ONCE, strips))) for s in range(0, strips, AT_ONCE)]
    return np.concatenate(out)[:n] if out else np.zeros((0, STUCK + 1))


def _strips(emit: np.ndarray, equal: np.ndarray, first: np.ndarray, last: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Posteriors of the rows of some strips."""
    n, strips = len(emit), len(which)
    prior, move = transitions()
    ends = np.zeros(len(prior))
    ends[[NORMAL, SPIKE, OUT, -1]] = 1.0  # a sequence cannot end before the least duration
    at = which[:, None] * STRIP + np.arange(-EDGE, STRIP + EDGE)[None, :]
    inside = (at >= 0) & (at < n)
    at = np.clip(at, 0, n - 1)
    width = at.shape[1]
    starts, stops = (first[at] | ~inside).T, (last[at] & inside).T
    e = np.empty((width, strips, len(prior)))
    e[:, :, :STUCK] = emit[at].transpose(1, 0, 2)
    e[:, :, STUCK] = np.where(e[:, :, OUT] > 0, 0.0, 1 / (TOP + 1))
    e[:, :, STUCK + 1 :] = equal[at].T[:, :, None]
    e[~inside.T] = 1.0
    kept = np.empty((STRIP, strips, len(prior)))
    a = np.tile(prior, (strips, 1))
    for k in range(width):
        a = a @ move
        a[starts[k]] = prior
        a *= e[k]
        a /= a.sum(1, keepdims=True)
        if EDGE <= k < EDGE + STRIP:
            kept[k - EDGE] = a
    b = np.ones((strips, len(prior)))
    back = move.T.copy()
    for k in range(width - 1, EDGE - 1, -1):
        if k < width - 1:
            b = (b * e[k + 1]) @ back
            b[starts[k + 1]] = 1.0
        b[stops[k]] = ends
        b /= b.sum(1, keepdims=True)
        if k < EDGE + STRIP:
            kept[k - EDGE] *= b
    post = np.concatenate([kept[:, :, :STUCK], kept[:, :, STUCK:].sum(2, keepdims=True)], 2)
    post /= post.sum(2, keepdims=True)
    return post.transpose(1, 0, 2).reshape(-1, STUCK + 1)


def emissions(adc: np.ndarray, bad: np.ndarray, count: np.ndarray, mid: np.ndarray, dev: np.ndarray) -> np.ndarray:
    """Likelihoods under normal, spike and out of range, with hard bounds: a value beyond TIMES deviations of a source with at least LEAST values is no normal one, one within is no spike."""
    sigma = np.maximum(1.4826 * dev, 0.05)
    away = np.abs(adc - mid)
    far = (away > TIMES * dev) & (count >= LEAST)
    normal = np.minimum(np.exp(-0.5 * np.minimum((away / sigma) ** 2, 400)) * 0.4 / np.maximum(sigma, 0.5), MOST_REPEAT) + 1e-12
    return np.stack([np.where(bad | far, 0.0, normal), np.where(far & ~bad, 1 / (TOP + 1), 0.0), bad.astype(float)], 1)


def middle(counts: np.ndarray) -> tuple[float, float]:
    """Middle value and typical deviation of a histogram over 0..255; of an even number the mean of the middle two."""
    def median(values: np.ndarray, weights: np.ndarray) -> float:
        c = np.cumsum(weights)
        n = int(c[-1])
        return (float(values[np.searchsorted(c, (n - 1) // 2, "right")]) + float(values[np.searchsorted(c, n // 2, "right")])) / 2

    v = np.flatnonzero(counts)
    m = median(v, counts[v])
    d = np.abs(v - m)
    o = np.argsort(d, kind="stable")
    return m, median(d[o], counts[v][o])


def _sorted(t: pa.Table) -> dict[str, np.ndarray]:
    """Rows of a bucket by source, slab and time, repeated rows once."""
    col = {c: t.column(c).to_numpy() for c in ROW}
    order = np.lexsort([col[c] for c in ("adc", "word_idx", "seq", "t", "timed", "slab", "channel", "chip", "iog")])
    col = {c: v[order] for c, v in col.items()}
    same = np.ones(max(len(order) - 1, 0), bool)
    for v in col.values():
        same &= v[1:] == v[:-1]
    keep = np.r_[np.ones(min(len(order), 1), bool), ~same]
    return {c: v[keep] for c, v in col.items()}


def _starts(col: dict[str, np.ndarray]) -> np.ndarray:
    """First row of each source and slab."""
    new = np.ones(len(col["iog"]), bool)
    new[1:] = False
    for c in (*SOURCE, "slab"):
        new[1:] |= col[c][1:] != col[c][:-1]
    return np.flatnonzero(new)


EDGES = "iog int, chip int, channel int, slab int, bucket int, counts array<bigint>, head array<int>, tail array<int>"
EDGES_ARROW = pa.schema([*((c, pa.int32()) for c in (*SOURCE, "slab", "bucket")), ("counts", pa.list_(pa.int64())), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])


def _edges(key: tuple, t: pa.Table) -> pa.Table:
    """Of each slab of a bucket: value counts, and the adc of its first and last timed rows."""
    col = _sorted(t)
    starts = _starts(col)
    out: dict[str, list] = {f: [] for f in EDGES_ARROW.names}
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(col["iog"])]):
        adc = col["adc"][a:b]
        timed = adc[col["timed"][a:b]]
        for c in (*SOURCE, "slab"):
            out[c].append(int(col[c][a]))
        out["bucket"].append(key[0].as_py())
        out["counts"].append(np.bincount(adc, minlength=TOP + 1).tolist())
        out["head"].append(timed[:EDGE].tolist())
        out["tail"].append(timed[-EDGE:].tolist())
    return pa.table(out, schema=EDGES_ARROW)


def _around(edges: DataFrame) -> DataFrame:
    """(source, slab, bucket, count, mid, dev, before, after): of each slab the statistics of its whole source and the timed adc around it."""
    by = Window.partitionBy(*SOURCE)
    order = by.orderBy("slab")
    # every slab with timed rows has at least one, so EDGE slabs to either side hold EDGE rows, if there are as many
    before = F.flatten(F.collect_list("tail").over(order.rowsBetween(-EDGE, -1)))
    after = F.flatten(F.collect_list("head").over(order.rowsBetween(1, EDGE)))
    last = F.slice(before, F.greatest(F.size(before) - EDGE + 1, F.lit(1)), F.lit(EDGE))
    total = edges.select(*SOURCE, F.posexplode("counts").alias("v", "n")).groupBy(*SOURCE, "v").agg(F.sum("n").alias("n")).groupBy(*SOURCE).agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "n"))), lambda x: x["n"]).alias("counts"))
    ends = edges.select(*SOURCE, "slab", "bucket", last.alias("before"), F.slice(after, 1, EDGE).alias("after"))
    return ends.join(total, list(SOURCE))


FLAGGED = pa.schema([("iog", pa.int32()), ("seq", pa.int64()), ("word_idx", pa.int32()), ("fault", pa.int32())])
#: Stands for a null in a key of a source.
NONE = -(1 << 31)


def _medians(v: np.ndarray, group: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the values of each group; of groups that lie end to end."""
    v = v[np.lexsort((v, group))]
    return (v[starts + (n - 1) // 2] + v[starts + n // 2]) / 2


def _flags(key: tuple, t: pa.Table, around: pa.Table) -> pa.Table:
    """Faulty hits of a bucket by the state with the greatest posterior."""
    col = _sorted(t)
    if not len(col["iog"]):
        return FLAGGED.empty_table()
    valued = col["valued"]
    part = {c: v[valued] for c, v in col.items()}
    starts = _starts(part)
    n = np.diff(np.r_[starts, len(part["iog"])])
    sid = np.repeat(np.arange(len(starts)), n)
    adc = part["adc"].astype(np.float64)
    count, mid = n.astype(np.int64), _medians(adc, sid, starts, n) if len(n) else np.zeros(0)
    dev = _medians(np.abs(adc - mid[sid]), sid, starts, n) if len(n) else np.zeros(0)
    given = {tuple(int(r[c]) for c in (*SOURCE, "slab")): r for r in around.to_pylist()}
    names = list(zip(*(part[c][starts].tolist() for c in (*SOURCE, "slab"))))
    edges: dict[int, tuple[list, list]] = {}
    for k in (k for k, name in enumerate(names) if name in given) if given else ():
        r = given[names[k]]
        counts = np.array(r["counts"], np.int64)
        count[k], (mid[k], dev[k]) = counts.sum(), middle(counts)
        edges[k] = (r["before"], r["after"])
    # the timed rows of each slab with the rows around it, then every row without a time for itself
    timed = part["timed"]
    order = np.flatnonzero(timed)
    pieces, owners, places = [], [], []
    done = 0
    cut = np.searchsorted(sid[order], np.arange(len(starts) + 1))
    for k, (before, after) in sorted(edges.items()):
        a, b = int(cut[k]), int(cut[k + 1])
        mine = order[done:a]
        rows = order[a:b]
        pieces += [part["adc"][mine], np.array(before, np.int32), part["adc"][rows], np.array(after, np.int32)]
        owners += [sid[mine], np.full(len(before) + len(rows) + len(after), k)]
        places += [mine, np.full(len(before), -1), rows, np.full(len(after), -1)]
        done = b
    mine = order[done:]
    value = np.concatenate([*pieces, part["adc"][mine]]).astype(np.int64)
    owner = np.concatenate([*owners, sid[mine]]).astype(np.int64)
    place = np.concatenate([*places, mine]).astype(np.int64)
    first = np.r_[True, owner[1:] != owner[:-1]][: len(value)]
    equal = np.r_[False, (value[1:] == value[:-1]) & ~first[1:]][: len(value)]
    alone = np.flatnonzero(~timed)
    outside = np.flatnonzero(~valued)
    emit = np.concatenate([
        emissions(value, (part["bad"][place] & (place >= 0)) if len(place) else np.zeros(0, bool), count[owner], mid[owner], dev[owner]),
        emissions(adc[alone], part["bad"][alone], count[sid[alone]], mid[sid[alone]], dev[sid[alone]]),
        np.tile([0.0, 0.0, 1.0], (len(outside), 1)),
    ])
    single = np.ones(len(alone) + len(outside), bool)
    first = np.r_[first, single]
    posterior = forward_backward(emit, np.r_[equal, ~single], first, np.r_[first[1:], True])
    state = np.full(len(col["iog"]), NORMAL)
    rows = np.flatnonzero(valued)
    best = posterior.argmax(1)
    state[rows[place[place >= 0]]] = best[: len(place)][place >= 0]
    state[rows[alone]] = best[len(place) : len(place) + len(alone)]
    state[outside] = best[len(place) + len(alone) :]
    hit = state != NORMAL
    place_of = np.zeros(STUCK + 1, np.int32)
    place_of[list(FAULTS.values())] = range(len(FAULTS))
    null = lambda c: pa.array(col[c][hit], FLAGGED.field(c).type, mask=col[c][hit] == NONE)
    return pa.table([null("iog"), null("seq"), null("word_idx"), pa.array(place_of[state[hit]])], schema=FLAGGED)


def _bad() -> Column:
    """Whether a reading cannot be: adc, raw time or channel outside of their range; nulls are none."""
    raw, adc, channel = (F.col(c).cast("bigint") for c in ("timestamp", "adc", "channel"))
    outside = lambda c, top: F.coalesce(~c.between(0, top), F.lit(False))
    return outside(adc, TOP) | outside(raw, RAW_LIMIT - 1) | outside(channel, 63)


def faulty_hits(hits: DataFrame) -> DataFrame:
    """Faulty hits as (iog, seq, word_idx, fault): impossible, stuck or spike.

    Nulls are no fault; hits of incomplete sources can only be impossible; hits without a time cannot be stuck; repeated
    rows count once; an empty table gives no rows; other columns are ignored.
    """
    spark = hits.sparkSession
    ship(spark)
    t = hit_time(F.col("timestamp"), F.col("receipt_timestamp"), F.col("message_seconds"))
    valued = F.coalesce(F.col("iog").isNotNull() & F.col("chip").isNotNull() & F.col("channel").between(0, 63) & F.col("adc").between(0, TOP), F.lit(False))
    whole = lambda c, kind, none: F.coalesce(F.col(c).cast(kind), F.lit(none).cast(kind)).alias(c)
    rows = hits.select(
        *(whole(c, "int", NONE) for c in SOURCE), t.alias("at"), whole("seq", "bigint", NONE), whole("word_idx", "int", NONE), whole("adc", "int", NONE), _bad().alias("bad"), valued.alias("valued"),
    ).where("bad OR valued").withColumn("mix", F.xxhash64("seq", "word_idx"))
    # sources with more rows than a slab: slabs as wide in time as their rows, on average, ask for
    sizes = checkpoint(rows.where("valued").groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")))
    n, many = (int(x or 0) for x in sizes.agg(F.sum("n"), F.count_if(F.col("n") > SLAB)).first())
    parts = shuffle_partitions(spark, n, 100_000)
    slabs = F.call_function("div", F.col("n") - 1, F.lit(SLAB).cast("bigint")) + 1
    large = sizes.where(F.col("n") > SLAB).select(*SOURCE, "lo", slabs.alias("slabs"), (F.call_function("div", F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)), slabs) + 1).alias("width"))
    of = F.when(F.col("slabs").isNull() | ~F.col("valued"), F.lit(0)).when(F.col("at").isNotNull(), F.call_function("div", F.col("at") - F.col("lo"), F.col("width")) + 1).otherwise(-1 - F.pmod(F.col("mix"), F.col("slabs")))
    cut = rows.join(F.broadcast(large) if many <= MOST_BROADCAST else large, list(SOURCE), "left").withColumn("slab", of.cast("int"))
    # rows of no source are spread by themselves
    bucket = F.pmod(F.when(F.col("valued"), F.xxhash64(*SOURCE, "slab")).otherwise(F.col("mix")), F.lit(max(8 * parts, -(-n // BUCKET)))).cast("int")
    placed = cut.select(*SOURCE, "slab", F.col("at").isNotNull().alias("timed"), F.coalesce("at", F.lit(0)).alias("t"), "seq", "word_idx", "adc", "bad", "valued", bucket.alias("bucket")).repartition(parts, "bucket")
    edges = placed.where("slab <> 0").groupBy("bucket").applyInArrow(_edges, EDGES)
    flagged = placed.groupBy("bucket").cogroup(_around(edges).groupBy("bucket")).applyInArrow(_flags, "iog int, seq bigint, word_idx int, fault int")
    # rows that differ under one name are one hit with the first of their faults
    return flagged.groupBy("iog", "seq", "word_idx").agg(F.element_at(F.array(*(F.lit(f) for f in FAULTS)), F.min("fault") + 1).alias("fault"))
