"""Operators of the general data problems against brute force, on random rows with nulls, ties, repeats and a hot address."""

import random
from collections import defaultdict
from statistics import median

import pytest
from conftest import HITS, hit_tick, random_hits
from pyspark.sql import functions as F

from wordstream.operators import faults, grid, heavy, late

R = 10_000_000


def lateness(rows):
    out, rows = [], set(rows)
    for r in rows:
        t = hit_tick(r[7], r[8], r[9])
        if t is None:
            continue
        arrival = max([x[9] for x in rows if x[0] == r[0] and x[1] <= r[1] and x[9] is not None] + [0])
        out.append((r, t // R, arrival - t // R))
    return out


@pytest.mark.parametrize("block", [4, 16384])
def test_late(make_hits, rows_of, block):
    rows = random_hits(random.Random(block), 400)
    df = make_hits(rows)
    want = sorted((r[0], r[1], r[2], "late" if d <= 3 else "too_late") for r, _, d in lateness(rows) if d >= 1)
    assert rows_of(late.late_events(df, block=block), "iog", "seq", "word_idx", "outcome") == want
    periods = defaultdict(list)
    for r, s, d in lateness(rows):
        if d <= 3:
            periods[r[0], s].append(r[6])
    got = {(r["iog"], r["second"]): (r["hits"], r["mean_adc"]) for r in late.late_periods(df, block=block, every=2).collect()}
    assert got.keys() == periods.keys()
    for k, v in periods.items():
        known = [x for x in v if x is not None]
        assert got[k][0] == len(v) and (got[k][1] == pytest.approx(sum(known) / len(known)) if known else got[k][1] is None)


def test_replay_restores_snapshot():
    log = late.PeriodLog(4)
    import numpy as np

    a = lambda *x: np.array(x, np.int64)
    log.offer(a(1, 2, 2), np.array([1.0, 2.0, 4.0]), 3)
    assert log.offer(a(3), np.array([5.0]), 4) == [3]
    assert log.offer(a(2), np.array([np.nan]), 5) == [2]  # late: only its period is replaced
    assert log.out[2] == (3, 6.0, 2) and log.revision[2] == 1 and log.out[3] == (1, 5.0, 1) and log.revision[3] == 0


def test_late_events_come_from_the_replay(monkeypatch):
    """Events are applied to the log or rejected by it; by default a late one restores the snapshot before its second."""
    import inspect

    import pyarrow as pa

    logs = []

    class Spy(late.PeriodLog):
        def __init__(self, keep):
            super().__init__(keep)
            logs.append(self)

    monkeypatch.setattr(late, "PeriodLog", Spy)
    every = inspect.signature(late.late_events).parameters["every"].default
    clock, period = [10, 11, 12, 12, 13], [10, 11, 12, 11, 9]
    n = len(clock)
    t = pa.table({"seq": list(range(n)), "word_idx": pa.array([0] * n, pa.int32()), "clock": clock, "period": period, "value": [1.0] * n})
    start = pa.table({"seq": [-1], "word_idx": pa.array([-1], pa.int32()), "clock": [0], "period": [late.NEVER], "value": [1.0]})
    got = late._block(every, 3, True)((pa.scalar(1), pa.scalar(0)), t, start).to_pylist()
    assert [(r["seq"], r["outcome"]) for r in got] == [(3, "late"), (4, "too_late")]
    assert {p: x[0] for p, x in logs[0].out.items()} == {10: 1, 11: 2, 12: 1} and logs[0].revision == {10: 0, 11: 1, 12: 0}


def test_blocks_start_from_the_checkpoint_before_them(make_hits, monkeypatch):
    """A late event whose second lies in earlier blocks restores their state: the block gives the whole output of that second, which replaces theirs."""
    # seq, adc, raw tick, receipt, header second; one frame a block
    at = lambda seq, adc, second, clock: (1, seq, 0, 1, 7, 5, adc, 5, (clock - second) * R + 9, clock)
    rows = [at(0, 10, 20, 20), at(1, 20, 20, 20), at(2, 40, 21, 21), at(3, 60, 20, 22), at(4, 80, 20, 23), at(5, 99, 20, 24), at(6, 7, 24, 24)]
    df = make_hits(rows)
    parts = late._apply(df, 3, 1, late._block(1, 3, False), "iog int, block bigint, period bigint, n bigint, total double, valued bigint, late bigint, too_late bigint").collect()
    of = {(r.block, r.period): (r.n, r.total, r.late, r.too_late) for r in parts}
    assert [of[b, 20] for b in (0, 1, 3, 4, 5)] == [(1, 10.0, 0, 0), (2, 30.0, 0, 0), (3, 90.0, 1, 0), (4, 170.0, 1, 0), (None, None, 0, 1)]
    got = {r.second: (r.hits, r.mean_adc, r.late_hits, r.too_late_hits) for r in late.late_periods(df, block=1).collect()}
    assert got == {20: (4, 42.5, 2, 1), 21: (1, 40.0, 0, 0), 24: (1, 7.0, 0, 0)}


def test_heavy(make_hits, rows_of):
    rows = random_hits(random.Random(3), 900)
    n, keys = len(rows), {"channel": (0, 4, 5), "chip": (0, 4), "io_channel": (0, 3)}
    want = []
    for g, share in heavy.SHARES.items():
        c = defaultdict(int)
        for r in rows:
            k = tuple(r[i] for i in keys[g])
            if None not in k:
                c[k] += 1
        for k, v in c.items():
            if v * 1000 >= n * share:
                d = dict(zip(keys[g], k))
                want.append((g, d[0], d.get(3, -1), d.get(4, -1), d.get(5, -1)))
    assert rows_of(heavy.heavy_addresses(make_hits(rows)), "grain", *heavy.ADDRESS) == sorted(want)
    best = defaultdict(list)
    for r in set(rows):
        for g, ix in keys.items():
            k = tuple(r[i] for i in ix)
            if None not in k:
                d = dict(zip(ix, k))
                best[g, d[0], d.get(3, -1), d.get(4, -1), d.get(5, -1)].append(hit_tick(r[7], r[8], r[9]))
    for per_mille in (5, 300, 999):
        got = {tuple(r)[:5]: tuple(r)[5:] for r in heavy.address_latest(make_hits(rows), per_mille).collect()}
        assert got == {k: (len(v), max([x for x in v if x is not None], default=None)) for k, v in best.items()}


TILES = "boot_id string, seq bigint, begin_monotonic double, end_monotonic double, iog int, tile int, mapped_packets_per_s double, cell int"


def test_grid(spark):
    nan = float("nan")
    rows = [
        ("a", 1, 10.0, 10.5, 1, 1, 4.0, 0), ("a", 1, 10.0, 10.5, 1, 1, 4.0, 0), ("a", 2, 10.6, 11.1, 1, 1, 8.0, 0), ("a", 3, 11.2, 11.3, 1, 1, nan, 0), ("a", 9, 15.0, 15.2, 1, 1, 2.0, 0),
        ("a", 4, 12.0, 11.0, 1, 1, 9.0, 0), ("a", 5, None, 11.0, 1, 1, 9.0, 0), ("a", 6, nan, 13.0, 1, 1, 9.0, 0), ("b", 1, 1.0, 1.2, None, 2, None, 0), ("a", 7, 11.2, 11.2, 1, 1, 5.0, 0),
    ]
    df = spark.createDataFrame(rows, TILES)
    for cells in (4, 4096):
        got = {r["cell"]: (r["readings"], r["rate"], r["mark"]) for r in grid.regular_grid(df, max_gap=3, cells=cells).where("boot_id = 'a'").collect()}
        assert got == {20: (1, 4.0, "observed"), 21: (1, 8.0, "observed"), 22: (2, 8.0, "observed"), 23: (0, 8.0, "carried"), 24: (0, 8.0, "carried"), 25: (0, 8.0, "carried"), 26: (0, None, "missing"), 27: (0, None, "missing"), 28: (0, None, "missing"), 29: (0, None, "missing"), 30: (1, 2.0, "observed")}
        assert sorted(r["cell"] for r in grid.grid_gaps(df).collect()) == list(range(23, 30))
    b = grid.regular_grid(df).where("boot_id = 'b'").collect()
    assert [(r["iog"], r["cell"], r["mark"]) for r in b] == [(None, 2, "missing")]
    assert grid.regular_grid(df.limit(0)).count() == 0
    far = spark.createDataFrame([("c", 1, 3e15, 3e15 + 1.0, 1, 1, 2.0, 0), ("c", 2, 3e15 + 1.5, 3e15 + 2.0, 1, 1, 4.0, 0), ("d", 1, 0.0, 5000.0, 1, 1, 1.0, 0)], TILES)
    got = {(r.boot_id, r.cell): r.readings for r in grid.regular_grid(far).collect()}
    assert [got["c", 6 * 10**15 + k] for k in range(4)] == [1, 1, 0, 1] and sum(k == "d" for k, _ in got) == 10_000


def fault_oracle(rows):
    rows, out = set(rows), {}
    bad = lambda x, a, b: x is not None and not a <= x <= b
    for r in rows:
        if bad(r[6], 0, 255) or bad(r[7], 0, 2**31 - 1) or bad(r[5], 0, 63):
            out[r[:3]] = "impossible"
    by = defaultdict(list)
    for r in rows:
        if None not in (r[0], r[4], r[5], r[6]) and 0 <= r[5] <= 63 and 0 <= r[6] <= 255:
            by[r[0], r[4], r[5]].append(r)
    for v in by.values():
        timed = sorted((r for r in v if hit_tick(r[7], r[8], r[9]) is not None), key=lambda r: (hit_tick(r[7], r[8], r[9]), r[1], r[2]))
        i = 0
        while i < len(timed):
            j = i
            while j < len(timed) and timed[j][6] == timed[i][6]:
                j += 1
            if j - i >= 20:
                for r in timed[i:j]:
                    out.setdefault(r[:3], "stuck")
            i = j
        m = median(r[6] for r in v)
        d = median(abs(r[6] - m) for r in v)
        if len(v) >= 100:
            for r in v:
                if abs(r[6] - m) > 12 * d:
                    out.setdefault(r[:3], "spike")
    return sorted((*k, f) for k, f in out.items())


def faulty_rows(seed):
    rng = random.Random(seed)
    rows = random_hits(rng, 1500)
    rows = [list(r) for r in rows]
    for k, r in enumerate(rows):
        if 300 <= k < 420 and r[4] == 7:
            r[6] = 101  # a run of equal values of the hot source
        if rng.random() < 0.01 and r[6] is not None:
            r[6] = rng.choice([0, 250])
        if r[4] == 2 and r[5] == 1 and r[6] is not None:
            r[6] = 50 if rng.random() > 0.02 else 51
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed,slab", [(1, 1 << 17), (2, 90), (3, 300), (4, 15)])
def test_faults(make_hits, rows_of, monkeypatch, seed, slab):
    """Also with one source cut into many slabs, shorter than a stuck run too, and with a constant source."""
    rows = faulty_rows(seed)
    monkeypatch.setattr(faults, "SLAB", slab)
    monkeypatch.setattr(faults, "BUCKET", 200)
    assert rows_of(faults.faulty_hits(make_hits(rows)), "iog", "seq", "word_idx", "fault") == fault_oracle(rows)


def test_faults_are_states_of_the_model(make_hits, rows_of, monkeypatch):
    """Without the way into a state its faults are gone: no rule beside the model gives them."""
    rows = faulty_rows(1)
    want = fault_oracle(rows)
    assert {f for *_, f in want} == {"impossible", "stuck", "spike"}
    for name, fault, state in (("TO_STUCK", "stuck", faults.STUCK), ("TO_OUT", "impossible", faults.OUT)):
        import numpy as np

        emit, equal = np.array([[0.2, 0, 0]] * 40 if fault == "stuck" else [[0.2, 0, 0]] * 20 + [[1e-9, 0, 1]] + [[0.2, 0, 0]] * 19), np.r_[False, np.ones(39, bool)] if fault == "stuck" else np.zeros(40, bool)
        ends = np.zeros(40, bool), np.zeros(40, bool)
        ends[0][0] = ends[1][-1] = True
        with monkeypatch.context() as m:
            assert (faults.forward_backward(emit, equal, *ends).argmax(1) == state).any()
            m.setattr(faults, name, 0.0)
            assert not (faults.forward_backward(emit, equal, *ends).argmax(1) == state).any()


def test_forward_backward_is_exact():
    """Strips give the same posteriors as one pass over each whole sequence, also within long stuck runs."""
    import numpy as np

    rng = np.random.default_rng(5)
    n = 3000
    value = rng.integers(0, 4, n)
    for a, k in ((100, 20), (130, 19), (600, 700), (1400, 25), (1425, 300), (2900, 100)):
        value[a : a + k] = 7 + a % 5
    first = rng.random(n) < 0.004
    first[0] = True
    last = np.r_[first[1:], True]
    equal = np.r_[False, value[1:] == value[:-1]] & ~first
    emit = np.stack([rng.uniform(0.05, 0.25, n), np.where(rng.random(n) < 0.1, 1 / 256, 0), np.zeros(n)], 1)
    got = faults.forward_backward(emit, equal, first, last)
    prior, A = faults.transitions()
    assert np.allclose(A.sum(1), 1) and np.isclose(prior.sum(), 1)
    e = np.concatenate([emit, np.full((n, 1), 1 / 256), np.repeat(equal[:, None].astype(float), faults.RUN - 1, 1)], 1)
    ends = np.zeros(len(prior))
    ends[[0, 1, 2, -1]] = 1
    for a, b in zip(np.flatnonzero(first), np.flatnonzero(last) + 1):
        al, be = np.zeros((b - a, len(prior))), np.tile(ends, (b - a, 1))
        for k in range(b - a):
            al[k] = (prior if k == 0 else al[k - 1] @ A) * e[a + k]
            al[k] /= al[k].sum()
        for k in range(b - a - 2, -1, -1):
            be[k] = A @ (e[a + k + 1] * be[k + 1])
            be[k] /= be[k].sum()
        p = al * be
        p = np.concatenate([p[:, :3], p[:, 3:].sum(1, keepdims=True)], 1)
        assert np.allclose(got[a:b], p / p.sum(1, keepdims=True), atol=1e-12)


def test_written_tables(spark):
    """Cutting lineage keeps the rows and their types, and clearing removes the tables."""
    from pathlib import Path

    from wordstream import session

    df = spark.range(10).select("id", F.struct(F.lit(1).alias("a"), F.lit(None).cast("double").alias("b")).alias("s"))
    out = session.checkpoint(df)
    assert out.schema.simpleString() == df.schema.simpleString() and sorted(out.collect()) == sorted(df.collect())
    folder = Path(session._folder(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    session.clear_checkpoints(spark)
    assert not folder.exists() and session.checkpoint(df).count() == 10


def test_empty_and_null_tables(spark, make_hits):
    for rows in ([], [(None,) * 10], [(1, 1, 1) + (None,) * 7]):
        df = make_hits(rows)
        for f in (late.late_events, late.late_periods, heavy.heavy_addresses, heavy.address_latest, faults.faulty_hits):
            out = f(df)
            assert out.schema and all(r is not None for r in out.collect())
    assert late.late_events(make_hits([])).count() == 0 and faults.faulty_hits(spark.createDataFrame([], HITS)).count() == 0
    assert F is not None
