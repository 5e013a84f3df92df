"""Detector operators against hand-made expectations and sequential oracles."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from wordstream.config import Timing, Windows
from wordstream.functions import payload
from wordstream.operators import audits, epochs, geometry, state, timing, triggers
from wordstream.sources import stream as wire
from wordstream.sources import synthetic

R = 10_000_000
STREAM = "iog int, seq bigint, word_idx int, kind string, io int, header_second bigint, receipt bigint, aux bigint, raw bigint, chip int, channel int, adc int"


def words(spark, items, iog=1):
    """Word stream of ('S', aux[, subtype[, second]]), ('D', raw, receipt) and ('T', aux[, subtype])."""
    rows = []
    for k, w in enumerate(items):
        if w[0] == "D":
            rows.append((iog, k // 3, k % 3, "D", 1, 100, w[2], None, w[1], 11, k % 64, 80))
        else:
            rows.append((iog, k // 3, k % 3, w[0], w[2] if len(w) > 2 else (83 if w[0] == "S" else 2), w[3] if len(w) > 3 else 100, None, w[1], None, None, None, None))
    return spark.createDataFrame(rows, STREAM)


def test_payload_by_hand(spark):
    """chip 131, channel 37, raw 0x1234567, adc 0xA4 in the bits of the format."""
    body = 131 << 2 | 37 << 10 | 0x1234567 << 16 | 0xA4 << 48 | 1 << 62
    body |= (1 - bin(body).count("1") % 2) << 63
    signed = body - (1 << 64) if body >> 63 else body
    row = spark.createDataFrame([(131, 37, 0x1234567, 0xA4, 1), (256, 0, 0, 0, 0), (None, 0, 0, 0, 0)], "chip int, channel int, raw bigint, adc int, down int")
    p = payload.pack_payload(*(F.col(c) for c in ("chip", "channel", "raw", "adc", "down")))
    assert [r[0] for r in row.select(p).collect()] == [signed, None, None]
    got = row.limit(1).select(*(payload.field(p, n).alias(n) for n in payload.FIELDS), payload.odd_parity(p).alias("odd")).first()
    assert (got.ptype, got.chip, got.channel, got.timestamp, got.adc, got.downstream, got.odd) == (0, 131, 37, 0x1234567, 0xA4, 1, True)


def frame(*words, kind=b"D", second=123, n=None):
    return struct.pack("<cIxH", kind, second, len(words) if n is None else n) + b"".join(words)


def data_word(io, receipt, body):
    return struct.pack("<cBI2xQ", b"D", io, receipt, body)


def test_frames_by_hand(spark):
    good = 11 << 2 | 5 << 10 | 7 << 16 | 80 << 48
    good |= (1 - bin(good).count("1") % 2) << 63
    sync = struct.pack("<cB2xI8x", b"S", 83, R)
    rows = [
        (1, 1, frame(data_word(18, 87654321, good), sync)), (1, 2, b""), (1, 3, b"D123"), (1, 4, frame(n=1)), (1, 5, frame(sync) + bytes(16)), (1, 6, frame(sync, n=2)), (1, 7, frame(kind=b"?")), (1, 8, frame()), (1, 9, frame(kind=b"X")), (1, 10, None),
        (1, 11, frame(data_word(1, 2**32 - 1, good ^ (1 << 63)), data_word(2, 1, good ^ (1 << 62) ^ (1 << 63)), data_word(3, 1, good ^ 3), second=2**32 - 1)),
    ]
    f = spark.createDataFrame(rows, "iog int, seq bigint, value binary")
    p = wire.parse_frames(f)
    assert {r.seq: r.reject for r in p.collect() if r.reject} == {2: "length", 3: "length", 4: "word count", 5: "word count", 6: "word count", 9: "kind", 10: "missing"}
    a = sorted(tuple(r) for r in wire.explode_words(p).select("seq", "word_idx", "header_second", "kind", "io", "receipt", "aux", "payload").collect())
    b = sorted(tuple(r) for r in wire.decode_frames(f).select("seq", "word_idx", "header_second", "kind", "io", "receipt", "aux", "payload").collect())
    assert a == b and len(a) == 5 and a[0][2:6] == (123, "D", 18, 87654321) and a[1][3:5] == ("S", 83) and a[1][6] == R and a[2][2] == 2**32 - 1 and a[2][5] == 2**32 - 1
    h = wire.decode_hits(wire.decode_frames(f)).collect()
    assert [(r.seq, r.io_channel, r.chip, r.channel, r.timestamp, r.adc) for r in sorted(h, key=lambda r: r.word_idx)] == [(1, 18, 11, 5, 7, 80), (11, 2, 11, 5, 7, 80)]
    c = wire.decode_counters(wire.decode_frames(f), p).first()
    assert (c.frames, c.malformed, c.nondata_messages, c.words, c.data_words, c.data_hits, c.bad_parity, c.downstream, c.other_packets, c.packet_type_3, c.sync83_packets) == (11, 7, 1, 5, 4, 3, 1, 1, 1, 1, 1)
    with pytest.raises(Exception, match="malformed"):
        wire.parse_frames(f, strict=True).collect()


def unroll_oracle(items):
    off, prev, out, bad = 0, R, [], 0
    for w in items:
        if w[0] == "S" and (len(w) < 3 or w[2] == 83):
            step = round(w[1] / R) * R
            if step > 0 and abs(w[1] - step) <= R // 20:
                off, prev = off + step, step
            else:
                bad += 1
        elif w[0] == "D":
            tick, rec = w[1] % R + off - (prev if w[2] < w[1] else 0), off + w[2]
            out.append((tick, off > 0 and tick >= 0 and rec >= tick and w[2] < 32 * R))
    return out, bad


CASES = [
    [("D", 5, 10), ("S", R, 72), ("D", 10, 20)], [("S", R), ("D", 100, 110)], [("S", R), ("S", R), ("D", R - 50, 20), ("D", 30, 40)], [("S", R + 11), ("S", 2 * R - 4), ("D", 7, 9)],
    [("S", 0), ("S", R // 2), ("D", 1, 2)], [("S", R), ("D", 10, 2**32 - 1)], [("S", R), ("S", R), ("D", 99, 100), ("D", 3, 4)],
]


@pytest.mark.parametrize("case", range(len(CASES) + 2))
def test_unroll(spark, case):
    rng = random.Random(case)
    items = CASES[case] if case < len(CASES) else [rng.choice([("D", rng.randrange(3 * R), rng.randrange(3 * R)), ("D", rng.randrange(R), rng.randrange(R)), ("S", R * rng.randint(0, 3) + rng.randint(-9, 9)), ("S", R, 72), ("T", 5)]) for _ in range(120)]
    w = words(spark, items)
    want, bad = unroll_oracle(items)
    got = [(r.tick, r.valid) for r in timing.unroll(w).orderBy("seq", "word_idx").collect()]
    assert got == want
    c = timing.unroll_counters(w).first()
    top, late = -1, 0
    for t, v in want:
        if v:
            late, top = late + (t < top), max(top, t)
    assert (c.invalid_syncs, c.warmup_hits + c.invalid_times, c.out_of_order_hits) == (bad, sum(not v for _, v in want), late)
    if any(v for _, v in want):
        d = timing.flow_difference(w).first()
        assert d.mismatches == 0 and d.compared_hits == sum(v for _, v in want)


def align_oracle(obs):
    """Sequential state machine over (tick, second, usable)."""
    last = cand = pinned = fresh = None
    conf, out = 0, []
    for tick, second, usable in obs:
        if fresh is not None and second is not None and second - fresh > 2.5:
            conf = 0
        if not usable:
            conf = 0
            out.append(("suspect", None))
            continue
        if last and (tick <= last[0] or second <= last[1]):
            last, conf = (tick, second), 0
            out.append(("suspect", None))
            continue
        last, fresh, c = (tick, second), second, second * R - tick
        if pinned is not None and c != pinned:
            cand, conf = c, 0
            out.append(("suspect", None))
            continue
        if c != cand:
            cand, conf = c, 0
        conf += 1
        if conf >= 2:
            pinned = c
        out.append(("aligned", c) if conf >= 2 else ("warming", None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_alignment(spark, seed):
    rng = random.Random(seed)
    obs, tick, second = [], 0, 1_790_000_000
    for _ in range(60):
        tick, second = tick + R, second + rng.choice([1, 1, 1, 1, 1, 1, 1, 2, 4]) if rng.random() < 0.9 else second
        if rng.random() < 0.15:
            second += rng.choice([-1, 1])
        obs.append((tick, second, rng.random() < 0.9))
    df = spark.createDataFrame([(1, k, 0, *o) for k, o in enumerate(obs)], "iog int, seq bigint, word_idx int, tick bigint, second bigint, usable boolean")
    for block in (1 << 14, 16):  # blocks see the one before them
        got = [(r.status, r.offset_ticks) for r in epochs.align(df, block=block).orderBy("seq").collect()]
        assert got == align_oracle(obs)


def test_matching_brute_force(spark):
    rng = random.Random(11)
    win = Windows(pre_us=10, post_us=300)
    hits = [(i % 3, k, 0, rng.randrange(10**6), k % 16) for k in range(300) for i in (rng.randrange(3),)]
    trig = [(rng.randrange(3), s, rng.randrange(10**6)) for s in ("beam", "light") for _ in range(20)]
    for i, s, t in trig[:10]:
        hits += [(i, 1000 + len(hits) + j, 0, t + d, 1) for j, d in enumerate((-101, -100, 0, 2999, 3000))]
    h = spark.createDataFrame(hits, "iog int, seq bigint, word_idx int, tick bigint, pixel_id int")
    t = spark.createDataFrame(trig, "iog int, source string, tick bigint")
    m = triggers.match_hits(h, triggers.merge_windows(t, win, ("iog", "source"), slab=50_000), ("iog",), 5000)
    want = sorted({(x[0], x[1], s) for x in hits for i, s, k in trig if i == x[0] and k - 100 <= x[3] < k + 3000})
    assert sorted(tuple(r) for r in m.select("iog", "seq", "source").collect()) == want
    merged = triggers.merge_windows(spark.createDataFrame([(1, 0), (1, 3100), (1, 9000), (1, 12101)], "iog int, tick bigint"), win)
    assert sorted((r.lo, r.hi, r.n) for r in merged.collect()) == [(-100, 6100, 2), (8900, 12000, 1), (12001, 15101, 1)]


def router_oracle(obs, triggers, targets):
    """Targets of each trigger by a machine that walks all events in time: (second, iog, tick, usable) and (second, source, tick)."""
    from wordstream.operators.epochs import FRESH

    state, out, lost = {}, [], []
    events = sorted([(o[0], 0, o) for o in obs] + [(t[0], 1, t) for t in triggers], key=lambda e: (e[0], e[1]))
    for now, kind, e in events:
        for i, s in state.items():
            if s["status"] == "aligned" and now - s["fresh"] > FRESH:
                s["status"], s["conf"] = "stale", 0
                lost.append(s["fresh"] + 3)
        if kind == 0:
            second, iog, tick, usable = e
            s = state.setdefault(iog, {"status": "warming", "fresh": None, "conf": 0, "cand": None, "pin": None, "last": None})
            good = usable and (s["last"] is None or (tick > s["last"][0] and second > s["last"][1]))
            if usable:
                s["last"] = (tick, second)
            c = second * R - tick
            if not good or (s["pin"] is not None and c != s["pin"]):
                if s["status"] == "aligned":
                    lost.append(now)
                s["status"], s["conf"] = "suspect", 0
                if good:
                    s["fresh"], s["cand"] = second, c
                continue
            if s["fresh"] is not None and second - s["fresh"] > FRESH:
                s["conf"] = 0
            s["fresh"] = second
            s["conf"] = s["conf"] + 1 if c == s["cand"] else 1
            s["cand"] = c
            s["status"] = "aligned" if s["conf"] >= 2 else "warming"
            if s["conf"] >= 2:
                s["pin"] = c
        else:
            second, source, tick = e
            ready = {i: s["pin"] for i, s in state.items() if s["status"] == "aligned" and 0 <= second - s["fresh"] <= FRESH}
            if source in ready:
                out += [(source, second, i, tick + ready[source] - ready[i]) for i in targets if i in ready and tick + ready[source] - ready[i] >= 0]
    return sorted(out), sorted(lost)


@pytest.mark.parametrize("seed", range(3))
def test_targets_at_the_time_of_the_trigger(spark, seed):
    """A target that is stale, suspect or not yet aligned when a trigger comes gets no window, also if it was or will be aligned; revocations come at the same times."""
    rng = random.Random(seed)
    base, obs, trig = 1_790_000_000, [], []
    for iog in (1, 5, 6):
        second, tick = base + iog % 3, 0
        for _ in range(70):
            step = rng.choice([1, 1, 1, 1, 1, 1, 1, 2, 4])
            second, tick = second + step, tick + step * R
            if rng.random() < 0.06:
                tick += R  # a changed offset
                obs.append((second, iog, tick, True))
                tick -= R
                second += 1
                tick += R
            obs.append((second, iog, tick, True))
    for _ in range(150):
        source = rng.choice([5, 6])
        second = base + rng.randrange(90)
        trig.append((second, source, (second - base) * R + rng.randrange(R)))
    want, lost = router_oracle(obs, trig, (1, 5, 6))
    o = spark.createDataFrame([(i, 10 * s, 0, t, s, u) for s, i, t, u in obs], "iog int, seq bigint, word_idx int, tick bigint, second bigint, usable boolean")
    a = epochs.align(o).withColumn("after", F.lit(R))
    t = spark.createDataFrame([(i, 10 * s + 5, k, 0, t, s) for k, (s, i, t) in enumerate(trig)], "iog int, seq bigint, word_idx int, subtype int, tick bigint, second bigint")
    config = spark.createDataFrame([(i, i != 4, 2.5, 120.5, 2.0, []) for i in (1, 4, 5, 6)], "iog int, trigger_view boolean, pre_us double, post_us double, history_seconds double, trigger_types array<int>")
    w = t.select("iog", "seq", "word_idx", F.lit("T").alias("kind"), F.lit(0).alias("io"), F.col("second").alias("header_second"), F.lit(5).cast("bigint").alias("aux"))
    own = epochs.qualified(w, a).select("iog", "seq", "word_idx", "own").join(t, ["iog", "seq", "word_idx"])
    r = triggers.route(own, epochs.target_offsets(a), config).where("tick >= 0").cache()
    assert sorted((x.source_iog, x.second, x.iog, x.tick) for x in r.collect()) == want and len(want) > 50
    assert {(x.pre, x.post, x.history) for x in r.collect()} == {(25, 1205, 2 * R)}
    revoked = epochs.revocations(a).collect()
    lost = [x for x in lost if x <= max(o[0] for o in obs)]  # later ones are seen by triggers only
    assert sorted(x.time for x in revoked) == lost and len(lost) > 3
    g = {x.second: (x.since, x.until) for x in epochs.generations(t.select("second").distinct(), epochs.revocations(a)).collect()}
    for s, _, _ in trig:
        assert g[s] == (max([x for x in lost if x <= s], default=-1), min([x for x in lost if x > s], default=1 << 62))


def test_hits_of_another_generation_or_beyond_the_history(spark):
    windows = spark.createDataFrame([(1, "beam", 100, 200, 0, 3 * R, 2 * R, 10, 1 << 62), (1, "light", 100, 150, 0, 3 * R, 2 * R, -1, 1 << 62)], "iog int, source string, lo bigint, hi bigint, n int, theirs bigint, history bigint, since bigint, until bigint")
    at = lambda seq, tick, second: (1, seq, 0, 7, tick, second * R - 3 * R)
    hits = spark.createDataFrame([at(1, 120, 9), at(2, 120, 4), at(3, 150, 3), at(4, 199, 5)], "iog int, seq bigint, word_idx int, pixel_id int, tick bigint, receipt_tick bigint")
    got = sorted((r.seq, r.source) for r in triggers.match_generations(hits, windows, 1000).collect())
    assert got == [(2, "light")]  # the first is later than the history, 3 and 4 outside of light's window, all before beam's generation
    early = windows.withColumn("since", F.lit(3)).withColumn("until", F.lit(5))
    assert sorted((r.seq, r.source) for r in triggers.match_generations(hits, early, 1000).collect()) == [(2, "beam"), (2, "light"), (3, "beam")]
    old = spark.createDataFrame([(10 * R, 1500, 20, 0, 9 * R), (10 * R, 1500, 12, 0, 9 * R)], "tick bigint, post bigint, second bigint, theirs bigint, history bigint")
    assert [r.second for r in triggers.in_history(old).collect()] == [12]


def test_frontier_ahead_revokes(spark):
    """A hit whose receipt runs more than 2.5 s ahead of the last sync takes the alignment away until two more syncs."""
    base = 1_790_000_000
    rows = [(1, k, 0, "S", 83, base + k, None, R, None) for k in range(3)] + [(1, 2, 1, "D", 1, base + 2, 26_000_000, None, 5), (1, 2, 2, "T", 0, base + 2, None, 9, None), (1, 3, 0, "S", 83, base + 3, None, R, None), (1, 4, 0, "S", 83, base + 4, None, R, None)]
    w = spark.createDataFrame(rows, "iog int, seq bigint, word_idx int, kind string, io int, header_second bigint, receipt bigint, aux bigint, raw bigint")
    a = epochs.align(epochs.pps_observations(w)).orderBy("seq", "word_idx").collect()
    assert [(r.ahead, r.status) for r in a] == [(False, "warming"), (False, "aligned"), (False, "aligned"), (True, "suspect"), (False, "warming"), (False, "aligned")]
    lost = epochs.revocations(epochs.align(epochs.pps_observations(w))).collect()
    assert [(r.seq, r.word_idx, r.time, r.paused) for r in lost] == [(2, 1, base + 2, False)]


def test_geometry(spark):
    places = [(i, t, c, ch, ((c - 11) * 8 + ch % 8) * 3.8, (ch // 8) * 3.8, 3.8) for i in (1, 2) for t in range(1, 9) for c in (11, 12) for ch in range(64)]
    px = geometry.number_pixels(spark.createDataFrame(places, "iog int, tile int, chip int, channel int, x double, y double, pitch double"))
    assert px.count() == 2 * 8 * 2 * 64 and px.agg(F.max("pixel_id"), F.count_distinct("pixel_id")).first() == (2047, 2048)
    at = geometry.address_table(px)
    hits = spark.createDataFrame([(1, 1, 11, 0), (1, 4, 11, 0), (1, 5, 11, 0), (1, 33, 11, 0), (2, 32, 12, 63), (None, 1, 11, 0)], "iog int, io_channel int, chip int, channel int")
    assert [r.pixel_id for r in geometry.map_hits(hits, at).orderBy("iog", "io_channel").collect()] == [None, 0, 0, 128, None, 2047]
    assert geometry.geometry_errors(px).count() == 0
    twice = px.unionByName(px.limit(1)).unionByName(px.limit(1).withColumn("x", F.lit(float("nan"))))
    assert {r.problem for r in geometry.geometry_errors(twice).collect()} >= {"overlap"}
    e = geometry.tile_extents(px).where("iog = 1 AND tile = 1").first()
    assert (e.n_pixels, e.width, e.height) == (128, 16, 8)
    double = px.withColumns({c: F.col(c) * 2 for c in ("x", "y", "pitch")})
    assert geometry.tile_extents(double).where("iog = 1 AND tile = 1").first().width == 16
    whole, twice = (geometry.geometry_identity(x).first() for x in (px, px.unionByName(px.limit(1)).unionByName(px.limit(1))))
    assert whole.geometry_id == geometry.geometry_identity(px.orderBy(F.desc("pixel_id"))).first().geometry_id != twice.geometry_id


def test_histogram_bins(spark):
    v = [-5, 0, 99, 100, 12_499_999, 12_500_000, 40_000_000, 10**12]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v bigint").select(audits.bin_of(F.col("v"))).collect()]
    assert got == [0, 0, 0, 1, 6, 7, 9, 9]


def test_state(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "pixel_id int, tick bigint")
    b = spark.createDataFrame([(1, 5), (2, 9), (4, 1)], "pixel_id int, tick bigint")
    delta = state.layer_delta(a, b)
    assert sorted(tuple(r) for r in delta.collect()) == [(2, 9), (3, -1), (4, 1)]
    magic, seq, records = state.decode_layer(bytes(state.encode_layer(delta, "RDB1", 7).first().frame))
    assert (magic, seq, records) == ("RDB1", 7, [(2, 9e-7), (3, -1.0), (4, 1e-7)])
    with pytest.raises(ValueError):
        state.decode_layer(b"RDB1" + bytes(7))
    levels = spark.createDataFrame([(None,), (-1,), (0,), (15,), (16,), (10**7,)], "a bigint").select(state.brightness(F.col("a"))).collect()
    assert [r[0] for r in levels] == [0, 0, 255, 255, 247, 0]
    c = spark.createDataFrame([(-1, 0, True, 5), (1000, 1100, True, 400), (1000, 1100, False, 50), (1000, 5000, True, 400)], "b int, f int, r boolean, s int")
    assert [r[0] for r in c.select(state.displayed_clock(F.col("b"), F.col("f"), F.col("r"), F.col("s"))).collect()] == [-1, 1100, 1000, 1250]
    r = spark.createDataFrame([(1, 3, 100.0, 1, 90.0, 100.0), (2, 3, 97.0, 0, 0.0, 100.0), (3, 0, 0.0, 0, 0.0, 90.0)], "iog int, syncs int, last_sync double, triggers int, last_trigger double, last_frame double")
    assert [(x.sync_badge, x.trigger_badge, x.healthy) for x in state.receipt_status(r, F.lit(100.5)).orderBy("iog").collect()] == [("pulse", "idle", True), ("stale", "idle", True), ("unknown", "unknown", False)]


def test_config():
    with pytest.raises(ValueError):
        Timing(delay=0.01)
    with pytest.raises(ValueError):
        Windows(post_us=0)
    with pytest.raises(ValueError):
        Timing(min_raw=True)
    assert Windows(pre_us=0.25, post_us=0.01, history_seconds=2).ticks() == (2, 1, 20_000_000)
    with pytest.raises(ValueError):
        audits.ring_page(None, limit=101)


def test_sources(spark, tmp_path):
    import json

    p = tmp_path / "c.jsonl"
    vals = [5.0, 1.0, 1.5, 0, 0, 0, *range(64), *range(64), *([0] * 112)]
    p.write_text("\n".join(json.dumps(x) for x in ({"type": "metadata", "boot_id": "b"}, {"type": "gap"}, {"type": "sample", "values": vals})))
    _, samples = synthetic.read_capture(spark, str(p))
    t = synthetic.tile_rows(samples)
    assert t.count() == 64 and t.where("iog = 2 AND tile = 3").first()[:] == (5, 1.0, 1.5, 2, 3, 10, 10)
    p.write_text('{"type": "sample", "values": [1]}')
    with pytest.raises(ValueError):
        synthetic.read_capture(spark, str(p))
    rows = [(0, 6, 1, R, 0, 83, True), (1, 0, 1, 10, 20, None, True), (2, 0, 1, R - 5, R - 1, None, True), (3, 6, 1, R, 0, 83, True), (4, 0, 1, R - 2, 10, None, True), (5, 0, 1, 30, 40, None, True), (6, 6, 1, 2 * R, 0, 83, True), (7, 0, 1, 100, 120, None, True), (8, 0, 1, 1, 2, None, False)]
    w = synthetic.packet_stream(spark.createDataFrame(rows, "row_id bigint, packet_type int, io_group int, timestamp bigint, receipt_timestamp bigint, trigger_type int, valid_parity boolean"))
    d = timing.flow_difference(w).first()
    assert (d.compared_hits, d.mismatches) == (5, 0)
    e = spark.createDataFrame([(1, "a", "h1", 5556), (1, "a", "h1", 5556), (9, "a", "b ad", 1)], "iog int, io_class string, host string, port int")
    assert {r.problem for r in synthetic.endpoint_errors(e).collect()} == {"iog given twice", "address given twice", "iog not in 1..8", "bad host", "bad port"}
    v = spark.createDataFrame([(" V2b",), ("3",), (None,)], "v string").select(synthetic.family(F.col("v"))).collect()
    assert [r[0] for r in v] == ["2b", None, None]
    (tmp_path / "geometry_mod1_v4.json").write_text(json.dumps({"pixel_pitch": 3.8, "geometry": {"1-2-11-5": [0.0, 3.8]}}))
    g = geometry.read_geometry(spark, str(tmp_path / "geometry_mod*.json")).first()
    assert (g.module, g.side, g.geometry_tile, g.chip, g.channel, g.y) == (1, 1, 2, 11, 5, 3.8) and len(g.sha256) == 64


def test_snapshot_frames_and_documents(spark, tmp_path):
    import json

    from wordstream.sources import sinks

    delta = spark.createDataFrame([(5, 10_000_000), (2, -1)], "pixel_id int, tick bigint")
    clocks = [(float(k), k + 0.5, k % 2 == 0) for k in range(8)]
    frame = bytes(state.encode_snapshot(delta, clocks, 3).first().frame)
    assert len(frame) == 204 + 24 and state.decode_snapshot(frame) == ("RDP2", 3, [(c, f, float(r)) for c, f, r in clocks], [(2, -1.0), (5, 1.0)])
    ages = spark.createDataFrame([(1, None), (0, 0.5)], "pixel_id int, age double")
    assert state.decode_snapshot(bytes(state.encode_ages(ages, 9, 12.5).first().frame)) == ("RDP1", 9, [(12.5,)], [(0, 0.5), (1, 1e9)])
    with pytest.raises(ValueError):
        state.decode_snapshot(frame[:-1])
    rows = spark.createDataFrame([(2, 5), (1, 7)], "iog int, hits int")
    assert json.loads(state.document(rows, 2).first().document) == {"version": 2, "sources": [{"hits": 7, "iog": 1}, {"hits": 5, "iog": 2}]}
    sinks.write_capture(rows, str(tmp_path / "c"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_capture(rows, str(tmp_path / "c"))
    f = spark.createDataFrame([(1, 1, b"x")], sinks.FRAMES)
    f.write.parquet(str(tmp_path / "f"))
    assert sinks.read_frames(spark, str(tmp_path / "f")).count() == 1 and sinks.read_frames(spark, str(tmp_path / "f"), streaming=True).isStreaming
