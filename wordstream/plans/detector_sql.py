"""The detector queries in DuckDB's SQL."""

from __future__ import annotations

_W = """
WITH h AS (SELECT DISTINCT * FROM hits),
w AS (SELECT iog, seq, word_idx, 'D' AS kind, io_channel AS io, message_seconds AS header_second, receipt_timestamp AS receipt, NULL::BIGINT AS aux, "timestamp" AS raw, chip, channel, adc
   FROM h WHERE "timestamp" BETWEEN 0 AND 2147483647 AND receipt_timestamp BETWEEN 0 AND 4294967295
  UNION ALL SELECT DISTINCT iog, seq, word_idx, kind, io, header_second, NULL, aux, NULL, NULL, NULL, NULL FROM words),
st AS (SELECT *, CASE WHEN kind = 'S' AND io = 83 AND CAST(round_even(aux / 1e7, 0) AS BIGINT) > 0
   AND abs(aux - CAST(round_even(aux / 1e7, 0) AS BIGINT) * 10000000) <= 500000 THEN CAST(round_even(aux / 1e7, 0) AS BIGINT) * 10000000 END AS step FROM w),
e AS (SELECT *, CAST(coalesce(sum(step) OVER p, 0) AS BIGINT) AS off, last_value(step IGNORE NULLS) OVER p AS prev FROM st
  WINDOW p AS (PARTITION BY iog ORDER BY seq, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d0 AS (SELECT *, receipt < raw AS crossed, off > 0 AS ready, raw % 10000000 + off - CASE WHEN receipt < raw THEN coalesce(prev, 10000000) ELSE 0 END AS tick, off + receipt AS receipt_tick FROM e WHERE kind = 'D'),
d AS (SELECT *, ready AND tick >= 0 AND receipt_tick >= tick AND receipt < 320000000 AS valid FROM d0),
sel AS (SELECT d.*, a.pixel_id FROM d JOIN dim_address a ON d.iog = a.iog AND d.io = a.io_channel AND d.chip = a.chip AND d.channel = a.channel WHERE d.valid AND d.raw >= 10),
f AS (SELECT i.iog, i.initial_tick, CAST(greatest(x.stop, t.top) AS BIGINT) AS frontier_tick, t.last_hit_tick FROM
  (SELECT iog, min(step) AS initial_tick FROM e WHERE step IS NOT NULL AND off = 0 GROUP BY iog) i JOIN (SELECT iog, sum(step) AS stop FROM e GROUP BY iog) x ON i.iog = x.iog
  LEFT JOIN (SELECT iog, max(receipt_tick) AS top, max(tick) AS last_hit_tick FROM d WHERE valid GROUP BY iog) t ON i.iog = t.iog),
t AS (SELECT iog, seq, word_idx, io AS subtype, off + aux AS tick, coalesce(off > 0 AND aux BETWEEN 0 AND 9999999, FALSE) AS valid, header_second FROM e WHERE kind = 'T')
"""

# alignment of clocks, by the same rules over windows
_A = _W + """,
o0 AS (SELECT iog, seq, word_idx, off + step AS tick, header_second AS second, coalesce(step IS NOT NULL AND header_second > 0 AND count(*) OVER (PARTITION BY iog, seq) = 1, FALSE) AS usable, FALSE AS ahead FROM e WHERE kind = 'S' AND io = 83
  UNION ALL SELECT iog, f.q, f.w, NULL, f.s, FALSE, TRUE FROM (SELECT iog, arg_min(struct_pack(q := seq, w := word_idx, s := header_second), seq * 100000 + word_idx) AS f FROM d WHERE valid AND receipt > 25000000 GROUP BY iog, off)),
o1 AS (SELECT *, coalesce(CAST(second AS DOUBLE), 0) AS now, CASE WHEN usable THEN second * 10000000 - tick END AS candidate,
  last_value(CASE WHEN usable THEN struct_pack(tick := tick, second := second) END IGNORE NULLS) OVER p AS lst FROM o0 WINDOW p AS (PARTITION BY iog ORDER BY seq, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o2 AS (SELECT *, usable AND (lst IS NULL OR (tick > lst.tick AND second > lst.second)) AS ordered FROM o1),
o3 AS (SELECT *, lag(ordered) OVER (PARTITION BY iog ORDER BY seq, word_idx) AS b_ordered, lag(candidate) OVER (PARTITION BY iog ORDER BY seq, word_idx) AS b_candidate,
  last_value(CASE WHEN ordered THEN now END IGNORE NULLS) OVER p AS fresh, last_value(CASE WHEN ordered THEN candidate END IGNORE NULLS) OVER p AS stored
  FROM o2 WINDOW p AS (PARTITION BY iog ORDER BY seq, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o4 AS (SELECT *, ordered AND coalesce(b_ordered AND b_candidate = candidate, FALSE) AND coalesce(now - fresh <= 2.5, FALSE) AS follows FROM o3),
pin AS (SELECT iog, arg_min(candidate, seq * 100000 + word_idx) AS pinned, min(seq * 100000 + word_idx) AS since FROM o4 WHERE follows GROUP BY iog),
o5 AS (SELECT o4.*, pin.pinned, coalesce(o4.seq * 100000 + o4.word_idx >= pin.since, FALSE) AS after FROM o4 LEFT JOIN pin ON o4.iog = pin.iog),
al AS (SELECT *, ordered AND (NOT after OR candidate = pinned) AS consistent, after AND follows AND candidate = pinned AS ok, CASE WHEN ordered THEN now ELSE fresh END AS fresh_at,
  CAST(CASE WHEN ordered THEN now WHEN ahead THEN CASE WHEN now > 0 THEN now ELSE fresh + 3 END ELSE fresh + 1 END AS BIGINT) AS arrived FROM o5),
al2 AS (SELECT *, usable AND (NOT consistent OR coalesce(stored <> candidate, FALSE)) AS inconsistent, CASE WHEN NOT consistent THEN 'suspect' WHEN ok THEN 'aligned' ELSE 'warming' END AS status, CASE WHEN ok THEN pinned END AS offset_ticks FROM al),
ac AS (SELECT iog, count(*) FILTER (NOT ahead) AS observations, count(*) FILTER (consistent) AS consistent, count(*) FILTER (inconsistent) AS inconsistent, count(*) FILTER (NOT usable AND NOT ahead) AS invalid, count(*) FILTER (ahead) AS ahead,
  max(offset_ticks) AS offset_ticks, arg_max(status, seq * 100000 + word_idx) AS last_status FROM al2 GROUP BY iog),
rv AS (SELECT iog, seq, word_idx, CAST(least(arrived, fresh + 3) AS BIGINT) AS time, status, arrived >= fresh + 3 AS paused FROM (SELECT *, lag(status) OVER (PARTITION BY iog ORDER BY seq, word_idx) AS was FROM al2) WHERE was = 'aligned' AND status <> 'aligned'
  UNION ALL SELECT iog, NULL, NULL, CAST(l.f + 3 AS BIGINT), 'stale', TRUE FROM (SELECT iog, arg_max(struct_pack(s := status, f := fresh_at), seq * 100000 + word_idx) AS l FROM al2 GROUP BY iog) WHERE l.s = 'aligned' AND l.f + 3 <= (SELECT max(arrived) FROM al2))
"""

# settings in ticks
_SETTINGS = """cf AS (SELECT iog, trigger_view, CAST(round_even(pre_us * 10, 0) AS BIGINT) AS pre, greatest(1, CAST(round_even(post_us * 10, 0) AS BIGINT)) AS post, CAST(history_seconds * 10000000 AS BIGINT) AS history, coalesce(trigger_types, []) AS types FROM observer_config)"""
# detector-wide triggers; the last observation before a trigger decides whether its source is aligned, the last up to its second whether a target is
_R = _A + f""",
{_SETTINGS},
q0 AS (SELECT iog, seq, word_idx, subtype, tick, valid, header_second, NULL AS seen FROM t
  UNION ALL BY NAME SELECT iog, seq, word_idx, struct_pack(o := offset_ticks, f := fresh_at) AS seen FROM al2),
q1 AS (SELECT *, last_value(seen IGNORE NULLS) OVER (PARTITION BY iog ORDER BY seq, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM q0),
tj AS (SELECT q1.*, CASE WHEN header_second - state.f BETWEEN 0 AND 2.5 THEN state.o END AS own, len(types) = 0 OR list_contains(types, subtype) AS wanted, u.iog IS NOT NULL AS uncertain
  FROM q1 LEFT JOIN cf ON q1.iog = cf.iog LEFT JOIN (SELECT DISTINCT iog, seq FROM rv WHERE NOT paused) u ON q1.iog = u.iog AND q1.seq = u.seq WHERE seen IS NULL),
q AS (SELECT * FROM tj WHERE valid AND wanted AND NOT uncertain AND own IS NOT NULL AND iog IN (5, 6)),
tg AS (SELECT iog, arrived, arg_max(struct_pack(s := status, o := offset_ticks, f := fresh_at), seq * 100000 + word_idx) AS st FROM al2 WHERE arrived IS NOT NULL GROUP BY iog, arrived),
r0 AS (SELECT q.*, cf.iog AS target, pre, post, history FROM q CROSS JOIN cf WHERE trigger_view),
ra AS (SELECT CASE r0.iog WHEN 5 THEN 'beam' ELSE 'light' END AS source, r0.iog AS source_iog, seq, word_idx, subtype, header_second, target AS iog, tick + (own - st.o) AS tick, st.o AS theirs, pre, post, history
  FROM r0 ASOF JOIN tg ON r0.target = tg.iog AND r0.header_second >= tg.arrived WHERE st.s = 'aligned' AND header_second - st.f BETWEEN 0 AND 2.5),
r AS (SELECT source, source_iog, seq, word_idx, subtype, iog, tick FROM ra WHERE tick >= 0),
rt AS (SELECT DISTINCT time FROM rv),
rg AS (SELECT ra.*, coalesce(x.time, -1) AS since, coalesce(y.time, 4611686018427387904) AS until FROM ra ASOF LEFT JOIN rt x ON ra.header_second >= x.time ASOF LEFT JOIN rt y ON ra.header_second < y.time
  WHERE tick >= 0 AND tick + post > header_second * 10000000 - theirs - history)
"""


def _windows(name: str, source: str, keys: str) -> str:
    return f""",
{name}0 AS (SELECT {keys}, tick - pre AS lo, tick + post AS hi FROM {source}),
{name}1 AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {name}0),
{name}2 AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM {name}1),
{name} AS (SELECT {keys}, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM {name}2 GROUP BY {keys}, isle)
"""


_OWN = _W + f", {_SETTINGS}" + _windows("win", "(SELECT t.*, pre, post FROM t JOIN cf ON t.iog = cf.iog WHERE valid AND trigger_view AND (len(types) = 0 OR list_contains(types, subtype)))", "iog") + ", om AS (SELECT sel.*, win.lo FROM sel JOIN win ON sel.iog = win.iog AND sel.tick >= win.lo AND sel.tick < win.hi)\n"
_WIDE = _R + _windows("win", "rg", "iog, source, since, until, theirs, history") + """, wm AS (SELECT DISTINCT sel.iog, sel.seq, sel.word_idx, sel.pixel_id, sel.tick, win.source FROM sel JOIN win ON sel.iog = win.iog AND sel.tick >= win.lo AND sel.tick < win.hi
 WHERE (sel.receipt_tick + theirs) // 10000000 >= since AND (sel.receipt_tick + theirs) // 10000000 < until AND sel.receipt_tick - sel.tick <= history),
wl AS (SELECT source, iog, pixel_id, max(tick) AS tick, count(*) AS hits FROM wm GROUP BY ALL)
"""
_AUDIT = _W + """,
au0 AS (SELECT *, max(receipt_tick) OVER (PARTITION BY iog ORDER BY seq, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS front FROM sel),
au1 AS (SELECT *, CASE WHEN front >= 12500000 THEN front - 12500000 ELSE -1 END AS cursor, CASE WHEN io BETWEEN 1 AND 32 THEN (io - 1) // 4 + 1 END AS tile FROM au0),
au AS (SELECT *, tick <= cursor AS late FROM au1),
ch AS (SELECT iog, tile, chip, count(*) AS selected_hits, count(*) FILTER (late) AS late_hits, count(*) FILTER (raw >= 10000000) AS raw_ge_period, count(*) FILTER (late AND raw >= 10000000) AS late_raw_ge_period,
  count(*) FILTER (receipt >= 10000000) AS receipt_ge_period, count(*) FILTER (crossed) AS crossed_raw_receipt, count(*) FILTER (late AND crossed) AS late_crossed_raw_receipt FROM au GROUP BY ALL)
"""
_COUNTS = ("selected_hits", "late_hits", "raw_ge_period", "late_raw_ge_period", "receipt_ge_period", "crossed_raw_receipt", "late_crossed_raw_receipt")
_LABELS = "['[0,10us)','[10us,1ms)','[1ms,10ms)','[10ms,100ms)','[100ms,0.5s)','[0.5s,1s)','[1s,1.25s)','[1.25s,2s)','[2s,4s)','[4s,infinity)']"
_BIN = "greatest(len(list_filter([0,100,10000,100000,1000000,5000000,10000000,12500000,20000000,40000000], lambda e: v >= e)) - 1, 0)"

_MAPPED = """
WITH h AS (SELECT DISTINCT * FROM hits),
m AS (SELECT h.*, a.pixel_id FROM h LEFT JOIN dim_address a ON h.iog = a.iog AND h.io_channel = a.io_channel AND h.chip = a.chip AND h.channel = a.channel),
ar AS (SELECT *, message_seconds * 10000000 + receipt_timestamp % 10000000 AS arrival, (io_channel - 1) // 4 + 1 AS tile FROM m WHERE pixel_id IS NOT NULL AND message_seconds > 0 AND receipt_timestamp BETWEEN 0 AND 319999999)
"""
_METRICS = """mm AS (SELECT iog, count(*) FILTER (pixel_id IS NOT NULL) AS mapped, count(*) FILTER (pixel_id IS NULL) AS unmapped, count(*) FILTER (pixel_id IS NOT NULL AND "timestamp" < 10) AS filtered,
  count(*) FILTER (pixel_id IS NOT NULL AND "timestamp" >= 10) AS selected FROM m GROUP BY iog)"""
_FRAMES = _W + """,
fw0 AS (SELECT iog, seq, word_idx, 'D' AS kind, io_channel AS io, message_seconds AS header_second, receipt_timestamp AS receipt, NULL::BIGINT AS aux, "timestamp" AS raw, chip, channel, adc FROM h
  UNION ALL SELECT DISTINCT iog, seq, word_idx, kind, io, header_second, NULL, aux, NULL, NULL, NULL, NULL FROM words),
fw AS (SELECT *, row_number() OVER (PARTITION BY iog, seq ORDER BY word_idx) - 1 AS k, max(header_second) OVER (PARTITION BY iog, seq) AS hs, bool_or(kind = 'D' AND NOT coalesce(receipt BETWEEN 0 AND 4294967295, FALSE)) OVER (PARTITION BY iog, seq) AS short,
  CASE WHEN length(kind) = 1 AND ascii(kind) < 128 THEN kind ELSE '?' END AS letter, coalesce(io, 0) & 255 AS io8, coalesce(aux, 0) & 4294967295 AS aux32,
  kind = 'D' AND (chip IS NULL OR channel IS NULL OR raw IS NULL OR adc IS NULL) AS missing,
  kind = 'D' AND coalesce(chip BETWEEN 0 AND 255 AND channel BETWEEN 0 AND 63 AND adc BETWEEN 0 AND 255 AND raw BETWEEN 0 AND 2147483647, FALSE) AS good FROM fw0),
fa AS (SELECT *, CASE WHEN hs BETWEEN 0 AND 4294967295 THEN hs ELSE 0 END AS second FROM fw),
fr AS (SELECT * FROM fa WHERE NOT short AND hs IS NOT NULL)
"""
_WORDS = """SELECT iog, seq, CAST(k AS INT) AS word_idx, second AS header_second, letter AS kind, CAST(io8 AS INT) AS io,
 CASE WHEN kind = 'D' THEN receipt ELSE (aux32 % 65536) * 65536 END AS receipt, CASE WHEN kind = 'D' THEN receipt // 65536 ELSE aux32 END AS aux FROM fr"""
_SEEN = lambda behind, name: f"{name} AS (SELECT sel.iog, f.frontier_tick - {behind} AS cursor_tick, sel.pixel_id, max(sel.tick) AS tick FROM sel JOIN f ON sel.iog = f.iog WHERE sel.tick <= f.frontier_tick - {behind} GROUP BY ALL)"
_CLOCKS = _A + """,
lf AS (SELECT iog, max(header_second) AS lf, max(max(header_second)) OVER () AS now FROM w WHERE header_second > 0 GROUP BY iog),
ck AS (SELECT f.iog, (f.frontier_tick - 12500000) // 10000 AS base, f.frontier_tick // 10000 AS front, f.frontier_tick - f.initial_tick >= 12500000 AS running, (now - lf) * 1000 AS since, ac.last_status, ac.offset_ticks FROM f JOIN lf ON f.iog = lf.iog LEFT JOIN ac ON f.iog = ac.iog),
cs AS (SELECT *, CASE WHEN base < 0 THEN -1 ELSE base + CASE WHEN running THEN least(greatest(since, 0), 250, greatest(front - base, 0)) ELSE 0 END END AS shown_ms FROM ck),
cl AS (SELECT iog, shown_ms, CASE WHEN last_status = 'aligned' AND offset_ticks IS NOT NULL THEN offset_ticks // 10000 + shown_ms END AS unix_ms, running FROM cs)
"""
_CUMULATIVE = _W + """,
c0 AS (SELECT iog, header_second // 10 AS interval, count(*) AS words, count(*) FILTER (kind = 'D') AS data_hits, count(*) FILTER (kind = 'S') AS sync, count(*) FILTER (kind = 'T') AS triggers FROM w WHERE header_second > 0 GROUP BY ALL)
"""
_RECEIPTS = """
b0 AS (SELECT iog, count(*) FILTER (kind = 'S' AND io = 83) AS syncs, max(header_second) FILTER (kind = 'S' AND io = 83) AS ls, count(*) FILTER (kind = 'T') AS triggers, max(header_second) FILTER (kind = 'T') AS lt, max(header_second) AS lf FROM w WHERE header_second > 0 GROUP BY iog),
b1 AS (SELECT *, max(lf) OVER () + 2.0::DOUBLE AS now FROM b0),
b2 AS (SELECT *, greatest(0.0::DOUBLE, now - ls) AS sa, greatest(0.0::DOUBLE, now - lt) AS ta, greatest(0.0::DOUBLE, now - lf) AS fa FROM b1),
bs AS (SELECT iog, syncs, CASE WHEN ls IS NOT NULL THEN sa END AS sync_age, triggers, CASE WHEN lt IS NOT NULL THEN ta END AS trigger_age, fa < 3 AS healthy,
 CASE WHEN fa > 3.5 THEN 'unknown' WHEN ls IS NULL OR syncs = 0 THEN 'waiting' WHEN sa > 2.5 THEN 'stale' WHEN sa < 0.6 THEN 'pulse' ELSE 'live' END AS sync_badge,
 CASE WHEN fa > 3.5 THEN 'unknown' WHEN lt IS NOT NULL AND ta < 0.6 THEN 'pulse' ELSE 'idle' END AS trigger_badge FROM b2)
"""
_LEVEL = lambda a: f"CASE WHEN {a} IS NULL OR {a} < 0 OR floor({a} / 16) >= 250 THEN 0 ELSE CAST(floor(255 * exp(-16 * floor({a} / 16) / 500) + 0.5) AS INT) END"


def oracle_sql() -> dict[str, str]:
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in _COUNTS)
    return {
        "q_match_detector_wide": _WIDE + "SELECT * FROM wl",
        "q_pack_decode_roundtrip": """SELECT iog, seq, word_idx, 0 AS ptype, chip, channel, adc, 0 AS downstream, "timestamp" AS raw, TRUE AS odd FROM (SELECT DISTINCT * FROM hits)
 WHERE chip BETWEEN 0 AND 255 AND channel BETWEEN 0 AND 63 AND adc BETWEEN 0 AND 255 AND "timestamp" BETWEEN 0 AND 2147483647""",
        "q_frame_parse": _FRAMES + "SELECT iog, seq, CASE WHEN short THEN NULL WHEN hs IS NULL THEN '!' ELSE 'D' END AS kind, CASE WHEN NOT short THEN second END AS header_second, CASE WHEN NOT short THEN CAST(count(*) AS INT) END AS n_words, CASE WHEN short THEN 'word count' END AS reject FROM fa GROUP BY iog, seq, short, hs, second",
        "q_frame_words": _FRAMES + _WORDS,
        "q_frame_words_expr": _FRAMES + _WORDS,
        "q_frame_hits": _FRAMES + "SELECT iog, seq, CAST(k AS INT) AS word_idx, CAST(io8 AS INT) AS io_channel, chip, channel, adc, raw AS \"timestamp\", receipt AS receipt_timestamp, second AS message_seconds FROM fr WHERE good",
        "q_decode_counters": _FRAMES + """, fc AS (SELECT iog, count(DISTINCT seq) AS frames, count(DISTINCT seq) FILTER (short) AS malformed, count(DISTINCT seq) FILTER (NOT short AND hs IS NULL) AS nondata_messages FROM fa GROUP BY iog),
wc AS (SELECT iog, count(*) AS words, count(*) FILTER (kind = 'D') AS data_words, count(*) FILTER (kind = 'D' AND NOT missing) AS data_hits, count(*) FILTER (good) AS valid_data_hits, count(*) FILTER (kind = 'D' AND NOT missing AND NOT good) AS bad_parity,
 count(*) FILTER (kind = 'D' AND NOT missing AND coalesce(header_second = 0, FALSE)) AS downstream, count(*) FILTER (kind = 'D' AND NOT missing AND NOT coalesce(header_second = 0, FALSE)) AS upstream, count(*) FILTER (missing) AS other_packets,
 count(*) FILTER (missing AND word_idx % 3 = 0) AS packet_type_1, count(*) FILTER (missing AND word_idx % 3 = 1) AS packet_type_2, count(*) FILTER (missing AND word_idx % 3 = 2) AS packet_type_3, count(*) FILTER (letter = 'T') AS triggers, count(*) FILTER (letter = 'S') AS sync,
 count(*) FILTER (letter = 'S' AND io8 = 83) AS sync83_packets, count(*) FILTER (letter NOT IN ('D','T','S','P','W','R','E')) AS unknown_words FROM fr GROUP BY iog)
SELECT fc.iog, frames, malformed, nondata_messages, nondata_messages AS legacy_messages, words, data_words, data_hits, valid_data_hits, bad_parity, downstream, upstream, other_packets, data_hits AS packet_type_0, packet_type_1, packet_type_2, packet_type_3, triggers, sync, sync83_packets, unknown_words FROM fc JOIN wc ON fc.iog = wc.iog""",
        "q_tile_extents": _MAPPED + """, px AS (SELECT DISTINCT m.iog, g.tile, (pixel_id - first_pixel) % width AS c, (pixel_id - first_pixel) // width AS r, g.x_min, g.y_min, g.pitch FROM m JOIN dim_tile g ON m.iog = g.iog AND g.tile = (m.io_channel - 1) // 4 + 1 WHERE pixel_id IS NOT NULL)
SELECT iog, tile, count(*) AS n_pixels, round(min(x_min + c * pitch), 6) AS x_min, round(min(y_min + r * pitch), 6) AS y_min, CAST(max(c) - min(c) + 1 AS INT) AS width, CAST(max(r) - min(r) + 1 AS INT) AS height FROM px GROUP BY iog, tile""",
        "q_map_hits": _MAPPED + "SELECT iog, seq, word_idx, pixel_id FROM m",
        "q_mapping_metrics": _MAPPED + ", " + _METRICS + " SELECT * FROM mm",
        "q_raw_veto": _MAPPED + "SELECT iog, pixel_id, count(*) AS hits, min(\"timestamp\") AS least_raw FROM m WHERE pixel_id IS NOT NULL AND \"timestamp\" >= 10 GROUP BY ALL",
        "q_sync_steps": _W + "SELECT iog, seq, word_idx, coalesce(io = 83, FALSE) AS selected, step FROM st WHERE kind = 'S'",
        "q_unroll_hits": _W + "SELECT iog, seq, word_idx, tick, receipt_tick, ready, valid, crossed FROM d",
        "q_unroll_counters": _W + """, oo AS (SELECT iog, tick < max(tick) OVER (PARTITION BY iog ORDER BY seq, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM d WHERE valid)
SELECT s.*, coalesce(h.boundary_corrected, 0) AS boundary_corrected, coalesce(h.warmup_hits, 0) AS warmup_hits, coalesce(h.invalid_times, 0) AS invalid_times, coalesce(o.n, 0) AS out_of_order_hits FROM
 (SELECT iog, count(step) AS pps_syncs, count(*) FILTER (io <> 83) AS ignored_syncs, count(*) FILTER (io = 83 AND step IS NULL) AS invalid_syncs, CAST(coalesce(sum(step // 10000000 - 1), 0) AS BIGINT) AS missed_periods FROM st WHERE kind = 'S' GROUP BY iog) s
 LEFT JOIN (SELECT iog, count(*) FILTER (valid AND crossed) AS boundary_corrected, count(*) FILTER (NOT ready) AS warmup_hits, count(*) FILTER (ready AND NOT valid) AS invalid_times FROM d GROUP BY iog) h ON s.iog = h.iog
 LEFT JOIN (SELECT iog, count(*) FILTER (x) AS n FROM oo GROUP BY iog) o ON s.iog = o.iog""",
        "q_frontier": _W + "SELECT * FROM f",
        "q_flow_reference_diff": _W + "SELECT iog, count(*) AS compared_hits, 0 AS mismatches FROM d WHERE valid GROUP BY iog",
        "q_last_hit_per_pixel": _W + "SELECT iog, pixel_id, max(tick) AS tick, count(*) AS hits FROM sel GROUP BY ALL",
        "q_last_arrival_per_pixel": _MAPPED + "SELECT iog, pixel_id, max(arrival) AS arrival FROM ar GROUP BY ALL",
        "q_seen_at_cursor": _W + ", " + _SEEN(50000000, "x") + " SELECT * FROM x",
        "q_trigger_projection": _W + "SELECT iog, seq, word_idx, subtype, tick, valid FROM t",
        "q_subtype_histogram": _W + "SELECT iog, subtype, count(*) AS n, count(*) FILTER (NOT valid) AS invalid_times FROM t GROUP BY ALL",
        "q_windows_merged": _OWN + "SELECT iog, lo, hi, n FROM win",
        "q_windows_newest": _OWN + "SELECT iog, lo, hi, n FROM win QUALIFY row_number() OVER (PARTITION BY iog ORDER BY lo DESC) <= 64",
        "q_match_same_iog": _OWN + "SELECT iog, pixel_id, max(tick) AS tick, count(*) AS hits FROM om GROUP BY ALL",
        "q_pps_alignment": _A + "SELECT iog, seq, word_idx, tick, usable, consistent, status, offset_ticks FROM al2",
        "q_alignment_counters": _A + "SELECT * FROM ac",
        "q_route_triggers": _R + "SELECT * FROM r",
        "q_router_counters": _R + """SELECT iog, count(*) FILTER (iog NOT IN (5, 6)) AS unexpected_source, count(*) FILTER (iog IN (5, 6) AND NOT wanted) AS filtered_subtype, count(*) FILTER (iog IN (5, 6) AND wanted AND NOT valid) AS invalid_trigger_times,
 count(*) FILTER (iog IN (5, 6) AND wanted AND valid AND uncertain) AS uncertain_batch, count(*) FILTER (iog IN (5, 6) AND wanted AND valid AND NOT uncertain AND own IS NULL) AS source_unaligned, count(*) FILTER (iog IN (5, 6) AND wanted AND valid AND NOT uncertain AND own IS NOT NULL) AS accepted FROM tj GROUP BY iog""",
        "q_target_counters": _R + """SELECT cf.iog, count(*) FILTER (tick >= 0 AND source = 'beam') AS routed_beam, count(*) FILTER (tick >= 0 AND source = 'light') AS routed_light, (SELECT count(*) FROM q) - count(ra.iog) AS unaligned_target_skips,
 count(*) FILTER (tick < 0) AS invalid_projected_ticks, count(*) FILTER (tick >= 0 AND tick + ra.post <= header_second * 10000000 - theirs - ra.history) AS outside_history FROM cf LEFT JOIN ra ON cf.iog = ra.iog WHERE trigger_view GROUP BY cf.iog""",
        "q_match_counters": _WIDE + ", ph AS (SELECT iog, seq, word_idx, max(CAST(source = 'beam' AS INT)) AS b, max(CAST(source = 'light' AS INT)) AS l FROM wm GROUP BY ALL) SELECT iog, count(*) AS matched, CAST(sum(b) AS BIGINT) AS beam, CAST(sum(l) AS BIGINT) AS light FROM ph GROUP BY iog",
        "q_layer_union": _WIDE + "SELECT pixel_id, max(tick) AS tick FROM wl GROUP BY pixel_id",
        "q_layer_delta": _W + ", " + _SEEN(80000000, "x") + ", " + _SEEN(50000000, "y") + " SELECT coalesce(x.iog, y.iog) AS iog, coalesce(x.pixel_id, y.pixel_id) AS pixel_id, coalesce(y.tick, -1) AS tick FROM x FULL JOIN y ON x.iog = y.iog AND x.pixel_id = y.pixel_id WHERE x.tick IS DISTINCT FROM y.tick",
        "q_late_audit_chip": _AUDIT + "SELECT * FROM ch",
        "q_late_audit_tile": _AUDIT + f""", g AS (SELECT iog, tile, {sums} FROM ch GROUP BY iog, tile UNION ALL SELECT iog, 0, {sums} FROM ch GROUP BY iog),
z AS (SELECT s.iog, s.tile, {", ".join(f"coalesce(g.{c}, 0) AS {c}" for c in _COUNTS)} FROM (SELECT DISTINCT iog, unnest(range(0, 9)) AS tile FROM ch) s LEFT JOIN g ON s.iog = g.iog AND s.tile = g.tile)
SELECT *, late_hits::DOUBLE / nullif(selected_hits, 0) AS late_fraction FROM z""",
        "q_late_histograms": _AUDIT + f""", v AS (SELECT iog, 'receipt_lag' AS kind, greatest(receipt_tick - tick, 0) AS v FROM au UNION ALL SELECT iog, 'lateness', cursor - tick FROM au WHERE late),
n AS (SELECT iog, kind, {_BIN} AS bin, count(*) AS n FROM v GROUP BY ALL),
sp AS (SELECT DISTINCT iog, kind, unnest(range(0, 10)) AS bin FROM (SELECT DISTINCT iog FROM au) a, (VALUES ('receipt_lag'), ('lateness')) k(kind))
SELECT sp.iog, sp.kind, CAST(sp.bin AS INT) AS bin, ({_LABELS})[sp.bin + 1] AS label, coalesce(n.n, 0) AS n FROM sp LEFT JOIN n ON sp.iog = n.iog AND sp.kind = n.kind AND sp.bin = n.bin""",
        "q_late_maxima": _AUDIT + "SELECT iog, max(CASE WHEN late THEN cursor - tick END) AS max_lateness_ticks, max(greatest(receipt_tick - tick, 0)) AS max_lag_ticks FROM au GROUP BY iog",
        "q_top_late_chips": _AUDIT + "SELECT *, row_number() OVER (PARTITION BY iog ORDER BY late_hits DESC, tile DESC, chip DESC) AS rank FROM ch WHERE late_hits > 0 QUALIFY rank <= 20",
        "q_late_samples": _AUDIT + """, k3 AS (SELECT * FROM au WHERE late QUALIFY row_number() OVER (PARTITION BY iog, seq ORDER BY word_idx DESC) <= 3)
SELECT iog, CAST(row_number() OVER (PARTITION BY iog ORDER BY seq DESC, word_idx DESC) AS INT) AS k, seq, word_idx, tile, chip, channel, raw // 10000000 AS raw_cycles, raw % 10000000 AS phase, tick, cursor, cursor - tick AS lateness_ticks, greatest(receipt_tick - tick, 0) AS lag_ticks FROM k3 QUALIFY k <= 12""",
        "q_tile_rate_intervals": _MAPPED + """, n AS (SELECT iog, arrival // 10000000 AS interval, tile, count(*) AS c, count(DISTINCT pixel_id) AS u FROM ar GROUP BY ALL),
sp AS (SELECT x.iog, x.interval, g.tile, g.n_pixels FROM (SELECT DISTINCT iog, interval FROM n) x JOIN dim_tile g ON x.iog = g.iog)
SELECT sp.iog, sp.interval, sp.tile, coalesce(c, 0) AS mapped_packets, CAST(coalesce(c, 0) AS DOUBLE) AS mapped_packets_per_s, coalesce(u, 0) AS unique_pixels, coalesce(u, 0) / CAST(sp.n_pixels AS DOUBLE) AS active_fraction FROM sp LEFT JOIN n ON sp.iog = n.iog AND sp.interval = n.interval AND sp.tile = n.tile""",
        "q_source_rate_deltas": _CUMULATIVE + "SELECT iog, interval, words, data_hits, sync, triggers FROM c0",
        "q_capture_gaps": """WITH o AS (SELECT boot_id, seq, max(begin_monotonic) AS b, max(end_monotonic) AS e FROM tile_rates GROUP BY ALL), l AS (SELECT *, lag(seq) OVER p AS ps, lag(e) OVER p AS pe FROM o WINDOW p AS (PARTITION BY boot_id ORDER BY seq))
SELECT boot_id, seq, coalesce(seq - ps - 1, 0) AS lost, ps IS NOT NULL AND NOT coalesce(seq = ps + 1 AND abs(b - pe) <= 1e-5, FALSE) AS breaks, coalesce(e > b, FALSE) AS advances FROM l""",
        "q_capture_checks": """WITH o AS (SELECT boot_id, seq, max(begin_monotonic) AS b, max(end_monotonic) AS e FROM tile_rates GROUP BY ALL), l AS (SELECT *, lag(seq) OVER p AS ps, lag(e) OVER p AS pe FROM o WINDOW p AS (PARTITION BY boot_id ORDER BY seq)),
g AS (SELECT boot_id, count(*) AS n, CAST(sum(coalesce(seq - ps - 1, 0)) AS BIGINT) AS lost, count(*) FILTER (ps IS NOT NULL AND NOT coalesce(seq = ps + 1 AND abs(b - pe) <= 1e-5, FALSE)) AS breaks, count(*) FILTER (NOT coalesce(e > b, FALSE)) AS rev FROM l GROUP BY boot_id)
SELECT c.boot_id, iog, samples, coalesce(n, 0) AS found_samples, missing_intervals, coalesce(lost, 0) AS found_missing, coalesce(breaks, 0) AS breaks, coalesce(rev, 0) AS reversed, samples = coalesce(n, 0) AS samples_agree, missing_intervals = coalesce(lost, 0) AS missing_agree
FROM (SELECT DISTINCT * FROM rate_captures) c LEFT JOIN g ON c.boot_id = g.boot_id""",
        "q_rate_ring_page": """WITH s AS (SELECT DISTINCT boot_id, seq FROM tile_rates), n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY boot_id ORDER BY seq DESC) <= 600),
e AS (SELECT *, min(seq) OVER (PARTITION BY boot_id) AS oldest, max(seq) OVER (PARTITION BY boot_id) AS latest FROM n) SELECT * FROM e WHERE seq > 20 QUALIFY row_number() OVER (PARTITION BY boot_id ORDER BY seq) <= 100""",
        "q_snapshot_deltas": _CUMULATIVE + """, p AS (SELECT *, percent_rank() OVER (PARTITION BY iog ORDER BY interval) AS p FROM c0),
z AS (SELECT iog, counter, CAST(sum(v) FILTER (p <= 0.5) AS BIGINT) AS "before", CAST(sum(v) AS BIGINT) AS "after" FROM (SELECT iog, p, unnest(['words', 'data_hits', 'sync', 'triggers']) AS counter, unnest([words, data_hits, sync, triggers]) AS v FROM p) GROUP BY iog, counter)
SELECT *, "after" - "before" AS delta, NULL::VARCHAR AS problem FROM z""",
        "q_verifier_issues": _A + """, y AS (SELECT *, sum(CASE WHEN usable THEN 0 ELSE 1 END) OVER (PARTITION BY iog ORDER BY seq, word_idx ROWS UNBOUNDED PRECEDING) AS counter FROM al2),
x AS (SELECT second // 600 AS session, iog, status, now, fresh, fresh_at, second, offset_ticks, counter, lag(offset_ticks) OVER s AS lo, lag(counter) OVER s AS lc FROM y WINDOW s AS (PARTITION BY second // 600, iog ORDER BY seq, word_idx)),
i AS (SELECT session, iog, 'collector unhealthy' AS issue FROM x WHERE NOT coalesce(now - fresh < 3, FALSE) UNION ALL SELECT session, iog, 'period unsupported' FROM x WHERE NOT coalesce(second > 0, FALSE)
 UNION ALL SELECT session, iog, 'epoch not freshly qualified' FROM x WHERE NOT coalesce(status = 'aligned' AND now - fresh_at BETWEEN 0 AND 2.5, FALSE) UNION ALL SELECT session, iog, 'no epoch offset' FROM x WHERE offset_ticks IS NULL
 UNION ALL SELECT session, iog, 'offset changed' FROM x WHERE lo <> offset_ticks UNION ALL SELECT session, iog, 'counter changed' FROM x WHERE lc <> counter)
SELECT session, iog, issue, count(*) AS samples FROM i GROUP BY ALL""",
        "q_revocations": _A + "SELECT * FROM rv",
        "q_current_generation": _A + ", z AS (SELECT max(time) AS last FROM rv) SELECT iog, count(*) AS triggers FROM (SELECT DISTINCT * FROM words) w, z WHERE kind = 'T' AND coalesce(header_second > last, TRUE) GROUP BY iog",
        "q_batch_cap": _W + "SELECT iog, seq, word_idx, subtype, tick, count(*) OVER (PARTITION BY iog, seq // 256) AS of FROM t WHERE valid QUALIFY row_number() OVER (PARTITION BY iog, seq // 256 ORDER BY seq DESC, word_idx DESC) <= 3",
        "q_playback_counters": _W + """, el AS (SELECT d.*, max(receipt_tick) OVER (PARTITION BY d.iog ORDER BY seq, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS front FROM d JOIN dim_address a ON d.iog = a.iog AND d.io = a.io_channel AND d.chip = a.chip AND d.channel = a.channel WHERE d.valid),
l AS (SELECT *, coalesce(front >= 12500000 AND tick <= front - 12500000, FALSE) AS late FROM el)
SELECT iog, count(*) AS timing_eligible_hits, count(*) FILTER (late) AS pre_cut_late_hits, count(*) FILTER (raw < 10) AS post_sync_filtered_hits, count(*) FILTER (raw >= 10) AS display_selected_hits, count(*) FILTER (raw >= 10 AND late) AS late_hits FROM l GROUP BY iog""",
        "q_display_labels": _CLOCKS + "SELECT iog, unix_ms, strftime(make_timestamp(unix_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS utc FROM cl",
        "q_receipt_status": _W + "," + _RECEIPTS + "SELECT * FROM bs",
        "q_source_totals": _W + "," + _RECEIPTS + ", m AS (SELECT h.*, a.pixel_id FROM h LEFT JOIN dim_address a ON h.iog = a.iog AND h.io_channel = a.io_channel AND h.chip = a.chip AND h.channel = a.channel), " + _METRICS + " SELECT CAST(sum(mapped) AS BIGINT) AS mapped, count(*) FILTER (healthy) AS receiving, CAST(sum(unmapped) AS BIGINT) AS unmapped, CAST(sum(filtered) AS BIGINT) AS filtered FROM mm JOIN bs ON mm.iog = bs.iog",
        "q_displayed_clock": _CLOCKS + "SELECT * FROM cl",
        "q_clock_summary": _CLOCKS + """, z AS (SELECT count(*) AS sources, count(unix_ms) AS labelled, min(unix_ms) AS oldest_ms, max(unix_ms) AS newest_ms, count(*) FILTER (unix_ms IS NOT NULL AND NOT running) AS buffering FROM cl)
SELECT *, newest_ms - oldest_ms AS spread_ms, CASE WHEN labelled = 0 THEN 'warming' WHEN labelled < sources THEN 'partial' WHEN buffering > 0 THEN 'buffering' ELSE 'running' END AS kind FROM z""",
        "q_phosphor_levels": _OWN + ", " + _SEEN(12500000, "x") + f""", tg AS (SELECT pixel_id, max(tick) AS tagged FROM om GROUP BY pixel_id),
y AS (SELECT x.iog, x.pixel_id, (cursor_tick - tick) // 10000 AS a, CASE WHEN tagged <= cursor_tick THEN (cursor_tick - tagged) // 10000 END AS b FROM x LEFT JOIN tg ON x.pixel_id = tg.pixel_id),
lv AS (SELECT iog, pixel_id, {_LEVEL("a")} AS level, {_LEVEL("b")} AS "only" FROM y)
SELECT *, greatest("only", level // 4) AS highlight FROM lv""",
        "q_hover_lookup": _MAPPED + """, p AS (SELECT DISTINCT m.iog, g.tile, pixel_id, (pixel_id - first_pixel) % width AS col, (pixel_id - first_pixel) // width AS row, height FROM m JOIN dim_tile g ON m.iog = g.iog AND g.tile = (m.io_channel - 1) // 4 + 1 WHERE pixel_id IS NOT NULL)
SELECT iog, tile, pixel_id, CAST(col AS INT) AS col, CAST(row AS INT) AS row, CAST(height - 1 - row AS INT) AS screen_row FROM p""",
    }
