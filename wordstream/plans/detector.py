"""Queries of the detector pipeline over hits, words and the dimensions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Timing
from ..functions.payload import field, odd_parity, pack_payload
from ..functions.prefix import running
from ..functions.ticks import R, div
from ..operators import audits, epochs, geometry, playback, state, timing, triggers
from ..session import checkpoint
from ..sources import stream as wire
from ..sources.tables import table

CFG = Timing()
#: Ticks of a bucket of the window joins, some times the widest window.
BUCKET = 50_000


class Feed:
    """What a query reads, each made once: tables, the word stream with repeated rows, its syncs, and what the syncs say of the clocks."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.table = lru_cache(None)(lambda name: table(spark, folder, name))

    @cached_property
    def words(self) -> DataFrame:
        return wire.word_stream(self.table("hits"), self.table("words"), distinct=False)

    @cached_property
    def syncs(self) -> DataFrame:
        return timing.sync_epochs(self.words, CFG)

    @cached_property
    def aligned(self) -> DataFrame:
        return epochs.align(epochs.pps_observations(self.words, CFG, self.syncs), cfg=CFG)

    @cached_property
    def lost(self) -> DataFrame:
        return checkpoint(epochs.revocations(self.aligned))  # rare


def stream(x: Feed) -> DataFrame:
    return wire.word_stream(x.table("hits"), x.table("words"))


def frames(x: Feed) -> DataFrame:
    return wire.encode_frames(wire.word_stream(x.table("hits"), x.table("words"), fitting=False))


def mapped(x: Feed) -> DataFrame:
    return geometry.map_hits(x.table("hits").dropDuplicates(), x.table("dim_address"))


def selected(x: Feed) -> DataFrame:
    """Timed, mapped hits after the veto, with their pixel."""
    u = timing.unroll(x.words, CFG, x.syncs).where("valid").withColumnRenamed("io", "io_channel").withColumnRenamed("raw", "timestamp")
    m = geometry.raw_veto(geometry.map_hits(u, x.table("dim_address")), CFG.min_raw)
    return m.withColumnRenamed("io_channel", "io").withColumnRenamed("timestamp", "raw")


def judged(x: Feed) -> DataFrame:
    """T words with valid, wanted, uncertain (their frame revoked the alignment of its source) and own offset."""
    frames = x.lost.where("NOT paused").select("iog", "seq", F.lit(True).alias("__lost")).distinct()
    t = triggers.wanted(epochs.qualified(x.words, x.aligned, CFG), x.table("observer_config"))
    return t.join(frames, ["iog", "seq"], "left").withColumn("uncertain", F.coalesce("__lost", F.lit(False))).drop("__lost")


def routed(x: Feed) -> tuple[DataFrame, DataFrame]:
    """Qualified triggers, and the same on the clocks of their targets."""
    t = checkpoint(judged(x).where("valid AND wanted AND NOT uncertain AND own IS NOT NULL AND iog IN (5, 6)"))  # one row a trigger
    return t, triggers.route(t, epochs.target_offsets(x.aligned), x.table("observer_config"))


def wide_windows(x: Feed) -> DataFrame:
    """Windows of each target and source, by generation of the alignments."""
    t, r = routed(x)
    r = triggers.in_history(r.where("tick >= 0")).join(epochs.generations(t.select("second").distinct(), x.lost), "second")
    return triggers.merge_windows(r, None, ("iog", "source", "since", "until", "theirs", "history"))


def wide_matched(x: Feed) -> DataFrame:
    return triggers.match_generations(selected(x), wide_windows(x), BUCKET)


def match_detector_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: latest hit of each pixel inside a trigger window of each detector-wide source."""
    return _wide_layer(Feed(spark, folder))


def _wide_layer(x: Feed) -> DataFrame:
    return triggers.latest_per_pixel(wide_matched(x), ("source", "iog"))


def _targets(x: Feed) -> DataFrame:
    t, r = routed(x)
    return triggers.target_counters(t, r, x.table("observer_config"))


def own_windows(x: Feed) -> DataFrame:
    """Windows of each source's own triggers, by its settings."""
    config = x.table("observer_config")
    t = triggers.wanted(triggers.project_triggers(x.words, CFG, x.syncs), config).where("valid AND wanted")
    return triggers.merge_windows(t.join(F.broadcast(triggers.settings(config)), "iog"))


def own_matched(x: Feed) -> DataFrame:
    return triggers.match_hits(selected(x), own_windows(x), ("iog",), BUCKET)


def cursors(x: Feed, behind: int) -> DataFrame:
    f = timing.frontiers(x.words, CFG, x.syncs)
    return f.select("iog", (F.col("frontier_tick") - behind).alias("cursor_tick"))


def audit(x: Feed) -> DataFrame:
    return audits.audited(selected(x), CFG)


def _pack(x: Feed) -> DataFrame:
    p = F.col("payload")
    rows = x.table("hits").dropDuplicates().select("iog", "seq", "word_idx", pack_payload(F.col("chip"), F.col("channel"), F.col("timestamp"), F.col("adc")).alias("payload")).where("payload IS NOT NULL")
    return rows.select("iog", "seq", "word_idx", *(field(p, n).cast("int").alias(n) for n in ("ptype", "chip", "channel", "adc", "downstream")), field(p, "timestamp").alias("raw"), odd_parity(p).alias("odd"))


def _counters(x: Feed) -> DataFrame:
    f = frames(x)
    return wire.decode_counters(wire.decode_frames(f), wire.parse_frames(f))


def _arrivals(x: Feed) -> DataFrame:
    """Mapped hits with an arrival time in ticks."""
    m = geometry.map_hits(x.table("hits").dropDuplicates(), x.table("dim_address"))
    return m.where("pixel_id IS NOT NULL AND message_seconds > 0 AND receipt_timestamp BETWEEN 0 AND 319999999")


def _arrival() -> F.Column:
    return F.col("message_seconds") * R + F.col("receipt_timestamp") % R


def _source_counts(x: Feed) -> DataFrame:
    """Counters of each iog and interval of 10 s of arrival."""
    w = stream(x).where("header_second > 0")
    one = w.groupBy("iog", div(F.col("header_second"), 10).alias("interval")).agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("kind") == "D").alias("data_hits"), F.count_if(F.col("kind") == "S").alias("sync"), F.count_if(F.col("kind") == "T").alias("triggers"))
    by = Window.partitionBy("iog").orderBy("interval")
    return one.select("iog", "interval", *(F.sum(c).over(by).alias(c) for c in ("words", "data_hits", "sync", "triggers")))


def _receipts(x: Feed) -> DataFrame:
    """Receipt status 2 s after the last second of the stream."""
    w = stream(x).where("header_second > 0")
    by = w.groupBy("iog").agg(F.count_if((F.col("kind") == "S") & (F.col("io") == 83)).alias("syncs"), F.max(F.when((F.col("kind") == "S") & (F.col("io") == 83), F.col("header_second"))).alias("last_sync"), F.count_if(F.col("kind") == "T").alias("triggers"), F.max(F.when(F.col("kind") == "T", F.col("header_second"))).alias("last_trigger"), F.max("header_second").alias("last_frame"))
    now = by.agg(F.max("last_frame").alias("now"))
    joined = by.withColumn("now", now.scalar()).select("*", *(F.coalesce(F.col(c), F.lit(0)).cast("double").alias(f"d_{c}") for c in ("last_sync", "last_trigger", "last_frame")))
    rows = joined.select("iog", "syncs", "triggers", "now", *(F.col(f"d_{c}").alias(c) for c in ("last_sync", "last_trigger", "last_frame")))
    return state.receipt_status(rows, F.col("now") + 2.0)


def _last_frames(x: Feed) -> DataFrame:
    """Last second of each iog, and of all."""
    last = x.words.where("header_second > 0").groupBy("iog").agg(F.max("header_second").alias("last_frame"))
    return last.withColumn("now", last.agg(F.max("last_frame")).scalar())


def _layers(x: Feed, behind: int) -> DataFrame:
    return playback.seen_at(selected(x), cursors(x, behind)).select("iog", "pixel_id", "tick")


def _clocks(x: Feed) -> DataFrame:
    """Displayed Unix milliseconds of each iog one playback delay behind its frontier."""
    a = epochs.alignment_counters(x.aligned)
    f = timing.frontiers(x.words, CFG, x.syncs).join(_last_frames(x), "iog")
    running = F.col("frontier_tick") - F.col("initial_tick") >= 12_500_000
    since = (F.col("now") - F.col("last_frame")) * 1000
    base = F.call_function("div", F.col("frontier_tick") - 12_500_000, F.lit(10_000).cast("bigint"))
    shown = state.displayed_clock(base, F.call_function("div", F.col("frontier_tick"), F.lit(10_000).cast("bigint")), running, since)
    unix = F.when((F.col("last_status") == "aligned") & F.col("offset_ticks").isNotNull(), F.call_function("div", F.col("offset_ticks"), F.lit(10_000).cast("bigint")) + shown)
    return f.join(a, "iog", "left").select("iog", shown.alias("shown_ms"), unix.alias("unix_ms"), running.alias("running"))


def _phosphor(x: Feed) -> DataFrame:
    seen = playback.seen_at(selected(x), cursors(x, 12_500_000))
    tag = triggers.union_layer(own_matched(x)).withColumnRenamed("tick", "tagged")
    rows = seen.join(tag, "pixel_id", "left")
    ms = lambda c: F.call_function("div", F.col("cursor_tick") - F.col(c), F.lit(10_000).cast("bigint"))
    plain, tagged = state.brightness(ms("tick")), F.when(F.col("tagged") <= F.col("cursor_tick"), state.brightness(ms("tagged"))).otherwise(0)
    return rows.select("iog", "pixel_id", plain.alias("level"), *(state.paint(m, plain, tagged).alias(m) for m in ("only", "highlight")))


def _hover(x: Feed) -> DataFrame:
    """Raster cells of the places at which the hits of each pixel lie."""
    tiles = x.table("dim_tile")
    at = _places(x).select("iog", "tile", "pixel_id", "x", "y")
    return geometry.hover_lookup(at, tiles).select("iog", "tile", "pixel_id", "col", "row", "screen_row")


def _places(x: Feed) -> DataFrame:
    """Pixels that have hits, with their place by their number in the tile's raster."""
    tiles = x.table("dim_tile").select("iog", "tile", "first_pixel", "width", "x_min", "y_min", "pitch")
    px = mapped(x).where("pixel_id IS NOT NULL").select("iog", geometry.tile_of(F.col("io_channel")).alias("tile"), "pixel_id").distinct().join(tiles, ["iog", "tile"])
    k = F.col("pixel_id") - F.col("first_pixel")
    return px.select("iog", "tile", "pixel_id", "pitch", (F.col("x_min") + (k % F.col("width")) * F.col("pitch")).alias("x"), (F.col("y_min") + F.floor(k / F.col("width")) * F.col("pitch")).alias("y"))


def _extents(x: Feed) -> DataFrame:
    """Extents of the tiles over the pixels that have hits."""
    return geometry.tile_extents(_places(x))


def _samples(x: Feed) -> DataFrame:
    """Verifier issues over samples taken at every observation, in sessions of 600 s."""
    a = running(x.aligned, {"counter": ("sum", F.when(~F.col("usable"), 1))}, inclusive=True)
    healthy = F.col("now") - F.col("fresh_before") < state.HEALTHY
    return audits.verify(a.select(F.call_function("div", "second", F.lit(600).cast("bigint")).alias("session"), "iog", F.struct("seq", "word_idx").alias("elapsed"), healthy.alias("healthy"), (F.col("second") > 0).alias("supported"), "status", (F.col("now") - F.col("fresh_at")).alias("age"), "offset_ticks", "counter"))


def _current(x: Feed) -> DataFrame:
    """T words of the current generation of alignments by iog."""
    w = x.table("words").where("kind = 'T'").dropDuplicates()
    return epochs.since_last_revocation(w, x.lost, F.col("header_second")).groupBy("iog").agg(F.count(F.lit(1)).alias("triggers"))


def _eligible(x: Feed) -> DataFrame:
    u = timing.unroll(x.words, CFG, x.syncs).where("valid").withColumnRenamed("io", "io_channel")
    return geometry.map_hits(u, x.table("dim_address")).where("pixel_id IS NOT NULL")


def _snapshot(x: Feed) -> DataFrame:
    """Increases of the counters of each iog over the second half of the stream."""
    c = _source_counts(x)
    half = F.percent_rank().over(Window.partitionBy("iog").orderBy("interval"))
    r = c.withColumn("p", half)
    cols = ["words", "data_hits", "sync", "triggers"]
    last = lambda df: df.groupBy("iog").agg(*(F.max(x).alias(x) for x in cols))
    return audits.snapshot_deltas(last(r.where("p <= 0.5")), last(r), ["iog"], cols)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[Feed], DataFrame]] = {
        "q_match_detector_wide": _wide_layer,
        "q_pack_decode_roundtrip": _pack,
        "q_frame_parse": lambda x: wire.parse_frames(frames(x)).select("iog", "seq", "kind", "header_second", "n_words", "reject"),
        "q_frame_words": lambda x: wire.decode_frames(frames(x)).drop("payload"),
        "q_frame_words_expr": lambda x: wire.explode_words(wire.parse_frames(frames(x))).drop("payload"),
        "q_frame_hits": lambda x: wire.decode_hits(wire.decode_frames(frames(x))),
        "q_decode_counters": _counters,
        "q_tile_extents": _extents,
        "q_map_hits": lambda x: mapped(x).select("iog", "seq", "word_idx", "pixel_id"),
        "q_mapping_metrics": lambda x: geometry.mapping_metrics(mapped(x)),
        "q_raw_veto": lambda x: geometry.raw_veto(mapped(x)).groupBy("iog", "pixel_id").agg(F.count(F.lit(1)).alias("hits"), F.min("timestamp").alias("least_raw")),
        "q_sync_steps": lambda x: timing.sync_steps(stream(x)).select("iog", "seq", "word_idx", "selected", "step"),
        "q_unroll_hits": lambda x: timing.unroll(x.words, CFG, x.syncs).select("iog", "seq", "word_idx", "tick", "receipt_tick", "ready", "valid", "crossed"),
        "q_unroll_counters": lambda x: timing.unroll_counters(x.words, CFG, x.syncs),
        "q_frontier": lambda x: timing.frontiers(x.words, CFG, x.syncs),
        "q_flow_reference_diff": lambda x: timing.flow_difference(x.words),
        "q_last_hit_per_pixel": lambda x: triggers.latest_per_pixel(selected(x), ("iog",)),
        "q_last_arrival_per_pixel": lambda x: _arrivals(x).groupBy("iog", "pixel_id").agg(F.max(_arrival()).alias("arrival")),
        "q_seen_at_cursor": lambda x: playback.seen_at(selected(x), cursors(x, 50_000_000)),
        "q_trigger_projection": lambda x: triggers.project_triggers(x.words, CFG, x.syncs).drop("second"),
        "q_subtype_histogram": lambda x: triggers.subtype_histogram(triggers.project_triggers(x.words, CFG, x.syncs)),
        "q_windows_merged": lambda x: own_windows(x),
        "q_windows_newest": lambda x: triggers.newest_windows(own_windows(x), 64),
        "q_match_same_iog": lambda x: triggers.latest_per_pixel(own_matched(x), ("iog",)),
        "q_pps_alignment": lambda x: x.aligned.select("iog", "seq", "word_idx", "tick", "usable", "consistent", "status", "offset_ticks"),
        "q_alignment_counters": lambda x: epochs.alignment_counters(x.aligned),
        "q_route_triggers": lambda x: routed(x)[1].where("tick >= 0").select("source", "source_iog", "seq", "word_idx", "subtype", "iog", "tick"),
        "q_target_counters": _targets,
        "q_router_counters": lambda x: triggers.router_counters(judged(x)),
        "q_match_counters": lambda x: triggers.match_counters(wide_matched(x)),
        "q_layer_union": lambda x: triggers.union_layer(_wide_layer(x)),
        "q_layer_delta": lambda x: state.layer_delta(_layers(x, 80_000_000), _layers(x, 50_000_000), ("iog", "pixel_id")),
        "q_late_audit_chip": lambda x: audits.late_by_chip(audit(x)),
        "q_late_audit_tile": lambda x: audits.late_rollup(audits.late_by_chip(audit(x))),
        "q_late_histograms": lambda x: audits.late_histograms(audit(x)),
        "q_late_maxima": lambda x: audits.late_maxima(audit(x)),
        "q_top_late_chips": lambda x: audits.top_late_chips(audits.late_by_chip(audit(x))),
        "q_late_samples": lambda x: audits.late_samples(audit(x)),
        "q_tile_rate_intervals": lambda x: audits.interval_rates(_arrivals(x), x.table("dim_tile"), _arrival(), R),
        "q_source_rate_deltas": lambda x: audits.source_deltas(_source_counts(x), ["words", "data_hits", "sync", "triggers"]),
        "q_capture_gaps": lambda x: audits.capture_breaks(x.table("tile_rates")),
        "q_capture_checks": lambda x: audits.reconcile(x.table("rate_captures"), audits.capture_breaks(x.table("tile_rates"))),
        "q_rate_ring_page": lambda x: audits.ring_page(x.table("tile_rates"), after=20, limit=100),
        "q_snapshot_deltas": _snapshot,
        "q_verifier_issues": _samples,
        "q_revocations": lambda x: x.lost,
        "q_current_generation": _current,
        "q_batch_cap": lambda x: triggers.batch_cap(triggers.accepted(triggers.project_triggers(x.words, CFG, x.syncs)), 3, div(F.col("seq"), 256)).select("iog", "seq", "word_idx", "subtype", "tick", "of"),
        "q_playback_counters": lambda x: audits.playback_counters(_eligible(x)),
        "q_display_labels": lambda x: _clocks(x).select("iog", "unix_ms", state.format_time(F.col("unix_ms"), "UTC").alias("utc")),
        "q_receipt_status": _receipts,
        "q_source_totals": lambda x: state.source_totals(geometry.mapping_metrics(mapped(x)).join(_receipts(x).select("iog", "healthy"), "iog")),
        "q_displayed_clock": _clocks,
        "q_clock_summary": lambda x: state.clock_summary(_clocks(x)),
        "q_phosphor_levels": _phosphor,
        "q_hover_lookup": _hover,
    }
    return {name: (lambda s, d, f=f: f(Feed(s, d))) for name, f in q.items()}
