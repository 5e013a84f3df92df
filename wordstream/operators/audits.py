"""Audits: lateness by chip and tile, histograms, rates of intervals, gaps of captures, and comparisons of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Timing
from ..functions.prefix import running
from ..functions.ticks import div
from .geometry import tile_of

#: Lower edges of the histograms in ticks of 100 ns and their labels; fixed values.
EDGES = (0, 100, 10_000, 100_000, 1_000_000, 5_000_000, 10_000_000, 12_500_000, 20_000_000, 40_000_000)
LABELS = ("[0,10us)", "[10us,1ms)", "[1ms,10ms)", "[10ms,100ms)", "[100ms,0.5s)", "[0.5s,1s)", "[1s,1.25s)", "[1.25s,2s)", "[2s,4s)", "[4s,infinity)")
#: Counters of an audit; fixed names.
COUNTS = ("selected_hits", "late_hits", "raw_ge_period", "late_raw_ge_period", "receipt_ge_period", "crossed_raw_receipt", "late_crossed_raw_receipt")
#: Intervals a rate ring keeps.
RING = 600


def audited(selected: DataFrame, cfg: Timing = Timing()) -> DataFrame:
    """Selected hits (mapped, timed, after the veto) with cursor, late, and the other flags of the audit.

    The cursor at a hit is the greatest receipt tick before it in wire order, less the playback delay; -1 before it starts.
    """
    delay = round(cfg.delay / cfg.tick_seconds)
    r = running(selected, {"front": ("max", F.col("receipt_tick"))})
    cursor = F.when(F.col("front") >= delay, F.col("front") - delay).otherwise(F.lit(-1))
    r = r.withColumn("cursor", cursor)
    return r.select(
        "iog", "seq", "word_idx", tile_of(F.col("io")).alias("tile"), "chip", "channel", "io", "raw", "receipt", "tick", "receipt_tick", "cursor", (F.col("tick") <= F.col("cursor")).alias("late"),
        (F.col("raw") >= cfg.period).alias("raw_ge"), (F.col("receipt") >= cfg.period).alias("receipt_ge"), "crossed",
    )


def _counts() -> list[Column]:
    late, raw, rec, cross = (F.col(c) for c in ("late", "raw_ge", "receipt_ge", "crossed"))
    return [F.count_if(m).alias(n) for n, m in zip(COUNTS, (F.lit(True), late, raw, late & raw, rec, cross, late & cross))]


def late_by_chip(audit: DataFrame) -> DataFrame:
    return audit.groupBy("iog", "tile", "chip").agg(*_counts())


def late_rollup(by_chip: DataFrame) -> DataFrame:
    """Totals of each iog and of each of its 8 tiles, tiles without hits included; tile 0 is the whole iog."""
    sums = [F.sum(c).alias(c) for c in COUNTS]
    own = by_chip.rollup("iog", "tile").agg(*sums, F.grouping("tile").alias("g")).where("iog IS NOT NULL").withColumn("tile", F.when(F.col("g") == 1, 0).otherwise(F.col("tile"))).drop("g")
    spine = by_chip.select("iog").distinct().select("iog", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("tile"))
    full = spine.join(own, ["iog", "tile"], "left").fillna(0, list(COUNTS))
    return full.withColumn("late_fraction", F.try_divide("late_hits", "selected_hits"))


def top_late_chips(by_chip: DataFrame, most: int = 20) -> DataFrame:
    """The chips of each iog with most late hits; of equal ones the highest (tile, chip). A top-k report."""
    by = Window.partitionBy("iog").orderBy(F.desc("late_hits"), F.desc("tile"), F.desc("chip"))
    return by_chip.where("late_hits > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def late_samples(audit: DataFrame, most: int = 12, per_frame: int = 3) -> DataFrame:
    """The last late hits of each iog, at most three of a frame. A sampling report."""
    frame = Window.partitionBy("iog", "seq").orderBy(F.desc("word_idx"))
    last = Window.partitionBy("iog").orderBy(F.desc("seq"), F.desc("word_idx"))
    rows = audit.where("late").withColumn("k", F.row_number().over(frame)).where(F.col("k") <= per_frame)
    rows = rows.withColumn("k", F.row_number().over(last)).where(F.col("k") <= most)
    return rows.select("iog", "k", "seq", "word_idx", "tile", "chip", "channel", F.call_function("div", "raw", F.lit(10_000_000).cast("bigint")).alias("raw_cycles"), (F.col("raw") % 10_000_000).alias("phase"), "tick", "cursor", (F.col("cursor") - F.col("tick")).alias("lateness_ticks"), F.greatest(F.col("receipt_tick") - F.col("tick"), F.lit(0)).alias("lag_ticks"))


def bin_of(ticks: Column) -> Column:
    """Number of the histogram bin of a duration: half-open, the last one open-ended, negative ones in the first."""
    return F.greatest(F.size(F.filter(F.array(*(F.lit(e) for e in EDGES)), lambda e: ticks >= e)) - 1, F.lit(0))


def late_histograms(audit: DataFrame) -> DataFrame:
    """Counts of lateness and of receipt lag by bin for each iog, empty bins included."""
    kinds = F.array(F.struct(F.lit("receipt_lag").alias("kind"), F.greatest(F.col("receipt_tick") - F.col("tick"), F.lit(0)).alias("v")), F.struct(F.lit("lateness").alias("kind"), F.when(F.col("late"), F.col("cursor") - F.col("tick")).alias("v")))
    own = audit.select("iog", F.inline(kinds)).where("v IS NOT NULL").groupBy("iog", "kind", bin_of(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = audit.select("iog").distinct().select("iog", F.explode(F.array(F.lit("receipt_lag"), F.lit("lateness"))).alias("kind")).select("iog", "kind", F.posexplode(F.array(*(F.lit(x) for x in LABELS))).alias("bin", "label"))
    return spine.join(own, ["iog", "kind", "bin"], "left").fillna(0, ["n"])


def late_maxima(audit: DataFrame) -> DataFrame:
    """Greatest lateness of the late hits and greatest receipt lag of each iog; null lateness without late hits."""
    return audit.groupBy("iog").agg(F.max(F.when(F.col("late"), F.col("cursor") - F.col("tick"))).alias("max_lateness_ticks"), F.max(F.greatest(F.col("receipt_tick") - F.col("tick"), F.lit(0))).alias("max_lag_ticks"))


def interval_rates(hits: DataFrame, dim_tile: DataFrame, at: Column, width: int) -> DataFrame:
    """Packets and different pixels of each tile in intervals of ``width`` ticks, with rates; tiles without packets have zeros.

    hits: mapped hits with pixel_id and iog; at: ticks of arrival. An interval exists where its iog has any hit.
    """
    tiles = dim_tile.select("iog", "tile", "n_pixels")
    rows = hits.select("iog", tile_of(F.col("io_channel")).alias("tile"), "pixel_id", div(at, width).alias("interval"))
    pixel = rows.groupBy("iog", "interval", "tile", "pixel_id").agg(F.count(F.lit(1)).alias("c"))  # distinct in two steps
    own = pixel.groupBy("iog", "interval", "tile").agg(F.sum("c").alias("mapped_packets"), F.count("pixel_id").alias("unique_pixels"))
    spine = own.select("iog", "interval").distinct().join(tiles, "iog")
    full = spine.join(own, ["iog", "interval", "tile"], "left").fillna(0, ["mapped_packets", "unique_pixels"])
    return full.select("iog", "interval", "tile", "mapped_packets", (F.col("mapped_packets") / F.lit(width / 1e7)).alias("mapped_packets_per_s"), "unique_pixels", (F.col("unique_pixels") / F.col("n_pixels")).alias("active_fraction"))


def source_deltas(counters: DataFrame, columns: list[str], keys: tuple[str, ...] = ("iog",), order: str = "interval") -> DataFrame:
    """Increases of cumulative counters between following rows of a key."""
    by = Window.partitionBy(*keys).orderBy(order)
    return counters.select(*keys, order, *((F.col(c) - F.coalesce(F.lag(c).over(by), F.lit(0))).alias(c) for c in columns))


def capture_breaks(rates: DataFrame) -> DataFrame:
    """Intervals of each capture with the number of lost ones before them, and whether their line breaks there.

    A break is a jump in seq or a begin that is not the end before it; rows without a bound always break.
    """
    one = rates.select("boot_id", "seq", "begin_monotonic", "end_monotonic").dropDuplicates().groupBy("boot_id", "seq").agg(F.max("begin_monotonic").alias("begin_monotonic"), F.max("end_monotonic").alias("end_monotonic"))
    by = Window.partitionBy("boot_id").orderBy("seq")
    before, end = F.lag("seq").over(by), F.lag("end_monotonic").over(by)
    joined = F.coalesce((F.col("seq") == before + 1) & (F.abs(F.col("begin_monotonic") - end) <= 1e-5), F.lit(False))
    return one.select("boot_id", "seq", F.coalesce(F.col("seq") - before - 1, F.lit(0)).alias("lost"), (before.isNotNull() & ~joined).alias("breaks"), F.coalesce(F.col("end_monotonic") > F.col("begin_monotonic"), F.lit(False)).alias("advances"))


def reconcile(captures: DataFrame, breaks: DataFrame) -> DataFrame:
    """Captures with the intervals, lost intervals, breaks and reversed intervals found in their rates, and whether what they state agrees; null if they state nothing."""
    found = breaks.groupBy("boot_id").agg(F.count(F.lit(1)).alias("found_samples"), F.sum("lost").alias("found_missing"), F.count_if("breaks").alias("breaks"), F.count_if(~F.col("advances")).alias("reversed"))
    rows = captures.dropDuplicates().join(found, "boot_id", "left").fillna(0, ["found_samples", "found_missing", "breaks", "reversed"])
    return rows.select("boot_id", "iog", "samples", "found_samples", "missing_intervals", "found_missing", "breaks", "reversed", (F.col("samples") == F.col("found_samples")).alias("samples_agree"), (F.col("missing_intervals") == F.col("found_missing")).alias("missing_agree"))


def ring_page(rates: DataFrame, after: int = 0, limit: int = 100, ring: int = RING) -> DataFrame:
    """A page of the newest ``ring`` intervals of each capture: ``limit`` intervals with seq above ``after``, and the ring's ends."""
    if after < 0 or not 1 <= limit <= 100:
        raise ValueError("after must not be negative; limit must be in 1..100")
    seqs = rates.select("boot_id", "seq").distinct()
    newest = seqs.withColumn("k", F.row_number().over(Window.partitionBy("boot_id").orderBy(F.desc("seq")))).where(F.col("k") <= ring)
    every = Window.partitionBy("boot_id")
    ends = newest.select("boot_id", "seq", F.min("seq").over(every).alias("oldest"), F.max("seq").over(every).alias("latest"))
    return ends.where(F.col("seq") > after).withColumn("k", F.row_number().over(every.orderBy("seq"))).where(F.col("k") <= limit).select("boot_id", "seq", "oldest", "latest")


def snapshot_deltas(before: DataFrame, after: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Long form (keys, counter, before, after, delta, problem) of counters in both snapshots; a decrease is a problem."""
    long = lambda df, n: df.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).cast("bigint").alias(n)) for c in counters))))
    both = long(before, "before").join(long(after, "after"), [*keys, "counter"])
    delta = F.col("after") - F.col("before")
    return both.select(*keys, "counter", "before", "after", delta.alias("delta"), F.when(delta < 0, "decreased").alias("problem"))


def verify(samples: DataFrame, stale_after: float = 2.5) -> DataFrame:
    """Issues of each session's status samples (session, elapsed, iog, healthy, supported, status, age, offset_ticks, counter)."""
    by = Window.partitionBy("session", "iog").orderBy("elapsed")
    checked = samples.select(
        "session", "iog",
        F.array_compact(F.array(
            F.when(~F.coalesce("healthy", F.lit(False)), F.lit("collector unhealthy")),
            F.when(~F.coalesce("supported", F.lit(False)), F.lit("period unsupported")),
            F.when(~F.coalesce((F.col("status") == "aligned") & F.col("age").between(0, stale_after), F.lit(False)), F.lit("epoch not freshly qualified")),
            F.when(F.col("offset_ticks").isNull(), F.lit("no epoch offset")),
            F.when(F.lag("offset_ticks").over(by) != F.col("offset_ticks"), F.lit("offset changed")),
            F.when(F.lag("counter").over(by) != F.col("counter"), F.lit("counter changed")),
        )).alias("issues"),
    )
    return checked.select("session", "iog", F.explode("issues").alias("issue")).groupBy("session", "iog", "issue").agg(F.count(F.lit(1)).alias("samples"))


def playback_counters(eligible: DataFrame, cfg: Timing = Timing()) -> DataFrame:
    """Of each iog: timed and mapped hits, those behind the cursor when they came, those the veto takes, and those shown.

    The cursor is the greatest receipt tick before a hit, less the playback delay.
    """
    delay = round(cfg.delay / cfg.tick_seconds)
    r = running(eligible, {"front": ("max", F.col("receipt_tick"))})
    late = F.coalesce((F.col("front") >= delay) & (F.col("tick") <= F.col("front") - delay), F.lit(False))
    shown = F.col("raw") >= cfg.min_raw
    return r.groupBy("iog").agg(F.count(F.lit(1)).alias("timing_eligible_hits"), F.count_if(late).alias("pre_cut_late_hits"), F.count_if(~shown).alias("post_sync_filtered_hits"), F.count_if(shown).alias("display_selected_hits"), F.count_if(shown & late).alias("late_hits"))
