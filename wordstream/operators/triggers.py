"""Trigger windows: projection of T words, merged windows, routing between sources, and matched hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Timing, Windows
from ..functions.ticks import R, div
from .timing import with_epochs

#: Sources of detector-wide triggers; fixed values of the data model.
SOURCES = {5: "beam", 6: "light"}


def project_triggers(stream: DataFrame, cfg: Timing = Timing(), epochs: DataFrame | None = None) -> DataFrame:
    """T words with subtype, tick on the clock of their iog, valid (epoch known, counter within a period), and the second of their frame."""
    return projected(with_epochs(stream, cfg, "T", epochs), cfg)


def projected(t: DataFrame, cfg: Timing = Timing(), *more: str) -> DataFrame:
    """The same for words that have their ``offset``."""
    valid = F.coalesce((F.col("offset") > 0) & F.col("aux").between(0, cfg.period - 1), F.lit(False))
    return t.select("iog", "seq", "word_idx", F.col("io").alias("subtype"), (F.col("offset") + F.col("aux")).alias("tick"), valid.alias("valid"), F.col("header_second").alias("second"), *more)


def subtype_histogram(triggers: DataFrame) -> DataFrame:
    """T words of each iog and subtype, and how many of them have an invalid time."""
    return triggers.groupBy("iog", "subtype").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("invalid_times"))


def accepted(triggers: DataFrame, types: tuple[int, ...] = ()) -> DataFrame:
    """Valid triggers of the wanted subtypes; no subtypes are all."""
    rows = triggers.where("valid")
    return rows.where(F.col("subtype").isin(*types)) if types else rows


def settings(config: DataFrame, tick_seconds: float = 1e-7) -> DataFrame:
    """(iog, pre, post, history, types) in ticks of the sources whose trigger view is on; of several rows of an iog one counts. At most one row a source."""
    ticks = lambda c, us: F.bround(F.col(c) * us / F.lit(tick_seconds)).cast("bigint")
    on = config.where("trigger_view AND iog IS NOT NULL").dropDuplicates(["iog"])
    return on.select("iog", ticks("pre_us", 1e-6).alias("pre"), F.greatest(ticks("post_us", 1e-6), F.lit(1)).alias("post"), ticks("history_seconds", 1).alias("history"), F.coalesce("trigger_types", F.array().cast("array<int>")).alias("types"))


def wanted(triggers: DataFrame, config: DataFrame) -> DataFrame:
    """Triggers with ``wanted``: whether their source has no list of subtypes or theirs is on it."""
    types = config.where("iog IS NOT NULL").dropDuplicates(["iog"]).select("iog", F.coalesce("trigger_types", F.array().cast("array<int>")).alias("__types"))
    any_type = F.coalesce(F.size("__types"), F.lit(0)) == 0
    return triggers.join(F.broadcast(types), "iog", "left").withColumn("wanted", any_type | F.coalesce(F.array_contains("__types", F.col("subtype")), F.lit(False))).drop("__types")


def merge_windows(triggers: DataFrame, win: Windows | None = None, keys: tuple[str, ...] = ("iog",), slab: int = 10_000_000 * 64) -> DataFrame:
    """Disjoint windows [lo, hi) of each key; touching ones are merged, ``n`` is the number of triggers.

    win: one setting for all; else each trigger has its ``pre`` and ``post``. Time is cut into slabs; a slab gets the
    greatest end of the windows before it and the beginning of the last merged one, so that only a row a slab meets in
    one place however many windows a key has.
    """
    pre, post = win.ticks()[:2] if win else (F.col("pre"), F.col("post"))
    w = triggers.select(*keys, (F.col("tick") - pre).alias("lo"), (F.col("tick") + post).alias("hi")).withColumn("slab", div(F.col("lo"), slab))
    one = w.repartition(*keys, "slab")
    earlier = Window.partitionBy(*keys).orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    by = Window.partitionBy(*keys, "slab").orderBy("lo", "hi")
    ends = one.groupBy(*keys, "slab").agg(F.max("hi").alias("top")).select(*keys, "slab", F.max("top").over(earlier).alias("carry"))
    reach = F.greatest("carry", F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    begun = one.join(ends, [*keys, "slab"]).withColumn("begin", F.when(F.coalesce(F.col("lo") > reach, F.lit(True)), F.col("lo")))
    parts = begun.withColumn("begin", F.max("begin").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "slab", "begin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
    # a part without a beginning goes on with the last window of an earlier slab
    last = F.max("begin").over(Window.partitionBy(*keys).orderBy("slab").rangeBetween(Window.unboundedPreceding, -1))
    edge = parts.groupBy(*keys, "slab").agg(F.max("begin").alias("begin")).select(*keys, "slab", last.alias("before"))
    whole = parts.join(edge, [*keys, "slab"]).withColumn("begin", F.coalesce("begin", "before"))
    return whole.groupBy(*keys, "begin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("begin")


def newest_windows(windows: DataFrame, most: int, keys: tuple[str, ...] = ("iog",)) -> DataFrame:
    """The newest ``most`` windows of each key: the reference limit on live windows, a feature of the operator."""
    return windows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("lo")))).where(F.col("k") <= most).drop("k")


def match_hits(hits: DataFrame, windows: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """Hits inside a window of their key, at most one each as windows are disjoint.

    An equi-join on time buckets of ``width`` ticks; windows are copied into the few buckets that they cover.
    """
    b = windows.withColumn("bucket", F.explode(F.sequence(div(F.col("lo"), width), div(F.col("hi") - 1, width))))
    return hits.withColumn("bucket", div(F.col("tick"), width)).join(b, [*keys, "bucket"]).where("tick >= lo AND tick < hi").drop("bucket")


def route(triggers: DataFrame, targets: DataFrame, config: DataFrame) -> DataFrame:
    """Triggers of the detector-wide sources on the clock of every target that is aligned and fresh in their second.

    triggers: with ``own`` and ``second`` (``qualified``); targets: ``target_offsets``; config: settings of the sources.
    Gives source, source_iog, seq, word_idx, subtype, second, and of the target iog, tick, theirs and its settings; a
    tick below 0 is none on the target's clock. Sources without a trigger view are no targets.
    """
    name = F.when(F.col("iog") == 5, "beam").when(F.col("iog") == 6, "light")
    t = triggers.where("own IS NOT NULL AND iog IN (5, 6)").select(name.alias("source"), F.col("iog").alias("source_iog"), "seq", "word_idx", "subtype", "second", "tick", "own")
    sent = t.join(targets, "second").join(F.broadcast(settings(config)), "iog").withColumn("tick", F.col("tick") + (F.col("own") - F.col("theirs")))
    return sent.drop("own", "types")


def in_history(routed: DataFrame) -> DataFrame:
    """Routed triggers whose window ends within the target's history when they arrive; older ones find no hits any more."""
    frontier = F.col("second") * R - F.col("theirs")
    return routed.where(F.col("tick") + F.col("post") > frontier - F.col("history"))


def match_generations(hits: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Hits inside a window of their iog whose own arrival lies in the generation of its triggers, and that are not later than the history.

    windows: with source, since, until, theirs and history. A hit counts once for each source.
    """
    m = match_hits(hits, windows, ("iog",), width)
    arrived = div(F.col("receipt_tick") + F.col("theirs"), R)
    alive = m.where((arrived >= F.col("since")) & (arrived < F.col("until")) & (F.col("receipt_tick") - F.col("tick") <= F.col("history")))
    return alive.dropDuplicates(["iog", "seq", "word_idx", "source"])


def latest_per_pixel(matched: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Latest tick and number of hits of each pixel."""
    return matched.groupBy(*keys, "pixel_id").agg(F.max("tick").alias("tick"), F.count(F.lit(1)).alias("hits"))


def union_layer(layers: DataFrame) -> DataFrame:
    """Latest tick of each pixel over all sources."""
    return layers.groupBy("pixel_id").agg(F.max("tick").alias("tick"))


def match_counters(matched: DataFrame) -> DataFrame:
    """Of each iog: hits matched at all, once each, and by source."""
    per_hit = matched.groupBy("iog", "seq", "word_idx").agg(F.max((F.col("source") == "beam").cast("int")).alias("beam"), F.max((F.col("source") == "light").cast("int")).alias("light"))
    return per_hit.groupBy("iog").agg(F.count(F.lit(1)).alias("matched"), F.sum("beam").alias("beam"), F.sum("light").alias("light"))


def router_counters(triggers: DataFrame) -> DataFrame:
    """Of each iog, each T word once: from an unexpected source, of an unwanted subtype, with an invalid time, in a frame that revoked its own alignment, of a source that is not aligned, or accepted.

    triggers: with valid, wanted, uncertain and own.
    """
    source, ok, want, unsure, known = F.col("iog").isin(*SOURCES), F.col("valid"), F.col("wanted"), F.col("uncertain"), F.col("own").isNotNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    chosen = source & want & ok
    return triggers.groupBy("iog").agg(
        count(~source).alias("unexpected_source"), count(source & ~want).alias("filtered_subtype"), count(source & want & ~ok).alias("invalid_trigger_times"), count(chosen & unsure).alias("uncertain_batch"),
        count(chosen & ~unsure & ~known).alias("source_unaligned"), count(chosen & ~unsure & known).alias("accepted"),
    )


def target_counters(accepted: DataFrame, routed: DataFrame, config: DataFrame) -> DataFrame:
    """Of each target: routed triggers by source, those skipped as it was not aligned, with a tick below 0, and outside its history.

    accepted: the qualified triggers of the detector-wide sources; routed: the same by target, before any cut.
    """
    late = ~(F.col("tick") + F.col("post") > F.col("second") * R - F.col("theirs") - F.col("history"))
    good = F.col("tick") >= 0
    count = lambda c: F.count_if(c)
    by = routed.groupBy("iog").agg(
        count(good & (F.col("source") == "beam")).alias("routed_beam"), count(good & (F.col("source") == "light")).alias("routed_light"), F.count(F.lit(1)).alias("__seen"), count(~good).alias("invalid_projected_ticks"), count(good & late).alias("outside_history"),
    )
    all_of = accepted.where("own IS NOT NULL AND iog IN (5, 6)").agg(F.count(F.lit(1)).alias("n"))
    rows = settings(config).select("iog").join(by, "iog", "left").fillna(0).withColumn("__all", all_of.scalar())
    return rows.select("iog", "routed_beam", "routed_light", (F.col("__all") - F.col("__seen")).alias("unaligned_target_skips"), "invalid_projected_ticks", "outside_history")


def batch_cap(triggers: DataFrame, most: int, batch: Column) -> DataFrame:
    """The last ``most`` triggers of each iog and batch, with the number of all: the reference limit on a storm of triggers."""
    rows = triggers.withColumn("batch", batch)
    every = Window.partitionBy("iog", "batch")
    k = F.row_number().over(every.orderBy(F.desc("seq"), F.desc("word_idx")))
    return rows.withColumn("of", F.count(F.lit(1)).over(every)).withColumn("k", k).where(F.col("k") <= most).drop("k")
