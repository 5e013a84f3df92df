"""Continuous clocks of sources: sync steps, unrolled ticks and their validity, frontiers and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Timing
from ..functions.prefix import BLOCK, as_of, running
from ..session import checkpoint


def sync_steps(stream: DataFrame, cfg: Timing = Timing()) -> DataFrame:
    """S words with ``selected`` (of the sync type) and ``step``: whole periods of a plausible one, null else."""
    selected = F.col("io") == cfg.sync_type
    return stream.where("kind = 'S'").withColumn("selected", F.coalesce(selected, F.lit(False))).withColumn("step", sync_step(cfg))


def sync_step(cfg: Timing) -> Column:
    """Whole periods of a plausible S word of the sync type, null else."""
    p = cfg.period
    step = F.rint(F.col("aux") / p).cast("bigint") * p
    return F.when((F.col("kind") == "S") & (F.col("io") == cfg.sync_type) & (step > 0) & (F.abs(F.col("aux") - step) <= max(1, p // 20)), step)


def sync_epochs(stream: DataFrame, cfg: Timing = Timing(), ahead: float = 2.5) -> DataFrame:
    """(iog, seq, word_idx, kind, second, step, after, prev): S words of the sync type with the sum of steps up to each and the last step.

    About one row a second and source, written once for all that reads it. Hits whose receipt runs more than ``ahead``
    periods on are among them (kind D), with their ``raw`` and ``receipt``; they have no step.
    """
    far = (F.col("kind") == "D") & (F.col("receipt") > int(ahead * cfg.period))
    words = stream.where(((F.col("kind") == "S") & (F.col("io") == cfg.sync_type)) | far).where("iog IS NOT NULL AND seq IS NOT NULL")
    second = F.col("header_second") if "header_second" in stream.columns else F.lit(None).cast("bigint")
    words = words.select("iog", "seq", "word_idx", "kind", second.alias("second"), "io", "aux", "raw", "receipt").dropDuplicates()
    s = words.withColumn("step", sync_step(cfg)).drop("io", "aux")
    return checkpoint(running(s, {"after": ("sum", F.col("step")), "prev": ("last", F.col("step"))}, inclusive=True))


def with_epochs(stream: DataFrame, cfg: Timing = Timing(), kinds: str = "D", epochs: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Words of ``kinds`` with, from the syncs strictly before them, ``offset`` (sum of steps) and ``prev`` (last step).

    Repeated rows count once. epochs: the ``sync_epochs`` of the stream, where they are at hand.
    """
    epochs = sync_epochs(stream, cfg) if epochs is None else epochs
    marks = epochs.where("step IS NOT NULL").select("iog", "seq", "word_idx", F.struct("after", "step").alias("value"))
    out = as_of(stream.where(F.col("kind").isin(*kinds)), marks, block, distinct=True)
    return out.withColumn("offset", F.coalesce(F.col("seen")["after"], F.lit(0).cast("bigint"))).withColumn("prev", F.col("seen")["step"]).drop("seen")


def unroll(stream: DataFrame, cfg: Timing = Timing(), epochs: DataFrame | None = None) -> DataFrame:
    """D words with tick, receipt_tick and the flags ready, valid, crossed, warmup, invalid_time.

    A hit whose receipt counter is below its raw time was taken before the last sync and belongs to the period before
    it. Hits before the first plausible sync are warm-up. Nothing is dropped.
    """
    return unrolled(with_epochs(stream, cfg, "D", epochs), cfg).drop("aux")


def unrolled(d: DataFrame, cfg: Timing = Timing()) -> DataFrame:
    """The same for words that have ``offset`` and ``prev``."""
    p = cfg.period
    crossed = F.col("receipt") < F.col("raw")
    tick = F.col("raw") % p + F.col("offset") - F.when(crossed, F.coalesce("prev", F.lit(p))).otherwise(0)
    d = d.withColumns({"crossed": crossed, "ready": F.col("offset") > 0, "tick": tick, "receipt_tick": F.col("offset") + F.col("receipt")})
    valid = F.col("ready") & (F.col("tick") >= 0) & (F.col("receipt_tick") >= F.col("tick")) & (F.col("receipt") < 32 * p)
    return d.withColumns({"valid": valid, "warmup": ~F.col("ready"), "invalid_time": F.col("ready") & ~valid})


def out_of_order(unrolled: DataFrame) -> DataFrame:
    """Valid hits with ``out_of_order``: earlier than a valid hit before them in wire order."""
    v = running(unrolled.where("valid"), {"top": ("max", F.col("tick"))})
    return v.withColumn("out_of_order", F.coalesce(F.col("tick") < F.col("top"), F.lit(False))).drop("top")


def unroll_counters(stream: DataFrame, cfg: Timing = Timing(), epochs: DataFrame | None = None) -> DataFrame:
    """Counters of the clock of each iog."""
    s = sync_steps(stream.where("kind = 'S'").dropDuplicates(), cfg).groupBy("iog").agg(F.count("step").alias("pps_syncs"), F.count_if(~F.col("selected")).alias("ignored_syncs"), F.count_if(F.col("selected") & F.col("step").isNull()).alias("invalid_syncs"), F.coalesce(F.sum(F.call_function("div", F.col("step"), F.lit(cfg.period).cast("bigint")) - 1), F.lit(0)).alias("missed_periods"))
    u = unroll(stream, cfg, epochs)
    h = u.groupBy("iog").agg(F.count_if(F.col("valid") & F.col("crossed")).alias("boundary_corrected"), F.count_if("warmup").alias("warmup_hits"), F.count_if("invalid_time").alias("invalid_times"))
    o = out_of_order(u).groupBy("iog").agg(F.count_if("out_of_order").alias("out_of_order_hits"))
    return s.join(h, "iog", "full").join(o, "iog", "full").fillna(0)


def frontiers(stream: DataFrame, cfg: Timing = Timing(), epochs: DataFrame | None = None) -> DataFrame:
    """initial_tick (after the first plausible sync), frontier_tick (greatest valid receipt or epoch) of each iog."""
    e = sync_epochs(stream, cfg) if epochs is None else epochs
    first = e.where("step IS NOT NULL").groupBy("iog").agg(F.min_by("step", F.struct("seq", "word_idx")).alias("initial_tick"), F.max("after").alias("end"))
    top = unroll(stream, cfg, e).where("valid").groupBy("iog").agg(F.max("receipt_tick").alias("top"), F.max("tick").alias("last_hit_tick"))
    return first.join(top, "iog", "left").select("iog", "initial_tick", F.greatest("end", "top").alias("frontier_tick"), "last_hit_tick")


def flow_difference(stream: DataFrame, cfg: Timing = Timing()) -> DataFrame:
    """Compared hits and mismatches of each iog between ``unroll`` and an independent formula.

    The formula ranks syncs: the epoch of a word is a join with the cumulated steps at its number of earlier syncs.
    """
    p = cfg.period
    stream = stream.dropDuplicates()
    s = sync_steps(stream, cfg).where("step IS NOT NULL").select("iog", "seq", "word_idx", "step")
    numbered = running(s, {"base": ("sum", F.col("step")), "k": ("sum", F.lit(1))}).select(F.col("iog").alias("i"), (F.col("k") + 1).alias("n"), (F.col("base") + F.col("step")).alias("epoch"), F.col("step").alias("last"))
    one = F.when((F.col("kind") == "S") & (F.col("io") == cfg.sync_type), 1)
    flags = stream.join(s.select("iog", "seq", "word_idx", F.lit(1).alias("good")), ["iog", "seq", "word_idx"], "left")
    d = running(flags.withColumn("one", F.when(one == 1, F.col("good"))), {"n": ("sum", F.col("one"))}).where("kind = 'D' AND n > 0").drop("one", "good")
    t = d.join(numbered.withColumnRenamed("n", "m"), (F.col("iog") == F.col("i")) & (F.col("n") == F.col("m")))
    want = t.select("iog", "seq", "word_idx", (F.col("epoch") + F.col("raw") % p - F.when(F.col("receipt") < F.col("raw"), F.col("last")).otherwise(0)).alias("want"))
    got = unroll(stream, cfg).where("valid").select("iog", "seq", "word_idx", "tick")
    return got.join(want, ["iog", "seq", "word_idx"], "left").groupBy("iog").agg(F.count(F.lit(1)).alias("compared_hits"), F.count_if(~F.col("tick").eqNullSafe(F.col("want"))).alias("mismatches"))


def seconds(tick: Column, cfg: Timing = Timing()) -> Column:
    """Seconds of a tick, for presentation only."""
    return tick * F.lit(cfg.tick_seconds)
