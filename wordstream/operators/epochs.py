"""Alignment of source clocks by their PPS labels.

The state after each observation depends on the few before it and on the offset that was pinned first, so the
sequence is expressed with windows over blocks of arrival instead of a fold over a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Timing
from ..functions.prefix import BLOCK, as_of, running
from ..functions.ticks import div
from ..session import checkpoint
from .timing import sync_epochs, unrolled
from .triggers import projected

#: Seconds after which an alignment without observations is stale; a fixed value.
FRESH = 2.5
#: First whole second at which it is.
STALE = 3


def pps_observations(stream: DataFrame, cfg: Timing = Timing(), epochs: DataFrame | None = None) -> DataFrame:
    """Selected S words as observations: tick after the word, header second, and whether each is usable at all.

    A word is unusable if its step is implausible or it has no positive second, and in ``align`` if its frame holds another one. The first
    hit of an epoch that runs more than FRESH seconds ahead of the last sync is an unusable observation too (``ahead``).
    """
    epochs = sync_epochs(stream, cfg, FRESH) if epochs is None else epochs
    usable = F.coalesce(F.col("step").isNotNull() & (F.col("second") > 0), F.lit(False))
    words = epochs.where("kind = 'S'").select("iog", "seq", "word_idx", F.when(F.col("step").isNotNull(), F.col("after")).alias("tick"), "second", usable.alias("usable"), F.lit(False).alias("ahead"), "after")
    far = unrolled(epochs.where("kind = 'D'").withColumnRenamed("after", "offset"), cfg).where("valid")
    first = far.groupBy("iog", "offset").agg(F.min_by(F.struct("seq", "word_idx", "second"), F.struct("seq", "word_idx")).alias("f"))
    hits = first.select("iog", "f.seq", "f.word_idx", F.lit(None).cast("bigint").alias("tick"), "f.second", F.lit(False).alias("usable"), F.lit(True).alias("ahead"), F.col("offset").alias("after"))
    return words.unionByName(hits)


def align(observations: DataFrame, now: Column | None = None, cfg: Timing = Timing(), block: int = BLOCK) -> DataFrame:
    """Each observation with its status (warming, aligned, suspect) and offset in ticks (null unless aligned).

    now: seconds at which an observation was made; the second of its label if not given. An observation is good if tick
    and second are both above those of the last usable one and its candidate offset is the pinned one, once there is
    any. Two good ones in a row with one candidate and without a stale pause align; the first such pair pins the
    offset. Any other observation revokes.

    Arrival is cut into blocks, each of which sees the block before it too; a source without a usable observation in a
    whole block starts anew, but for its pinned offset.
    """
    at = F.coalesce(now if now is not None else F.col("second").cast("double"), F.lit(0.0))
    o = observations if "ahead" in observations.columns else observations.withColumn("ahead", F.lit(False))
    b = div(F.col("seq").cast("bigint"), block)
    own = o.withColumn("__own", b).withColumn("__block", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    part = Window.partitionBy("iog", "__block")
    by = part.orderBy("seq", "word_idx")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    alone = F.col("ahead") | (F.count_if(~F.col("ahead")).over(Window.partitionBy("iog", "__block", "seq")) == 1)
    o = own.withColumns({"usable": F.col("usable") & alone, "now": at})
    o = o.withColumn("candidate", F.when(F.col("usable"), F.col("second") * cfg.period - F.col("tick")))
    o = o.withColumn("last", F.last(F.when(F.col("usable"), F.struct("tick", "second")), ignorenulls=True).over(before))
    o = o.withColumn("ordered", F.col("usable") & (F.col("last").isNull() | ((F.col("tick") > F.col("last")["tick"]) & (F.col("second") > F.col("last")["second"]))))
    kept = lambda c: F.last(F.when(F.col("ordered"), F.col(c)), ignorenulls=True).over(before)
    # the observation before, whatever it was, and the last one that refreshed the clock
    o = o.withColumns({"b": F.lag(F.struct("ordered", "candidate")).over(by), "fresh": kept("now"), "stored": kept("candidate")})
    follows = F.col("ordered") & F.coalesce(F.col("b")["ordered"] & (F.col("b")["candidate"] == F.col("candidate")), F.lit(False)) & F.coalesce(F.col("now") - F.col("fresh") <= FRESH, F.lit(False))
    o = o.withColumn("follows", follows).withColumn("was", F.lag(F.when(F.col("follows"), F.col("candidate"))).over(by))
    o = checkpoint(o.where("__own = __block").drop("__own", "__block", "last", "b"))  # one row a sync word
    first = F.min_by("candidate", F.struct("seq", "word_idx"))
    pinned = o.where("follows").groupBy("iog").agg(first.alias("pinned"), F.min(F.struct("seq", "word_idx")).alias("since"))
    o = o.join(F.broadcast(pinned), "iog", "left")  # a row a source
    here = F.struct("seq", "word_idx")
    after = F.coalesce(here >= F.col("since"), F.lit(False))
    fits = F.col("ordered") & (~after | (F.col("candidate") == F.col("pinned")))
    aligned = after & F.col("follows") & (F.col("candidate") == F.col("pinned"))
    status = F.when(~fits, "suspect").when(aligned, "aligned").otherwise("warming")
    # a change of the candidate counts as inconsistent, also where the new one may be confirmed
    changed = F.col("usable") & (~fits | F.coalesce(F.col("stored") != F.col("candidate"), F.lit(False)))
    fresh = F.when(F.col("ordered"), F.col("now")).otherwise(F.col("fresh"))
    # one that refreshes the clock arrives in its second; another is taken to come a second after the last that did
    arrived = F.when(F.col("ordered"), F.col("now")).when(F.col("ahead"), F.when(F.col("now") > 0, F.col("now")).otherwise(F.col("fresh") + STALE)).otherwise(F.col("fresh") + 1)
    return o.select(
        "iog", "seq", "word_idx", "tick", "second", "now", "ahead", F.col("fresh").alias("fresh_before"), fresh.alias("fresh_at"), arrived.cast("bigint").alias("arrived"), "candidate", "usable", fits.alias("consistent"), changed.alias("inconsistent"), status.alias("status"),
        F.when(aligned, F.col("pinned")).alias("offset_ticks"), F.coalesce(F.col("was") == F.col("pinned"), F.lit(False)).alias("was_aligned"), *(["after"] if "after" in o.columns else []),
    )


def alignment_counters(aligned: DataFrame) -> DataFrame:
    """Of each iog: observations, consistent, inconsistent and invalid ones, hits ahead of the syncs, pinned offset, last status."""
    last = F.max_by("status", F.struct("seq", "word_idx"))
    return aligned.groupBy("iog").agg(F.count_if(~F.col("ahead")).alias("observations"), F.count_if("consistent").alias("consistent"), F.count_if("inconsistent").alias("inconsistent"), F.count_if(~F.col("usable") & ~F.col("ahead")).alias("invalid"), F.count_if("ahead").alias("ahead"), F.max("offset_ticks").alias("offset_ticks"), last.alias("last_status"))


def qualified(stream: DataFrame, aligned: DataFrame, cfg: Timing = Timing()) -> DataFrame:
    """T words as of ``project_triggers``, with ``own``: the offset of their own source at their place in the stream, null unless aligned and fresh."""
    marks = aligned.select("iog", "seq", "word_idx", F.struct("after", "offset_ticks", "fresh_at").alias("value"))
    t = as_of(stream.where("kind = 'T'").select("iog", "seq", "word_idx", "io", "aux", "header_second"), marks, distinct=True)
    age = F.col("header_second").cast("double") - F.col("seen")["fresh_at"]
    t = t.withColumn("offset", F.coalesce(F.col("seen")["after"], F.lit(0).cast("bigint"))).withColumn("own", F.when(age.between(0, FRESH), F.col("seen")["offset_ticks"]))
    return projected(t, cfg, "own")


def target_offsets(aligned: DataFrame) -> DataFrame:
    """(iog, second, theirs): offset of each source in each second in which it is aligned and fresh, by its last observation up to then."""
    last = aligned.where("arrived IS NOT NULL").groupBy("iog", "arrived").agg(F.max_by(F.struct("status", "offset_ticks", "fresh_at"), F.struct("seq", "word_idx")).alias("state"))
    # beyond FRESH seconds none is fresh
    each = last.select("iog", F.explode(F.sequence(F.col("arrived"), F.col("arrived") + STALE - 1)).alias("second"), "arrived", "state")
    state = each.groupBy("iog", "second").agg(F.max_by("state", "arrived").alias("s")).select("iog", "second", "s.*")
    return state.where((F.col("status") == "aligned") & (F.col("second") - F.col("fresh_at")).between(0, FRESH)).select("iog", "second", F.col("offset_ticks").alias("theirs"))


def revocations(aligned: DataFrame) -> DataFrame:
    """Observations that took a usable alignment away: (iog, seq, word_idx, time, status, paused); without a word where none came any more.

    time: the second of the revocation, which is when the alignment went stale (``paused``) or the observation arrived.
    """
    stale = (F.col("fresh_before") + STALE).cast("bigint")
    lost = aligned.where("was_aligned AND status <> 'aligned'")
    seen = lost.select("iog", "seq", "word_idx", F.least("arrived", stale).alias("time"), "status", (F.col("arrived") >= stale).alias("paused"))
    # a source without further observations goes stale while others go on
    ends = aligned.groupBy("iog").agg(F.max_by(F.struct("status", "fresh_at"), F.struct("seq", "word_idx")).alias("l"))
    top = aligned.agg(F.max("arrived")).scalar()
    late = ends.where("l.status = 'aligned'").select("iog", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("int").alias("word_idx"), (F.col("l.fresh_at") + STALE).cast("bigint").alias("time"), F.lit("stale").alias("status"), F.lit(True).alias("paused"))
    return seen.unionByName(late.where(F.col("time") <= top))


def generations(seconds: DataFrame, revoked: DataFrame) -> DataFrame:
    """(second, since, until): for each second the last revocation of any source up to it and the first after it; -1 and 2^62 without one."""
    times = revoked.select(F.col("time").alias("second"), F.lit(1).alias("rev"))
    points = seconds.select(F.col("second").cast("bigint").alias("second"), F.lit(0).alias("rev")).unionByName(times).groupBy("second").agg(F.max("rev").alias("rev"))
    rows = points.select(F.lit(0).alias("all"), F.col("second").alias("seq"), F.lit(0).alias("word_idx"), "rev")
    g = checkpoint(running(rows, {"gen": ("sum", F.col("rev"))}, inclusive=True, key="all").select(F.col("seq").alias("second"), "rev", "gen"))  # a row a second
    starts = g.where("rev = 1").select("gen", F.col("second").alias("since"))
    ends = starts.select((F.col("gen") - 1).alias("gen"), F.col("since").alias("until"))
    out = g.join(starts, "gen", "left").join(ends, "gen", "left")
    return out.select("second", F.coalesce("since", F.lit(-1)).alias("since"), F.coalesce("until", F.lit(1 << 62)).alias("until"))


def since_last_revocation(rows: DataFrame, revoked: DataFrame, seen: Column) -> DataFrame:
    """Rows of the current generation: seen after the last revocation of any source, all of them if there was none."""
    last = revoked.agg(F.max("time").alias("last")).scalar()
    return rows.where(F.coalesce(seen > last, F.lit(True)))
