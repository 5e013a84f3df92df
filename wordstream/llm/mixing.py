"""Mixtures of sources by target weights, with a low-discrepancy schedule.

The documents of a source are shuffled and laid end to end; every BLOCK tokens make one block. A mix is a row of
slots of one block each. Golden-ratio points in the unit interval, mapped through the cumulated weights, give each
slot its source, so that every stretch of the mix has nearly the target shares. The n-th slot of a source takes its
n-th block, starting over when all were used, up to the most uses of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, shuffle_partitions
from .bpe import count_tokens

#: Tokens of a slot and block.
BLOCK = 64
#: Golden ratio as a fraction of 2^32; a fixed value of the sequence.
GOLDEN, ONE = 2654435769, 1 << 32
#: Parts that the documents of one source, and slots that those of one mix, are numbered in.
BUCKETS, CHUNK = 256, 1 << 14


def _sized(documents: DataFrame, path: str | None) -> DataFrame:
    """(source, doc_id, tokens) of the documents with tokens; texts are encoded once."""
    return checkpoint(count_tokens(documents, ["doc_id", "source"], path).where("tokens > 0").dropDuplicates(["doc_id"]))


def token_blocks(sized: DataFrame, seed: int = 7) -> DataFrame:
    """(source, doc_id, tokens, block) of sized documents, shuffled by a hash and laid end to end by source.

    Positions come from sums by hash bucket and a running sum within each, so that no task holds a whole source.
    """
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = sized.where("source IS NOT NULL").select("source", "doc_id", "tokens", mixed.alias("h"), F.pmod(mixed, F.lit(BUCKETS)).alias("bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("run", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    placed = run.hint("merge").join(offsets, ["source", "bucket"])
    return placed.select("source", "doc_id", "tokens", F.call_function("div", F.col("offset") + F.col("run"), F.lit(BLOCK).cast("bigint")).alias("block"))


def _plans(mixes: DataFrame, targets: DataFrame, sized: DataFrame) -> DataFrame:
    """A row for each mix: wanted tokens, slots, and the listed sources with the upper end of their part of the unit interval, cap and blocks."""
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    cap = F.when(F.count("max_repeats") == F.count(F.lit(1)), F.max("max_repeats")).alias("cap")
    clean = targets.where("target_share > 0 AND source IS NOT NULL").groupBy("mix_id", "source").agg(F.sum("target_share").alias("w"), cap)
    counts = sized.groupBy("source").agg(F.call_function("div", F.sum("tokens") + (BLOCK - 1), F.lit(BLOCK).cast("bigint")).alias("blocks"))
    every = Window.partitionBy("mix_id")
    shares = clean.join(counts, "source", "left").select("mix_id", "source", "cap", F.coalesce("blocks", F.lit(0)).alias("blocks"), (F.sum("w").over(every.orderBy("source")) / F.sum("w").over(every)).alias("upto"))
    parts = shares.groupBy("mix_id").agg(F.array_sort(F.collect_list(F.struct("upto", "source", "cap", "blocks"))).alias("ends"))
    wanted = F.greatest(F.round(F.col("total_ratio") * total).cast("bigint"), F.lit(0))
    return checkpoint(mixes.select("mix_id", wanted.alias("wanted")).withColumn("slots", F.call_function("div", F.col("wanted") + BLOCK // 2, F.lit(BLOCK).cast("bigint"))).join(parts, "mix_id"))


def schedule(plans: DataFrame) -> DataFrame:
    """(mix_id, slot, source, cap, blocks, n): source of each slot, and how many earlier slots of the mix have the same source."""
    plans = plans.where("slots > 0")
    total = plans.agg(F.sum("slots")).first()[0] or 0  # a row a mix
    chunks = plans.select("mix_id", "slots", "ends", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("slots") - 1, F.lit(CHUNK).cast("bigint")))).alias("chunk"))
    # chunks are few small rows, but their slots are many, so they are spread before they are made
    chunks = chunks.repartition(shuffle_partitions(plans.sparkSession, total), "mix_id", "chunk")
    slots = chunks.select("mix_id", "ends", "chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1)).alias("slot"))
    point = F.pmod(F.pmod(F.col("slot"), F.lit(ONE)) * GOLDEN, F.lit(ONE)) / F.lit(float(ONE))
    # the last end is 1 up to rounding and takes the rest
    part = F.coalesce(F.filter("ends", lambda x: F.col("point") < x["upto"])[0], F.element_at("ends", -1))
    drawn = slots.withColumn("point", point).select("mix_id", "chunk", "slot", part.alias("part")).select("mix_id", "chunk", "slot", "part.source", "part.cap", "part.blocks")
    before = Window.partitionBy("mix_id", "source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.groupBy("mix_id", "source", "chunk").agg(F.count(F.lit(1)).alias("c")).select("mix_id", "source", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("mix_id", "source", "chunk").orderBy("slot")
    numbered = drawn.withColumn("k", F.row_number().over(inside) - 1)
    # slots compress so well that they would pass for a small table and be broadcast
    return numbered.hint("merge").join(offsets, ["mix_id", "source", "chunk"]).select("mix_id", "slot", "source", "cap", "blocks", (F.col("offset") + F.col("k")).alias("n"))


def mix_documents(documents: DataFrame, mixes: DataFrame, targets: DataFrame, seed: int = 7, path: str | None = None) -> DataFrame:
    """(mix_id, slot, doc_id, source, used, tokens): the documents of each mix in order, ``used`` the how-manieth use.

    The size of a mix is total_ratio times the tokens of all documents. A source whose documents do not suffice, even
    with all uses, leaves its later slots empty; sources with share 0 or without documents have none; null max_repeats
    is no cap, below 1 none are used. Documents without tokens are never used; repeated doc_ids count once; shares of
    one source listed twice add up, with the greater cap. A mix without targets has no rows.
    """
    sized = _sized(documents, path)
    return _mix(sized, _plans(mixes, targets, sized), seed)


def _mix(sized: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    drawn = schedule(plans).where("blocks > 0")
    uses = drawn.select("mix_id", "slot", "source", F.call_function("div", F.col("n"), F.col("blocks")).alias("pass"), F.pmod(F.col("n"), F.col("blocks")).alias("block"), "cap").where("cap IS NULL OR pass < cap")
    return uses.hint("merge").join(token_blocks(sized, seed), ["source", "block"]).select("mix_id", "slot", "doc_id", "source", (F.col("pass") + 1).cast("int").alias("used"), "tokens")


def mix_shares(documents: DataFrame, mixes: DataFrame, targets: DataFrame, seed: int = 7, path: str | None = None) -> DataFrame:
    """For each mix and listed source: the target share, wanted and reached tokens, uses, and the share really reached.

    ``reached_share`` is of the tokens of the whole mix, ``reached_of_wanted`` of the wanted size.
    """
    sized = _sized(documents, path)
    plans = _plans(mixes, targets, sized)
    used = _mix(sized, plans, seed).groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("used").alias("most_uses"))
    every = Window.partitionBy("mix_id")
    listed = targets.where("source IS NOT NULL").groupBy("mix_id", "source").agg(F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("w"))
    wanted = listed.withColumn("target_share", F.when(F.sum("w").over(every) > 0, F.col("w") / F.sum("w").over(every)).otherwise(0.0)).join(plans.select("mix_id", "wanted"), "mix_id")
    rows = wanted.join(used, ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return rows.select(
        "mix_id", "source", "target_share", F.round(F.col("target_share") * F.col("wanted")).cast("bigint").alias("wanted_tokens"), F.col("tokens").alias("reached_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.try_divide("tokens", F.sum("tokens").over(every)).alias("reached_share"), F.try_divide("tokens", "wanted").alias("reached_of_wanted"),
    )
