"""Per-address results when a few addresses hold most rows.

Heavy addresses are found by a frequent-items sketch in one pass. Their rows are picked out by a broadcast join with
the few heavy addresses and aggregated in evenly loaded tasks (by the identity of the row, then by address); all other
rows take the ordinary shuffle on the address. The two are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ticks import hit_time

#: Grains of an address and the columns that each uses; fixed values of the data model.
GRAINS = {"channel": ("iog", "chip", "channel"), "chip": ("iog", "chip"), "io_channel": ("iog", "io_channel")}
ADDRESS = ("iog", "io_channel", "chip", "channel")
#: Least share in thousandths of all rows that makes an address of a grain heavy; fixed values of the data model.
SHARES = {"channel": 10, "chip": 36, "io_channel": 66}
#: Items a sketch keeps track of. A count is off by at most 3.5 / TRACKED of the rows, so a heavy address is never missed and at most 1 / share + 1 are.
TRACKED = 8192


def _grain_rows(rows: DataFrame, grains: dict[str, tuple[str, ...]] = GRAINS) -> DataFrame:
    """One row for each row and grain whose columns are all given; columns a grain does not use are -1."""

    def entry(grain: str, used: tuple[str, ...]) -> Column:
        return F.struct(F.lit(grain).alias("grain"), *(F.coalesce(F.col(c), F.lit(-1)).alias(c) if c in used else F.lit(-1).alias(c) for c in ADDRESS))

    whole = {g: F.lit(True) for g in grains}
    for g, used in grains.items():
        for c in used:
            whole[g] = whole[g] & F.col(c).isNotNull()
    return rows.select(F.inline(F.filter(F.array(*(F.when(whole[g], entry(g, u)) for g, u in grains.items())), lambda x: x.isNotNull())))


def heavy_candidates(rows: DataFrame, keys: dict[str, tuple[str, ...]], per_mille: dict[str, int]) -> DataFrame:
    """(name, key hash) of every key that may hold its share of the rows, by one sketch a key; at most 2 / share of each."""
    sketches = [F.expr(f"approx_top_k(xxhash64({', '.join(used)}), {min(TRACKED // 4, 2 * (1000 // per_mille[k]) + 2)}, {TRACKED})").alias(k) for k, used in keys.items()]
    top = rows.agg(F.count(F.lit(1)).alias("total"), *sketches)
    found = top.select("total", F.inline(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(per_mille[k]).alias("share"), F.col(k).alias("items")) for k in keys))))
    # half the share leaves room for the error of the sketch
    return found.select("total", "name", "share", F.inline("items")).where(F.col("count") * 2000 >= F.col("total") * F.col("share")).select("name", F.col("item").alias("hash"))


def heavy_addresses(hits: DataFrame, per_mille: dict[str, int] | None = None) -> DataFrame:
    """Addresses that hold at least their grain's share of all rows, repeated rows included.

    The sketch names candidates, their rows are picked out by a broadcast join and counted exactly. Rows with a null
    in the address count in the total only; an empty table gives no rows; other columns are ignored.
    """
    per_mille = per_mille or SHARES
    rows = hits.select(*(F.col(c).cast("int").alias(c) for c in ADDRESS))
    heavy = heavy_candidates(rows, GRAINS, per_mille)
    tagged = _grain_rows(rows)
    hashed = tagged.withColumn("hash", F.when(F.col("grain") == "channel", F.xxhash64("iog", "chip", "channel")).when(F.col("grain") == "chip", F.xxhash64("iog", "chip")).otherwise(F.xxhash64("iog", "io_channel")))
    picked = hashed.join(F.broadcast(heavy.withColumnRenamed("name", "grain")), ["grain", "hash"], "left_semi")
    counts = picked.groupBy("grain", *ADDRESS).agg(F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    share = F.expr("CASE grain " + " ".join(f"WHEN '{g}' THEN {v}" for g, v in per_mille.items()) + " END")
    return counts.where(F.col("rows") * 1000 >= total.scalar() * share).select("grain", *ADDRESS)


def address_latest(hits: DataFrame, per_mille: int = 5) -> DataFrame:
    """Row count and latest hit time of each address at each of the three grains; repeated rows count once.

    A whole address (iog, io_channel, chip, channel) that may hold ``per_mille`` of the rows is heavy. Rows of heavy
    addresses are made distinct by a shuffle on the whole row, the others by a shuffle on the address; both give one
    row an address, from which the grains are added up. Addresses with a null in a grain's columns have no row in it;
    an address without any hit time has a null latest_hit.
    """
    t = hit_time(F.col("timestamp"), F.col("receipt_timestamp"), F.col("message_seconds"))
    rows = hits.select(*(F.col(c).cast("int").alias(c) for c in ADDRESS), F.col("seq").cast("bigint").alias("seq"), F.col("word_idx").cast("int").alias("word_idx"), t.alias("t"))
    heavy = F.broadcast(heavy_candidates(rows, {"address": ADDRESS}, {"address": per_mille}).select("hash"))
    hashed = rows.withColumn("hash", F.xxhash64(*ADDRESS))
    once = [*ADDRESS, "seq", "word_idx", "t"]
    sums = [F.count(F.lit(1)).alias("hits"), F.max("t").alias("latest_hit")]
    hot = hashed.join(heavy, "hash", "left_semi").select(once).dropDuplicates().groupBy(*ADDRESS).agg(*sums)
    cold = hashed.join(heavy, "hash", "left_anti").select(once).repartition(*ADDRESS).dropDuplicates().groupBy(*ADDRESS).agg(*sums)
    address = hot.unionByName(cold)
    whole = address.select("hits", "latest_hit", F.inline(F.array(*(F.struct(F.lit(g).alias("grain"), *(F.col(c).isNotNull().alias(f"{c}_given") if c in u else F.lit(True).alias(f"{c}_given") for c in ADDRESS), *(F.col(c).alias(c) if c in u else F.lit(-1).alias(c) for c in ADDRESS)) for g, u in GRAINS.items()))))
    for c in ADDRESS:
        whole = whole.where(f"{c}_given")
    return whole.groupBy("grain", *ADDRESS).agg(F.sum("hits").alias("hits"), F.max("latest_hit").alias("latest_hit"))
