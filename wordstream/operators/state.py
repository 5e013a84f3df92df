"""State for viewers: changed pixels between two layers, receipt status, badges, clocks, brightness, and frame encodings."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import le_hex
from ..session import ship

#: Fixed values of the view: seconds until a receipt is old, a link is lost, a collector is unhealthy, a pulse is fresh.
STALE, LINK, HEALTHY, FRESH = 2.5, 3.5, 3.0, 0.6


def layer_delta(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("pixel_id",)) -> DataFrame:
    """Pixels whose tick differs between two layers; -1 clears one that is gone."""
    b, a = before.select(*keys, F.col("tick").alias("b")), after.select(*keys, F.col("tick").alias("a"))
    return b.join(a, list(keys), "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, F.coalesce("a", F.lit(-1)).alias("tick"))


def age(now: Column, stamp: Column) -> Column:
    """Seconds since a stamp, not negative; null if there never was one."""
    return F.when(stamp != 0, F.greatest(F.lit(0.0), now - stamp))


def receipt_status(counts: DataFrame, now: Column) -> DataFrame:
    """Ages, health and badge of each iog: (iog, syncs, last_sync, triggers, last_trigger, last_frame) in seconds at ``now``."""
    sync, trig, frame = age(now, F.col("last_sync")), age(now, F.col("last_trigger")), age(now, F.col("last_frame"))
    badge = F.when(F.coalesce(frame, F.lit(1e9)) > LINK, "unknown").when(sync.isNull() | (F.col("syncs") == 0), "waiting").when(sync > STALE, "stale").when(sync < FRESH, "pulse").otherwise("live")
    trigger = F.when(F.coalesce(frame, F.lit(1e9)) > LINK, "unknown").when(trig < FRESH, "pulse").otherwise("idle")
    return counts.select("iog", "syncs", sync.alias("sync_age"), "triggers", trig.alias("trigger_age"), F.coalesce(frame < HEALTHY, F.lit(False)).alias("healthy"), badge.alias("sync_badge"), trigger.alias("trigger_badge"))


def source_totals(rates: DataFrame) -> DataFrame:
    """One row over all sources: hits, receiving sources, sums of problems."""
    return rates.agg(F.sum("mapped").alias("mapped"), F.count_if("healthy").alias("receiving"), F.sum("unmapped").alias("unmapped"), F.sum("filtered").alias("filtered"))


def displayed_clock(base_ms: Column, frontier_ms: Column, running: Column, since_ms: Column) -> Column:
    """Displayed detector time: runs on from the last known base for at most 250 ms and never past the frontier."""
    ahead = F.least(F.greatest(since_ms, F.lit(0)), F.lit(250), F.greatest(frontier_ms - base_ms, F.lit(0)))
    return F.when(base_ms < 0, F.lit(-1)).otherwise(base_ms + F.when(running, ahead).otherwise(0))


def epoch_second(header_second: Column, sync_tick: Column, period: int = 10_000_000) -> Column:
    """Unix second of the source's first epoch; null unless the label is whole and positive."""
    return F.when((header_second > 0) & (sync_tick >= 0) & (sync_tick % period == 0), header_second - F.call_function("div", sync_tick, F.lit(period).cast("bigint")))


def clock_summary(rows: DataFrame) -> DataFrame:
    """Over the aligned sources: how many, oldest and newest displayed time, and spread in ms; kind of the label."""
    ok = F.col("unix_ms").isNotNull()
    agg = rows.agg(F.count(F.lit(1)).alias("sources"), F.count("unix_ms").alias("labelled"), F.min("unix_ms").alias("oldest_ms"), F.max("unix_ms").alias("newest_ms"), F.count_if(ok & ~F.col("running")).alias("buffering"))
    kind = F.when(F.col("labelled") == 0, "warming").when(F.col("labelled") < F.col("sources"), "partial").when(F.col("buffering") > 0, "buffering").otherwise("running")
    return agg.withColumn("spread_ms", F.col("newest_ms") - F.col("oldest_ms")).withColumn("kind", kind)


def brightness(age_ms: Column, tau_s: float = 0.5) -> Column:
    """Brightness 0..255 of a pixel by its age, in steps of 16 ms; 0 when unseen, in the future, or at the end of the scale."""
    import math

    last = math.ceil(8000 * tau_s / 16)
    step = F.floor(age_ms / 16)
    level = F.floor(255 * F.exp(-16 * step / (1000 * tau_s)) + 0.5)
    return F.when(age_ms.isNull() | (age_ms < 0) | (step >= last), F.lit(0)).otherwise(level).cast("int")


def paint(mode: str, plain: Column, tagged: Column) -> Column:
    """Level shown for a pixel: all hits, tagged ones only, or tagged ones highlighted over dimmed others."""
    if mode not in ("all", "only", "highlight"):
        raise ValueError("mode must be all, only or highlight")
    return plain if mode == "all" else tagged if mode == "only" else F.greatest(tagged, F.floor(plain / 4).cast("int"))


def encode_layer(delta: DataFrame, magic: str, seq: int) -> DataFrame:
    """One binary frame of a layer delta: magic, seq, count, then (pixel id u32, seconds f64); -1 clears."""
    import pyarrow as pa

    if magic not in ("RDT1", "RDB1", "RDL1"):
        raise ValueError("unknown layer")
    ship(delta.sparkSession)

    def pack(batches):
        for b in batches:
            ids, ticks = (c.to_pylist() for c in b.columns)
            body = [(i, struct.pack("<Id", i, -1.0 if t < 0 else t * 1e-7)) for i, t in zip(ids, ticks)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in body], pa.int32()), pa.array([x for _, x in body], pa.binary())], names=["pixel_id", "record"])

    records = delta.select(F.col("pixel_id").cast("int"), F.col("tick").cast("bigint")).mapInArrow(pack, "pixel_id int, record binary")
    # a frame holds one record a pixel, so its size is bounded by the geometry
    whole = records.agg(F.array_sort(F.collect_list(F.struct("pixel_id", "record"))).alias("r"))
    head = F.concat(F.hex(F.lit(magic)), le_hex(F.lit(seq), 4), le_hex(F.size("r"), 4))
    return whole.select(F.unhex(F.concat(head, F.array_join(F.transform("r", lambda x: F.hex(x["record"])), ""))).alias("frame"))


def decode_layer(frame: bytes) -> tuple[str, int, list[tuple[int, float]]]:
    """Magic, seq and records of a layer frame; ValueError if its length, kind or a record is bad."""
    if len(frame) < 12 or frame[:4] not in (b"RDT1", b"RDB1", b"RDL1"):
        raise ValueError("not a layer frame")
    seq, n = struct.unpack_from("<II", frame, 4)
    if len(frame) != 12 + 12 * n:
        raise ValueError("length does not match the count")
    records = [struct.unpack_from("<Id", frame, 12 + 12 * k) for k in range(n)]
    if any(not (t >= 0 or t == -1) for _, t in records):
        raise ValueError("bad record")
    return frame[:4].decode(), seq, records


def encode_ages(ages: DataFrame, seq: int, now: float) -> DataFrame:
    """One host-time frame RDP1 of changed pixels (pixel_id, age): magic, seq, count, now, then (id u32, age f32); null ages are 1e9."""
    return _frame(ages.select(F.col("pixel_id").cast("int"), F.coalesce(F.col("age").cast("double"), F.lit(1e9)).alias("v")), "<If", b"RDP1", struct.pack("<I", seq), struct.pack("<d", now))


def encode_snapshot(delta: DataFrame, clocks: list[tuple[float, float, bool]], seq: int) -> DataFrame:
    """One detector-time frame RDP2 of changed pixels (pixel_id, tick): magic, seq, count, (cursor, frontier, running) of 8 sources, then (id u32, seconds f64)."""
    if len(clocks) != 8:
        raise ValueError("8 clocks needed")
    head = b"".join(struct.pack("<ddd", c, f, float(r)) for c, f, r in clocks)
    seconds = F.when(F.col("tick") < 0, F.lit(-1.0)).otherwise(F.col("tick") * F.lit(1e-7))
    return _frame(delta.select(F.col("pixel_id").cast("int"), seconds.alias("v")), "<Id", b"RDP2", struct.pack("<I", seq), head)


def _frame(records: DataFrame, layout: str, magic: bytes, seq: bytes, head: bytes) -> DataFrame:
    """Frame of one record a pixel, packed in the tasks; its size is bounded by the geometry."""
    import pyarrow as pa

    ship(records.sparkSession)

    def pack(batches):
        for b in batches:
            ids, values = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([struct.pack(layout, i, v) for i, v in zip(ids, values)], pa.binary())], names=["pixel_id", "record"])

    whole = records.mapInArrow(pack, "pixel_id int, record binary").agg(F.array_sort(F.collect_list(F.struct("pixel_id", "record"))).alias("r"))
    parts = [F.lit((magic + seq).hex()), le_hex(F.size("r"), 4), F.lit(head.hex()), F.array_join(F.transform("r", lambda x: F.hex(x["record"])), "")]
    return whole.select(F.unhex(F.concat(*parts)).alias("frame"))


def decode_snapshot(frame: bytes) -> tuple[str, int, list[tuple[float, ...]], list[tuple[int, float]]]:
    """Magic, seq, clocks and records of an RDP1 or RDP2 frame; ValueError if its kind or length is bad."""
    kinds = {b"RDP1": (20, "<If"), b"RDP2": (204, "<Id")}
    if frame[:4] not in kinds or len(frame) < kinds[frame[:4]][0]:
        raise ValueError("not a snapshot frame")
    start, layout = kinds[frame[:4]]
    seq, n = struct.unpack_from("<II", frame, 4)
    size = struct.calcsize(layout)
    if len(frame) != start + n * size:
        raise ValueError("length does not match the count")
    clocks = [struct.unpack_from("<d", frame, 12)] if start == 20 else [struct.unpack_from("<ddd", frame, 12 + 24 * k) for k in range(8)]
    return frame[:4].decode(), seq, clocks, [struct.unpack_from(layout, frame, start + size * k) for k in range(n)]


#: Most characters of a published document; a fixed value.
DOCUMENT_LIMIT = 262_144


def document(sources: DataFrame, version: int, name: str = "sources") -> DataFrame:
    """One JSON document of the rows of each source, in the order of iog; null if it is longer than the limit."""
    whole = sources.agg(F.array_sort(F.collect_list(F.struct("iog", F.struct(*sorted(sources.columns)).alias("row")))).alias("r"))
    json = F.to_json(F.struct(F.lit(version).alias("version"), F.transform("r", lambda x: x["row"]).alias(name)))
    return whole.select(F.when(F.length(json) <= DOCUMENT_LIMIT, json).alias("document"))


def format_time(unix_ms: Column, zone: str = "America/Chicago") -> Column:
    """Local wall time of Unix milliseconds in a zone, to the millisecond."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(unix_ms), zone), "yyyy-MM-dd HH:mm:ss.SSS")
