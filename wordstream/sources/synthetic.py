"""Deterministic synthetic inputs and further readers: demo hits, rate captures, packet files, endpoint settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Allowed families of front-end chips; fixed values.
FAMILIES = ("2", "2a", "2b", "2d", "lightpix-1")


def read_capture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, samples) of a JSON-lines rate capture; ValueError unless there is one metadata line and a sample."""
    rows = spark.read.schema("type string, boot_id string, iogs array<int>, scalars array<string>, source_fields array<string>, values array<double>").json(path)
    n = rows.groupBy("type").count().where("type IN ('metadata', 'sample')")
    found = {r["type"]: r["count"] for r in n.collect()}  # two rows
    if found.get("metadata") != 1 or not found.get("sample"):
        raise ValueError("need one metadata line and at least one sample")
    return rows.where("type = 'metadata'"), rows.where("type = 'sample'").select("values")


def tile_rows(samples: DataFrame, scalars: int = 6) -> DataFrame:
    """Long form of wide capture samples: (seq, begin_monotonic, end_monotonic, iog, tile, mapped_packets, unique_pixels)."""
    v = F.col("values")
    tiles = F.explode(F.sequence(F.lit(0), F.lit(63)))
    rows = samples.select("values", tiles.alias("code"))
    at = lambda k: F.try_element_at(v, k)
    return rows.select(at(F.lit(1)).cast("bigint").alias("seq"), at(F.lit(2)).alias("begin_monotonic"), at(F.lit(3)).alias("end_monotonic"), (F.floor(F.col("code") / 8) + 1).cast("int").alias("iog"), (F.col("code") % 8 + 1).cast("int").alias("tile"), at(F.col("code") + scalars + 1).cast("bigint").alias("mapped_packets"), at(F.col("code") + scalars + 65).cast("bigint").alias("unique_pixels"))


def packet_stream(packets: DataFrame, most: int | None = None) -> DataFrame:
    """Word stream of an offline packet table (row_id, packet_type, io_group, timestamp, receipt_timestamp, trigger_type, valid_parity)."""
    rows = packets.where(F.col("row_id") < most) if most is not None else packets
    rows = rows.where(F.coalesce("valid_parity", F.lit(True)) & F.col("packet_type").isin(0, 6))
    sync = F.col("packet_type") == 6
    return rows.select(
        F.col("io_group").alias("iog"), F.col("row_id").alias("seq"), F.lit(0).alias("word_idx"), F.when(sync, "S").otherwise("D").alias("kind"), F.when(sync, F.col("trigger_type")).cast("int").alias("io"),
        F.when(~sync, F.col("receipt_timestamp")).alias("receipt"), F.when(sync, F.col("timestamp")).alias("aux"), F.when(~sync, F.col("timestamp")).alias("raw"),
    )


def endpoint_errors(endpoints: DataFrame) -> DataFrame:
    """Problems of endpoint rows (iog, io_class, host, port)."""
    count = endpoints.groupBy("iog").agg(F.count(F.lit(1)).alias("same"))
    addresses = endpoints.groupBy("host", "port").agg(F.count(F.lit(1)).alias("same_address"))
    rows = endpoints.join(count, "iog", "left").join(addresses, ["host", "port"], "left")
    problems = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("iog").between(1, 8), F.lit(False)), F.lit("iog not in 1..8")), F.when(F.col("same") > 1, F.lit("iog given twice")), F.when(F.col("same_address") > 1, F.lit("address given twice")),
        F.when(~F.coalesce(F.col("host").rlike(r"^[A-Za-z0-9.\-]+$"), F.lit(False)), F.lit("bad host")), F.when(~F.coalesce(F.col("port") == 5556, F.lit(False)), F.lit("bad port")),
    ))
    return rows.select("iog", F.explode(problems).alias("problem"))


def family(version: F.Column) -> F.Column:
    """Chip family of a version string, a leading v left off; null if it is none of the allowed ones."""
    v = F.regexp_replace(F.lower(F.trim(version)), "^v", "")
    return F.when(v.isin(*FAMILIES), v)
