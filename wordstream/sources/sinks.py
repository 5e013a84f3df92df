"""Readers of frames and writers of captures and reports; a writer never replaces what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FRAMES = "iog int, seq bigint, value binary"
#: Columns of the rate report; fixed.
RATE_COLUMNS = ("seq", "begin_monotonic", "end_monotonic", "duration_s", "iog", "tile", "mapped_packets", "mapped_packets_per_s", "unique_pixels", "active_fraction")


def read_frames(spark: SparkSession, path: str, streaming: bool = False, files: int = 64) -> DataFrame:
    """Frames stored as parquet; as a stream at most ``files`` new files a micro-batch, so that a backlog is drained in bounded steps."""
    if streaming:
        return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files).parquet(path)
    return spark.read.schema(FRAMES).parquet(path)


def write_rates(rates: DataFrame, path: str) -> None:
    """Rate report as CSV with a header; an error if the path exists."""
    rates.select(*RATE_COLUMNS).write.mode("errorifexists").option("header", True).csv(path)


def write_capture(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; an error if the path exists."""
    rows.write.mode("errorifexists").json(path)
