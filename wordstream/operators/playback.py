"""What is visible at a playback cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seen_at(hits: DataFrame, cursors: DataFrame) -> DataFrame:
    """Latest tick of each pixel at a cursor of its iog: hits not later than the cursor, however late they came."""
    return hits.join(cursors.select("iog", "cursor_tick"), "iog").where("tick <= cursor_tick").groupBy("iog", "cursor_tick", "pixel_id").agg(F.max("tick").alias("tick"))
