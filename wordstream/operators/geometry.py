"""Pixel geometry: dimensions, mapping of hits, extents, and lookup of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADDRESS = ("iog", "io_channel", "chip", "channel")


def tile_of(io_channel: Column) -> Column:
    """Tile 1..8 of an io_channel 1..32."""
    return F.when(io_channel.between(1, 32), (F.floor((io_channel - 1) / 4) + 1).cast("int"))


def module_of(iog: Column) -> Column:
    return F.floor((iog - 1) / 2).cast("int")


def map_hits(hits: DataFrame, dim_address: DataFrame) -> DataFrame:
    """Hits with pixel_id, null where the address is in no tile. The address table has a fixed bound; Spark broadcasts it if it is small."""
    return hits.join(dim_address.select(*ADDRESS, "pixel_id").dropDuplicates([*ADDRESS]), [*ADDRESS], "left")


def mapping_metrics(mapped: DataFrame, min_raw: int = 10) -> DataFrame:
    """mapped, unmapped, filtered (mapped, raw time below min_raw) and selected hits of each iog."""
    known, late = F.col("pixel_id").isNotNull(), F.col("timestamp") >= min_raw
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return mapped.groupBy("iog").agg(count(known).alias("mapped"), count(~known).alias("unmapped"), count(known & ~late).alias("filtered"), count(known & late).alias("selected"))


def raw_veto(mapped: DataFrame, min_raw: int = 10) -> DataFrame:
    """Mapped hits whose raw timestamp is at least min_raw; the raw value itself, not its remainder."""
    return mapped.where(F.col("pixel_id").isNotNull() & (F.col("timestamp") >= min_raw))


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of geometry files {"pixel_pitch": p, "geometry": {"side-tile-chip-channel": [x, y]}}, with the hash of each file."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))
    doc = raw.select("sha256", F.regexp_extract("path", r"mod(\d+)", 1).try_cast("int").alias("module"), F.from_json("text", "pixel_pitch double, geometry map<string, array<double>>").alias("d"))
    pix = doc.select("sha256", "module", F.col("d.pixel_pitch").alias("pitch"), F.explode("d.geometry").alias("address", "xy"))
    part = lambda k: F.split("address", "-")[k].try_cast("int")
    return pix.select("sha256", "module", "pitch", part(0).alias("side"), part(1).alias("geometry_tile"), part(2).alias("chip"), part(3).alias("channel"), F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def geometry_errors(pixels: DataFrame, pitch: float = 3.8) -> DataFrame:
    """(iog, tile, problem) of pixels that no raster can hold: range, not finite, off the grid, two on one place."""
    corner = pixels.groupBy("iog", "tile").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    at = pixels.join(corner, ["iog", "tile"]).withColumn("cx", (F.col("x") - F.col("x0")) / pitch).withColumn("cy", (F.col("y") - F.col("y0")) / pitch)
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    off = (F.abs(F.col("cx") - F.rint("cx")) > 1e-3) | (F.abs(F.col("cy") - F.rint("cy")) > 1e-3)
    single = at.select("iog", "tile", F.when(~F.col("chip").between(0, 255) | ~F.col("channel").between(0, 63), "range").when(F.coalesce(~finite, F.lit(True)), "not finite").when(off, "off grid").alias("problem")).where("problem IS NOT NULL")
    double = at.groupBy("iog", "tile", F.rint("cx"), F.rint("cy")).count().where("count > 1").select("iog", "tile", F.lit("overlap").alias("problem"))
    return single.unionByName(double).dropDuplicates()


def number_pixels(pixels: DataFrame) -> DataFrame:
    """pixel_id by (iog, tile, chip, channel): offsets of tiles, then positions within a tile."""
    from pyspark.sql import Window

    counts = pixels.groupBy("iog", "tile").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("iog", "tile", F.coalesce(F.sum("n").over(Window.orderBy("iog", "tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row a tile
    rank = F.row_number().over(Window.partitionBy("iog", "tile").orderBy("chip", "channel", "x", "y")) - 1
    return pixels.withColumn("k", rank).join(first, ["iog", "tile"]).withColumn("pixel_id", (F.col("first") + F.col("k")).cast("int")).drop("k", "first")


def address_table(numbered: DataFrame) -> DataFrame:
    """Addresses of numbered pixels; the four io_channels of a tile alias the same pixels."""
    return numbered.select("iog", F.explode(F.sequence((F.col("tile") - 1) * 4 + 1, F.col("tile") * 4)).alias("io_channel"), "chip", "channel", "pixel_id")


def tile_extents(pixels: DataFrame) -> DataFrame:
    """Corner and raster size of each tile; pixels have the pitch of their tile."""
    size = lambda c: (F.rint((F.max(c) - F.min(c)) / F.max("pitch")) + 1).cast("int")
    return pixels.groupBy("iog", "tile").agg(F.count(F.lit(1)).alias("n_pixels"), F.round(F.min("x"), 6).alias("x_min"), F.round(F.min("y"), 6).alias("y_min"), size("x").alias("width"), size("y").alias("height"))


def hover_lookup(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Raster cell of points (iog, tile, x, y) in their tile; null outside. Rows are shown top down."""
    at = points.join(tiles.select("iog", "tile", "x_min", "y_min", "pitch", "width", "height", "first_pixel"), ["iog", "tile"])
    col, row = (F.floor((F.col(c) - F.col(f"{c}_min")) / F.col("pitch") + 0.5) for c in ("x", "y"))
    inside = col.between(0, F.col("width") - 1) & row.between(0, F.col("height") - 1)
    return at.select(*points.columns, F.when(inside, col).cast("int").alias("col"), F.when(inside, row).cast("int").alias("row"), F.when(inside, F.col("height") - 1 - row).cast("int").alias("screen_row"))


def geometry_identity(numbered: DataFrame) -> DataFrame:
    """Identity of a geometry: number of pixels and a hash of all of them that does not depend on their order; rows given twice change it too."""
    one = F.xxhash64("iog", "tile", "chip", "channel", "pixel_id").cast("decimal(20,0)")
    return numbered.agg(F.count(F.lit(1)).alias("n_pixels"), F.sha2(F.concat_ws(" ", F.count(F.lit(1)), F.sum(one), F.bit_xor(F.xxhash64("iog", "tile", "chip", "channel", "pixel_id"))), 256).alias("geometry_id"))
