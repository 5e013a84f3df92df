"""Irregular readings onto a regular grid of cells.

Readings are spread over the cells they share time with and aggregated per cell; a sequence of cells per source, made
in blocks of bounded length, is left-joined with them; the last observation is carried forward within a maximum gap.
Blocks hold the trailing cells of the block before as a halo, so that no window spans a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SOURCE = ("boot_id", "iog", "tile")
#: Cell length in seconds; a fixed value of the data model.
CELL_S = 0.5
#: Cells of a source in one block.
CELLS = 4096


def covered_cells(readings: DataFrame, cell_s: float = CELL_S) -> DataFrame:
    """One row for each cell with a reading: number of readings, shared seconds with a rate, and rate times seconds.

    A reading counts if both bounds are finite, so that their cells are BIGINTs, and end > begin. Null and NaN rates
    cover their cells without a rate. A long reading is spread in blocks of cells.
    """
    b, e = F.col("begin_monotonic").cast("double"), F.col("end_monotonic").cast("double")
    most = F.lit(float(1 << 62) * cell_s)
    finite = (F.abs(b) < most) & (F.abs(e) < most)  # also false for NaN, which is greater than all
    rows = readings.where(finite & (e > b)).select(*SOURCE, F.col("seq"), b.alias("b"), e.alias("e"), F.col("mapped_packets_per_s").cast("double").alias("rate")).dropDuplicates()
    lo, hi = F.floor(F.col("b") / cell_s), F.ceil(F.col("e") / cell_s) - 1
    part = rows.select(*SOURCE, "b", "e", "rate", F.explode(F.sequence(F.floor(lo / CELLS), F.floor(hi / CELLS))).alias("block"))
    spread = part.select(*SOURCE, "b", "e", "rate", F.explode(F.sequence(F.greatest(lo, F.col("block") * CELLS), F.least(hi, (F.col("block") + 1) * CELLS - 1))).alias("cell"))
    shared = F.least(F.col("e"), (F.col("cell") + 1) * F.lit(cell_s)) - F.greatest(F.col("b"), F.col("cell") * F.lit(cell_s))
    known = F.col("rate").isNotNull() & ~F.isnan("rate")
    return spread.groupBy(*SOURCE, "cell").agg(F.count(F.lit(1)).alias("readings"), F.sum(F.when(known, shared)).alias("seconds"), F.sum(F.when(known, F.col("rate") * shared)).alias("amount"))


def regular_grid(readings: DataFrame, max_gap: int = 4, cell_s: float = CELL_S, cells: int = CELLS) -> DataFrame:
    """Every cell between the first and the last covered cell of each source, with its rate and a mark.

    mark: 'observed' (the mean rate over the shared seconds, to 6 places), 'carried' (no usable rate; the last observed one, at most
    ``max_gap`` cells back) or 'missing' (rate null). ``readings`` is 0 in a cell that no reading covers. Sources with
    a null in their columns are kept as sources of their own; repeated rows count once; an empty table gives no rows.
    """
    key = [F.col(c) for c in SOURCE]
    seen = covered_cells(readings, cell_s)
    bounds = seen.groupBy(*SOURCE).agg(F.min("cell").alias("first"), F.max("cell").alias("last"))
    block = F.floor(F.col("cell") / cells)
    starts = bounds.select(*SOURCE, "first", "last", F.explode(F.sequence(F.floor(F.col("first") / cells), F.floor(F.col("last") / cells))).alias("block"))
    grid = starts.select(*SOURCE, "block", F.explode(F.sequence(F.greatest("first", F.col("block") * cells - max_gap), F.least("last", (F.col("block") + 1) * cells - 1))).alias("cell"))
    g, s = grid.alias("g"), seen.alias("s")
    same = F.col("g.cell") == F.col("s.cell")
    for c in SOURCE:
        same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = g.join(s, same, "left").select(*(F.col(f"g.{c}").alias(c) for c in SOURCE), "g.block", F.col("g.cell").alias("cell"), F.coalesce("s.readings", F.lit(0)).alias("readings"), F.when(F.col("s.seconds") > 0, F.round(F.col("s.amount") / F.col("s.seconds"), 6)).alias("own"))
    before = Window.partitionBy(*SOURCE, "block").orderBy("cell").rowsBetween(-max_gap, 0)
    filled = joined.withColumn("rate", F.last("own", ignorenulls=True).over(before)).where(block == F.col("block"))
    mark = F.when(F.col("own").isNotNull(), "observed").when(F.col("rate").isNotNull(), "carried").otherwise("missing")
    return filled.select(*key, F.col("cell").cast("bigint").alias("cell"), F.col("readings").cast("bigint").alias("readings"), "rate", mark.alias("mark"))


def grid_gaps(readings: DataFrame, cell_s: float = CELL_S) -> DataFrame:
    """Cells of the grid that no reading covers."""
    return regular_grid(readings, cell_s=cell_s).where("readings = 0").select(*SOURCE, "cell")
