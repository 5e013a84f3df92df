"""Running values in wire order of each source, computed in blocks.

A window over a whole source would sort it in one task. Here the arrival order is cut into blocks; each block is
summed up on its own, the few block values are carried over, and the running value is taken within blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ticks import div

#: Frames of a source in one block.
BLOCK = 1 << 14


def running(df: DataFrame, values: dict[str, tuple[str, Column]], inclusive: bool = False, block: int = BLOCK, key: str = "iog") -> DataFrame:
    """Add a running value for each name: ('sum' | 'max' | 'last', column) over the earlier rows of (key, seq, word_idx).

    'last' is the last value that is not null. Before any value: 0 for a sum, null else. ``inclusive`` counts the row itself.
    """
    names = list(values)
    src = {n: f"__{n}" for n in names}
    rows = df.withColumn("__block", div(F.col("seq").cast("bigint"), block)).withColumns({src[n]: c for n, (_, c) in values.items()})
    at = F.struct("seq", "word_idx")
    total = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))}
    blocks = rows.groupBy(key, "__block").agg(*(total[k](src[n]).alias(n) for n, (k, _) in values.items()))
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    carry = blocks.select(F.col(key).alias("__key"), F.col("__block").alias("__b"), *(over[k](n).over(earlier).alias(f"__carry_{n}") for n, (k, _) in values.items()))
    inside = Window.partitionBy(key, "__block").orderBy("seq", "word_idx").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = rows.join(carry, (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__b")))

    def value(n: str, kind: str) -> Column:
        own, before = over[kind](src[n]).over(inside), F.col(f"__carry_{n}")
        if kind == "sum":
            return F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))
        return F.greatest(before, own) if kind == "max" else F.coalesce(own, before)

    out = joined.withColumns({n: value(n, k) for n, (k, _) in values.items()})
    return out.drop("__block", "__b", "__key", *src.values(), *(f"__carry_{n}" for n in names))


def as_of(rows: DataFrame, marks: DataFrame, block: int = BLOCK, key: str = "iog", distinct: bool = False) -> DataFrame:
    """Rows with ``seen``: the last ``value`` of marks (key, seq, word_idx, value) strictly before each, null without one.

    Marks are rare against rows. The rows are shuffled once, by key and block of arrival, together with the marks of the
    block and the last mark before it. Rows without key or seq are left out; ``distinct`` drops repeated ones on the way.
    """
    at = div(F.col("seq").cast("bigint"), block)
    rows = rows.where(F.col(key).isNotNull() & F.col("seq").isNotNull()).withColumn("__block", at)
    marks = marks.select(key, "seq", "word_idx", F.struct("value").alias("__mark"))
    ends = rows.groupBy(key).agg(F.max("__block").alias("top"))
    # the last mark of each block is what later blocks start from, up to the block of the next one
    last = marks.groupBy(key, at.alias("b")).agg(F.max_by("__mark", F.struct("seq", "word_idx")).alias("__mark"))
    nxt = last.join(ends, key).withColumn("upto", F.coalesce(F.lead("b").over(Window.partitionBy(key).orderBy("b")), F.col("top")))
    carried = nxt.where("upto > b").select(key, F.explode(F.sequence(F.col("b") + 1, F.col("upto"))).alias("__block"), "__mark")
    known = carried.select(key, "__block", (F.col("__block") * block - 1).alias("seq"), F.lit(-(1 << 31)).alias("word_idx"), "__mark")
    known = known.unionByName(marks.select(key, at.alias("__block"), "seq", "word_idx", "__mark"))
    left = rows.repartition(key, "__block")
    both = (left.dropDuplicates() if distinct else left).unionByName(known.repartition(key, "__block"), allowMissingColumns=True)
    before = Window.partitionBy(key, "__block").orderBy("seq", "word_idx", F.col("__mark").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("__last", F.last("__mark", ignorenulls=True).over(before)).where("__mark IS NULL")
    return out.withColumn("seen", F.col("__last")["value"]).drop("__last", "__mark", "__block")
