"""Exact percentiles of every group by distributed multi-select, and summaries that can be combined.

A state is a table of (keys, value, weight): how often a group has a value. States of separate files, sources or
seconds are combined by adding the weights of equal values. Percentiles of a state come from multi-select: partitions
propose the local medians of what is left of each range, the weighted median of the proposals becomes the pivot,
weights below, at and above it are counted, ranges without a wanted rank are discarded, and this repeats until every
wanted rank is found or its range is short enough to be read off directly.

A percentile p of n values is the least value whose cumulated weight is at least p * n (error 0). ``summarize`` cuts a
state down to 1 / eps entries a group by the same selection; ranks of its values are off by at most eps * n, and
combining summaries keeps that bound, because the errors and the weights add up alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import checkpoint

#: Percentiles of the queries, and the names of their columns.
PERCENTS = (1, 5, 25, 50, 75, 95, 99)
#: Entries of a range that are few enough to be read off directly.
SHORT = 48


def value_state(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """State of rows: weight of each value in each group. Null values are left out, null keys are a group of their own."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def combine(states: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """State of the union of what the states describe; keys may be fewer than theirs, which merges their groups."""
    parts = [s.select(*keys, "value", "weight") for s in states]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "value").agg(F.sum("weight").alias("weight"))


def multi_select(state: DataFrame, keys: Sequence[str], ranks: Column, buckets: int = 1) -> DataFrame:
    """(keys, n, rank, value): the value at each wanted rank (from 1) of each group.

    ranks: array of BIGINT, an expression over n, the weight of the group. buckets: parts that the entries of one
    group and range are spread over; more than 1 where a group can have very many different values. Groups without
    entries have no rows; NaN counts as the greatest value.
    """
    at = ["k", "range"]  # keys in one struct, in which nulls are equal
    left = checkpoint(state.select(F.struct(*keys).alias("k"), "value", "weight", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).cast("bigint").alias("range")))
    whole = left.groupBy("k").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("entries"))
    ranges = checkpoint(whole.select("k", "n", F.lit(1).cast("bigint").alias("range"), F.lit(0).cast("bigint").alias("below"), "entries", F.array_distinct(ranks).alias("ranks")))
    done: list[DataFrame] = []
    whole_numbers = isinstance(state.schema["value"].dataType, IntegralType)
    for depth in count():
        done.append(_read_off(left, ranges.where(F.col("entries") <= SHORT)))
        ranges = ranges.where(F.col("entries") > SHORT)
        if ranges.isEmpty():
            break
        # every partition proposes the median of its entries of a range; the weighted median of these is the pivot
        rows = left.where("open") if depth else left.join(ranges.select(*at), at, "left_semi")
        proposals = rows.groupBy(*at, "bucket").agg(F.percentile_approx("value", 0.5, 200).alias("m"), F.count(F.lit(1)).alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        # medians are rounded to a double; where that leaves the range, the middle of the range in its own type splits it
        m = _weighted_median()
        between = F.when((m > F.col("lo")) & (m < F.col("hi")), m).otherwise(_half(F.col("lo"), whole_numbers) + _half(F.col("hi"), whole_numbers))
        pivots = proposals.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("m", "c"))).alias("p"), F.sum("c").alias("all"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*at, between.alias("pivot"))
        split = rows.join(_each_bucket(pivots, buckets), [*at, "bucket"])
        below, equal = F.col("value") < F.col("pivot"), F.col("value") == F.col("pivot")
        weigh = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0))
        counts = split.groupBy(*at, "pivot").agg(weigh(below).alias("less"), weigh(equal).alias("same"), F.count_if(below).alias("fewer"), F.count_if(F.col("value") > F.col("pivot")).alias("more"))
        # three ways: ranks below the pivot, at it, above it; a range without ranks is ruled out
        upto, over = F.col("below") + F.col("less"), F.col("below") + F.col("less") + F.col("same")
        low = F.struct((F.col("range") * 2).alias("range"), F.col("below").alias("below"), F.col("fewer").alias("entries"), F.filter("ranks", lambda r: r <= upto).alias("ranks"))
        high = F.struct((F.col("range") * 2 + 1).alias("range"), over.alias("below"), F.col("more").alias("entries"), F.filter("ranks", lambda r: r > over).alias("ranks"))
        cut = checkpoint(ranges.join(counts, at).select("k", "n", "pivot", "range", F.filter("ranks", lambda r: (r > upto) & (r <= over)).alias("hit"), F.filter(F.array(low, high), lambda x: F.size(x["ranks"]) > 0).alias("parts")))
        done.append(cut.select("k", "n", F.explode("hit").alias("rank"), F.col("pivot").alias("value")))
        ranges = cut.select("k", "n", F.inline("parts"))
        kept = cut.select(*at, "pivot", F.transform("parts", lambda x: x["range"]).alias("kept"), F.transform(F.filter("parts", lambda x: x["entries"] > SHORT), lambda x: x["range"]).alias("opened"))
        now = F.col("range") * 2 + F.when(below, 0).otherwise(1)
        rest = rows.join(_each_bucket(kept, buckets), [*at, "bucket"]).where(~equal).withColumn("now", now).where(F.array_contains("kept", F.col("now")))
        left = checkpoint(rest.select("k", "value", "weight", "bucket", F.col("now").alias("range"), F.array_contains("opened", F.col("now")).alias("open")))
    return reduce(DataFrame.unionByName, done).select("k.*", "n", "rank", "value")


def _each_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))


def _half(c: Column, whole_numbers: bool) -> Column:
    return F.call_function("div", c.cast("bigint"), F.lit(2).cast("bigint")) if whole_numbers else c / 2


def _weighted_median() -> Column:
    """First proposal at which half of the entries are reached."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.element_at("p", 1)["m"].alias("m"), F.lit(False).alias("over"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["seen"] + x["c"]).alias("seen"), F.when(s["over"], s["m"]).otherwise(x["m"]).alias("m"), (s["over"] | ((s["seen"] + x["c"]) * 2 >= F.col("all"))).alias("over"))

    return F.aggregate("p", start, step, lambda s: s["m"])


def _read_off(left: DataFrame, short: DataFrame) -> DataFrame:
    """Values at the wanted ranks of ranges with few entries, which are sorted and added up in one array each."""
    rows = left.where("NOT open") if "open" in left.columns else left.join(short.select("k", "range"), ["k", "range"], "left_semi")
    lists = rows.groupBy("k", "range").agg(F.array_sort(F.collect_list(F.struct("value", "weight"))).alias("e"))
    ready = short.join(lists, ["k", "range"]).select("k", "n", "below", "e", F.explode("ranks").alias("rank"))
    start = F.struct(F.col("below").alias("seen"), F.element_at("e", 1)["value"].alias("v"), F.lit(False).alias("over"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["seen"] + x["weight"]).alias("seen"), F.when(s["over"], s["v"]).otherwise(x["value"]).alias("v"), (s["over"] | (s["seen"] + x["weight"] >= F.col("rank"))).alias("over"))

    return ready.select("k", "n", "rank", F.aggregate("e", start, step, lambda s: s["v"]).alias("value"))


def _rank(percent: int) -> Column:
    """Least rank that is at least percent / 100 of n, at least 1."""
    n = F.col("n")
    return F.greatest(F.lit(1).cast("bigint"), F.call_function("div", n * percent + 99, F.lit(100).cast("bigint")))


def percentiles(state: DataFrame, keys: Sequence[str], percents: Sequence[int] = PERCENTS, buckets: int = 1) -> DataFrame:
    """(keys, n, p01, p05, ...): percentiles of each group of a state, exact for that state."""
    found = multi_select(state, keys, F.array(*(_rank(p) for p in percents)), buckets)
    cols = [F.max(F.when(F.col("rank") == _rank(p), F.col("value"))).alias(f"p{p:02d}") for p in percents]
    return found.groupBy(*keys, "n").agg(*cols)


def summarize(state: DataFrame, keys: Sequence[str], parts: int = 50, buckets: int = 1) -> DataFrame:
    """State of at most ``parts`` entries a group, whose ranks are off by at most n / parts."""
    n = F.col("n")
    ranks = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda k: F.call_function("div", n * k + (parts - 1), F.lit(parts).cast("bigint")))
    found = multi_select(state, keys, ranks, buckets)
    before = F.coalesce(F.array_max(F.filter(ranks, lambda r: r < F.col("rank"))), F.lit(0))
    return found.groupBy(*keys, "value").agg(F.sum(F.col("rank") - before).alias("weight"))
