import random
from collections import defaultdict

import pytest

from wordstream.llm import percentiles as P


def disc(values, p):
    v = sorted(values)
    return v[max(1, -(-p * len(v) // 100)) - 1]


@pytest.mark.parametrize("buckets", [1, 5])
def test_multi_select(spark, buckets, monkeypatch):
    """Doubles and integers, one group with a third of the rows, null keys, negative values, ties; small ranges force rounds."""
    monkeypatch.setattr(P, "SHORT", 4)
    rng = random.Random(buckets)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([rng.uniform(-1e6, 1e6), float(rng.randint(0, 5))]) if rng.random() > 0.02 else None) for _ in range(800)] + [("one", 3.5)]
    state = P.value_state(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    got = {r.g: r for r in P.percentiles(state, ["g"], buckets=buckets).collect()}
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        assert got[g].n == len(v)
        assert [got[g][f"p{p:02d}"] for p in P.PERCENTS] == [disc(v, p) for p in P.PERCENTS]


def test_queries_propose_several_medians(spark, data, monkeypatch):
    """The pivots of the registered queries are weighted medians of several local medians."""
    from wordstream.llm import queries as Q

    seen, multi_select = [], P.multi_select
    monkeypatch.setattr(P, "multi_select", lambda state, keys, ranks, buckets=1: seen.append(buckets) or multi_select(state, keys, ranks, buckets))
    for f in (Q.source_percentiles, Q.chip_percentiles, Q.combined_percentiles):
        f(spark, data)
    assert len(seen) == 4 and min(seen) > 1


def test_values_that_doubles_cannot_tell_apart(spark, monkeypatch):
    """Nanosecond times: many different values between two doubles; a hot group among them."""
    monkeypatch.setattr(P, "SHORT", 4)
    base = 1_790_000_000_000_000_000
    rows = [("hot", base + k) for k in range(90)] + [("a", base + 7 * k) for k in range(10)]
    state = P.value_state(spark.createDataFrame(rows, "g string, v bigint"), ["g"], "v")
    got = {r.g: [r[f"p{p:02d}"] for p in P.PERCENTS] for r in P.percentiles(state, ["g"], buckets=3).collect()}
    assert got == {g: [disc([v for h, v in rows if h == g], p) for p in P.PERCENTS] for g in ("hot", "a")}


def test_combined_states(spark):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), rng.randint(1, 20), int(rng.gauss(100, 30))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, day int, v int")
    parts = [P.value_state(df.where(f"day {c}"), ["g", "day"], "v") for c in ("<= 10", "> 10")]
    exact = {r.g: r for r in P.percentiles(P.combine(parts, ["g"]), ["g"]).collect()}
    rough = {r.g: r for r in P.percentiles(P.combine([P.summarize(p, ["g", "day"], 10) for p in parts], ["g"]), ["g"]).collect()}
    for g in "xy":
        v = sorted(x[2] for x in rows if x[0] == g)
        assert [exact[g][f"p{p:02d}"] for p in P.PERCENTS] == [disc(v, p) for p in P.PERCENTS]
        assert rough[g].n == len(v)
        for p in P.PERCENTS:  # ranks are off by at most n / 10
            x, r, e = rough[g][f"p{p:02d}"], max(1, -(-p * len(v) // 100)), len(v) / 10 + 1
            assert sum(y <= x for y in v) >= r - e and sum(y < x for y in v) <= r + e


def test_empty(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert P.percentiles(P.value_state(df, ["g"], "v"), ["g"]).count() == 0
    assert P.summarize(P.value_state(df.limit(0), ["g"], "v"), ["g"]).count() == 0
