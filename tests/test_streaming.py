"""Streaming forms give the same rows as the batch forms, however the stream is cut."""

import random

import pytest
from conftest import random_hits
from pyspark.sql import functions as F
from test_detector import STREAM, R, unroll_oracle

from wordstream.config import Windows
from wordstream.operators import epochs, late
from wordstream.streaming import stateful


def split(spark, rows, schema, path, parts):
    n = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * n : (k + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.mark.parametrize("parts", [1, 3])
def test_unroll_stream(spark, tmp_path, parts):
    rng = random.Random(4)
    items = [rng.choice([("D", rng.randrange(R), rng.randrange(R)), ("S", R * rng.randint(1, 2) + 3)]) for _ in range(90)]
    rows = [(1, k // 3, k % 3, w[0], 1 if w[0] == "D" else 83, 100, w[2] if w[0] == "D" else None, w[1] if w[0] == "S" else None, w[1] if w[0] == "D" else None, 1, 1, 1) for k, w in enumerate(items)]
    got = drain(stateful.unroll_stream(split(spark, rows, STREAM, tmp_path / "in", parts)), f"u{parts}", "append")
    assert [(r.tick, r.valid) for r in got.orderBy("seq", "word_idx").collect()] == unroll_oracle(items)[0]


@pytest.mark.parametrize("parts", [1, 4])
def test_align_stream(spark, tmp_path, parts):
    rng = random.Random(7)
    rows, second = [], [1_790_000_000, 1_790_000_000]
    for k in range(120):
        i = k % 2
        second[i] += rng.choice([1, 1, 1, 1, 1, 2, 4])
        label = rng.choice([second[i]] * 9 + [0, None, second[i] - 1])
        aux = rng.choice([R] * 8 + [R + 11, 2 * R, R // 2, None])
        rows += [(1 + i, k, w, "S", 83, label, None, aux, None, None, None, None) for w in range(2 if rng.random() < 0.05 else 1)]
    rows.append(rows[-1])
    got = drain(stateful.align_stream(split(spark, rows, STREAM, tmp_path / "in", parts)), f"al{parts}", "append")
    want = epochs.align(epochs.pps_observations(spark.createDataFrame(rows, STREAM)))
    cols = ("iog", "seq", "word_idx", "tick", "second", "usable", "status", "offset_ticks")
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert {r.status for r in got.collect()} == {"warming", "aligned", "suspect"}


def test_late_stream(spark, tmp_path):
    from conftest import HITS

    rows = sorted(set(random_hits(random.Random(9), 600)), key=lambda r: (r[1], r[2]))
    cut = [r for r in rows]
    out = drain(stateful.late_stream(split(spark, cut, HITS, tmp_path / "in", 4)), "late4", "update")
    last = out.groupBy("iog", "second").agg(F.max_by(F.struct("hits", "total", "valued"), "revision").alias("x")).select("iog", "second", "x.*")
    want = late.late_periods(spark.createDataFrame(rows, HITS)).collect()
    got = {(r.iog, r.second): (r.hits, None if not r.valued else r.total / r.valued) for r in last.collect()}
    assert got == {(r.iog, r.second): (r.hits, r.mean_adc) for r in want}


def test_match_stream(spark, tmp_path):
    rng = random.Random(2)
    base = 17_900_000_000_000_000
    hits = [(1 + k % 2, k, 0, base + rng.randrange(R // 10)) for k in range(200)]
    trig = [(1 + k % 2, "beam", base + rng.randrange(R // 10)) for k in range(30)]
    h = split(spark, hits, "iog int, seq bigint, word_idx int, tick bigint", tmp_path / "h", 3)
    t = split(spark, trig, "iog int, source string, tick bigint", tmp_path / "t", 2)
    got = drain(stateful.match_stream(h, t, Windows(pre_us=10, post_us=300)), "m", "append")
    want = sorted({(i, s) for i, s, _, x in hits for j, _, y in trig if i == j and y - 100 <= x < y + 3000})
    assert sorted((r.iog, r.seq) for r in got.collect()) == want


def test_publish(spark, tmp_path):
    src = split(spark, [(1,), (2,), (3,)], "x int", tmp_path / "in", 2)
    stateful.publish(src, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
