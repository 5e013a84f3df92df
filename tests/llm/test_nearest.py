import random

import pytest
from conftest import hit_tick, random_hits

from wordstream.llm import nearest as N

R = 10_000_000
WORDS = "iog int, seq bigint, word_idx int, header_second bigint, kind string, io int, receipt bigint, aux bigint, payload bigint, t int"
CONFIG = "iog int, post_us double, pre_us double"


def oracle(hits, words, config):
    trig = [(w[0], w[3] * R + w[7] % R, w[1], w[2]) for w in set(words) if w[4] == "T" and w[3] and w[3] > 0 and w[7] is not None and 0 <= w[7] < 32 * R]
    out = []
    for h in set(hits):
        t = hit_tick(h[7], h[8], h[9])
        if t is None or h[0] not in config:
            continue
        best = min(((abs(k[1] - t), k[1], k[2], k[3]) for k in trig if k[0] == h[0]), default=None)
        if best and best[0] <= config[h[0]] * 10:
            out.append((h[0], h[1], h[2], best[2], best[3], best[0]))
    return sorted(out)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_nearest(spark, make_hits, rows_of, batch):
    """Wide tolerances, repeated and equal-time triggers, ties, slab borders, and small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng = random.Random(batch)
        hits = random_hits(rng, 500)
        words = [(rng.randint(1, 2), 5000 + k, k % 4, 1000 + rng.randrange(12), rng.choice("TTTTS"), 2, 0, rng.choice([rng.randrange(R), rng.randrange(3 * R), 5, R - 1, None, -1]), 0, 0) for k in range(60)]
        words += words[:9] + [(w[0], w[1] + 900, *w[2:]) for w in words[:9]]
        for h in hits[:40]:  # two triggers equally near, before and after
            t = hit_tick(h[7], h[8], h[9])
            if t:
                words += [(h[0], 9000, 1, (t + d) // R, "T", 2, 0, (t + d) % R, 0, 0) for d in (-700, 700)]
        config = {1: 50_000.5, 2: 9000.0}
        c = spark.createDataFrame([(k, v, None) for k, v in config.items()] + [(3, None, 1.0)], CONFIG)
        got = N.nearest_triggers(make_hits(hits), spark.createDataFrame(words, WORDS), c)
        cols = ("iog", "seq", "word_idx", "trigger_seq", "trigger_word_idx", "distance")
        want = oracle(hits, words, config)
        assert rows_of(got, *cols) == want
        every = N.nearest_triggers(make_hits(hits), spark.createDataFrame(words, WORDS), c, unmatched=True)
        timed = {h[:3] for h in hits if hit_tick(h[7], h[8], h[9]) is not None and h[0] is not None}
        assert every.count() == len(timed) and every.where("trigger_seq IS NOT NULL").count() == len(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark, make_hits):
    w, c = spark.createDataFrame([], WORDS), spark.createDataFrame([], CONFIG)
    assert N.nearest_triggers(make_hits([]), w, c).count() == 0
    assert N.nearest_triggers(make_hits([(1, 1, 1, 1, 1, 1, 1, 5, 6, 100)]), w, c, unmatched=True).count() == 1
