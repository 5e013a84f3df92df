import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("WORDSTREAM_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from wordstream.streaming.stateful import STATE_STORE

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config(*STATE_STORE).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)


HITS = "iog int, seq bigint, word_idx int, io_channel int, chip int, channel int, adc int, timestamp bigint, receipt_timestamp bigint, message_seconds bigint"


@pytest.fixture(scope="session")
def make_hits(spark):
    """Hits from tuples, with extra columns whose names the operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, HITS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("t", "tick", "block", "bucket", "period", "hash", "grain", "value", "weight", "k", "range", "slab", "is_hit", "source"):
                df = df.withColumn(c, F.lit(1))
        return df

    return make


@pytest.fixture(scope="session")
def rows_of():
    def get(df, *order):
        return sorted(tuple(r) for r in df.select(*order).collect()) if order else sorted((tuple(r) for r in df.collect()), key=str)

    return get


def hit_tick(ts, rec, sec):
    R = 10_000_000
    if ts is None or rec is None or sec is None or not 0 <= ts < 2**31 or not 0 <= rec < 32 * R or sec <= 0:
        return None
    q = rec // R
    return (sec - q) * R + ts if ts <= rec else (sec - q - 1) * R + ts % R


def random_hits(rng, n, iogs=2, chips=2, channels=3, start=1000, spread=12):
    """Rows with nulls, late and corrupt times, repeats, and one hot address."""
    R, rows = 10_000_000, []
    for k in range(n):
        sec = start + k * spread // n
        raw = rng.randrange(R)
        back = rng.choice([0, 0, 0, 0, 1, 2, 3, 4, 6])
        hot = rng.random() < 0.35
        r = [1 if hot else rng.randint(1, iogs), k // 3, k % 3, rng.randint(1, 2), 7 if hot else rng.randint(1, chips), 5 if hot else rng.randint(0, channels - 1), rng.randint(90, 110), raw, back * R + rng.randrange(R), sec]
        if rng.random() < 0.05:
            r[rng.choice([3, 4, 5, 6, 7, 8, 9])] = None
        if rng.random() < 0.05:
            i, v = rng.choice([(6, -4), (6, 400), (7, 2**31), (7, -1), (8, 2**33), (9, 0), (5, 99), (7, 3 * R)])
            r[i] = v
        rows.append(tuple(r))
    return rows + [rng.choice(rows) for _ in range(n // 20)]
