import random

import pytest
from pyspark.sql import functions as F

from wordstream.llm import bpe, mixing

try:
    bpe.vocabulary_path()
except ImportError:
    pytest.skip("no vocabulary", allow_module_level=True)

MIXES, TARGETS = "mix_id int, mix_name string, total_ratio double", "mix_id int, source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = "the crane crew hid an oak door under the bridge before noon".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(3, 60))), "hot" if k % 3 == 0 else rng.choice(["a", "b", "tiny"] if k < 30 else ["a", "b"])) for k in range(600)]
    rows += [(900, None, "a"), (901, "", "a"), (902, "lost words", None), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("block", F.lit(1)).withColumn("slot", F.lit(1))


def test_shares(spark, docs):
    mixes = spark.createDataFrame([(1, "m", 0.5), (2, "n", 1.5), (3, "none", 1.0), (4, "zero", 0.0)], MIXES)
    targets = spark.createDataFrame([(1, "hot", 50.0, 1), (1, "a", 25.0, 4), (1, "b", 25.0, None), (2, "hot", 0.6, 1), (2, "tiny", 0.2, 3), (2, "b", 0.2, None), (2, "gone", 0.0, 1), (2, "missing", 0.4, 1), (2, "a", 0.0, 9), (4, "a", 1.0, 1)], TARGETS)
    sized = {r.doc_id: r for r in bpe.count_tokens(docs, ["doc_id", "source"]).collect() if r.tokens}
    total = sum(r.tokens for r in sized.values())
    size = {s: sum(r.tokens for r in sized.values() if r.source == s) for s in ("hot", "a", "b", "tiny")}
    rows = mixing.mix_documents(docs, mixes, targets).collect()
    uses: dict = {}
    for r in rows:
        uses.setdefault((r.mix_id, r.doc_id), []).append(r.used)
        assert (r.source, r.tokens) == (sized[r.doc_id].source, sized[r.doc_id].tokens)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in uses.values())
    cap = {(1, "hot"): 1, (1, "a"): 4, (2, "hot"): 1, (2, "tiny"): 3}
    assert all(len(v) <= cap.get((m, sized[d].source), 99) for (m, d), v in uses.items())
    got = {(r.mix_id, r.source): r for r in mixing.mix_shares(docs, mixes, targets).collect()}
    assert len(got) == 10
    for (m, s), r in got.items():
        ratio = {1: 0.5, 2: 1.5, 4: 0.0}[m]
        want = min(r.target_share * ratio * total, cap.get((m, s), 99) * size.get(s, 0))
        assert abs(r.reached_tokens - want) <= 5 * mixing.BLOCK + 60, (m, s)
        assert r.reached_tokens == sum(x.tokens for x in rows if (x.mix_id, x.source) == (m, s))
    assert got[2, "tiny"].reached_tokens == 3 * size["tiny"] and got[2, "missing"].reached_tokens == 0 and got[2, "a"].reached_tokens == 0
    assert got[1, "hot"].target_share == pytest.approx(0.5) and sum(r.reached_share for (m, _), r in got.items() if m == 1) == pytest.approx(1)


def test_every_stretch_is_mixed(spark, docs):
    """Low discrepancy: in each hundred slots the sources are within a few slots of their shares."""
    mixes, targets = spark.createDataFrame([(1, "m", 5.0)], MIXES), spark.createDataFrame([(1, "a", 0.7, None), (1, "b", 0.3, None)], TARGETS)
    plans = mixing._plans(mixes, targets, mixing._sized(docs, None))
    slots = [r.source for r in mixing.schedule(plans).orderBy("slot").collect()]
    for k in range(0, len(slots) - 100, 50):
        assert abs(slots[k : k + 100].count("a") - 70) <= 4


def test_numbering_across_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    mixes, targets = spark.createDataFrame([(1, "m", 1.0)], MIXES), spark.createDataFrame([(1, "a", 0.5, None), (1, "b", 0.5, None)], TARGETS)
    plans = mixing._plans(mixes, targets, mixing._sized(docs, None))
    seen = {}
    for r in mixing.schedule(plans).orderBy("slot").collect():
        assert r.n == seen.get(r.source, 0)
        seen[r.source] = r.n + 1


def test_empty(spark, docs):
    mixes, targets = spark.createDataFrame([(1, "m", 1.0)], MIXES), spark.createDataFrame([(1, "a", 1.0, 1)], TARGETS)
    assert mixing.mix_documents(docs.limit(0), mixes, targets).count() == 0
    assert mixing.mix_documents(docs, mixes, targets.limit(0)).count() == 0
