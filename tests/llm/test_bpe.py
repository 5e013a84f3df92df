import random

import pytest

from wordstream.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
try:
    PATH = bpe.vocabulary_path()
except ImportError:
    pytest.skip("no vocabulary", allow_module_level=True)

TEXTS = [
    None, "", " ", "\n\n", "Hello world", "Don't  stop   ", "<|endoftext|> x", "a" * 4000, "日本語のテキスト。", "हिन्दी में पाठ", "ภาษาไทย", "نص عربي", "👩‍🔧🛠️", "１２３ ٤٥", "é    ", "\x00\x01", "x" * 50_000 + " y", "'s're'LL",
]


def test_same_as_library(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab AB'.,\n\té漢字1२😀ا") for _ in range(80)) for _ in range(300)]
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = {k: t.encode(x, add_special_tokens=False).ids if x else [] for k, x in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'clash' AS ids", "1 AS tokens").repartition(3)
    assert {r.doc_id: r.ids for r in bpe.encode_texts(df).collect()} == want
    assert {r.doc_id: r.tokens for r in bpe.count_tokens(df, ["doc_id"]).collect()} == {k: len(v) for k, v in want.items()}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert bpe.encode_texts(df).count() == 2 and bpe.encode_texts(df.limit(0)).count() == 0


def test_index_applies_ranks_in_order():
    """Overlapping pairs are merged from the left."""
    p = bpe.pair_index(PATH)
    t = tokenizers.Tokenizer.from_file(PATH)
    for w in ("aaaaa", "ababab", "nananana", "banana"):
        assert p.merge_words([w]) == [t.encode(w, add_special_tokens=False).ids]
