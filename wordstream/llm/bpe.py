"""Token ids of texts by a byte-level BPE vocabulary, with a pair occurrence index.

All different words of a batch of a partition are laid end to end as linked lists of tokens. An index maps each pair of
neighbours to all its positions. The active ranks are applied in ascending order: every occurrence of the pair is
merged, and the lists of the pairs that this makes or breaks are updated. Words that came before are not merged again.
"""

from __future__ import annotations

import heapq
import importlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Pattern that splits a text into words before the merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers before it starts over.
REMEMBER = 500_000
#: Different words that are merged at once.
AT_ONCE = 20_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    return importlib.import_module("public_tokenizers").path(name)


def _byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndex:
    """Merges of a vocabulary, applied through an index of pair occurrences."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids = model["vocab"]
        self.byte_id = [0] * 256
        for letter, byte in _byte_letters().items():
            self.byte_id[byte] = ids[letter]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[tuple[int, int, int]] = []
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((ids[a], ids[b]), k)
            self.merged.append((ids[a], ids[b], ids[a + b]))
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN)

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        token: list[int] = []
        following: list[int] = []
        previous: list[int] = []
        heads = []
        for w in words:
            heads.append(len(token))
            data = w.encode("utf-8", "surrogatepass")
            start = len(token)
            token.extend(self.byte_id[b] for b in data)
            following.extend(range(start + 1, start + len(data)))
            following.append(-1)
            previous.append(-1)
            previous.extend(range(start, start + len(data) - 1))
        rank, index, active = self.rank, {}, []
        for i, j in enumerate(following):
            if j >= 0 and (r := rank.get((token[i], token[j]))) is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        active = list(index)
        heapq.heapify(active)

        def add(i: int, j: int) -> None:
            if (r := rank.get((token[i], token[j]))) is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
                    heapq.heappush(active, r)

        while active:
            r = heapq.heappop(active)
            a, b, ab = self.merged[r]
            for i in sorted(index.pop(r)):
                j = following[i]
                if token[i] != a or j < 0 or token[j] != b:
                    continue  # an earlier merge took part of the pair
                token[i], token[j] = ab, -1
                k = following[i] = following[j]
                if k >= 0:
                    previous[k] = i
                    add(i, k)
                if (p := previous[i]) >= 0:
                    add(p, i)
        out = []
        for h in heads:
            ids = []
            while h >= 0:
                ids.append(token[h])
                h = following[h]
            out.append(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        split = [self.split.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = list({w for words in split for w in words if w not in self.known})
        for k in range(0, len(new), AT_ONCE):
            self.known.update(zip(new[k : k + AT_ONCE], self.merge_words(new[k : k + AT_ONCE])))
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]


@lru_cache(maxsize=4)
def pair_index(path: str) -> PairIndex:
    """One index a worker and vocabulary."""
    return PairIndex(path)


def _here(path: str | None) -> str:
    """Place of the vocabulary on the machine of a task: that of the installed tokenizers, a path that it can open, or a file sent by addFile."""
    if path is None:
        return vocabulary_path()
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def _encoder(path: str | None, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pair_index(_here(path))
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = index.encode(part.column(part.num_columns - 1).to_pylist())
                last = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                names = part.schema.names[:-1] + ["tokens" if count_only else "ids"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], last], names=names)

    return run


def encode_texts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): token ids of each row's text, without special tokens.

    One row a row; an empty list for empty and null texts; repeated rows stay repeated; a word of any length is merged
    as a whole; an empty table gives no rows; other columns are ignored.
    """
    ship(documents.sparkSession)
    rows = documents.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(_encoder(path, False), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The kept columns and ``tokens``, the number of token ids of text."""
    ship(documents.sparkSession)
    rows = documents.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_encoder(path, True), f"{schema}, tokens bigint")
