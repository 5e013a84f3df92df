"""Queries of this subpackage over the given tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ticks import HIT_TIME_SQL, TRIGGER_TIME_SQL
from ..sources.tables import table
from . import bpe, mixing, nearest, percentiles, sentences

SOURCE = ["iog", "chip", "channel"]
#: Parts that the entries of a range are spread over, each of which proposes a local median.
BUCKETS = 4


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    """Values of adc in 0..255 with their address, repeated rows once."""
    rows = table(spark, folder, "hits").where("adc BETWEEN 0 AND 255 AND iog IS NOT NULL AND chip IS NOT NULL")
    return rows.select("iog", "seq", "word_idx", "chip", "channel", "adc").dropDuplicates()


def source_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of adc for every source of measurement."""
    state = percentiles.value_state(_readings(spark, folder).where("channel BETWEEN 0 AND 63"), SOURCE, "adc")
    return percentiles.percentiles(state, SOURCE, buckets=BUCKETS)


def chip_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of adc for every (iog, chip), from the combined states of its channels."""
    state = percentiles.value_state(_readings(spark, folder), SOURCE, "adc")
    return percentiles.percentiles(percentiles.combine([state], ["iog", "chip"]), ["iog", "chip"], buckets=BUCKETS)


def combined_percentiles(spark: SparkSession, folder: str, parts: int = 50) -> DataFrame:
    """Percentiles of adc for every iog from summaries of its single chips; ranks are off by at most n / parts."""
    state = percentiles.combine([percentiles.value_state(_readings(spark, folder), SOURCE, "adc")], ["iog", "chip"])
    summary = percentiles.summarize(state, ["iog", "chip"], parts, BUCKETS)
    return percentiles.percentiles(percentiles.combine([summary], ["iog"]), ["iog"], buckets=BUCKETS).withColumn("rank_error", F.call_function("div", F.col("n"), F.lit(parts).cast("bigint")))


def nearest_matches(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest_triggers(table(spark, folder, "hits"), table(spark, folder, "words"), table(spark, folder, "observer_config")).drop("distance")


def nearest_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every hit with a time, with its trigger or nulls."""
    return nearest.nearest_triggers(table(spark, folder, "hits"), table(spark, folder, "words"), table(spark, folder, "observer_config"), unmatched=True)


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(table(spark, folder, "documents"))


def mixed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(*(table(spark, folder, t) for t in ("documents", "mixes", "mix_targets")))


def mixed_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_shares(*(table(spark, folder, t) for t in ("documents", "mixes", "mix_targets")))


def sentence_units(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_source_percentiles": source_percentiles,
        "p1_chip_percentiles": chip_percentiles,
        "p1_combined_percentiles": combined_percentiles,
        "p6_found": nearest_matches,
        "p6_nearest": nearest_all,
        "p7_ids": token_ids,
        "p8_mix": mixed_documents,
        "p8_shares": mixed_shares,
        "p9_found": sentence_units,
    }


def _percentiles_sql(state: str, keys: str) -> str:
    """Percentiles of a state (keys, value, weight): the least value whose cumulated weight reaches the rank."""
    cols = ", ".join(f"min(value) FILTER (up * 100 >= n * {p}) AS p{p:02d}" for p in percentiles.PERCENTS)
    return f"""c AS (SELECT *, sum(weight) OVER (PARTITION BY {keys} ORDER BY value) AS up, sum(weight) OVER (PARTITION BY {keys}) AS n FROM {state})
SELECT {keys}, CAST(n AS BIGINT) AS n, {cols} FROM c GROUP BY {keys}, n"""


_READINGS = "r AS (SELECT DISTINCT iog, seq, word_idx, chip, channel, adc FROM hits WHERE adc BETWEEN 0 AND 255 AND iog IS NOT NULL AND chip IS NOT NULL)"

_NEAREST = f"""
WITH h AS (SELECT iog, seq, word_idx, {HIT_TIME_SQL} AS t FROM (SELECT DISTINCT * FROM hits)),
k AS (SELECT iog, seq, word_idx, {TRIGGER_TIME_SQL} AS t FROM (SELECT DISTINCT * FROM words) WHERE kind = 'T'),
one AS (SELECT iog, t, min(struct_pack(seq := seq, word_idx := word_idx)) AS w FROM k WHERE t IS NOT NULL GROUP BY iog, t),
b AS (SELECT h.*, one.t AS bt, one.w AS bw FROM h ASOF LEFT JOIN one ON h.iog = one.iog AND h.t >= one.t WHERE h.t IS NOT NULL),
a AS (SELECT b.*, one.t AS nt, one.w AS nw FROM b ASOF LEFT JOIN one ON b.iog = one.iog AND b.t <= one.t),
d AS (SELECT a.*, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN t - bt ELSE nt - t END AS d, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bw ELSE nw END AS w FROM a),
m AS (SELECT d.iog, d.seq, d.word_idx, CASE WHEN d.d <= c.post_us * 10 THEN d.w END AS w, CASE WHEN d.d <= c.post_us * 10 THEN d.d END AS distance FROM d LEFT JOIN observer_config c ON d.iog = c.iog)
"""


def oracle_sql() -> dict[str, str]:
    ranks = "SELECT iog, chip, n, (n * k + 49) // 50 AS rank, max((n * k + 49) // 50) OVER (PARTITION BY iog, chip ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT iog, chip, count(*) AS n FROM r GROUP BY iog, chip) t, range(1, 51) x(k)"
    return {
        "p1_source_percentiles": f"WITH {_READINGS}, s AS (SELECT iog, chip, channel, adc AS value, count(*) AS weight FROM r WHERE channel BETWEEN 0 AND 63 GROUP BY ALL), " + _percentiles_sql("s", "iog, chip, channel"),
        "p1_chip_percentiles": f"WITH {_READINGS}, s AS (SELECT iog, chip, adc AS value, count(*) AS weight FROM r GROUP BY ALL), " + _percentiles_sql("s", "iog, chip"),
        "p1_combined_percentiles": f"""WITH {_READINGS}, v AS (SELECT iog, chip, adc, sum(count(*)) OVER (PARTITION BY iog, chip ORDER BY adc) AS up FROM r GROUP BY iog, chip, adc),
k AS ({ranks}), w AS (SELECT k.iog, k.chip, k.rank - coalesce(k.prev, 0) AS weight, (SELECT min(adc) FROM v WHERE v.iog = k.iog AND v.chip = k.chip AND v.up >= k.rank) AS value FROM k),
s AS (SELECT iog, value, sum(weight) AS weight FROM w WHERE weight > 0 GROUP BY iog, value), z AS (""" + "WITH " + _percentiles_sql("s", "iog") + ") SELECT *, n // 50 AS rank_error FROM z",
        "p6_found": _NEAREST + "SELECT iog, seq, word_idx, w.seq AS trigger_seq, w.word_idx AS trigger_word_idx FROM m WHERE w IS NOT NULL",
        "p6_nearest": _NEAREST + "SELECT iog, seq, word_idx, w.seq AS trigger_seq, w.word_idx AS trigger_word_idx, distance FROM m",
    }
