"""The word stream: all words of all sources in wire order, from the tables or from binary frames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import HEADER, WORD, field, le_hex, le_number, odd_parity, pack_damaged, pack_payload
from ..session import ship

#: Most words of a frame, and word kinds that are known; fixed values of the format.
MOST_WORDS, KINDS = 65535, "DTSPWRE"
WORDS = "iog int, seq bigint, word_idx int, header_second bigint, kind string, io int, receipt bigint, aux bigint, payload bigint"


def word_stream(hits: DataFrame, words: DataFrame, distinct: bool = True, fitting: bool = True) -> DataFrame:
    """D words from hits and all others from words, repeated rows once; hits whose times do not fit a word are left out.

    Without ``distinct`` repeated rows stay, for operators that drop them after their own shuffle; without ``fitting`` all hits.
    """
    d = hits.select("iog", "seq", "word_idx", F.lit("D").alias("kind"), F.col("io_channel").alias("io"), F.col("message_seconds").alias("header_second"), F.col("receipt_timestamp").alias("receipt"), F.lit(None).cast("bigint").alias("aux"), F.col("timestamp").alias("raw"), "chip", "channel", "adc")
    if fitting:
        d = d.where("raw BETWEEN 0 AND 2147483647 AND receipt BETWEEN 0 AND 4294967295")
    none = F.lit(None).cast("int")
    o = words.select("iog", "seq", "word_idx", "kind", "io", "header_second", F.lit(None).cast("bigint").alias("receipt"), "aux", F.lit(None).cast("bigint").alias("raw"), none.alias("chip"), none.alias("channel"), none.alias("adc"))
    rows = d.unionByName(o)
    return rows.dropDuplicates() if distinct else rows


def encode_frames(stream: DataFrame) -> DataFrame:
    """Binary frames (iog, seq, value) of a word stream, in the order of word_idx; every word is kept, a faulty one as the fault it would be on the wire.

    A data word with a missing field has another packet type, one with a value outside of its bits a bad parity, one of a
    frame second 0 the direction bit. A frame with a receipt that does not fit is cut short by a byte, and one without
    any second is no data frame. Other values are cut to their bits, nulls are 0.
    """
    top = (1 << 32) - 1
    is_d = F.col("kind") == "D"
    parts = [F.col(c) for c in ("chip", "channel", "raw", "adc")]
    missing = reduce(lambda a, b: a | b, (c.isNull() for c in parts))
    good = pack_payload(*parts).isNotNull()
    pay = pack_damaged(*parts, F.when(missing, 1 + F.pmod(F.col("word_idx"), F.lit(3))).otherwise(0), F.coalesce(F.col("header_second") == 0, F.lit(False)).cast("int"), good | missing)
    low = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).bitwiseAND(F.lit(top).cast("bigint"))
    letter = F.when((F.length("kind") == 1) & (F.ascii("kind") < 128), F.col("kind")).otherwise("?")
    data = F.concat(F.hex(letter), le_hex(low("io").bitwiseAND(F.lit(255).cast("bigint")), 1), F.when(is_d, F.concat(le_hex(low("receipt"), 4), F.lit("0000"))).otherwise(F.concat(F.lit("0000"), le_hex(low("aux"), 4))), le_hex(F.when(is_d, pay).otherwise(F.lit(0).cast("bigint")), 8))
    short = is_d & ~F.coalesce(F.col("receipt").between(0, top), F.lit(False))
    body = stream.select("iog", "seq", "word_idx", "header_second", data.alias("data"), short.alias("short"))
    frames = body.groupBy("iog", "seq").agg(F.max("header_second").alias("s"), F.array_sort(F.collect_list(F.struct("word_idx", "data"))).alias("w"), F.bool_or("short").alias("short"))
    second = F.when(F.col("s").between(0, top), F.col("s")).otherwise(F.lit(0))
    head = F.concat(F.when(F.col("s").isNull(), "21").otherwise("44"), le_hex(second, 4), F.lit("00"), le_hex(F.size("w"), 2))
    text = F.concat(head, F.array_join(F.transform("w", lambda x: x["data"]), ""))
    return frames.select("iog", "seq", F.unhex(F.when(F.col("short"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)).alias("value"))


def reject_reason(value: Column) -> Column:
    """Why a frame is malformed, or null: not given, length, kind, or word count against length."""
    n = F.octet_length(value)
    kind = F.hex(F.substring(value, 1, 1))
    return (
        F.when(value.isNull(), "missing").when((n < HEADER) | (n > HEADER + MOST_WORDS * WORD), "length")
        .when(~kind.isin("44", "3F", "21"), "kind").when(n != HEADER + WORD * le_number(value, 6, 2), "word count")
    )


def parse_frames(frames: DataFrame, strict: bool = False) -> DataFrame:
    """Header fields of frames: kind, header_second, n_words, reject (null if well formed), sample (first bytes of a reject).

    ``strict`` raises an error on a malformed frame instead.
    """
    v = F.col("value")
    reason = reject_reason(v)
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("malformed frame: "), reason))).otherwise(F.lit(None).cast("string"))
    ok = reason.isNull()
    return frames.select("iog", "seq", "value", F.when(ok, F.decode(F.substring(v, 1, 1), "US-ASCII")).alias("kind"), F.when(ok, le_number(v, 1, 4)).alias("header_second"), F.when(ok, le_number(v, 6, 2)).cast("int").alias("n_words"), reason.alias("reject"), F.when(~ok, F.hex(F.substring(v, 1, 32))).alias("sample"))


def explode_words(parsed: DataFrame) -> DataFrame:
    """Word table of the well-formed data frames, in column expressions."""
    rows = parsed.where("reject IS NULL AND kind = 'D' AND n_words > 0").select("iog", "seq", "header_second", "value", F.explode(F.sequence(F.lit(0), F.col("n_words") - 1)).alias("word_idx"))
    w = F.expr(f"substring(value, {HEADER + 1} + word_idx * {WORD}, {WORD})")
    cut = rows.select("iog", "seq", "word_idx", "header_second", w.alias("w"))
    return cut.select("iog", "seq", "word_idx", "header_second", F.decode(F.substring("w", 1, 1), "ISO-8859-1").alias("kind"), le_number(F.col("w"), 1, 1).cast("int").alias("io"), le_number(F.col("w"), 2, 4).alias("receipt"), le_number(F.col("w"), 4, 4).alias("aux"), le_number(F.col("w"), 8, 8).alias("payload"))


def decode_frames(frames: DataFrame) -> DataFrame:
    """The same word table from binary frames in one vectorised pass over Arrow batches; malformed frames are left out."""
    ship(frames.sparkSession)
    letters = np.array([chr(i) for i in range(256)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = pc.fill_null(b.column(2), b"").cast(pa.binary())
            if not len(value):
                continue
            ends = np.frombuffer(value.buffers()[1], np.int32)[value.offset : value.offset + len(value) + 1].astype(np.int64)
            data = np.frombuffer(value.buffers()[2] or b"", np.uint8)
            start, size = ends[:-1], np.diff(ends)
            k = np.flatnonzero((size >= HEADER) & (size <= HEADER + MOST_WORDS * WORD))
            at = start[k]
            number = lambda p, n: sum(data[p + j].astype(np.int64) << 8 * j for j in range(n))
            n = number(at + 6, 2)
            good = (data[at] == 68) & (n > 0) & (size[k] == HEADER + WORD * n)
            k, at, n = k[good], at[good], n[good]
            if not len(k):
                continue
            idx = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = data[(np.repeat(at + HEADER, n) + WORD * idx)[:, None] + np.arange(WORD)]
            field = lambda p: np.ascontiguousarray(w[:, p : p + 4]).view("<u4")[:, 0].astype(np.int64)
            frame = pa.array(np.repeat(k, n))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(frame).cast(pa.int32()), b.column(1).take(frame).cast(pa.int64()), pa.array(idx, pa.int32()), pa.array(np.repeat(number(at + 1, 4), n), pa.int64()), pa.array(letters[w[:, 0]], pa.string()),
                    pa.array(w[:, 1], pa.int32()), pa.array(field(2), pa.int64()), pa.array(field(4), pa.int64()), pa.array(np.ascontiguousarray(w[:, 8:]).view("<i8")[:, 0], pa.int64()),
                ],
                names=[x.split()[0] for x in WORDS.split(", ")],
            )

    return frames.select("iog", "seq", "value").mapInArrow(run, WORDS)


def decode_hits(words: DataFrame) -> DataFrame:
    """Accepted hits of a word table: D words of packet type 0 with odd parity; the direction bit is no cut."""
    p = F.col("payload")
    rows = words.where((F.col("kind") == "D") & (field(p, "ptype") == 0) & odd_parity(p))
    return rows.select("iog", "seq", "word_idx", F.col("io").alias("io_channel"), *(field(p, n).cast("int").alias(n) for n in ("chip", "channel", "adc")), field(p, "timestamp").alias("timestamp"), F.col("receipt").alias("receipt_timestamp"), F.col("header_second").alias("message_seconds"))


def decode_counters(words: DataFrame, parsed: DataFrame) -> DataFrame:
    """Decode counters of each iog over its words and frames."""
    p, is_d = F.col("payload"), F.col("kind") == "D"
    zero = is_d & (field(p, "ptype") == 0)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    by_word = words.groupBy("iog").agg(
        F.count(F.lit(1)).alias("words"), count(is_d).alias("data_words"), count(zero).alias("data_hits"), count(zero & odd_parity(p)).alias("valid_data_hits"), count(zero & ~odd_parity(p)).alias("bad_parity"),
        count(zero & (field(p, "downstream") == 1)).alias("downstream"), count(zero & (field(p, "downstream") == 0)).alias("upstream"), count(is_d & (field(p, "ptype") != 0)).alias("other_packets"),
        *(count(is_d & (field(p, "ptype") == k)).alias(f"packet_type_{k}") for k in range(4)),
        count(F.col("kind") == "T").alias("triggers"), count(F.col("kind") == "S").alias("sync"), count((F.col("kind") == "S") & (F.col("io") == 83)).alias("sync83_packets"), count(~F.col("kind").isin(*KINDS)).alias("unknown_words"),
    )
    by_frame = parsed.groupBy("iog").agg(F.count(F.lit(1)).alias("frames"), F.count("reject").alias("malformed"), count(F.col("kind").isin("?", "!")).alias("nondata_messages"), count(F.col("kind").isin("?", "!")).alias("legacy_messages"))
    joined = by_frame.join(by_word, "iog", "left")
    return joined.fillna(0)
