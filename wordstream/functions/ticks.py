"""Tick arithmetic: hit and trigger times as exact BIGINT ticks of 100 ns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data: ticks in a second, bits of a raw timestamp, seconds a receipt counter can span.
R = 10_000_000
RAW_LIMIT = 1 << 31
RECEIPT_LIMIT = 32 * R


def hit_time(timestamp: Column, receipt: Column, second: Column) -> Column:
    """Hit time in ticks since the Unix epoch; null if a part is null, out of its range, or the product overflows."""
    raw, rec, sec = (c.cast("bigint") for c in (timestamp, receipt, second))
    base = F.try_multiply(sec - div(rec, R), F.lit(R).cast("bigint"))
    known = raw.between(0, RAW_LIMIT - 1) & rec.between(0, RECEIPT_LIMIT - 1) & (sec > 0)
    return F.when(known, F.when(raw <= rec, F.try_add(base, raw)).otherwise(F.try_subtract(F.try_add(base, raw % R), F.lit(R))))


def trigger_time(aux: Column, second: Column) -> Column:
    """Time of a T word in ticks; null if the header second is not positive or the counter is out of range."""
    a, s = aux.cast("bigint"), second.cast("bigint")
    return F.when((s > 0) & a.between(0, RECEIPT_LIMIT - 1), F.try_add(F.try_multiply(s, F.lit(R).cast("bigint")), a % R))


def div(a: Column, b: int) -> Column:
    """Integer quotient of BIGINT ticks, rounded toward minus infinity."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b).cast("bigint"))


#: The same rules in DuckDB's dialect, for the oracles.
HIT_TIME_SQL = """CASE WHEN "timestamp" BETWEEN 0 AND 2147483647 AND receipt_timestamp BETWEEN 0 AND 319999999 AND message_seconds > 0
 THEN CASE WHEN "timestamp" <= receipt_timestamp THEN (message_seconds - receipt_timestamp // 10000000) * 10000000 + "timestamp"
 ELSE (message_seconds - receipt_timestamp // 10000000 - 1) * 10000000 + "timestamp" % 10000000 END END"""
TRIGGER_TIME_SQL = "CASE WHEN header_second > 0 AND aux BETWEEN 0 AND 319999999 THEN header_second * 10000000 + aux % 10000000 END"
