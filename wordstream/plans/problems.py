"""Queries of the general data problems over the detector tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.ticks import HIT_TIME_SQL
from ..operators import faults, grid, heavy, late
from ..sources.tables import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": lambda s, d: late.late_events(table(s, d, "hits")),
        "p2_seconds": lambda s, d: late.late_periods(table(s, d, "hits")),
        "p3_found": lambda s, d: heavy.heavy_addresses(table(s, d, "hits")),
        "p3_addresses": lambda s, d: heavy.address_latest(table(s, d, "hits")),
        "p4_found": lambda s, d: grid.grid_gaps(table(s, d, "tile_rates")),
        "p4_grid": lambda s, d: grid.regular_grid(table(s, d, "tile_rates")),
        "p5_found": lambda s, d: faults.faulty_hits(table(s, d, "hits")),
    }


_ARRIVALS = f"""
WITH h AS (SELECT *, {HIT_TIME_SQL} AS t FROM (SELECT DISTINCT * FROM hits)),
a AS (SELECT iog, seq, word_idx, adc, t // 10000000 AS sec,
  max(CASE WHEN message_seconds > 0 THEN message_seconds ELSE 0 END) OVER (PARTITION BY iog ORDER BY seq RANGE UNBOUNDED PRECEDING) AS arrival FROM h),
l AS (SELECT *, arrival - sec AS late FROM a WHERE sec IS NOT NULL)
"""

_ADDRESS_GRAINS = [("channel", "iog, -1, chip, channel", "chip IS NOT NULL AND channel IS NOT NULL", 10), ("chip", "iog, -1, chip, -1", "chip IS NOT NULL", 36), ("io_channel", "iog, io_channel, -1, -1", "io_channel IS NOT NULL", 66)]


def _grains(source: str, extra: str) -> str:
    names = ("iog", "io_channel", "chip", "channel")
    one = lambda g, cols, given: f"SELECT '{g}' AS grain, " + ", ".join(f"{c.strip()} AS {n}" for c, n in zip(cols.split(","), names)) + f"{extra} FROM {source} WHERE iog IS NOT NULL AND {given}"
    return " UNION ALL ".join(one(g, cols, given) for g, cols, given, _ in _ADDRESS_GRAINS)


_CELLS = """
WITH r AS (SELECT DISTINCT boot_id, iog, tile, seq, begin_monotonic AS b, end_monotonic AS e, mapped_packets_per_s AS rate FROM tile_rates
  WHERE begin_monotonic IS NOT NULL AND end_monotonic IS NOT NULL AND end_monotonic > begin_monotonic),
x AS (SELECT boot_id, iog, tile, b, e, rate, unnest(range(CAST(floor(b / 0.5) AS BIGINT), CAST(ceil(e / 0.5) AS BIGINT))) AS cell FROM r),
c AS (SELECT boot_id, iog, tile, cell, count(*) AS readings,
  sum(CASE WHEN NOT isnan(rate) THEN least(e, (cell + 1) * 0.5::DOUBLE) - greatest(b, cell * 0.5::DOUBLE) END) AS seconds,
  sum(CASE WHEN NOT isnan(rate) THEN rate * (least(e, (cell + 1) * 0.5::DOUBLE) - greatest(b, cell * 0.5::DOUBLE)) END) AS amount FROM x GROUP BY ALL),
v AS (SELECT boot_id, iog, tile, min(cell) AS lo, max(cell) AS hi FROM c GROUP BY boot_id, iog, tile),
g AS (SELECT boot_id, iog, tile, unnest(range(lo, hi + 1)) AS cell FROM v),
j AS (SELECT g.boot_id, g.iog, g.tile, g.cell, coalesce(c.readings, 0) AS readings, CASE WHEN seconds > 0 THEN round(amount / seconds, 6) END AS own
  FROM g LEFT JOIN c ON g.boot_id = c.boot_id AND g.iog = c.iog AND g.tile = c.tile AND g.cell = c.cell)
"""

_FAULTS = f"""
WITH h AS (SELECT *, {HIT_TIME_SQL} AS t FROM (SELECT DISTINCT * FROM hits)),
bad AS (SELECT iog, seq, word_idx FROM h WHERE adc NOT BETWEEN 0 AND 255 OR "timestamp" NOT BETWEEN 0 AND 2147483647 OR channel NOT BETWEEN 0 AND 63),
s AS (SELECT * FROM h WHERE iog IS NOT NULL AND chip IS NOT NULL AND channel BETWEEN 0 AND 63 AND adc BETWEEN 0 AND 255),
m AS (SELECT iog, chip, channel, count(*) AS n, median(adc) AS mid FROM s GROUP BY ALL),
d AS (SELECT iog, chip, channel, n, mid, median(abs(adc - mid)) AS dev FROM s JOIN m USING (iog, chip, channel) GROUP BY ALL),
o AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY iog, chip, channel, adc ORDER BY t, seq, word_idx) AS isle FROM s WHERE t IS NOT NULL WINDOW w AS (PARTITION BY iog, chip, channel ORDER BY t, seq, word_idx)),
stuck AS (SELECT iog, seq, word_idx FROM (SELECT *, count(*) OVER (PARTITION BY iog, chip, channel, adc, isle) AS len FROM o) WHERE len >= 20),
spike AS (SELECT s.iog, s.seq, s.word_idx FROM s JOIN d USING (iog, chip, channel) WHERE d.n >= 100 AND abs(s.adc - d.mid) > 12 * d.dev)
SELECT iog, seq, word_idx, 'impossible' AS fault FROM bad
UNION ALL SELECT iog, seq, word_idx, 'stuck' FROM stuck ANTI JOIN bad USING (iog, seq, word_idx)
UNION ALL SELECT iog, seq, word_idx, 'spike' FROM spike ANTI JOIN bad USING (iog, seq, word_idx) ANTI JOIN stuck USING (iog, seq, word_idx)
"""


def oracle_sql() -> dict[str, str]:
    share = " ".join(f"WHEN '{g}' THEN {v}" for g, _, _, v in _ADDRESS_GRAINS)
    return {
        "p2_found": _ARRIVALS + "SELECT iog, seq, word_idx, CASE WHEN late <= 3 THEN 'late' ELSE 'too_late' END AS outcome FROM l WHERE late >= 1",
        "p2_seconds": _ARRIVALS + """SELECT iog, sec AS second, count(*) FILTER (late <= 3) AS hits,
 CAST(sum(adc) FILTER (late <= 3) AS DOUBLE) / nullif(count(adc) FILTER (late <= 3), 0) AS mean_adc,
 count(*) FILTER (late BETWEEN 1 AND 3) AS late_hits, count(*) FILTER (late > 3) AS too_late_hits FROM l GROUP BY iog, sec HAVING count(*) FILTER (late <= 3) > 0""",
        "p3_found": f"""WITH g AS ({_grains("hits", "")}), n AS (SELECT grain, iog, io_channel, chip, channel, count(*) AS c FROM g GROUP BY ALL)
SELECT grain, iog, io_channel, chip, channel FROM n WHERE c * 1000 >= (SELECT count(*) FROM hits) * CASE grain {share} END""",
        "p3_addresses": f"""WITH h AS (SELECT *, {HIT_TIME_SQL} AS t FROM (SELECT DISTINCT * FROM hits)), g AS ({_grains("h", ", t")})
SELECT grain, iog, io_channel, chip, channel, count(*) AS hits, max(t) AS latest_hit FROM g GROUP BY ALL""",
        "p4_found": _CELLS + "SELECT boot_id, iog, tile, cell FROM j WHERE readings = 0",
        "p4_grid": _CELLS + """, f AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY boot_id, iog, tile ORDER BY cell ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rate FROM j)
SELECT boot_id, iog, tile, cell, readings, rate, CASE WHEN own IS NOT NULL THEN 'observed' WHEN rate IS NOT NULL THEN 'carried' ELSE 'missing' END AS mark FROM f""",
        "p5_found": _FAULTS,
    }
