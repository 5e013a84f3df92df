"""Settings with their ranges and defaults; from spark.conf keys of the same names under ``wordstream.``."""

from __future__ import annotations

from dataclasses import dataclass, fields
from math import isfinite

from pyspark.sql import SparkSession


def _check(name: str, value: float, low: float, high: float, whole: bool = False) -> None:
    if isinstance(value, bool) or not isfinite(value) or not low <= value <= high or (whole and value != int(value)):
        raise ValueError(f"{name} must be {'an integer ' if whole else ''}in {low}..{high}")


@dataclass(frozen=True)
class Timing:
    """Clock and playback of a source; ranges and defaults are fixed values."""

    tick_seconds: float = 1e-7
    period: int = 10_000_000
    sync_type: int = 83
    delay: float = 1.25
    max_pending_hits: int = 500_000
    min_raw: int = 10

    def __post_init__(self) -> None:
        _check("tick_seconds", self.tick_seconds, 1e-12, 1)
        _check("period", self.period, 1, 1 << 31, True)
        _check("sync_type", self.sync_type, 0, 255, True)
        _check("delay", self.delay, 0.05, 10)
        _check("max_pending_hits", self.max_pending_hits, 1, 5_000_000, True)
        _check("min_raw", self.min_raw, 0, 1 << 31, True)

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Timing:
        """Values of spark.conf, defaults elsewhere."""
        kinds = {"tick_seconds": float, "delay": float}
        got = {f.name: spark.conf.get(f"wordstream.{f.name}", None) for f in fields(cls)}
        return cls(**{k: kinds.get(k, int)(v) for k, v in got.items() if v is not None})


@dataclass(frozen=True)
class Windows:
    """Trigger windows; ranges and defaults are fixed values."""

    pre_us: float = 0.0
    post_us: float = 300.0
    history_seconds: float = 2.0
    max_windows: int = 2048
    types: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        _check("pre_us", self.pre_us, 0, 1e5)
        _check("post_us", self.post_us, 1e-9, 1e5)
        _check("history_seconds", self.history_seconds, 0.1, 10)
        _check("max_windows", self.max_windows, 1, 8192, True)
        for t in self.types:
            _check("types", t, 0, 255, True)

    def ticks(self, tick_seconds: float = 1e-7) -> tuple[int, int, int]:
        """Ticks before and after a trigger, and of history; halves round to even, at least one tick after."""
        return round(self.pre_us * 1e-6 / tick_seconds), max(1, round(self.post_us * 1e-6 / tick_seconds)), round(self.history_seconds / tick_seconds)
