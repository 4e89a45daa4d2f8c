"""Counters, timers and progress of a run on the driver; what tables hold is counted by ``operators.mapping.run_stats``."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def ratio(a: float, b: float) -> float:
    """a / b; a positive number over 0 is infinite, and 0 over 0 is not a number."""
    return a / b if b else math.nan if not a else math.copysign(math.inf, a)


class Counters:
    """Named whole numbers; asking for a name that was never counted is an error."""

    def __init__(self, **given: int):
        self._n = dict(given)

    def inc(self, name: str, by: int = 1) -> None:
        self._n[name] = self._n.get(name, 0) + by

    def count(self, name: str) -> int:
        return self._n[name]

    def frac(self, name: str, whole: str) -> float:
        return ratio(self._n[name], self._n[whole])

    def perc(self, name: str, whole: str) -> float:
        return 100 * self.frac(name, whole)

    def __add__(self, other: Counters) -> Counters:
        return Counters(**{k: self._n.get(k, 0) + other._n.get(k, 0) for k in (*self._n, *(k for k in other._n if k not in self._n))})

    def items(self):
        return self._n.items()


class Timers:
    """Named stop watches: seconds in all, and the longest over the shortest of the times they ran."""

    def __init__(self):
        self._since: dict[str, float] = {}
        self._spans: dict[str, tuple[float, float, float]] = {}  # sum, shortest, longest

    def start(self, name: str) -> None:
        if name in self._since:
            raise ValueError(f"timer {name} is running")
        self._since[name] = time.perf_counter()

    def stop(self, name: str) -> None:
        if name not in self._since:
            raise ValueError(f"timer {name} isn't running")
        self.add(name, time.perf_counter() - self._since.pop(name))

    @contextmanager
    def of(self, name: str) -> Iterator[None]:
        self.start(name)
        try:
            yield
        finally:
            self.stop(name)

    def add(self, name: str, seconds: float) -> None:
        total, low, high = self._spans.get(name, (0.0, math.inf, 0.0))
        self._spans[name] = total + seconds, min(low, seconds), max(high, seconds)

    def secs(self, name: str) -> float:
        return self._spans[name][0]

    def range_ratio(self, name: str) -> float:
        return ratio(self._spans[name][2], self._spans[name][1])

    def perc(self, name: str, whole: str) -> float:
        return 100 * ratio(self.secs(name), self.secs(whole))

    def __add__(self, other: Timers) -> Timers:
        out = Timers()
        for name in (*self._spans, *(k for k in other._spans if k not in self._spans)):
            a, b = (t._spans.get(name, (0.0, math.inf, 0.0)) for t in (self, other))
            out._spans[name] = a[0] + b[0], min(a[1], b[1]), max(a[2], b[2])
        return out

    def seconds(self) -> dict[str, float]:
        return {k: v[0] for k, v in self._spans.items()}

    def breakdown(self, whole: str) -> list[tuple[str, float, float, float]]:
        """(name, seconds, percentage of ``whole``, longest over shortest) of each watch, in the order of first use."""
        return [(k, self.secs(k), self.perc(k, whole), self.range_ratio(k)) for k in self._spans]


def memory_mb() -> dict[str, float]:
    """This process' virtual and resident memory."""
    with open("/proc/self/status", encoding="ascii", errors="replace") as f:
        found = dict(line.split(":", 1) for line in f if ":" in line)
    return {k: int(found[k].split()[0]) / 1024 for k in ("VmSize", "VmRSS") if k in found}


def progress(spark: SparkSession) -> float:
    """The share of the active stages' tasks that have ended; 1 without any."""
    tracker = spark.sparkContext.statusTracker()
    infos = [i for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i]
    return ratio(sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)) if infos else 1.0


def progress_bar(share: float, title: str = "", width: int = 60) -> str:
    """A line that overwrites itself on a terminal."""
    done = min(width, max(0, round(share * width)))
    return f"\r{title} [{'=' * done}{' ' * (width - done)}] {100 * share:.0f}%"
