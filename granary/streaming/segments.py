"""Segments of speech put together until they span a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.folds import folded


class Group:
    """The open group of one key: where it began, where it ends so far, its segments."""

    def __init__(self, window: float) -> None:
        self.window, self.first, self.last, self.n = window, None, None, 0

    def take(self, start: float, end: float) -> list[tuple]:
        self.first = start if self.n == 0 else self.first
        self.last, self.n = end, self.n + 1
        return self.close() if end - self.first >= self.window else []

    def close(self) -> list[tuple]:
        out = [(self.first, self.last, self.n)] if self.n else []
        self.n = 0
        return out


def grouped(segments: DataFrame, key: str, window: float) -> DataFrame:
    """(key, first, last, n) of segments (key, start, end) in order of start, then end: a group closes once it spans ``window``."""
    return folded(segments, key, [F.col("start"), F.col("end")], ["start", "end"], lambda: Group(window), "first double, last double, n long")
