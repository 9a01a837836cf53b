"""Table functions: what walks an ordered partition once and gives rows on the way, to be called from SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


class ExplodeWindows:
    """Windows of width rows every stride rows of an ordered partition, with the mean of a column in each.

    SELECT * FROM explode_windows(TABLE(t) PARTITION BY k ORDER BY pos, key => 'k', value => 'v', width => 20, stride => 10).  A tail that no
    window covers gets one of its own (kind trailing) if it has at least least_tail rows; without least_tail it is dropped.  At a
    time the rows of one window are held.  A mean leaves nulls out, and is null where there is nothing else.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument, width: AnalyzeArgument, stride: AnalyzeArgument, least_tail: AnalyzeArgument | None = None) -> AnalyzeResult:
        own = next(f for f in rows.dataType.fields if f.name == key.value)
        fields = [StructField("window_index", LongType()), StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType()), StructField("mean", DoubleType())]
        return AnalyzeResult(schema=StructType([StructField(own.name, own.dataType), *fields]))

    def __init__(self) -> None:
        self.held: list[float | None] = []
        self.first = self.seen = self.index = self.covered = 0
        self.key: object = None
        self.tail: int | None = None

    def eval(self, row: Row, key: str, value: str, width: int, stride: int, least_tail: int | None = None) -> Iterator[tuple]:
        self.key, self.tail = row[key], least_tail
        if self.seen >= self.first:  # rows between windows, where the stride is wider, are not held
            self.held.append(None if row[value] is None else float(row[value]))
        self.seen += 1
        if self.seen == self.first + width:
            yield self._row(self.held, self.first, self.seen, "full")
            self.covered, self.first, self.index = self.seen, self.first + stride, self.index + 1
            self.held = self.held[stride:]

    def terminate(self) -> Iterator[tuple]:
        left = self.seen - self.covered
        if self.tail is not None and self.index and left >= max(1, self.tail) and self.first <= self.covered:
            yield self._row(self.held[self.covered - self.first :], self.covered, self.seen, "trailing")

    def _row(self, values: list[float | None], start: int, end: int, kind: str) -> tuple:
        some = [v for v in values if v is not None]
        return self.key, self.index, start, end, kind, sum(some) / len(some) if some else None


def register(spark: SparkSession) -> None:
    """Makes explode_windows known to a session's SQL."""
    spark.udtf.register("explode_windows", udtf(ExplodeWindows, useArrow=False))
