"""Table functions for SQL: one text in, several rows out, joined to their row with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class TextWindows:
    """Windows of ``size`` characters, each ``overlap`` characters before the end of the last; a null or empty text has none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        if size <= overlap or overlap < 0:
            raise ValueError("windows must be longer than their overlap")
        k = start = 0
        while text and (k == 0 or start + overlap < len(text)):
            yield k, start, text[start : start + size]
            k, start = k + 1, start + size - overlap


def register(spark: SparkSession) -> None:
    """Makes text_windows(text, size, overlap) -> (k, start, piece) known to the session's SQL. Rows travel in Arrow batches."""
    spark.udtf.register("text_windows", udtf(TextWindows, returnType="k int, start int, piece string", useArrow=True))
