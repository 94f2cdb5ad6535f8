"""Where queries register themselves, with the SQL that says the same to DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import new_folder
from ..ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bounded(pattern: str) -> str:
    """A pattern for DuckDB, whose word bounds know ASCII only: letters and digits of all scripts make words, as they do for Spark."""
    ahead = re.sub(r"\\b(?=[(a-z])", r"(?:^|[^\\p{L}\\p{N}_])", pattern)
    return ahead.replace("\\b", r"(?:$|[^\p{L}\p{N}_])")


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DERIVED: dict[tuple, object] = {}


def derived(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], object]) -> object:
    """What make(folder) wrote to the shared folder and opened, once for a session and a folder of tables: an index that several queries read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DERIVED:
        _DERIVED[key] = make(new_folder(spark))
    return _DERIVED[key]
