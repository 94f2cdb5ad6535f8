"""Metadata APIs as Spark data sources: one page of a query a partition, with retries.

    spark.dataSource.register(ApiSource)
    spark.read.format("paper_api").option("url", ".../works?search=x&per-page=50&page={page}").option("pages", 4).load()

Rows are (page, body): responses as they came, for ``from_json`` with the schema of the API.
Pages are read by executors, so a lost one is read again by Spark.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers that are worth another try.
BUSY = (429, 500, 502, 503, 504)
#: Pages that the APIs give of one query.
MOST_PAGES = 100


def asked_wait(said: str | None, otherwise: float, now: float | None = None) -> float:
    """Seconds of a Retry-After: a number or a date; ``otherwise`` where it is neither."""
    if said and said.strip().isdigit():
        return float(said)
    try:
        return max(0.0, parsedate_to_datetime(said or "").timestamp() - (time.time() if now is None else now))
    except ValueError:
        return otherwise


def fetch(url: str, *, tries: int = 6, wait: float = 10.0, longest: float = 60.0, opener=urlopen, sleep=time.sleep) -> str:
    """A body; waits as the server says (Retry-After), else twice as long each time."""
    for n in range(tries):
        try:
            with opener(Request(url, headers={"User-Agent": "papyra"}), timeout=60) as answer:
                return answer.read().decode("utf-8", "replace")
        except OSError as e:
            code = getattr(e, "code", None)
            if n + 1 == tries or (code is not None and code not in BUSY):
                raise
            said = getattr(e, "headers", None) and e.headers.get("Retry-After")
            sleep(min(longest, asked_wait(said, wait * 2**n)))
    raise ValueError("tries must be at least 1")


class ApiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paper_api"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return ApiReader(self.options)


class ApiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.pages = options["url"], int(options.get("pages", 1))
        if not 1 <= self.pages <= MOST_PAGES:
            raise ValueError(f"pages must be from 1 to {MOST_PAGES}, not {self.pages}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.value, fetch(self.url.format(page=partition.value))


def arxiv_query(words: str) -> str:
    """A search of all fields, unless the query names its fields."""
    return words if ":" in words else f"all:{words}"
