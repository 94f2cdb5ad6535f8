"""A stored inverted index: which field of which unit (a paper, an item of its extraction) has a token, and at which place.

Two tables in one folder, both cut into folders by a hash of the token and sorted by token inside:

    postings: token, n, and lists of key, unit, field, pos     terms: token, df

so that a query reads the folders of its few tokens and, in their files, the row groups that may
hold them; texts aren't read. ``key`` is what document frequencies count (a paper for all of its
units), ``pos`` the place of a token among the field's distinct tokens. A row is what one batch of
texts says of a token, ``n`` the keys that no row before counted, so a shuffle carries a token once
a batch and frequencies are sums. Rows are dealt out by bucket and key when they are written, into
more files the more text there is: a token of every text is split over several files, and a task
sorts a bounded part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import STOPWORDS, TOKEN, plain_tokens, query_tokens
from ..shared import spread
from .linking import small

#: Folders by token; one of them is read for each token of a query. More for larger corpora.
BUCKETS = 16
#: Files of a bucket, at least; characters of texts whose postings one task sorts.
PARTS, SORTED = 4, 16_000_000
#: Postings that are put in lists at once.
BATCH = 500_000

_FOUND = re.compile(TOKEN).findall
_STOP = frozenset(STOPWORDS)


def token_list(text: str | None) -> list[str]:
    """text.tokens() inside a task: search tokens in order, once each."""
    low = (text or "").lower()
    found = dict.fromkeys(_FOUND(low))
    if "-" in low or "_" in low:
        parts: dict[str, None] = {}
        for t in found:
            t = t.replace("_", "-")
            parts[t] = None
            if "-" in t:
                parts.update(dict.fromkeys(t.split("-")))
        found = parts
    return [t for t in found if len(t) > 1 and t not in _STOP]


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _postings(units: DataFrame, single: bool) -> DataFrame:
    """token, n, and lists of key, unit, field, pos (single: of key and pos) of units (key, unit, fields: array of texts), a row for each token of a batch; n: keys that are counted in this row. All units of a key are one task's, unless single."""
    kinds = {c: units.schema[c].dataType for c in (("key",) if single else ("key", "unit"))}
    numbers = ("pos",) if single else ("field", "pos")
    schema = ", ".join(["token string, n long", *(f"{c} array<{k.simpleString()}>" for c, k in kinds.items()), *(f"{c} array<int>" for c in numbers)])
    names = ["token", "n", *kinds, *numbers]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = object(), set()
        for b in batches:
            number: dict[str, int] = {}
            which: list[int] = []
            rows: list[int] = []
            fresh: list[bool] = []
            flat: dict[str, list[int]] = {"field": [], "pos": []}

            def full(b: pa.RecordBatch = b) -> pa.RecordBatch:
                ids = np.array(which, dtype=np.int64)
                order = np.argsort(ids, kind="stable")
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(ids))]).astype(np.int32))
                n = np.bincount(ids, weights=np.array(fresh)).astype(np.int64)
                at = pa.array(np.array(rows, dtype=np.int64)[order])
                values = [b.column(c).take(at).cast(to_arrow_type(k)) for c, k in kinds.items()] + [pa.array(np.array(flat[c], dtype=np.int32)[order]) for c in numbers]
                return pa.RecordBatch.from_arrays([pa.array(list(number), "string"), pa.array(n), *(pa.ListArray.from_arrays(ends, v) for v in values)], names=names)

            keys = [None] * b.num_rows if single else b.column("key").to_pylist()
            for i, texts in enumerate(b.column("fields")):
                if single or keys[i] != last:
                    last, seen = keys[i], set()
                for f, text in enumerate(texts.as_py() or []):
                    own = token_list(text)
                    which += [number.setdefault(t, len(number)) for t in own]
                    rows += [i] * len(own)
                    flat["field"] += [f] * len(own)
                    flat["pos"] += range(len(own))
                    fresh += [t not in seen for t in own]
                    seen.update(own)
                if len(which) >= BATCH:
                    yield full()
                    for x in (number, which, rows, fresh, *flat.values()):
                        x.clear()
            if which:
                yield full()

    texts = units.select("key", "unit", "fields")
    texts = spread(texts) if single else texts.repartition("key").sortWithinPartitions("key")
    return texts.mapInArrow(run, schema)


def build(units: DataFrame, path: str, *, buckets: int = BUCKETS, parts: int = PARTS, single: bool = False) -> SearchIndex:
    """Writes the index of units (key, unit, fields) to a folder that all executors share, and opens it.

    single: each key has one unit of one field, which is the key, so a token's postings are its keys
    and are stored without the rest. parts: files of one bucket at least, by key, so that a token
    of all keys is split over as many tasks.

    Null texts and null lists of fields have no tokens; units of a null key are counted as one more
    key. Repeated units are repeated in the index and score once each.
    """
    spark = units.sparkSession
    size = F.aggregate(F.coalesce("fields", F.array().cast("array<string>")), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)))
    totals = units.agg(F.count_distinct("key").alias("keys"), F.count_if(F.col("key").isNull()).alias("nulls"), F.count("*").alias("units"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    parts = max(parts, -(-totals["size"] // (SORTED * buckets)))
    part = F.pmod(F.xxhash64(F.get("key", 0).cast("string")), F.lit(parts))
    rows = _postings(units, single).withColumn("bucket", bucket_of(F.col("token"), buckets)).repartition(buckets * parts, "bucket", part)
    rows.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings")
    counted = spark.read.parquet(f"{path}/postings").groupBy("bucket", "token").agg(F.sum("n").alias("df"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/terms")
    keys = totals["keys"] + (totals["nulls"] > 0)
    spark.createDataFrame([(keys, totals["units"], buckets)], "keys long, units long, buckets int").write.parquet(f"{path}/totals")
    return SearchIndex(spark, path)


class SearchIndex:
    """An index that build() has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.lists = spark.read.parquet(f"{path}/postings")
        self.postings = self.opened(self.lists)
        self.terms = spark.read.parquet(f"{path}/terms")
        self.n, self.units, self.buckets = spark.read.parquet(f"{path}/totals").first()

    def opened(self, lists: DataFrame, *more: str) -> DataFrame:
        """bucket, token, key, unit, field, pos of rows of lists, a row for each posting, with more of their columns."""
        own = [c for c in ("key", "unit", "field", "pos") if c in lists.columns]
        rows = lists.select("bucket", "token", *more, F.inline(F.arrays_zip(*own)))
        alone = {} if "unit" in own else {"unit": F.col("key"), "field": F.lit(0)}  # build(single=True)
        return rows.withColumns(alone) if alone else rows

    def pruned(self, table: DataFrame, tokens: list[str]) -> DataFrame:
        """Rows of a few tokens: only their folders are listed and only row groups that may hold them are read."""
        if not tokens:
            return table.filter("false")
        spark = table.sparkSession
        of = spark.createDataFrame([(t,) for t in tokens], "token string").select(bucket_of(F.col("token"), self.buckets).alias("b")).distinct().collect()
        return table.filter(F.col("bucket").isin(*[r["b"] for r in of]) & F.col("token").isin(*tokens))

    def idf(self, query: list[str]) -> dict[str, float]:
        """1 + ln((N + 1) / (df + 1)) of a query's tokens: a row for each."""
        df = {r["token"]: r["df"] for r in self.pruned(self.terms, query).select("token", "df").collect()}
        return {t: 1.0 + math.log((max(self.n, 1) + 1.0) / (df.get(t, 0) + 1.0)) for t in query}

    def document_frequency(self) -> DataFrame:
        """token, df, idf of all tokens."""
        return self.terms.select("token", "df", (1.0 + F.log((self.n + 1.0) / (F.col("df") + 1.0))).alias("idf"))

    def runs(self, phrase: list[str]) -> DataFrame:
        """unit, field of fields whose tokens, joined by spaces, have the phrase's: its first word may end a token, its last may begin one, the others are tokens.

        The vocabulary is read for the ends, then the postings of what fits there.
        """
        token, k = F.col("token"), len(phrase)
        fits = [F.contains(token, F.lit(phrase[0]))] if k == 1 else [F.endswith(token, F.lit(phrase[0])), *[token == w for w in phrase[1:-1]], F.startswith(token, F.lit(phrase[-1]))]
        roles = F.array_compact(F.array(*[F.when(fit, i) for i, fit in enumerate(fits)]))
        words = self.terms.filter(reduce(or_, fits)).select("bucket", "token", F.explode(roles).alias("role"))
        held = self.opened(self.lists.join(small(words), ["bucket", "token"]), "role").select("unit", "field", (F.col("pos") - F.col("role")).alias("start"), "role").distinct()
        return held.groupBy("unit", "field", "start").agg(F.count("*").alias("n")).filter(F.col("n") == k).select("unit", "field").distinct()

    def fields(self, query: str) -> DataFrame:
        """key, unit, field, own (the query's tokens in this field), phrase (whether its tokens run on as in the query) of every field with one of the query's tokens."""
        q, phrase = query_tokens(query), plain_tokens(query)
        own = self.pruned(self.postings, q).groupBy("key", "unit", "field").agg(F.array_sort(F.collect_set("token")).alias("own"))
        if not phrase:
            return own.withColumn("phrase", F.lit(False))
        runs = self.runs(phrase).select(F.col("unit").alias("_u"), F.col("field").alias("_f"), F.lit(True).alias("_run"))
        out = own.join(runs, (F.col("unit") == F.col("_u")) & (F.col("field") == F.col("_f")), "left")
        return out.select("key", "unit", "field", "own", F.coalesce("_run", F.lit(False)).alias("phrase"))
