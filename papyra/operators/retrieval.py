"""Search: document frequencies, lexical scores, vectors, ranking."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import round4
from ..functions.text import LOW_SIGNAL, query_tokens
from ..shared import spread
from .linking import nearest
from .search_index import BUCKETS, SearchIndex, build, token_list


#: Tokens that a task counts before it sends them on.
COUNTED = 1_000_000


def document_frequency(docs: DataFrame, text: Column) -> DataFrame:
    """token, df, idf = 1 + ln((N + 1) / (df + 1)).

    Each task counts the tokens of its texts in a table of its own and sends a row a token, so a
    shuffle carries the vocabulary once a task, not a row for each token of a text.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), "string"), pa.array(list(held.values()), "int64")], names=["token", "df"])
            held.clear()
            return out

        for b in batches:
            for t in b.column("text").to_pylist():
                held.update(token_list(t))
            if len(held) >= COUNTED:
                yield sent()
        if held:
            yield sent()

    df = spread(docs.select(text.alias("text"))).mapInArrow(count, "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))
    n = docs.agg(F.count("*").alias("n"))  # one row
    return df.crossJoin(F.broadcast(n)).select("token", "df", (1.0 + F.log((F.col("n") + 1.0) / (F.col("df") + 1.0))).alias("idf"))


def lexical_score(own: Column, query: list[str], idf: dict[str, float], weight: float = 1.0, phrase: Column | None = None) -> Column:
    """Score of a text's tokens: weighted idf of the query's tokens that it has, common terms a quarter; 0 where a specific query meets common terms only; more where the tokens run on as in the query (``phrase``; by default they are looked at here)."""
    specific = [t for t in query if t not in LOW_SIGNAL]
    phrase = F.contains(F.array_join(own, " "), F.lit(" ".join(query))) if phrase is None else phrase
    part = lambda t: idf.get(t, 1.0) * (1.0 if t in specific else 0.25)
    total = sum((F.when(F.array_contains(own, t), part(t)).otherwise(0.0) for t in query), F.lit(0.0))
    bonus = F.when(phrase, weight * max(2, len(query))).otherwise(0.0)
    needed = F.arrays_overlap(own, F.array(*map(F.lit, specific or query))) if query else F.lit(False)
    return F.when(needed, weight * total + bonus).otherwise(0.0)


def lexical_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> SearchIndex:
    """The index of a table of texts."""
    return build(docs.select(docs[id_col].alias("key"), docs[id_col].alias("unit"), F.array(docs[text_col]).alias("fields")), path, buckets=buckets, single=True)


def lexical_hits(index: SearchIndex, query: str) -> DataFrame:
    """id, score, own (the query's tokens that it has) of each document that scores."""
    q = query_tokens(query)
    found = index.fields(query)
    return found.select(F.col("unit").alias("id"), lexical_score(F.col("own"), q, index.idf(q), phrase=F.col("phrase")).alias("score"), "own").filter("score > 0")


def lexical_search(index: SearchIndex, query: str, *, limit: int = 10, id_col: str = "doc_id") -> DataFrame:
    """id_col, score of the best documents for a query, by score to four decimals, ties by id."""
    hits = lexical_hits(index, query)
    return hits.orderBy(F.desc(round4(F.col("score"))), "id").limit(max(0, limit)).select(F.col("id").alias(id_col), "score")


def cover_first(hits: DataFrame, query: list[str], *, limit: int = 10) -> DataFrame:
    """The first ``limit`` hits (id, score, own: tokens) with rank: first, one after the other, the hit with the most query tokens not yet covered (then the higher score, then the lower id), then the rest by score.

    Of hits with the same covered tokens only the best can be picked, and there are no more such
    sets than 2 to the number of query tokens: one row for each comes to the driver. The rest is
    a top-k, of which each task sends no more than ``limit``.
    """
    specific = [t for t in query if t not in LOW_SIGNAL]
    picked: list = []
    if len(specific) >= 2:
        mask = sum((F.when(F.array_contains("own", t), 1 << i).otherwise(0) for i, t in enumerate(specific)), F.lit(0))
        best = hits.withColumn("mask", mask).filter("mask > 0").groupBy("mask").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
        rows, covered = [(r["b"]["s"], r["b"]["id"], r["mask"]) for r in best.collect()], 0
        for _ in specific:
            new = [(-bin(m & ~covered).count("1"), s, i, m) for s, i, m in rows if m & ~covered]
            if not new:
                break
            _, _, i, m = min(new)
            picked.append(i)
            covered |= m
    place = F.coalesce(*[F.when(F.col("id") == i, k) for k, i in enumerate(picked)], F.lit(len(picked))) if picked else F.lit(0)
    first = hits.withColumn("_p", place).orderBy("_p", F.desc("score"), "id").limit(max(0, limit))
    return first.withColumn("rank", F.row_number().over(W.orderBy("_p", F.desc("score"), "id"))).drop("_p")


def vector_topk(vectors: DataFrame, queries: DataFrame, *, k: int = 5, least: float = -1.0) -> DataFrame:
    """query_id, rank, id, score: the k rows of greatest cosine for each query vector (id, v), itself left out.

    Each query meets each row, in blocks: see linking.nearest(). Work is queries times rows, as the answer is exact.
    """
    whole = lambda df: df.select("id", F.lit(0).alias("type"), "v")
    scored = nearest(whole(vectors), whole(queries), k=k, least=least, of_few=True).select(F.col("of").alias("query_id"), "id", "score")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hybrid(lexical: DataFrame, by_label: DataFrame, *, limit: int = 10) -> DataFrame:
    """paper_id, score, n_evidence of lexical evidence and of evidence found through similar labels (both paper_id, score). What both find counts twice, as each is evidence of its own."""
    both = lexical.select("paper_id", "score").unionByName(by_label.select("paper_id", "score"))
    return both.groupBy("paper_id").agg(F.sum("score").alias("score"), F.count("*").alias("n_evidence")).orderBy(F.desc("score"), "paper_id").limit(limit)
