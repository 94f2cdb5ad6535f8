"""Texts in rows: sentences, pieces, n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, sentences


def sentence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, ord (from 0), sentence_md5 of each sentence of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("ord", "s"))
    return rows.select("doc_id", "ord", F.md5("s").alias("sentence_md5"))


def repeated_phrases(docs: DataFrame, heads: tuple[str, ...], stops: tuple[str, ...], *, sizes: tuple[int, ...] = (2, 3, 4), least: int = 2) -> DataFrame:
    """doc_id, phrase, n: phrases of a document (doc_id, text) that begin or end with a head word, hold no stop word, and are there ``least`` times; counted within each document, so that nothing is shuffled but its own phrases."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z][a-z-]+"), F.lit(0))
    rows = docs.select("doc_id", words.alias("_w")).select("doc_id", F.explode(ngrams(F.col("_w"), sizes)).alias("phrase"))  # a column of its own: n-grams look at it again and again
    first, last = F.regexp_extract("phrase", "^[^ ]+", 0), F.regexp_extract("phrase", "[^ ]+$", 0)
    rows = rows.filter((first.isin(*heads) | last.isin(*heads)) & ~F.arrays_overlap(F.split("phrase", " "), F.array(*map(F.lit, stops))))
    return rows.groupBy("doc_id", "phrase").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
