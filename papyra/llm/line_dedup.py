"""Operator 4: boilerplate lines by their frequency within a site.

For each host, the pages that hold a line are divided by the pages of the host; lines above a
ratio are dropped. Only two hashes of 64 bits a line are shuffled, never text. Since the shares
of all lines of a host add up to its mean number of distinct lines a page, at most that mean
divided by the ratio can be boilerplate: the lists that go back to the pages stay small however
many pages a host has. They are broadcast while their measured size is small, else joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Boilerplate lines, over all hosts, up to which their lists are broadcast (16 bytes each).
BROADCAST_LINES = 500_000


def _key(line: Column) -> Column:
    """Two independent 64-bit hashes of the trimmed line."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """host, key, n_pages (that hold the line), host_pages of every line above the ratio and on min_pages pages at least."""
    pages = docs.select(docs[host_col].alias("host"), docs[text_col].alias("text")).filter(F.col("host").isNotNull())
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    return counts.join(totals, "host").filter(F.col("n_pages") > ratio * F.col("host_pages"))


def line_dedup(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 2, spare_copies: bool = False) -> DataFrame:
    """docs with its columns, boilerplate lines taken out of text, and dl_lines, dl_dropped (lines that aren't blank, those dropped).

    Lines are compared without spaces at their ends and with their case; blank lines stay. A
    page counts once for each line, however often it repeats it; repeated rows are pages of
    their own. A page all of whose lines are boilerplate loses them all and stays as a row;
    with spare_copies it counts as a copied page rather than a frame around content, and stays
    as it is for document-level deduplication. Lines on fewer pages than min_pages stay: a line
    of one page repeats nothing, though on a host of a few pages its share is above any ratio. Pages without a host and null texts stay as they
    are; an empty table gives an empty one. Columns of docs that are called as the two new ones
    are replaced.
    """
    sets = checkpointed(boilerplate_lines(docs, host_col=host_col, text_col=text_col, ratio=ratio, min_pages=min_pages).select("host", "key"))
    lists = sets.groupBy("host").agg(F.collect_list("key").alias("dl_keys")).withColumnRenamed("host", "dl_host")
    if sets.count() <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    # A row is one column here, so that no name of its own can clash.
    row = F.col("row")
    joined = docs.select(F.struct("*").alias("row")).join(lists, row[host_col] == F.col("dl_host"), "left")
    text, keys = row[text_col], F.coalesce(F.col("dl_keys"), F.array().cast("array<struct<a:bigint,b:bigint>>"))
    kept = F.filter(_lines(text), lambda x: ~((F.trim(x) != "") & F.array_contains(keys, _key(x))))
    filled = lambda lines: F.size(F.filter(lines, lambda x: F.trim(x) != ""))
    joined = joined.select("row", kept.alias("kept"), F.when(text.isNull(), 0).otherwise(filled(_lines(text))).alias("dl_lines"))
    stays = F.col("kept").isNull() | (F.lit(spare_copies) & (filled(F.col("kept")) == 0))
    joined = joined.select("row", F.when(stays, text).otherwise(F.array_join("kept", "\n")).alias("new"), "dl_lines", F.when(stays, 0).otherwise(F.col("dl_lines") - filled(F.col("kept"))).alias("dl_dropped"))
    names = [F.col("new").alias(c) if c == text_col else row[c].alias(c) for c in docs.columns if c not in ("dl_lines", "dl_dropped")]
    return joined.select(*names, "dl_lines", "dl_dropped")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("dl_lines").cast("long").alias("n_lines"), F.col("dl_dropped").cast("long").alias("n_dropped"), F.md5("text").alias("text_md5"))


OP4_SQL = """
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
held AS (SELECT DISTINCT doc_id, source, trim(line) AS line FROM (SELECT doc_id, source, unnest(lines) AS line FROM pages) WHERE trim(line) <> '' AND source IS NOT NULL),
boiler AS (SELECT h.source, h.line FROM (SELECT source, line, count(*) AS n FROM held GROUP BY ALL) h
  JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY ALL) t ON h.source = t.source WHERE h.n >= 2 AND h.n > 0.1 * t.pages),
numbered AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM pages),
marked AS (SELECT n.*, trim(n.line) <> '' AS filled, b.line IS NOT NULL AS dropped FROM numbered n LEFT JOIN boiler b ON b.source = n.source AND b.line = trim(n.line)),
per AS (SELECT doc_id, count(*) FILTER (WHERE filled) AS n_lines, count(*) FILTER (WHERE dropped) AS n, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n_lines, 0) AS n_lines, coalesce(p.n, 0) AS n_dropped,
  md5(CASE WHEN d.text IS NOT NULL AND d.source IS NOT NULL THEN coalesce(p.kept, '') ELSE d.text END) AS text_md5
FROM documents d LEFT JOIN per p USING (doc_id)
"""
