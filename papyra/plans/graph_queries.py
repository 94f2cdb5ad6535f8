"""Graph operators on the star schema: orders or suppliers stand for papers, parts for references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import obsolescence
from ..operators import graph
from .registry import query, read


def _edges(spark: SparkSession, sf_dir: str, src: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col(src).alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem),
d AS (SELECT src, count(*) AS deg FROM e GROUP BY src),
p AS (SELECT a.src AS l, b.src AS r, count(*) AS shared FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL),
k AS (SELECT l, r, shared, shared / greatest(1, least(x.deg, y.deg)) AS s FROM p JOIN d x ON x.src = l JOIN d y ON y.src = r)
SELECT l AS src, r AS dst, round(s, 4) AS score, shared FROM k WHERE shared >= 2 AND s >= 0.25
UNION ALL SELECT r, l, round(s, 4), shared FROM k WHERE shared >= 2 AND s >= 0.25""")
def co_citation_similarity(spark, sf_dir):
    return graph.co_citation(_edges(spark, sf_dir, "l_orderkey"))


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
d AS (SELECT src, count(*) AS deg FROM e GROUP BY src),
p AS (SELECT a.src AS src, b.src AS dst, count(*) AS shared FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL)
SELECT p.src, p.dst, shared, round(shared / (x.deg + y.deg - shared), 4) AS score FROM p JOIN d x ON x.src = p.src JOIN d y ON y.src = p.dst
WHERE shared / (x.deg + y.deg - shared) >= 0.1""")
def jaccard_neighbours(spark, sf_dir):
    return graph.jaccard_pairs(_edges(spark, sf_dir, "l_suppkey"))


@query("""
WITH k AS (SELECT l, r, shared, shared / greatest(1, least(x.deg, y.deg)) AS s FROM
  (SELECT a.src AS l, b.src AS r, count(*) AS shared FROM (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) a
   JOIN (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL)
  JOIN (SELECT l_orderkey AS src, count(DISTINCT l_partkey) AS deg FROM lineitem GROUP BY 1) x ON x.src = l
  JOIN (SELECT l_orderkey AS src, count(DISTINCT l_partkey) AS deg FROM lineitem GROUP BY 1) y ON y.src = r WHERE shared >= 2),
b AS (SELECT l AS src, r AS dst, s, shared FROM k WHERE s >= 0.25 UNION ALL SELECT r, l, s, shared FROM k WHERE s >= 0.25)
SELECT src, dst, round(s, 4) AS score, shared, (SELECT count(*) FROM b) AS total FROM b ORDER BY round(s, 4) DESC, src, dst LIMIT 20""")
def co_citation_preview(spark, sf_dir):
    """The first 20 edges and how many there are."""
    edges = graph.co_citation(_edges(spark, sf_dir, "l_orderkey"))
    return edges.orderBy(F.desc("score"), "src", "dst").limit(20).crossJoin(edges.agg(F.count("*").alias("total"))).select("src", "dst", "score", "shared", "total")


@query("""
WITH e AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders), n AS (SELECT c_custkey AS id, c_name AS title, false AS is_stub FROM customer WHERE c_custkey % 3 <> 0)
SELECT id, title, is_stub, (SELECT count(*) FROM e WHERE dst = id) AS n_cited FROM n
UNION ALL SELECT dst, NULL, true, count(*) FROM e WHERE dst NOT IN (SELECT id FROM n) GROUP BY dst""")
def citation_edges_with_stubs(spark, sf_dir):
    """Orders cite customers, of which every third isn't in the store: stubs stand for these."""
    edges = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")).distinct()
    known = read(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("store").alias("source"), F.lit(False).alias("is_stub"))
    nodes = graph.with_stubs(known, edges)
    cited = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return nodes.join(cited, "id", "left").select("id", "title", "is_stub", F.coalesce("n", F.lit(0)).cast("long").alias("n_cited"))


@query("SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS n_cited_by, min(l_orderkey) AS first_citing FROM lineitem GROUP BY 1")
def cited_by(spark, sf_dir):
    return _edges(spark, sf_dir, "l_orderkey").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_cited_by"), F.min("src").alias("first_citing"))


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), m AS (SELECT dst FROM e WHERE src = 1),
a AS (SELECT 'citation' AS kind, dst AS id, CAST(NULL AS DOUBLE) AS score FROM m
  UNION ALL SELECT 'cited_by', src, NULL FROM e WHERE dst = 1
  UNION ALL SELECT 'similar', s.src, round(s.n / (d.deg + (SELECT count(*) FROM m) - s.n), 4) FROM (SELECT src, count(*) AS n FROM e WHERE src <> 1 AND dst IN (SELECT dst FROM m) GROUP BY src) s
    JOIN (SELECT src, count(*) AS deg FROM e GROUP BY src) d ON d.src = s.src),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC NULLS LAST, id) AS rank FROM a)
SELECT kind, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def paper_neighbourhood(spark, sf_dir):
    return graph.neighbours(_edges(spark, sf_dir, "l_suppkey"), 1)


@query("""
WITH p AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, count(l_orderkey) AS citations FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT id, year, citations, round(least(1.0, greatest(0, 2026 - year) / (1.0 + log10(greatest(1, citations) + 1)) / 10.0), 4) AS obsolescence FROM p""")
def obsolescence_scores(spark, sf_dir):
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    n = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    p = o.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")).join(n, "id", "left").withColumn("citations", F.coalesce("n", F.lit(0)).cast("long"))
    return p.select("id", "year", "citations", obsolescence(F.col("year"), F.col("citations"), 2026).alias("obsolescence"))


@query("""
WITH n AS (SELECT 'n' || n_nationkey AS id FROM nation UNION SELECT 'c' || c_custkey FROM customer UNION SELECT 'o' || o_orderkey FROM orders),
e AS (SELECT 'BELONGS_TO' AS type FROM customer UNION ALL SELECT 'PLACED' FROM orders)
SELECT (SELECT count(*) FROM n) AS n_nodes, count(*) AS n_edges, string_agg(DISTINCT type, ',' ORDER BY type) AS edge_types FROM e""")
def explorer(spark, sf_dir):
    c, o, n = (read(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id")).union(c.select(F.concat(F.lit("c"), "c_custkey"))).union(o.select(F.concat(F.lit("o"), "o_orderkey")))
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("BELONGS_TO").alias("type")).union(o.select(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"), F.lit("PLACED")))
    return graph.explorer_stats(nodes, edges)


@query("""
SELECT l_suppkey AS src, l_partkey AS dst, max_by(l_orderkey, (l_orderkey, l_linenumber, l_quantity)) AS last_order, max_by(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS weight FROM lineitem GROUP BY ALL""")
def merged_edges(spark, sf_dir):
    """Edge upserts: the last write of each pair of ends stays."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_orderkey").alias("last_order"), F.col("l_quantity").alias("weight"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("seq"))
    return graph.merge_edges(e).select("src", "dst", "last_order", "weight")


@query("""
SELECT p_type AS label, count(DISTINCT l_suppkey) AS n_papers, round(list_sum(list_slice(list_sort(list(l_quantity), 'DESC'), 1, 4)) + count(DISTINCT l_suppkey), 4) AS score
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type HAVING count(DISTINCT l_suppkey) >= 2""")
def shared_label_groups(spark, sf_dir):
    """Hypotheses from labels that two papers or more share: the four best scores and the number of papers."""
    from ..operators.answers import shared_labels

    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    ev = line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_type").alias("label"), F.col("l_suppkey").alias("paper_id"), F.col("l_quantity").alias("score"))
    return shared_labels(ev)
