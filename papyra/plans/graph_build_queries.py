"""Graph build on the star schema: orders are papers that cite parts, their lines what was extracted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round4
from ..operators import graph_build
from .registry import query, read

#: Orders whose key ends in a third have an extraction under a name that no paper has; orders of status P failed; each 17th is invalid.
_EXTRACTIONS = """
x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'zz' || (o_custkey % 200) ELSE 'o' || o_orderkey END AS paper_id, o_orderkey % 3 <> 0 AS known, o_orderdate AS ts, CASE WHEN o_orderpriority LIKE '1%' THEN 'survey' ELSE 'research' END AS paper_type, o_orderkey % 2 = 0 AS split FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 17 <> 0),
i AS (SELECT x.*, CASE WHEN l_linenumber % 2 = 1 THEN 'concept' ELSE 'method' END AS role, l_linenumber AS line, 'Part kind ' || (l_partkey % 40) AS label, CASE WHEN l_partkey % 40 < 5 THEN 'c:' || (l_partkey % 40) END AS canonical_id, l_discount * 10 AS confidence,
  CASE l_returnflag WHEN 'A' THEN 'central' WHEN 'R' THEN 'passing' END AS salience, CASE l_returnflag WHEN 'N' THEN 'metric' END AS evidence_role, CASE l_returnflag WHEN 'A' THEN 'paper_contribution' WHEN 'R' THEN 'baseline' ELSE 'other' END AS source_type, l_linestatus = 'F' AS approved, l_partkey, l_suppkey, l_extendedprice
  FROM x JOIN lineitem ON l_orderkey = x.id),
a AS (SELECT *, coalesce(canonical_id, role || ':part-kind-' || substr(label, 11)) AS node_id FROM i WHERE line <> 7 AND CASE WHEN split THEN approved ELSE confidence >= CASE role WHEN 'concept' THEN 0.75 ELSE 0.70 END END),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, node_id ORDER BY ts DESC, id DESC, role, line, l_partkey, l_suppkey, l_extendedprice) AS n FROM a) WHERE n = 1)"""


def _papers(spark, sf_dir):
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    cited = line.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit(None).cast("string").alias("paperId"), F.lit("").alias("doi"), F.concat(F.lit("p"), "l_partkey").alias("id"), F.lit(None).cast("string").alias("source_id"), F.lit("t").alias("title"))).alias("references"))
    rows = orders.join(cited, orders.o_orderkey == cited.l_orderkey, "left")
    none = F.array().cast(cited.schema["references"].dataType)
    return rows.select(
        F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("orders").alias("source"), F.col("o_orderkey").cast("string").alias("source_id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), F.concat(F.lit(" 10.1/"), F.upper("o_orderstatus")).alias("doi"),
        none.alias("citations"), "references", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("added_to_graph"), F.col("o_orderkey").alias("seq"),
    )


def _extractions(spark, sf_dir):
    line, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    flag = F.col("l_returnflag")
    text = lambda c: c.cast("string")
    item = F.struct(
        F.concat(F.lit("  Part  kind "), (F.col("l_partkey") % 40).cast("string"), F.lit(" .")).alias("label"), F.when(F.col("l_partkey") % 40 < 5, F.concat(F.lit("c:"), text(F.col("l_partkey") % 40))).alias("canonical_id"), F.array(F.lit("part kind x"), F.lit("Part Kind X")).alias("aliases"), (F.col("l_discount") * 10).alias("confidence"),
        F.when(flag == "A", "central").when(flag == "R", "passing").alias("salience"), F.when(flag == "N", "metric").alias("evidence_role"), F.when(flag == "A", "paper_contribution").when(flag == "R", "baseline").otherwise("other").alias("source_type"), F.when(F.col("l_linestatus") == "F", "Approved").otherwise("pending").alias("review_status"),
        (F.col("l_linenumber") == 7).alias("auto_detected"), F.lit(None).cast("string").alias("candidate_source"), F.lit(None).cast("boolean").alias("accepted_for_kg_write"), F.concat(F.lit("line "), text(F.col("l_linenumber"))).alias("evidence_span"), F.lit("d").alias("domain"),
    )
    rows = line.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"), item.alias("item"), F.concat(F.lit("concept:part-kind-"), text(F.col("l_partkey") % 40)).alias("node"))
    # Sorted once, in a column of its own: what a lambda looks at is worked out for each element.
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", "node", "item"))).alias("all"))
    of = lambda odd: F.transform(F.filter("all", lambda x: (x["k"]["l_linenumber"] % 2 == 1) == odd), lambda x: x["item"])
    # Each line relates its kind to the first line's.
    relation = F.transform("all", lambda x: F.struct(x["node"].alias("subject_id"), F.when(x["k"]["l_linenumber"] % 2 == 0, "").otherwise("USES").alias("relation_type"), F.get("all", 0)["node"].alias("object_id"), F.when(x["k"]["l_linenumber"] == 5, "").otherwise("said").alias("evidence_span"), F.lit(0.5).alias("confidence"), F.lit("llm").alias("source"), F.lit("APPROVED").alias("review_status")))
    lists = lists.select("l_orderkey", of(True).alias("concepts"), of(False).alias("methods"), relation.alias("relations"))
    kind = F.when(F.col("o_orderpriority").like("1%"), "survey").otherwise("research")
    return o.join(lists, o.o_orderkey == lists.l_orderkey).select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("zz"), text(F.col("o_custkey") % 200))).otherwise(F.concat(F.lit("o"), text(F.col("o_orderkey")))).alias("paper_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("extraction_status"),
        F.col("o_orderdate").alias("extraction_timestamp"), kind.alias("paper_type"), F.when(F.col("o_orderkey") % 17 == 0, "invalid").alias("metadata_status"), F.array().cast("array<string>").alias("blocking_errors"), F.lit(None).cast("string").alias("raw_response"), (F.col("o_orderkey") % 2 == 0).alias("split"), "concepts", "methods", "relations",
    )


def _graph(spark, sf_dir):
    return graph_build.build(_papers(spark, sf_dir), _extractions(spark, sf_dir), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))


@query(f"""
WITH {_EXTRACTIONS}
SELECT 'o' || o_orderkey AS id, o_orderpriority AS title, CAST(year(o_orderdate) AS INTEGER) AS year, 'orders' AS source, FALSE AS is_stub, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE TIMESTAMP '2030-01-01' END AS added_to_graph FROM orders
UNION ALL SELECT DISTINCT 'p' || l_partkey, NULL, NULL, 'citation_reference', TRUE, NULL FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT DISTINCT paper_id, '', NULL, 'extraction_stub', TRUE, TIMESTAMP '2030-01-01' FROM e WHERE NOT known""")
def graph_papers(spark, sf_dir):
    """Papers, stubs of what they cite, stubs of what only extractions know."""
    return _graph(spark, sf_dir).papers.select("id", "title", "year", "source", "is_stub", "added_to_graph")


@query("SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def graph_citations(spark, sf_dir):
    return _graph(spark, sf_dir).citations


@query(f"WITH {_EXTRACTIONS} SELECT node_id AS id, min(label) AS label, 'd' AS domain, TRUE AS has_alias FROM e WHERE role = 'concept' GROUP BY node_id")
def graph_concepts(spark, sf_dir):
    c = _graph(spark, sf_dir).concepts
    return c.select("id", "label", "domain", ((F.size("aliases") == 2) & (F.get("aliases", 1) == "part kind x")).alias("has_alias"))


@query(f"WITH {_EXTRACTIONS} SELECT node_id AS id, min(label) AS label, 'd' AS domain, '' AS description FROM e WHERE role = 'method' GROUP BY node_id")
def graph_methods(spark, sf_dir):
    return _graph(spark, sf_dir).methods


@query(f"""
WITH {_EXTRACTIONS}
SELECT paper_id, node_id, role, CASE WHEN role = 'concept' THEN CASE WHEN paper_type = 'survey' AND salience = 'central' THEN 'REVIEWS' WHEN evidence_role = 'metric' THEN 'DISCUSSES' ELSE 'MENTIONS' END
  ELSE CASE WHEN source_type = 'paper_contribution' THEN 'INTRODUCES' WHEN paper_type = 'survey' THEN 'REVIEWS' WHEN source_type = 'baseline' THEN 'MENTIONS' ELSE 'USES' END END AS relation,
  round(confidence, 4) AS weight, 'line ' || line AS evidence, source_type AS source FROM e""")
def graph_mentions(spark, sf_dir):
    """What papers mention, each node once, the first over a paper's extractions."""
    m = _graph(spark, sf_dir).mentions
    return m.withColumn("weight", round4(F.col("weight")))


@query(f"""
WITH {_EXTRACTIONS},
l AS (SELECT l_orderkey, l_linenumber, 'concept:part-kind-' || (l_partkey % 40) AS src, first_value('concept:part-kind-' || (l_partkey % 40)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem),
c AS (SELECT id, node_id FROM e WHERE role = 'concept')
SELECT DISTINCT src, CASE WHEN l_linenumber % 2 = 0 THEN 'RELATED_TO' ELSE 'USES' END AS relation, dst, 'said' AS evidence, 0.5::DOUBLE AS confidence FROM l
WHERE src <> dst AND l_linenumber <> 5 AND (l_orderkey, src) IN (SELECT id, node_id FROM c) AND (l_orderkey, dst) IN (SELECT id, node_id FROM c)""")
def graph_related(spark, sf_dir):
    """Relations between concepts that one extraction wrote, each once for its ends and type."""
    return _graph(spark, sf_dir).related.select("src", "relation", "dst", "evidence", "confidence")


@query(f"""
WITH {_EXTRACTIONS},
l AS (SELECT l_orderkey, l_linenumber, 'concept:part-kind-' || (l_partkey % 40) AS src, first_value('concept:part-kind-' || (l_partkey % 40)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem),
c AS (SELECT id, node_id FROM e WHERE role = 'concept'),
d AS (SELECT DISTINCT src, l_linenumber % 2 AS relation, dst FROM l WHERE src <> dst AND l_linenumber <> 5 AND (l_orderkey, src) IN (SELECT id, node_id FROM c) AND (l_orderkey, dst) IN (SELECT id, node_id FROM c))
SELECT (SELECT count(*) FROM d) AS relation_edges, (SELECT count(*) FROM orders) AS papers_seen, (SELECT count(*) FROM orders) + (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) + (SELECT count(DISTINCT paper_id) FROM e WHERE NOT known) AS papers_written,
  (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)) AS citation_edges, count(DISTINCT node_id) FILTER (WHERE role = 'concept') AS concept_nodes, count(DISTINCT node_id) FILTER (WHERE role = 'method') AS method_nodes,
  count(*) FILTER (WHERE role = 'concept') AS concept_edges, count(*) FILTER (WHERE role = 'method') AS method_edges FROM e""")
def graph_stats(spark, sf_dir):
    p = _papers(spark, sf_dir)
    return graph_build.stats(_graph(spark, sf_dir), p)
