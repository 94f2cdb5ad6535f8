"""Vocabularies and linking on parts, suppliers, embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vocabulary
from .registry import query, read


@query("""
WITH e AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Term-' || (p_partkey % 20) WHEN 1 THEN 'name ' || (p_partkey % 20) WHEN 2 THEN 'Alias ' || (p_partkey % 20) ELSE 'zz' END AS label FROM part),
x AS (SELECT id, CASE WHEN label <> 'zz' THEN id % 20 END AS t, id % 5 AS v FROM e)
SELECT id, CASE WHEN t IS NOT NULL THEN 't' || t WHEN v < 2 THEN 't' || v END AS term_id, CASE WHEN t IS NOT NULL OR v < 2 THEN 1.0 END::DOUBLE AS link_score FROM x""")
def linked_terms(spark, sf_dir):
    """Labels found by key, name or alias, the rest by vectors, where one points the same way."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 20
    label = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Term-"), k)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("name "), k)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Alias "), k)).otherwise("zz")
    axis = lambda n: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == n, 2.0).otherwise(0.0))
    e = p.select(F.col("p_partkey").alias("id"), label.alias("label"), axis(F.col("p_partkey") % 5).alias("v"))
    t = spark.range(20).select(F.concat(F.lit("t"), "id").alias("term_id"), F.concat(F.lit("term "), "id").alias("key"), F.concat(F.lit("Name-"), "id").alias("display_name"), F.array(F.concat(F.lit("ALIAS"), "id")).alias("aliases"), F.col("id").alias("ord"), F.when(F.col("id") < 2, axis(F.col("id"))).alias("v"))
    return vocabulary.linked(e, t).select("id", "term_id", "link_score")


@query("""
WITH e AS (SELECT DISTINCT 'B' || p_size AS c FROM part), m AS (SELECT 'B' || s AS source, 'B' || (s - 1) AS target FROM (SELECT DISTINCT p_size AS s FROM part) WHERE s % 5 = 0 AND 'B' || (s - 1) IN (SELECT c FROM e))
SELECT c AS canonical_label, list_aggregate(list_concat(['a' || c], coalesce((SELECT list_concat(list('a' || source), list(source)) FROM m WHERE target = c), [])), 'string_agg', ',') AS aliases FROM e WHERE c NOT IN (SELECT source FROM m)""")
def merged_entries(spark, sf_dir):
    """Sizes as entries: each fifth goes into the one before it."""
    sizes = read(spark, sf_dir, "part").select("p_size").distinct()
    e = sizes.select(F.concat(F.lit("B"), "p_size").alias("canonical_label"), F.array(F.concat(F.lit("aB"), "p_size")).alias("aliases"), F.lit("d").alias("domain"), F.lit(1).alias("seq"))
    m = sizes.filter("p_size % 5 = 0").select(F.concat(F.lit("B"), "p_size").alias("source"), F.concat(F.lit("B"), F.col("p_size") - 1).alias("target"))
    out = vocabulary.merged_entries(vocabulary.registered(e.limit(0), e), m)
    return out.select("canonical_label", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Size ' || p_size WHEN p_size % 3 = 1 THEN 'Size ' || p_size END AS canonical_label FROM part")
def normalised_labels(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("sIZE "), "p_size")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("S"), "p_size")).otherwise("other")
    e = p.select(F.concat(F.lit("Size "), "p_size").alias("canonical_label"), F.array(F.concat(F.lit("s"), "p_size")).alias("aliases"), F.lit("d").alias("domain"), F.lit(1).alias("seq")).distinct()
    return vocabulary.normalised(p.select("p_partkey", said.alias("label")), e).select("p_partkey", "canonical_label")


@query("""
WITH l AS (SELECT l_orderkey AS paper_id, ['rl', 'val', 'ml', 'os', 'rf', 'bias', 'x'][l_partkey % 7 + 1] AS k FROM lineitem), s AS (SELECT paper_id, list(DISTINCT k) AS ks FROM l GROUP BY 1),
h AS (SELECT paper_id, 'hint' AS kind, unnest(CASE WHEN list_contains(ks, 'rl') AND list_contains(ks, 'val') THEN [['human-robot interaction', 'Emotion-conditioned reinforcement signals can support socially legible robot adaptation.'], ['affective computing', 'Appraisal and valence models provide reusable state features for adaptive affective systems.']] ELSE [] END) AS v FROM s)
SELECT paper_id, kind, v[1] AS value, v[2] AS why_applicable, NULL AS this_field, NULL AS other_field FROM h
UNION ALL SELECT paper_id, 'hint', 'data governance', 'Monitoring and drift-detection methods transfer to institutional data quality workflows.', NULL, NULL FROM s WHERE list_contains(ks, 'ml') AND list_contains(ks, 'os')
UNION ALL SELECT DISTINCT paper_id, 'conflict', CASE k WHEN 'val' THEN 'valence' WHEN 'rf' THEN 'reward' ELSE 'bias' END, NULL, CASE k WHEN 'val' THEN 'affective polarity' WHEN 'rf' THEN 'reinforcement signal or objective term' ELSE 'statistical or model distortion' END,
  CASE k WHEN 'val' THEN 'chemistry/linguistics - bonding capacity or argument structure' WHEN 'rf' THEN 'psychology/economics - subjective or extrinsic incentive' ELSE 'social science - systematic unfairness or prejudice' END FROM l WHERE k IN ('val', 'rf', 'bias')""")
def suggested_hints(spark, sf_dir):
    labels = ("Reinforcement Learning", "valence", "Machine-learning", "Official Statistics", "reward function", "Bias", "x")
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.get(F.array(*map(F.lit, labels)), (F.col("l_partkey") % 7).cast("int")).alias("label"))
    return vocabulary.suggested(line)


@query("""
WITH d AS (SELECT doc_id, text, regexp_replace(lower(text), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') AS low, lower(substr(text, 1, 5000)) AS head FROM documents),
n AS (SELECT *, len(regexp_extract_all(low, '(?:^|[^\\p{L}\\p{N}_])anea(?:$|[^\\p{L}\\p{N}_])')) AS n, regexp_matches(head, '(?:^|[^\\p{L}\\p{N}_])anea(?:$|[^\\p{L}\\p{N}_])') AS early FROM d)
SELECT doc_id, round(CASE WHEN doc_id % 3 = 2 THEN 0.5 ELSE least(0.93, CASE WHEN n >= 8 THEN 0.86 WHEN n >= 4 THEN 0.78 WHEN n >= 2 THEN 0.70 WHEN n >= 1 THEN 0.62 ELSE 0.52 END + CASE WHEN early THEN 0.04 ELSE 0.0 END) END::DOUBLE, 2) AS confidence FROM n""")
def calibrated_concepts(spark, sf_dir):
    """Confidence in a word by how documents mention it, for scanned and flat ones; others keep theirs."""
    d = read(spark, sf_dir, "documents")
    c = d.select(F.col("doc_id").alias("paper_id"), F.lit(" anea ").alias("label"), F.when(F.col("doc_id") % 3 == 1, 0.74).otherwise(0.5).alias("confidence"), (F.col("doc_id") % 3 == 0).alias("auto_detected"), F.lit(None).cast("string").alias("candidate_source"))
    return vocabulary.calibrated(c, d.select(F.col("doc_id").alias("paper_id"), "text")).select(F.col("paper_id").alias("doc_id"), "confidence")


@query("""
SELECT l_orderkey AS paper_id, l_linenumber AS ord, l_partkey % 6 AS k FROM lineitem WHERE CASE l_partkey % 6 WHEN 0 THEN TRUE WHEN 1 THEN l_returnflag <> 'A' WHEN 2 THEN FALSE WHEN 3 THEN l_returnflag <> 'A' WHEN 4 THEN l_returnflag <> 'A' OR l_discount >= 0.065 ELSE FALSE END""")
def filtered_concepts(spark, sf_dir):
    """Concepts without artefacts: a blocked key, a page break, a piece of the title, weak scans, headings."""
    line = read(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") % 6
    label = F.get(F.array(*map(F.lit, ("Good term", "Blocked", "a --- b", "study of deep nets", "Weak", "of learning"))), k.cast("int"))
    c = line.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("ord"), k.alias("k"), label.alias("label"), F.when(k == 5, "Section or heading: of learning").otherwise("said").alias("evidence_span"), F.when(k == 4, F.round(F.col("l_discount") * 10, 2)).otherwise(0.9).alias("confidence"), F.lit(False).alias("auto_detected"), F.when(F.col("l_returnflag") == "A", "deterministic_scan").alias("candidate_source"))
    t = c.select("paper_id", F.lit("A study of deep nets and more").alias("title")).distinct()
    return vocabulary.filtered(c, t, blocked=["blocked"]).select("paper_id", "ord", "k")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber, l_partkey) AS n FROM lineitem)
SELECT l_suppkey AS paper_id, l_returnflag AS kind, count(*) AS n, max(l_orderkey) AS last_order FROM r WHERE n <= 12 GROUP BY ALL""")
def first_items(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("paper_id"), F.col("l_returnflag").alias("kind"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), "l_partkey").alias("ord"), "l_orderkey")
    return vocabulary.first_items(line).groupBy("paper_id", "kind").agg(F.count("*").alias("n"), F.max("l_orderkey").alias("last_order"))
