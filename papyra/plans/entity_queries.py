"""Rules on entities over the star schema: lines of orders are entities of suppliers, customers or orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round4
from ..operators import context
from ..operators import entities as rules
from .registry import query, read

_DETAIL, _FAMILIES = ("partkind3",), ("partkind4", "partkind5")
_CORE = {"benchmark": ("partkind6", "partkind7"), "theoretical": ("partkind8", "partkind9"), "quantum": ("partkind10",), "medical_imaging": ("partkind11", "partkind12")}

#: Entities of orders: a line is an accepted concept or method, or a candidate of either, by its number.
_ENTITIES = """
t AS (SELECT o_orderkey AS paper_id, CASE o_orderkey % 4 WHEN 0 THEN 'survey' WHEN 1 THEN 'benchmark' WHEN 2 THEN 'theoretical' ELSE 'research' END AS kind, 'On part kind ' || (o_custkey % 30) AS title FROM orders),
n AS (SELECT l_orderkey AS paper_id, l_linenumber AS ord, CASE l_linenumber % 4 WHEN 0 THEN 'concept' WHEN 1 THEN 'concept_candidate' WHEN 2 THEN 'method_candidate' ELSE 'method' END AS role, 'partkind' || (l_partkey % 30) AS key, CASE WHEN l_partkey % 7 > 0 THEN 'id' || (l_partkey % 30) END AS canonical_id,
  l_suppkey % 3 > 0 AS exact, ['Theory', 'MethodFamily', 'Algorithm', 'System'][l_suppkey % 4 + 1] AS type, 0.4 + l_discount * 5 AS confidence, CAST(l_quantity % 3 AS INTEGER) AS mentions, CASE WHEN l_returnflag = 'A' THEN 'central' ELSE 'passing' END AS salience, CASE WHEN l_returnflag = 'R' THEN 'Baseline' ELSE 'other' END AS source, l_linestatus = 'F' AS scanned FROM lineitem),
r AS (SELECT n.*, t.kind, t.title, (mentions >= 1 OR salience = 'central') AS seen, (type IN ('Theory', 'System', 'MethodFamily') AND confidence >= 0.5 AND length(key) >= 8 AND contains(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), key)) AS titled FROM n JOIN t USING (paper_id))"""


def _entities(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    pick = lambda c, n, *xs: F.coalesce(*[F.when(F.col(c) % n == i, x) for i, x in enumerate(xs)])
    kind, none = (F.col("l_partkey") % 30).cast("string"), F.lit(None).cast("string")
    return line.select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("ord"), pick("l_linenumber", 4, "concept", "concept_candidate", "method_candidate", "method").alias("role"), F.concat(F.lit("Part-kind "), kind).alias("label"), none.alias("canonical_label"), F.when(F.col("l_partkey") % 7 > 0, F.concat(F.lit("id"), kind)).alias("canonical_id"),
        F.when(F.col("l_suppkey") % 3 > 0, "exact_alias").otherwise("embedding").alias("match_type"), pick("l_suppkey", 4, "Theory", "MethodFamily", "Algorithm", "System").alias("entity_type"), (0.4 + F.col("l_discount") * 5).alias("confidence"), (F.col("l_quantity") % 3).cast("int").alias("mention_count"), F.when(F.col("l_returnflag") == "A", "central").otherwise("passing").alias("salience"),
        F.when(F.col("l_returnflag") == "R", "Baseline").otherwise("other").alias("source_type"), F.when(F.col("l_linestatus") == "F", "deterministic_scan").alias("candidate_source"), F.lit("pending").alias("review_status"), F.lit(None).cast("array<string>").alias("aliases"), F.concat(F.lit("uses part-kind "), kind, F.lit(" and kind "), F.col("l_linenumber").cast("string")).alias("evidence_span"), none.alias("context"), F.lit("part sort").alias("description"), none.alias("section"), none.alias("domain"),
    )


def _kinds(spark, sf_dir):
    kind = F.coalesce(*[F.when(F.col("o_orderkey") % 4 == i, x) for i, x in enumerate(("survey", "benchmark", "theoretical", "research"))])
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), kind.alias("paper_type"), F.concat(F.lit("On part kind "), F.col("o_custkey") % 30).alias("title"))


def _first(rule: str, accepted: str, into: str) -> str:
    """SQL of the promotion of the first row of an id for which a rule holds, unless it is accepted already."""
    return f"""k AS (SELECT *, coalesce({rule}, FALSE) AND canonical_id IS NOT NULL AS ok FROM r),
p AS (SELECT *, ok AND count(*) FILTER (WHERE ok) OVER (PARTITION BY paper_id, canonical_id ORDER BY ord ROWS UNBOUNDED PRECEDING) = 1 AND NOT bool_or(role IN ({accepted})) OVER (PARTITION BY paper_id, canonical_id) AS up FROM k)
SELECT paper_id, CAST(ord AS INTEGER) AS ord, CASE WHEN up THEN {into} ELSE role END AS role, CASE WHEN up THEN 'approved' ELSE 'pending' END AS review_status FROM p"""


_CONCEPT_RULE = """role = 'concept_candidate' AND exact AND key <> 'partkind3' AND (
  (kind = 'survey' AND type IN ('Theory', 'System') AND confidence >= 0.7 AND (mentions >= 2 OR salience = 'central'))
  OR (kind = 'survey' AND type = 'MethodFamily' AND key IN ('partkind4', 'partkind5') AND confidence >= 0.6 AND seen) OR titled
  OR (kind = 'benchmark' AND key IN ('partkind6', 'partkind7') AND confidence >= 0.6 AND (seen OR titled))
  OR (kind = 'theoretical' AND key IN ('partkind8', 'partkind9') AND confidence >= 0.6 AND (mentions >= 2 OR salience = 'central' OR titled OR scanned))
  OR (kind IN ('benchmark', 'research') AND key = 'partkind10' AND confidence >= 0.6 AND (seen OR titled))
  OR (kind IN ('benchmark', 'research') AND key IN ('partkind11', 'partkind12') AND confidence >= 0.6 AND (seen OR titled OR scanned)))"""


@query(f"WITH {_ENTITIES}, {_first(_CONCEPT_RULE, repr('concept'), repr('concept'))}")
def promoted_concepts(spark, sf_dir):
    out = rules.promote_concepts(_entities(spark, sf_dir), _kinds(spark, sf_dir), detail=_DETAIL, families=_FAMILIES, core=_CORE)
    return out.select("paper_id", "ord", "role", "review_status")


_METHOD_RULE = "role = 'method_candidate' AND exact AND type IN ('Algorithm', 'MethodFamily', 'System') AND confidence >= 0.7 AND source = 'Baseline' AND seen AND (kind = 'survey' OR (kind = 'benchmark' AND key IN ('partkind6', 'partkind7')) OR (kind IN ('research', 'benchmark') AND key IN ('partkind11', 'partkind12')))"


@query(f"WITH {_ENTITIES}, {_first(_METHOD_RULE, repr('method'), repr('method'))}")
def promoted_methods(spark, sf_dir):
    out = rules.promote_methods(_entities(spark, sf_dir), _kinds(spark, sf_dir), core=_CORE["benchmark"], medical=_CORE["medical_imaging"])
    return out.select("paper_id", "ord", "role", "review_status")


_END_RULE = "role IN ('concept_candidate', 'method_candidate') AND exact AND key <> 'partkind3' AND confidence >= 0.6 AND seen AND (paper_id, key) IN (SELECT a.paper_id, 'partkind' || ((CAST(substr(a.key, 9) AS INTEGER) + d) % 30) FROM n a, (SELECT unnest([1, 29]) AS d) WHERE a.role IN ('concept', 'method') AND a.scanned)"


@query(f"WITH {_ENTITIES}, {_first(_END_RULE, repr('concept') + ', ' + repr('method'), 'CASE WHEN role = ' + repr('concept_candidate') + ' OR type IN (' + repr('Theory') + ', ' + repr('System') + ') THEN ' + repr('concept') + ' ELSE ' + repr('method') + ' END')}".replace("ELSE 'pending' END AS review_status", "WHEN role IN ('concept', 'method') AND scanned THEN 'approved' ELSE 'pending' END AS review_status"))
def promoted_endpoints(spark, sf_dir):
    """Candidates that a template joins to an approved entity: each kind uses the next one."""
    e = _entities(spark, sf_dir)
    e = e.withColumn("review_status", F.when(F.col("role").isin("concept", "method") & F.col("candidate_source").isNotNull(), "approved").otherwise("pending"))
    t = spark.range(30).select(F.concat(F.lit("partkind"), "id").alias("subj"), F.lit("USES").alias("rel"), F.concat(F.lit("partkind"), (F.col("id") + 1) % 30).alias("obj"))
    t = t.union(t.select("obj", F.lit("OUTPERFORMS"), "obj"))
    return rules.promote_endpoints(e, t, detail=_DETAIL).select("paper_id", "ord", "role", "review_status")


@query("""
SELECT l_orderkey AS paper_id, l_linenumber AS ord, CASE WHEN CAST(l_quantity % 3 AS INTEGER) > 0 THEN CAST(l_quantity % 3 AS INTEGER) WHEN regexp_matches('uses part-kind ' || (l_partkey % 30) || ' and kind ' || l_linenumber || ' part sort', '(^|[^a-z0-9])part-kind ' || (l_partkey % 30) || '($|[^a-z0-9])') THEN 1 ELSE 0 END AS mention_count FROM lineitem""")
def repaired_mentions(spark, sf_dir):
    return rules.repaired_mentions(_entities(spark, sf_dir)).select("paper_id", "ord", "mention_count")


@query(f"""
WITH {_ENTITIES}
SELECT paper_id, CAST(ord AS INTEGER) AS ord, key = 'partkind2' OR (confidence >= 0.6 AND (key IN ('partkind11', 'partkind12') OR source = 'Baseline')) AS linked FROM n WHERE type = 'Algorithm'""")
def linked_algorithms(spark, sf_dir):
    """Algorithms that belong to a field: by key, by an anchor in their text, or as baselines in the field's terms."""
    e = _entities(spark, sf_dir).filter("entity_type = 'Algorithm'")
    rule = rules.links_to_field(e, always=["partkind2"], anchors=r"part-kind 1[12]\b.*part sort", domains=["parts"], context=["uses part"], background=["cell"])
    return e.select("paper_id", "ord", rule.alias("linked"))


@query("""
WITH e AS (SELECT l_orderkey AS paper_id, 'id' || (l_partkey % 30) AS cid, bool_or(l_linestatus = 'F') AS ok FROM lineitem WHERE l_partkey % 7 > 0 GROUP BY ALL),
r AS (SELECT l_orderkey AS paper_id, 'id' || (l_partkey % 30) AS s, 'id' || (l_suppkey % 30) AS o, l_quantity, l_returnflag, l_linenumber FROM lineitem)
SELECT r.paper_id, s AS subject_id, CASE l_returnflag WHEN 'A' THEN 'USED_IN' ELSE 'IS_A' END AS relation_type, o AS object_id, CAST(CASE WHEN l_quantity > 25 THEN 0.9 ELSE 0.75 END AS DOUBLE) AS confidence,
  CASE WHEN l_linenumber = 1 THEN 'given' WHEN a.ok AND b.ok THEN 'llm_relation' ELSE 'candidate_relation' END AS source, CASE WHEN a.ok AND b.ok THEN 'approved' ELSE 'pending' END AS review_status
FROM r JOIN e a ON a.paper_id = r.paper_id AND a.cid = s JOIN e b ON b.paper_id = r.paper_id AND b.cid = o WHERE s <> o AND l_returnflag <> 'N'""")
def valid_relations(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", " used in").when(F.col("l_returnflag") == "R", "is-a").otherwise("LIKES")
    r = line.select(F.col("l_orderkey").alias("paper_id"), F.concat(F.lit("id"), F.col("l_partkey") % 30).alias("subject_id"), kind.alias("relation_type"), F.concat(F.lit("id"), F.col("l_suppkey") % 30).alias("object_id"), F.lit(" said ").alias("evidence_span"), F.lit(None).cast("string").alias("section"), F.when(F.col("l_quantity") > 25, 0.9).alias("confidence"), F.when(F.col("l_linenumber") == 1, "given").alias("source"))
    e = _entities(spark, sf_dir).withColumn("review_status", F.when(F.col("candidate_source").isNotNull(), "approved").otherwise("pending"))
    out = rules.valid_relations(r, e, ["USED_IN", "IS_A"])
    return out.select("paper_id", "subject_id", "relation_type", "object_id", "confidence", "source", "review_status")


@query("""
WITH n AS (SELECT l_orderkey AS paper_id, l_linenumber AS ord, CASE WHEN l_partkey % 7 > 0 THEN 'id' || (l_partkey % 30) END AS cid, l_linestatus = 'F' AS ok, length('uses part-kind ' || (l_partkey % 30) || ' and kind ' || l_linenumber || ' part sort') AS size FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, coalesce(cid, '#' || ord) ORDER BY ok DESC, size DESC, ord) AS n FROM n)
SELECT paper_id, CAST(ord AS INTEGER) AS ord FROM k WHERE n = 1""")
def one_entity_per_id(spark, sf_dir):
    e = _entities(spark, sf_dir).withColumn("review_status", F.when(F.col("candidate_source").isNotNull(), "approved").otherwise("pending"))
    return rules.one_per_id(e).select("paper_id", "ord")


@query("""
WITH n AS (SELECT l_orderkey AS paper_id, l_linenumber AS ord, 'partkind' || (l_partkey % 30) AS key, CASE WHEN l_partkey % 7 > 0 THEN 'id' || (l_partkey % 30) END AS cid, l_linestatus = 'F' AND l_partkey % 7 > 0 AS ok FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, key ORDER BY ok DESC, ord, cid NULLS FIRST) AS n FROM n)
SELECT paper_id, key, cid AS canonical_id, CAST(ord AS INTEGER) AS ord FROM k WHERE n = 1""")
def entity_label_index(spark, sf_dir):
    e = _entities(spark, sf_dir).withColumn("review_status", F.when(F.col("candidate_source").isNotNull(), "approved").otherwise("pending"))
    return rules.label_index(e)


@query("""
WITH n AS (SELECT l_suppkey AS paper_id, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_partkey % 3 = 0 THEN 'Doe and Roe (19' || (50 + l_partkey % 40) || ') kind ' || (l_partkey % 5) WHEN l_partkey % 3 = 1 THEN 'Doe and Roe kind ' || (l_partkey % 5) ELSE 'Kind-' || (l_partkey % 9) END AS label,
  CASE WHEN l_partkey % 3 < 2 THEN 'author' || 'doeandroekind' || (l_partkey % 5) ELSE 'kind' || (l_partkey % 9) END AS base, l_discount, l_linestatus, l_partkey FROM lineitem),
k AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 'author:' || substr(base, 7) WHEN l_partkey % 3 = 1 THEN substr(base, 7) ELSE base END AS key FROM n)
SELECT paper_id, key, arg_min(label, (CAST(regexp_matches(label, '\\((?:19|20)[0-9]{2}') AS INT), -length(label), ord, label)) AS label, max(l_discount) AS confidence, CASE WHEN bool_or(l_linestatus = 'F') THEN 'approved' ELSE 'pending' END AS review_status, count(DISTINCT label) - 1 AS n_aliases FROM k GROUP BY paper_id, key""")
def merged_methods(spark, sf_dir):
    """Methods of suppliers: names of authors with their years are one, whatever the year."""
    line = read(spark, sf_dir, "lineitem")
    k, none = F.col("l_partkey"), F.lit(None).cast("string")
    label = F.when(k % 3 == 0, F.concat(F.lit("Doe and Roe (19"), 50 + k % 40, F.lit(") kind "), k % 5)).when(k % 3 == 1, F.concat(F.lit("Doe and Roe kind "), k % 5)).otherwise(F.concat(F.lit("Kind-"), k % 9))
    m = line.select(F.col("l_suppkey").alias("paper_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), label.alias("label"), none.alias("canonical_label"), F.lit(None).cast("array<string>").alias("aliases"), F.lit("d").alias("description"), none.alias("evidence_span"), none.alias("context"), F.col("l_discount").alias("confidence"), F.when(F.col("l_linestatus") == "F", "Approved").otherwise("pending").alias("review_status"))
    out = rules.merged_methods(m)
    return out.select("paper_id", "key", "label", "confidence", "review_status", F.size("aliases").cast("long").alias("n_aliases"))


@query("""
WITH n AS (SELECT l_orderkey AS paper_id, l_linenumber AS ord, l_partkey % 30 AS p, 'uses part-kind ' || (l_partkey % 30) || ' and kind ' || l_linenumber || ' part sort' AS t FROM lineitem),
f AS (SELECT paper_id, p, min(ord) AS ord FROM n WHERE p % 30 IS NOT NULL GROUP BY ALL),
r AS (SELECT a.paper_id, a.p AS s, b.p AS o FROM f a JOIN f b ON a.paper_id = b.paper_id AND a.p + 1 = b.p),
x AS (SELECT DISTINCT r.*, n.t, CASE WHEN contains(n.t, 'part-kind ' || s) OR contains(n.t, 'part kind ' || s) OR contains(n.t, 'part-kind-' || s) THEN 4 WHEN contains(n.t, 'part-kind') THEN 2 ELSE 0 END AS ms, CASE WHEN contains(n.t, 'part-kind ' || o) THEN 4 WHEN contains(n.t, 'part-kind') THEN 2 ELSE 0 END AS mo FROM r JOIN n USING (paper_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, s, o ORDER BY ms + mo + 3 DESC, length(t) DESC, t DESC) AS n FROM x WHERE ms > 0 AND mo > 0)
SELECT paper_id, 'k' || s AS subject_id, 'k' || o AS object_id, t AS evidence FROM k WHERE n = 1""")
def relation_evidence(spark, sf_dir):
    """For each pair of neighbouring kinds of an order, the text that speaks of both best."""
    e = _entities(spark, sf_dir).withColumn("canonical_id", F.concat(F.lit("k"), F.regexp_extract("label", "([0-9]+)$", 1)))
    k = e.select("paper_id", "canonical_id", F.regexp_extract("label", "([0-9]+)$", 1).cast("int").alias("p")).distinct()
    r = k.join(k.select("paper_id", F.col("canonical_id").alias("object_id"), (F.col("p") - 1).alias("p")), ["paper_id", "p"]).select("paper_id", F.col("canonical_id").alias("subject_id"), F.lit("USES").alias("relation_type"), "object_id")
    return context.relation_evidence(r, e).select("paper_id", "subject_id", "object_id", "evidence")


_RELATIONS = ("CAUSES", "LEADS_TO", "IMPLIES", "MITIGATES", "PREVENTS", "AFFECTS", "BUILT_ON", "PROVIDES", "REPRODUCES", "DERIVED_FROM", "MORE_ROBUST_THAN", "USES")
_SAYS = ("lowers", "an impact on", "entails", "to mitigate", "may avoid", "repercussion of", "built on", "exposes", "replicates", "distilled", "vulnerable", "based on")


@query(f"""
WITH n AS (SELECT l_orderkey AS paper_id, l_linenumber AS ord, l_partkey % 30 AS p, ['{"', '".join(_SAYS)}'][l_suppkey % 12 + 1] || ' of kindred-' || (l_partkey % 30) || ' near kindred-' || ((l_partkey + 1) % 30) || ' seen ' || l_suppkey AS t FROM lineitem),
f AS (SELECT paper_id, p, arg_min(t, ord) AS own FROM n GROUP BY ALL), x AS (SELECT DISTINCT paper_id, t FROM n),
r AS (SELECT a.paper_id, a.p AS s, b.p AS o, a.own AS so, b.own AS oo, ['{"', '".join(_RELATIONS)}'][(a.paper_id + a.p) % 12 + 1] AS rel, ['{"', '".join(_SAYS)}'][(a.paper_id + a.p) % 12 + 1] AS word FROM f a JOIN f b ON a.paper_id = b.paper_id AND a.p + 1 = b.p),
w AS (SELECT r.*, t, CASE WHEN contains(t, 'kindred-' || s) OR contains(t, 'kindred ' || s) THEN 4 ELSE 2 END AS ms, CASE WHEN contains(t, 'kindred-' || o) OR contains(t, 'kindred ' || o) THEN 4 ELSE 2 END AS mo FROM r JOIN x USING (paper_id) WHERE contains(t, 'kindred-' || s) AND contains(t, 'kindred-' || o)),
k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, s, o ORDER BY ms + mo + CASE WHEN contains(t, word) AND rel <> 'CAUSES' OR (rel IN ('CAUSES', 'LEADS_TO') AND contains(t, 'impact')) OR (rel = 'IMPLIES' AND contains(t, 'entails')) OR (rel = 'AFFECTS' AND (contains(t, 'impact') OR contains(t, 'repercussion'))) OR (rel = 'REPRODUCES' AND contains(t, 'replicate')) OR (rel = 'BUILT_ON' AND contains(t, 'based on')) THEN 3 ELSE 0 END DESC, length(t) DESC, t DESC) AS n FROM w)
SELECT r.paper_id, r.rel AS relation_type, 'k' || r.s AS subject_id, 'k' || r.o AS object_id, coalesce(k.t, CASE WHEN r.rel = 'REPRODUCES' THEN r.oo ELSE r.so END) AS evidence FROM r LEFT JOIN k ON k.paper_id = r.paper_id AND k.s = r.s AND k.o = r.o AND k.n = 1""")
def relation_evidence_typed(spark, sf_dir):
    """Evidence of relations of twelve types: texts name both kinds, and words of the relation decide between them."""
    line = read(spark, sf_dir, "lineitem")
    k, none = F.col("l_partkey") % 30, F.lit(None).cast("string")
    said = F.concat(F.get(F.array(*map(F.lit, _SAYS)), (F.col("l_suppkey") % 12).cast("int")), F.lit(" of kindred-"), k, F.lit(" near kindred-"), (F.col("l_partkey") + 1) % 30, F.lit(" seen "), "l_suppkey")
    e = line.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("Kindred-"), k).alias("label"), none.alias("canonical_label"), F.concat(F.lit("k"), k).alias("canonical_id"), F.lit("Task").alias("entity_type"), F.lit("approved").alias("review_status"), F.lit(None).cast("array<string>").alias("aliases"), said.alias("evidence_span"), none.alias("context"), none.alias("description"), none.alias("section"))
    p = line.select(F.col("l_orderkey").alias("paper_id"), k.alias("p")).distinct()
    both = p.join(p.select("paper_id", (F.col("p") - 1).alias("p")), ["paper_id", "p"])
    rel = F.get(F.array(*map(F.lit, _RELATIONS)), ((F.col("paper_id") + F.col("p")) % 12).cast("int"))
    r = both.select("paper_id", F.concat(F.lit("k"), "p").alias("subject_id"), rel.alias("relation_type"), F.concat(F.lit("k"), F.col("p") + 1).alias("object_id"))
    return context.relation_evidence(r, e).select("paper_id", "relation_type", "subject_id", "object_id", "evidence")


@query("""
WITH n AS (SELECT l_orderkey AS paper_id, l_linenumber AS ord, 'c' || (l_partkey % 12) AS id, ['System', 'Task', 'Metric', 'Dataset', 'ModelArchitecture', 'Theory'][l_partkey % 6 + 1] AS type, l_linestatus = 'F' AS ok, 'topic-' || chr(CAST(97 + l_partkey % 12 AS INTEGER)) || 'xyz' AS label,
  CASE l_suppkey % 4 WHEN 0 THEN 'evaluated with' WHEN 1 THEN 'a model for' WHEN 2 THEN 'built on' ELSE 'near' END || ' topic-' || chr(CAST(97 + (l_partkey + l_suppkey) % 12 AS INTEGER)) || 'xyz' AS t FROM lineitem),
e AS (SELECT * FROM n WHERE ok QUALIFY row_number() OVER (PARTITION BY paper_id, id ORDER BY length(t) DESC, ord) = 1),
p AS (SELECT a.paper_id, a.id AS s, b.id AS o, a.ord AS so, b.ord AS oo, a.type AS st, b.type AS ot, CASE WHEN contains(a.t, b.label) THEN a.t END AS f, CASE WHEN contains(b.t, a.label) THEN b.t END AS g FROM e a JOIN e b ON a.paper_id = b.paper_id AND a.id <> b.id),
k AS (SELECT *, CASE WHEN st IN ('System', 'Task', 'ModelArchitecture') AND ot = 'Dataset' AND (contains(f, 'evaluated') OR contains(g, 'evaluated')) THEN 'EVALUATED_ON'
  WHEN st IN ('System', 'Task', 'ModelArchitecture') AND ot = 'Task' AND contains(f, 'for') THEN 'USED_FOR' WHEN st IN ('System', 'ModelArchitecture') AND ot = 'ModelArchitecture' AND contains(f, 'built on') THEN 'USES' END AS rel FROM p),
v AS (SELECT *, CASE WHEN rel = 'EVALUATED_ON' THEN CASE WHEN contains(f, 'evaluated') OR contains(f, 'on') THEN f ELSE g END ELSE f END AS ev FROM k WHERE rel IS NOT NULL)
SELECT paper_id, s AS subject_id, rel AS relation_type, o AS object_id, ev AS evidence_span FROM v""")
def context_relations(spark, sf_dir):
    """What types and texts of approved entities of an order suggest."""
    line = read(spark, sf_dir, "lineitem")
    none, letter = F.lit(None).cast("string"), lambda c: F.concat(F.lit("topic-"), F.char(97 + c % 12), F.lit("xyz"))
    pick = lambda c, *xs: F.get(F.array(*map(F.lit, xs)), (F.col(c) % len(xs)).cast("int"))
    e = line.select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("ord"), letter(F.col("l_partkey")).alias("label"), none.alias("canonical_label"), F.concat(F.lit("c"), F.col("l_partkey") % 12).alias("canonical_id"), pick("l_partkey", "System", "Task", "Metric", "Dataset", "ModelArchitecture", "Theory").alias("entity_type"),
        F.when(F.col("l_linestatus") == "F", "Approved").otherwise("pending").alias("review_status"), F.lit(None).cast("array<string>").alias("aliases"), F.concat(pick("l_suppkey", "evaluated with", "a model for", "built on", "near"), F.lit(" "), letter(F.col("l_partkey") + F.col("l_suppkey"))).alias("evidence_span"), none.alias("context"), none.alias("description"), none.alias("section"),
    )
    return context.context_relations(e).select("paper_id", "subject_id", "relation_type", "object_id", "evidence_span")
