"""Vectors, linking and deduplication on embeddings and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import dot, round4, square
from ..operators import dedup, linking, retrieval
from ..shared import shared_folder
from ..streaming import events as streams
from ..streaming import jobs
from .registry import query, read

_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query(f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 4) AS score FROM r WHERE rank <= 5""")
def vector_topk_share(spark, sf_dir):
    """The five nearest of each hundredth vector, exact: queries grow with the table."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.vector_topk(e, e.filter("id % 100 = 0")).select("query_id", "rank", "id", round4(F.col("score")).alias("score"))


@query(f"""
WITH s AS (SELECT a.vec_id AS id, b.vec_id AS seed_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE b.vec_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, seed_id) AS rank FROM s WHERE score >= 0.3)
SELECT id, CAST(rank AS INTEGER) AS rank, seed_id, round(score, 4) AS score, rank = 1 AND score >= 0.92 AS auto_merge FROM r WHERE rank <= 5""")
def type_compatible_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), F.col("embedding").alias("v"))
    return linking.compatible_topk(e, e.filter("id % 10 = 0"), least=0.3)


@query("SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS norm2 FROM embeddings")
def vector_norms(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", round4(dot(F.col("embedding"), F.col("embedding"))).alias("norm2"))


@query("""
WITH h AS (SELECT s_suppkey AS id, s_nationkey FROM supplier), t AS (SELECT n_name AS subj, r_name AS obj, 'PART_OF' AS rel FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT DISTINCT s_nationkey % 7 AS paper_id, n_name AS key FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT DISTINCT s_nationkey % 7, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey <> 2)
SELECT a.paper_id, subj, rel, obj FROM t JOIN e a ON a.key = subj JOIN e b ON b.key = obj AND a.paper_id = b.paper_id""")
def relation_templates(spark, sf_dir):
    s, n, r = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    paper = (F.col("s_nationkey") % 7).alias("paper_id")
    e = j.select(paper, F.col("n_name").alias("key")).union(j.filter("r_regionkey <> 2").select(paper, F.col("r_name").alias("key")))
    t = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subj"), F.lit("PART_OF").alias("rel"), F.col("r_name").alias("obj"))
    return linking.relations_from_templates(e, t)


@query("""
WITH r AS (SELECT l_suppkey % 50 AS subject_id, l_linestatus AS relation_type, l_partkey % 50 AS object_id, CASE WHEN l_returnflag = 'A' THEN 'approved' ELSE 'pending' END AS review_status,
  CASE l_returnflag WHEN 'N' THEN 'llm_relation' WHEN 'R' THEN 'candidate_relation' ELSE 'deterministic_relation' END AS source, l_discount AS confidence, repeat('x', CAST(l_quantity AS BIGINT)) AS evidence_span, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, relation_type, object_id ORDER BY (review_status = 'approved') DESC, CASE source WHEN 'deterministic_relation' THEN 3 WHEN 'llm_relation' THEN 2 ELSE 1 END DESC, confidence DESC, length(evidence_span) DESC, ord, source) AS n FROM r)
SELECT subject_id, relation_type, object_id, review_status, source, confidence, length(evidence_span) AS evidence_chars, ord FROM k WHERE n = 1""")
def best_relation(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    r = line.select(
        (F.col("l_suppkey") % 50).alias("subject_id"), F.col("l_linestatus").alias("relation_type"), (F.col("l_partkey") % 50).alias("object_id"), F.when(flag == "A", "approved").otherwise("pending").alias("review_status"),
        F.when(flag == "N", "llm_relation").when(flag == "R", "candidate_relation").otherwise("deterministic_relation").alias("source"), F.col("l_discount").alias("confidence"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("evidence_span"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return linking.best_relations(r).select("subject_id", "relation_type", "object_id", "review_status", "source", "confidence", F.length("evidence_span").cast("long").alias("evidence_chars"), "ord")


@query("""
WITH a AS (SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS k, arg_max(r_name, n_nationkey) AS canonical_id FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Unknown' ELSE '  ' || n_name || '!' END AS label, (s_suppkey % 100) / 100.0 AS confidence FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, label, canonical_id, CASE WHEN canonical_id IS NULL THEN 'new' ELSE 'exact_alias' END AS match_type, CASE WHEN canonical_id IS NOT NULL AND confidence >= 0.85 THEN 'approved' ELSE 'pending' END AS review_status,
  CASE WHEN confidence >= 0.88 THEN 'central' WHEN confidence >= 0.7 THEN 'supporting' WHEN confidence >= 0.55 THEN 'background' ELSE 'passing' END AS salience FROM e LEFT JOIN a ON a.k = trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'))""")
def ontology_match(spark, sf_dir):
    s, n, r = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    aliases = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("alias"), F.col("r_name").alias("canonical_id"), F.col("n_nationkey").alias("ord"))
    e = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "Unknown").otherwise(F.concat(F.lit("  "), "n_name", F.lit("!"))).alias("label"), ((F.col("s_suppkey") % 100) / 100.0).alias("confidence"))
    out = linking.resolve(e, aliases)
    return out.select("s_suppkey", "label", "canonical_id", "match_type", linking.review_status(F.col("match_type"), F.col("confidence"), F.lit(False), F.lit("pending")).alias("review_status"), linking.salience(F.col("confidence")).alias("salience"))


@query("SELECT lower(p_brand) AS key, arg_min(p_brand, p_partkey) AS label FROM part GROUP BY 1")
def entity_labels(spark, sf_dir):
    return linking.first_spelling(read(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("ord")))


@query("""
WITH d AS (SELECT doc_id, unnest(range(0, CAST(ceil(n_chars / 500.0) AS BIGINT))) AS k FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM d)
SELECT doc_id, k FROM n WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda i: CAST(round_even(i * (n - 1) / 7.0, 0) AS BIGINT)), k)""")
def sampled_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("n_chars > 0")
    return linking.sampled_chunks(d.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_chars") / 500.0) - 1)).alias("k")))


@query()
def embed_hash(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", dedup.hash_embedding(F.col("p_name")).alias("v"))
    return p.select("p_partkey", F.size("v").alias("dim"), round4(square(F.col("v"))).alias("norm2"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def dedup_sequential(spark, sf_dir):
    """Documents as records of one version, the text's hash as DOI, no title: the first of each stays."""
    shared_folder(spark)
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.md5("text").alias("doi"), F.lit("").alias("title"), F.lit(1).alias("version"))
    return dedup.dedup_records(d).select(F.col("ord").alias("doc_id"))


@query()
def dedup_titles(spark, sf_dir):
    """Documents as records with titles (first lines) and versions, every second one with the text's hash as DOI: matched one after the other by DOI, else title."""
    shared_folder(spark)
    d = read(spark, sf_dir, "documents")
    records = d.select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 2 == 0, F.md5("text")).alias("doi"), F.split("text", "\n", 2)[0].alias("title"), (1 + F.col("n_chars") % 3).cast("int").alias("version"))
    return dedup.dedup_records(records).select(F.col("ord").alias("doc_id"))


@query()
def method_fuzzy_dedup(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    m = p.select(F.floor(F.col("p_partkey") / 25).alias("paper_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("label"), F.col("p_brand").alias("source_type"), F.col("p_type").alias("description"))
    return dedup.dedup_methods(m)


@query("SELECT lower(o_orderpriority) || '|' || (o_custkey % 100) AS key, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def first_per_key(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("ord", F.col("o_orderkey"))
    key = F.concat(F.lower("o_orderpriority"), F.lit("|"), F.col("o_custkey") % 100)
    return dedup.first_per_key(o, key).select(F.concat(F.lower("o_orderpriority"), F.lit("|"), F.col("o_custkey") % 100).alias("key"), F.col("o_orderkey").alias("first_order"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return streams.windowed_counts(read(spark, sf_dir, "events"))


@query("""
WITH k AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w > INTERVAL 2 HOUR, TRUE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM k)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    """Bursts of a user's events, two hours apart."""
    return streams.sessions(read(spark, sf_dir, "events"), gap="2 hours")


@query("""
WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS job_id, user_id AS paper_id, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, ts, event_id FROM events),
s AS (SELECT job_id, paper_id, arg_max(status, {'t': ts, 'e': event_id}) AS status, count(*) FILTER (WHERE status = 'processing') AS attempts FROM e GROUP BY ALL)
SELECT *, CASE WHEN ends_with(job_id, '3') THEN 'superseded' WHEN status = 'completed' THEN 'skip' WHEN paper_id % 7 = 0 THEN 'fail' WHEN status = 'failed' AND attempts >= 2 THEN 'give_up' WHEN status = 'failed' THEN 'retry' ELSE 'run' END AS action FROM s""")
def job_plan(spark, sf_dir):
    """What resumed jobs have to do: each day is a job, users are its papers, events what has become of them."""
    e = read(spark, sf_dir, "events")
    kinds = {"view": "processing", "click": "processing", "purchase": "completed", "error": "failed"}
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("queued"))
    log = e.select(F.to_date("ts").cast("string").alias("job_id"), F.col("user_id").alias("paper_id"), status.alias("status"), "ts", F.col("event_id").alias("seq"))
    requests = log.select("job_id", "paper_id", F.when(F.col("paper_id") % 7 != 0, F.concat(F.lit("/"), "paper_id")).alias("pdf_path"), F.col("seq").alias("ord"))
    gone = log.select("job_id", F.when(F.endswith("job_id", F.lit("3")), "superseded").otherwise("processing").alias("status")).distinct()
    return jobs.planned(requests, log, gone, most=2).select("job_id", "paper_id", "status", "attempts", "action")
