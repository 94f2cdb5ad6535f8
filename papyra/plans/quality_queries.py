"""Health, benchmark and answer scoring on the star schema, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ratio, round4
from ..operators import quality
from .registry import query, read


@query("""
WITH d AS (SELECT count(*) AS g FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))
SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS with_full_text, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS retracted, count(*) FILTER (WHERE o_totalprice > 300000) AS conflicts,
  CAST(0 AS BIGINT) AS missing_title, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS missing_year, count(*) FILTER (WHERE CAST((o_orderkey % 100) / 100.0 AS FLOAT) >= CAST(0.6 AS FLOAT)) AS high_obsolescence, (SELECT g FROM d) AS duplicate_doi_groups,
  round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS full_text_coverage FROM orders""")
def health_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    p = o.select(
        (F.col("o_orderstatus") == "F").alias("has_full_text"), F.col("o_orderpriority").like("1%").alias("retracted"), (F.col("o_totalprice") > 300000).alias("conflict_flag"), F.lit("t").alias("title"),
        F.when(F.col("o_orderkey") % 11 != 0, F.year("o_orderdate")).alias("year"), ((F.col("o_orderkey") % 100) / 100.0).cast("float").alias("obsolescence_score"), F.col("o_custkey").cast("string").alias("doi"),
    )
    return quality.paper_health(p)


@query("""
SELECT count(*) AS total, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS papers_with_success, round(avg(round(value * 100)) , 4) AS avg_value, max(ts) AS latest,
  round(count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) / 1000, 4) AS paper_success_coverage FROM events""")
def extraction_health(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("s"), F.col("user_id").alias("paper_id"), F.round(F.col("value") * 100).alias("extraction_duration_seconds"), F.col("ts").alias("extraction_timestamp"))
    rows = e.withColumn("extraction_status", F.when(F.col("s") == "purchase", "success").otherwise(F.col("s")))
    return quality.extraction_health(rows, 1000).withColumnRenamed("avg_duration_seconds", "avg_value")


@query("SELECT coalesce(nullif(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, ''), 'unknown') AS key, count(*) AS n FROM events GROUP BY 1")
def group_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("s", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")))
    return quality.group_counts(e, "s")


@query("SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return quality.duplicate_groups(read(spark, sf_dir, "documents"), F.md5("text"))


@query("""
WITH g AS (SELECT d.lang, d.doc_id, l.quality = 1 AS e, d.n_chars > 1000 AS p FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE NOT e AND p) AS fp, count(*) FILTER (WHERE e AND NOT p) AS fn FROM g WHERE e OR p GROUP BY lang)
SELECT lang, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 4) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 4) END AS f1 FROM c""")
def prf_report(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("lang", "doc_id", "quality", "n_chars")
    return quality.prf(d.filter("quality = 1"), d.filter("n_chars > 1000"), ["doc_id"], ["lang"])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS correct, round(count(*) FILTER (WHERE quality = toxic) / count(*), 4) AS accuracy FROM labels")
def field_accuracy(spark, sf_dir):
    lab = read(spark, sf_dir, "labels")
    return quality.field_accuracy(lab.select("doc_id", F.col("quality").alias("v")), lab.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("""
WITH g AS (SELECT lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS c, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1)
SELECT count(*) AS n_canonical, count(*) FILTER (WHERE n > 1) AS n_duplicate, round(count(*) FILTER (WHERE n > 1) / count(*), 4) AS rate FROM g""")
def duplicate_canonical(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return quality.duplicate_canonical_rate(d, F.md5(F.lower(F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " ")))), F.col("doc_id"))


@query("""
WITH p AS (SELECT doc_id AS id, n_chars > 50 AS has_answer, quality = 1 AS has_sources, contains(replace(lower(text), '-', ' '), 'the ') AS has_terms, toxic = 0 AS no_forbidden, doc_id % 9 <> 0 AS no_error FROM documents JOIN labels USING (doc_id)),
s AS (SELECT *, CAST(has_answer AS INT) + CAST(has_sources AS INT) + CAST(has_terms AS INT) + CAST(no_forbidden AS INT) + CAST(no_error AS INT) AS k FROM p)
SELECT id, has_answer, has_sources, has_terms, no_forbidden, no_error, round(k / 5, 4) AS score, k = 5 AS passed FROM s""")
def answer_score(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    parts = d.select(F.col("doc_id").alias("id"), (F.col("n_chars") > 50).alias("has_answer"), (F.col("quality") == 1).alias("has_sources"), F.contains(F.replace(F.lower("text"), F.lit("-"), F.lit(" ")), F.lit("the ")).alias("has_terms"), (F.col("toxic") == 0).alias("no_forbidden"), (F.col("doc_id") % 9 != 0).alias("no_error"))
    return quality.answer_scores(parts)


@query("""
WITH e AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 END AS r FROM events)
SELECT user_id, day, CASE WHEN max(r) IS NULL THEN 'skipped' WHEN max(r) = 3 AND bool_or(r IN (0, 1)) THEN 'partial' ELSE list_extract(['clean', 'trimmed', 'partial', 'failed'], CAST(max(r) + 1 AS BIGINT)) END AS parse_quality FROM e GROUP BY user_id, day""")
def worst_parse_by_day(spark, sf_dir):
    """The worst parse of each user and day."""
    q = F.when(F.col("event_type") == "view", "clean").when(F.col("event_type") == "click", "trimmed").when(F.col("event_type") == "signup", "partial").when(F.col("event_type") == "error", "failed").otherwise("skipped")
    e = read(spark, sf_dir, "events").select(F.struct("user_id", F.to_date("ts").cast("string").alias("day")).alias("key"), q.alias("q"))
    return quality.worst_parse(e, "key", "q").select("key.user_id", "key.day", "parse_quality")


@query("SELECT o_custkey AS project_id, count(*) AS n_papers, CAST(min(year(o_orderdate)) AS INTEGER) AS min_year, CAST(max(year(o_orderdate)) AS INTEGER) AS max_year, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS coverage FROM orders GROUP BY 1")
def project_dashboard(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    out = o.groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("n_papers"), F.min(F.year("o_orderdate")).alias("min_year"), F.max(F.year("o_orderdate")).alias("max_year"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return out.withColumn("coverage", ratio(F.col("f"), F.col("n_papers"))).drop("f")


@query("""
WITH t AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders)
SELECT total, round(f / total, 4) AS coverage, concat_ws(',', CASE WHEN f / total < 0.9 THEN 'low_coverage' END, CASE WHEN p > 0 THEN 'pending_reviews' END) AS warnings, CASE WHEN f / total < 0.9 OR p > 0 THEN 'warning' ELSE 'ok' END AS status FROM t""")
def health_warnings(spark, sf_dir):
    o = read(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    out = quality.warnings(o.withColumn("coverage", round4(F.col("f") / F.col("total"))), [("low_coverage", F.col("f") / F.col("total") < 0.9), ("pending_reviews", F.col("p") > 0)])
    return out.select("total", "coverage", F.array_join("warnings", ",").alias("warnings"), "status")
