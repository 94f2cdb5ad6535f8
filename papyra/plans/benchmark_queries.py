"""Benchmarks, health and paper rules on the star schema, documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round4
from ..operators import benchmarks, extraction, papers
from ..operators.text_rules import sentence_rows
from .registry import bounded, query, read

_CASES = """
g AS (SELECT l_suppkey AS case_id, CASE WHEN l_linenumber % 2 = 0 THEN 'methods' ELSE 'concepts' END AS kind, l_orderkey * 10 + l_linenumber AS ord, 'kind ' || (l_partkey % 60) AS key, l_returnflag = 'A' AS gold, l_returnflag <> 'N' OR l_linestatus = 'F' AS found, CASE WHEN l_quantity > 25 THEN 'T' ELSE 'U' END AS type, 'c' || (l_partkey % 25) AS cid, l_linestatus = 'F' AS pending FROM lineitem),
s AS (SELECT case_id, kind, key, bool_or(gold) AS e, bool_or(found) AS p FROM g GROUP BY ALL),
c AS (SELECT case_id, kind, count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE NOT e AND p) AS fp, count(*) FILTER (WHERE e AND NOT p) AS fn FROM s GROUP BY ALL),
q AS (SELECT case_id, kind, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c),
w AS (SELECT case_id, round(max(precision) FILTER (WHERE kind = 'concepts'), 4) AS cp, round(max(recall) FILTER (WHERE kind = 'concepts'), 4) AS cr, round(max(precision) FILTER (WHERE kind = 'methods'), 4) AS mp, round(max(recall) FILTER (WHERE kind = 'methods'), 4) AS mr FROM q GROUP BY case_id),
v AS (SELECT x.case_id, round(avg(CASE WHEN x.v IS NOT DISTINCT FROM y.v THEN 1 ELSE 0 END), 4) AS acc FROM (SELECT case_id, key, arg_max(type, ord) AS v FROM g WHERE gold AND kind = 'concepts' GROUP BY ALL) x LEFT JOIN (SELECT case_id, key, arg_max(type, ord) AS v FROM g WHERE found AND kind = 'concepts' GROUP BY ALL) y USING (case_id, key) GROUP BY x.case_id),
d AS (SELECT case_id, round(avg(CASE WHEN n > 1 THEN 1 ELSE 0 END), 4) AS dup FROM (SELECT case_id, cid, count(DISTINCT key) AS n FROM g WHERE found AND kind = 'concepts' GROUP BY ALL) GROUP BY case_id),
p AS (SELECT case_id, round(avg(CAST(pending AS INT)), 4) AS pend, count(*) FILTER (WHERE kind = 'concepts') AS n FROM g WHERE found GROUP BY case_id),
r AS (SELECT s_suppkey AS case_id, coalesce(cp, 0) AS cp, coalesce(cr, 0) AS cr, coalesce(mp, 0) AS mp, coalesce(mr, 0) AS mr, coalesce(acc, 0) AS acc, coalesce(dup, 0) AS dup, coalesce(pend, 0) AS pend, s_suppkey % 10 = 0 AS warned, s_suppkey % 4 = 1 AS denied, coalesce(p.n, 0) AS n FROM supplier LEFT JOIN w ON w.case_id = s_suppkey LEFT JOIN v ON v.case_id = s_suppkey LEFT JOIN d ON d.case_id = s_suppkey LEFT JOIN p ON p.case_id = s_suppkey)"""


def _reports(spark, sf_dir):
    line, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    rows = line.select(
        F.col("l_suppkey").alias("case_id"), F.when(F.col("l_linenumber") % 2 == 0, "methods").otherwise("concepts").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit(" Kind-"), F.col("l_partkey") % 60).alias("label"), F.concat(F.lit("c"), F.col("l_partkey") % 25).alias("canonical_id"), none.alias("canonical_label"),
        F.when(F.col("l_quantity") > 25, "T").otherwise("U").alias("entity_type"), none.alias("source_type"), F.when(F.col("l_linestatus") == "F", "Pending").otherwise("approved").alias("review_status"), none.alias("subject"), none.alias("relation_type"), none.alias("object"), "l_returnflag", "l_linestatus",
    )
    cases = s.select(F.col("s_suppkey").alias("case_id"), F.when(F.col("s_suppkey") % 10 == 0, F.array(F.lit("w"))).alias("parser_warnings"))
    sides = F.array(F.struct(F.lit("gold").alias("side"), F.lit("yes").alias("negated")), F.struct(F.lit("found").alias("side"), F.when(F.col("s_suppkey") % 4 == 1, "no").otherwise("TRUE").alias("negated")))
    claims = s.select(F.col("s_suppkey").alias("case_id"), F.inline(sides)).withColumns({"ord": F.lit(1), "statement": F.lit("It does."), "attributed_to": F.lit("this_paper")})
    return benchmarks.case_reports(cases, rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag <> 'N' or l_linestatus = 'F'"), claims)


@query(f"""
WITH {_CASES}
SELECT case_id, cp AS concepts_precision, cr AS concepts_recall, mp AS methods_precision, mr AS methods_recall, acc AS entity_type_accuracy, dup AS duplicate_canonical_rate, pend AS pending_rate, CASE WHEN denied THEN 0.0 ELSE 1.0 END AS claim_negation_accuracy, CAST(warned AS INT) AS parser_warning_count, n AS accepted_concept_count FROM r""")
def benchmark_cases(spark, sf_dir):
    """A report for each supplier as a case."""
    return _reports(spark, sf_dir).select("case_id", "concepts_precision", "concepts_recall", "methods_precision", "methods_recall", "entity_type_accuracy", "duplicate_canonical_rate", "pending_rate", "claim_negation_accuracy", "parser_warning_count", "accepted_concept_count")


@query(f"""
WITH {_CASES}
SELECT count(*) AS case_count, round(avg(cp), 4) AS concept_precision, round(avg(cr), 4) AS concept_recall, round(avg(mp), 4) AS method_precision, round(avg(dup), 4) AS duplicate_canonical_rate, round(avg(pend), 4) AS pending_rate, round(avg(CASE WHEN denied THEN 0 ELSE 1 END), 4) AS claim_negation_accuracy,
  count(*) FILTER (WHERE denied) AS claim_negation_error_count, avg(cp) >= 0.85 AS passes_precision_gate, avg(dup) <= 0.05 AS passes_duplicate_gate, NOT bool_or(warned) AS passes_parser_gate, NOT bool_or(denied) AS passes_claim_gate FROM r""")
def benchmark_summary(spark, sf_dir):
    out = benchmarks.benchmark_summary(_reports(spark, sf_dir))
    return out.select("case_count", "concept_precision", "concept_recall", "method_precision", "duplicate_canonical_rate", "pending_rate", "claim_negation_accuracy", "claim_negation_error_count", "passes_precision_gate", "passes_duplicate_gate", "passes_parser_gate", "passes_claim_gate")


_STEM = "CASE WHEN w IN ('grade', 'graded', 'grader', 'graders', 'grading') THEN 'grade' WHEN w IN ('rate', 'rated', 'rates', 'rater', 'raters', 'rating', 'ratings') THEN 'rate' WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"
_STEMS = f"list_transform(regexp_extract_all({{x}}, '[a-z0-9]+'), lambda w: {_STEM})"
_ANSWERS = f"""
a AS (SELECT doc_id AS id, text || CASE doc_id % 3 WHEN 0 THEN ' [p1, p' || (doc_id % 10) || ']' WHEN 1 THEN ' [12; zz]' ELSE '' END AS answer, doc_id % 10 AS k FROM documents),
f AS (SELECT *, trim(regexp_replace(regexp_replace(lower(answer), '[-_/]+', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM a),
n AS (SELECT *, {_STEMS.format(x="t")} AS own FROM f),
u AS (SELECT *, k <> 1 AND k <> 2 AND NOT regexp_matches(answer, '\\[([^\\]]*[,;][ ]*)?p2([,;][^\\]]*)?\\]') AS no_source,
  list_filter(['anea ands', 'raters|onlies', 'zz-q'], lambda x: NOT list_bool_or(list_transform(list_transform(string_split(x, '|'), lambda o: replace(o, '-', ' ')), lambda o: contains(t, o) OR contains(replace(t, ' ', ''), replace(o, ' ', '')) OR len(list_filter({_STEMS.format(x="o")}, lambda s: NOT list_contains(own, s))) = 0))) AS missing_terms,
  contains(t, 'idiot') AS forbidden, list_filter(list_transform(string_split(replace(array_to_string(regexp_extract_all(answer, '\\[([^\\]]+)\\]', 1), ','), ';', ','), ','), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(arxiv:|doi:|p)')) AS invalid FROM n),
e AS (SELECT id, CASE WHEN no_source THEN 0.0 ELSE 1.0 END AS sources_part, (3 - len(missing_terms)) / 3 AS terms_part, CASE WHEN forbidden THEN 0.0 ELSE 1.0 END AS forbidden_part, CASE WHEN len(invalid) > 0 THEN 0.0 ELSE 1.0 END AS citations_part, CASE WHEN id % 9 = 0 THEN 0.0 ELSE 1.0 END AS generation_part, len(missing_terms) AS n_missing FROM u),
z AS (SELECT *, (sources_part + terms_part + forbidden_part + citations_part + generation_part) / 5 AS raw FROM e)"""


def _evaluated(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 10
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" [p1, p"), k, F.lit("]"))).when(F.col("doc_id") % 3 == 1, " [12; zz]").otherwise(""))
    cases = d.select(F.col("doc_id").alias("id"), F.array(F.lit("p2")).alias("expected_sources"), F.array(*map(F.lit, ("anea ands", "raters|onlies", "zz-q"))).alias("required_terms"), F.array(F.lit("idiot")).alias("forbidden_terms"))
    answers = d.select(F.col("doc_id").alias("id"), said.alias("answer"), F.when(k == 1, F.array(F.lit("p2"))).when(k == 2, F.array(F.lit("p9"), F.lit("p2"))).otherwise(F.array(F.lit("p3"))).alias("sources"), F.when(F.col("doc_id") % 18 == 0, "late").alias("generation_error"), (F.col("doc_id") % 18 == 9).alias("no_answer"))
    return benchmarks.evaluated_answers(cases, answers)


@query(f"WITH {_ANSWERS} SELECT id, round(raw, 4) AS score, raw = 1.0 AS passes, sources_part, round(terms_part, 4) AS terms_part, forbidden_part, citations_part, generation_part, CAST(n_missing AS INTEGER) AS n_missing FROM z")
def evaluated_answers(spark, sf_dir):
    """Documents as answers, scored in five parts that are taken from their texts."""
    e = _evaluated(spark, sf_dir)
    return e.select("id", "score", "passes", "sources_part", round4(F.col("terms_part")).alias("terms_part"), "forbidden_part", "citations_part", "generation_part", F.size("missing_terms").alias("n_missing"))


@query(f"""
WITH {_ANSWERS}
SELECT round(avg(round(raw, 4)), 4) AS average_score, count(*) FILTER (WHERE raw = 1.0) AS pass_count, count(*) AS case_count, md5(string_agg(CASE WHEN citations_part < 1 THEN id END, ',' ORDER BY id)) AS invalid_citations, md5(string_agg(CASE WHEN sources_part < 1 THEN id END, ',' ORDER BY id)) AS missing_sources,
  md5(string_agg(CASE WHEN n_missing > 0 THEN id END, ',' ORDER BY id)) AS missing_terms, md5(coalesce(string_agg(CASE WHEN forbidden_part < 1 THEN id END, ',' ORDER BY id), '')) AS forbidden, md5(string_agg(CASE WHEN generation_part < 1 THEN id END, ',' ORDER BY id)) AS errors FROM z""")
def answers_summary(spark, sf_dir):
    s = benchmarks.answers_summary(_evaluated(spark, sf_dir))
    ids = lambda c: F.md5(F.array_join(c, ","))
    return s.select("average_score", "pass_count", "case_count", ids("invalid_citation_cases").alias("invalid_citations"), ids("missing_source_cases").alias("missing_sources"), ids("missing_term_cases").alias("missing_terms"), ids("forbidden_hit_cases").alias("forbidden"), ids("generation_error_cases").alias("errors"))


@query("""
SELECT (SELECT count(*) FROM customer) AS papers_total, (SELECT count(*) FROM orders) AS extractions_total, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS papers_with_success, (SELECT count(*) FROM events WHERE event_type = 'error') AS review_pending, (SELECT count(DISTINCT label) FROM embeddings) AS embedding_models,
  round((SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') / (SELECT count(*) FROM customer), 4) AS paper_success_coverage,
  concat_ws(',', CASE WHEN (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') / (SELECT count(*) FROM customer) < 0.8 THEN 'low_coverage' END, CASE WHEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 0 THEN 'failed_extractions' END, 'retracted_papers', 'duplicate_dois') AS warnings, 'warning' AS status""")
def health_report(spark, sf_dir):
    """The whole report: customers as papers, orders as extractions, errors as the review queue."""
    c, o, e, v = (read(spark, sf_dir, n) for n in ("customer", "orders", "events", "embeddings"))
    p = c.select(F.lit(True).alias("has_full_text"), (F.col("c_custkey") % 50 == 0).alias("retracted"), F.lit(False).alias("conflict_flag"), F.col("c_name").alias("title"), F.lit(2020).alias("year"), F.lit(0.1).cast("float").alias("obsolescence_score"), F.col("c_mktsegment").alias("doi"))
    x = o.select(F.col("o_custkey").alias("paper_id"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "failed").otherwise("open").alias("extraction_status"), F.lit(1.0).alias("extraction_duration_seconds"), F.col("o_orderdate").alias("extraction_timestamp"))
    out = benchmarks.health_report(p, x, e.select(F.when(F.col("event_type") == "error", "pending").otherwise("approved").alias("review_status")), v.select(F.col("label").alias("model"), F.lit(1).alias("embedding_version")), e.select(F.col("event_type").alias("status")), e.select(F.col("event_type").alias("parse_quality"), F.col("value").alias("duration_seconds")))
    return out.select("papers_total", "extractions_total", F.col("extractions_papers_with_success").alias("papers_with_success"), "review_pending", "embedding_models", "paper_success_coverage", F.array_join("warnings", ",").alias("warnings"), "status")


@query("""
WITH m AS (SELECT o_custkey AS id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'unknown' END, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1),
f AS (SELECT c_custkey AS id, c_name AS title, latest FROM customer LEFT JOIN m ON m.id = c_custkey WHERE c_nationkey % 2 = 0 AND c_acctbal > 0 AND latest = 'success' AND contains(lower(c_custkey || ' ' || c_name || ' ' || c_mktsegment), '1')),
p AS (SELECT *, count(*) OVER () AS total FROM f ORDER BY lower(title) DESC, id LIMIT 40 OFFSET 10)
SELECT id, latest AS latest_extraction_status, total, CAST((SELECT count(DISTINCT n_regionkey) FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey = p.id) AS INTEGER) AS n_projects FROM p""")
def paper_page(spark, sf_dir):
    """A page of customers as papers of projects (regions), with full text (money), whose last order was filled."""
    c, o, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), read(spark, sf_dir, "nation")
    p = c.select(F.col("c_custkey").alias("id"), F.lit("").alias("source_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("abstract"), F.lit(None).cast("string").alias("doi"), F.lit(2000).alias("year"), (F.col("c_acctbal") > 0).alias("has_full_text"), F.lit(None).cast("timestamp").alias("added_timestamp"))
    region = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").cast("string").alias("project_id"), F.col("c_custkey").alias("paper_id"))
    even = c.filter("c_nationkey % 2 = 0").select(F.lit("even").alias("project_id"), F.col("c_custkey").alias("paper_id"))
    x = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("paper_id"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "failed").otherwise("").alias("extraction_status"), F.col("o_orderdate").alias("extraction_timestamp"))
    out = papers.paper_page(p, region.union(even), x, query="1", project="even", full_text=True, status="success", sort="title_desc", limit=40, offset=10)
    return out.select("id", "latest_extraction_status", "total", (F.size("project_ids") - 1).alias("n_projects"))


@query("""
WITH q AS (SELECT event_id AS id, event_type AS label, ts FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 500)
SELECT id, label FROM q WHERE contains(label, 'ick')""")
def review_page(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "approved").otherwise("pending").alias("review_status"), F.col("ts").alias("created_timestamp"), F.col("event_type").alias("label"), F.lit("s").alias("suggested_canonical"), F.lit("z").alias("paper_id"))
    return papers.review_page(e, query="ICK", limit=500).select("id", "label")


@query("""
WITH x AS (SELECT o_orderkey AS id, 10 + o_custkey % 85 AS yy, o_orderkey % 14 AS m, CASE WHEN o_orderkey % 5 > 0 THEN 1995 + o_custkey % 30 END AS said FROM orders), k AS (SELECT *, CASE WHEN m BETWEEN 1 AND 12 THEN CASE WHEN yy < 90 THEN 2000 + yy ELSE 1900 + yy END END AS year FROM x)
SELECT id, 'arxiv:' || yy || lpad(CAST(m AS VARCHAR), 2, '0') || '.00001' AS paper_id, CAST(CASE WHEN year IS NOT NULL AND (said IS NULL OR abs(year - said) > 2) THEN year ELSE said END AS INTEGER) AS paper_year, CAST(CASE WHEN abs(year - said) > 2 THEN said END AS INTEGER) AS llm_paper_year, 'valid' AS metadata_status,
  CASE WHEN abs(year - said) > 2 THEN 'model_year_differs_from_id' ELSE '' END AS identity_warnings FROM k""")
def settled_papers(spark, sf_dir):
    """Years that a model said, settled against those of ids."""
    o = read(spark, sf_dir, "orders")
    digits = F.concat((10 + F.col("o_custkey") % 85).cast("string"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("file arXiv: "), digits, F.lit(".00001v3")).alias("paper_id"), F.lit("").alias("text"), F.lit("Survey").alias("paper_type"), F.lit("t").alias("title"), F.when(F.col("o_orderkey") % 5 > 0, 1995 + F.col("o_custkey") % 30).alias("paper_year"))
    out = papers.metadata_checks(papers.paper_node(rows))
    return out.select("id", "paper_id", "paper_year", "llm_paper_year", "metadata_status", F.array_join("identity_warnings", ",").alias("identity_warnings"))


@query("""
SELECT doc_id, concat_ws(',', CASE doc_id % 3 WHEN 1 THEN 'partial_recovery' WHEN 2 THEN 'failed_calls' END, CASE WHEN n_chars >= 20000 AND doc_id % 40 < 12 THEN 'few_concepts' END, CASE WHEN doc_id % 4 = 0 AND doc_id % 40 < 30 THEN 'few_concepts_for_survey' END, CASE WHEN n_chars >= 20000 AND doc_id % 5 = 0 THEN 'no_methods' END) AS warnings FROM documents""")
def quality_warnings(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    rows = d.select("doc_id", F.when(i % 4 == 0, "survey").otherwise("research").alias("paper_type"), (i % 40).alias("concept_count"), (i % 5).alias("method_count"), F.col("n_chars").alias("text_length"), F.when(i % 3 == 1, "partial").when(i % 3 == 2, "failed").otherwise("clean").alias("parse_quality"))
    return papers.quality_warnings(rows).select("doc_id", F.array_join("warnings", ",").alias("warnings"))


@query("""
WITH r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'boom' WHEN 'click' THEN 'every call failed' WHEN 'view' THEN 'no model loaded' END AS e FROM events)
SELECT event_id, coalesce(e, '') AS error_message, CASE WHEN e IS NULL THEN 'success' ELSE 'failed' END AS extraction_status FROM r""")
def saved_extractions(spark, sf_dir):
    """Raw replies by event: fatal errors, failed calls, replies with something to show."""
    e = read(spark, sf_dir, "events")
    calls = '"parse_quality": "failed", "calls": [{"call_type": "a", "parse_quality": "failed", "raw_excerpt": "%s"}, {"call_type": "claims_retry", "parse_quality": "clean"}]'
    raw = F.when(F.col("event_type") == "error", '{"fatal_llm_error": true, "failure_reason": " boom "}').when(F.col("event_type") == "click", "{" + calls % "" + "}").when(F.col("event_type") == "view", "{" + calls % "No models loaded" + "}").when(F.col("event_type") == "purchase", "{" + calls % "" + ', "concepts": [{"label": "x"}]}').otherwise("no json")
    out = papers.saved_extractions(e.select("event_id", raw.alias("raw_response"), F.lit(None).cast("string").alias("error_message")))
    return out.select("event_id", F.coalesce("error_message", F.lit("")).alias("error_message"), "extraction_status")


_CLAIM = ["limitation", "negative_result", "comparison", "recommendation", "contribution"]


def _claim_sql() -> str:
    from ..functions import text

    kinds = " ".join(f"WHEN regexp_matches(s, '{bounded(p)}') THEN '{t}'" for t, p in text.CLAIM_MARKS.items())
    return f"""
WITH c AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'this does not work than that' WHEN 1 THEN 'we propose it without significant loss' WHEN 2 THEN 'it is limited' WHEN 3 THEN 'you should go' WHEN 4 THEN 'a present thing' ELSE lower(coalesce(text, '')) END AS s FROM conversations),
k AS (SELECT *, CASE WHEN turn % 11 = 3 THEN 'finding' ELSE CASE {kinds} ELSE 'finding' END END AS claim_type FROM c)
SELECT conv_id, turn, claim_type, CASE WHEN regexp_matches(s, '{bounded(text.NO_LOSS)}') THEN FALSE WHEN regexp_matches(s, '{bounded(text.DENIAL)}') THEN TRUE WHEN claim_type IN ('limitation', 'negative_result') THEN FALSE ELSE turn % 2 = 0 END AS negated FROM k"""


@query(_claim_sql())
def claim_types(spark, sf_dir):
    """Types and negation of claims, some of which say their own."""
    from ..functions import text

    c = read(spark, sf_dir, "conversations")
    t = F.col("turn") % 6
    said = F.coalesce(*[F.when(t == i, x) for i, x in enumerate(("This does not work than that", "We propose it without significant loss", "It is limited", "You should go", "A present thing"))], F.coalesce("text", F.lit("")))
    rows = c.select("conv_id", "turn", said.alias("s"), F.when(F.col("turn") % 11 == 3, " Finding ").otherwise("guess").alias("given"))
    rows = rows.withColumn("claim_type", text.claim_type(F.col("s"), F.col("given")))
    return rows.select("conv_id", "turn", "claim_type", text.negated(F.col("s"), F.col("claim_type"), F.col("turn") % 2 == 0).alias("negated"))


@query("""
WITH s AS (SELECT doc_id, regexp_extract_all(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) || ' ', '[^.!?]+(?:[.!?]+\\s|$)') AS x FROM documents)
SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS ord, md5(trim(unnest(x))) AS sentence_md5 FROM (SELECT doc_id, list_filter(x, lambda y: trim(y) <> '') AS x FROM s)""")
def sentences(spark, sf_dir):
    return sentence_rows(read(spark, sf_dir, "documents"))


@query("""
WITH x AS (SELECT doc_id, regexp_replace(text, 'https?://[^ ]*', 'loss function', 'g') AS t FROM documents)
SELECT doc_id, kind FROM (SELECT doc_id, unnest([CASE WHEN regexp_matches(lower(t), '\\b(equation|formula)\\b|\\$[^$]{1,300}\\$|\\\\\\[(?s:.){1,600}?\\\\\\]|\\\\begin\\{equation\\}') THEN 'formula' END, CASE WHEN regexp_matches(lower(t), '\\b(loss function|objective function)\\b|\\barg\\s*max\\b|\\barg\\s*min\\b') THEN 'optimization_objective' END, CASE WHEN regexp_matches(lower(t), '\\btable\\s+[0-9]+\\b') THEN 'table' END, CASE WHEN regexp_matches(lower(t), '\\b(bayesian|probabilistic)\\b|\\bp\\s*\\(\\s*[^)]+\\s*\\)') THEN 'probabilistic_model' END, CASE WHEN regexp_matches(lower(t), '\\b(theorem|proof)\\b') THEN 'theorem' END, CASE WHEN regexp_matches(lower(t), '\\breward function\\b|\\br\\s*\\(\\s*s\\s*,\\s*a') THEN 'reward_function' END, CASE WHEN regexp_matches(lower(t), '\\bvalue function\\b|\\bv\\s*\\(\\s*s\\s*\\)|\\bq\\s*\\(\\s*s\\s*,\\s*a\\s*\\)') THEN 'value_function' END]) AS kind FROM x) WHERE kind IS NOT NULL""")
def math_content(spark, sf_dir):
    """Kinds of mathematical content of texts, whose addresses speak of a loss function here."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "https?://[^ ]*", "loss function").alias("t"))
    return d.select("doc_id", F.explode(extraction.math_content(F.col("t"))).alias("kind"))
