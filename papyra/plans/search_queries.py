"""Search over papers and extractions, answers, hypotheses and verification on documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round4
from ..operators import answers, search, search_index, verification
from .registry import derived, query, read
from .text_queries import _tokens


def _papers(spark, sf_dir):
    """Whole documents as papers: the first 60 characters are the title, the rest the abstract."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("paper_id"), F.substring("text", 1, 60).alias("title"), F.substr("text", F.lit(61)).alias("abstract"), F.col("source").alias("doi"))


def _items(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "claim").when(F.col("role") == "assistant", "concept").otherwise("method")
    return c.select(F.col("conv_id").alias("paper_id"), kind.alias("kind"), F.col("turn").alias("ord"), "text")


def _index(spark, sf_dir):
    return derived(spark, sf_dir, "papers and items", lambda path: search_index.build(search.search_units(_papers(spark, sf_dir), _items(spark, sf_dir)), path))


def _evidence_sql(words: list[str]) -> str:
    """Scores of all evidence for words, none of which is common or follows another in a text."""
    own = lambda x: f"list_intersect(list_distinct({_tokens(x)}), [{', '.join(repr(w) for w in words)}])"
    part = lambda c, w: f"{w} * coalesce(list_sum(list_transform({c}, lambda t: w[t])), 0)"
    return f"""
b AS (SELECT doc_id AS paper_id, 'paper' AS kind, 0 AS ord, {own("substr(text, 1, 60)")} AS a1, {own("substr(text, 61)")} AS a2, {own("source")} AS a3 FROM documents
  UNION ALL SELECT conv_id, CASE role WHEN 'user' THEN 'claim' WHEN 'assistant' THEN 'concept' ELSE 'method' END, turn, {own("coalesce(text, '')")}, [], [] FROM conversations),
k AS (SELECT unnest([{', '.join(repr(w) for w in words)}]) AS t), n AS (SELECT count(DISTINCT paper_id) AS n FROM b),
f AS (SELECT map_from_entries(list((t, 1.0 + ln(((SELECT n FROM n) + 1.0) / ((SELECT count(DISTINCT paper_id) FROM b WHERE list_contains(a1, t) OR list_contains(a2, t) OR list_contains(a3, t)) + 1.0))))) AS w FROM k),
s AS (SELECT paper_id, kind, ord, list_distinct(a1 || a2 || a3) AS own, CASE WHEN kind = 'paper' THEN {part("a1", 4.0)} + {part("a2", 1.5)} + {part("a3", 2.0)} ELSE CASE kind WHEN 'claim' THEN 2.5 ELSE 3.0 END * coalesce(list_sum(list_transform(a1, lambda t: w[t])), 0) END AS score FROM b, f),
e AS (SELECT paper_id, kind, CAST(ord AS BIGINT) AS ord, own, score FROM s WHERE score > 0)"""


@query(f"WITH {_evidence_sql(['anea', 'attion', 'idiot'])} SELECT paper_id, kind, ord, round(score, 4) AS score FROM e")
def search_evidence(spark, sf_dir):
    """All evidence for a query in titles, abstracts and extracted items, by the weights of its fields."""
    e = search.evidence(_index(spark, sf_dir), "anea of attion, idiot")
    return e.select("paper_id", "kind", "ord", round4(F.col("score")).alias("score"))


@query(f"""
WITH RECURSIVE {_evidence_sql(['anea', 'attion', 'idiot'])},
h AS (SELECT paper_id, round(sum(score), 4) AS score, count(*) AS n_evidence, list_distinct(flatten(list(own))) AS own FROM e GROUP BY paper_id),
m AS (SELECT *, CAST(list_contains(own, 'anea') AS INT) + 2 * CAST(list_contains(own, 'attion') AS INT) + 4 * CAST(list_contains(own, 'idiot') AS INT) AS m FROM h),
p(step, paper_id, covered) AS (
  SELECT 0, CAST(NULL AS BIGINT), 0
  UNION ALL
  SELECT p.step + 1, b.paper_id, p.covered | b.m FROM p, LATERAL (SELECT m.paper_id, m.m FROM m WHERE (m.m & ~p.covered) <> 0 ORDER BY bit_count(m.m & ~p.covered) DESC, m.score DESC, m.paper_id LIMIT 1) b WHERE p.step < 3),
r AS (SELECT m.*, row_number() OVER (ORDER BY p.step NULLS LAST, m.score DESC, m.paper_id) AS rank FROM m LEFT JOIN p ON p.paper_id = m.paper_id)
SELECT CAST(rank AS INTEGER) AS rank, paper_id, n_evidence FROM r WHERE rank <= 30""")
def kg_search(spark, sf_dir):
    """The best 30 papers for a query of three words, those first that cover them."""
    return search.search(_index(spark, sf_dir), "anea of attion, idiot", limit=30).select("rank", "paper_id", "n_evidence")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
k AS (SELECT * FROM r WHERE n <= 50), l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) AS m FROM k)
SELECT c_custkey AS id, c_name AS title, o_orderkey AS latest_id, (SELECT count(*) FROM k WHERE k.o_custkey = c_custkey) AS n_extractions FROM customer LEFT JOIN (SELECT * FROM l WHERE m = 1) l ON o_custkey = c_custkey""")
def paper_detail(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("paper_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("extraction_status"), F.col("o_orderdate").alias("extraction_timestamp"))
    out = search.paper_detail(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), e)
    return out.select("id", "title", F.col("latest.id").alias("latest_id"), "n_extractions")


_ANSWER = r"""
v AS (SELECT CAST(conv_id + 1 AS INTEGER) AS hit_rank, turn AS ord, 'p' || conv_id AS paper_id, CASE role WHEN 'user' THEN 'claim' WHEN 'assistant' THEN 'method' ELSE 'concept' END AS kind, substr(coalesce(text, ''), 1, 80) AS text, (length(coalesce(text, '')) % 50) / 10.0 AS score FROM conversations),
b AS (SELECT * FROM v ORDER BY score DESC, hit_rank, ord, paper_id, kind, text LIMIT 24),
i AS (SELECT 'p' || (doc_id % 50) AS paper_id, CASE WHEN doc_id % 2 = 0 THEN 'relation' ELSE 'claim' END AS kind, doc_id AS ord, substr(text, 1, 60) AS text FROM documents WHERE trim(substr(text, 1, 60)) <> ''),
m AS (SELECT min(h.hit_rank) AS hit_rank, min(i.ord) + 1000000 AS ord, i.paper_id, i.kind, i.text FROM i JOIN (SELECT DISTINCT paper_id, hit_rank FROM v WHERE hit_rank <= 3) h USING (paper_id) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.paper_id = i.paper_id AND b.kind = i.kind AND b.text = i.text) GROUP BY i.paper_id, i.kind, i.text),
u AS (SELECT *, CASE WHEN regexp_matches(text, '[0-9]') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(lower(text), '\b(ai consult|clinical|clinician|physician|patient|diagnos|treatment)\b') THEN 1.5 ELSE 0.0 END AS s FROM (SELECT * FROM b UNION ALL SELECT hit_rank, ord, paper_id, kind, text, NULL FROM m)),
w AS (SELECT hit_rank, ord, paper_id, kind, text, coalesce(score, CASE kind WHEN 'claim' THEN 7.0 ELSE 4.5 END + s) + CASE kind WHEN 'claim' THEN 3.0 WHEN 'relation' THEN 2.0 WHEN 'method' THEN 1.0 ELSE 0.5 END + s AS answer_score FROM u),
z AS (SELECT * FROM w ORDER BY answer_score DESC, hit_rank, ord, paper_id, kind, text LIMIT 24)"""


def _answer_evidence(spark, sf_dir):
    c, d = read(spark, sf_dir, "conversations"), read(spark, sf_dir, "documents")
    said = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("role") == "user", "claim").when(F.col("role") == "assistant", "method").otherwise("concept")
    e = c.select((F.col("conv_id") + 1).cast("int").alias("hit_rank"), F.col("turn").alias("ord"), F.concat(F.lit("p"), "conv_id").alias("paper_id"), kind.alias("kind"), F.substring(said, 1, 80).alias("text"), ((F.length(said) % 50) / 10.0).alias("score"))
    items = d.select(F.concat(F.lit("p"), F.col("doc_id") % 50).alias("paper_id"), F.when(F.col("doc_id") % 2 == 0, "relation").otherwise("claim").alias("kind"), F.col("doc_id").alias("ord"), F.substring("text", 1, 60).alias("text"))
    return answers.evidence_for_answer(e, items)


@query(f"WITH {_ANSWER} SELECT hit_rank, ord, paper_id, kind, text, round(answer_score, 4) AS answer_score FROM z")
def answer_evidence(spark, sf_dir):
    """What an answer may quote: the best evidence, and what the first papers' extractions say besides."""
    return _answer_evidence(spark, sf_dir).select("hit_rank", "ord", "paper_id", "kind", "text", round4(F.col("answer_score")).alias("answer_score"))


@query(rf"""
WITH {_ANSWER}, t AS (SELECT *, row_number() OVER (ORDER BY answer_score DESC, hit_rank, ord, paper_id, kind, text) AS k FROM z)
SELECT 'what?' AS question, 'Local KG evidence for ''what?'':' || chr(10) || string_agg('- [' || paper_id || '] ' || CASE WHEN regexp_matches(paper_id, '[02468]$') THEN 'On ' || paper_id ELSE paper_id END || ': ' || regexp_replace(text, '\[[ \t\r\n]*([^\]p][^\]]*?)[ \t\r\n]*\]', '(\1)', 'g'), chr(10) ORDER BY k) AS answer, FALSE AS no_answer FROM t WHERE k <= 5""")
def grounded_answer(spark, sf_dir):
    """An answer that quotes its five best pieces of evidence, by the titles of papers that have one."""
    e = _answer_evidence(spark, sf_dir)
    title = F.when(F.col("paper_id").rlike("[02468]$"), F.concat(F.lit("On "), "paper_id")).otherwise("")
    return answers.extractive_answer("what?", e, e.select("paper_id", title.alias("title")).distinct())


@query("""
WITH v AS (SELECT CAST(conv_id AS INTEGER) AS hit_rank, turn AS ord, conv_id AS paper_id, CASE role WHEN 'user' THEN 'method' WHEN 'assistant' THEN 'concept' ELSE 'cross_domain_hint' END AS kind, regexp_extract(coalesce(text, ''), '^[^ ]+') AS label, CASE WHEN conv_id % 2 = 0 THEN 'f' || (conv_id % 7) END AS field, (turn % 5) / 2.0 AS score FROM conversations),
h AS (SELECT 'hint' AS kind, CAST(paper_id AS VARCHAR) AS subject, coalesce(field, 'another field') AS field, 1 AS n_papers, score + 1 AS score FROM v WHERE kind = 'cross_domain_hint'),
n AS (SELECT *, lower(label) AS key, row_number() OVER (PARTITION BY lower(label) ORDER BY hit_rank, ord, paper_id) AS k FROM v WHERE kind IN ('method', 'concept') AND label <> ''),
s AS (SELECT 'shared' AS kind, key AS subject, NULL AS field, count(DISTINCT paper_id) AS n_papers, sum(score) FILTER (WHERE k <= 4) + count(DISTINCT paper_id) AS score FROM n GROUP BY key HAVING count(DISTINCT paper_id) >= 2)
SELECT kind, subject, field, CAST(n_papers AS BIGINT) AS n_papers, round(score, 4) AS score FROM (SELECT * FROM h UNION ALL SELECT * FROM s) ORDER BY score DESC, kind, subject, field LIMIT 60""")
def hypotheses(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "method").when(F.col("role") == "assistant", "concept").otherwise("cross_domain_hint")
    e = c.select(F.col("conv_id").cast("int").alias("hit_rank"), F.col("turn").alias("ord"), F.col("conv_id").cast("string").alias("paper_id"), kind.alias("kind"), F.regexp_extract(F.coalesce("text", F.lit("")), "^[^ ]+", 0).alias("label"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("f"), F.col("conv_id") % 7)).alias("field"), ((F.col("turn") % 5) / 2.0).alias("score"))
    return answers.hypotheses(e, limit=60).select("kind", "subject", "field", "n_papers", round4(F.col("score")).alias("score"))


@query("""
WITH p AS (SELECT c_custkey AS k, 'arxiv:2101.' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS paper_id FROM customer),
f AS (SELECT DISTINCT '/pdfs/' || lower(o_orderstatus) || '/2101.' || lpad(CAST(o_custkey % 2000 AS VARCHAR), 5, '0') || 'v' || (o_orderkey % 3) || '.pdf' AS path FROM orders)
SELECT p.paper_id, min(f.path) AS path FROM p LEFT JOIN f ON contains(f.path, substr(p.paper_id, 7)) GROUP BY p.paper_id""")
def find_files(spark, sf_dir):
    """Papers and the first file whose path holds their id."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    papers = c.select(F.concat(F.lit("arxiv:2101."), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("paper_id"), F.lit("").alias("title"))
    files = o.select(F.concat(F.lit("/pdfs/"), F.lower("o_orderstatus"), F.lit("/2101."), F.lpad((F.col("o_custkey") % 2000).cast("string"), 5, "0"), F.lit("v"), F.col("o_orderkey") % 3, F.lit(".pdf")).alias("path")).distinct()
    return verification.find_files(papers, files).select("paper_id", "path")


@query()
def verify_answers(spark, sf_dir):
    """Conversations as answers that cite documents, whose own sentences and those of the next document are the evidence."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("p"), "doc_id").alias("paper_id"))
    a = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), "turn", F.concat(F.lit("p"), F.col("conv_id") + F.col("turn")).alias("paper_id"))
    said = a.groupBy("answer_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("paper_id")), "; "), F.lit("]")).alias("answer"))
    sources = a.filter("turn % 2 = 0").select("answer_id", F.col("turn").alias("ord"), "paper_id")
    none = F.lit(None).cast("string")
    quoted = d.select((F.col("doc_id") - F.col("doc_id") % 2).alias("of"), F.substring("text", 100, 200).alias("evidence_span"), F.col("doc_id").alias("id"))
    rows = sources.join(quoted, F.expr("cast(substr(paper_id, 2) as bigint)") == F.col("of"))
    evidence = rows.select("answer_id", "id", "ord", "paper_id", F.lit("claim").alias("kind"), none.alias("text"), none.alias("title"), none.alias("abstract"), none.alias("label"), "evidence_span", none.alias("statement"), none.alias("context"), none.alias("description"), none.alias("why_applicable"))
    out = verification.verify_answers(said, sources, evidence, d.select("paper_id", "text"))
    return out.withColumn("missing", F.array_join("missing", ","))
