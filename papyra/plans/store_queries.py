"""Sources, appends, reviews and projects on the star schema; API answers are made of its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round4
from ..functions.text import CLAIM_STOP, claim_terms
from ..operators import dedup, entities, extraction, graph_build, merge, papers, scan, text_rules
from ..sources import tables
from .registry import query, read


def _number(c: str):
    return F.lpad(F.col(c).cast("string"), 5, "0")


@query("""
SELECT '2101.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS source_id, CAST(1 + p_size % 3 AS INTEGER) AS version, p_name AS title, CAST(2000 + p_size % 20 AS INTEGER) AS year, 'http://arxiv.org/pdf/' || p_partkey AS pdf_url, p_brand AS first_author FROM part""")
def arxiv_feed(spark, sf_dir):
    """Records of Atom feeds, a page for each part with one entry."""
    p = read(spark, sf_dir, "part")
    entry = F.concat(
        F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>q</title><entry><id>http://arxiv.org/abs/2101.'), _number("p_partkey"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("v"), 1 + F.col("p_size") % 3)), F.lit("</id><published>"), 2000 + F.col("p_size") % 20, F.lit("-01-02T00:00:00Z</published><title> "), F.col("p_name"), F.lit("\n </title><summary>s</summary><author><name>"), F.col("p_brand"),
        F.lit('</name></author><author><name>B</name></author><link href="http://arxiv.org/abs/1" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/'), F.col("p_partkey"), F.lit('" rel="related"/></entry><entry><id>http://arxiv.org/abs/0</id><title>other</title><author><name>C</name></author><link href="x"/></entry></feed>'),
    )
    out = tables.arxiv_records(p.select(entry.alias("body"))).filter("title <> 'other'")
    return out.select("source_id", "version", "title", "year", "pdf_url", F.get("authors", 0).alias("first_author"))


@query("""
SELECT 'S' || s_suppkey AS source_id, s_name AS title, CAST(2000 + s_suppkey % 20 AS INTEGER) AS year, '10.1/s' || s_suppkey AS doi, CAST(s_nationkey AS INTEGER) AS citation_count, 'R' || s_nationkey AS first_reference FROM supplier""")
def recommendations(spark, sf_dir):
    """Records of answers to a request for recommendations."""
    s = read(spark, sf_dir, "supplier")
    paper = F.struct(F.concat(F.lit("S"), "s_suppkey").alias("paperId"), F.col("s_name").alias("title"), (2000 + F.col("s_suppkey") % 20).alias("year"), F.col("s_nationkey").alias("citationCount"), F.array(F.struct(F.lit("A").alias("name"))).alias("authors"), F.struct(F.concat(F.lit("10.1/S"), "s_suppkey").alias("DOI")).alias("externalIds"), F.array(F.struct(F.concat(F.lit("R"), "s_nationkey").alias("paperId"))).alias("references"))
    pages = s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(paper).alias("recommendedPapers"))).alias("body"))
    out = tables.semantic_scholar_pages(pages, field="recommendedPapers")
    return out.select("source_id", "title", "year", "doi", "citation_count", F.get("references", 0).alias("first_reference"))


@query("SELECT 'C' || p_size AS id, min(p_brand) AS label, CAST(p_size % 5 AS INTEGER) AS level, count(*) AS works_count FROM part GROUP BY p_size")
def openalex_terms(spark, sf_dir):
    p = read(spark, sf_dir, "part").groupBy("p_size").agg(F.min("p_brand").alias("b"), F.count("*").alias("n"))
    item = F.struct(F.concat(F.lit("https://openalex.org/C"), "p_size").alias("id"), F.col("b").alias("display_name"), (F.col("p_size") % 5).alias("level"), F.col("n").alias("works_count"))
    return tables.openalex_terms(p.select(F.to_json(F.struct(F.array(item).alias("results"))).alias("body")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_id, p_name AS title, CAST(2001 + p_size AS INTEGER) AS year FROM part")
def papers_with_code(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.concat(2001 + F.col("p_size"), F.lit("-05-01")).alias("published"))
    return tables.papers_with_code(p.select(F.to_json(F.struct(F.array(item).alias("results"))).alias("body"))).select("source_id", "title", "year")


@query("""
SELECT event_id, event_id % 4 <> 1 AS parsed, CASE WHEN event_id % 4 = 1 THEN 'no ' || props END AS raw FROM events""")
def json_or_raw(spark, sf_dir):
    """JSON fields, with the raw text kept where it is bad."""
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("no "), "props")).otherwise(F.col("props")).alias("v"))
    out = e.select("event_id", tables.json_or_raw(F.col("v"), "struct<k:int>").alias("x"))
    return out.select("event_id", F.col("x.parsed").isNotNull().alias("parsed"), "x.raw")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 64 END AS n FROM embeddings")
def json_vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, "broken").otherwise(F.to_json("embedding")).alias("j"))
    return v.select("vec_id", F.coalesce(F.size(tables.vector(F.col("j"))), F.lit(0)).alias("n").cast("int")).withColumn("n", F.greatest("n", F.lit(0)))


@query("""
WITH w AS (SELECT c_custkey, 'arXiv:2101.' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || 'v3' AS identifier FROM customer)
SELECT identifier, o_orderkey AS id FROM w JOIN orders ON o_custkey = c_custkey""")
def extractions_of(spark, sf_dir):
    """Extractions under file names, found by ids with prefix and version."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    asked = c.select(F.concat(F.lit("arXiv:2101."), _number("c_custkey"), F.lit("v3")).alias("identifier"))
    e = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("2101."), _number("o_custkey"), F.lit(".pdf")).alias("paper_id"))
    return tables.extractions_of(e, asked).select("identifier", "id")


@query("""
SELECT 'src:' || c_custkey AS id, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS quality_score, CAST(CASE WHEN c_custkey % 4 = 0 THEN 7 ELSE c_nationkey % 3 END AS INTEGER) AS citation_count FROM customer""")
def insert_defaults(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    refs = F.slice(F.array(*map(F.lit, "abc")), 1, F.col("c_nationkey") % 3)
    rows = c.select(F.lit("").alias("id"), F.lit("src").alias("source"), F.col("c_custkey").cast("string").alias("source_id"), F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(0.25).alias("quality_score"), F.when(F.col("c_custkey") % 4 == 0, 7).alias("citation_count"), F.array().cast("array<string>").alias("citations"), refs.alias("references"))
    return merge.insert_defaults(rows).select("id", round4(F.col("quality_score")).alias("quality_score"), "citation_count")


@query("""
WITH p AS (SELECT 'arxiv:2101.' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS title, c_custkey AS k FROM customer),
w AS (SELECT DISTINCT CAST(o_custkey + o_orderkey % 2 * 100000 AS BIGINT) AS k FROM orders)
SELECT p.id, CASE WHEN title = '' AND w.k IS NOT NULL THEN 'new ' || p.k ELSE title END AS title FROM p LEFT JOIN w ON w.k = p.k
UNION ALL SELECT '2101.' || (w.k - 100000) || 'zz', 'new ' || w.k FROM w WHERE w.k > 90000""")
def ensured_papers(spark, sf_dir):
    """Papers whose missing titles are filled from records of file names; records of unknown names become papers."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    p = c.select(F.concat(F.lit("arxiv:2101."), _number("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("title"), F.col("c_custkey").alias("ord"))
    k = o.select((F.col("o_custkey") + F.col("o_orderkey") % 2 * 100000).alias("k")).distinct()
    w = k.select(F.when(F.col("k") > 90000, F.concat(F.lit("2101."), F.col("k") - 100000, F.lit("zz"))).otherwise(F.concat(F.lit("2101."), _number("k"), F.lit("v2.pdf"))).alias("identifier"), F.concat(F.lit("new "), "k").alias("title"))
    return merge.ensured_papers(p, w, ["title"])


@query("""
SELECT l_orderkey AS paper_id, 'P' || (l_partkey % 50) AS label, CASE WHEN l_linenumber = 2 THEN 'sugg' ELSE 'P' || (l_partkey % 50) END AS suggested_canonical, CASE WHEN l_linenumber = 3 THEN 'ctx' ELSE 'ev' END AS evidence, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_linestatus = 'F' AND l_linenumber <= 4 GROUP BY ALL""")
def review_items(spark, sf_dir):
    """What waits for review in the four lists of filled orders: one line in each."""
    line, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    item = F.struct(F.concat(F.lit(" P"), F.col("l_partkey") % 50, F.lit(" ")).alias("label"), F.when(F.col("l_linenumber") == 2, "sugg").alias("canonical_label"), F.lit("T").alias("entity_type"), F.lit(None).cast("string").alias("canonical_id"), F.when(F.col("l_linenumber") == 3, "").otherwise("ev").alias("evidence_span"), F.lit("ctx").alias("context"), F.when(F.col("l_linestatus") == "F", "Pending").otherwise("approved").alias("review_status"))
    names = ("concepts", "methods", "concept_candidates", "method_candidates")
    lists = line.select("l_orderkey", "l_linenumber", item.alias("x")).groupBy("l_orderkey").agg(*[F.collect_list(F.when(F.col("l_linenumber") == i + 1, F.col("x"))).alias(n) for i, n in enumerate(names)])
    e = o.join(lists, o.o_orderkey == lists.l_orderkey).select(F.col("o_orderkey").alias("paper_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("extraction_status"), *names)
    return papers.review_items(e).groupBy("paper_id", "label", "suggested_canonical", "evidence").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id AS id, turn, CASE WHEN turn % 3 = 0 THEN 'new' ELSE coalesce(text, '') END AS content, CASE WHEN turn % 3 = 0 THEN TIMESTAMP '2031-01-01' ELSE TIMESTAMP '2030-01-01' END AS updated_timestamp FROM conversations WHERE coalesce(text, '') <> 'new'""")
def updated_if_changed(spark, sf_dir):
    """Turns of which some are edited, some with what they say already: only changed ones have a new time."""
    c = read(spark, sf_dir, "conversations").withColumn("content", F.coalesce("text", F.lit("")))
    t = lambda y: F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz")
    key = F.concat_ws(":", "conv_id", "turn")
    rows = c.select(key.alias("key"), F.col("conv_id").alias("id"), "turn", "content", t(2030).alias("updated_timestamp"))
    edits = c.filter("turn % 3 < 2").select(key.alias("key"), F.when(F.col("turn") % 3 == 0, "new").otherwise(F.col("content")).alias("content"))
    return merge.updated_if_changed(rows, edits, "key", ["content"], t(2031)).drop("key")


@query("""
WITH k AS (SELECT o_custkey AS project_id, o_orderkey AS paper_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders WHERE o_orderstatus <> 'P')
SELECT CASE WHEN project_id % 10 = 0 THEN 'big' || project_id ELSE 'c' || project_id END AS project_id, paper_id FROM k UNION ALL SELECT CASE WHEN c_custkey % 10 = 0 THEN 'big' || c_custkey ELSE 'c' || c_custkey END, -1 FROM customer""")
def edited_projects(spark, sf_dir):
    """Projects of customers: open orders are taken out, one paper is added, some are renamed."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    name = lambda k: F.concat(F.lit("c"), k)
    p = o.select(name("o_custkey").alias("project_id"), F.col("o_orderkey").alias("paper_id"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    added = c.select(name("c_custkey").alias("project_id"), F.lit(-1).cast("long").alias("paper_id"), F.lit(0).cast("long").alias("ord"))
    renamed = c.filter("c_custkey % 10 = 0").select(name("c_custkey").alias("project_id"), F.concat(F.lit("big"), "c_custkey").alias("new_id"))
    return merge.edited_projects(p.drop("o_orderstatus"), added, p.filter("o_orderstatus = 'P'"), renamed).select("project_id", "paper_id")


@query("""
WITH s AS (SELECT conv_id AS doc_id, turn AS ord, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM conversations)
SELECT doc_id, min(ord) AS ord FROM s WHERE k <> '' GROUP BY doc_id, k""")
def merged_claims(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("text").alias("statement"))
    return entities.merged_claims(c).select("doc_id", "ord")


@query("""
WITH r AS (SELECT l_orderkey AS paper_id, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord, ['Bias', ' model', 'reward', 'VALUE', 'drive', ''][l_partkey % 6 + 1] AS term, l_returnflag FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY paper_id, lower(trim(term)) ORDER BY ord) AS n FROM r WHERE trim(term) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS m FROM f WHERE n = 1)
SELECT paper_id, trim(term) AS term FROM k WHERE m <= 3 AND (lower(trim(term)) NOT IN ('bias', 'model', 'value') OR (l_returnflag <> 'N' AND (lower(trim(term)) = 'bias' AND paper_id % 2 = 0 OR lower(trim(term)) = 'value' AND paper_id % 3 = 0)))""")
def merged_conflicts(spark, sf_dir):
    """Terms in conflict: general ones stay where the paper's entities anchor them and they are defined."""
    line, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    term = F.get(F.array(*map(F.lit, ("Bias", " model", "reward", "VALUE", "drive", ""))), (F.col("l_partkey") % 6).cast("int"))
    rows = line.select(F.col("l_orderkey").alias("paper_id"), term.alias("term"), F.when(F.col("l_returnflag") == "N", "it is Not defined here").otherwise("a word").alias("this_field"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("ord"))
    e = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("paper_id"), F.lit("selectionbias").alias("key")).union(o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("value")))
    return papers.merged_conflicts(rows, e, most=3).select("paper_id", "term")


@query("SELECT event_id, value FROM events WHERE event_type = 'error' AND value >= 0.7")
def contradictions(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "contradictory").otherwise("irrelevant").alias("conflict_type"), F.col("value").alias("confidence"))
    return papers.contradictions(e).select("event_id", F.col("confidence").alias("value"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z-]+') AS x FROM documents),
g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(x)), lambda i: array_to_string(x[i : i + 1], ' ')), list_transform(range(1, greatest(1, len(x) - 1)), lambda i: array_to_string(x[i : i + 2], ' ')))) AS phrase FROM w WHERE len(x) >= 2)
SELECT doc_id, phrase, count(*) AS n FROM g WHERE (regexp_extract(phrase, '^[^ ]+') IN ('anea', 'thanedble') OR regexp_extract(phrase, '[^ ]+$') IN ('anea', 'thanedble')) AND NOT list_has_any(string_split(phrase, ' '), ['the', 'and']) GROUP BY ALL HAVING count(*) >= 2""")
def repeated_phrases(spark, sf_dir):
    """Phrases of two and three words with a head word at an end and no stop word, twice in a document."""
    return text_rules.repeated_phrases(read(spark, sf_dir, "documents"), ("anea", "thanedble"), ("the", "and"), sizes=(2, 3))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Given' WHEN regexp_matches(lower(text), 'idiot|moron') THEN 'Rude' WHEN contains(lower(text), 'http') THEN 'Linked' ELSE 'Interdisciplinary' END AS domain FROM documents""")
def method_domains(spark, sf_dir):
    """Domains by the words that speak for them, where none or an unknown one is given."""
    d = read(spark, sf_dir, "documents")
    words = {"Rude": ["idiot", "moron"], "Linked": ["http"]}
    given = F.when(F.col("doc_id") % 4 == 0, "Given").when(F.col("doc_id") % 4 == 1, " Unknown")
    own = F.coalesce(extraction.domain(F.col("text"), words), F.lit("Interdisciplinary"))
    named = extraction.method_domain(given, F.lit(""), F.lit(""))
    return d.select("doc_id", F.when(named == "Given", named).otherwise(F.when(F.lower("text").rlike("idiot|moron"), "Rude").otherwise(own)).alias("domain"))


_SCAN = [("Idiot", r"\bidiots?\b", None), ("Address", r"https?://", None), ("Long number", r"[0-9]{6,}", "mail"), ("License", r"licen[cs]ed? under", "mail")]


@query("""
WITH p AS (SELECT unnest(['Idiot', 'Address', 'Long number', 'License']) AS label, unnest(['(?:^|[^\\p{L}\\p{N}_])idiots?(?:$|[^\\p{L}\\p{N}_])', 'https?://', '[0-9]{6,}', 'licen[cs]ed? under']) AS pattern, unnest([FALSE, FALSE, TRUE, TRUE]) AS gated)
SELECT doc_id, label FROM documents, p WHERE regexp_matches(text, '(?i)' || pattern) AND (NOT gated OR contains(text, '@'))""")
def scan_vocabulary(spark, sf_dir):
    """A vocabulary's patterns in documents, two of them in texts with an address only."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    patterns = spark.createDataFrame([(i, "concept", label, p, gate, 0.5) for i, (label, p, gate) in enumerate(_SCAN)], scan.PATTERNS)
    return scan.scan_patterns(d.withColumn("gate_mail", F.contains("body", F.lit("@"))), patterns).select("doc_id", "label")


@query("SELECT p_partkey, upper(left(p_name, 1)) || 'la Beta (' || upper(left(p_name, 1)) || 'B)' AS text, upper(left(p_name, 1)) || 'la Beta' AS long, upper(left(p_name, 1)) || 'B' AS short FROM part")
def acronyms(spark, sf_dir):
    """Names with their short forms in brackets."""
    p = read(spark, sf_dir, "part")
    a = F.upper(F.substring("p_name", 1, 1))
    said = F.concat(a, F.lit("la Beta ("), a, F.lit("B)"))
    rows = p.select("p_partkey", said.alias("text"), F.concat(F.lit("x the "), said, F.lit(" and Journal of Kinds (JK)")).alias("t"))
    return rows.select("p_partkey", "text", F.inline(F.transform(scan.acronym_pairs(F.col("t")), lambda x: F.struct(x["long"].alias("long"), x["short"].alias("short")))))


@query("""
SELECT DISTINCT 'Kind ' || (l_partkey % 90) AS label, lower('Kind ' || (l_partkey % 90)) AS label_norm, CAST(2 AS INTEGER) AS embedding_version, 1024 AS dim FROM lineitem WHERE l_partkey % 90 <> 7
UNION ALL SELECT 'old ' || p_size, 'old ' || p_size, 1, 0 FROM (SELECT DISTINCT p_size FROM part)""")
def reindexed_embeddings(spark, sf_dir):
    """Embeddings after all labels are embedded anew; those of an older version stay."""
    line, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    labels = line.filter("l_partkey % 90 <> 7").select(F.concat(F.lit(" Kind  "), F.col("l_partkey") % 90).alias("label"), F.col("l_orderkey").alias("ord"))
    t = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    old = p.select(F.concat(F.lit("old "), "p_size").alias("label")).distinct().select("label", F.col("label").alias("label_norm"), F.lit("hash").alias("model"), F.lit(1).alias("embedding_version"), F.array().cast("array<float>").alias("vector"), t.alias("updated_timestamp"))
    out = merge.reindexed(labels, old, dedup.hash_embedding(F.col("label")), model="hash", version=2, now=t)
    return out.select("label", "label_norm", "embedding_version", F.size("vector").alias("dim"))


@query("""
SELECT (SELECT count(*) FROM lineitem) AS records_seen, count(DISTINCT l_partkey) AS records_unique, (SELECT count(*) FROM (SELECT p_partkey AS k FROM part UNION SELECT l_partkey FROM lineitem)) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) AS edges_written FROM lineitem""")
def global_merge(spark, sf_dir):
    """Parts as a global graph into which a project's lines are merged."""
    line, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("seq"), F.col("p_name").alias("title"))
    project = line.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("seq"), F.lit("line").alias("title"))
    edges = line.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_orderkey").alias("seq"))
    n, _, _, counts = merge.merged_into_global(nodes, edges.limit(0), edges.limit(0), project, edges, edges.limit(0))
    return counts.crossJoin(n.agg(F.count("*").alias("n_nodes"))).select("records_seen", "records_unique", "n_nodes", "edges_written")


_TERMS = f"""len(list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_-]{{2,}}'), lambda w: length(w) >= 4 AND w NOT IN ({', '.join(repr(w) for w in CLAIM_STOP)})),
  lambda w: CASE WHEN length(w) > 5 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END)))"""


@query(f"SELECT conv_id, turn, CAST({_TERMS} AS INTEGER) AS n_terms, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 END + CASE WHEN coalesce(role, '') = '' THEN 0 ELSE 1 END + {_TERMS} AS INTEGER) AS score FROM conversations")
def payload_scores(spark, sf_dir):
    """Turns as payloads: their telling words are a list of items, text and role are fields that may be filled."""
    c = read(spark, sf_dir, "conversations").withColumn("terms", claim_terms(F.coalesce("text", F.lit(""))))
    return c.select("conv_id", "turn", F.size("terms").alias("n_terms"), papers.payload_score([F.col("terms")], [F.col("text"), F.col("role")]).alias("score"))


@query("SELECT p_partkey, trim(regexp_replace(p_name, '[ \\t\\r\\n]+', ' ', 'g')) AS label, 'concept:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS id FROM part")
def clean_labels(spark, sf_dir):
    """Labels cleaned of the signs at their ends, and the ids that they make."""
    p = read(spark, sf_dir, "part").select("p_partkey", graph_build.clean_label(F.concat(F.lit(" ("), F.regexp_replace("p_name", " ", "  "), F.lit("). "))).alias("label"))
    return p.select("p_partkey", "label", graph_build.node_id("concept", F.lit(""), F.col("label")).alias("id"))
