"""Extraction rules on the star schema, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extraction_text, table_functions
from ..functions.scalars import round4
from ..operators import concepts, extraction, retrieval, scan
from .registry import bounded, query, read


@query("""
WITH w AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '2101.' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') || 'v2.pdf' WHEN 1 THEN 'arXiv:2101.' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') ELSE 'zzz' END AS identifier FROM orders)
SELECT o_orderkey, identifier, CASE WHEN identifier <> 'zzz' AND TRY_CAST(regexp_extract(identifier, '2101[.]([0-9]{5})', 1) AS INTEGER) IN (SELECT c_custkey FROM customer) THEN 'arxiv:2101.' || regexp_extract(identifier, '2101[.]([0-9]{5})', 1) END AS paper_id FROM w""")
def resolve_identifiers(spark, sf_dir):
    """File names and prefixed ids find their papers through shared aliases."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    number = F.lpad(F.col("o_custkey").cast("string"), 5, "0")
    wanted = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("2101."), number, F.lit("v2.pdf"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("arXiv:2101."), number)).otherwise("zzz").alias("identifier"))
    papers = c.select(F.concat(F.lit("arxiv:2101."), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("id"), F.col("c_custkey").alias("ord"))
    return extraction.resolve_papers(wanted, papers)


_KIND_SQL = rf"""
WITH d AS (SELECT doc_id, substr(text, 1, 6000) AS header, lower(substr(text, 1, 12000)) AS x, list_transform(regexp_split_to_array(text, '\r\n|[\r\n]')[1:30], lambda l: lower(trim(regexp_replace(l, '\s+', ' ', 'g'), ' #'))) AS lines FROM documents),
t AS (SELECT *, coalesce(list_filter(lines, lambda l: length(l) BETWEEN 6 AND 180 AND NOT regexp_matches(l, '{extraction.NO_TITLE}'))[1], '') AS title, list_filter(list_transform(regexp_extract_all(header, '{extraction.YEAR}'), lambda y: CAST(y AS INTEGER)), lambda y: y <= 2026)[1] AS y FROM d)
SELECT doc_id, CASE WHEN regexp_matches(title, '{extraction.BENCHMARK}') OR (regexp_matches(x, '{extraction.FRAMEWORK[0]}') AND regexp_matches(x, '{extraction.FRAMEWORK[1]}') AND regexp_matches(x, '{extraction.FRAMEWORK[2]}')) THEN 'benchmark'
  WHEN regexp_matches(title, '{extraction.SURVEY}') OR regexp_matches(x, '{extraction.SURVEY}') THEN 'survey' ELSE 'research' END AS paper_type,
  CASE WHEN y IS NULL THEN 0 ELSE coalesce(TRY_CAST(nullif(regexp_extract(header, '{extraction.DATED}', 1), '') AS INTEGER), y) END AS year FROM t"""


@query(_KIND_SQL)
def paper_kind_detected(spark, sf_dir):
    """Kind and year by marks in the title line, the first 12,000 and the first 6,000 characters."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", extraction.detected_type(F.col("text")).alias("paper_type"), F.coalesce(extraction.detected_year(F.col("text"), 2026), F.lit(0)).alias("year"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'theoretical' WHEN paper_type = 'benchmark' THEN 'benchmark' WHEN doc_id % 4 = 2 THEN 'survey' ELSE paper_type END AS paper_type, year FROM ({_KIND_SQL})")
def paper_kind(spark, sf_dir):
    """The kind that a model gave (here by id, some of them unknown) combined with the detected one."""
    d = read(spark, sf_dir, "documents")
    given = F.when(F.col("doc_id") % 4 == 1, " Theoretical").when(F.col("doc_id") % 4 == 2, "survey").when(F.col("doc_id") % 4 == 3, "poem")
    return d.select("doc_id", extraction.resolved_type(given, extraction.detected_type(F.col("text"))).alias("paper_type"), F.coalesce(extraction.detected_year(F.col("text"), 2026), F.lit(0)).alias("year"))


@query("""
WITH k AS (SELECT l_suppkey AS paper_id, trim(regexp_replace(lower(p_brand || ' ' || CASE WHEN l_linenumber % 2 = 0 THEN upper(p_type) ELSE p_type END), '[^a-z0-9]+', ' ', 'g')) AS key, p_brand || ' ' || CASE WHEN l_linenumber % 2 = 0 THEN upper(p_type) ELSE p_type END AS label,
  CASE WHEN l_returnflag = 'A' THEN 'method' ELSE 'concept' END AS role, l_discount AS confidence, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT *, row_number() OVER (PARTITION BY paper_id, key ORDER BY confidence DESC, (role = 'method') DESC, ord, label DESC) AS n FROM k)
SELECT paper_id, key, label, role, confidence, (SELECT count(DISTINCT x.label) - 1 FROM k x WHERE x.paper_id = b.paper_id AND x.key = b.key) AS n_aliases FROM b WHERE n = 1""")
def merged_entities(spark, sf_dir):
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    j = line.join(part, line.l_partkey == part.p_partkey)
    label = F.concat_ws(" ", "p_brand", F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type")))
    e = j.select(F.col("l_suppkey").alias("paper_id"), label.alias("label"), F.when(F.col("l_returnflag") == "A", "method").otherwise("concept").alias("role"), F.col("l_discount").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return extraction.merged_entities(e).withColumn("n_aliases", F.size("aliases").cast("long")).drop("aliases")


@query("""
SELECT DISTINCT o_custkey AS paper_id, lower(o_orderpriority) AS label FROM orders WHERE (o_custkey, lower(o_orderpriority)) NOT IN (SELECT o_custkey, lower(o_orderpriority) FROM orders WHERE o_orderstatus = 'F')""")
def candidates_left(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id"), F.lower("o_orderpriority").alias("label"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    return extraction.candidates_left(o, o.filter("o_orderstatus = 'F'")).select("paper_id", "label")


@query("""
WITH e AS (SELECT CAST(dense_rank() OVER (ORDER BY o_custkey) AS INTEGER) AS hit_rank, o_orderkey AS ord, o_totalprice AS score FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY hit_rank ORDER BY ord) AS k FROM e WHERE hit_rank <= 6)
SELECT hit_rank, ord, score FROM k WHERE k <= 3 ORDER BY hit_rank, ord LIMIT 12""")
def evidence_payload(spark, sf_dir):
    from pyspark.sql.window import Window as W

    o = read(spark, sf_dir, "orders")
    first = o.select("o_custkey").distinct().orderBy("o_custkey").limit(6)  # the operator looks at the first hits only
    ranked = first.withColumn("hit_rank", F.row_number().over(W.orderBy("o_custkey")))
    return extraction.evidence_payload(o.join(F.broadcast(ranked), "o_custkey").select("hit_rank", F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("score")))


@query("""
SELECT paper_id, round(sum(score), 4) AS score, count(*) AS n_evidence FROM (SELECT l_suppkey AS paper_id, l_quantity AS score FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_suppkey, l_quantity FROM lineitem WHERE l_discount > 0.08)
GROUP BY paper_id ORDER BY sum(score) DESC, paper_id LIMIT 25""")
def hybrid_merge(spark, sf_dir):
    """Evidence of two searches added up; what both found counts twice."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("paper_id"), F.col("l_quantity").alias("score"), "l_discount")
    out = retrieval.hybrid(line.filter("score > 45"), line.filter("l_discount > 0.08"), limit=25)
    return out.select("paper_id", round4(F.col("score")).alias("score"), "n_evidence")


@query("""
SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[#*_`>~-]+', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')), 1, 180) AS excerpt, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM conversations""")
def note_excerpts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", extraction.note_excerpt(F.col("text")).alias("excerpt"), extraction.token_estimate(F.col("text")).alias("tokens"))


@query("""
WITH t AS (SELECT conv_id AS id, min(CASE WHEN turn = 0 THEN text END) AS question, min(CASE WHEN turn = 1 THEN text END) AS answer FROM conversations GROUP BY 1), m AS (SELECT conv_id AS thread_id, turn AS ord, role, text AS content FROM conversations WHERE conv_id % 2 = 0)
SELECT thread_id, ord, role, md5(content) AS content FROM m UNION ALL SELECT id, 0, 'user', md5(question) FROM t WHERE id % 2 <> 0 AND question <> '' UNION ALL SELECT id, 1, 'assistant', md5(answer) FROM t WHERE id % 2 <> 0 AND answer <> ''""")
def thread_messages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    threads = c.groupBy(F.col("conv_id").alias("id")).agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("question"), F.min(F.when(F.col("turn") == 1, F.col("text"))).alias("answer"))
    messages = c.filter("conv_id % 2 = 0").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("content"))
    return extraction.with_first_messages(threads, messages).withColumn("content", F.md5("content"))


@query(rf"""
WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(regexp_replace(substr(replace(text, 'the ', 'our '), 1, 3500), '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' .')),
  lambda x: length(x) BETWEEN 70 AND 320 AND regexp_matches(lower(x), '{bounded(extraction.CLAIM_MARK)}')) AS g FROM documents),
k AS (SELECT doc_id, g, list_transform(g, lambda x: trim(regexp_replace(lower(substr(x, 1, 120)), '[^a-z0-9]+', ' ', 'g'))) AS k FROM w),
f AS (SELECT doc_id, list_filter(g, lambda x, i: list_position(k, k[i]) = i)[1:5] AS g FROM k)
SELECT doc_id, CAST(generate_subscripts(g, 1) - 1 AS INTEGER) AS ord, md5(unnest(g)) AS statement_md5, regexp_matches(lower(unnest(g)), '{bounded(extraction.CLAIM_DENIAL)}') AS negated FROM f""")
def fallback_claims(spark, sf_dir):
    """Claims of texts that say "our" for "the", as none of the documents has a claim's mark or a heading of its own."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("the "), F.lit("our ")).alias("text"))
    return extraction.fallback_claims(d).select("doc_id", "ord", F.md5("statement").alias("statement_md5"), "negated")


_STRIP = f"trim({{}}, '{extraction_text.SPACES}')"
_WORDS = ", ".join("'(?i)" + k.replace("'", "''") + "'" for k in extraction_text.KEYWORDS)


@query(f"""
WITH t AS (SELECT doc_id, {_STRIP.format("coalesce(text, '')")} AS t FROM documents), k AS (SELECT unnest([{_WORDS}]) AS p, unnest(range(1, {len(extraction_text.KEYWORDS) + 1})) AS k),
l AS (SELECT doc_id, t, k, string_split_regex(t, p) AS parts, regexp_extract_all(t, p) AS hits FROM t, k WHERE length(t) > 6000),
i AS (SELECT doc_id, t, k, parts, hits, unnest(range(1, len(hits) + 1)) AS i FROM l WHERE len(hits) > 0),
s AS (SELECT doc_id, t, k, i, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS n FROM i),
w AS (SELECT doc_id, any_value(t) AS t, greatest(0, s - 900) AS a, least(length(t), s + n + 900) AS b, min(k * 1000000 + i) AS o FROM s GROUP BY doc_id, greatest(0, s - 900), least(length(t), s + n + 900)),
p AS (SELECT doc_id, o, {_STRIP.format("substr(t, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))")} AS piece, {_STRIP.format("substr(t, 1, 2000)")} AS head FROM w),
c AS (SELECT *, length(head) + sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY o) - length(piece) AS before FROM p),
m AS (SELECT doc_id, list(piece ORDER BY o) AS pieces FROM c WHERE before < 5000 GROUP BY doc_id)
SELECT t.doc_id, CAST(length(out) AS INTEGER) AS n_chars, md5(out) AS text_md5 FROM (
  SELECT t.doc_id, CASE WHEN length(t) <= 6000 THEN t ELSE substr(array_to_string(list_filter([{_STRIP.format("substr(t, 1, 2000)")}] || coalesce(pieces, []) || [{_STRIP.format("substr(t, length(t) - 999)")}], lambda x: x <> ''), chr(10) || chr(10) || '---' || chr(10) || chr(10)), 1, 6000) END AS out FROM t LEFT JOIN m USING (doc_id)) t""")
def extraction_texts(spark, sf_dir):
    """Documents as an extraction reads them within 6,000 characters: the head, what stands around keywords, the tail."""
    d = read(spark, sf_dir, "documents").select("doc_id", extraction_text.strip(F.coalesce("text", F.lit(""))).alias("t"))
    d = d.withColumn("out", extraction_text.extraction_text(F.col("t"), 6000))
    return d.select("doc_id", F.length("out").alias("n_chars"), F.md5("out").alias("text_md5"))


@query(f"""
WITH t AS (SELECT doc_id, {_STRIP.format("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 6000 THEN [0] ELSE range(0, length(t), 5100) END) AS s FROM t),
c AS (SELECT doc_id, CASE WHEN length(t) <= 6000 THEN t ELSE {_STRIP.format("substr(t, CAST(s + 1 AS BIGINT), 6000)")} END AS chunk, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM p WHERE length(t) <= 6000 OR {_STRIP.format("substr(t, CAST(s + 1 AS BIGINT), 6000)")} <> ''),
x AS (SELECT doc_id, chunk, unnest(CASE WHEN n <= 8 THEN [k] ELSE list_filter(list_transform(range(0, 8), lambda i: CASE WHEN CAST(round_even(i * (n - 1) / 7.0, 0) AS BIGINT) = k THEN k END), lambda v: v IS NOT NULL) END) AS k FROM c)
SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS k, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS chunk_md5 FROM x""")
def extraction_chunks(spark, sf_dir):
    """Documents in chunks of the least context; they have no numbered headings, so a long one is cut by length."""
    d = read(spark, sf_dir, "documents").select("doc_id", extraction_text.strip(F.coalesce("text", F.lit(""))).alias("t"))
    d = d.select("doc_id", F.posexplode(extraction_text.extraction_chunks(F.col("t"), 4096)).alias("k", "chunk"))
    return d.select("doc_id", "k", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query(f"""
WITH t AS (SELECT doc_id, {_STRIP.format("coalesce(text, '')")} AS t FROM documents), l AS (SELECT doc_id, t, length(t) // 2 AS mid, string_split_regex(t, '\\n\\s*\\n') AS parts, regexp_extract_all(t, '\\n\\s*\\n') AS hits FROM t),
a AS (SELECT doc_id, t, mid, list_transform(range(1, len(hits) + 1), lambda i: CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT)) AS places FROM l),
b AS (SELECT doc_id, t, coalesce(list_sort(list_transform(places, lambda x: struct_pack(d := abs(x - mid), p := x)))[1].p, mid) AS cut FROM a),
h AS (SELECT doc_id, CASE WHEN t = '' THEN [''] ELSE list_filter([{_STRIP.format("substr(t, 1, CAST(cut AS BIGINT))")}, {_STRIP.format("substr(t, CAST(cut + 1 AS BIGINT))")}], lambda x: x <> '') END AS h FROM b)
SELECT doc_id, CAST(len(h) AS INTEGER) AS n, md5(array_to_string(h, '|')) AS halves_md5 FROM h""")
def structural_halves(spark, sf_dir):
    """Documents in two at the blank line nearest to their middle."""
    d = read(spark, sf_dir, "documents").select("doc_id", extraction_text.structural_halves(F.col("text")).alias("h"))
    return d.select("doc_id", F.size("h").alias("n"), F.md5(F.array_join("h", "|")).alias("halves_md5"))


@query(r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS w FROM benchmark), x AS MATERIALIZED (SELECT w, lower(w) AS low FROM w), d AS MATERIALIZED (SELECT doc_id, text, lower(text) AS low FROM documents)
SELECT doc_id, w AS label FROM d JOIN x ON contains(d.low, x.low) WHERE regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])' || w || '(?:$|[^\p{L}\p{N}_])')""")
def scan_benchmark_words(spark, sf_dir):
    """Every long word of the benchmark as a pattern: hundreds of them, of which a document meets those that it has letters of."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0))).alias("label")).distinct()
    patterns = words.select(F.pmod(F.xxhash64("label"), F.lit(2**31)).cast("int").alias("ord"), F.lit("concept").alias("kind"), "label", F.concat(F.lit(r"\b"), "label", F.lit(r"\b")).alias("pattern"), F.lit(None).cast("string").alias("gate"), F.lit(0.5).alias("sure"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    return scan.scan_patterns(docs, patterns).select("doc_id", "label")


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, t, unnest(CASE WHEN t = '' THEN [] ELSE range(0, greatest(length(t) - 200, 1), 1800) END) AS start FROM t)
SELECT doc_id, CAST(start // 1800 AS INTEGER) AS k, CAST(start AS INTEGER) AS start, md5(substr(t, start + 1, 2000)) AS piece_md5 FROM s""")
def windows_lateral(spark, sf_dir):
    """Windows of documents by a table function in SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT d.doc_id, w.k, w.start, md5(w.piece) AS piece_md5 FROM {docs} d, LATERAL text_windows(d.text, 2000, 200) w", docs=read(spark, sf_dir, "documents"))


@query("""
WITH r AS (SELECT l_orderkey AS paper_id, l_linenumber AS ord, min(l_partkey) % 5 AS k, min(l_suppkey) % 3 AS f FROM lineitem GROUP BY ALL),
x AS (SELECT *, CASE k WHEN 0 THEN 'Sparse Coding' WHEN 1 THEN 'SC' WHEN 2 THEN 'Motor Babble' WHEN 3 THEN 'SC and motor babble' ELSE 'page 3' END AS label FROM r),
p AS (SELECT paper_id, bool_or(f = 0 AND k <> 4) AS known, bool_or(k = 0) AS has_long, bool_or(k = 1) AS has_short, bool_or(k = 2) AS motor FROM x GROUP BY 1),
v AS (SELECT x.paper_id, x.ord, x.k, p.known, p.has_long, p.has_short, p.motor, min(x.ord) FILTER (WHERE x.k = 0) OVER w AS first_full, min(x.ord) FILTER (WHERE x.k = 1) OVER w AS first_short FROM x JOIN p USING (paper_id) WHERE x.k <> 4 WINDOW w AS (PARTITION BY x.paper_id))
SELECT paper_id, CAST(ord AS INTEGER) AS ord, CASE WHEN k = 1 AND known THEN 'Sparse Coding' WHEN k = 0 THEN 'Sparse Coding' WHEN k = 1 THEN 'SC' WHEN k = 2 THEN 'Motor Babble' ELSE 'SC and motor babble' END AS label,
  CASE WHEN known AND has_short AND ((k = 0 AND ord = first_full) OR (k = 1 AND NOT has_long)) THEN 'SC' ELSE '' END AS aliases
FROM v WHERE NOT (k = 1 AND known AND (has_long OR ord <> first_short)) AND NOT (k = 3 AND motor AND CASE WHEN known THEN has_long OR has_short ELSE has_short END)""")
def post_processed_concepts(spark, sf_dir):
    """Lines of orders as concepts: a short form that a context explains is an alias of its long form, and a compound of two concepts goes."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    label = F.get(F.array(*map(F.lit, ("Sparse Coding.", "SC", "Motor  Babble", "SC and motor babble", "page 3"))), (F.col("l_partkey") % 5).cast("int"))
    c = line.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("ord"), label.alias("label"), F.when(F.col("l_suppkey") % 3 == 0, "they use Sparse Coding (SC) here").otherwise("nothing").alias("context"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("aliases"))
    return concepts.post_processed(c).select("paper_id", "ord", "label", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ",").alias("aliases"))
