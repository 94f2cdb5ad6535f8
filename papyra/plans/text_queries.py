"""Text operators and search on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.scalars import round4
from ..operators import answers, conflicts, retrieval
from ..shared import in_pieces
from .registry import derived, query, read

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _tokens(x: str) -> str:
    """SQL of text.tokens()."""
    found = f"list_transform(regexp_extract_all(lower({x}), '{text.TOKEN}'), lambda t: replace(t, '_', '-'))"
    parts = f"flatten(list_transform({found}, lambda t: CASE WHEN contains(t, '-') THEN list_concat([t], string_split(t, '-')) ELSE [t] END))"
    return f"list_filter({parts}, lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


@query(f"""
WITH t AS (SELECT doc_id, unnest(list_distinct({_tokens("text")})) AS token FROM documents)
SELECT token, count(*) AS df, round(1.0 + ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)), 4) AS idf FROM t GROUP BY token""")
def token_doc_frequency(spark, sf_dir):
    out = retrieval.document_frequency(read(spark, sf_dir, "documents"), F.col("text"))
    return out.select("token", "df", round4(F.col("idf")).alias("idf"))


def _index(spark, sf_dir):
    return derived(spark, sf_dir, "documents", lambda path: retrieval.lexical_index(read(spark, sf_dir, "documents"), path))


@query(f"""
WITH t AS (SELECT doc_id, unnest(list_distinct({_tokens("text")})) AS token FROM documents)
SELECT token, count(*) AS df, round(1.0 + ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)), 4) AS idf FROM t GROUP BY token""")
def index_terms(spark, sf_dir):
    """The vocabulary of the stored index, which is built here if no other query has."""
    return _index(spark, sf_dir).document_frequency().select("token", "df", round4(F.col("idf")).alias("idf"))


SEARCH = "thtion anea models ererth"
_SCORED = f"""
d AS (SELECT doc_id, list_distinct({_tokens("text")}) AS own FROM documents),
q AS (SELECT unnest(['thtion', 'anea', 'models', 'ererth']) AS t),
f AS (SELECT t, 1.0 + ln(((SELECT count(*) FROM documents) + 1.0) / ((SELECT count(*) FROM d WHERE list_contains(own, t)) + 1.0)) AS w FROM q),
h AS (SELECT doc_id, sum(CASE WHEN t = 'models' THEN 0.25 * w ELSE w END) AS score, list(t) AS own FROM d, f WHERE list_contains(own, t) GROUP BY doc_id HAVING bool_or(t <> 'models'))"""


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 4) AS score FROM h ORDER BY round(score, 4) DESC, doc_id LIMIT 25")
def lexical_search(spark, sf_dir):
    """The best 25 documents for a query of specific and common words."""
    out = retrieval.lexical_search(_index(spark, sf_dir), SEARCH, limit=25)
    return out.select("doc_id", round4(F.col("score")).alias("score"))


@query(f"""
WITH d AS (SELECT doc_id, {_tokens("text")} AS x FROM documents),
o AS (SELECT doc_id, list_filter(x, lambda t, i: list_position(x, t) = i) AS x FROM d),
f AS (SELECT t, 1.0 + ln(((SELECT count(*) FROM documents) + 1.0) / ((SELECT count(*) FROM o WHERE list_contains(x, t)) + 1.0)) AS w FROM (SELECT unnest(['attion', 'thanedble', 'anea']) AS t))
SELECT doc_id, round(sum(w) + CASE WHEN any_value(contains(array_to_string(x, ' '), 'attion thanedble anea')) THEN 3.0 ELSE 0.0 END, 4) AS score FROM o, f WHERE list_contains(x, t) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 40""")
def phrase_search(spark, sf_dir):
    """A query whose words many documents have in this order: these score its phrase part too."""
    out = retrieval.lexical_search(_index(spark, sf_dir), "attion of thanedble anea", limit=40)
    return out.select("doc_id", round4(F.col("score")).alias("score"))


@query(f"""
WITH RECURSIVE {_SCORED},
m AS (SELECT doc_id, score, CAST(list_contains(own, 'thtion') AS INT) + 2 * CAST(list_contains(own, 'anea') AS INT) + 4 * CAST(list_contains(own, 'ererth') AS INT) AS m FROM h),
p(step, doc_id, covered) AS (
  SELECT 0, CAST(NULL AS BIGINT), 0
  UNION ALL
  SELECT p.step + 1, b.doc_id, p.covered | b.m FROM p, LATERAL (SELECT m.doc_id, m.m FROM m WHERE (m.m & ~p.covered) <> 0 ORDER BY bit_count(m.m & ~p.covered) DESC, m.score DESC, m.doc_id LIMIT 1) b WHERE p.step < 3),
r AS (SELECT m.doc_id, m.score, p.step, row_number() OVER (ORDER BY p.step NULLS LAST, m.score DESC, m.doc_id) AS rank FROM m LEFT JOIN p ON p.doc_id = m.doc_id)
SELECT doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50""")
def coverage_rank(spark, sf_dir):
    """The first 50 hits in the order that covers the query's words first."""
    hits = retrieval.lexical_hits(_index(spark, sf_dir), SEARCH)
    return retrieval.cover_first(hits, text.query_tokens(SEARCH), limit=50).select(F.col("id").alias("doc_id"), round4(F.col("score")).alias("score"), "rank")


@query("""
WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents),
p AS (SELECT *, coalesce(nullif(instr(lower(t), 'idiot'), 0), nullif(instr(lower(t), 'anea'), 0), 0) AS k FROM c), s AS (SELECT *, greatest(0, k - 1 - 120) AS a FROM p)
SELECT doc_id, CASE WHEN length(t) <= 360 THEN t WHEN k = 0 THEN rtrim(substr(t, 1, 357)) || '...' ELSE
  CASE WHEN a > 0 THEN '...' ELSE '' END || trim(substr(t, CAST(a + 1 AS BIGINT), 360)) || CASE WHEN a + 360 < length(t) THEN '...' ELSE '' END END AS snippet FROM s""")
def snippets(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", text.snippet(F.col("text"), ["idiot", "anea"]).alias("snippet"))


def _occurs(part: str) -> str:
    return f"(length(s) - length(replace(s, '{part}', ''))) // {len(part)}"


@query(f"""
WITH p AS (SELECT doc_id, substr(coalesce(text, ''), 1, 5000) AS s FROM documents),
k AS (SELECT doc_id, {" + ".join(_occurs(x) for x in ("$$", chr(92) + "[", chr(92) + "]", chr(92) + "alpha", chr(92) + "beta"))} > 1 AS heavy_formulas,
  len(list_filter(string_split(s, chr(10)), lambda x: contains(x, '|') OR contains(x, chr(9)))) > 2 AS complex_tables,
  {" + ".join(_occurs(x) for x in ("Figure", "Diagram", "Visualization", "Schematic", "Architecture"))} > 1 AS diagrams FROM p)
SELECT *, CASE WHEN heavy_formulas THEN 'nougat' WHEN complex_tables THEN 'table_transformer' WHEN diagrams THEN 'vlm' ELSE 'marker' END AS parser FROM k""")
def parser_indicators(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", *[c.alias(n) for n, c in text.page_features(F.col("text")).items()])


@query("""SELECT doc_id, length(regexp_extract(text || chr(10), '(?s)^(.*?)\\n[ \\t]*(?:[0-9.]+[ \\t]*)?(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY)[ \\t]*\\n', 1)) AS n FROM documents WHERE regexp_matches(text, '\\n[ \\t]*(?:[0-9.]+[ \\t]*)?(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY)[ \\t]*\\n')
UNION ALL SELECT doc_id, length(text) FROM documents WHERE NOT regexp_matches(text, '\\n[ \\t]*(?:[0-9.]+[ \\t]*)?(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY)[ \\t]*\\n')""")
def reference_cut(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(text.before_references(F.col("text"))).cast("long").alias("n"))


@query("""
WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text || ' [p' || (doc_id % 7) || ', arXiv:' || doc_id || '; zz]', '\\[([^\\[\\]]{1,200})\\]', 1)) AS g FROM documents),
y AS (SELECT doc_id, lower(trim(unnest(string_split(replace(g, ';', ','), ',')))) AS label FROM x)
SELECT DISTINCT doc_id, label FROM y WHERE regexp_matches(label, '^(arxiv:|doi:|p)')""")
def citation_labels(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    said = F.concat("text", F.lit(" [p"), F.col("doc_id") % 7, F.lit(", arXiv:"), "doc_id", F.lit("; zz]"))
    return d.select("doc_id", F.explode(answers.citation_labels(said)).alias("label"))


@query("""
WITH l AS (SELECT unnest(['idiot', 'of the', 'worthless', 'unknown source form']) AS label, unnest(['', 'OT', '', 'USF']) AS short),
d AS (SELECT doc_id, label, short, regexp_replace(lower(text), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') AS low, regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') AS t FROM documents, l),
n AS (SELECT *, len(regexp_extract_all(low, '(?:^|[^\\p{L}\\p{N}_])' || replace(label, ' ', '[\\s-]+') || '(?:$|[^\\p{L}\\p{N}_])')) AS n FROM d),
m AS (SELECT doc_id, label, CASE WHEN n = 0 AND short <> '' THEN len(regexp_extract_all(t, '(?:^|[^\\p{L}\\p{N}_])' || short || '(?:$|[^\\p{L}\\p{N}_])')) ELSE n END AS n FROM n)
SELECT doc_id, label, CAST(n AS INTEGER) AS n FROM m WHERE n > 0""")
def mention_count(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    found = F.array(*[F.struct(F.lit(x).alias("label"), text.mentions(F.col("text"), x).alias("n")) for x in ("idiot", "of the", "worthless", "unknown source form")])
    return d.select("doc_id", F.inline(found)).filter("n > 0")


_CLAIM_STOP = ", ".join(f"'{w}'" for w in text.CLAIM_STOP)
_MARKERS = ", ".join(f"'{w}'" for w in text.CONFLICT_MARKERS)


@query(f"""
WITH t AS (SELECT conv_id, turn, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{2,}}'), lambda w: length(w) >= 4 AND w NOT IN ({_CLAIM_STOP})),
  lambda w: CASE WHEN length(w) > 5 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END)) AS x FROM conversations),
p AS (SELECT a.conv_id, a.turn AS l, b.turn AS r, len(list_intersect(a.x, b.x)) AS k, least(len(a.x), len(b.x)) AS m, list_has_any(list_concat(a.x, b.x), [{_MARKERS}]) AS c FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn),
s AS (SELECT conv_id, l, r, CASE WHEN k = 0 THEN 0.0 ELSE k / greatest(1, m) + CASE WHEN c THEN 0.1 ELSE 0.0 END END AS score FROM p),
n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, l, r) AS rank FROM s)
SELECT conv_id, l, r, round(score, 4) AS score FROM n WHERE total <= 10 OR (score > 0 AND rank <= 10)""")
def claim_pairs(spark, sf_dir):
    """Pairs of claims of a conversation; where there are more than ten, the ten that share most."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("ord"), F.col("text").alias("statement"))
    return conflicts.claim_pairs(c).select(F.col("paper_id").alias("conv_id"), "l", "r", round4(F.col("score")).alias("score"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS x FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS phrase FROM w WHERE len(x) >= 2)
SELECT phrase, count(*) AS n FROM g GROUP BY phrase""")
def ngram_counts(spark, sf_dir):
    d = in_pieces(read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    return d.select(words.alias("w")).select(F.explode(text.ngrams(F.col("w"), (2,))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


@query("""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\r\\n]+', ' ', 'g')) AS title,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_md5 FROM pages""")
def page_text(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", text.html_title(F.col("html")).alias("title"), F.md5(text.html_text(F.col("html"))).alias("text_md5"))


PATTERNS = {"url": "https?://", "email": "[a-z0-9._-]+@[a-z0-9-]+[.][a-z]+", "license": "licen[cs]ed? under", "copyright": "copyright", "number": "[0-9]{4,}"}


@query("WITH p AS (SELECT unnest(['url', 'email', 'license', 'copyright', 'number']) AS label, unnest(['https?://', '[a-z0-9._-]+@[a-z0-9-]+[.][a-z]+', 'licen[cs]ed? under', 'copyright', '[0-9]{4,}']) AS pattern) SELECT doc_id, label FROM documents, p WHERE regexp_matches(lower(text), pattern)")
def scan_patterns(spark, sf_dir):
    """Fixed patterns as literals, so that each is compiled once, not once a row."""
    d = read(spark, sf_dir, "documents")
    hits = F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), F.lit(n)) for n, p in PATTERNS.items()]))
    return d.select("doc_id", F.explode(hits).alias("label"))


@query("""
WITH p AS (SELECT item_id, list_transform(range(0, greatest(length(text) - 120, 1), 80), lambda i: trim(substr(lower(text), i + 1, 120))) AS ps FROM benchmark),
u AS (SELECT item_id, unnest(ps) AS probe, generate_subscripts(ps, 1) AS k FROM p),
f AS (SELECT u.item_id AS needle_id, d.doc_id, length(probe) AS length, k, instr(lower(d.text), probe) AS position FROM u JOIN documents d ON length(probe) >= 30 AND contains(lower(d.text), probe)),
r AS (SELECT *, row_number() OVER (PARTITION BY needle_id, doc_id ORDER BY length DESC, k) AS n FROM f)
SELECT needle_id, doc_id, CAST(position AS BIGINT) AS position, CAST(length AS BIGINT) AS length FROM r WHERE n = 1""")
def excerpt_lookup(spark, sf_dir):
    b, d = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    return answers.excerpts(b.select(F.col("item_id").alias("needle_id"), "text"), d.select("doc_id", "text"))
