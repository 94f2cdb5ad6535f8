"""Verification of answers in their sources: evidence is looked for in the texts that it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import cut_at_sentence, fragments, highlight_terms, squeeze, without_title
from .answers import cited_ids
from .linking import small

#: Characters of an excerpt, and of a stretch that is looked for word by word, the step between stretches, and the least that counts.
EXCERPT, PIECE, STEP, LEAST = 260, 120, 80, 30


def reference_fragments(evidence: DataFrame, *, most: int = 3) -> DataFrame:
    """evidence (id, kind, text, title, abstract, label, evidence_span, statement, context, description, why_applicable) with fragments: what is looked for in a text.

    The first ``most`` sentences or clauses, each once whatever its signs: of the abstract (papers
    only) and of what the evidence quotes; if it quotes nothing, of its own text and label; as a
    last resort of the abstract and the title. A title before a text is left out.
    """
    title = F.coalesce("title", F.lit(""))
    of = lambda *names: F.flatten(F.array(*[fragments(without_title(F.col(n) if isinstance(n, str) else n, title)) for n in names]))
    quoted = of(F.when(F.lower("kind") == "paper", F.col("abstract")), "evidence_span", "statement", "context", "description", "why_applicable")
    rows = evidence.select("*", quoted.alias("_a"), of("text", "label").alias("_b"), of("abstract", "title").alias("_c"))
    parts = F.when(F.size("_a") > 0, F.col("_a")).when(F.size("_b") > 0, F.col("_b")).otherwise(F.col("_c"))
    rows = rows.withColumn("_p", parts).withColumn("_k", F.transform("_p", lambda x: F.trim(F.lower(F.regexp_replace(x, "[^\\p{L}\\p{N}_]+", " ")))))
    first = F.slice(F.filter("_p", lambda x, i: F.array_position("_k", F.get("_k", i)) == i + 1), 1, most)
    return rows.select(*evidence.columns, first.alias("fragments"))


def _around(text: Column, position: Column, length: Column, size: int) -> Column:
    """A stretch around a place (from 0): back to the last sentence start before it, on to the next end, ``size`` characters at most."""
    half = F.greatest(F.lit(40), F.floor((F.lit(size) - length) / 2).cast("int"))
    raw_start, raw_end = F.greatest(F.lit(0), position - half), F.least(F.length(text), position + length + half)
    before = F.length(F.regexp_extract(F.substr(text, raw_start + 1, position - raw_start), r"(?s)^(.*[.!?] )", 1))
    after = F.length(F.regexp_extract(F.substr(text, raw_end + 1), r"(?s)^(.*?[.!?]) ", 1))
    start = F.when(raw_start <= 0, 0).otherwise(raw_start + before)
    end = F.when(raw_end >= F.length(text), F.length(text)).otherwise(raw_end + after)
    cut = F.trim(F.substr(text, start + 1, end - start))
    return F.when(F.length(cut) > size, cut_at_sentence(cut, size)).otherwise(cut)


def best_excerpt(texts: DataFrame, text: str, reference: str, *, size: int = EXCERPT) -> DataFrame:
    """texts with excerpt: where a text says what a reference says; empty where it doesn't.

    The longest stretch of the reference that the text has, with the sentence around it; else the
    window of ``size`` characters with the most of the reference's words. A projection of one row.
    """
    rows = texts.withColumn("_t", squeeze(F.coalesce(text, F.lit("")))).withColumn("_r", squeeze(F.coalesce(reference, F.lit(""))))
    rows = rows.withColumns({"_tl": F.lower("_t"), "_rl": F.lower("_r")})  # columns of their own: each piece and window looks at them
    starts = F.sequence(F.lit(0), F.greatest(F.length("_r") - PIECE, F.lit(1)) - 1, F.lit(STEP))
    pieces = F.transform(starts, lambda i: F.trim(F.substr(F.col("_rl"), i + 1, F.lit(PIECE))))
    held = F.transform(pieces, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), F.position(p, F.col("_tl")).alias("at")))
    found = F.filter(held, lambda x: (x["n"] <= -LEAST) & (x["at"] > 0))
    rows = rows.withColumn("_hit", F.array_min(found)).withColumn("_w", highlight_terms(F.col("_r")))
    windows = F.sequence(F.lit(0), F.greatest(F.length("_t") - size, F.lit(1)) - 1, F.lit(max(size // 2, 120)))
    score = lambda start: F.size(F.filter("_w", lambda w: F.contains(F.substr(F.col("_tl"), start + 1, F.lit(size)), w)))
    best = F.array_max(F.transform(windows, lambda s: F.struct(score(s).alias("score"), (-s).alias("s"))))
    rows = rows.withColumn("_best", F.when(F.col("_hit").isNull() & (F.size("_w") > 0), best))
    at, n = F.col("_hit.at") - 1, -F.col("_hit.n")
    exact = F.trim(F.substr(F.col("_t"), at + 1, n))
    start = -F.col("_best.s")
    excerpt = (
        F.when((F.col("_t") == "") | (F.col("_r") == ""), "")
        .when(F.col("_hit").isNotNull(), F.when(exact.rlike("[.!?]$"), exact).otherwise(_around(F.col("_t"), at, n, size)))
        .when(F.size("_w") == 0, cut_at_sentence(F.col("_t"), size))
        .when(F.col("_best.score") > 0, _around(F.col("_t"), start, F.least(F.lit(size), F.length("_t") - start), size))
        .otherwise("")
    )
    return rows.withColumn("excerpt", excerpt).select(*texts.columns, "excerpt")


def located(evidence: DataFrame, texts: DataFrame, *, most: int = 3) -> DataFrame:
    """evidence_id, paper_id, k, reference, excerpt, matched_terms, found: each fragment of each piece of evidence (id, paper_id, ...) in the text of its paper (paper_id, text; null or none: not found)."""
    ref = reference_fragments(evidence, most=most).select(F.col("id").alias("evidence_id"), "paper_id", F.posexplode_outer("fragments").alias("k", "reference"))
    ref = ref.withColumn("reference", F.coalesce("reference", F.lit(""))).withColumn("k", F.coalesce("k", F.lit(0)))
    rows = best_excerpt(ref.join(texts.select("paper_id", "text"), "paper_id", "left"), "text", "reference")
    terms = F.when(F.col("excerpt") != "", F.filter(highlight_terms(F.col("reference")), lambda w: F.contains(F.lower("excerpt"), w))).otherwise(F.array().cast("array<string>"))
    return rows.select("evidence_id", "paper_id", "k", "reference", "excerpt", terms.alias("matched_terms"), (F.col("excerpt") != "").alias("found"))


def lookup_tokens(paper_id: Column, title: Column) -> Column:
    """What a paper's file may be named by, the most telling first: its id, the id without its prefix, the first eight words of its title."""
    words = F.slice(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), 1, 8)
    values = F.array(paper_id, F.when(F.contains(paper_id, F.lit(":")), F.regexp_replace(paper_id, "^[^:]*:", "")), F.array_join(words, "-"), F.array_join(words, "_"))
    clean = F.transform(F.array_compact(values), lambda v: F.lower(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")))
    return F.array_distinct(F.filter(clean, lambda v: F.length(v) >= 4))


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substr(text, i, F.lit(n))))


def find_files(papers: DataFrame, files: DataFrame) -> DataFrame:
    """papers (paper_id, title) with path: the first file (path) whose path holds the first of a paper's tokens that any has, in any case; null where none has one.

    A token's last eight letters, or last four of a short one, are looked up among those of the
    paths by an equi-join, so that not every token is held against every path.
    """
    token = papers.select("paper_id", F.posexplode(lookup_tokens(F.col("paper_id"), F.col("title"))).alias("k", "token"))
    token = token.withColumn("gram", F.right("token", F.when(F.length("token") >= 8, 8).otherwise(4)))
    low = F.lower("path")
    parts = files.select("path", F.explode(F.array_union(_grams(low, 8), _grams(low, 4))).alias("gram"))
    met = token.join(parts, "gram").filter(F.contains(F.lower("path"), F.col("token")))
    best = met.groupBy("paper_id").agg(F.min(F.struct("k", "path")).alias("b")).select("paper_id", F.col("b.path").alias("path"))
    return papers.join(best, "paper_id", "left")


def verify_answers(answers: DataFrame, sources: DataFrame, evidence: DataFrame, texts: DataFrame, *, most_sources: int = 10, each: int = 5) -> DataFrame:
    """A row for each source of an answer: answer_id, paper_id, available, n_located, n_found, cited, missing (ids that the answer cites without a source).

    answers: answer_id, answer. sources: answer_id, ord, paper_id. evidence: answer_id, id, ord,
    paper_id and what reference_fragments() reads. texts: paper_id, text of the files at hand.
    """
    k = F.row_number().over(W.partitionBy("answer_id").orderBy("ord"))
    used = sources.withColumn("_k", k).filter(F.col("_k") <= most_sources).select("answer_id", "paper_id").distinct()
    cited = answers.select("answer_id", cited_ids(F.col("answer")).alias("cited"))
    given = used.groupBy("answer_id").agg(F.collect_set("paper_id").alias("_ids"))  # most_sources at most
    missing = cited.join(given, "answer_id", "left").select("answer_id", "cited", F.array_except("cited", F.coalesce("_ids", F.array().cast("array<string>"))).alias("missing"))
    mine = evidence.join(used, ["answer_id", "paper_id"], "left_semi")
    found = located(mine.withColumn("id", F.struct("answer_id", "id", "ord")), texts)
    nth = F.row_number().over(W.partitionBy("evidence_id.answer_id", "paper_id").orderBy("evidence_id.ord", "evidence_id.id", "k"))
    kept = found.withColumn("_n", nth).filter(F.col("_n") <= each)
    per = kept.groupBy(F.col("evidence_id.answer_id").alias("answer_id"), "paper_id").agg(F.count("*").alias("n_located"), F.count_if("found").alias("n_found"))
    have = small(texts.select("paper_id", F.lit(True).alias("_have")).distinct())
    out = used.join(have, "paper_id", "left").join(per, ["answer_id", "paper_id"], "left").join(missing, "answer_id", "left")
    return out.select("answer_id", "paper_id", F.coalesce("_have", F.lit(False)).alias("available"), F.coalesce("n_located", F.lit(0)).alias("n_located"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.array_contains("cited", F.col("paper_id")).alias("cited"), "missing")
