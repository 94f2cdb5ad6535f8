"""Evidence for answers: selection, citation, verification in source texts, hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import round4
from .linking import small


def shared_labels(evidence: DataFrame, *, best: int = 4) -> DataFrame:
    """label, n_papers, score of labels (any case) that at least two papers have: the sum of the best scores plus the number of papers. evidence: label, paper_id, score.

    Only the best scores of each label are kept while they are gathered, so a label that is
    everywhere stays small.
    """
    e = evidence.withColumn("key", F.lower("label"))
    n = e.groupBy("key").agg(F.min("label").alias("label"), F.count_distinct("paper_id").alias("n_papers")).filter("n_papers >= 2")
    top = e.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score")))).filter(F.col("k") <= best).groupBy("key").agg(F.sum("score").alias("s"))
    return n.join(top, "key").select("label", "n_papers", round4(F.col("s") + F.col("n_papers")).alias("score"))


# What kinds of evidence are worth in an answer, and the scores of what is added from the best papers.
KIND_BONUS = {"claim": 3.0, "relation": 2.0, "method": 1.0, "concept": 0.5, "paper": 0.25}
ADDED_SCORE = {"claim": 7.0, "method": 5.0, "concept": 4.0, "relation": 4.5}
# Fixed value: words of patient care, which make a statement specific.
CARE = r"\b(ai consult|clinical|clinician|physician|patient|diagnos|treatment)\b"


def specificity(text: Column) -> Column:
    """What a statement gains by a number in it and by words of patient care."""
    return F.when(text.rlike("[0-9]"), 2.0).otherwise(0.0) + F.when(F.lower(text).rlike(CARE), 1.5).otherwise(0.0)


def answer_rank(kind: Column, text: Column, score: Column) -> Column:
    bonus = F.coalesce(*[F.when(kind == k, v) for k, v in KIND_BONUS.items()], F.lit(0.0))
    return score + bonus + specificity(text)


def evidence_for_answer(evidence: DataFrame, items: DataFrame | None = None, *, limit: int = 24, hits: int = 3) -> DataFrame:
    """The evidence (hit_rank, ord, paper_id, kind, text, score) that an answer may use, with answer_score: the ``limit`` best by score, what the first ``hits`` papers say besides (items: paper_id, kind, ord, text, from their extractions), ranked by kind and specificity, the ``limit`` best of these."""
    order = ["hit_rank", "ord", "paper_id", "kind", "text"]
    found = evidence.select(*order, "score").orderBy(F.desc("score"), *order).limit(limit)
    if items is not None:
        first = evidence.filter(F.col("hit_rank") <= hits).select("paper_id", "hit_rank").distinct()
        base = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in ADDED_SCORE.items()])
        more = items.filter(F.trim("text") != "").join(small(first), "paper_id").groupBy("paper_id", "kind", "text").agg(F.min("hit_rank").alias("hit_rank"), F.min("ord").alias("ord"))
        more = more.join(found, ["paper_id", "kind", "text"], "left_anti").select("hit_rank", (F.col("ord") + 1_000_000).alias("ord"), "paper_id", "kind", "text", (base + specificity(F.col("text"))).alias("score"))
        found = found.union(more)
    ranked = found.withColumn("answer_score", answer_rank(F.col("kind"), F.col("text"), F.col("score")))
    return ranked.orderBy(F.desc("answer_score"), *order).limit(limit)


def cited_or_all(evidence: DataFrame, cited: DataFrame) -> DataFrame:
    """Evidence of cited papers; all of it where no citation matches any."""
    ids = cited.select("paper_id").distinct()
    some = evidence.join(ids, "paper_id", "left_semi")
    any_ = some.limit(1).agg(F.count("*").alias("_some"))  # one row
    marked = evidence.join(ids.withColumn("_cited", F.lit(True)), "paper_id", "left").crossJoin(F.broadcast(any_))
    return marked.filter(F.coalesce("_cited", F.lit(False)) | (F.col("_some") == 0)).drop("_cited", "_some")


# What stands in brackets, and how labels of sources begin.
CITATION = r"\[([^\]]+)\]"
SOURCE = "^(arxiv:|doi:|p)"


def bracketed(text: Column) -> Column:
    """What stands in square brackets, cut at commas and semicolons."""
    parts = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1)), lambda x: F.split(x, "[,;][ \\t\\r\\n]*")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def citation_labels(text: Column) -> Column:
    """Labels in brackets that name a source (arxiv:, doi: or p...), lower-cased, once each."""
    return F.array_distinct(F.filter(F.transform(bracketed(text), F.lower), lambda x: x.rlike(SOURCE)))


def cited_ids(text: Column) -> Column:
    """The ids that a text cites, sorted, as they are written."""
    return F.array_sort(F.array_distinct(F.filter(bracketed(text), lambda x: x.rlike(SOURCE))))


def invalid_citations(text: Column) -> Column:
    """Labels in brackets that name no source: numbers, ranges and other words."""
    return F.filter(bracketed(text), lambda x: ~x.rlike(SOURCE))


def cleaned_evidence(text: Column) -> Column:
    """A text in which brackets that name no source are round ones."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[ \t\r\n]*(?!arxiv:|doi:|p)([^\]]+?)[ \t\r\n]*\]", "($1)")


def extractive_answer(question: str, evidence: DataFrame, titles: DataFrame, *, lines: int = 5) -> DataFrame:
    """One row: question, answer (a line for each of the best pieces of evidence, with its paper cited), no_answer. evidence: as evidence_for_answer() gives it; titles: paper_id, title."""
    best = evidence.orderBy(F.desc("answer_score"), "hit_rank", "ord", "paper_id", "kind", "text").limit(lines).join(titles, "paper_id", "left")
    line = F.concat(F.lit("- ["), F.col("paper_id"), F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), "paper_id"), F.lit(": "), cleaned_evidence(F.col("text")))
    key = F.struct((-F.col("answer_score")).alias("s"), "hit_rank", "ord", "paper_id", "kind", "text", line.alias("line"))
    said = best.agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"]).alias("l"))
    head, none = f"Local KG evidence for '{question}':", f"No matching evidence was found in the local KG for: {question}"
    text = F.when(F.size("l") == 0, none).otherwise(F.array_join(F.concat(F.array(F.lit(head)), F.col("l")), "\n"))
    return said.select(F.lit(question).alias("question"), text.alias("answer"), (F.size("l") == 0).alias("no_answer"))


def _pieces(text: Column, size: int, step: int, least: int) -> Column:
    """Stretches of a text (lower case) that are looked for: each of ``size`` characters, ``step`` after the one before."""
    low = F.lower(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - size, F.lit(1)) - 1, F.lit(step))
    return F.filter(F.array_distinct(F.transform(starts, lambda i: F.trim(F.substr(low, i + 1, F.lit(size))))), lambda p: F.length(p) >= least)


def excerpts(needles: DataFrame, texts: DataFrame, *, size: int = 120, step: int = 80, least: int = 30) -> DataFrame:
    """needle_id, doc_id, position (from 1), length: the longest stretch of a needle that a text has (the first of equals), in any case, and where it has it first.

    Needles (needle_id, text) are looked for in stretches of ``size`` characters, so that one whose
    middle is quoted is found as well; those shorter than ``least`` have none. A stretch's longest
    inner word, or where it has none its first letters, is looked up among those of the texts by an
    equi-join; only texts that have it are searched for the stretch.
    """
    piece = needles.select("needle_id", F.posexplode(_pieces(F.col("text"), size, step, least)).alias("k", "probe"))
    inner = F.split(F.col("probe"), "[^\\p{L}\\p{N}]+")
    # The first and last pieces may be cut words; the longest of the others is the most telling.
    whole = F.filter(F.slice(inner, 2, F.greatest(F.lit(0), F.size(inner) - 2)), lambda w: w != "")
    longest = F.array_max(F.transform(whole, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    piece = piece.withColumn("word", longest)
    low = texts.select("doc_id", F.lower("text").alias("low"))
    found = _held(low, piece.filter("word is not null"), F.array_distinct(F.split("low", "[^\\p{L}\\p{N}]+")))
    bare = piece.filter("word is null")
    if not bare.isEmpty():
        bare = bare.withColumn("word", F.substring("probe", 1, 8))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low") - 7)), lambda i: F.substr("low", i, F.lit(8))))
        found = found.union(_held(low, bare, grams))
    best = F.min(F.struct((-F.length("probe")).alias("n"), "k", "position")).alias("b")
    return found.groupBy("needle_id", "doc_id").agg(best).select("needle_id", "doc_id", F.col("b.position").cast("long").alias("position"), (-F.col("b.n")).cast("long").alias("length"))


def _held(low: DataFrame, piece: DataFrame, keys: Column) -> DataFrame:
    """needle_id, doc_id, k, probe, position of the stretches (needle_id, k, probe, word) that texts (doc_id, low) hold, through keys of theirs."""
    asked = piece.select("word").distinct()
    words = low.select("doc_id", F.explode(keys).alias("word")).join(small(asked), "word", "left_semi")
    pairs = words.join(small(piece), "word").select("doc_id", "needle_id", "k", "probe")
    found = low.join(pairs, "doc_id").withColumn("position", F.position("probe", "low"))
    return found.filter("position > 0").select("needle_id", "doc_id", "k", "probe", "position")


def last_turns(messages: DataFrame, *, turns: int = 6, chars: int = 900) -> DataFrame:
    """conv_id, turn, line: the last turns of each conversation as lines 'Role: text', white space squeezed, text cut."""
    k = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    said = F.substring(F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " ")), 1, chars)
    who = F.when(F.col("role") == "assistant", "Assistant").when(F.col("role") == "user", "User").otherwise("System")
    return messages.withColumn("_k", k).filter(F.col("_k") <= turns).select("conv_id", "turn", F.concat(who, F.lit(": "), said).alias("line"))


def hypotheses(evidence: DataFrame, *, limit: int = 10) -> DataFrame:
    """kind (hint, shared), subject, field, n_papers, score of what evidence (hit_rank, ord, paper_id, kind, label, field, score) suggests, the best first.

    A hint of another field scores one more than it did. A method or concept that two papers name
    (in any case) scores its first four pieces of evidence, in order of hits, and one for each paper.
    """
    hint = evidence.filter("kind = 'cross_domain_hint'").select(F.lit("hint").alias("kind"), F.col("paper_id").alias("subject"), F.coalesce(F.nullif("field", F.lit("")), F.lit("another field")).alias("field"), F.lit(1).cast("long").alias("n_papers"), (F.col("score") + 1.0).alias("score"))
    named = evidence.filter(F.col("kind").isin("method", "concept") & (F.coalesce("label", F.lit("")) != "")).withColumn("key", F.lower("label"))
    n = named.groupBy("key").agg(F.count_distinct("paper_id").alias("n_papers")).filter("n_papers >= 2")
    first = named.withColumn("_k", F.row_number().over(W.partitionBy("key").orderBy("hit_rank", "ord", "paper_id"))).filter("_k <= 4").groupBy("key").agg(F.sum("score").alias("s"))
    shared = n.join(first, "key").select(F.lit("shared").alias("kind"), F.col("key").alias("subject"), F.lit(None).cast("string").alias("field"), "n_papers", (F.col("s") + F.col("n_papers")).alias("score"))
    return hint.union(shared).orderBy(F.desc("score"), "kind", "subject", "field").limit(max(0, limit))
