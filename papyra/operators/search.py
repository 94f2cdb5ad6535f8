"""Search over papers and their extractions, with the evidence that was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import round4
from ..functions.text import query_tokens, snippet
from .merge import best_extraction
from .retrieval import cover_first, lexical_score
from .search_index import SearchIndex

# How much the fields of papers and the items of extractions weigh.
PAPER_WEIGHTS = {"title": 4.0, "abstract": 1.5, "doi": 2.0}
ITEM_WEIGHTS = {"concept": 3.0, "method": 3.0, "claim": 2.5, "cross_domain_hint": 2.0, "terminology_conflict": 1.5}
# The fields of an item in the order in which they make its text.
ITEM_FIELDS = ("label", "statement", "context", "description", "domain", "field", "why_applicable", "term", "this_field", "other_field", "evidence_type")
ANSWER_FIELDS = ("statement", "evidence_span", "label", "context", "description", "relation_type", "subject_id", "object_id")


def _joined(fields: list[Column]) -> Column:
    return F.trim(F.array_join(F.filter(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in fields]), lambda x: x != ""), " "))


def item_text(item: Column, names: list[str]) -> Column:
    """Text of an item (a struct with these fields): the telling fields first, then all other plain ones."""
    rest = [n for n in names if n not in ITEM_FIELDS]
    return _joined([item[n] for n in [f for f in ITEM_FIELDS if f in names] + rest])


def answer_item_text(item: Column, names: list[str]) -> Column:
    """Text of an item as answers quote it."""
    return _joined([item[n] for n in ANSWER_FIELDS if n in names])


def search_units(papers: DataFrame, items: DataFrame) -> DataFrame:
    """key, unit, fields, text of papers (paper_id, title, abstract, doi) and of the items of their extractions (paper_id, kind, ord, text), as SearchIndex takes them; text is what snippets are cut from."""
    none = F.lit("")
    whole = F.trim(F.array_join(F.filter(F.array(F.coalesce("title", none), F.coalesce("abstract", none)), lambda x: x != ""), " "))
    unit = lambda kind, ord_: F.struct(F.col("paper_id").alias("paper_id"), kind.alias("kind"), ord_.cast("long").alias("ord")).alias("unit")
    own = papers.select(F.col("paper_id").alias("key"), unit(F.lit("paper"), F.lit(0)), F.array(*[F.coalesce(c, none) for c in PAPER_WEIGHTS]).alias("fields"), whole.alias("text"))
    said = items.select(F.col("paper_id").alias("key"), unit(F.col("kind"), F.col("ord")), F.array(F.coalesce("text", none)).alias("fields"), F.coalesce("text", none).alias("text"))
    return own.union(said)


def evidence(index: SearchIndex, query: str) -> DataFrame:
    """paper_id, kind, ord, score, own (the query's tokens that it has) of all that a query finds in an index of search_units().

    Weights of tokens count papers, each with all of its items. Only postings are read.
    """
    q = query_tokens(query)
    idf = index.idf(q)
    kind, field = F.col("unit.kind"), F.col("field")
    scored = lambda w: lexical_score(F.col("own"), q, idf, w, F.col("phrase"))
    paper = F.coalesce(*[F.when(field == i, scored(w)) for i, w in enumerate(PAPER_WEIGHTS.values())])
    item = F.coalesce(*[F.when(kind == k, scored(w)) for k, w in ITEM_WEIGHTS.items()])
    rows = index.fields(query).withColumn("score", F.coalesce(F.when(kind == "paper", paper).otherwise(item), F.lit(0.0)))
    out = rows.groupBy("unit").agg(F.sum("score").alias("score"), F.array_distinct(F.flatten(F.collect_set("own"))).alias("own")).filter("score > 0")
    return out.select("unit.*", "score", "own")


def with_snippets(found: DataFrame, units: DataFrame, query: str) -> DataFrame:
    """found (from evidence()) with text: a stretch of the unit's text around the query's first token. Texts are read for this only."""
    texts = units.select("unit.*", "text").withColumnsRenamed({"paper_id": "_p", "kind": "_k", "ord": "_o"})
    same = (F.col("paper_id") == F.col("_p")) & (F.col("kind") == F.col("_k")) & (F.col("ord") == F.col("_o"))
    return found.join(texts, same).withColumn("text", snippet(F.col("text"), query_tokens(query))).drop("_p", "_k", "_o")


def search(index: SearchIndex, query: str, *, limit: int = 10, resolved: DataFrame | None = None) -> DataFrame:
    """rank, paper_id, score, n_evidence of the papers that a query finds, those that cover its words first.

    resolved (raw_id, paper_id): ids under which extractions are kept and the papers that they
    mean; evidence of both counts as the paper's. Ids that aren't there stay as they are.
    """
    q = query_tokens(query)
    found = evidence(index, query)
    if resolved is not None:
        found = found.withColumnRenamed("paper_id", "raw_id").join(resolved.groupBy("raw_id").agg(F.min("paper_id").alias("_p")), "raw_id", "left").withColumn("paper_id", F.coalesce("_p", "raw_id"))
    hits = found.groupBy(F.col("paper_id").alias("id")).agg(round4(F.sum("score")).alias("score"), F.array_distinct(F.flatten(F.collect_set("own"))).alias("own"), F.count("*").alias("n_evidence"))
    return cover_first(hits, q, limit=limit).select("rank", F.col("id").alias("paper_id"), "score", "n_evidence")


def paper_detail(papers: DataFrame, extractions: DataFrame, *, most: int = 50) -> DataFrame:
    """papers (id, ...) with latest (the newest success, else the newest extraction: id, extraction_status, extraction_timestamp) and n_extractions, of the ``most`` newest."""
    newest = W.partitionBy("paper_id").orderBy(F.desc("extraction_timestamp"), F.desc("id"))
    kept = extractions.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= most).drop("_n")
    latest = best_extraction(kept).select(F.col("paper_id").alias("_p"), F.struct("id", "extraction_status", "extraction_timestamp").alias("latest"))
    n = kept.groupBy(F.col("paper_id").alias("_q")).agg(F.count("*").alias("n_extractions"))
    out = papers.join(latest, papers["id"] == F.col("_p"), "left").join(n, papers["id"] == F.col("_q"), "left")
    return out.select(*[papers[c] for c in papers.columns], "latest", F.coalesce("n_extractions", F.lit(0)).alias("n_extractions"))
