"""Literature graph: nodes, citation edges, similarity from shared references, explorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import first_filled, record_id, round4


def citation_ids(citations: Column, references: Column) -> Column:
    """Ids of an array of (paperId, doi, id, source_id, title) structs: of citations, else of references; first key that is filled, in order, once each."""
    items = F.when(F.size(citations) > 0, citations).otherwise(references)
    key = lambda x: first_filled(x["paperId"], x["doi"], x["id"], x["source_id"], x["title"])
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array()), lambda x: F.trim(key(x))), lambda k: k.isNotNull() & (k != "")))


def paper_nodes(papers: DataFrame) -> DataFrame:
    """Node rows of full papers: id, title, year, doi, source, is_stub."""
    return papers.select(record_id(papers["id"], papers["source"], papers["source_id"]).alias("id"), "title", "year", "doi", "source", F.lit(False).alias("is_stub"))


def with_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes and a stub for each cited id that has none. A full row always stands before a stub, in whatever order they came."""
    missing = edges.select(F.col("dst").alias("id")).distinct().join(nodes, "id", "left_anti")
    stub = missing.select("id", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns if c not in ("id", "source", "is_stub")], F.lit("citation_reference").alias("source"), F.lit(True).alias("is_stub"))
    return nodes.unionByName(stub)


def merge_edges(edges: DataFrame, keys: tuple[str, ...] = ("src", "dst"), seq: str = "seq") -> DataFrame:
    """One edge per key, the last one; keys with the relation keep relations between the same ends apart."""
    rest = [c for c in edges.columns if c not in keys]
    return edges.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("last")).select(*keys, *[F.col(f"last.{c}") for c in rest])


#: Sources in one row of a list, pairs that one task counts, and sources of a reference up to which all pairs of them are made.
CHUNK, COUNTED, HOT = 512, 2_000_000, 1_000


def _load(e: DataFrame) -> tuple[int, int]:
    """The most sources of a reference, and about how many tasks it takes to count pairs."""
    cited = e.groupBy("dst").agg(F.count("*").alias("df"))
    most, pairs = cited.agg(F.max("df"), F.sum(F.col("df") * F.least("df", F.lit(HOT)) / 2)).first()
    least = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return most or 0, min(20_000, max(least, int(pairs or 0) // COUNTED))


def _later(sources: DataFrame, others: DataFrame) -> DataFrame:
    """sources (src, dst, ...) with later, the sources of their reference (src, dst of others) after them in order, in lists of CHUNK at most."""
    part = F.floor(F.row_number().over(W.partitionBy("dst").orderBy("src")) / CHUNK)
    lists = others.select("src", "dst", part.alias("_p")).groupBy("dst", "_p").agg(F.collect_list("src").alias("_all"))
    met = sources.join(lists, "dst").withColumn("later", F.filter("_all", lambda x: x > F.col("src")))
    return met.filter(F.size("later") > 0).drop("dst", "_p", "_all")


def _counted(met: DataFrame, tasks: int) -> DataFrame:
    """l, r, n and what else a source has: how many lists of a source hold another. Lists are shuffled by source, not a row for each pair; pairs are made and counted there."""
    rest = [c for c in met.columns if c not in ("src", "later")]
    pairs = met.repartition(tasks, "src").select(F.col("src").alias("l"), *rest, F.explode("later").alias("r"))
    return pairs.groupBy("l", "r", *rest).agg(F.count("*").alias("n"))


def co_citation(edges: DataFrame, *, min_shared: int = 2, min_score: float = 0.25) -> DataFrame:
    """src, dst, score, shared in both directions: overlap coefficient of reference lists (src, dst of edges).

    Sources of a single reference can't share two and drop out first. Of each other source the
    reference that most sources have is its last one, if it has more than HOT. Two sources that
    share nothing but a reference that is last for both share one only, so last ones meet no last
    ones: a reference that everyone has makes no pairs. It is counted afterwards by comparing the
    two. Pairs that share too little go where they are counted.
    """
    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    most, tasks = _load(e)
    own = W.partitionBy("src")
    if most > HOT and min_shared >= 2:
        cited = e.groupBy("dst").agg(F.count("*").alias("df"))
        e = e.join(cited, "dst").withColumns({"deg": F.count("*").over(own), "k": F.row_number().over(own.orderBy(F.desc("df"), "dst"))})
        e = e.filter(F.col("deg") >= min_shared).select("src", "dst", "deg", ((F.col("k") == 1) & (F.col("df") > HOT)).alias("last"))
        e = e.withColumn("hot", F.max("last").over(own))
        rows = e.select("src", "dst", "hot", "last")
        met = _later(rows.filter("not last"), rows).union(_later(rows.filter("last"), rows.filter("not last")))
    else:
        e = e.withColumn("deg", F.count("*").over(own)).filter(F.col("deg") >= min_shared).withColumns({"last": F.lit(False), "hot": F.lit(False)})
        met = _later(e.select("src", "dst", "hot", "last"), e)
    pairs = _counted(met.drop("last"), tasks).filter(F.col("hot") | (F.col("n") >= min_shared))
    per = e.groupBy("src").agg(F.max("deg").alias("deg"), F.max(F.when(F.col("last"), F.col("dst"))).alias("top"))
    lo, ro = per.toDF("l", "dl", "tl"), per.toDF("r", "dr", "tr")
    full = pairs.join(lo, "l").join(ro, "r").withColumn("shared", F.col("n") + F.when(F.col("tl") == F.col("tr"), 1).otherwise(0))
    raw = F.col("shared") / F.greatest(F.lit(1), F.least("dl", "dr"))
    kept = full.filter((F.col("shared") >= min_shared) & (raw >= min_score)).select("l", "r", round4(raw).alias("score"), "shared")
    both = F.array(F.struct(F.col("l").alias("src"), F.col("r").alias("dst")), F.struct(F.col("r").alias("src"), F.col("l").alias("dst")))
    return kept.select(F.inline(both), "score", "shared")


def jaccard_pairs(edges: DataFrame, *, min_score: float = 0.1) -> DataFrame:
    """src, dst (src < dst), shared, score: Jaccard similarity of reference lists. A pair scores no more than what it shares of its first list, so most pairs go where they are counted."""
    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    _, tasks = _load(e)
    own = e.withColumn("ds", F.count("*").over(W.partitionBy("src")))
    pairs = _counted(_later(own, e), tasks).filter(F.col("n") / F.col("ds") >= min_score)
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    full = pairs.select(F.col("l").alias("src"), F.col("r").alias("dst"), "ds", F.col("n").alias("shared")).join(deg.toDF("dst", "dd"), "dst")
    raw = F.col("shared") / (F.col("ds") + F.col("dd") - F.col("shared"))
    return full.filter(raw >= min_score).select("src", "dst", "shared", round4(raw).alias("score"))


def neighbours(edges: DataFrame, paper: object, *, limit: int = 10) -> DataFrame:
    """kind (citation, cited_by, similar), id, score, rank around one paper: what it cites and what cites it, by id, and the papers with the most similar references (Jaccard)."""
    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    mine = e.filter(F.col("src") == F.lit(paper)).select("dst")
    out = mine.select(F.lit("citation").alias("kind"), F.col("dst").alias("id"), F.lit(None).cast("double").alias("score"))
    back = e.filter(F.col("dst") == F.lit(paper)).select(F.lit("cited_by").alias("kind"), F.col("src").alias("id"), F.lit(None).cast("double").alias("score"))
    size = mine.agg(F.count("*").alias("own"))
    shared = e.filter(F.col("src") != F.lit(paper)).join(mine, "dst", "left_semi").groupBy("src").agg(F.count("*").alias("shared"))
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    near = shared.join(deg, "src").crossJoin(F.broadcast(size)).select(F.lit("similar").alias("kind"), F.col("src").alias("id"), round4(F.col("shared") / (F.col("deg") + F.col("own") - F.col("shared"))).alias("score"))
    order = W.partitionBy("kind").orderBy(F.desc_nulls_last("score"), "id")
    return out.union(back).union(near).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def explorer_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, edge_types (sorted, joined by commas)."""
    n = nodes.select("id").distinct().agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("edge_types"))
    return n.crossJoin(e)


def relation_of_concept(paper_type: Column, role: Column, confidence: Column) -> Column:
    """Relation of a paper to a concept: surveys review, central or sure ones discuss, others mention."""
    return F.when(F.lower(paper_type) == "survey", "REVIEWS").when((F.lower(role) == "central") | (confidence >= 0.85), "DISCUSSES").otherwise("MENTIONS")


def accepted_entities(items: Column, legacy: Column, threshold: float) -> Column:
    """Entities (review_status, auto_detected, candidate_source, confidence) that may be written to the graph: approved ones that no scan proposed; rows of old layouts by confidence, 1 if missing."""
    new = F.filter(items, lambda x: ~F.coalesce(x["auto_detected"], F.lit(False)) & (F.coalesce(x["candidate_source"], F.lit("")) != "deterministic_scan") & (x["review_status"] == "approved"))
    old = F.filter(items, lambda x: F.coalesce(x["confidence"], F.lit(1.0)) >= threshold)
    return F.when(legacy, old).otherwise(new)
