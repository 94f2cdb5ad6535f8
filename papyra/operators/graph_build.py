"""Graph build: metadata and extractions become node and edge tables, which the caller writes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recovery import scientific_text
from ..functions.scalars import as_int, first_filled, record_id, slug
from ..functions.text import squeeze
from ..shared import kept
from .extraction import blocked, resolve_papers
from .graph import citation_ids, co_citation, merge_edges, with_stubs


def clean_label(label: Column, size: int = 160) -> Column:
    """A label with white space squeezed, signs and brackets off its ends, cut. Only labels beyond ASCII are sent to Python for their normal form."""
    wide = label.rlike("[^\\x00-\\x7F]")
    normal = F.when(wide, scientific_text(F.when(wide, label))).otherwise(label)
    return F.substring(F.btrim(squeeze(F.coalesce(normal, F.lit(""))), F.lit(" .,:;()[]{}")), 1, size)


def node_id(prefix: str, canonical: Column, label: Column) -> Column:
    """The canonical id, else prefix:slug, else a piece of the label's SHA-1."""
    s = slug(label, mark="-")
    made = F.concat(F.lit(f"{prefix}:"), F.when(s != "", s).otherwise(F.substring(F.sha1(label), 1, 16)))
    return F.coalesce(F.nullif(canonical, F.lit("")), made)


def first_of_each(labels: Column) -> Column:
    """Labels cleaned, each once in any case, the first spelling."""
    clean = F.filter(F.transform(labels, lambda x: clean_ascii(x)), lambda x: x != "")
    keys = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def clean_ascii(label: Column, size: int = 160) -> Column:
    """clean_label() for labels that are in normal form already."""
    return F.substring(F.btrim(squeeze(F.coalesce(label, F.lit(""))), F.lit(" .,:;()[]{}")), 1, size)


def weight(entity: Column) -> Column:
    return F.coalesce(entity["confidence"], F.lit(1.0))


def evidence_of(entity: Column, names: list[str]) -> Column:
    """The first filled of evidence, quoted or not, and context, cut."""
    fields = [entity[n] for n in ("evidence_span", "evidence", "context") if n in names]
    return F.substring(F.coalesce(first_filled(*fields), F.lit("")), 1, 360)


# The roles, sources and standing that name a paper's relation to what it mentions.
REVIEWED_SALIENCE, DISCUSSED_ROLES, MENTIONED_SOURCES = ("central", "supporting"), ("metric", "theory", "domain_concept", "method_family"), ("baseline", "background")


def concept_relation(paper_type: Column, salience: Column, evidence_role: Column) -> Column:
    """Surveys review what is central or supporting to them; metrics, theories, domains and families are discussed; the rest is mentioned."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.when((low(paper_type) == "survey") & low(salience).isin(*REVIEWED_SALIENCE), "REVIEWS").when(low(evidence_role).isin(*DISCUSSED_ROLES), "DISCUSSES").otherwise("MENTIONS")


def method_relation(paper_type: Column, source_type: Column) -> Column:
    """Contributions are introduced; surveys and reviewed methods: reviewed; baselines and background: mentioned; others are used."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.when(low(source_type) == "paper_contribution", "INTRODUCES").when((low(paper_type) == "survey") | (low(source_type) == "reviewed_method"), "REVIEWS").when(low(source_type).isin(*MENTIONED_SOURCES), "MENTIONS").otherwise("USES")


def accepted(items: Column, split: Column, threshold: float) -> Column:
    """Entities that may be written: never scanned ones; of rows that keep candidates apart (split) approved ones that nothing withholds; of older rows those sure enough, 1 if nothing is said."""
    plain = F.filter(items, lambda x: ~F.coalesce(x["auto_detected"], F.lit(False)) & (F.coalesce(x["candidate_source"], F.lit("")) != "deterministic_scan"))
    approved = F.filter(plain, lambda x: (F.lower(F.trim(x["review_status"])) == "approved") & F.coalesce(x["accepted_for_kg_write"], F.lit(True)))
    return F.when(split, approved).otherwise(F.filter(plain, lambda x: F.coalesce(x["confidence"], F.lit(1.0)) >= threshold))


def accepted_relations(relations: Column) -> Column:
    """Approved relations with evidence."""
    return F.filter(relations, lambda x: (F.lower(x["review_status"]) == "approved") & (F.coalesce(x["evidence_span"], F.lit("")) != ""))


def citation_edges(papers: DataFrame) -> DataFrame:
    """src, dst: what papers (id, source, source_id, citations, references) cite, without themselves, once each."""
    own = record_id(papers["id"], papers["source"], papers["source_id"])
    rows = papers.select(own.alias("src"), F.explode(citation_ids(papers["citations"], papers["references"])).alias("dst"))
    return rows.filter("src <> dst").distinct()


def paper_rows(papers: DataFrame, now: Column) -> DataFrame:
    """Node rows of papers, the last one (seq) of each id; added_to_graph keeps the first time it was in the graph, else it is now."""
    rows = papers.select(record_id(papers["id"], papers["source"], papers["source_id"]).alias("id"), F.coalesce("title", F.lit("")).alias("title"), "year", F.lower(F.trim("doi")).alias("doi"), "source", F.lit(False).alias("is_stub"), F.coalesce("added_to_graph", now).alias("added_to_graph"), "seq")
    first = rows.groupBy("id").agg(F.min("added_to_graph").alias("added_to_graph"), F.max_by(F.struct("title", "year", "doi", "source", "is_stub"), "seq").alias("b"))
    return first.select("id", "b.title", "b.year", "b.doi", "b.source", "b.is_stub", "added_to_graph")


def graph_entities(extractions: DataFrame, papers: DataFrame) -> DataFrame:
    """extraction_id, paper_id (of the paper that the extraction's id resolves to, else its own), known, role, node_id, label, item, paper_type: each node of a paper once, the first over its extractions (newest first), concepts before methods.

    extractions: id, paper_id, extraction_status, extraction_timestamp, paper_type, metadata_status,
    blocking_errors, raw_response, split, concepts, methods (arrays of one struct type). papers: id, ord.
    """
    good = extractions.filter((F.col("extraction_status") == "success") & (F.coalesce("paper_id", F.lit("")) != "") & ~blocked(F.col("metadata_status"), F.col("blocking_errors"), F.col("raw_response")))
    ids = good.select(F.col("paper_id").alias("identifier")).distinct()
    found = resolve_papers(ids, papers).select("identifier", F.col("paper_id").alias("_found"))
    good = good.join(found, good["paper_id"] == found["identifier"], "left")
    concepts, methods = accepted(F.col("concepts"), F.col("split"), 0.75), accepted(F.col("methods"), F.col("split"), 0.70)
    marked = lambda items, role: F.transform(items, lambda x, i: F.struct(F.lit(role).alias("role"), i.alias("ord"), x.alias("item")))
    rows = good.select(F.col("id").alias("extraction_id"), F.coalesce("_found", "paper_id").alias("paper_id"), F.col("_found").isNotNull().alias("known"), "paper_type", "extraction_timestamp", F.inline(F.concat(marked(concepts, "concept"), marked(methods, "method"))))
    rows = rows.withColumn("label", clean_label(F.col("item.label"))).filter("label <> ''")
    node = F.when(F.col("role") == "concept", node_id("concept", F.col("item.canonical_id"), F.col("label"))).otherwise(node_id("method", F.col("item.canonical_id"), F.col("label")))
    order = F.struct((-F.unix_micros(F.col("extraction_timestamp").cast("timestamp"))).alias("t"), (-F.col("extraction_id")).alias("e"), (F.col("role") == "method").alias("r"), "ord")
    best = rows.withColumn("node_id", node).groupBy("paper_id", "node_id").agg(F.min_by(F.struct("extraction_id", "known", "role", "label", "item", "paper_type"), order).alias("b"))
    return best.select("b.extraction_id", "paper_id", "b.known", "b.role", "node_id", "b.label", "b.item", "b.paper_type")


class Graph:
    """The node and edge tables of a build. Each is planned when it is asked for, so a caller pays for what it reads; the entities behind most of them are found once and written down."""

    def __init__(self, papers: DataFrame, extractions: DataFrame, now: Column, min_shared: int, min_score: float):
        self._papers, self._extractions, self._now, self._least = papers, extractions, now, (min_shared, min_score)
        self._names = extractions.schema["concepts"].dataType.elementType.names

    def _has(self, name: str) -> Column:
        return F.col("item")[name] if name in self._names else F.lit(None).cast("string")

    @cached_property
    def _nodes(self) -> DataFrame:
        return paper_rows(self._papers, self._now)

    @cached_property
    def entities(self) -> DataFrame:
        """As graph_entities() gives them."""
        return kept(graph_entities(self._extractions, self._nodes.select("id", F.lit(0).alias("ord"))))

    @cached_property
    def papers(self) -> DataFrame:
        """id, title, year, doi, source, is_stub, added_to_graph"""
        with_cited = with_stubs(self._nodes, self.citations)
        unknown = self.entities.filter("not known").select(F.col("paper_id").alias("id")).distinct().join(with_cited, "id", "left_anti")
        stub = unknown.select("id", F.lit("").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("doi"), F.lit("extraction_stub").alias("source"), F.lit(True).alias("is_stub"), self._now.alias("added_to_graph"))
        return with_cited.unionByName(stub)

    @cached_property
    def citations(self) -> DataFrame:
        """src, dst"""
        return citation_edges(self._papers)

    @cached_property
    def similar(self) -> DataFrame:
        """src, dst, score, shared"""
        return co_citation(self.citations, min_shared=self._least[0], min_score=self._least[1])

    @cached_property
    def concepts(self) -> DataFrame:
        """id, label, aliases, domain"""
        has, item = self._has, F.col("item")
        return self.entities.filter("role = 'concept'").groupBy(F.col("node_id").alias("id")).agg(F.max_by(F.struct(clean_ascii(first_filled(has("canonical_label"), F.col("label"))).alias("label"), first_of_each(F.concat(F.array("label"), F.coalesce(item["aliases"], F.array().cast("array<string>")))).alias("aliases"), F.coalesce(has("domain"), F.lit("")).alias("domain")), F.struct("extraction_id", "paper_id")).alias("b")).select("id", "b.*")

    @cached_property
    def methods(self) -> DataFrame:
        """id, label, domain, description"""
        has = self._has
        return self.entities.filter("role = 'method'").groupBy(F.col("node_id").alias("id")).agg(F.max_by(F.struct(clean_ascii(first_filled(has("canonical_label"), F.col("label"))).alias("label"), F.coalesce(has("domain"), F.lit("")).alias("domain"), F.coalesce(first_filled(has("description"), has("context")), F.lit("")).alias("description")), F.struct("extraction_id", "paper_id")).alias("b")).select("id", "b.*")

    @cached_property
    def mentions(self) -> DataFrame:
        """paper_id, node_id, role, relation, weight, evidence, source"""
        has, item = self._has, F.col("item")
        relation = F.when(F.col("role") == "concept", concept_relation(F.col("paper_type"), has("salience"), has("evidence_role"))).otherwise(method_relation(F.col("paper_type"), has("source_type")))
        source = F.coalesce(first_filled(has("source_type"), has("evidence_role"), has("source")), F.lit(""))
        return self.entities.select("paper_id", "node_id", "role", relation.alias("relation"), weight(item).alias("weight"), evidence_of(item, self._names).alias("evidence"), source.alias("source"))

    @cached_property
    def related(self) -> DataFrame:
        """src, relation, dst, evidence, confidence, source"""
        return related(self._extractions, self.entities)


def build(papers: DataFrame, extractions: DataFrame, now: Column, *, min_shared: int = 2, min_score: float = 0.25) -> Graph:
    """All node and edge tables of papers (with seq, citations, references, added_to_graph) and their extractions (with relations). Ids that papers cite and that only extractions know become stubs."""
    return Graph(papers, extractions, now, min_shared, min_score)


def related(extractions: DataFrame, entities: DataFrame) -> DataFrame:
    """src, relation, dst, evidence, confidence, source: accepted relations both of whose ends are concepts that the same extraction wrote; the last (extraction, place) of equal ends and relation."""
    mine = entities.filter("role = 'concept'").select("extraction_id", "node_id")
    rows = extractions.select(F.col("id").alias("extraction_id"), F.posexplode(accepted_relations(F.col("relations"))).alias("ord", "r")).select("extraction_id", "ord", F.col("r.subject_id").alias("src"), F.coalesce(F.nullif(F.col("r.relation_type"), F.lit("")), F.lit("RELATED_TO")).alias("relation"), F.col("r.object_id").alias("dst"), F.col("r.evidence_span").alias("evidence"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("r.source", F.lit("")).alias("source"))
    rows = rows.filter("src <> '' and dst <> '' and src <> dst")
    rows = rows.join(mine.withColumnRenamed("node_id", "src"), ["extraction_id", "src"], "left_semi").join(mine.withColumnRenamed("node_id", "dst"), ["extraction_id", "dst"], "left_semi")
    return merge_edges(rows.select("src", "relation", "dst", F.struct("extraction_id", "ord").alias("seq"), "evidence", "confidence", "source"), keys=("src", "relation", "dst")).drop("seq")


def stats(graph: Graph, papers: DataFrame) -> DataFrame:
    """One row of counts of a build: papers_seen, papers_written, citation_edges, concept_nodes, method_nodes, concept_edges, method_edges, relation_edges."""
    one = lambda df, **named: df.agg(*[c.alias(n) for n, c in named.items()])
    out = one(papers, papers_seen=F.count("*"))
    for part in (one(graph.papers, papers_written=F.count("*")), one(graph.citations, citation_edges=F.count("*")), one(graph.concepts, concept_nodes=F.count("*")), one(graph.methods, method_nodes=F.count("*")), one(graph.mentions, concept_edges=F.count_if(F.col("role") == "concept"), method_edges=F.count_if(F.col("role") == "method")), one(graph.related, relation_edges=F.count("*"))):
        out = out.crossJoin(part)  # rows of one
    return out


def stub_year(coverage: Column) -> Column:
    """The year of a paper that only an extraction knows, from its temporal coverage in JSON."""
    return as_int(F.get_json_object(coverage, "$.paper_year"))
