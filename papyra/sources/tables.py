"""Readers: fixed schemas, listings, lookups, JSON at the edge, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D, _F, _B, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.FloatType(), T.BooleanType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


#: Items of extraction lists; further keys of the JSON are dropped.
ENTITY = _schema(label=_S, entity_type=_S, domain=_S, context=_S, description=_S, evidence_span=_S, section=_S, confidence=_D, salience=_S, source_type=_S, aliases=T.ArrayType(_S), auto_detected=_B, candidate_source=_S, canonical_id=_S, canonical_label=_S, review_status=_S, kg_layer=_S)
RELATION = _schema(subject_id=_S, relation_type=_S, object_id=_S, evidence_span=_S, section=_S, confidence=_D, source=_S, review_status=_S)
CLAIM = _schema(statement=_S, claim_type=_S, evidence_type=_S, negated=_B, attributed_to=_S)

#: The store's tables. Scores stay 32-bit, as they are compared after that rounding.
SCHEMAS = {
    "papers": _schema(id=_S, source=_S, source_id=_S, title=_S, authors=T.ArrayType(_S), year=_I, abstract=_S, doi=_S, references=T.ArrayType(_S), citations=T.ArrayType(_S), pdf_url=_S, has_full_text=_B, retracted=_B, conflict_flag=_B, quality_score=_F, obsolescence_score=_F, citation_count=_I, version=_I, added_timestamp=_TS, updated_timestamp=_TS),
    "extraction_results": _schema(id=T.LongType(), paper_id=_S, extraction_status=_S, paper_type=_S, concepts=T.ArrayType(ENTITY), methods=T.ArrayType(ENTITY), relations=T.ArrayType(RELATION), claims=T.ArrayType(CLAIM), extraction_duration_seconds=_D, extraction_timestamp=_TS),
    "batch_jobs": _schema(job_id=_S, status=_S, papers_total=_I, papers_completed=_I, papers_failed=_I, created_timestamp=_TS, updated_timestamp=_TS),
    "batch_job_items": _schema(job_id=_S, paper_id=_S, pdf_path=_S, status=_S, attempts=_I, error=_S, started_timestamp=_TS, completed_timestamp=_TS),
    "entity_embeddings": _schema(label=_S, label_norm=_S, model=_S, embedding_version=_S, backend=_S, dimension=_I, vector=T.ArrayType(_F), updated_timestamp=_TS),
    "entity_review_queue": _schema(id=T.LongType(), paper_id=_S, label=_S, entity_type=_S, canonical_id=_S, confidence=_D, evidence_span=_S, review_status=_S, created_timestamp=_TS),
    "notes": _schema(id=_S, project_id=_S, title=_S, markdown=_S, created_timestamp=_TS, updated_timestamp=_TS),
    "note_citations": _schema(id=_S, note_id=_S, paper_id=_S, quote=_S, created_timestamp=_TS),
    "note_ai_messages": _schema(id=_S, thread_id=_S, role=_S, content=_S, created_timestamp=_TS),
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def listing(rows: DataFrame, *, by: str, key: str, where: Column | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first, ties by key; the filter comes before the page."""
    out = rows if where is None else rows.filter(where)
    out = out.orderBy(F.desc(by), key)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def with_children(parents: DataFrame, children: DataFrame, *, on: str, order: str, name: str) -> DataFrame:
    """parents with an array of their children in order; empty where there are none. (For lists that people write: notes, citations, messages.)"""
    fields = [order, *[c for c in children.columns if c not in (on, order)]]
    lists = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = lists.schema[name].dataType
    return parents.join(lists, on, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def json_items(value: Column, item: str) -> Column:
    """Items of a JSON list; one object is a list of one; bad or missing JSON has none."""
    kind = f"array<{item}>"
    return F.coalesce(F.from_json(value, kind), F.array().cast(kind))


def openalex_record(works: DataFrame) -> DataFrame:
    """OpenAlex works (nested JSON rows) as uniform records."""
    return works.select(
        F.lit("openalex").alias("source"), F.regexp_extract("id", "([^/]+)$", 1).alias("source_id"), F.col("title"), F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"),
        F.col("publication_year").cast("int").alias("year"), F.regexp_replace(F.lower("doi"), "^https?://doi\\.org/", "").alias("doi"), F.transform("referenced_works", lambda r: F.regexp_extract(r, "([^/]+)$", 1)).alias("references"), F.col("cited_by_count").cast("int").alias("citation_count"),
    )


def semantic_scholar_record(papers: DataFrame) -> DataFrame:
    """Semantic Scholar papers as uniform records."""
    return papers.select(
        F.lit("semantic_scholar").alias("source"), F.col("paperId").alias("source_id"), F.col("title"), F.transform("authors", lambda a: a["name"]).alias("authors"),
        F.col("year").cast("int").alias("year"), F.lower(F.col("externalIds.DOI")).alias("doi"), F.transform("references", lambda r: r["paperId"]).alias("references"), F.col("citationCount").cast("int").alias("citation_count"),
    )


def open_access_url(locations: DataFrame) -> DataFrame:
    """doi, url: the best open copy, its PDF before its page."""
    return locations.select("doi", F.coalesce("best_oa_location.url_for_pdf", "best_oa_location.url").alias("url"))


def harvested_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Landed API responses, one JSON document a file, with the file's name."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file_name", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1))


def pdf_listing(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, version, path, size of files named {paper_id}_v{version}.pdf; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", F.col("length").alias("size"))
    name = F.regexp_extract("path", "([^/]+)\\.pdf$", 1)
    return files.select(F.regexp_extract(name, "^(.*)_v([0-9]+)$", 1).alias("paper_id"), F.regexp_extract(name, "^(.*)_v([0-9]+)$", 2).try_cast("int").alias("version"), "path", "size")


def by_key(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The rows of one key: the filter reaches the scan."""
    return rows.filter(F.col(column) == F.lit(value))


def extractions_of(extractions: DataFrame, identifiers: DataFrame) -> DataFrame:
    """identifier with the extractions (paper_id, ...) of any name that it goes by."""
    from ..operators.extraction import identifier_aliases

    names = identifiers.select("identifier", F.explode(identifier_aliases(F.col("identifier"))).alias("_alias"))
    own = extractions.withColumn("_alias", F.explode(identifier_aliases(F.col("paper_id"))))
    return names.join(own, "_alias").drop("_alias").distinct()


def vector(value: Column) -> Column:
    """A vector kept as JSON; null where it isn't one."""
    return F.from_json(value, "array<float>")


def json_or_raw(value: Column, kind: str) -> Column:
    """Struct of parsed (null where the JSON is bad) and raw (kept only then)."""
    parsed = F.from_json(value, kind, {"mode": "PERMISSIVE"})
    good = F.try_parse_json(value).isNotNull() & parsed.isNotNull()
    return F.struct(F.when(good, parsed).alias("parsed"), F.when(~F.coalesce(good, F.lit(False)), value).alias("raw"))


ATOM = "struct<entry:array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,link:array<struct<_href:string,_title:string,_rel:string>>>>>"


def arxiv_records(pages: DataFrame, *, body: str = "body") -> DataFrame:
    """Uniform records of Atom feeds, one a page: source_id without its version, version, title, abstract, authors, year, pdf_url."""
    entry = pages.select(F.explode(F.from_xml(F.col(body), ATOM)["entry"]).alias("e"))
    tail = F.regexp_extract("e.id", "abs/(.+)$", 1)
    squeezed = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    pdf = F.get(F.filter("e.link", lambda x: x["_title"] == "pdf"), 0)["_href"]
    return entry.select(
        F.lit("arxiv").alias("source"), F.regexp_replace(tail, "v[0-9]+$", "").alias("source_id"), F.coalesce(F.regexp_extract(tail, "v([0-9]+)$", 1).try_cast("int"), F.lit(1)).alias("version"), squeezed("e.title").alias("title"), squeezed("e.summary").alias("abstract"),
        F.transform("e.author", lambda a: a["name"]).alias("authors"), F.substring("e.published", 1, 4).try_cast("int").alias("year"), pdf.alias("pdf_url"),
    )


_S2_PAPER = "struct<paperId:string,title:string,year:int,citationCount:int,authors:array<struct<name:string>>,externalIds:struct<DOI:string>,references:array<struct<paperId:string>>>"


def semantic_scholar_pages(pages: DataFrame, *, body: str = "body", field: str = "data") -> DataFrame:
    """Uniform records of answers to a search (data) or a request for recommendations (recommendedPapers)."""
    rows = pages.select(F.inline(F.from_json(F.col(body), f"{field} array<{_S2_PAPER}>")[field]))
    return semantic_scholar_record(rows)


def openalex_terms(pages: DataFrame, *, body: str = "body") -> DataFrame:
    """id, label, level, works_count of answers that list topics or concepts."""
    kind = "results array<struct<id:string,display_name:string,level:int,works_count:long>>"
    rows = pages.select(F.inline(F.from_json(F.col(body), kind)["results"]))
    return rows.select(F.regexp_extract("id", "([^/]+)$", 1).alias("id"), F.col("display_name").alias("label"), "level", "works_count")


def papers_with_code(pages: DataFrame, *, body: str = "body") -> DataFrame:
    """Uniform records of answers of that API."""
    kind = "results array<struct<id:string,arxiv_id:string,title:string,abstract:string,authors:array<string>,published:string,url_pdf:string>>"
    rows = pages.select(F.inline(F.from_json(F.col(body), kind)["results"]))
    return rows.select(F.lit("papers_with_code").alias("source"), F.col("id").alias("source_id"), "arxiv_id", "title", "abstract", "authors", F.substring("published", 1, 4).try_cast("int").alias("year"), F.col("url_pdf").alias("pdf_url"))


#: What stands between the pages of a text, and the characters that a text must have to be one.
PAGE_BREAK, LEAST_TEXT = "\n---PAGE BREAK---\n", 100


def pdf_pages(content: bytes) -> list[str]:
    """Texts of a PDF's pages by the first library that is there and reads it; without one, what the file holds as text."""
    import io

    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            pages = [p.extract_text() or "" for p in pdf.pages]
    except Exception:  # not installed, or a file that it can't read: the next way
        pages = []
    if sum(map(len, pages)) <= LEAST_TEXT:
        try:
            from pypdf import PdfReader

            pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
        except Exception:  # as above
            pages = []
    return pages or [content.decode("utf-8", "ignore")]


def pdf_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, n_pages, text (null where nothing readable is found) of the PDFs of a folder, each read by one task."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(parts):
        for p in parts:
            pages = [pdf_pages(bytes(c)) for c in p["content"]]
            texts = [PAGE_BREAK.join(x) for x in pages]
            yield pd.DataFrame({"path": p["path"], "n_pages": [len(x) for x in pages], "text": [t if len(t) > LEAST_TEXT else None for t in texts]})

    return files.mapInPandas(run, "path string, n_pages int, text string")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """canonical_id, label, entity_type, alias, ord of an ontology file: a list of entries (id, label, type, aliases) under any key, JSON, or YAML where a reader for it is installed."""
    import json

    text = "\n".join(r["value"] for r in spark.read.text(path).collect())  # a configuration file
    if path.endswith((".yaml", ".yml")):
        import yaml

        content = yaml.safe_load(text)
    else:
        content = json.loads(text)
    groups = content.values() if isinstance(content, dict) else [content]
    entries = [e for g in groups if isinstance(g, list) for e in g if isinstance(e, dict) and e.get("label")]
    rows = [(str(e.get("id") or e["label"]), str(e["label"]), str(e.get("type") or ""), str(a), i) for i, e in enumerate(entries) for a in [e["label"], *(e.get("aliases") or [])]]
    return spark.createDataFrame(rows, "canonical_id string, label string, entity_type string, alias string, ord int")
