"""Papers: listings, identity and metadata checks, what an extraction says of its paper, review queue."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_int, blank_to_null, first_filled
from ..functions.text import before_references, normal_key, squeeze
from .extraction import PAPER_TYPES, title_line
from .linking import small
from .merge import latest_status

# Fixed value: the archive's categories before 2007.
LEGACY = "(?:astro-ph|cond-mat|cs|gr-qc|hep-ex|hep-lat|hep-ph|hep-th|math-ph|math|nlin|nucl-ex|nucl-th|physics|q-bio|q-fin|quant-ph|stat)"
_NEW = r"(?i)\b(?:arxiv:\s*)?([0-9]{2})([0-9]{2})\.([0-9]{4,5})(?:v[0-9]+)?\b"
_OLD = rf"(?i)(?<![A-Za-z0-9])({LEGACY})\s*[/_:.-]\s*([0-9]{{7}})(?:v[0-9]+)?(?![0-9])"
_TOLD = (r"(?i)\barxiv\s*:\s*([0-9]{2})([0-9]{2})\.([0-9]{4,5})(?:v[0-9]+)?\b", r"(?i)\barxiv\.org/(?:abs|pdf)/([0-9]{2})([0-9]{2})\.([0-9]{4,5})(?:v[0-9]+)?\b")


def _id(text: Column, pattern: str) -> Column:
    a, b, c = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    return F.when(a != "", F.concat(F.lit("arxiv:"), a, b, F.lit("."), c))


def _old_id(text: Column) -> Column:
    a, b = F.lower(F.regexp_extract(text, _OLD, 1)), F.regexp_extract(text, _OLD, 2)
    return F.when(a != "", F.concat(F.lit("arxiv:"), a, F.lit("/"), b))


def arxiv_id(text: Column) -> Column:
    """arxiv:yymm.nnnnn, or arxiv:category/nnnnnnn, of the first id in a text, without its version; null without one."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(_id(text, _NEW), _old_id(text))


def told_arxiv_id(text: Column) -> Column:
    """arxiv_id() of ids that say so: with the prefix, as an address, or of the old form."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(_id(text, _TOLD[0]), _id(text, _TOLD[1]), _old_id(text))


def front_arxiv_id(text: Column) -> Column:
    """The id that a paper's first pages say is its own: told within 8,000 characters, before the introduction, within 20,000; else any near the abstract's heading, or in the first 2,500 characters."""
    front = F.substring(before_references(F.coalesce(text, F.lit(""))), 1, 20000)
    intro = F.regexp_extract(front, r"(?is)^(.*?)(?:^|\n)\s*(?:#{1,6}\s*)?(?:[0-9]+\.?\s*)?(?:introduction|i\.\s+introduction)\b", 1)
    head = F.regexp_extract(front, r"(?is)^(.*?\babstract\b.{0,250})", 1)
    near = F.when(head != "", head).otherwise(F.substring(front, 1, 2500))
    return F.coalesce(told_arxiv_id(F.substring(front, 1, 8000)), told_arxiv_id(intro), told_arxiv_id(front), arxiv_id(near))


def arxiv_year(identifier: Column) -> Column:
    """The year that an id's first digits say; null if its month is none."""
    digits = F.coalesce(blank_to_null(F.regexp_extract(identifier, r"([0-9]{4})\.[0-9]{4,5}", 1)), blank_to_null(F.regexp_extract(identifier, r"/\s*([0-9]{4})[0-9]{3}", 1)))
    year, month = as_int(F.substring(digits, 1, 2)), as_int(F.substring(digits, 3, 2))
    return F.when(month.between(1, 12), F.when(year < 90, 2000 + year).otherwise(1900 + year))


def sane_year(value: Column) -> Column:
    year = as_int(value.cast("string"))
    return F.when(year.between(1500, 3000), year)


# Words that titles are compared without.
TITLE_STOPWORDS = "a an and are as at based by for from in into is its of on or our the to using via with".split()


def _ratio(a: Column, b: Column) -> Column:
    """difflib's similarity of two texts, null where one is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else SequenceMatcher(None, u, v).ratio() for u, v in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def titles_conflict(a: Column, b: Column) -> Column:
    """Whether two titles are surely different: of three telling words or more each, they share less than 0.35 of the shorter one's and 0.25 of all, and are less than 0.55 alike by letters. Only titles that the words leave open are sent to Python."""
    low = lambda x: F.lower(squeeze(F.coalesce(x, F.lit(""))))
    words = lambda x: F.array_distinct(F.filter(F.regexp_extract_all(low(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*TITLE_STOPWORDS) & ~w.rlike("^[0-9]+$")))
    shared = F.size(F.array_intersect(words(a), words(b)))
    apart = (F.size(words(a)) >= 3) & (F.size(words(b)) >= 3) & (shared < 0.35 * F.least(F.size(words(a)), F.size(words(b)))) & (shared < 0.25 * F.size(F.array_union(words(a), words(b)))) & (normal_key(low(a)) != normal_key(low(b)))
    return apart & F.coalesce(_ratio(F.when(apart, low(a)), F.when(apart, low(b))) < 0.55, F.lit(False))


def paper_node(rows: DataFrame) -> DataFrame:
    """A node for each extraction (paper_id, text, paper_type, title, paper_year): the paper's id, title and year as they are settled between the model, the text and the id, and what each said where they conflict.

    A title in the text stands before one that conflicts with it; a year two off the id's gives way
    to it, if the text names no other id. Further columns stay.
    """
    more = [c for c in rows.columns if c not in ("paper_id", "text", "paper_type", "title", "paper_year")]
    rows = rows.withColumns({"_line": title_line(F.col("text")), "_front": front_arxiv_id(F.col("text")), "_asked": arxiv_id(F.col("paper_id")), "_given": blank_to_null(F.trim("title")), "_said": sane_year(F.col("paper_year"))})
    rows = rows.withColumn("_clash", F.col("_given").isNotNull() & F.col("_line").isNotNull() & titles_conflict(F.col("_given"), F.col("_line")))
    sure = F.when(F.col("_asked").isNotNull(), F.when(F.col("_front").isNull() | (F.col("_front") == F.col("_asked")), F.col("_asked"))).otherwise(F.col("_front"))
    rows = rows.withColumn("_year", arxiv_year(sure))
    off = F.coalesce(F.abs(F.col("_year") - F.col("_said")) > 2, F.lit(False))
    kind = F.lower(F.trim("paper_type"))
    return rows.select(
        *more, F.coalesce("_asked", "_front", "paper_id").alias("paper_id"), F.when(F.col("_clash"), F.col("_line")).otherwise(F.coalesce("_given", "_line")).alias("title"), F.when(kind.isin(*PAPER_TYPES), kind).otherwise("research").alias("paper_type"),
        F.when(F.col("_year").isNotNull() & (F.col("_said").isNull() | off), F.col("_year")).otherwise(F.col("_said")).alias("paper_year"), F.when(F.col("_asked").isNotNull() & (F.col("_front") != F.col("_asked")), F.col("_front")).alias("detected_source_id"),
        F.when(F.col("_clash"), F.col("_line")).alias("detected_title"), F.when(F.col("_clash"), F.col("_given")).alias("llm_paper_title"), F.when(off, F.col("_said")).alias("llm_paper_year"),
    )


def metadata_checks(nodes: DataFrame) -> DataFrame:
    """nodes (as paper_node() gives them) with metadata_status (valid or invalid), blocking_errors and identity_warnings, by name."""
    asked, found = arxiv_id(F.col("paper_id")), arxiv_id(F.col("detected_source_id"))
    year = arxiv_year(asked)
    off = lambda c: F.coalesce(F.abs(year - sane_year(F.col(c))) > 2, F.lit(False))
    other = F.coalesce(asked != found, F.lit(False))
    title = F.coalesce(titles_conflict(F.col("detected_title"), F.col("llm_paper_title")), F.lit(False))
    named = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    errors = named({"paper_id_mismatch": other, "paper_id_year_mismatch": off("paper_year"), "paper_title_mismatch": title})
    warnings = named({"year_differs_from_id": off("paper_year"), "model_year_differs_from_id": off("llm_paper_year"), "text_names_another_id": other, "title_differs_from_text": title})
    return nodes.withColumns({"blocking_errors": errors, "identity_warnings": warnings}).withColumn("metadata_status", F.when(F.size("blocking_errors") > 0, "invalid").otherwise("valid"))


def quality_warnings(rows: DataFrame) -> DataFrame:
    """rows (paper_type, concept_count, method_count, text_length, parse_quality) with warnings, by name: recovered or failed replies, and too few concepts or methods for a long paper or a survey."""
    long = F.col("text_length") >= 20000
    rules = {"partial_recovery": F.col("parse_quality") == "partial", "failed_calls": F.col("parse_quality") == "failed", "few_concepts": long & (F.col("concept_count") < 12), "few_concepts_for_survey": (F.col("paper_type") == "survey") & (F.col("concept_count") < 30), "no_methods": long & (F.col("method_count") == 0)}
    return rows.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))


def failure_of(raw: Column) -> Column:
    """Why an extraction's raw reply (JSON) is a failure, null if it isn't: a fatal error with its reason, or replies that all failed with nothing to show."""
    get = lambda p: blank_to_null(F.get_json_object(raw, p))
    fatal = F.coalesce(get("$.fatal_llm_error"), F.lit("false")).isin("false", "0", "null", "[]", "{}")
    calls = F.from_json(F.coalesce(get("$.call_diagnostics"), get("$.calls")), "array<struct<call_type:string,parse_quality:string,raw_excerpt:string>>")
    calls = F.filter(calls, lambda c: F.coalesce(c["call_type"], F.lit("")) != "claims_retry")
    all_failed = (F.size(calls) > 0) & F.forall(calls, lambda c: F.coalesce(c["parse_quality"], F.lit("")) == "failed")
    empty = lambda p: F.coalesce(get(p), F.lit("[]")).isin("[]", "null", "{}", "false", "0")
    unloaded = F.exists(calls, lambda c: F.contains(F.coalesce(c["raw_excerpt"], F.lit("")), F.lit("No models loaded")))
    failed = (F.coalesce(get("$.extraction_parse_quality"), get("$.parse_quality")) == "failed") & all_failed
    return F.when(~fatal, F.coalesce(F.trim(get("$.failure_reason")), F.lit("failed before usable JSON"))).when(failed & unloaded, "no model loaded").when(failed & empty("$.concepts") & empty("$.methods"), "every call failed")


def saved_extractions(rows: DataFrame) -> DataFrame:
    """Rows (raw_response, error_message, ...) as they are stored: extraction_status, and an error inferred from the raw reply where none is given."""
    return rows.withColumn("error_message", F.coalesce("error_message", failure_of(F.col("raw_response")))).withColumn("extraction_status", F.when(F.col("error_message").isNull(), "success").otherwise("failed"))


def review_items(extractions: DataFrame, lists: tuple[str, ...] = ("concepts", "methods", "concept_candidates", "method_candidates")) -> DataFrame:
    """paper_id, label, entity_type, canonical_id, suggested_canonical, evidence, source_field of all entities of successful extractions that wait for review, in four lists of one struct type."""
    names = extractions.schema[lists[0]].dataType.elementType.names
    has = lambda n: F.col(f"x.{n}") if n in names else F.lit(None).cast("string")
    items = F.concat(*[F.coalesce(F.col(c), F.array().cast(extractions.schema[c].dataType)) for c in lists])
    rows = extractions.filter("extraction_status = 'success'").select("paper_id", F.explode(items).alias("x")).filter((F.lower("x.review_status") == "pending") & (F.trim("x.label") != ""))
    label = F.trim("x.label")
    return rows.select("paper_id", label.alias("label"), has("entity_type").alias("entity_type"), has("canonical_id").alias("canonical_id"), first_filled(has("suggested_canonical"), has("canonical_label"), label).alias("suggested_canonical"), F.coalesce(first_filled(has("evidence"), has("evidence_span"), has("context"), has("description")), F.lit("")).alias("evidence"), F.coalesce(first_filled(has("candidate_reason"), has("acceptance_reason")), F.lit("")).alias("source_field"))


def matches_query(words: str, *fields: str) -> Column:
    """Whether every word of a query is somewhere in the fields."""
    import re

    hay = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(True)
    for w in re.findall("[a-z0-9._:-]+", words.lower()):
        out = out & F.contains(hay, F.lit(w))
    return out


SORTS = {"title": "title", "year": "year", "added": "added_timestamp"}


def paper_page(papers: DataFrame, memberships: DataFrame, extractions: DataFrame, *, query: str = "", project: str | None = None, full_text: bool | None = None, status: str | None = None, sort: str = "added_desc", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of papers (id, source_id, title, abstract, doi, year, has_full_text, added_timestamp) with project_ids, latest_extraction_status and total (of all that match), filtered, sorted (ties by id).

    memberships: project_id, paper_id. extractions: id, paper_id, extraction_status, extraction_timestamp.
    """
    rows = papers
    if project is not None:
        rows = rows.join(small(memberships.filter(F.col("project_id") == project).select(F.col("paper_id").alias("id")).distinct()), "id", "left_semi")
    if full_text is not None:
        rows = rows.filter(F.coalesce("has_full_text", F.lit(False)) == full_text)
    rows = rows.filter(matches_query(query, "id", "source_id", "title", "abstract", "doi")) if query else rows
    last = latest_status(extractions, "paper_id", "extraction_status", "extraction_timestamp", "id").select(F.col("paper_id").alias("id"), F.coalesce(blank_to_null(F.col("extraction_status")), F.lit("unknown")).alias("latest_extraction_status"))
    rows = rows.join(last, "id", "left")
    rows = rows.filter(F.col("latest_extraction_status") == status) if status else rows
    name, _, way = sort.rpartition("_")
    key = F.coalesce("year", F.lit(0)) if name == "year" else F.lower(F.coalesce(F.col(SORTS.get(name, "added_timestamp")).cast("string"), F.lit("")))
    total = rows.agg(F.count("*").alias("total"))  # one row
    page = rows.withColumn("_key", key).orderBy(F.desc("_key") if way == "desc" else F.asc("_key"), "id").offset(offset).limit(limit)
    mine = memberships.join(F.broadcast(page.select(F.col("id").alias("paper_id"))), "paper_id", "left_semi").groupBy(F.col("paper_id").alias("id")).agg(F.array_sort(F.collect_set("project_id")).alias("project_ids"))
    return page.join(mine, "id", "left").crossJoin(F.broadcast(total)).withColumn("project_ids", F.coalesce("project_ids", F.array().cast("array<string>"))).drop("_key")


def review_page(queue: DataFrame, *, status: str | None = "pending", query: str = "", limit: int = 100) -> DataFrame:
    """The newest ``limit`` items of the review queue, of which those are shown that hold a query in their label, suggestion or paper: the limit comes first."""
    rows = queue if status is None else queue.filter(F.col("review_status") == status)
    rows = rows.orderBy(F.desc("created_timestamp"), F.desc("id")).limit(limit)
    hit = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower()))
    return rows.filter(hit("label") | hit("suggested_canonical") | hit("paper_id")) if query else rows


def contradictions(pairs: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Pairs of claims (conflict_type, confidence) that contradict each other, the surest first."""
    return pairs.filter((F.col("conflict_type") == "contradictory") & (F.col("confidence") >= threshold)).orderBy(F.desc("confidence"), *[c for c in pairs.columns if c not in ("confidence", "conflict_type")])


# Terms that are too general to be in conflict, and the keys of entities that anchor them.
GENERAL_TERMS = {"bias": ("bias", "selectionbias", "operationalizationbias", "databias"), "model": ("modelbasedrl", "modeluncertainty", "transitionmodel"), "policy": ("policysearch", "policygradient"), "value": ("valuefunction", "statevalue", "stateactionvalue")}


def merged_conflicts(conflicts: DataFrame, entities: DataFrame, *, most: int = 8) -> DataFrame:
    """paper_id, term, ord: the first (ord) conflict of each term of a paper, ``most`` of them; a general term only where the paper's entities (paper_id, key) anchor it and this_field defines it."""
    from pyspark.sql.window import Window as W

    tight = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    rows = conflicts.select("paper_id", squeeze(F.col("term")).alias("term"), "this_field", "ord").filter("term <> ''")
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("paper_id", F.lower("term")).orderBy("ord"))).filter("_n = 1")
    kept = first.withColumn("_k", F.row_number().over(W.partitionBy("paper_id").orderBy("ord"))).filter(F.col("_k") <= most).withColumn("key", tight(F.col("term")))
    needs = F.array_union(F.array("key"), F.coalesce(*[F.when(F.col("key") == k, F.array(*map(F.lit, v))) for k, v in GENERAL_TERMS.items()]))
    general = kept.filter(F.col("key").isin(*GENERAL_TERMS)).select("paper_id", "ord", F.explode(needs).alias("anchor"))
    anchored = general.join(entities.select("paper_id", F.col("key").alias("anchor")).distinct(), ["paper_id", "anchor"], "left_semi").select("paper_id", "ord").distinct().withColumn("_ok", F.lit(True))
    vague = F.lower(F.coalesce("this_field", F.lit(""))).rlike(r"\bnot explicitly\b|\bnot defined\b")
    out = kept.join(anchored, ["paper_id", "ord"], "left").filter(~F.col("key").isin(*GENERAL_TERMS) | (F.coalesce("_ok", F.lit(False)) & ~vague))
    return out.filter("key <> ''").select("paper_id", "term", "ord")


def payload_score(fields: list[Column], plain: list[Column]) -> Column:
    """How much a parsed reply holds: the entries of its lists and one for each plain field that is filled."""
    lists = sum((F.greatest(F.lit(0), F.size(F.coalesce(c, F.array()))) for c in fields), F.lit(0))
    return lists + sum((F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0", "false"), 0).otherwise(1) for c in plain), F.lit(0))


def unique_strings(values: Column) -> Column:
    """Trimmed, the empty ones dropped, each once in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))
