"""Benchmarks of extractions and answers, and the health of a store: one report a call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_bool, first_filled, ratio, round4
from ..functions.text import normal_key, squeeze
from .answers import cited_ids, invalid_citations
from .linking import small

#: What an extraction must reach: precision of concepts, and rate of canonical ids with several labels.
LEAST_PRECISION, MOST_DUPLICATES = 0.85, 0.05


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def set_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """case_id, kind, tp, fp, fn, precision, recall, f1 of sets of keys (case_id, kind, key); 0 where undefined."""
    e = expected.filter("key <> ''").select("case_id", "kind", "key").distinct().withColumn("_e", F.lit(1))
    p = predicted.filter("key <> ''").select("case_id", "kind", "key").distinct().withColumn("_p", F.lit(1))
    is_e, is_p = F.col("_e").isNotNull(), F.col("_p").isNotNull()
    c = e.join(p, ["case_id", "kind", "key"], "full").groupBy("case_id", "kind").agg(F.count_if(is_e & is_p).alias("tp"), F.count_if(~is_e & is_p).alias("fp"), F.count_if(is_e & ~is_p).alias("fn"))
    part = lambda n, d: F.when(d == 0, 0.0).otherwise(n / d)
    precision, recall = part(F.col("tp"), F.col("tp") + F.col("fp")), part(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": round4(precision), "recall": round4(recall), "f1": round4(_f1(precision, recall))})


def relation_key(subject: Column, kind: Column, obj: Column) -> Column:
    """Key of a relation with both ends and a type; empty for others."""
    parts = [normal_key(F.coalesce(subject, F.lit(""))), F.upper(F.trim(F.coalesce(kind, F.lit("")))), normal_key(F.coalesce(obj, F.lit("")))]
    return F.when((parts[0] != "") & (parts[1] != "") & (parts[2] != ""), F.concat_ws("|", *parts)).otherwise("")


def value_accuracy(expected: DataFrame, predicted: DataFrame, *, empty: float = 0.0) -> DataFrame:
    """case_id, expected_count, error_count, accuracy of values (case_id, key, value) over the expected keys: the last (ord) value of a key counts on either side; ``empty`` where a case expects none, which only a left join with the cases shows."""
    last = lambda df, name: df.filter("key <> ''").groupBy("case_id", "key").agg(F.max_by("value", "ord").alias(name))
    both = last(expected, "_e").join(last(predicted, "_p"), ["case_id", "key"], "left")
    out = both.groupBy("case_id").agg(F.count("*").alias("expected_count"), F.count_if(~F.col("_e").eqNullSafe(F.col("_p"))).alias("error_count"))
    return out.withColumn("accuracy", F.when(F.col("expected_count") == 0, empty).otherwise(round4(1 - F.col("error_count") / F.col("expected_count"))))


def duplicate_rates(items: DataFrame) -> DataFrame:
    """case_id, duplicate_canonical_rate: canonical ids (else keys of the canonical label or label) with several normalised labels, among all of a case."""
    key = first_filled(F.col("canonical_id"), normal_key(first_filled(F.col("canonical_label"), F.col("label"))))
    g = items.select("case_id", F.trim(key).alias("c"), normal_key(F.coalesce("label", F.lit(""))).alias("l")).filter("c <> '' and l <> ''").groupBy("case_id", "c").agg(F.count_distinct("l").alias("n"))
    return g.groupBy("case_id").agg(F.count("*").alias("_n"), F.count_if(F.col("n") > 1).alias("_d")).select("case_id", ratio(F.col("_d"), F.col("_n")).alias("duplicate_canonical_rate"))


def case_reports(cases: DataFrame, gold: DataFrame, found: DataFrame, claims: DataFrame) -> DataFrame:
    """A row for each case (case_id, parser_warnings: array): scores of concepts, methods and relations, rates, claim errors.

    gold, found: case_id, kind (concepts, methods, relations, ...), ord, label, canonical_id,
    canonical_label, entity_type, source_type, review_status, subject, relation_type, object. claims:
    case_id, side (gold, found), ord, statement, negated, attributed_to.
    """
    key = F.when(F.col("kind") == "relations", relation_key(F.col("subject"), F.col("relation_type"), F.col("object"))).otherwise(normal_key(F.coalesce("label", F.lit(""))))
    g, f = gold.withColumn("key", key), found.withColumn("key", key)
    scores = set_scores(g, f)
    kinds = ("concepts", "concept_candidates", "methods", "relations")
    wide = scores.groupBy("case_id").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in kinds for c in ("precision", "recall", "f1")])
    value = lambda df, kind, field: df.filter((F.col("kind") == kind) & F.col("key").isNotNull()).select("case_id", "key", "ord", F.col(field).alias("value"))
    given = lambda df: df.filter("value <> ''")
    types = value_accuracy(given(value(g, "concepts", "entity_type")), value(f, "concepts", "entity_type")).select("case_id", F.col("accuracy").alias("entity_type_accuracy"))
    sources = value_accuracy(given(value(g, "methods", "source_type")), value(f, "methods", "source_type")).select("case_id", F.col("accuracy").alias("method_source_type_accuracy"))
    said = claims.withColumn("key", normal_key(F.coalesce("statement", F.lit("")))).withColumn("value", as_bool(F.col("negated")).cast("string"))
    denied = value_accuracy(said.filter("side = 'gold' and negated is not null"), said.filter("side = 'found'")).select("case_id", F.col("accuracy").alias("claim_negation_accuracy"), F.col("error_count").alias("claim_negation_error_count"), F.col("expected_count").alias("claim_negation_expected_count"))
    wrong = said.filter("side = 'found'").groupBy("case_id").agg(F.count_if(F.col("attributed_to").isNotNull() & ~F.col("attributed_to").isin("this_paper", "cited_work")).alias("claim_attribution_error_count"))
    entities = f.filter(F.col("kind").isin("concepts", "methods")).groupBy("case_id").agg(F.count("*").alias("_n"), F.count_if(F.lower("review_status") == "pending").alias("_w"), F.count_if(F.col("kind") == "concepts").alias("accepted_concept_count"))
    pending = entities.select("case_id", ratio(F.col("_w"), F.col("_n")).alias("pending_rate"), "accepted_concept_count")
    rates = duplicate_rates(f.filter("kind = 'concepts'"))
    out = cases.select("case_id", F.size(F.coalesce("parser_warnings", F.array().cast("array<string>"))).alias("parser_warning_count"))
    for part in (wide, types, sources, denied, wrong, pending, rates):
        out = out.join(part, "case_id", "left")
    return out.fillna(0.0, [c for c in out.columns if c.endswith(("precision", "recall", "f1", "rate", "type_accuracy"))]).fillna(1.0, ["claim_negation_accuracy"]).fillna(0, [c for c in out.columns if c.endswith("count")])


def benchmark_summary(reports: DataFrame) -> DataFrame:
    """One row over case_reports(): the averages of the cases, the sums of their errors, and the four gates. Without cases: zeros, of which only precision fails its gate."""
    avg = lambda c, none=0.0: F.coalesce(F.avg(c), F.lit(none))
    sums = {n: F.coalesce(F.sum(n), F.lit(0)) for n in ("claim_negation_error_count", "claim_attribution_error_count", "parser_warning_count")}
    means = {"concept_precision": avg("concepts_precision"), "concept_recall": avg("concepts_recall"), "method_precision": avg("methods_precision"), "method_recall": avg("methods_recall"), "relation_precision": avg("relations_precision"), "relation_recall": avg("relations_recall"), "duplicate_canonical_rate": avg("duplicate_canonical_rate"), "pending_rate": avg("pending_rate"), "claim_negation_accuracy": avg("claim_negation_accuracy", 1.0)}
    out = reports.agg(F.count("*").alias("case_count"), *[v.alias(f"_{k}") for k, v in means.items()], *[v.alias(k) for k, v in sums.items()])
    gates = {"passes_precision_gate": F.col("_concept_precision") >= LEAST_PRECISION, "passes_duplicate_gate": F.col("_duplicate_canonical_rate") <= MOST_DUPLICATES, "passes_parser_gate": F.col("parser_warning_count") == 0, "passes_claim_gate": (F.col("claim_negation_error_count") == 0) & (F.col("claim_attribution_error_count") == 0)}
    return out.select("case_count", *[round4(F.col(f"_{k}")).alias(k) for k in means], *sums, *[v.alias(k) for k, v in gates.items()])


def flat(text: Column) -> Column:
    """Lower case, hyphens, underscores and slashes as spaces, squeezed: how terms of answers are compared."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[-_/ \\t\\r\\n]+", " "))


# Words that are taken for one another.
ONE_WORD = {"grade": ("grade", "graded", "grader", "graders", "grading"), "rate": ("rate", "rated", "rates", "rater", "raters", "rating", "ratings")}


def soft_stem(word: Column) -> Column:
    """A word without its plural; the forms of a few words are one."""
    same = [F.when(word.isin(*forms), w) for w, forms in ONE_WORD.items()]
    n = F.length(word)
    return F.coalesce(*same, F.when(F.endswith(word, F.lit("ies")) & (n > 4), F.concat(F.substr(word, F.lit(1), n - 3), F.lit("y"))), F.when(F.endswith(word, F.lit("s")) & (n > 3), F.substr(word, F.lit(1), n - 1)), word)


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), soft_stem))


def forms(stem: Column) -> Column:
    """All words that have this stem: those that soft_stem() may have made it from, if it did."""
    n, none = F.length(stem), F.array().cast("array<string>")
    same = F.coalesce(*[F.when(stem == w, F.array(*map(F.lit, ws))) for w, ws in ONE_WORD.items()], none)
    ends = F.array(stem, F.concat(stem, F.lit("s")), F.concat(F.substr(stem, F.lit(1), n - 1), F.lit("ies")))
    return F.array_distinct(F.filter(F.concat(ends, same), lambda w: soft_stem(w) == stem))


def has_stem(text: Column, stem: Column) -> Column:
    """Whether a flat text has a whole word of this stem. All such words begin as the stem does but for its last character, and so does the pattern: Java finds what it begins with without a closer look at each character."""
    root = F.substr(stem, F.lit(1), F.greatest(F.length(stem) - 1, F.lit(1)))
    rest = F.array_join(F.transform(forms(stem), lambda w: F.substr(w, F.length(root) + 1)), "|")
    whole = F.concat(root, F.lit("(?<![a-z0-9]"), root, F.lit(")(?:"), rest, F.lit(")(?![a-z0-9])"))
    return F.contains(text, root) & F.rlike(text, whole)


def tight(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is worked out once: a column that is looked at in one place only is moved there by Spark, and within a lambda worked out again for each element."""
    return F.transform(F.array(value), use)[0]


def term_present(term: Column, text: Column, close: Column) -> Column:
    """Whether one of a term's options ("a|b") is in a flat text, spaces aside (close: the text without them), or the text has a word of each of its stems.

    The text's own stems are not worked out: the few words that have a stem are looked for.
    """
    options = F.filter(F.transform(F.split(term, "\\|"), flat), lambda o: o != "")
    worded = lambda found: (F.size(found) > 0) & F.forall(found, lambda s: has_stem(text, s))
    return F.exists(options, lambda o: F.contains(close, tight(o)) | once(stems(o), worded))


def evaluated_answers(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """id, score, passes, the five parts, and the lists behind them.

    cases: id, expected_sources, required_terms, forbidden_terms (arrays). answers: id, answer,
    sources (array of paper ids), generation_error, no_answer. A part is 1 or 0, but required terms
    count in proportion. A case without an answer has an empty one.
    """
    none = F.array().cast("array<string>")
    rows = cases.join(answers, "id", "left").withColumns({"_t": flat(F.col("answer")), "_all": F.array_union(F.coalesce("sources", none), cited_ids(F.coalesce("answer", F.lit(""))))})
    missing = lambda close: F.filter(F.coalesce("required_terms", none), lambda t: ~term_present(t, F.col("_t"), close))
    rows = rows.withColumns(
        {
            "missing_sources": F.filter(F.coalesce("expected_sources", none), lambda s: ~F.array_contains(F.col("_all"), s)),
            "missing_terms": once(tight(F.col("_t")), missing),
            "forbidden_hits": F.filter(F.coalesce("forbidden_terms", none), lambda t: F.contains(F.col("_t"), flat(t))),
            "invalid_citations": invalid_citations(F.coalesce("answer", F.lit(""))),
        }
    )
    n = F.size(F.coalesce("required_terms", none))
    hollow = (F.coalesce("generation_error", F.lit("")) != "") | F.coalesce("no_answer", F.lit(False))
    one = lambda bad: F.when(bad, 0.0).otherwise(1.0)
    parts = {"sources_part": one(F.size("missing_sources") > 0), "terms_part": F.when(n == 0, 1.0).otherwise((n - F.size("missing_terms")) / n), "forbidden_part": one(F.size("forbidden_hits") > 0), "citations_part": one(F.size("invalid_citations") > 0), "generation_part": one(hollow)}
    rows = rows.withColumns(parts)
    score = sum((F.col(p) for p in parts), F.lit(0.0)) / len(parts)
    return rows.select("id", round4(score).alias("score"), (score == 1.0).alias("passes"), *parts, "missing_sources", "missing_terms", "forbidden_hits", "invalid_citations")


def answers_summary(reports: DataFrame) -> DataFrame:
    """One row over evaluated_answers(): average_score, pass_count, case_count, and the ids (sorted) of cases that failed a part. Cases are a written list, so their ids are too."""
    ids = lambda bad: F.array_sort(F.collect_list(F.when(bad, F.col("id"))))
    return reports.agg(
        round4(F.coalesce(F.avg("score"), F.lit(0.0))).alias("average_score"), F.count_if("passes").alias("pass_count"), F.count("*").alias("case_count"),
        ids(F.col("citations_part") < 1).alias("invalid_citation_cases"), ids(F.col("sources_part") < 1).alias("missing_source_cases"), ids(F.size("missing_terms") > 0).alias("missing_term_cases"), ids(F.col("forbidden_part") < 1).alias("forbidden_hit_cases"), ids(F.col("generation_part") < 1).alias("generation_error_cases"),
    )


def with_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """gold (paper_id, source_file) with prediction: that of the file named after the paper (file_name, prediction), else of the gold file's own name; null where there is neither."""
    p = small(predictions.select("file_name", "prediction"))
    a, b = p.toDF("_fa", "_pa"), p.toDF("_fb", "_pb")
    out = gold.join(a, F.concat("paper_id", F.lit(".json")) == F.col("_fa"), "left").join(b, F.col("source_file") == F.col("_fb"), "left")
    return out.select(*gold.columns, F.coalesce("_pa", "_pb").alias("prediction"))


#: Coverage of papers by successful extractions below which health is a warning.
COVERAGE_GATE = 0.8


def health_report(papers: DataFrame, extractions: DataFrame, review_queue: DataFrame, embeddings: DataFrame, jobs: DataFrame, telemetry: DataFrame, *, gate: float = COVERAGE_GATE) -> DataFrame:
    """One row: counts over the six tables, the groups of statuses as maps, warnings, action_items, status. All are aggregates that combine on the map side."""
    from .quality import extraction_health, paper_health

    groups = lambda df, column: df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")).alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias(f"by_{column}"))  # noqa: E731  a row a status
    base = paper_health(papers)
    named = lambda df, prefix, cols: df.select(*[F.col(c).alias(f"{prefix}{c}") for c in cols])
    ex = extraction_health(extractions, 0)
    parts = [
        named(base, "papers_", base.columns), named(ex, "extractions_", [c for c in ex.columns if c != "paper_success_coverage"]), groups(extractions, "extraction_status"),
        review_queue.agg(F.count_if(F.col("review_status") == "pending").alias("review_pending"), F.count("*").alias("review_total")),
        embeddings.agg(F.count("*").alias("embeddings_total"), F.count_distinct("model").alias("embedding_models"), F.coalesce(F.max("embedding_version"), F.lit(0)).alias("embedding_version")),
        groups(jobs, "status"), telemetry.agg(F.count("*").alias("telemetry_total"), round4(F.avg("duration_seconds")).alias("telemetry_avg_seconds")), groups(telemetry, "parse_quality"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one
    out = out.withColumn("paper_success_coverage", ratio(F.col("extractions_papers_with_success"), F.col("papers_total")))
    failed = F.coalesce(F.try_element_at("by_extraction_status", F.lit("failed")), F.lit(0))
    rules = {"no_papers": F.col("papers_total") == 0, "low_coverage": (F.col("papers_total") > 0) & (F.col("paper_success_coverage") < gate), "failed_extractions": failed > 0, "no_embeddings": (F.col("papers_total") > 0) & (F.col("embeddings_total") == 0), "retracted_papers": F.col("papers_retracted") > 0, "duplicate_dois": F.col("papers_duplicate_doi_groups") > 0}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    out = out.withColumn("warnings", found).withColumn("action_items", F.array_compact(F.array(F.when(F.col("review_pending") > 0, F.concat(F.col("review_pending").cast("string"), F.lit(" entity review items are waiting for approve/reject decisions."))))))
    return out.withColumn("status", F.when(F.size("warnings") > 0, "warning").otherwise("ok"))


def repaired(before: DataFrame, after: DataFrame) -> DataFrame:
    """The reports of health before and after a repair, as stage and the columns that matter."""
    cols = ["embeddings_total", "paper_success_coverage", "warnings", "status"]
    return before.select(F.lit("before").alias("stage"), *cols).union(after.select(F.lit("after").alias("stage"), *cols))
