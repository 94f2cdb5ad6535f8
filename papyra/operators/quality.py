"""Health reports, extraction benchmarks, answer scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import group_key, ratio, round4


def paper_health(papers: DataFrame) -> DataFrame:
    """One row of counts over papers, the groups that share a DOI among them."""
    base = papers.agg(
        F.count("*").alias("total"), F.count_if("has_full_text").alias("with_full_text"), F.count_if("retracted").alias("retracted"), F.count_if("conflict_flag").alias("conflicts"),
        F.count_if(F.col("title").isNull() | (F.col("title") == "")).alias("missing_title"), F.count_if(F.col("year").isNull()).alias("missing_year"), F.count_if(F.col("obsolescence_score") >= F.lit(0.6).cast("float")).alias("high_obsolescence"),
    )
    dup = papers.filter("doi is not null and doi <> ''").groupBy("doi").count().filter("count > 1").agg(F.count("*").alias("duplicate_doi_groups"))
    return base.crossJoin(dup).withColumn("full_text_coverage", ratio(F.col("with_full_text"), F.col("total")))


def extraction_health(rows: DataFrame, papers_total: int) -> DataFrame:
    ok = F.when(F.col("extraction_status") == "success", F.col("paper_id"))
    out = rows.agg(F.count("*").alias("total"), F.count_distinct(ok).alias("papers_with_success"), round4(F.avg("extraction_duration_seconds")).alias("avg_duration_seconds"), F.max("extraction_timestamp").alias("latest"))
    return out.withColumn("paper_success_coverage", ratio(F.col("papers_with_success"), F.lit(papers_total)))


def group_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(group_key(F.col(column)).alias("key")).agg(F.count("*").alias("n"))


def warnings(report: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """report with warnings (names of the rules that hold) and status."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return report.withColumn("warnings", found).withColumn("status", F.when(F.size("warnings") > 0, "warning").otherwise("ok"))


def duplicate_groups(rows: DataFrame, key: Column) -> DataFrame:
    """Keys that several rows share, and how many do."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def prf(expected: DataFrame, predicted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Precision, recall and F1 of sets of keys in each group; 0 where undefined, 1 where nothing is expected and nothing predicted is not assumed."""
    e, p = expected.select(*by, *keys).distinct().withColumn("_e", F.lit(1)), predicted.select(*by, *keys).distinct().withColumn("_p", F.lit(1))
    both = e.join(p, [*by, *keys], "full")
    is_e, is_p = F.col("_e").isNotNull(), F.col("_p").isNotNull()
    c = both.groupBy(*by).agg(F.count_if(is_e & is_p).alias("tp"), F.count_if(~is_e & is_p).alias("fp"), F.count_if(is_e & ~is_p).alias("fn"))
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": pr, "recall": rc, "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def gates(report: DataFrame) -> DataFrame:
    """The four gates of an extraction benchmark over the average of its cases (precision, duplicate_rate, parser_warnings, claim_errors)."""
    avg = report.agg(F.avg("precision").alias("precision"), F.avg("duplicate_rate").alias("duplicate_rate"), F.sum("parser_warnings").alias("parser_warnings"), F.sum("claim_errors").alias("claim_errors"))
    return avg.withColumns({"ok_precision": F.col("precision") >= 0.85, "ok_duplicates": F.col("duplicate_rate") <= 0.05, "ok_warnings": F.col("parser_warnings") == 0, "ok_claims": F.col("claim_errors") == 0})


def duplicate_canonical_rate(rows: DataFrame, canonical: Column, label: Column) -> DataFrame:
    """n_canonical, n_duplicate (canonical ids of several labels), rate."""
    g = rows.groupBy(canonical.alias("c")).agg(F.count_distinct(label).alias("n"))
    out = g.agg(F.count("*").alias("n_canonical"), F.count_if(F.col("n") > 1).alias("n_duplicate"))
    return out.withColumn("rate", ratio(F.col("n_duplicate"), F.col("n_canonical")))


def field_accuracy(expected: DataFrame, predicted: DataFrame, key: str, field: str) -> DataFrame:
    """n, correct, accuracy of a field over the expected keys; 1 where nothing is expected."""
    e, p = expected.select(key, F.col(field).alias("_e")), predicted.select(key, F.col(field).alias("_p"))
    out = e.join(p, key, "left").agg(F.count("*").alias("n"), F.count_if(F.col("_e") == F.col("_p")).alias("correct"))
    return out.withColumn("accuracy", F.when(F.col("n") == 0, 1.0).otherwise(ratio(F.col("correct"), F.col("n"))))


def term_found(text: Column, options: list[str]) -> Column:
    """Whether one of the options is in a text, hyphens taken as spaces or left out."""
    low = F.lower(text)
    flat, tight = F.replace(low, F.lit("-"), F.lit(" ")), F.regexp_replace(low, "[^a-z0-9]", "")
    hit = F.lit(False)
    for o in options:
        o = o.lower()
        hit = hit | F.contains(flat, F.lit(o.replace("-", " "))) | F.contains(tight, F.lit("".join(c for c in o if c.isascii() and c.isalnum())))
    return hit


def answer_scores(answers: DataFrame) -> DataFrame:
    """answers (id and five boolean parts) with score (their mean) and passed (all hold)."""
    parts = ["has_answer", "has_sources", "has_terms", "no_forbidden", "no_error"]
    total = sum((F.col(p).cast("int") for p in parts), F.lit(0))
    return answers.withColumns({"score": round4(total / 5), "passed": total == 5})


def answer_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), round4(F.avg("score")).alias("score"), F.count_if(~F.col("has_sources")).alias("missing_sources"), F.count_if(~F.col("no_forbidden")).alias("forbidden"))


SEVERITY = ("clean", "trimmed", "partial", "failed")


def worst_parse(rows: DataFrame, key: str, quality: str) -> DataFrame:
    """Worst parse quality of each key; failed pieces beside clean ones make it partial; only skipped ones: skipped."""
    rank = F.coalesce(*[F.when(F.col(quality) == q, i) for i, q in enumerate(SEVERITY)])
    out = rows.groupBy(key).agg(F.max(rank).alias("r"), F.bool_or(F.col(quality).isin("clean", "trimmed")).alias("some"))
    name = F.coalesce(*[F.when(F.col("r") == i, q) for i, q in enumerate(SEVERITY)], F.lit("skipped"))
    return out.select(key, F.when((F.col("r") == 3) & F.coalesce("some", F.lit(False)), "partial").otherwise(name).alias("parse_quality"))
