"""Vocabularies: external terms, registered entries, what labels suggest by themselves; concepts checked against their text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import dot
from ..functions.text import before_references
from .entities import repaired_mentions, tight_key
from .extraction import is_noise, truncated_label
from .linking import in_blocks, resolve, review_status, small, text_confidence


def linked(entities: DataFrame, terms: DataFrame, *, least: float = 0.85) -> DataFrame:
    """entities (id, label, v) with term_id and link_score: the external term (term_id, key, display_name, aliases, ord, v) of just this key, else of its normal form, else by display name or alias (each the first by ord), else the nearest by cosine from ``least`` on.

    The three exact ways are one equi-join on normal keys; only what they leave open meets the
    vectors of the terms, in blocks of a measured size.
    """
    names = F.array_union(F.array("key", "display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    ways = F.transform(names, lambda n, i: F.struct(tight_key(n).alias("k"), F.when(i == 0, 0).otherwise(1).alias("way")))
    index = terms.select("term_id", "ord", F.inline(ways)).filter("k <> ''").groupBy("k").agg(F.min(F.struct("way", "ord", "term_id")).alias("b")).select("k", F.col("b.term_id").alias("_exact"))
    rows = entities.withColumn("_k", tight_key(F.col("label"))).join(small(index), F.col("_k") == F.col("k"), "left").drop("k", "_k")
    unit = lambda c: F.transform(c.cast("array<double>"), lambda x: x / F.sqrt(dot(c, c)))
    open_ = rows.filter("_exact is null and v is not null").select("id", unit(F.col("v")).alias("a"))
    known = terms.filter("v is not null").select("term_id", "ord", unit(F.col("v")).alias("b"))
    near = reduce(DataFrame.union, [open_.join(t) for t in in_blocks(known, "term_id")])
    best = near.withColumn("s", dot(F.col("a"), F.col("b"))).filter(F.col("s") >= least).groupBy("id").agg(F.max(F.struct("s", (-F.col("ord")).alias("o"), "term_id")).alias("m"))
    out = rows.join(best.select(F.col("id").alias("_id"), "m"), F.col("id") == F.col("_id"), "left")
    return out.select(*entities.columns, F.coalesce("_exact", "m.term_id").alias("term_id"), F.when(F.col("_exact").isNotNull(), 1.0).otherwise(F.col("m.s")).alias("link_score"))


def registered(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (canonical_label, aliases, domain, seq) after others have been registered: the last of a label."""
    both = entries.unionByName(new)
    return both.groupBy("canonical_label").agg(F.max_by(F.struct("aliases", "domain", "seq"), "seq").alias("b")).select("canonical_label", "b.*")


def merged_entries(entries: DataFrame, merges: DataFrame) -> DataFrame:
    """Entries after some (source) went into others (target): their aliases and their own label go behind the target's, in order of sources; merges of labels that aren't there do nothing."""
    have = entries.select("canonical_label")
    m = merges.filter("source <> target").dropDuplicates(["source"]).join(have.withColumnRenamed("canonical_label", "source"), "source", "left_semi").join(have.withColumnRenamed("canonical_label", "target"), "target", "left_semi")
    moved = m.join(entries.select(F.col("canonical_label").alias("source"), F.col("aliases").alias("_a")), "source").groupBy("target").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source", "_a"))), lambda x: F.concat(x["_a"], F.array(x["source"])))).alias("_more"))
    left = entries.join(m.select(F.col("source").alias("canonical_label")), "canonical_label", "left_anti")
    out = left.join(moved, left["canonical_label"] == moved["target"], "left")
    return out.select(left["canonical_label"], F.concat("aliases", F.coalesce("_more", F.array().cast("array<string>"))).alias("aliases"), "domain", "seq")


def normalised(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """labels (label, ...) with canonical_label: that of the entry whose label or alias it is in any case, the last registered; null for others."""
    names = entries.select("canonical_label", "seq", F.explode(F.concat(F.array("canonical_label"), "aliases")).alias("n")).groupBy(F.lower("n").alias("_n")).agg(F.max_by("canonical_label", F.struct("seq", "canonical_label")).alias("canonical_label"))
    return labels.join(small(names), F.lower("label") == F.col("_n"), "left").drop("_n")


# Labels of which a paper must have one of each group, the field to which its methods may go, and why.
EMOTIONS = ("OCC Model", "Somatic Marker Hypothesis", "Affective Computing", "Valence", "Arousal", "Appraisal theory")
HINTS = (
    ((("Reinforcement Learning",), EMOTIONS), "human-robot interaction", "Emotion-conditioned reinforcement signals can support socially legible robot adaptation."),
    ((("Reinforcement Learning",), EMOTIONS), "affective computing", "Appraisal and valence models provide reusable state features for adaptive affective systems."),
    ((("Machine Learning",), ("Official Statistics",)), "data governance", "Monitoring and drift-detection methods transfer to institutional data quality workflows."),
)
# Labels whose term other fields use otherwise: the term, its meaning here and there.
OVERLOADED = {
    "Reward function": ("reward", "reinforcement signal or objective term", "psychology/economics - subjective or extrinsic incentive"),
    "Value function": ("value", "expected return estimate", "ethics/statistics - normative worth or measured quantity"),
    "Drive": ("drive", "internal motivational variable in an RL/control loop", "psychology/physiology - homeostatic need state or drive reduction construct"),
    "Valence": ("valence", "affective polarity", "chemistry/linguistics - bonding capacity or argument structure"),
    "Policy": ("policy", "action-selection rule", "governance - institutional rule or regulation"),
    "Bias": ("bias", "statistical or model distortion", "social science - systematic unfairness or prejudice"),
}


def squeezed(label: str) -> str:
    """tight_key() of a label on the driver."""
    return re.sub("[^a-z0-9]+", "", label.lower())


def suggested(concepts: DataFrame, *, most: int = 5) -> DataFrame:
    """paper_id, kind (hint, conflict), value, why_applicable, this_field, other_field of each paper (paper_id, label): fields that its concepts hint at and why, and their overloaded terms with both meanings, ``most`` in order. Tables of a few labels, so all is one aggregate of those."""
    known = sorted({squeezed(x) for groups, _, _ in HINTS for g in groups for x in g} | set(map(squeezed, OVERLOADED)))
    keys = concepts.select("paper_id", tight_key(F.col("label")).alias("k")).filter(F.col("k").isin(known)).groupBy("paper_id").agg(F.collect_set("k").alias("ks"))
    none = F.lit(None).cast("string")
    row = lambda kind, value, why=none, this=none, other=none: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in (("kind", kind), ("value", value), ("why_applicable", why), ("this_field", this), ("other_field", other))])
    one_of = lambda labels: F.arrays_overlap("ks", F.array(*[F.lit(squeezed(x)) for x in labels]))
    hints = [F.when(reduce(and_, map(one_of, groups)), row("hint", field, why)) for groups, field, why in HINTS]
    clashes = F.slice(F.array_compact(F.array(*[F.when(one_of([label]), row("conflict", term, none, this, other)) for label, (term, this, other) in OVERLOADED.items()])), 1, most)
    return keys.select("paper_id", F.inline(F.concat(F.array_compact(F.array(*hints)), clashes)))


#: Confidences that fallbacks give to everything, which say nothing.
FLAT = (0.74, 0.70, 0.68, 0.64, 0.62, 0.60)


def calibrated(concepts: DataFrame, texts: DataFrame) -> DataFrame:
    """concepts (paper_id, label, confidence, auto_detected, candidate_source) with the confidence of scanned and flat ones taken from how the text of their paper (paper_id, text), without its references, mentions them."""
    body = texts.select("paper_id", before_references(F.coalesce("text", F.lit(""))).alias("_body"))
    rows = concepts.filter("trim(label) <> ''").join(body, "paper_id", "left")
    weak = F.coalesce("auto_detected", F.lit(False)) | (F.col("candidate_source") == "deterministic_scan").eqNullSafe(True) | F.coalesce("confidence", F.lit(0.0)).isin(*FLAT)
    return rows.withColumn("confidence", F.when(weak, text_confidence(F.coalesce("_body", F.lit("")), F.trim("label"))).otherwise(F.col("confidence"))).drop("_body")


def filtered(concepts: DataFrame, titles: DataFrame, *, blocked: Iterable[str] = ()) -> DataFrame:
    """concepts (paper_id, label, evidence_span, confidence, auto_detected, candidate_source) without artefacts of parsing; of scanned ones also without blocked keys, pieces of the title (paper_id, title) of three words, those below 0.65, and cut words."""
    rows = concepts.join(titles.select("paper_id", F.col("title").alias("_title")), "paper_id", "left")
    key, title = tight_key(F.col("label")), tight_key(F.col("_title"))
    scanned = (F.col("candidate_source") == "deterministic_scan").eqNullSafe(True)
    low = F.lower(F.coalesce("label", F.lit("")))
    broken = F.contains(low, F.lit("---")) | F.contains(low, F.lit("page break"))
    piece = (title != "") & F.contains(title, key) & (key != title) & (F.size(F.split(F.trim("label"), r"\s+")) >= 3)
    weak = scanned & (key.isin(*blocked) | piece | (F.coalesce("confidence", F.lit(1.0)) < 0.65) | truncated_label(F.col("label")))
    noise = is_noise(F.col("label"), F.col("evidence_span"), auto=F.col("auto_detected"), title=F.col("_title"))
    return rows.filter((key != "") & ~broken & ~noise & ~weak).drop("_title")


def enriched(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entities as rules of ``entities`` take them, linked: canonical_id and match_type by alias (alias, canonical_id, ord), the review status that follows (candidates always wait), and repaired counts of mentions."""
    rest = [c for c in entities.columns if c not in ("canonical_id", "match_type")]
    rows = resolve(entities.select(*rest), aliases)
    status = F.when(F.col("role").endswith("_candidate"), "pending").otherwise(review_status(F.col("match_type"), F.coalesce("confidence", F.lit(0.0)), F.lit(True), F.col("review_status")))
    return repaired_mentions(rows.withColumn("review_status", status)).select(*entities.columns)


def first_items(rows: DataFrame, *, most: int = 12) -> DataFrame:
    """The first items (paper_id, kind, ord) of each kind of a paper."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("paper_id", "kind").orderBy("ord"))).filter(F.col("_n") <= most).drop("_n")


def request_hash(paper_ids: list[str], pdf_paths: dict[str, str], provider: str | None = None, overrides: dict | None = None) -> str:
    """What a batch request is told apart by: the SHA-256 of its JSON with sorted keys."""
    said = {"paper_ids": paper_ids, "pdf_paths": pdf_paths, "llm_provider": provider, "llm_overrides": overrides or {}}
    return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
