"""Relations from what the texts of a paper's entities say: which text speaks of which entity, evidence, generic relations.

A text speaks of an entity if it has one of its phrases, or enough of its telling words. Both are
looked for as parts of the text, so pairs of an entity and a text are found by blocks of four
letters: the first four of a phrase or telling word must be in the text. Only pairs of one paper
that share a block are compared. Blocks of a text are many times its size, so only papers of more
than MANY entities are cut into blocks; in a smaller paper each entity meets each text.

Entities are rows as in ``entities``: paper_id, ord, label, canonical_label, canonical_id,
entity_type, review_status, aliases, evidence_span, context, description, section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.recovery import scientific_text
from ..functions.scalars import first_filled
from .entities import entity_text, labels, one_per_id, tight_key
from .linking import small

# Words of labels that say little of what a text is about.
GENERIC_WORDS = "action agent agents based concept emotion emotional function functions learning method methods model models network networks neural quantum reinforcement state states system systems theory used".split()
# Further phrases and words of some entities, and entities that only phrases find, by key.
MORE_PHRASES = {
    "valence": ("valency", "valence"),
    "boltzmannactionselection": ("boltzmann action selection", "boltzmann", "beta", "β", "Î²"),
    "largelanguagemodel": ("large language model", "large language models", "llm", "llms", "llm-based"),
    "clinicaldecisionsupport": ("clinical decision support", "cds", "cds systems"),
    "rewardshaping": ("reward shaping", "reward modification", "reward modulation", "modify the reward", "modify reward", "modified reward", "emotions to modify the reward"),
    "tdlearning": ("td learning", "temporal difference learning", "model-free rl", "model free rl"),
    "modelbasedrl": ("model-based rl", "model based rl", "model-based reinforcement learning"),
}
MORE_WORDS = {"valence": ("valency",), "boltzmannactionselection": ("boltzmann", "beta"), "largelanguagemodel": ("llm", "llms"), "clinicaldecisionsupport": ("cds",)}
PHRASES_ONLY = ("rewardshaping", "tdlearning", "modelbasedrl")
# Words that speak of a relation, by its type.
RELATION_WORDS = {
    "CORRESPONDS_TO": ("connection", "correspond", "maps", "mapped"),
    "MEASURES": ("measure", "derive", "distance"),
    "IMPLEMENTS": ("implements", "update", "approximate", "value-function", "value function"),
    "IMPLIES": ("implies", "imply", "entails", "enables", "therefore", "superselection", "pointer"),
    "ELICITS": ("elicit", "elicits", "derive", "derives", "generate"),
    "USED_FOR": ("used for", "improve", "improved", "learning efficiency", "drive", "guide"),
    "USED_IN": ("used in", "basis", "defined", "definition", "compute", "computed", "framework"),
    "PART_OF": ("part of", "located", "system", "component", "subdivision"),
    "CAUSES": ("affect", "cause", "change", "degradation", "generate", "generates", "impact", "induce", "lead", "risk", "shift"),
    "LEADS_TO": ("affect", "cause", "change", "degradation", "generate", "generates", "impact", "induce", "lead", "risk", "shift"),
    "MITIGATES": ("counter", "ensure", "essential", "mitigate", "monitor", "prevent", "robust", "strategy", "validate"),
    "PREVENTS": ("avoid", "discontinuation", "failure", "prevent", "robust", "single point"),
    "AFFECTS": ("affect", "consequence", "impact", "quality", "repercussion", "risk"),
    "BUILT_ON": ("built", "built on", "based on", "framework", "simulation"),
    "PROVIDES": ("provide", "provided", "integration", "module", "exposes", "interface"),
    "SUPPORTS": ("support", "supports", "encoding", "exposes", "strategy"),
    "USES": ("use", "uses", "using", "with", "based on"),
    "REPRODUCES": ("reproduce", "reproduces", "replicate", "replicates", "benchmark", "implementation"),
    "EVALUATED_ON": ("dataset", "evaluated", "trained", "training", "benchmark", "on"),
    "DERIVED_FROM": ("derived", "distilled", "distillation", "version", "from"),
    "OUTPERFORMS": ("outperform", "outperforms", "better", "best", "higher", "improve"),
    "MORE_ROBUST_THAN": ("robust", "more robust", "vulnerable", "whereas", "than", "perturbation"),
    "RELATED_TO": ("related", "mapping", "cross-domain", "cross domain", "cross-modal", "analogy"),
}
# A pair of ends whose relation has words of its own.
MODULATED = ("MODULATED_BY", "boltzmannactionselection", "valence", ("influenced", "modulated", "valency", "valence", "beta", "β"))
# Relations that types and texts alone suggest, the first that holds; their types, their words, and whether the object's text counts too.
METHODS = ("Algorithm", "MethodFamily", "ModelArchitecture", "System", "Task")
AIMS = ("Task", "Phenomenon", "ApplicationSetting", "DomainConcept")
GENERIC = (
    ("EVALUATED_ON", METHODS, ("Dataset", "Benchmark"), ("evaluated", "evaluation", "benchmark", "benchmarked", "dataset", "trained", "training", "tested", "validation", "study"), True),
    ("USED_FOR", METHODS, AIMS, ("for", "used for", "applied to", "detect", "detection", "classify", "classification", "predict", "prediction", "support", "decision", "control", "design", "validation", "monitoring", "generation", "estimate", "analyze", "analysis", "reduce", "reducing"), False),
    ("USES", ("System", "ModelArchitecture", "MethodFamily"), ("Algorithm", "MethodFamily", "ModelArchitecture"), ("uses", "using", "based on", "built on", "powered by", "implemented with", "integrates", "applies", "leverages", "incorporates", "llm-based", "ai-based"), False),
    ("MEASURES", ("Metric",), AIMS, ("measure", "measures", "metric", "score", "rate", "assess", "assesses", "evaluate", "quantify", "risk", "error"), False),
)
#: Entities of a paper up to which its entities and texts meet without blocks.
MANY = 64
#: Letters of a block, and terms that are shorter.
BLOCK = 4
SHORT = tuple(t for more in (MORE_PHRASES, MORE_WORDS) for ts in more.values() for t in ts if len(t) < BLOCK)


def _none() -> Column:
    return F.array().cast("array<string>")


def _of_key(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    """What a table of fixed values has for a key."""
    found = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(found, key), _none())


def _low(text: Column) -> Column:
    """scientific_text(), lower-cased. ASCII is as it was, so only other texts are sent to Python."""
    wide = text.rlike("[^\\x00-\\x7F]")
    return F.lower(F.when(wide, scientific_text(F.when(wide, text))).otherwise(text))


def _normal(texts: Column) -> Column:
    """_low() of each text of an array; Python functions take no lambda's variable, so they go as one text."""
    return F.split(_low(F.array_join(texts, "\x1f")), "\x1f")


def _by_size(entities: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """entities of papers with MANY at most, and of others if there are any."""
    crowded = entities.groupBy("paper_id").agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select("paper_id")
    if crowded.isEmpty():
        return entities, None
    crowded = small(crowded)
    return entities.join(crowded, "paper_id", "left_anti"), entities.join(crowded, "paper_id", "left_semi")


def with_terms(entities: DataFrame) -> DataFrame:
    """entities with _phrases, _words and _anchors that a text is searched for: labels with spaces and hyphens changed for one another, their words of four letters that aren't generic, the first such word of each; and what tables add by key."""
    rows = entities.withColumn("_l", _normal(labels())).withColumn("_key", tight_key(first_filled(F.col("canonical_label"), F.col("label"))))
    low = F.transform("_l", lambda x: F.trim(x))
    variants = F.flatten(F.transform(low, lambda x: F.array(x, F.replace(x, F.lit("-"), F.lit(" ")), F.replace(x, F.lit(" "), F.lit("-")))))
    words = F.transform(low, lambda x: F.filter(F.regexp_extract_all(x, F.lit("[a-z][a-z0-9-]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS)))
    telling = F.when(F.col("_key").isin(*PHRASES_ONLY), _none()).otherwise(F.concat(F.flatten(words), _of_key(MORE_WORDS, F.col("_key"))))
    return rows.withColumns(
        {
            "_phrases": F.array_distinct(F.concat(F.filter(variants, lambda x: F.length(x) >= 4), _of_key(MORE_PHRASES, F.col("_key")))),
            "_words": F.array_distinct(telling),
            "_anchors": F.array_distinct(F.array_compact(F.transform(words, lambda ws: F.get(ws, 0)))),
        }
    ).drop("_l")


def match_score(text: Column, phrases: Column, words: Column, anchors: Column) -> Column:
    """4 where a text has a phrase; 2 where it has two of the words (one, if there is but one) and an anchor; else 0."""
    n = F.size(F.filter(words, lambda w: F.contains(text, w)))
    near = (F.size(words) > 0) & (n >= F.least(F.lit(2), F.size(words))) & ((F.size(anchors) == 0) | F.exists(anchors, lambda a: F.contains(text, a)))
    return F.when(F.exists(phrases, lambda p: F.contains(text, p)), 4).when(near, 2).otherwise(0)


def _blocks(text: Column) -> Column:
    """Every four letters of a text that run on, once each; and the short terms that it has."""
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (BLOCK - 1))), lambda i: F.substr(text, i, F.lit(BLOCK)))
    return F.array_distinct(F.concat(all_, F.filter(F.array(*map(F.lit, SHORT)), lambda t: F.contains(text, t))))


def texts_of(entities: DataFrame) -> DataFrame:
    """paper_id, text, low of the entities' texts of each paper, once each; low is normalised."""
    rows = entities.select("paper_id", entity_text().alias("text")).filter("text <> ''").repartition("paper_id").distinct()
    return rows.withColumn("low", _low(F.col("text")))


def spoken_of(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """paper_id, target (an entity's canonical_id), text, score of all texts (paper_id, text, low) that speak of an entity of their paper (from with_terms())."""
    anchors = F.when(F.size("_anchors") > 0, F.col("_anchors")).otherwise(F.col("_words"))
    keys = F.array_distinct(F.transform(F.concat("_phrases", anchors), lambda t: F.substring(t, 1, BLOCK)))
    wanted = entities.select("paper_id", F.col("canonical_id").alias("target"), "_phrases", "_words", "_anchors", F.explode(keys).alias("block"))
    held = texts.select("paper_id", "text", "low", F.explode(_blocks(F.col("low"))).alias("block"))
    pairs = wanted.select("paper_id", "target", "block").join(held.select("paper_id", "text", "block"), ["paper_id", "block"]).select("paper_id", "target", "text").distinct()
    met = pairs.join(entities.select("paper_id", F.col("canonical_id").alias("target"), "_phrases", "_words", "_anchors"), ["paper_id", "target"]).join(texts, ["paper_id", "text"])
    score = match_score(F.col("low"), F.col("_phrases"), F.col("_words"), F.col("_anchors"))
    return met.select("paper_id", "target", "text", "low", score.alias("score")).filter("score > 0")


def relation_terms(kind: Column, subject_key: Column, object_key: Column) -> Column:
    """Words that speak of a relation."""
    of, subject, object_, words = MODULATED
    own = (kind == of) & (subject_key == subject) & (object_key == object_)
    return F.when(own, F.array(*map(F.lit, words))).otherwise(_of_key(RELATION_WORDS, kind))


def _first_of_id(entities: DataFrame) -> DataFrame:
    """The first entity of each id of a paper."""
    known = entities.filter(F.coalesce("canonical_id", F.lit("")) != "")
    parts = F.struct("label", "canonical_label", "aliases", entity_text().alias("_text"))
    return known.groupBy("paper_id", "canonical_id").agg(F.min_by(parts, "ord").alias("e")).select("paper_id", "canonical_id", "e.*")


_KEYS = ("paper_id", "subject_id", "relation_type", "object_id")


def _own_text() -> Column:
    """What stands for evidence where no text speaks of both ends."""
    turned = F.col("relation_type").isin("REPRODUCES", "EVALUATED_ON")
    return first_filled(F.when(turned, F.col("_object._text")).otherwise(F.col("_subject._text")), F.when(turned, F.col("_subject._text")).otherwise(F.col("_object._text")), F.concat_ws(" ", "_subject.label", "_object.label"))


def _rank(score: Column) -> Column:
    """How good a text is for a relation, by which the greatest is taken."""
    speaks = F.exists(relation_terms(F.col("relation_type"), F.col("_subject._key"), F.col("_object._key")), lambda t: F.contains("low", t))
    return F.struct((score + F.when(speaks, 3).otherwise(0)).alias("s"), F.length("text").alias("n"), "text")


def _evidence(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relation_evidence() in papers of few entities: a relation, which carries the terms of its ends, meets the texts of its paper."""
    side = lambda c, subject: F.struct(F.col(c).alias("canonical_id"), F.lit(subject).alias("_is"))
    ends = relations.select(*_KEYS).distinct().select(*_KEYS, F.inline(F.array(side("subject_id", True), side("object_id", False))))
    e = with_terms(ends.join(_first_of_id(entities), ["paper_id", "canonical_id"]))
    end = F.struct("_text", "_key", "label", "_phrases", "_words", "_anchors")
    keyed = e.groupBy(*_KEYS).agg(F.any_value(F.when(F.col("_is"), end), True).alias("_subject"), F.any_value(F.when(~F.col("_is"), end), True).alias("_object")).filter("_subject is not null and _object is not null")
    met = keyed.join(texts_of(entities), "paper_id", "left")
    a, b = (match_score(F.col("low"), F.col(f"{c}._phrases"), F.col(f"{c}._words"), F.col(f"{c}._anchors")) for c in ("_subject", "_object"))
    scored = met.select(*_KEYS, "_subject", "_object", "text", "low", a.alias("_a"), b.alias("_b"))
    ranked = F.when((F.col("_a") > 0) & (F.col("_b") > 0), _rank(F.col("_a") + F.col("_b")))
    best = scored.select(*_KEYS, ranked.alias("_r"), _own_text().alias("_own")).groupBy(*_KEYS).agg(F.max("_r").alias("b"), F.any_value("_own").alias("_own"))
    return best.select(*_KEYS, F.substring(F.coalesce("b.text", "_own"), 1, 360).alias("evidence"))


def _evidence_by_blocks(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relation_evidence() in papers of many entities: a relation meets only texts that speak of its subject, and of those the ones that speak of its object."""
    e = with_terms(_first_of_id(entities))
    keys = list(_KEYS)
    end = lambda side: e.select("paper_id", F.col("canonical_id").alias(f"{side}_id"), F.struct("_text", "_key", "label").alias(f"_{side}"))
    keyed = relations.select(*keys).distinct().join(end("subject"), ["paper_id", "subject_id"]).join(end("object"), ["paper_id", "object_id"])
    spoken = spoken_of(e, texts_of(entities))
    a = spoken.select("paper_id", F.col("target").alias("subject_id"), "text", "low", F.col("score").alias("_a"))
    b = spoken.select("paper_id", F.col("target").alias("object_id"), "text", F.col("score").alias("_b"))
    met = keyed.join(a, ["paper_id", "subject_id"]).join(b, ["paper_id", "object_id", "text"])
    best = met.groupBy(*keys).agg(F.max(_rank(F.col("_a") + F.col("_b"))).alias("b")).select(*keys, F.col("b.text").alias("_best"))
    return keyed.join(best, keys, "left").select(*keys, F.substring(F.coalesce("_best", _own_text()), 1, 360).alias("evidence"))


def relation_evidence(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations (paper_id, subject_id, relation_type, object_id) with evidence: of the texts of the paper's entities that speak of both ends the best (three more for a word of the relation; then the longest, then the last in order), else an end's own text, cut to 360 characters.

    Relations with an end that is no entity of their paper are left out.
    """
    few, many = _by_size(entities)
    found = _evidence(relations, few)
    return found if many is None else found.unionByName(_evidence_by_blocks(relations, many))


_END = ("canonical_id", "ord", "entity_type", "_key", "section")


def _carried(e: DataFrame) -> DataFrame:
    """paper_id, c, t, text, low: entities whose own text speaks of another of their paper, and these, in papers of few entities."""
    whole = F.struct(*_END, "_text", "_low", "_phrases", "_words", "_anchors")
    packed = e.groupBy("paper_id").agg(F.collect_list(whole).alias("_all"))  # MANY at most
    pairs = packed.select("paper_id", F.explode("_all").alias("c"), "_all").filter("c._text <> ''").select("paper_id", "c", F.explode("_all").alias("t")).filter("c.canonical_id <> t.canonical_id")
    said = match_score(F.col("c._low"), F.col("t._phrases"), F.col("t._words"), F.col("t._anchors")) > 0
    end = lambda x: F.struct(*[F.col(f"{x}.{n}").alias(n) for n in _END]).alias(x)
    return pairs.filter(said).select("paper_id", end("c"), end("t"), F.col("c._text").alias("text"), F.col("c._low").alias("low"))


def _carried_by_blocks(e: DataFrame) -> DataFrame:
    """_carried() in papers of many entities."""
    texts = e.filter("_text <> ''").select("paper_id", F.col("_text").alias("text"), F.col("_low").alias("low")).distinct()
    spoken = spoken_of(e, texts).select("paper_id", F.col("target").alias("_t"), "text", "low")
    carriers = e.select("paper_id", F.struct(*_END).alias("c"), F.col("_text").alias("text"))
    targets = e.select("paper_id", F.col("canonical_id").alias("_t"), F.struct(*_END).alias("t"))
    return carriers.join(spoken, ["paper_id", "text"]).filter("c.canonical_id <> _t").join(targets, ["paper_id", "_t"]).select("paper_id", "c", "t", "text", "low")


def context_relations(entities: DataFrame, *, most: int = 48) -> DataFrame:
    """paper_id, subject_id, relation_type, object_id, evidence_span, section, confidence, source, review_status: relations between two approved entities of a paper that their types allow and that the text of one, speaking of the other, has words for; the first ``most`` of a paper in the order of its entities.

    One entity of each id counts (one_per_id()). The order of a paper's relations is by subject,
    then by object, so the cut is one window over relations that hold, not over pairs.
    """
    few, many = _by_size(entities.filter((F.coalesce("canonical_id", F.lit("")) != "") & (F.lower("review_status") == "approved")))
    termed = lambda df: with_terms(one_per_id(df.repartition("paper_id")).withColumn("_text", entity_text())).withColumn("_low", _low(F.col("_text")))
    carried = _carried(termed(few))
    carried = carried if many is None else carried.unionByName(_carried_by_blocks(termed(many)))
    said = F.struct("text", "low")
    ways = F.array(*[F.struct(F.col(s).alias("_subject"), F.col(o).alias("_object"), (said if s == "c" else F.when(F.lit(False), said)).alias("ahead"), (said if s == "t" else F.when(F.lit(False), said)).alias("back")) for s, o in (("c", "t"), ("t", "c"))])
    both = carried.select("paper_id", F.inline(ways)).withColumns({"subject_id": F.col("_subject.canonical_id"), "object_id": F.col("_object.canonical_id")})
    p = both.groupBy("paper_id", "subject_id", "object_id").agg(*[F.any_value(c, True).alias(c) for c in ("ahead", "back", "_subject", "_object")])
    says = lambda text, terms: text.isNotNull() & F.exists(terms, lambda t: F.contains(text["low"], t))
    lits = lambda xs: F.array(*map(F.lit, xs))
    a, b = F.col("ahead"), F.col("back")

    def holds(subjects: tuple, objects: tuple, terms: tuple, either: bool) -> Column:
        typed = F.col("_subject.entity_type").isin(*subjects) & F.col("_object.entity_type").isin(*objects)
        return typed & (says(a, lits(terms)) | says(b, lits(terms)) if either else says(a, lits(terms)))

    kind = F.coalesce(*[F.when(holds(s, o, t, either), rel) for rel, s, o, t, either in GENERIC])
    more = F.coalesce(*[F.when(F.col("relation_type") == rel, lits(t)) for rel, _, _, t, _ in GENERIC])
    found = p.withColumn("relation_type", kind).filter("relation_type is not null")
    found = found.withColumn("_terms", F.concat(relation_terms(F.col("relation_type"), F.col("_subject._key"), F.col("_object._key")), more))
    found = found.withColumn("evidence_span", F.substring(F.when(says(a, F.col("_terms")), a["text"]).when(says(b, F.col("_terms")), b["text"]), 1, 360)).filter("evidence_span <> ''")
    k = F.row_number().over(W.partitionBy("paper_id").orderBy("_subject.ord", "_object.ord"))
    section = F.coalesce(first_filled(F.col("_subject.section"), F.col("_object.section")), F.lit(""))
    kept = found.withColumn("_k", k).filter(F.col("_k") <= most)
    return kept.select("paper_id", "subject_id", "relation_type", "object_id", "evidence_span", section.alias("section"), F.lit(0.8).alias("confidence"), F.lit("deterministic_relation").alias("source"), F.lit("approved").alias("review_status"))
