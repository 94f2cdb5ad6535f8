"""Relations from texts, fixed word lists and repaired letters on small rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

ENTITY = "paper_id string, ord int, canonical_id string, label string, canonical_label string, entity_type string, review_status string, aliases array<string>, evidence_span string, context string, description string, section string"


def entity(paper, k, id_, label, text, kind="Task", status="approved", section=None, aliases=None):
    return (paper, k, id_, label, None, kind, status, aliases, text, None, None, section)


@pytest.mark.parametrize(
    ("kind", "word"),
    [("CAUSES", "a shift in"), ("LEADS_TO", "degradation of"), ("IMPLIES", "therefore"), ("MITIGATES", "to counter"), ("PREVENTS", "a single point of"), ("AFFECTS", "the repercussion of"), ("BUILT_ON", "a simulation of"), ("PROVIDES", "an interface to"), ("REPRODUCES", "replicates"), ("DERIVED_FROM", "a distilled"), ("MORE_ROBUST_THAN", "a perturbation of"), ("SUPPORTS", "exposes"), ("RELATED_TO", "an analogy with"), ("PART_OF", "located in")],
)
def test_words_of_a_relation_decide(spark, kind, word):
    from papyra.operators.context import relation_evidence

    plain = "Sparse coding stands beside motor babbling in a far longer text without telling words at all"
    told = f"sparse coding, {word} motor babbling"
    e = spark.createDataFrame([entity("p", 1, "a", "Sparse coding", plain), entity("p", 2, "b", "Motor babbling", told), entity("q", 1, "a", "Sparse coding", "other paper: sparse coding, " + word + " motor babbling!")], ENTITY)
    r = spark.createDataFrame([("p", "a", kind, "b"), ("p", "a", "NO_SUCH", "b"), ("p", "a", kind, "zz")], "paper_id string, subject_id string, relation_type string, object_id string")
    got = {x["relation_type"]: x["evidence"] for x in relation_evidence(r, e).collect()}
    assert got == {kind: told, "NO_SUCH": plain}


def test_terms_of_some_entities_and_their_pair(spark):
    from papyra.operators.context import relation_evidence

    long_ = "Boltzmann action selection and valency stand here in a text of more letters and nothing else"
    short = "β is influenced by valency, with boltzmann"
    e = spark.createDataFrame(
        [
            entity("p", 1, "v", "Valence", long_), entity("p", 2, "s", "Boltzmann action selection", short), entity("p", 3, "c", "Clinical decision support", "a cds of llms"), entity("p", 4, "l", "Large language model", ""),
            entity("p", 5, "r", "Reward shaping", ""), entity("p", 6, "x", "Shaping of the reward by tdlearning", "reward and shaping apart; cds"),
        ],
        ENTITY,
    )
    r = spark.createDataFrame([("p", "s", "MODULATED_BY", "v"), ("p", "c", "USES", "l"), ("p", "r", "EVALUATED_ON", "c")], "paper_id string, subject_id string, relation_type string, object_id string")
    got = {x["relation_type"]: x["evidence"] for x in relation_evidence(r, e).collect()}
    # A text of valence has a word of this pair's own, so the longer of two decides. Reward shaping is
    # found by phrases only, so no text speaks of it and the object's own text stands.
    assert got == {"MODULATED_BY": long_, "USES": "a cds of llms", "EVALUATED_ON": "a cds of llms"}


def test_generic_relations(spark):
    from papyra.operators.context import context_relations

    e = spark.createDataFrame(
        [
            entity("p", 1, "net", "Deep-parsing net", "the deep parsing net is applied to ripple finding", "System", section="2"),
            entity("p", 2, "task", "Ripple finding", "no word of others", "Task"),
            entity("p", 3, "set", "Ripple-1000", "deep–parsing net was trained on it", "Dataset"),
            entity("p", 4, "rate", "Miss rate", "a score for ripple finding", "Metric"),
            entity("p", 5, "arch", "Tree encoder", "built on deep parsing net", "ModelArchitecture", "pending"),
            entity("p", 6, "net", "Deep-parsing net", "short", "System"),
            entity("p", 7, None, "Ripple finding", "deep-parsing net for it", "Task"),
            entity("q", 1, "net", "Deep-parsing net", "for ripple finding", "System"),
        ],
        ENTITY,
    )
    got = {tuple(r)[:4]: (r["evidence_span"], r["section"]) for r in context_relations(e).collect()}
    assert got == {
        ("p", "net", "USED_FOR", "task"): ("the deep parsing net is applied to ripple finding", "2"),
        ("p", "net", "EVALUATED_ON", "set"): ("deep–parsing net was trained on it", "2"),
        ("p", "rate", "MEASURES", "task"): ("a score for ripple finding", ""),
    }


def test_generic_relations_are_cut_in_order(spark):
    from papyra.operators.context import context_relations

    names = [f"{a}{b}" for a in ("ale", "bor", "cil", "dur", "fex", "gom", "hin", "jat") for b in ("stone", "rivers", "fields", "meadow", "island", "harbour", "canyon", "forest")]
    text = "used for " + " ".join(names[1:])
    rows = [entity("p", 0, "c0", names[0], text, "System")] + [entity("p", k, f"c{k}", n, "nothing", "Task") for k, n in enumerate(names[1:], 1)]
    got = context_relations(spark.createDataFrame(rows, ENTITY))
    assert sorted(int(r["object_id"][1:]) for r in got.collect()) == list(range(1, 49))
    assert context_relations(spark.createDataFrame([], ENTITY)).count() == 0


def test_claims_are_compared_without_all_stop_words(spark):
    from papyra.functions.text import CLAIM_STOP, claim_terms

    assert len(CLAIM_STOP) == 33
    row = spark.sql("SELECT 'Across sites, after rain and among ferns, moss grows' AS s").select(claim_terms(F.col("s")).alias("t")).first()
    assert row["t"] == ["sites", "rain", "ferns", "moss", "grows"]


def test_core_terms_of_medical_imaging(spark):
    from papyra.operators.entities import promote_concepts, promote_methods

    schema = "paper_id string, ord int, role string, label string, canonical_label string, canonical_id string, match_type string, entity_type string, confidence double, mention_count int, salience string, source_type string, candidate_source string, review_status string, aliases array<string>"
    row = lambda p, k, role, label, source, scan: (p, k, role, label, None, f"id{k}", "exact_alias", "Algorithm", 0.7, 1 if role[0] == "m" else 0, "passing", source, scan, "pending", None)
    e = spark.createDataFrame([row("r", 1, "concept_candidate", "TOF-MRA", None, "deterministic_scan"), row("r", 2, "concept_candidate", "TOF-MRA", None, None), row("t", 1, "concept_candidate", "TOF-MRA", None, "deterministic_scan"), row("r", 3, "method_candidate", "TOF MRA", "paper_contribution", None), row("t", 3, "method_candidate", "TOF MRA", "paper_contribution", None)], schema)
    papers = spark.createDataFrame([("r", "research", "x"), ("t", "theoretical", "x")], "paper_id string, paper_type string, title string")
    up = lambda df: sorted((r["paper_id"], r["ord"]) for r in df.filter("review_status = 'approved'").collect())
    assert up(promote_concepts(e, papers, core={"medical_imaging": ["tofmra"]})) == [("r", 1)]
    assert up(promote_methods(e, papers, medical=["tofmra"])) == [("r", 3)]


def test_letters_are_repaired(spark):
    from papyra.functions.recovery import scientific_text, transcoded

    sound = ["naïve café", "“quotes” – and €", "漢字", "", None, "Ã", "plain", "TÃ¤"]
    broken = ["naïve café", "“quotes” – and €", "Größe ’x’", "Ångström"]
    spoilt = []
    for t in broken:
        raw = t.encode("utf-8")
        try:
            spoilt.append((t, raw.decode("cp1252")))
        except UnicodeDecodeError:
            continue
    assert len(spoilt) >= 2
    rows = spark.createDataFrame([(w, s) for w, s in spoilt] + [(s, s) for s in sound if s != "TÃ¤"] + [("Tä", "TÃ¤")], "want string, said string")
    assert [r for r in rows.select("want", transcoded(F.col("said")).alias("got")).collect() if r["want"] != r["got"]] == []
    got = spark.createDataFrame([("TD(Î»), TD(λ), Â±, ﬁt—x­y",)], "s string").select(scientific_text(F.col("s")).alias("s")).first()["s"]
    assert got == "TD(lambda), TD(lambda), ±, fit-xy"


def test_what_a_survey_contributes_is_one_method(spark):
    from papyra.operators.entities import SURVEY_NAME, merged_methods

    schema = "paper_id string, ord int, label string, canonical_label string, aliases array<string>, description string, evidence_span string, context string, confidence double, review_status string, source_type string"
    row = lambda p, k, label, text, source="paper_contribution": (p, k, label, None, None, text, None, None, 0.7, "pending", source)
    m = spark.createDataFrame([row("s", 1, "A taxonomy of emotion", "d"), row("s", 2, "Overview", "affect in agents"), row("s", 3, "Taxonomy of emotion", "d", "baseline"), row("r", 1, "A taxonomy of emotion", "d")], schema)
    papers = spark.createDataFrame([("s", "survey"), ("r", "research")], "paper_id string, paper_type string")
    got = {(r["paper_id"], r["label"]): r["aliases"] for r in merged_methods(m, papers).collect()}
    assert got == {("s", SURVEY_NAME): ["A taxonomy of emotion", "Overview"], ("s", "Taxonomy of emotion"): [], ("r", "A taxonomy of emotion"): []}


def test_papers_of_few_entities_are_not_cut_into_blocks(spark, monkeypatch):
    from papyra.operators import context

    names = ["Sparse coding", "Motor babbling", "Tree encoder", "Ripple finding"]
    rows = [entity(p, k, f"c{k}", n, f"{n.lower()} is built on {names[k - 1].lower()}, used for it", ("System", "ModelArchitecture", "Task")[k % 3]) for p in ("p", "q") for k, n in enumerate(names)]
    rows += [entity("q", 9, "c9", "Quiet term", "nothing of others"), entity("q", 10, None, "No id", "tree encoder beside sparse coding, at length")]
    e = spark.createDataFrame(rows, ENTITY)
    r = spark.createDataFrame([(p, f"c{a}", "USES", f"c{b}") for p in ("p", "q", "z") for a in range(4) for b in range(4)] + [("q", "c9", "USES", "c1"), ("q", None, "USES", "c1")], "paper_id string, subject_id string, relation_type string, object_id string")
    told = {}
    for many in (5, 64, 0):
        monkeypatch.setattr(context, "MANY", many)
        evidence, relations = context.relation_evidence(r, e), context.context_relations(e)
        told[many] = sorted(map(repr, evidence.collect())), sorted(map(repr, relations.collect()))
        if many == 64:  # no row for each four letters of a text
            assert not any("block" in df._jdf.queryExecution().optimizedPlan().toString() for df in (evidence, relations))
    assert len(told[64][0]) == 33 and told[64][1]
    assert told[5] == told[64] == told[0]


def test_promotion_of_equal_places_repeats(spark):
    from papyra.operators.entities import promote_endpoints

    schema = "paper_id string, ord int, role string, label string, canonical_label string, canonical_id string, match_type string, entity_type string, confidence double, mention_count int, salience string, source_type string, candidate_source string, review_status string, aliases array<string>"
    row = lambda k, role, label, kind, status="pending": ("p", k, role, label, None, f"id-{label}", "exact_alias", kind, 0.7, 1, "passing", None, None, status, None)
    rows = [row(1, "method", "a", "Task", "approved"), row(2, "method_candidate", "b", "Theory"), row(2, "method_candidate", "b", "Algorithm"), row(2, "method_candidate", "b", "System")]
    t = spark.createDataFrame([("a", "USES", "b")], "subj string, rel string, obj string")
    told = [sorted((r["entity_type"], r["role"]) for r in promote_endpoints(spark.createDataFrame(x, schema).coalesce(1), t).filter("ord = 2").collect()) for x in (rows, rows[::-1], rows[2:] + rows[:2])]
    assert told[0] == told[1] == told[2] and ("Algorithm", "method") in told[0]
