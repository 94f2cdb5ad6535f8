"""The scan against its patterns run one by one, and its parts on small texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papyra.functions import scan_table as table
from papyra.operators import scan

OFFICIAL = """
CHANGING DATA SOURCES IN THE AGE OF MACHINE LEARNING FOR OFFICIAL STATISTICS
June 6, 2023
ABSTRACT
Changes in data sources pose risks for machine learning for official statistics.
The repercussions include concept drift, bias, availability, validity, accuracy,
completeness, neutrality, privacy, ownership, ethics, regulation, and public perception.
Data pipelines should monitor changes in incoming data frequency and model retraining
can mitigate distribution changes in derived data fields.

References
Quantum machine learning of Fock space and BERT.
"""


def test_literals_that_a_match_must_have():
    assert scan.literals(r"\bQ[\s-]?learning\b") == ["learning"]
    assert scan.literals(r"\bPPO\b|\bProximal Policy Optimization\b") == ["ppo", "optimization"]
    assert scan.literals(r"\bchang(?:e|es|ing)\s+(?:in\s+)?data sources?\b") == ["change", "changes", "changing"]
    assert scan.literals(r"\bTD\s*\(?\s*(?:lambda|λ)") is None and scan.literals(r"(?:abc)?x") is None and scan.literals("(?:abcd)+") == ["abcd"]
    for label, pattern in table.CONCEPTS:
        found = scan.literals(pattern)
        assert found is None or all(len(x) >= scan.RUN for x in found), label


def test_every_pattern_is_found_where_it_matches(spark):
    """Texts of pieces of patterns and noise: the join gives what running all patterns gives."""
    r = random.Random(5)
    pieces = [re.sub(r"\\b|\\s\*?\+?|[()?:\\]|\[.*?\]", " ", alt) for _, p in table.CONCEPTS for alt in p.split("|")]
    texts = ["; ".join(r.sample(pieces, 12)) + r.choice([". RL emotion", ". data source statistical", ". Quantum dataset", "."]) for _ in range(60)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = docs.select("doc_id", scan.body_of(F.col("text")).alias("body"))
    rows = rows.select("doc_id", "body", *[c.alias(f"gate_{g}") for g, c in scan.gates(F.col("body")).items()]).cache()
    got = {(x["doc_id"], x["kind"], x["label"], x["ord"]) for x in scan.scan_patterns(rows, scan.known_patterns(spark)).collect()}
    want = set()
    open_ = {x["doc_id"]: x for x in rows.collect()}
    for p in scan.known_patterns(spark).collect():
        for i, t in enumerate(texts):
            if (p["gate"] is None or open_[i][f"gate_{p['gate']}"]) and re.search(p["pattern"], t or "", re.I):
                want.add((i, p["kind"], p["label"], p["ord"]))
    assert got == want and len({w[3] for w in want}) > 120
    rows.unpersist()


def test_a_paper_of_official_statistics(spark):
    found = scan.scan(spark.createDataFrame([(1, OFFICIAL), (2, "Emotion only."), (3, None)], "doc_id int, text string")).collect()
    concepts = {r["label"]: r for r in found if r["kind"] == "concept"}
    assert {"Official Statistics", "Machine Learning", "Concept Drift", "Bias", "Data Availability", "Data Validity", "Data Accuracy", "Data Completeness", "Privacy", "Regulation"} <= set(concepts)
    assert not {"BERT", "Fock space"} & set(concepts) and {r["doc_id"] for r in found} == {1}
    assert concepts["Concept Drift"]["context"].startswith("The repercussions include concept drift") and concepts["Concept Drift"]["confidence"] == 0.74
    assert {r["label"] for r in found if r["kind"] == "method"} >= {"Data Source Monitoring"}
    assert sorted(r["ord"] for r in found if r["kind"] == "concept") == list(range(1, len(concepts) + 1))


def test_short_forms_headings_and_phrases(spark):
    body = "We use Deep Reinforcement Learning (RL) here.\nThe Proceedings of Deep Nets (PDN). For Alpha Beta (AB)\n1 Data Sources and Bias\nDATA QUALITY\nBias is high.\nnothing here\nLong Short-Term Memory (LSTM)"
    row = spark.createDataFrame([(body,)], "body string").select(scan.acronym_pairs(F.col("body")).alias("a"), scan.headings(F.col("body")).alias("h"), scan.titled(F.lit("ai-BASED x2y o'neil")).alias("t")).first()
    assert [(a["long"], a["short"]) for a in row["a"]] == [("Reinforcement Learning", "RL"), ("Alpha Beta", "AB"), ("Long Short-Term Memory", "LSTM")]
    assert [h["label"] for h in row["h"]] == ["Data Sources and Bias", "Data Quality"]
    assert row["t"] == "ai-BASED x2y o'neil".title()
    text = "reward policy of an agent. " * 3 + "the reward of robots. learning agents learning agents"
    docs = spark.createDataFrame([(1, text, True), (2, text, False)], "doc_id int, body string, gate_rl_emotion boolean")
    got = {r["label"]: r["n"] for r in scan.repeated_phrases(docs, "rl_emotion").collect()}
    assert got == {k: v for k, v in plain_phrases(text).most_common(20) if v >= 2}


def plain_phrases(text):
    heads, ends, generic, (least, longest) = table.PHRASES["rl_emotion"]
    words = [w for w in re.sub(r"[^A-Za-z0-9\s-]", " ", text).lower().split() if len(w) > 2]
    out = Counter()
    for n in (2, 3, 4):
        for i in range(len(words) - n + 1):
            p = words[i : i + n]
            if set(p) & set(heads) and p[0] not in ends and p[-1] not in ends and set(p) - set(generic) and least <= len(" ".join(p)) <= longest:
                out[" ".join(p).title()] += 1
    return out


@pytest.mark.parametrize(("text", "want"), [("a\n References \nb", "a"), ("a\n2. Works cited\nb", "a"), ("a references b", "a references b"), ("## Bibliography\nx", ""), (None, "")])
def test_bodies(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(F.trim(F.regexp_replace(scan.body_of(F.col("t")), "\n", "")).alias("b")).first()["b"] == want


def test_context_of_a_place(spark):
    text = "First one. Second has a Term in it! third. " + "x" * 300 + " Term " + "y" * 300
    rows = spark.createDataFrame([(text, text.index("Term"), text.index("Term") + 4), (text, text.rindex("Term"), text.rindex("Term") + 4)], "t string, s int, e int")
    got = [r["c"] for r in rows.select(scan.context_for(F.col("t"), F.col("s"), F.col("e")).alias("c")).collect()]
    assert got == ["Second has a Term in it!", "Term " + "y" * 179]


def test_a_table_of_thousands(spark):
    """Other patterns than the scan's own: each document meets the few that it has words of."""
    patterns = spark.createDataFrame([(k, "concept", f"L{k}", rf"\bword{k}x\b", None, 0.5) for k in range(3000)], scan.PATTERNS)
    docs = spark.createDataFrame([(i, f"some word{i * 7}x and WORD{i * 11 + 1}X") for i in range(50)], "doc_id int, body string")
    got = {(r["doc_id"], r["label"]) for r in scan.scan_patterns(docs, patterns).collect()}
    assert got == {(i, f"L{k}") for i in range(50) for k in (i * 7, i * 11 + 1)}


def test_only_documents_that_have_a_whole_literal_meet_its_pattern(spark, monkeypatch):
    """Words that begin like a literal meet nothing: what is joined with texts is what can match."""
    held = []
    monkeypatch.setattr(scan, "kept", lambda df: held.append(df.cache()) or held[-1])
    patterns = spark.createDataFrame([(k, "concept", f"L{k}", rf"\bstatement{c}\b", None, 0.5) for k, c in enumerate("abcdefgh")], scan.PATTERNS)
    docs = spark.createDataFrame([(1, "statements state the statue"), (2, "xStatementAy"), (3, "a Statementb; statementb statementC"), (4, None)], "doc_id int, body string")
    got = {(r["doc_id"], r["label"]) for r in scan.scan_patterns(docs, patterns).collect()}
    assert got == {(3, "L1"), (3, "L2")}
    assert {r["doc_id"]: len(r["met"]) for r in held[0].collect()} == {2: 1, 3: 2}
