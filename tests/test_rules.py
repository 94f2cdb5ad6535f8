"""Rules against expected values that were worked out by hand, or against plain versions."""

from __future__ import annotations

import hashlib
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_claims(spark):
    from papyra.functions.text import claim_type, negated

    rows = {
        "Our data are too simple.": ("limitation", False),
        "There is no evidence for it.": ("negative_result", True),
        "A is more robust than B": ("comparison", False),
        "You must test": ("recommendation", False),
        "We introduce X without performance loss": ("contribution", False),
        "The sky is blue": ("finding", False),
        "It works without any care": ("finding", False),
        "The model fails to learn and cannot": ("negative_result", True),
    }
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    got = {r["s"]: (r["t"], r["n"]) for r in df.select("s", claim_type(F.col("s")).alias("t"), negated(F.col("s"), claim_type(F.col("s"))).alias("n")).collect()}
    assert got == rows
    r = one(spark, given=claim_type(F.lit("x"), F.lit(" Limitation ")), odd=claim_type(F.lit("x"), F.lit("guess")), said=negated(F.lit("x"), F.lit("finding"), F.lit(True)), lim=negated(F.lit("x"), F.lit("limitation"), F.lit(True)), none=claim_type(F.lit(None).cast("string")))
    assert r == {"given": "limitation", "odd": "finding", "said": True, "lim": False, "none": "finding"}


def test_mentions(spark):
    from papyra.functions.text import mentions

    text = "Idiot idiot idiot, deep Q-learning and deep  q learning; DQL in DQL. (c++) naïve idiotic"
    r = one(spark, a=mentions(F.lit(text), "idiot"), b=mentions(F.lit(text), "Deep Q learning"), c=mentions(F.lit(text), "Dense Quick Learner"), d=mentions(F.lit(text), "c++"), e=mentions(F.lit(text), "na"), f=mentions(F.lit(None).cast("string"), "x"), g=mentions(F.lit(text), ""))
    assert r == {"a": 3, "b": 2, "c": 2, "d": 1, "e": 0, "f": 0, "g": 0}


def test_fallback_claims_windows(spark):
    from papyra.operators.extraction import fallback_claims

    filler = "Nothing here has any sign of that kind and it goes on for a good while longer still. " * 4
    found = "Our method shows that the windows of a paper are read in order and none twice at all."
    last = "We demonstrate in the end that no later window is needed for what has been said so far."
    paper = f"Title\nAbstract {filler}{found} {found}\n1. Introduction\nWe have results that aren't in any window, as the introduction is none of these parts.\nConclusion\n{filler}{last}\nReferences\n[1] our results are shown in a list of references that is no part of the paper any more."
    rows = fallback_claims(spark.createDataFrame([(1, paper), (2, "x" * 50 + ". " + found), (3, None), (4, "")], "doc_id long, text string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["ord"])):
        got.setdefault(r["doc_id"], []).append((r["statement"], r["negated"]))
    assert got == {1: [(found[:-1], False), (last[:-1], True)], 2: [(found[:-1], False)]}


def test_noise(spark):
    from papyra.operators.extraction import is_noise, noisy_label, truncated_label

    rows = [("of learning", "Section or heading: of learning", True), ("University of X", "| section or heading: a", True), ("learning", "section or heading: x", False), ("of learning", "said", False), ("!!", "", True), ("Data", "repeated phrase in parsed paper text (3)", True)]
    df = spark.createDataFrame(rows, "label string, evidence string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", is_noise(F.col("label"), F.col("evidence")).alias("got")).collect())
    r = one(spark, a=noisy_label(F.lit("x --- y")), b=noisy_label(F.lit("reward page")), c=noisy_label(F.lit("learn to")), d=noisy_label(F.lit("Q")), e=truncated_label(F.lit("classi fication")), f=truncated_label(F.lit("verifi cation")), g=truncated_label(F.lit("cation")), h=is_noise(F.lit("of deep nets"), auto=F.lit(True), title=F.lit("A Study of Deep Nets")))
    assert r == {"a": True, "b": True, "c": True, "d": False, "e": False, "f": True, "g": False, "h": True}


def test_identities(spark):
    from papyra.operators.papers import arxiv_id, arxiv_year, failure_of, front_arxiv_id, titles_conflict

    r = one(
        spark, a=arxiv_id(F.lit("see arXiv: 2101.00001v3 now")), b=arxiv_id(F.lit("hep-th/9901001v2")), c=arxiv_id(F.lit("none")), d=arxiv_year(F.lit("arxiv:9912.0001")), e=arxiv_year(F.lit("arxiv:2113.00001")), f=arxiv_year(F.lit("arxiv:cs/0501001")),
        g=front_arxiv_id(F.lit("2999.00001 text\nhttps://arxiv.org/abs/1501.00002 more\nReferences\narXiv:1601.00003")), h=front_arxiv_id(F.lit("1701.00004 only")),
        i=titles_conflict(F.lit("Deep learning of many kinds"), F.lit("A quantum theory without photons")), j=titles_conflict(F.lit("Deep learning of many kinds"), F.lit("deep  learning, of many kinds")), k=titles_conflict(F.lit("Short"), F.lit("A quantum theory without photons")),
        l=failure_of(F.lit('{"fatal_llm_error": true, "failure_reason": "gone"}')), m=failure_of(F.lit('{"parse_quality": "failed", "calls": []}')), n=failure_of(F.lit("no json")), o=failure_of(F.lit('{"parse_quality": "failed", "calls": [{"parse_quality": "failed"}]}')),
    )
    assert r == {"a": "arxiv:2101.00001", "b": "arxiv:hep-th/9901001", "c": None, "d": 1999, "e": None, "f": 2005, "g": "arxiv:1501.00002", "h": "arxiv:1701.00004", "i": True, "j": False, "k": False, "l": "gone", "m": None, "n": None, "o": "every call failed"}


SENTENCE = re.compile(r"[.!?] ")


def plain_excerpt(text, reference, size=260):
    """best_excerpt() with loops over characters."""
    t, r = " ".join(text.split()), " ".join(reference.split())
    if not t or not r:
        return ""

    def cut(x):
        if len(x) <= size:
            return x
        ends = [m.start() for m in SENTENCE.finditer(x[:size])]
        return x[: ends[-1] + 1].strip() if ends and ends[-1] >= max(80, size // 2) else x[: size - 3].rstrip() + "..."

    def around(at, n):
        half = max(40, (size - n) // 2)
        a, z = max(0, at - half), min(len(t), at + n + half)
        before = [m.start() for m in SENTENCE.finditer(t[a:at])]
        after = [m.start() for m in SENTENCE.finditer(t[z:])]
        a = a + before[-1] + 2 if a and before else a
        z = len(t) if z >= len(t) else z + after[0] + 1 if after else z
        return cut(t[a:z].strip())

    best = None
    for i in range(0, max(len(r) - 120, 1), 80):
        piece = r.lower()[i : i + 120].strip()
        at = t.lower().find(piece)
        if len(piece) >= 30 and at >= 0 and (best is None or len(piece) > best[1]):
            best = (at, len(piece))
    if best:
        exact = t[best[0] : sum(best)].strip()
        return exact if exact[-1:] in set(".!?") else around(*best)
    words = []
    for w in sorted(re.findall(r"[A-Za-z0-9][A-Za-z0-9-]{2,}", r), key=len, reverse=True):
        if w.lower() not in words and w.lower() not in "about also and are for from into that the this used using with".split():
            words.append(w.lower())
    if not words:
        return cut(t)
    scores = [(sum(w in t.lower()[a : a + size] for w in words), -a) for a in range(0, max(len(t) - size, 1), 130)]
    n, a = max(scores)
    return around(-a, min(size, len(t) + a)) if n > 0 else ""


def test_best_excerpt_equals_plain_version(spark):
    import random

    from papyra.operators.verification import best_excerpt

    r = random.Random(3)
    words = "reward policy the emotion agent learns and value of state with action model robot".split()
    text = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", "", ".", "!", ","]) for _ in range(n))
    rows = [("", "x"), ("a b", ""), ("Short text about cats.", "cats"), ("nothing", "the and"), ("A long one. " * 60, "is it")]
    for _ in range(60):
        t = text(r.randint(5, 300))
        at = r.randrange(len(t))
        rows.append((t, r.choice([t[at : at + r.randint(20, 300)], text(r.randint(1, 40)), t[at : at + 60] + " zzz", "Zebra reward"])))
    out = best_excerpt(spark.createDataFrame(rows, "text string, reference string"), "text", "reference").collect()
    for row in out:
        assert row["excerpt"] == plain_excerpt(row["text"], row["reference"]), row


def test_fragments_and_verification(spark):
    from papyra.operators.verification import reference_fragments, verify_answers

    none = None
    schema = "id long, answer_id string, ord int, paper_id string, kind string, text string, title string, abstract string, label string, evidence_span string, statement string, context string, description string, why_applicable string"
    long = "A clause that is long enough to be cut in two parts by what stands between them, which is a colon: and then it goes on for so long that the whole is far beyond the length that a single fragment may have before it is split."
    rows = [
        (1, "a", 1, "p1", "claim", "own text", "The Title", "abstract", "lab", "The Title: it works. It WORKS!", none, long, none, none),
        (2, "a", 2, "p2", "paper", "own text", "T", "An abstract. Of two.", none, none, none, none, none, none),
        (3, "a", 3, "p3", "claim", "own text", "T", "An abstract", "label", none, none, none, none, none),
        (4, "a", 4, "p4", "claim", none, "Only title", none, none, none, none, none, none, none),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: r["fragments"] for r in reference_fragments(df).collect()}
    assert got[1] == ["it works.", "It WORKS!", "A clause that is long enough to be cut in two parts by what stands between them, which is a colon"][:1] + got[1][1:] and len(got[1]) == 3 and got[1][1].startswith("A clause")
    assert got[2] == ["An abstract.", "Of two."] and got[3] == ["own text", "label"] and got[4] == []
    answers = spark.createDataFrame([("a", "It works [p1; p9] and [1].")], "answer_id string, answer string")
    sources = spark.createDataFrame([("a", i, f"p{i}") for i in (1, 2, 3)], "answer_id string, ord int, paper_id string")
    texts = spark.createDataFrame([("p1", "We say: it works. It does."), ("p2", "Nothing in common with that")], "paper_id string, text string")
    out = {r["paper_id"]: r for r in verify_answers(answers, sources, df, texts).collect()}
    assert set(out) == {"p1", "p2", "p3"} and out["p1"]["missing"] == ["p9"] and out["p1"]["cited"] and not out["p2"]["cited"]
    assert out["p1"]["available"] and not out["p3"]["available"] and out["p1"]["n_found"] >= 1 and out["p3"]["n_found"] == 0 and out["p1"]["n_located"] == 3


def test_records_in_sequence_equal_plain_version(spark):
    import random

    from papyra.operators.dedup import dedup_records

    r = random.Random(7)
    rows = [(i, r.choice([None, f"10.1/{r.randrange(25)}", f" HTTPS://doi.org/10.1/{r.randrange(25)}"]), r.choice([None, "", f"Title {r.randrange(30)}", f"title  {r.randrange(30)}!"]), r.choice([None, 1, 2, 3])) for i in range(160)]
    alive = []
    for i, doi, title, version in rows:
        d = re.sub("^https?://doi.org/", "", (doi or "").strip().lower()) or None
        t = re.sub("[^a-z0-9]+", " ", (title or "").lower()).strip() or None
        alive.append((i, d, t, version or 1))
    by, kept = {}, {}
    for row in alive:
        keys = [(n, k) for n, k in (("d", row[1]), ("t", row[2])) if k]
        held = next((by[k] for k in keys if k in by), None)
        if held is not None and row[3] <= held[3]:
            continue
        if held is not None:
            kept.pop(held[0], None)
            keys += [(n, k) for n, k in (("d", held[1]), ("t", held[2])) if k]
        kept[row[0]] = row
        by.update(dict.fromkeys(keys, row))
    df = spark.createDataFrame(rows, "ord long, doi string, title string, version int")
    assert sorted(x["ord"] for x in dedup_records(df).collect()) == sorted(kept)


def test_alike_methods_and_embeddings(spark):
    import numpy as np

    from papyra.operators.dedup import dedup_methods, embedded, hash_embedding

    rows = [("p", 1, "Reward shaping", "a", "d"), ("p", 2, "reward shapings", "a", "longer text"), ("p", 3, "Reward shapings", "b", None), ("p", 4, "SARSA", None, None), ("q", 1, "Reward shaping", None, ""), ("q", 2, " ", None, None)]
    assert SequenceMatcher(None, "reward shaping", "reward shapings").ratio() > 0.9
    out = dedup_methods(spark.createDataFrame(rows, "paper_id string, ord long, label string, source_type string, description string")).collect()
    got = sorted((r["paper_id"], r["ord"], r["label"], r["description"], r["merged"]) for r in out)
    assert [g[:3] + g[4:] for g in got] == [("p", 2, "reward shapings", 3), ("p", 4, "SARSA", 1), ("q", 1, "Reward shaping", 1)] and got[0][3] == "longer text"
    labels = ["Deep Q learning", "deep deep", "", None, "漢", "a-b"]
    v = embedded(labels, 64)
    for label, row in zip(labels, v, strict=True):
        words = re.findall("[a-z0-9]+", (label or "").lower()) or [(label or "").lower().strip() or "<empty>"]
        want = np.zeros(64)
        for w in words:
            d = hashlib.blake2b(w.encode(), digest_size=16).digest()
            for k in range(0, 16, 2):
                want[(d[k] * 256 + d[k + 1]) % 64] += (1 if d[k] % 2 == 0 else -1) / len(words)
        assert np.allclose(row, want / (np.linalg.norm(want) or 1), atol=1e-6)
    same = spark.createDataFrame([(x,) for x in labels], "l string").select(hash_embedding(F.col("l"), 64).alias("v")).collect()
    assert np.allclose([r["v"] for r in same], v)


def test_benchmark_edges(spark):
    from papyra.operators.benchmarks import answers_summary, benchmark_summary, case_reports, evaluated_answers, with_predictions

    item = "case_id string, kind string, ord int, label string, canonical_id string, canonical_label string, entity_type string, source_type string, review_status string, subject string, relation_type string, object string"
    none = (None,) * 8
    gold = spark.createDataFrame([("a", "concepts", 1, "Deep-Q", None, None, "T", None, None, None, None, None), ("a", "relations", 1, None, None, None, None, None, None, "X", "uses", "Y")], item)
    found = spark.createDataFrame([("a", "concepts", 1, "deep q", "c1", None, "U", None, "pending", None, None, None), ("a", "concepts", 2, "Deep Q net", "c1", None, "T", None, "approved", None, None, None), ("a", "relations", 1, None, None, None, None, None, None, "x", "USES", "y"), ("a", "relations", 2, *none[:6], "x", None, "y")], item)
    claims = spark.createDataFrame([("a", "gold", 1, "It is.", "true", None), ("a", "found", 1, "it is", "no", "someone")], "case_id string, side string, ord int, statement string, negated string, attributed_to string")
    cases = spark.createDataFrame([("a", []), ("b", ["w"])], "case_id string, parser_warnings array<string>")
    reports = case_reports(cases, gold, found, claims)
    r = {x["case_id"]: x for x in reports.collect()}
    a, b = r["a"], r["b"]
    assert (a["concepts_precision"], a["concepts_recall"], a["relations_f1"], a["duplicate_canonical_rate"], a["pending_rate"]) == (0.5, 1.0, 1.0, 1.0, 0.5)
    assert (a["entity_type_accuracy"], a["claim_negation_accuracy"], a["claim_negation_error_count"], a["claim_attribution_error_count"]) == (0.0, 0.0, 1, 1)
    assert (b["claim_negation_accuracy"], b["parser_warning_count"], b["concepts_precision"]) == (1.0, 1, 0.0)
    s = benchmark_summary(reports).first()
    assert (s["case_count"], s["concept_precision"], s["passes_claim_gate"], s["passes_parser_gate"], s["passes_duplicate_gate"]) == (2, 0.25, False, False, False)
    empty = benchmark_summary(reports.limit(0)).first()
    assert (empty["case_count"], empty["passes_precision_gate"], empty["passes_duplicate_gate"], empty["passes_parser_gate"], empty["passes_claim_gate"], empty["claim_negation_accuracy"]) == (0, False, True, True, True, 1.0)
    cases = spark.createDataFrame([(1, ["p1"], ["Graders|x", "multi-agent"], ["bad"]), (2, [], [], []), (3, ["p7"], ["zz"], ["un-safe"])], "id int, expected_sources array<string>, required_terms array<string>, forbidden_terms array<string>")
    answers = spark.createDataFrame([(1, "A grade by multiagents [p1].", [], None, False), (3, "It is un safe [3, q].", ["p2"], "late", None)], "id int, answer string, sources array<string>, generation_error string, no_answer boolean")
    e = evaluated_answers(cases, answers)
    got = {x["id"]: (x["score"], x["passes"]) for x in e.collect()}
    assert got == {1: (1.0, True), 2: (1.0, True), 3: (0.0, False)}
    t = answers_summary(e).first()
    assert (t["pass_count"], t["invalid_citation_cases"], t["missing_source_cases"], t["forbidden_hit_cases"], t["generation_error_cases"]) == (2, [3], [3], [3], [3])
    p = with_predictions(spark.createDataFrame([("a", "g1.json"), ("b", "g2.json"), ("c", "g3.json")], "paper_id string, source_file string"), spark.createDataFrame([("a.json", "A"), ("g1.json", "B"), ("g2.json", "C")], "file_name string, prediction string"))
    assert {x["paper_id"]: x["prediction"] for x in p.collect()} == {"a": "A", "b": "C", "c": None}


def test_sources(spark, tmp_path):
    from papyra.sources.api import ApiReader, asked_wait
    from papyra.sources.tables import json_or_raw, pdf_texts, vocabulary

    with pytest.raises(ValueError, match="pages"):
        ApiReader({"url": "u", "pages": "101"})
    assert len(ApiReader({"url": "u", "pages": "100"}).partitions()) == 100
    assert asked_wait("7", 1) == 7 and asked_wait(None, 3) == 3 and asked_wait("soon", 4) == 4
    assert asked_wait("Fri, 27 Nov 2026 12:00:10 GMT", 1, now=1795780800.0) == 10.0
    r = one(spark, a=json_or_raw(F.lit('{"k": 1}'), "struct<k:int>"), b=json_or_raw(F.lit("{k"), "struct<k:int>"))
    assert r["a"]["parsed"]["k"] == 1 and r["a"]["raw"] is None and r["b"]["parsed"] is None and r["b"]["raw"] == "{k"
    (tmp_path / "v.json").write_text('{"concepts": [{"id": "c1", "label": "Reward", "type": "Metric", "aliases": ["R"]}, {"note": 1}], "version": 2}')
    assert [(x["canonical_id"], x["alias"]) for x in vocabulary(spark, str(tmp_path / "v.json")).orderBy("alias").collect()] == [("c1", "R"), ("c1", "Reward")]
    (tmp_path / "a.pdf").write_bytes(b"plain text that stands in for a page " * 5)
    (tmp_path / "b.pdf").write_bytes(b"short")
    got = {x["path"].rsplit("/", 1)[1]: x["text"] for x in pdf_texts(spark, str(tmp_path)).collect()}
    assert got["a.pdf"].startswith("plain text") and got["b.pdf"] is None


def test_scan_and_acronyms(spark):
    from papyra.operators.scan import PATTERNS, acronym_pairs, body_of, context_for, scan_patterns

    text = "First words. We use Deep Reinforcement Learning (DRL) in a robot. Then more follows here."
    r = one(spark, a=acronym_pairs(F.lit(text + " The Journal of Kinds (JK) and Deep nets (XY).")), c=context_for(F.lit(text), F.lit(13), F.lit(15)))
    assert [(x["long"], x["short"]) for x in r["a"]] == [("Deep Reinforcement Learning", "DRL")]
    assert r["c"] == "We use Deep Reinforcement Learning (DRL) in a robot."
    docs = spark.createDataFrame([(1, text + "\nReferences\nSARSA"), (2, "sarsa and robots"), (3, None)], "doc_id long, text string").select("doc_id", body_of(F.col("text")).alias("body"))
    patterns = spark.createDataFrame([(0, "concept", "SARSA", r"\bSARSA\b", None, 0.7), (1, "concept", "Robot", r"\brobots?\b", "deep", 0.7)], PATTERNS)
    found = scan_patterns(docs.withColumn("gate_deep", F.contains(F.lower("body"), F.lit("deep"))), patterns)
    assert sorted((x["doc_id"], x["label"]) for x in found.collect()) == [(1, "Robot"), (2, "SARSA")]


def test_keys_of_methods_are_worked_out_once(spark):
    """A key's steps are columns: the plan has each of its few replacements once, not once for each look at the key."""
    from papyra.operators import entities

    schema = "paper_id int, ord int, label string, canonical_label string, aliases array<string>, description string, evidence_span string, context string, confidence double, review_status string"
    rows = [(1, i, x, None, None, None, None, None, 0.5, "pending") for i, x in enumerate(["Doe and Roe (1999)", "Doe and Roe", "Doe et al. emotion model", "Kind-1", "  -", None])]
    out = entities.merged_methods(spark.createDataFrame(rows, schema))
    assert {r["key"] for r in out.collect()} == {"author:doeandroe", "doeandroe", "author:doeetal", "kind1"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 10


def test_terms_are_found_by_their_stems(spark):
    from random import Random

    from papyra.operators.benchmarks import ONE_WORD, evaluated_answers, forms

    def flat(x):
        return re.sub("[ \t\r\n]+", " ", re.sub("[-_/]+", " ", x.lower())).strip(" ")

    def soft(w):
        for key, words in ONE_WORD.items():
            if w in words:
                return key
        if w.endswith("ies") and len(w) > 4:
            return w[:-3] + "y"
        return w[:-1] if w.endswith("s") and len(w) > 3 else w

    def present(term, text):
        own, found = {soft(w) for w in re.findall("[a-z0-9]+", text)}, []
        for o in filter(None, map(flat, term.split("|"))):
            need = {soft(w) for w in re.findall("[a-z0-9]+", o)}
            found.append(o in text or o.replace(" ", "") in text.replace(" ", "") or bool(need) and need <= own)
        return any(found)

    r = Random(7)
    words = [*(w for ws in ONE_WORD.values() for w in ws), *"grades rat ratios generate only onlies onlys anea aneas ands q qs s ss y ies yies ties tie ty é Éa été a1 1s 2ies x.y xx".split()]
    said = lambda n: "".join(r.choice(words) + r.choice([" ", " ", "  ", "-", "_/", "\n", ". ", " - ", "é", " "]) for _ in range(n))
    rows = [(i, said(r.randint(0, 6)), [r.choice(["", " ", "|"]).join(["", said(r.randint(1, 2)).strip(), said(1)]) for _ in range(12)] + ["", "|", "é"]) for i in range(300)]
    cases = spark.createDataFrame([(i, [], t, ["rat", "a-1"]) for i, _, t in rows], "id int, expected_sources array<string>, required_terms array<string>, forbidden_terms array<string>")
    answers = spark.createDataFrame([(i, x, [], None, False) for i, x, _ in rows], "id int, answer string, sources array<string>, generation_error string, no_answer boolean")
    e = evaluated_answers(cases, answers)
    got = {x["id"]: (x["missing_terms"], x["forbidden_hits"]) for x in e.collect()}
    want = {i: ([t for t in ts if not present(t, flat(x))], [t for t in ("rat", "a-1") if flat(t) in flat(x)]) for i, x, ts in rows}
    assert got == want and 500 < sum(len(m) for m, _ in want.values()) < 4000
    stems = sorted({soft(w) for w in words if re.fullmatch("[a-z0-9]+", w)})
    made = spark.createDataFrame([(s,) for s in stems], "s string").select("s", forms(F.col("s")).alias("f")).collect()
    assert all({soft(w) for w in x["f"]} <= {x["s"]} and {w for w in words if soft(w) == x["s"]} <= set(x["f"]) for x in made)
    # The words of a text are not made for each option of a term, and what options are compared with is worked out before they are.
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "_t#" in plan and not re.search(r"regexp_extract_all\(_t#", plan)
    assert re.search(r"transform\(array\(replace\(_t#\d+,  , \)\)", plan) and len(re.findall(r"replace\(_t#", plan)) == 1
