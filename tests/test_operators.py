"""Expectations on small literals."""

from __future__ import annotations

import random
import uuid
from datetime import datetime

import pytest

from pyspark.sql import functions as F


def test_co_citation_counts_the_reference_all_share(spark):
    from papyra.operators.graph import co_citation

    r = random.Random(1)
    refs = {f"p{i}": {"all", *(f"r{r.randrange(12)}" for _ in range(r.randint(0, 5)))} for i in range(30)}
    edges = spark.createDataFrame([(s, d) for s, ds in refs.items() for d in ds] * 2, "src string, dst string")
    got = {(x["src"], x["dst"]): (x["score"], x["shared"]) for x in co_citation(edges).collect()}
    want = {}
    for a, x in refs.items():
        for b, y in refs.items():
            k = len(x & y)
            if a != b and k >= 2 and k / min(len(x), len(y)) >= 0.25:
                want[(a, b)] = (round(k / min(len(x), len(y)), 4), k)
    assert got == want and all(got[(b, a)] == v for (a, b), v in got.items())


def test_stubs_never_hide_papers(spark):
    from papyra.operators.graph import with_stubs

    nodes = spark.createDataFrame([("a", "A", "store", False)], "id string, title string, source string, is_stub boolean")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "src string, dst string")
    assert {(r["id"], r["title"], r["is_stub"]) for r in with_stubs(nodes, edges).collect()} == {("a", "A", False), ("b", None, True)}


def test_citation_ids(spark):
    from papyra.operators.graph import citation_ids

    kind = "array<struct<paperId:string,doi:string,id:string,source_id:string,title:string>>"
    df = spark.createDataFrame([([], [("x", None, None, None, None), (None, " y ", None, None, None), ("", "", "x", None, None), (None, None, None, None, None)])], f"citations {kind}, refs {kind}")
    assert df.select(citation_ids(F.col("citations"), F.col("refs")).alias("i")).first()["i"] == ["x", "y"]


def in_turn(records):
    """The rule of dedup_records(), one record after the other over all records."""
    of, groups, free = {}, {}, set()
    for o, doi, title, version in records:
        doi = (doi or "").strip().lower().removeprefix("https://doi.org/") or None
        title = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (title or "").lower()).split()) or None
        keys = [k for k in (("d", doi), ("t", title)) if k[1]]
        if not keys:
            free.add(o)
            continue
        g = next((of[k] for k in keys if k in of), None)
        if g is None or (version or 1) > groups[g][0]:
            g = o if g is None else g
            groups[g] = (version or 1, o)
            of.update(dict.fromkeys(keys, g))
    return free | {o for _, o in groups.values()}


RECORDS = "ord long, doi string, title string, version int"


def test_dedup_records_equals_the_rule_in_turn(spark):
    from papyra.operators.dedup import dedup_records

    assert in_turn([(0, "10.1/X", "T", 1), (1, "https://doi.org/10.1/x", "other", 2)]) == {1}
    r = random.Random(6)
    for _ in range(3):
        rows = [(i, r.choice([None, "", *(f"10.1/{k}" for k in range(25))]), r.choice([None, "", *(f"Title {k}!" for k in range(25))]), r.choice([None, 1, 2, 3])) for i in range(60)]
        out = dedup_records(spark.createDataFrame(rows, RECORDS))
        assert {x["ord"] for x in out.collect()} == in_turn(rows)
    assert dedup_records(spark.createDataFrame([], RECORDS)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_records_in_rounds(spark, seed):
    """No task sees more than three records at once; a third of them share a DOI, another third a title."""
    from papyra.operators.dedup import dedup_records

    r = random.Random(seed)
    hot = [(r.choice(["10.1/hot", f"10.1/{k}", None, None]), "Untitled" if r.random() < 0.3 else f"Title {r.randrange(150)}", r.choice([None, 1, 1, 2, 3])) for k in range(240)]
    rows = [(i, *x) for i, x in enumerate([("10.1/hot", f"Title {r.randrange(150)}", 1 + r.randrange(2)) for _ in range(120)] + hot)]
    r.shuffle(rows)
    rows = [(i, *x[1:]) for i, x in enumerate(rows)]
    out = dedup_records(spark.createDataFrame(rows, RECORDS), few=3)
    assert {x["ord"] for x in out.collect()} == in_turn(rows)


def test_dedup_moves_keys_of_one_size(spark, monkeypatch):
    """Titles as long as texts, and a title and a DOI that read alike, which don't meet."""
    from papyra.operators import dedup

    rows = [(i, "10.1/same" if i == 5 else None, "10 1 same" if i == 6 else f"{'Long title ' * 3000}{i % 4}", 1) for i in range(12)]
    written, plain = [], dedup.kept
    monkeypatch.setattr(dedup, "kept", lambda df: written.append(plain(df)) or written[-1])
    out = {x["ord"] for x in dedup.dedup_records(spark.createDataFrame(rows, RECORDS), few=3).collect()}
    assert out == in_turn(rows)
    sizes = [df.agg(F.max(F.length(c))).first()[0] for df in written for c in ("d", "t", "key") if c in df.columns]
    assert max(n for n in sizes if n) == 16


def test_fuzzy_methods(spark):
    from papyra.operators.dedup import dedup_methods

    rows = [("p", 1, "Deep Q-Network", "a", ""), ("p", 2, "deep q network", "a", "longer"), ("p", 3, "Deep Q Networks", "b", "x"), ("p", 4, " ", "a", "x"), ("q", 5, "Deep Q-Network", "a", "z")]
    out = dedup_methods(spark.createDataFrame(rows, "paper_id string, ord long, label string, source_type string, description string")).collect()
    assert sorted((r["paper_id"], r["description"], r["merged"]) for r in out) == [("p", "longer", 3), ("q", "z", 1)]


def test_upserts(spark):
    from papyra.operators.merge import best_extraction, fill_missing, item_state, upsert

    old = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], "k int, v string, seq int, made int")
    new = spark.createDataFrame([(2, "c", 5, 9), (2, None, 4, 8), (3, "d", 1, 7)], "k int, v string, seq int, made int")
    assert sorted(map(tuple, upsert(old, new, ["k"], "seq", keep_first=("made",)).collect())) == [(1, "a", 1, 1), (2, "c", 5, 1), (3, "d", 1, 7)]
    filled = fill_missing(old.withColumn("v", F.when(F.col("k") == 1, "").otherwise(F.col("v"))), new.withColumn("k", F.lit(1)).limit(1), "k", ["v"])
    assert sorted((r["k"], r["v"]) for r in filled.collect()) == [(1, "c"), (2, "b")]
    t = lambda h: datetime(2024, 1, 1, h)
    ev = spark.createDataFrame([("j", "processing", t(1), 1), ("j", "failed", t(2), 2), ("j", "processing", t(3), 3), ("j", "completed", t(4), 4)], "p string, status string, ts timestamp, seq int")
    s = item_state(ev, ["p"]).first()
    assert (s["status"], s["started"], s["completed"], s["attempts"]) == ("completed", t(1), t(4), 2)
    ex = spark.createDataFrame([("p", 1, "success", t(1)), ("p", 2, "failed", t(2)), ("q", 3, "failed", t(1)), ("q", 4, "failed", t(2))], "paper_id string, id int, extraction_status string, extraction_timestamp timestamp")
    assert sorted((r["paper_id"], r["id"]) for r in best_extraction(ex).collect()) == [("p", 1), ("q", 4)]


def test_note_restore_toggles(spark):
    from papyra.operators.merge import delete_note, restore_notes, update_notes

    notes = spark.createDataFrame([("n", "one", datetime(2024, 1, 1))], "id string, markdown string, updated_timestamp timestamp")
    versions = spark.createDataFrame([], "note_id string, markdown string, created_timestamp timestamp")
    at = lambda d: F.lit(datetime(2024, 1, d))
    notes, versions = update_notes(notes, spark.createDataFrame([("n", "two")], "id string, markdown string"), versions, at(2))
    assert notes.first()["markdown"] == "two" and versions.first()["markdown"] == "one"
    notes, versions = restore_notes(notes, versions, at(3))
    assert notes.first()["markdown"] == "one"
    notes, versions = restore_notes(notes, versions, at(4))
    assert notes.first()["markdown"] == "two" and versions.count() == 3
    left = delete_note({"notes": notes, "note_ai_threads": spark.createDataFrame([("t", "n")], "id string, note_id string"), "note_ai_messages": spark.createDataFrame([("m", "t"), ("o", "u")], "id string, thread_id string")}, notes.select("id"))
    assert left["notes"].count() == 0 and [r["id"] for r in left["note_ai_messages"].collect()] == ["o"]


def test_tokens_and_scores(spark):
    from papyra.functions.text import query_tokens, snippet, tokens
    from papyra.operators.retrieval import cover_first, lexical_score

    df = spark.createDataFrame([("The deep-learning model_zoo of papers, x deep",)], "t string")
    assert df.select(tokens(F.col("t")).alias("k")).first()["k"] == ["deep-learning", "deep", "learning", "model-zoo", "model", "zoo"]
    assert query_tokens("Doctor of the deep-Q") == ["doctor", "clinical", "clinician", "physician", "deep-q", "deep"]
    own = F.array(*map(F.lit, ["reward", "shaping", "model"]))
    score = lambda q: spark.range(1).select(lexical_score(own, q, {}, 2.0).alias("s")).first()["s"]
    assert score(["reward", "model"]) == 2.5 and score(["model", "other"]) == 0.0 and score(["model"]) == 0.5 + 4.0 and score(["reward", "shaping"]) == 4.0 + 4.0
    long = "x " * 300 + "needle " + "y " * 300
    s = spark.createDataFrame([(long,)], "t string").select(snippet(F.col("t"), ["needle"]).alias("s")).first()["s"]
    assert "needle" in s and s.startswith("...") and s.endswith("...") and len(s) <= 366
    hits = spark.createDataFrame([(1, 9.0, ["aa"]), (2, 8.0, ["aa"]), (3, 1.0, ["bb", "cc"]), (4, 2.0, ["dd"])], "id int, score double, own array<string>")
    assert [r["id"] for r in cover_first(hits, ["aa", "bb", "cc", "dd"]).orderBy("rank").collect()] == [3, 1, 4, 2]


def test_identifiers(spark):
    from papyra.functions.scalars import normal_doi, obsolescence, ratio, stable_id, uuid5
    from papyra.functions.text import title_fingerprint

    row = spark.range(1).select(
        uuid5(F.lit("a|b")).alias("u"), normal_doi(F.lit(" HTTPS://doi.org/10.1/X ")).alias("d"), stable_id("c", F.lit("Deep  Q!")).alias("s"), stable_id("c", F.lit("漢")).alias("h"),
        obsolescence(F.lit(2016), F.lit(99), 2026).alias("o"), obsolescence(F.lit(2016), F.lit(0), 2026).alias("o0"), obsolescence(F.lit(None).cast("int"), F.lit(0), 2026).alias("on"), ratio(F.lit(1), F.lit(0)).alias("r"),
        (title_fingerprint(F.lit("Émile, A  b")) == title_fingerprint(F.lit("emile a B"))).alias("t"),
    ).first()
    assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "a|b")) and row["d"] == "10.1/x" and row["s"] == "c:deep-q" and len(row["h"]) == 18
    assert row["o"] < row["o0"] and row["on"] == 0.5 and row["r"] == 0.0 and row["t"]


def test_reports(spark):
    from papyra.operators.quality import prf, term_found, worst_parse

    e = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c")], "paper string, label string")
    p = spark.createDataFrame([("p", "a"), ("p", "x"), ("p", "a")], "paper string, label string")
    got = {r["paper"]: (r["precision"], r["recall"], r["f1"]) for r in prf(e, p, ["label"], ["paper"]).collect()}
    assert got == {"p": (0.5, 0.5, 0.5), "q": (0.0, 0.0, 0.0)}
    assert spark.range(1).select(term_found(F.lit("Q-learning works"), ["q learning", "zzz"]).alias("t")).first()["t"]
    w = worst_parse(spark.createDataFrame([("a", "failed"), ("a", "clean"), ("b", "skipped"), ("c", "failed")], "k string, q string"), "k", "q")
    assert dict(map(tuple, w.collect())) == {"a": "partial", "b": "skipped", "c": "failed"}


def test_answers(spark):
    from papyra.operators.answers import cited_or_all, evidence_for_answer, excerpts

    ev = spark.createDataFrame([(1, 0, "p", "claim", "t 1", 1.0), (2, 0, "q", "paper", "u", 4.0), (5, 0, "r", "other", "clinical", 2.0)], "hit_rank int, ord long, paper_id string, kind string, text string, score double")
    assert [(r["paper_id"], r["answer_score"]) for r in evidence_for_answer(ev).collect()] == [("p", 6.0), ("q", 4.25), ("r", 3.5)]
    items = spark.createDataFrame([("p", "claim", 0, "t 1"), ("q", "relation", 1, "a uses b 2"), ("r", "claim", 0, "beyond the first three"), ("q", "method", 2, " ")], "paper_id string, kind string, ord long, text string")
    more = evidence_for_answer(ev, items, hits=3)
    assert [(r["paper_id"], r["kind"], r["answer_score"]) for r in more.collect()][:2] == [("q", "relation", 10.5), ("p", "claim", 6.0)] and more.count() == 4
    one = spark.createDataFrame([("q",)], "paper_id string")
    assert cited_or_all(ev, one).count() == 1 and cited_or_all(ev, one.withColumn("paper_id", F.lit("z"))).count() == 3
    needles = spark.createDataFrame([("a", "lorem ipsum dolor sit amet consectetur"), ("b", "ab"), ("c", "x" * 40)], "needle_id string, text string")
    texts = spark.createDataFrame([(1, "so: lorem ipsum dolor sit amet consectetur!"), (2, "y" + "x" * 50), (3, "lorem")], "doc_id long, text string")
    assert sorted((r["needle_id"], r["doc_id"], r["position"]) for r in excerpts(needles, texts).collect()) == [("a", 1, 5), ("c", 2, 2)]
    # a needle whose middle is quoted, and one whose end is
    words = [f"word{i}" for i in range(80)]
    long = spark.createDataFrame([("n", " ".join(words))], "needle_id string, text string")
    quotes = spark.createDataFrame([(1, "x " + " ".join(words[20:60]).upper() + " y"), (2, " ".join(words[45:])), (3, "none of these " * 9)], "doc_id long, text string")
    assert {r["doc_id"]: r["length"] for r in excerpts(long, quotes).collect()} == {1: 120, 2: 120}


def test_linking(spark):
    from papyra.operators.linking import align_relations, kg_layer

    rel = spark.createDataFrame([("p", "a", "USES", "b", "approved", "llm_relation", 0.9), ("p", "a", "USES", "z", "approved", "llm_relation", 0.9)], "paper_id string, subject_id string, relation_type string, object_id string, review_status string, source string, confidence double")
    out = {r["object_id"]: (r["review_status"], r["confidence"]) for r in align_relations(rel, spark.createDataFrame([("p", "a"), ("p", "b")], "paper_id string, canonical_id string")).collect()}
    assert out == {"b": ("approved", 0.9), "z": ("pending", 0.65)}
    ents = spark.createDataFrame([("Reward", "approved", "background", "passing"), ("Core", "approved", "background", "passing"), ("x", "pending", "", "")], "label string, review_status string, source_type string, salience string")
    assert {r["label"]: r["kg_layer"] for r in kg_layer(ents, core=["core"]).collect()} == {"Reward": "detail", "Core": "core", "x": "detail"}


def test_streams(spark, tmp_path):
    from papyra.streaming.events import run_available, upsert_sink, windowed_counts

    rows = [(i, datetime(2024, 1, 1 + i % 9, 1), i % 3, "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run_available(windowed_counts(stream), f"{tmp_path}/out", f"{tmp_path}/c")
    got = {(r["window_start"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["window_start"], r["n"]) for r in windowed_counts(df).collect()}
    assert got and got <= want
    q = stream.writeStream.foreachBatch(upsert_sink(f"{tmp_path}/state", ["user_id"], "event_id")).option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["user_id"], r["event_id"]) for r in spark.read.parquet(f"{tmp_path}/state/v0").collect()) == [(0, 57), (1, 58), (2, 59)]


def test_paper_kind_reads_whole_windows(spark):
    from papyra.operators.extraction import detected_type, detected_year

    pad = "lorem ipsum " * 300
    rows = [(0, "Some plain title\n" + pad + " this survey covers 1931 and May 4, 2019."), (1, "arXiv 1999\nA Benchmark of Things\n" + pad), (2, "A title here\nSurvey data on a dataset, 2001 and 2010"), (3, "A title here\n" + pad * 4 + "this survey, 2001"), (4, None)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", detected_type(F.col("t")).alias("k"), detected_year(F.col("t"), 2026).alias("y")).orderBy("i").collect()
    assert [(r["k"], r["y"]) for r in got] == [("survey", 2019), ("benchmark", 1999), ("research", 2001), ("research", None), ("research", None)]


def test_pairs_of_sources_are_made_where_they_are_counted(spark, monkeypatch):
    from collections import defaultdict
    from itertools import combinations

    from papyra.operators import graph

    rows = [(s, 1000 + (s * k * k + k) % 23) for s in range(40) for k in range(1 + s % 6)] + [(s, 999) for s in range(3, 40)] + [(7, None), (None, 7)]
    refs = defaultdict(set)
    for s, d in rows:
        if s is not None and d is not None:
            refs[s].add(d)
    shared = {(a, b): len(refs[a] & refs[b]) for a, b in combinations(sorted(refs), 2)}
    overlap = {(a, b): n for (a, b), n in shared.items() if n >= 2 and n / min(len(refs[a]), len(refs[b])) >= 0.25}
    alike = {(a, b): n for (a, b), n in shared.items() if n and n / len(refs[a] | refs[b]) >= 0.3}
    edges = spark.createDataFrame(rows, "src long, dst long")
    for chunk, hot in ((3, 5), (512, 1_000)):
        monkeypatch.setattr(graph, "CHUNK", chunk)
        monkeypatch.setattr(graph, "HOT", hot)
        got = {(r["src"], r["dst"]): r["shared"] for r in graph.co_citation(edges).collect()}
        assert got == overlap | {(b, a): n for (a, b), n in overlap.items()}
        assert {(r["src"], r["dst"]): r["shared"] for r in graph.jaccard_pairs(edges, min_score=0.3).collect()} == alike
    for pairs in (graph.co_citation(edges), graph.jaccard_pairs(edges)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "later" in plan and "hashpartitioning(l#" not in plan.split("Generate explode(later")[0].split("HashAggregate")[-1]


def test_embedded_labels_and_their_squares(spark):
    import numpy as np

    from papyra.functions.scalars import dot, square
    from papyra.operators.dedup import embedded, hash_embedding

    names = ["Blue part", None, "", "blue PART", "--", "one two three two", "Blue part"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, s string").select("k", hash_embedding(F.col("s"), 64).alias("v"))
    rows = df.select("k", "v", square(F.col("v")).alias("a"), dot(F.col("v"), F.col("v")).alias("b")).orderBy("k").collect()
    assert np.array_equal(np.array([r["v"] for r in rows], np.float32), embedded(names, 64))
    assert all(r["a"] == r["b"] and abs(r["a"] - 1) < 1e-6 for r in rows)


def test_a_build_plans_what_is_asked_for(spark, monkeypatch):
    """Edges of likeness aren't worked out for a caller who reads mentions, and entities are found once for all tables."""
    from papyra.operators import graph_build
    from papyra.plans import graph_build_queries

    def never(*a, **k):
        raise AssertionError("not asked for")

    found = []
    real = graph_build.graph_entities
    monkeypatch.setattr(graph_build, "co_citation", never)
    monkeypatch.setattr(graph_build, "graph_entities", lambda *a: found.append(1) or real(*a))
    g = graph_build_queries._graph(spark, "/root/testdata/sf0.001")
    assert g.mentions.count() > 0 and g.concepts.count() > 0 and g.related.columns[0] == "src"
    assert len(found) == 1


def test_texts_are_counted_in_pieces_of_one_size(spark):
    from papyra.shared import in_pieces

    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(400)] + [(-1, None)], "doc_id long, text string").coalesce(1)
    out = in_pieces(docs, size=10_000)
    sizes = [sum(len(r["text"] or "") for r in p) for p in out.rdd.glom().collect()]
    assert sum(sizes) == 400_000 and max(sizes) <= 30_000 and out.count() == 401
    assert in_pieces(docs).rdd.getNumPartitions() == 1
    assert in_pieces(docs.limit(0)).count() == 0
