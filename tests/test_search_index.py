"""The stored index against texts read one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = "graph transformer deep-learning model_zoo protein fold ant ants giant of the a x robot clinic clinical support".split()


def corpus(n=120):
    r = random.Random(4)
    docs = [(k, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 14)))) for k in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "graph transformer"), (n + 3, "giant robot supporter"), (n + 4, "protein " * 500 + "fold")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    from papyra.operators.retrieval import lexical_index

    docs = spark.createDataFrame(corpus(), "doc_id int, text string").withColumn("token", F.lit("clash")).repartition(5)
    return lexical_index(docs, str(tmp_path_factory.mktemp("index") / "docs"), buckets=4)


def plain_fields(query):
    """doc -> (tokens of the query, phrase), from whole texts."""
    from papyra.functions.text import plain_tokens, query_tokens
    from papyra.operators.search_index import token_list

    q, phrase = query_tokens(query), " ".join(plain_tokens(query))
    out = {}
    for k, t in corpus():
        own = token_list(t)
        if set(own) & set(q):
            out[k] = (sorted(set(own) & set(q)), bool(phrase) and phrase in " ".join(own))
    return out


@pytest.mark.parametrize("query", ["graph", "ant", "graph transformer", "ant robot support", "the of a", "", "clinic", "deep-learning zoo", "protein of fold", "nowhere graph", "Model_Zoo model"])
def test_fields_equal_whole_texts(index, query):
    got = {r["unit"]: (r["own"], r["phrase"]) for r in index.fields(query).collect()}
    assert got == plain_fields(query)


def test_tokens_are_those_of_the_column_function(spark):
    from papyra.functions.text import tokens
    from papyra.operators.search_index import token_list

    texts = [t for _, t in corpus()] + ["A-b_c a--b _x y- é-a K2 Kelvin İx", "a-1_2-a 1-1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("k")).collect()
    assert [r["k"] or [] for r in rows] == [token_list(r["t"]) for r in rows]


def test_frequencies_and_weights(index, spark):
    from papyra.operators.retrieval import document_frequency
    from papyra.operators.search_index import token_list

    df = {}
    for _, t in corpus():
        for w in token_list(t):
            df[w] = df.get(w, 0) + 1
    assert {r["token"]: r["df"] for r in index.terms.collect()} == df and index.n == len(corpus())
    docs = spark.createDataFrame(corpus(), "doc_id int, text string").repartition(3)
    got = {r["token"]: (r["df"], round(r["idf"], 9)) for r in document_frequency(docs, F.col("text")).collect()}
    assert got == {r["token"]: (r["df"], round(r["idf"], 9)) for r in index.document_frequency().collect()}
    assert index.idf(["graph", "nowhere"])["nowhere"] > index.idf(["graph"])["graph"]


def test_only_folders_of_the_words_are_read(index):
    rows = index.pruned(index.postings, ["graph"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket") or "PartitionFilters: [isnotnull(bucket" in plan
    assert "PushedFilters" in plan and "token" in plan.split("PushedFilters")[1].split("]")[0]
    assert rows.select("bucket").distinct().count() == 1
    assert index.pruned(index.postings, []).count() == 0


def test_search_over_papers_and_items(spark, tmp_path):
    from papyra.operators import search, search_index

    papers = spark.createDataFrame([("p1", "Graph transformer for proteins", "We fold proteins.", None), ("p2", "Robots", "A graph of robots", "10.1/x"), ("p3", None, None, None)], "paper_id string, title string, abstract string, doi string")
    items = spark.createDataFrame([("p1", "method", 0, "graph transformer"), ("p1", "claim", 0, "a graph transformer folds"), ("raw9", "concept", 0, "Concept drift"), ("p2", "concept", 1, None)], "paper_id string, kind string, ord int, text string")
    units = search.search_units(papers, items)
    index = search_index.build(units, str(tmp_path / "kg"))
    assert index.n == 4
    found = search.evidence(index, "graph transformer")
    kinds = {(r["paper_id"], r["kind"]) for r in found.collect()}
    assert kinds == {("p1", "paper"), ("p1", "method"), ("p1", "claim"), ("p2", "paper")}
    text = {(r["paper_id"], r["kind"]): r["text"] for r in search.with_snippets(found, units, "graph transformer").collect()}
    assert text["p2", "paper"] == "Robots A graph of robots"
    assert [r["paper_id"] for r in search.search(index, "graph transformer").orderBy("rank").collect()] == ["p1", "p2"]
    resolved = spark.createDataFrame([("raw9", "p3")], "raw_id string, paper_id string")
    assert [r["paper_id"] for r in search.search(index, "concept drift", resolved=resolved).collect()] == ["p3"]
    assert search.search(index, "the of").count() == 0


def test_common_words_alone_do_not_match_a_telling_query(spark, tmp_path):
    from papyra.operators.retrieval import lexical_hits, lexical_index

    docs = spark.createDataFrame([(1, "Clinical AI decision support"), (2, "Robot AI planning")], "doc_id int, text string")
    index = lexical_index(docs, str(tmp_path / "two"))
    assert [r["id"] for r in lexical_hits(index, "AI clinics").collect()] == [1]
    assert sorted(r["id"] for r in lexical_hits(index, "AI").collect()) == [1, 2]


def test_small_is_a_matter_of_bytes(spark):
    from papyra.operators.linking import SMALL_BYTES, size_of, small

    few = spark.range(3).select(F.repeat(F.lit("x"), SMALL_BYTES // 2).alias("s"))
    assert size_of(few) > SMALL_BYTES and "ResolvedHint" not in small(few)._jdf.queryExecution().analyzed().toString()
    many = spark.range(100_000)
    assert size_of(many) < SMALL_BYTES and "ResolvedHint" in small(many)._jdf.queryExecution().analyzed().toString()
    odd = spark.createDataFrame([(None, [["a", None]], {"k": 1.0}, (1, "x"))], "a string, b array<array<string>>, c map<string,double>, d struct<e:int,f:string>")
    assert 0 < size_of(odd) < 300 and size_of(odd.limit(0)) == 0


def test_queries_meet_vectors_in_blocks(spark, monkeypatch):
    from papyra.operators import linking
    from papyra.operators.retrieval import vector_topk

    r = random.Random(2)
    rows = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)], "id int, v array<double>")
    one = sorted(map(tuple, vector_topk(rows, rows.filter("id < 20"), k=3).select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(linking, "SMALL_BYTES", 500)
    blocks = linking.in_blocks(rows.filter("id < 20"), "id")
    assert len(blocks) > 2 and sum(b.count() for b in blocks) == 20
    many = vector_topk(rows, rows.filter("id < 20"), k=3)
    assert sorted(map(tuple, many.select("query_id", "rank", "id").collect())) == one


def test_vectors_are_scored_in_blocks_with_exact_ties(spark, monkeypatch):
    import math
    from functools import reduce

    from papyra.operators import linking
    from papyra.operators.retrieval import vector_topk

    r = random.Random(5)
    base = [[r.uniform(-1, 1) for _ in range(7)] for _ in range(30)]
    rows = [(f"v{i:03d}", i % 2, base[i % 30]) for i in range(90)] + [("none", 0, None), ("zero", 0, [0.0] * 7), ("hole", 0, [None] + [1.0] * 6), ("long", 0, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id string, type int, v array<float>")
    stored = [(x["id"], x["type"], x["v"]) for x in df.collect()]
    dot = lambda a, b: reduce(lambda s, p: s + p[0] * p[1], zip(a, b), 0.0)
    cos = lambda a, b: dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))
    ok = [x for x in stored if x[2] and None not in x[2] and any(x[2])]

    def want(of, among, k, least, typed):
        out = set()
        for i, t, v in of:
            found = sorted((-cos(v, w), j) for j, u, w in among if j != i and len(v) == len(w) and (not typed or t == u))
            out |= {(i, n, j, -s) for n, (s, j) in enumerate([f for f in found if -f[0] >= least][:k], 1)}
        return out

    few = df.filter("id like 'v0%'")
    of = [x for x in ok if x[0].startswith("v0")]
    for size in (300, 4 << 20):
        monkeypatch.setattr(linking, "BLOCK_BYTES", size)
        found = vector_topk(df.select("id", "v"), few.select("id", "v"), k=4, least=0.2)
        assert {tuple(x) for x in found.select("query_id", "rank", "id", "score").collect()} == want(of, ok, 4, 0.2, False)
        seeds = linking.compatible_topk(df, few, k=3, least=0.1)
        assert {tuple(x)[:3] for x in seeds.collect()} == {x[:3] for x in want(ok, of, 3, 0.1, True)}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_of_the_index_is_what_a_batch_says_of_a_token(spark, tmp_path):
    """Postings are stored as lists, so that a token is shuffled once a batch; frequencies count a key of many units once, null keys as one."""
    from papyra.operators import search_index

    units = [(k if k < 9 else None, f"{k}.{i}", ["shared words", f"own{k} shared"]) for k in range(10) for i in range(20)]
    index = search_index.build(spark.createDataFrame(units, "key int, unit string, fields array<string>").repartition(3), str(tmp_path / "units"), buckets=2)
    stored = spark.read.parquet(str(tmp_path / "units" / "postings"))
    assert stored.filter("token = 'shared'").count() <= spark.sparkContext.defaultParallelism
    assert {r["token"]: r["df"] for r in index.terms.collect()} == {"shared": 10, "words": 10, **{f"own{k}": 1 for k in range(10)}} and index.n == 10
    assert index.postings.filter("token = 'shared'").select("unit", "field", "pos").distinct().count() == 400
