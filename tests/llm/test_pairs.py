"""Operators 4, 5, 9 and 10 against plain versions on small rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

WORDS = [a + b for a in ("lor", "ip", "dol", "sit", "am", "con", "sec", "ad", "eli", "sed") for b in ("em", "sum", "or", "et", "ur", "is", "o", "ta")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS) + "x"
    return " ".join(w)


def near_corpus():
    r = random.Random(3)
    texts = [None, "", "", "one two", "One  two", "one two three", prose(r, 2000)]
    for size, group, edits in ((100, 12, 2), (200, 30, 5), (60, 5, 1), (150, 40, 9)):
        base = prose(r, size)
        texts += [base] * 3 + [edited(r, base, r.randint(0, edits)) for _ in range(group)]
        chain = base
        for _ in range(6):
            chain = edited(r, chain, 2)
            texts.append(chain)
    return [(i, t) for i, t in enumerate(texts + [prose(r, 80) for _ in range(40)])]


def shingles(text):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_classes(docs, threshold=0.8):
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t) for i, t in docs}
    for k, (i, t) in enumerate(docs):
        for j, u in docs[:k]:
            both = sum((sets[i] & sets[j]).values())
            all_ = sum((sets[i] | sets[j]).values())
            if (t or "") == (u or "") or (all_ and both >= threshold * all_):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in docs}


def test_near_duplicates_equal_brute_force(spark):
    from papyra.llm.near_dup import near_duplicates

    docs = near_corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, class_id string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == plain_classes(docs)


def test_near_duplicates_odd_rows(spark):
    from papyra.llm.near_dup import drop_near_duplicates, near_duplicates

    schema = "doc_id long, text string, n long"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3), (None, "a b c d e f", 4), (None, None, 5)], schema)
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in near_duplicates(df).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1)]
    kept = drop_near_duplicates(df).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 0, 1]


def test_dart_signatures_estimate_weighted_jaccard():
    from papyra.llm.near_dup import elements, mix, signatures, weighted

    rng = np.random.default_rng(1)
    words = mix(np.arange(1, 2000, dtype=np.uint64))
    a, b = words[:1000], np.r_[words[:850], words[1200:1350]]
    e, n = elements(np.r_[a, b].view(np.int64), np.array([len(a), len(b)]))
    sets = [set(e[: n[0]].tolist()), set(e[n[0] :].tolist())]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    h, w, m = weighted(np.r_[a, b].view(np.int64), np.array([len(a), len(b)]))
    sig = signatures(h, w, m, 2048)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    # real weights, small and large, against the sums of minima and maxima
    for scale, unit in ((1.0, 1.0), (0.05, 0.01), (300.0, 8.0)):
        x, y = scale * rng.pareto(1.5, 300) + 0.01 * scale, scale * rng.pareto(1.5, 300) + 0.01 * scale
        y[:200] = x[:200] * rng.choice([1.0, 0.5, 2.0], 200)
        sig = signatures(np.r_[words[:300], words[:300]], np.r_[x, y], np.array([300, 300]), 2048, unit)
        true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 0.05, (scale, true)
    # a text says the same of itself next to others and alone
    assert (signatures(words[:9], np.arange(1.0, 10.0), np.array([9]), 32)[0] == signatures(np.r_[words[50:60], words[:9]], np.r_[np.full(10, 3.3), np.arange(1.0, 10.0)], np.array([10, 9]), 32)[1]).all()
    # repeats are weight: a text twice over isn't the text
    e, n = elements(np.r_[a[:50], a[:50], a[:50]].view(np.int64), np.array([50, 100]))
    assert len(set(e[: n[0]].tolist()) & set(e[n[0] :].tolist())) == 46


def test_prefix_pairs_lose_none(spark):
    from papyra.llm.near_dup import prefix_pairs, verified

    r = random.Random(9)
    sets = []
    for _ in range(8):
        base = set(r.sample(range(10_000), 40))
        sets += [base | set(r.sample(range(10_000), 3)) - set(r.sample(sorted(base), r.randint(0, 5))) for _ in range(6)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "doc_id long, elements array<long>")
    got = {(r["u"], r["v"]) for r in verified(prefix_pairs(df, df.select("doc_id"), 0.8), df, 0.8).collect()}
    assert got == {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_line_dedup_equals_plain_version(spark):
    from papyra.llm.line_dedup import line_dedup

    r = random.Random(2)
    docs = []
    for i in range(120):
        lines = [prose(r, 6) for _ in range(r.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), "  menu about contact ")
        docs.append((i, "\n".join(lines), None if i % 20 == 7 else f"host{i % 2}", "z"))
    docs += [(200, None, "host0", "z"), (201, "", "host0", "z"), (202, "menu about contact", "host0", "z"), (203, "\n\n", "host1", "z")]
    out = line_dedup(spark.createDataFrame(docs, "doc_id long, text string, source string, dl_kept string"))
    assert out.columns == ["doc_id", "text", "source", "dl_kept", "dl_lines", "dl_dropped"]
    pages, held = Counter(), Counter()
    for _, t, h, _ in docs:
        if h is not None:
            pages[h] += 1
            held.update({(h, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    for row in out.collect():
        text, host = next((t, h) for i, t, h, _ in docs if i == row["doc_id"])
        bad = lambda x: x.strip(" ") != "" and held[(host, x.strip(" "))] >= 2 and held[(host, x.strip(" "))] > 0.1 * pages[host]
        kept = [x for x in (text or "").split("\n") if not bad(x)]
        assert row["text"] == ("\n".join(kept) if text is not None else None)
        assert row["dl_dropped"] == len((text or "").split("\n")) - len(kept)
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_pages_of_boilerplate_lose_their_lines(spark):
    from papyra.llm.line_dedup import line_dedup

    docs = [(i, "menu\nabout", "a") for i in range(5)] + [(9, "menu\nown", "a"), (10, "x", "b"), (11, "x", "b"), (12, "menu\n" + "long line\n" * 30_000, "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["dl_dropped"]) for r in line_dedup(df).collect()}
    assert {got[i] for i in range(5)} == {("", 2)} and got[9] == ("own", 1) and got[10] == ("", 1)
    assert got[12] == (docs[-1][1], 0)  # one page says nothing of its host
    spared = {r["doc_id"]: r["text"] for r in line_dedup(df, spare_copies=True).collect()}
    assert spared[0] == "menu\nabout" and spared[9] == "own"


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_contamination(docs, items):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v and i is not None else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_bytes", [8_000_000, 300])
def test_contamination_equals_brute_force(spark, block_bytes):
    from papyra.llm.decontamination import contamination

    r = random.Random(4)
    items = [(k, prose(r, r.choice([3, 9, 10, 11, 30]))) for k in range(12)] + [(90, None), (91, "?!"), (92, "É ÉÉ x9"), (None, "a b c")]
    docs = [(0, None), (1, ""), (2, "... É-ÉÉ; X9 b"), (3, "a b c")]
    for i in range(4, 60):
        w = prose(r, r.randint(5, 80)).split()
        for _ in range(r.randint(0, 2)):
            v = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(v) - 10))
            w[r.randrange(len(w)) : 0] = v[a : a + r.randint(8, 25)]
        docs.append((i, " ".join(w).title() if i % 3 else ", ".join(w)))
    df = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], list(x["items"])) for x in contamination(df, bench, block_bytes=block_bytes).collect()}
    assert got == plain_contamination(docs, items)


def test_contamination_of_empty_tables_and_repeated_rows(spark):
    from papyra.llm.decontamination import contamination, drop_contaminated

    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert contamination(none, bench).count() == 0
    twice = spark.createDataFrame([(1, "x a b c"), (1, "x a b c"), (2, "a b"), (None, "a b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in contamination(twice, bench).collect()) == [(0, 3), (1, 3), (1, 3), (2, 0)]
    assert [r["n_hit"] for r in contamination(twice, none.toDF("item_id", "text")).collect()] == [0] * 4
    assert [r["doc_id"] for r in drop_contaminated(twice, bench).collect()] == [2]
    # by text, not by id: a clean row with a dropped one's id stays; ids may be strings
    mixed = spark.createDataFrame([("x", "q a b c", 1), ("x", "clean", 2), (None, None, 3)], "doc_id string, text string, text_id int")
    left = drop_contaminated(mixed, bench)
    assert left.columns == mixed.columns and sorted(r["text_id"] for r in left.collect()) == [2, 3]
    assert sorted((r["doc_id"] or "", r["n_hit"]) for r in contamination(mixed, bench).collect()) == [("", 0), ("x", 0), ("x", 3)]
    very_long = spark.createDataFrame([(1, "w " * 300_000 + "a b c " + "w " * 300_000)], "doc_id long, text string")
    assert [(r["n_words"], r["n_hit"]) for r in contamination(very_long, bench).collect()] == [(600_003, 3)]


def test_proximity_matches(spark):
    from papyra.llm.decontamination import anchors, blocks, postings, proximity_matches, term_counts

    docs = spark.createDataFrame([(1, "five four three two one"), (2, "one x x x x x x x x x x two")], "doc_id long, text string")
    block = next(blocks(spark.createDataFrame([("i", "one two three four five")], "item_id string, text string")))
    places = anchors(block, term_counts(docs, block))
    found = proximity_matches(postings(docs, block, {p[0] for p in places}), places, share=1.0).collect()
    assert {r["doc_id"] for r in found} == {1}


def test_nearest_neighbours_reach_recall(spark):
    from papyra.llm.ann import nearest

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    v = np.r_[centres[rng.integers(0, 30, 1500)] + 0.2 * rng.normal(size=(1500, 16)), rng.normal(size=(500, 16)), np.tile(centres[0], (300, 1))]
    rows = [(i, [float(x) for x in v[i]]) for i in range(len(v))]
    odd = [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [None] * 16), (9200, [1.0, 2.0]), (9250, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    out = nearest(df, df.filter("vec_id % 50 = 0")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, len(v), 50):
        s = u @ u[q]
        s[q] = -9
        order = np.lexsort((np.arange(len(v)), -s.round(12)))[:5]
        assert [abs(u[i] @ u[q] - x) < 1e-12 for i, x in got[q]] == [True] * 5
        hit += len(set(order.tolist()) & {i for i, _ in got[q]})
        total += 5
    assert set(got) == set(range(0, len(v), 50)) and hit / total >= 0.9


def test_nearest_splits_crowded_leaves_and_keeps_ties(spark):
    """Small leaves by a second tree; a vector that half of all rows share; repeated ids; string ids; other lengths."""
    from papyra.llm.ann import nearest

    rng = np.random.default_rng(5)
    v = np.r_[rng.normal(size=(1200, 8)), np.tile(rng.normal(size=8), (1200, 1))]
    df = spark.createDataFrame([(i, [float(x) for x in r], 1.0) for i, r in enumerate(v)], "vec_id long, embedding array<double>, score double").repartition(5)
    got = {}
    for r in nearest(df, df.filter("vec_id % 50 = 0"), recall=1.0, sample_rows=300, split_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, len(v), 50):
        s = (u @ u[q]).round(12)
        s[q] = -9
        assert len(got[q]) == 5 and (q < 1200 or got[q] == [i for i in range(1200, 1206) if i != q][:5])
        assert len(set(got[q]) & set(np.lexsort((np.arange(len(v)), -s))[:5].tolist())) >= 3
    odd = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 2.0]), ("c", [1.0, 2.0, 3.0]), ("d", [1.0, 2.0, 3.0]), (None, [1.0, 1.0])], "vec_id string, embedding array<double>")
    assert [(r["query_id"], r["vec_id"], round(r["score"], 6)) for r in nearest(odd, odd).orderBy("query_id").collect()] == [("a", "b", 1.0), ("b", "a", 1.0), ("c", "d", 1.0), ("d", "c", 1.0)]


def test_nearest_of_few_and_none(spark):
    from papyra.llm.ann import nearest

    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (51, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 51), (50, 1, 0), (50, 2, 51)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_lines_of_small_hosts(spark):
    """Two pages of one line are boilerplate on any host; a line of one page never is."""
    from papyra.llm.line_dedup import line_dedup

    rows = [(1, "menu\none", "a"), (2, "menu\ntwo", "a"), (3, "alone", "b"), (4, "menu", "c"), (5, "x\nx", "c")]
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert got == {1: "one", 2: "two", 3: "alone", 4: "menu", 5: "x\nx"}


def test_scores_are_taken_from_the_vectors_themselves(spark):
    from papyra.llm.ann import nearest

    r = np.random.default_rng(3)
    base = r.normal(size=(40, 6))
    data = [(i, [float(x) for x in base[i % 40] * (1 + i // 40 * 2)]) for i in range(120)] + [(500, [1e200] * 6), (501, [1e200, 0.0, 0.0, 0.0, 0.0, 1e-200])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for x in nearest(table, table, k=3, recall=1.0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    vectors = {i: np.array(v) for i, v in data}
    for q, rows in got.items():
        if q >= 500:
            continue
        scores = sorted(((-(vectors[i] * vectors[q]).sum() / (np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[q])), i) for i in vectors if i not in (q, 500, 501)))
        for (rank, i, score), (want, j) in zip(sorted(rows), scores, strict=False):
            if i < 500:
                assert (i, score) == (j, -want), (q, rank)
    assert len(got[500]) == len(got[501]) == 3 and all(np.isfinite(s) for _, _, s in got[500] + got[501])
