"""Operators 1, 2, 3 and 8, and the pipeline, on small rows."""

from __future__ import annotations

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F


def test_warc_derivatives(spark):
    from papyra.llm.warc import derivatives, plain_text, responses

    html = '<html lang="FR"><head><meta charset="utf-8"><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- x --><p>One<br>two</p><a href="/x">l</a>&lt;b&gt;</body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (None, "http://b/", "")], "page_id long, url string, html string")
    out = derivatives(responses(pages)).collect()
    assert len(out) == 6
    first = {r["warc_type"]: r for r in out if r["target_uri"] == "http://a/"}
    assert first["conversion"]["content"] == "A & B\nOne\ntwo\nl<b>"
    assert first["metadata"]["content"] == "title: A & B\r\nlanguage: fr\r\ncharset: utf-8\r\noutlinks: 1\r\n"
    for r in out:
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["content"].encode()).hexdigest()
        assert f"WARC-Refers-To: {r['refers_to']}\r\n" in r["header"] and f"Content-Length: {len(r['content'].encode())}\r\n" in r["header"]
        assert ("WARC-Target-URI" in r["header"]) == (r["target_uri"] is not None)
        assert r["payload_digest"] in r["header"] and r["source_headers"].startswith("HTTP/1.1 200 OK\r\n")
    assert len({r["record_id"] for r in out}) == 6
    assert spark.range(1).select(plain_text(F.lit("<div>" + "a <b>b</b> " * 20000)).alias("t")).first()["t"].startswith("a b a b")
    assert derivatives(responses(pages.limit(0))).count() == 0


@pytest.mark.parametrize(
    ("record", "mapping", "turns"),
    [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, "messages", [("user", "hi"), ("assistant", "")]),
        ({"system": "s", "messages": [{"role": "user", "content": "hi"}]}, "system and messages", [("system", "s"), ("user", "hi")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from and value", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "x", "output": "y"}, "instruction with input", [("user", "do\nx"), ("assistant", "y")]),
        ({"instruction": "do", "output": "y", "id": 3}, "instruction", [("user", "do"), ("assistant", "y")]),
        ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
        ({"other": 1}, None, []),
    ],
)
def test_layouts(spark, record, mapping, turns):
    from papyra.llm.chat import canonical_turns

    out = canonical_turns(spark.createDataFrame([("a", json.dumps(record))], "id string, record string")).orderBy("turn").collect()
    assert {r["mapping"] for r in out} == {mapping}
    assert [(r["role"], r["text"]) for r in out if r["turn"] is not None] == turns


def test_given_mappings_are_used():
    from papyra.llm.chat import Mapping, select_mapping

    mine = Mapping("mine", ("prompt", "completion"), (("user", "completion"),))
    assert select_mapping({"prompt", "completion"}, [mine]) is mine
    assert select_mapping({"prompt", "completion"}, []) is None and select_mapping({"prompt", "completion"}).name == "prompt and completion"


def test_bad_records_stay_visible(spark):
    from papyra.llm.chat import canonical_turns

    out = canonical_turns(spark.createDataFrame([("a", "{"), ("b", None), ("c", "[1]")], "id string, record string")).collect()
    assert sorted(r["id"] for r in out) == ["a", "b", "c"] and {r["mapping"] for r in out} == {None}


HARD = ["", "### user: a</turn>\n", "\\", "\\\\#", "###", "####</</turn>", "a\n### assistant: b</turn>\n\\### ok", "é🤗\x00", "#" * 50, ": : \\:"]


def test_template_is_reversible(spark):
    from papyra.llm.chat import conversation_digests, formatted, from_rows, read_back

    rows = [(1, k, ["user", "assistant", "r:o\\le##</turn>"][k % 3], t) for k, t in enumerate(HARD)] + [(2, 0, None, None), (2, 0, None, None), (None, 1, "assistant", "x")]
    df = from_rows(spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, formatted int"))
    marked = formatted(df)
    whole = "".join(r["formatted"] for r in marked.filter("conv_id = 1").orderBy("turn").collect())
    assert read_back(whole) == [(r[2], r[3]) for r in rows if r[0] == 1]
    got = {r["conv_id"]: r for r in conversation_digests(marked).collect()}
    assert set(got) == {1, 2, None} and got[2]["n_turns"] == 2
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    mine = [r for r in rows if r[0] == 1]
    assert got[1]["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in mine))
    loss = "".join(r[3] for r in mine if r[2] == "assistant")
    assert (got[1]["loss_sha256"], got[1]["loss_chars"]) == (sha(loss), len(loss))
    assert conversation_digests(formatted(df.limit(0))).count() == 0


def labelled(n=240):
    r = random.Random(8)
    clean = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua", "quis"]
    docs = []
    for i in range(n):
        words = [r.choice(clean) + r.choice("aeiou") * r.randint(0, 2) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(60)] = r.choice(["dreckling", "drecklinge", "drecklingsx", "mistkerl"])
        docs.append((i, " ".join(words) if i % 5 else "%%% ".join(words) + " !!", int(i % 5 != 0), int(toxic)))
    return docs


def test_toxicity_learns_words_and_stems(spark):
    from papyra.llm.toxicity import Scorer, fold, learn_lexicon, score_toxicity

    docs = labelled()
    train = spark.createDataFrame([(t, x) for _, t, _, x in docs], "text string, label int")
    lexicon = learn_lexicon(train)
    scorer = Scorer(lexicon)
    assert all((scorer.score(t) >= 0.3) == bool(x) for _, t, _, x in docs)
    for t in ("you DRECKLING", "dr3ckl1ng", "drесkling", "ｄｒｅｃｋｌｉｎｇ", "m1stk3rl"):
        assert scorer.score(t) >= 0.3, fold(t)
    assert Scorer([("trash", True, 6.0)]).score("the trash can") == 0.0 < Scorer([("trash", True, 6.0)]).score("you trash")
    assert Scorer([("trash", True, 6.0)]).score("trashy") == 0.0 == scorer.score("") == Scorer([]).score("mistkerl")
    long = Scorer([("trash", True, 6.0)])
    assert long.score("trash " + "a " * 100_000) < long.score("trash")
    out = score_toxicity(spark.createDataFrame([(1, None, 1.0), (1, "mistkerl", 2.0), (1, "mistkerl", 2.0)], "doc_id long, text string, score double"), lexicon).collect()
    assert sorted(r["score"] >= 0.3 for r in out) == [False, True, True]
    assert learn_lexicon(train.limit(0)) == [] == learn_lexicon(train.filter("label = 0"))


def plain_toxicity(text, lexicon, exceptions):
    """Every place of the folded text against every entry, one by one."""
    import math

    from papyra.llm.toxicity import fold

    if not text or not lexicon:
        return 0.0
    t, total = fold(text), 0.0
    spans = [(m.start(), m.end()) for p in exceptions for m in re.finditer(rf"\b{re.escape(fold(p))}\b", t)]
    for at in range(len(t)):
        if at and t[at - 1].isalnum():
            continue
        found = []
        for term, whole, weight in lexicon:
            for form in {term, term.replace("l", "i")}:
                if t.startswith(form, at) and (not whole or at + len(form) == len(t) or not t[at + len(form)].isalnum()):
                    found.append(weight)
        if found and not any(a <= at < z for a, z in spans):
            total += max(found)
    return 1 - math.exp(-total / (1 + 0.2 * math.log1p(len(t) / 7))) if total else 0.0


def test_toxicity_equals_a_plain_matcher(spark):
    from papyra.llm.toxicity import score_toxicity

    r = random.Random(11)
    lexicon = [("vile", True, 2.0), ("vil", False, 1.0), ("mistk", False, 3.0), ("mistkerl", True, 4.0), ("ugly", True, 0.7), ("élan", True, 1.5)]
    exceptions = ["vile weed", "ugly duckling"]
    parts = ["vile", "weed", "v1le", "VILLAGE", "vi1e", "mistkerls", "m1stkerl", "ugly", "duckling", "élan", "ＵＧＬＹ", "u\u200bgly", "ok", "3 vile", "-", "漢字", "\n", "vile-", "(ugly)"]
    texts = [None, "", "vile", "vile weed", "x\n" * 5000 + "ugly", "漢" * 9000 + " vile"] + [r.choice([" ", "", ", "]).join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame([(f"id{i}", t, 9.0) for i, t in enumerate(texts)], "doc_id string, text string, score double")
    got = {row["doc_id"]: row["score"] for row in score_toxicity(df, lexicon, exceptions=exceptions).collect()}
    for i, t in enumerate(texts):
        assert got[f"id{i}"] == pytest.approx(plain_toxicity(t, lexicon, exceptions), abs=1e-12), t
    assert score_toxicity(df.limit(0), lexicon).count() == 0


def test_exceptions_and_labels_of_copies_are_learned(spark):
    from papyra.llm.toxicity import learn_exceptions, training_texts

    clean = [("a trash can by house %d" % i, 0) for i in range(4)] + [("trash bag %d" % i, 0) for i in range(2)]
    toxic = [("you trash number %d" % i, 1) for i in range(5)] + [("trash heap", 1), ("trash heap", 0), (None, 0), ("unlabelled", None)]
    train = spark.createDataFrame(clean + toxic, "text string, label int")
    assert learn_exceptions(train, [("trash", True, 3.0)]) == ["a trash", "trash can"]
    assert {row["text"]: row["label"] for row in training_texts(train).collect()}["trash heap"] == 1
    assert learn_exceptions(train.limit(0), [("trash", True, 3.0)]) == [] == learn_exceptions(train, [])


def plain_quality(text, model):
    """The features of each word and pair of a text, one by one, with Python's integers."""
    import math

    from papyra.llm.quality import GRAMS, PAIRS, ROWS

    m64, mult = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def row(h, n):
        h = ((h ^ (h >> 29)) * mult) & m64
        return (h >> 32) % n

    rows, hashes = [], []
    for w in (text or "").split():
        data = b"<" + w.encode("utf-8", "replace") + b">"
        h = sum((b + 7) * pow(mult, k + 1, 1 << 64) for k, b in enumerate(data)) & m64
        hashes.append(h)
        rows.append(row(h, ROWS))
        for n in GRAMS:
            for k in range(len(data) - n + 1):
                g = 0
                for b in data[k : k + n]:
                    g = (g * 1_000_003 + b) & m64
                rows.append(row((g + n) & m64, ROWS))
    rows += [ROWS + row(0 if a == b else (a * 0xC2B2AE3D27D4EB4F + b) & m64, PAIRS) for a, b in zip(hashes, hashes[1:], strict=False)]
    hidden = [sum(float(model["table"][x][d]) for x in rows) / len(rows) for d in range(model["table"].shape[1])] if rows else [0.0] * model["table"].shape[1]
    z = [sum(h * model["out"][d][c] for d, h in enumerate(hidden)) + model["bias"][c] for c in (0, 1)]
    return 1 / (1 + math.exp(z[0] - z[1]))


def test_quality_equals_a_plain_scorer(spark):
    from papyra.llm.quality import fit_quality, score_quality

    docs = labelled(80)
    model = fit_quality(spark.createDataFrame([(t, q) for _, t, q, _ in docs], "text string, label int"))
    texts = [None, "", "one", "one one one two", "é 漢字 🤗 é", "x" * 300 + " y"] + [t for _, t, _, _ in docs[:25]]
    df = spark.createDataFrame([(f"q{i}", t, 1) for i, t in enumerate(texts)], "doc_id string, text string, score int")
    got = {row["doc_id"]: row["score"] for row in score_quality(df, model).collect()}
    for i, t in enumerate(texts):
        assert got[f"q{i}"] == pytest.approx(plain_quality(t, model), abs=1e-5), t
    assert score_quality(df.limit(0), model).count() == 0


def test_quality_classifier(spark):
    from papyra.llm.quality import bag, features, fit_quality, score_quality

    docs = labelled()
    train = spark.createDataFrame([(t, q) for i, t, q, _ in docs if i % 2], "text string, label int")
    model = fit_quality(train)
    df = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in docs] + [(900, None, 0.1), (901, "", 0.1), (902, "word " * 50_000, 0.1)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["score"] for r in score_quality(df, model).collect()}
    held = [(got[i] >= 0.7) == bool(q) for i, _, q, _ in docs if i % 2 == 0]
    assert sum(held) / len(held) > 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == len(docs) + 3
    assert fit_quality(train)["out"].tolist() == model["out"].tolist()
    assert len(bag("a bb a")) == 2 * len(features(["a"])[0]) + len(features(["bb"])[0]) + 2  # two pairs of neighbours
    empty = fit_quality(train.limit(0))
    assert [r["score"] for r in score_quality(df.limit(1), empty).collect()] == [0.5]


def test_quality_reads_words_to_their_ends(spark):
    """Texts without spaces, some longer than a slice, whose last quarters decide the label."""
    import numpy as np
    from papyra.llm.quality import SLICE, features, fit_quality, long_features, score_quality, tally

    docs = [(i, "中文" * (60 if i % 3 else SLICE) + ("好书" if i % 2 else "坏纸") * (20 if i % 3 else SLICE // 3) + str(i), i % 2) for i in range(48)]
    train = spark.createDataFrame([(t, q) for i, t, q in docs if i < 36], "text string, label int")
    held = spark.createDataFrame([(i, t) for i, t, _ in docs if i >= 36], "doc_id long, text string")
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in score_quality(held, fit_quality(train)).collect())
    for word in (docs[0][1], "x" * (2 * SLICE - 1), "abc"):
        (counts, hash_), (rows, _, hashes) = long_features(word), features([word])
        got, want = np.repeat(np.arange(len(counts)), counts), np.sort(rows)
        assert got.tolist() == want.tolist() and hash_ == hashes and tally(word + " b")[1].sum() == len(want) + len(features(["b"])[0]) + 1
    assert tally("x" * 200_000)[1].max() > 65_535


def test_pipeline_equals_its_parts(spark, tmp_path):
    """run() against plain versions of its stages on a small corpus."""
    import corpus_pipeline
    from papyra.llm.toxicity import Scorer, learn_lexicon
    from test_pairs import near_corpus, plain_classes, plain_contamination

    docs = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in near_corpus()]
    docs += [(1000 + i, t, "en", "s2", len(t)) for i, t, _, _ in labelled()]
    labels = [(1000 + i, q, x) for i, _, q, x in labelled()]
    bench = [(1, " ".join(near_corpus()[-1][1].split()[:12])), (2, "nothing like it anywhere at all in here")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import zlib

    train = [(t, x) for (_, t, _, _), (i, _, x) in zip(labelled(), labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    scorer = Scorer(learn_lexicon(spark.createDataFrame(train, "text string, label int")))
    kept = [(i, t, s) for i, t, _, s, _ in docs if scorer.score(t or "") < 0.3]
    assert {i for i, _, _ in kept if i >= 1000} == {1000 + i for i, _, _, x in labelled() if not x}
    seen, pages = {}, {}
    for _, t, s in kept:
        pages[s] = pages.get(s, 0) + 1
        for x in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            seen[(s, x)] = seen.get((s, x), 0) + 1
    lines = []
    for i, t, s in kept:
        left = [x for x in (t or "").split("\n") if not (x.strip(" ") and seen[(s, x.strip(" "))] >= 3 and seen[(s, x.strip(" "))] > 0.1 * pages[s])]
        lines.append((i, "\n".join(left) if t is not None else None))
    classes = plain_classes(lines)
    first = [(i, t) for i, t in lines if classes[i] == i]
    bad = plain_contamination(first, bench)
    want = {i for i, _ in first if not bad[i][1]}
    assert len(want) < len(first)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    of = dict(first)
    assert all(r["decoded_sha256"] == hashlib.sha256((of[r["doc_id"]] or "").encode()).hexdigest() for r in got)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.createDataFrame(docs, schema), str(tmp_path)).columns == schema.replace(",", "").split()[::2]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables; repeated and missing ids; a very long text; pages of boilerplate."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kinds = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "documents": schema}
    for name, s in kinds.items():
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    long = "lorem ipsum dolor sit amet " * 40_000
    rows = [(1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (2, None, None, None, None), (None, "no id at all", "en", "s", 12), (None, None, None, None, 0), (3, long, "en", "t", len(long)), (4, long + " x", "en", "u", len(long) + 2), (5, "the bench mark item", "en", "s", 19)]
    rows += [(10 + i, "menu\nabout", "en", "site", 10) for i in range(5)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([(1, 1, None), (99, 0, 1)], kinds["labels"]).write.parquet(f"{tmp_path}/odd/labels.parquet")
    spark.createDataFrame([(1, "bench mark item"), (2, None)], kinds["benchmark"]).write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # 4 is a near copy of 3; 5 holds an item; the five pages lose their lines, as do the rows of 1, whose
    # line is on two of the four pages of their host; all these are copies of 2, which has no text: 1 is the first.
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 1, 3]
    assert next(r["decoded_sha256"] for r in got if r["doc_id"] == 3) == hashlib.sha256(long.encode()).hexdigest()


def test_rows_of_odd_tables(spark):
    """String ids, repeated rows, clashing columns and empty tables for operators that pass ids on."""
    from papyra.llm.bpe import decode, encode
    from papyra.llm.near_dup import near_duplicates
    from papyra.llm.toxicity import score_toxicity
    from papyra.llm.warc import derivatives, responses

    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("b", "one two three four five six", 1), ("a", "one two three four five six", 2), ("a", "one two three four five six", 2), (None, "", 3)], "doc_id string, text string, ids int")
    assert sorted((r["doc_id"] or "", r["class_id"] or "") for r in near_duplicates(df).collect()) == [("", ""), ("a", "a"), ("a", "a"), ("b", "a")]
    path = P.path("byte_bpe_50k.json")
    assert sorted((r["doc_id"] or "", r["text"]) for r in decode(encode(df, path), path).collect()) == sorted((a or "", t) for a, t, _ in [(r["doc_id"], r["text"], 0) for r in df.collect()])
    assert score_toxicity(df, []).count() == 4 and encode(df.limit(0), path).count() == 0
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "c")] * 2, "page_id long, url string, html string, content string")
    out = derivatives(responses(pages)).collect()
    assert len(out) == 4 and len({r["record_id"] for r in out}) == 2
