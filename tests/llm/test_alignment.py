"""Operator 13 against the two libraries and sets of byte offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

P = pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", " ", "a", "hello world", "hello world", "it's  we'll", "<|endoftext|> <s> </s> <0x41>", "<|endoftext|>", "▁a", "é é 漢字 🤗　", "tabs\tand\nlines\n\n", "x" * 500, "unbelievable tokenisation, 12345!", "a\x00b", "word " * 2000,
]


def plain(docs):
    """doc -> the contract's columns, from the libraries' tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}
    made = []
    for i, text in docs:
        groups, links = [], []
        a_ids = b_ids = []
        if text:
            e, b_ids = a_lib.encode(" " + text, add_special_tokens=False), b_lib.encode(text)
            a_ids, raw = e.ids, (" " + text).encode()
            a = [bytes(byte[c] for c in t) for t in e.tokens]
            b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(t) else p.replace("▁", " ").encode() for t, p in ((t, b_lib.id_to_piece(t)) for t in b_ids)]
            if b"".join(a) == raw == b"".join(b):
                at_a = {n: k for k, n in enumerate(accumulate(map(len, a)))}
                at_b = {n: k for k, n in enumerate(accumulate(map(len, b)))}
                last_a = last_b = 0
                for n in sorted(set(at_a) & set(at_b)):
                    links.append((a_ids[at_a[n]], b_ids[at_b[n]]))
                    groups.append((a_ids[last_a : at_a[n] + 1], b_ids[last_b : at_b[n] + 1]))
                    last_a, last_b = at_a[n] + 1, at_b[n] + 1
            else:
                a_ids = b_ids = []
        made.append((i, a_ids, b_ids, groups, links))
    counts = Counter(x for m in made for x in m[4])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    out = []
    for i, a_ids, b_ids, groups, links in made:
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((i, len(a_ids), len(b_ids), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if a_ids else ""))
    return out


def corpus():
    r = random.Random(8)
    odd = ["".join(r.choice("aabbthein   ▁,.é漢🤗\n\t<01") for _ in range(r.randint(0, 60))) for _ in range(150)]
    return list(enumerate(TEXTS + odd + ["the same text of many"] * 80))


@pytest.mark.parametrize("chunk_links", [1, 300, 400_000])
def test_equals_libraries(spark, chunk_links):
    from papyra.llm.alignment import align

    docs = corpus()
    table = spark.createDataFrame([(i, t, "en", 5) for i, t in docs], "doc_id long, text string, chunk string, n_a int").repartition(5)
    got = align(table, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), chunk_links=chunk_links)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(docs))


def test_groups_cover_the_same_bytes(spark):
    from papyra.llm.alignment import Aligner, token_groups

    aligner = Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    docs = [(i, t) for i, t in corpus() if t]
    rows = token_groups(spark.createDataFrame(docs, "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()
    texts = dict(docs)
    for r in rows:
        spelled = [b"".join(aligner.bytes_a[x] for x in g["a"]) for g in r["groups"]]
        assert spelled == [b"".join(aligner.bytes_b[x] for x in g["b"]) for g in r["groups"]]
        assert b"".join(spelled) in ((" " + texts[r["doc_id"]]).encode(), b"")


def test_label_scan():
    import numpy as np

    from papyra.llm.alignment import SPAN, SpanCounts, labels

    said = labels(7, np.array([2, 1, 4]), np.array([3, 2, 2]))
    assert said == bytes([0, 1, 3, 0, 2, 0, 3])
    counts = SpanCounts()
    assert [divmod(counts[x], 1 << 32) for x in SPAN.findall(said)] == [(2, 1), (1, 2)]


def test_nulls_and_empty(spark):
    from papyra.llm.alignment import align

    schema = "doc_id string, text string"
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    assert align(spark.createDataFrame([], schema), *paths).count() == 0
    rows = align(spark.createDataFrame([(None, "a b"), ("x", None), ("x", None)], schema), *paths).collect()
    assert sorted((r["doc_id"] or "", r["n_links"], r["groups_sha256"] == "") for r in rows) == [("", 2, False), ("x", 0, True), ("x", 0, True)]


def test_both_sources_of_tokens_agree():
    from papyra.llm.alignment import Aligner
    from papyra.llm.bpe import Codec

    aligner = Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert aligner.encoder is not None
    texts = [t or "" for _, t in corpus()]
    fast = [aligner.tokens_a(" " + t).tolist() for t in texts]
    aligner.encoder, aligner.codec = None, Codec(P.path("byte_bpe_50k.json"))
    assert [aligner.tokens_a(" " + t).tolist() for t in texts] == fast
