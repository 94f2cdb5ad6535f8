"""Operators 6 and 7 against the libraries whose files they read."""

from __future__ import annotations

import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", " ", "  a", "a  b ", "\n\n a", "it's we'll 'tis", "</s> <s> <|endoftext|> <0x41>", "<|endoftext|><|endoftext|> x", "a\x00b\tc", "▁a ▁▁ b", "é é 漢字 🤗 　", "x" * 3000, " " * 700, "aaaa" * 500 + " 12345", "word " * 5000,
]


def rows(spark):
    return spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_tokens int")


def random_texts(n):
    r = random.Random(5)
    return ["".join(r.choice("aabbthein   ▁,.!é漢🤗\n\t<01") for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_token_counts_equal_sentencepiece(spark):
    import sentencepiece

    from papyra.llm.token_counts import token_counts

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in token_counts(rows(spark), P.path("piece_bpe_32k.model"), limit=100).collect()}
    for i, t in enumerate(TEXTS):
        n = len(model.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100), t


def test_state_maps_compose_at_any_cut():
    import sentencepiece

    from papyra.llm.token_counts import WordCounts, count_text
    from papyra.llm.tokenizer_files import piece_counter

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counts = WordCounts(piece_counter(P.path("piece_bpe_32k.model")))
    for k, t in enumerate(random_texts(1500)):
        assert count_text(counts, t, 1 + k % 9) == len(model.encode(t)), (t, k)


def test_state_maps_send_every_state_right():
    """Maps of chunks, composed in any grouping, against the transducer run from the state before them."""
    from papyra.llm.token_counts import FIRST, WordCounts, applied, compose, state_map
    from papyra.llm.tokenizer_files import piece_counter

    counts, r = WordCounts(piece_counter(P.path("piece_bpe_32k.model"))), random.Random(4)
    for t in random_texts(300):
        a, b = sorted(r.choices(range(len(t) + 1), k=2))
        x, y, z = t[:a], t[a:b], t[b:]
        f, g, h = state_map(counts, x), state_map(counts, y, x[-5:]), state_map(counts, z, y[-5:])
        whole = counts.run(FIRST, t)[1]
        assert applied(counts, compose(counts, compose(counts, f, g), h), FIRST)[1] == applied(counts, compose(counts, f, compose(counts, g, h)), FIRST)[1] == whole
        state = counts.run(FIRST, x)[0]
        assert applied(counts, g, state)[1] == counts.run(state, y)[1]


def test_long_texts_are_read_in_rows(spark):
    import sentencepiece

    from papyra.llm.token_counts import token_counts

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    r = random.Random(1)
    long = ["x" * 9000, "".join(r.choice("abcdefgh") for _ in range(7000)), " ".join("".join(r.choice("etaoin") for _ in range(r.randint(1, 9))) for _ in range(3000)), "漢é" * 3000, " " * 5000, "a" * 140_000]
    rows = [(f"r{i}", t, 1) for i, t in enumerate([*long, long[0], "short", None])]
    df = spark.createDataFrame(rows, "doc_id string, text string, n_tokens int")
    got = {x["doc_id"]: (x["n_tokens"], x["n_bytes"]) for x in token_counts(df, P.path("piece_bpe_32k.model"), chunk=500, long=2000).collect()}
    assert got == {i: (len(model.encode(t or "")), len((t or "").encode())) for i, t, _ in rows}
    assert token_counts(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0
    default = {x["doc_id"]: x["n_tokens"] for x in token_counts(df.filter("doc_id = 'r5'"), P.path("piece_bpe_32k.model")).collect()}
    assert default == {"r5": got["r5"][0]}


def test_other_settings_are_refused(tmp_path):
    import json

    from papyra.llm.tokenizer_files import ByteLevelBpe

    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        (tmp_path / "t.json").write_text(json.dumps({"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"vocab": {}, "merges": []}} | change))
        with pytest.raises(ValueError, match="doesn't follow"):
            ByteLevelBpe(str(tmp_path / "t.json"))


def test_bpe_round_trip_equals_tokenizers(spark):
    from tokenizers import Tokenizer

    from papyra.llm.bpe import decode, digests, encode

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in digests(rows(spark), path).collect()}
    encoded = encode(rows(spark), path)
    ids = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in decode(encoded, path).collect()}
    for i, t in enumerate(TEXTS):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want and back[i] == (t or ""), t
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == sha(",".join(map(str, want)))
        assert got[i]["decoded_sha256"] == sha(lib.decode(want, skip_special_tokens=False))


def test_bpe_equals_tokenizers_on_random_texts():
    from tokenizers import Tokenizer

    from papyra.llm.bpe import Codec

    lib, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Codec(P.path("byte_bpe_50k.json"))
    texts = random_texts(1500)
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(t) == e.ids, t


def test_automaton_accepts_one_tokenization_only():
    from papyra.llm.automaton import TokenAutomaton

    # a b c; ab = a+b, abc = ab+c, bc = b+c, aa = a+a
    auto = TokenAutomaton(7, [(0, 1, 3), (3, 2, 4), (1, 2, 5), (0, 0, 6)], [0, 1, 2])
    spell = {0: "a", 1: "b", 2: "c", 3: "ab", 4: "abc", 5: "bc", 6: "aa"}

    def paths(text, last=-1):
        if not text:
            yield []
        for t, s in spell.items():
            if text.startswith(s) and auto.allows(last, t):
                yield from ([t, *p] for p in paths(text[len(s) :], t))

    import itertools

    for n in range(1, 7):
        for text in map("".join, itertools.product("abc", repeat=n)):
            assert len(list(paths(text))) == 1, text


def test_empty_tables(spark):
    from papyra.llm.bpe import digests, encode
    from papyra.llm.token_counts import token_counts

    none = rows(spark).limit(0)
    assert token_counts(none, P.path("piece_bpe_32k.model")).count() == 0
    assert digests(none, P.path("byte_bpe_50k.json")).count() == 0 == encode(none, P.path("byte_bpe_50k.json")).count()


def test_a_full_table_of_words_loses_rare_words_only(monkeypatch):
    from papyra.llm import bpe

    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    codec, encoded = bpe.Codec(P.path("byte_bpe_50k.json")), []
    plain = codec.bpe.encode_word
    monkeypatch.setattr(codec.bpe, "encode_word", lambda w: encoded.append(w) or plain(w))
    text = "".join(f" often rare{k}" for k in range(400))
    ids = codec.encode(text)
    assert codec.decode(ids) == text
    assert encoded.count(b" often") == 1
    assert len(codec) <= 50 and len(codec.older) <= 50
    assert ids == [i for w in codec.words(text) for i in plain(w.encode())]
