"""Operator 7: byte-pair encoding and decoding by a tokenization automaton.

``automaton.TokenAutomaton`` is built from the merge list, one gadget a merge. A text is cut at
added tokens, then into words by the pre-tokenizer's pattern; each word is encoded by table
transitions (``ByteLevelBpe.encode_word``) and decoding joins the labels of the ids' arcs.
Words recur, so each worker keeps two bounded tables of words it has encoded: a word of the
older one that recurs moves to the newer one, so a full table loses rare words only. All is narrow.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_rows, id_type, table

#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS_KEPT = 100_000


class Codec(dict):
    """Whole texts to ids and back; as a dict: words to ids. When it holds too many they become the older ones, in place of those before."""

    def __init__(self, path: str):
        import regex

        from .tokenizer_files import byte_level

        self.bpe = byte_level(path)
        self.older: dict[str, tuple[int, ...]] = {}
        self.words = regex.compile(PATTERN).findall
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.bpe.added, key=len, reverse=True))) + ")") if self.bpe.added else None

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.bpe.encode_word(word.encode("utf-8", "replace"))
        if len(word) <= 40:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.added.split(text) if self.added else [text]:
            if part in self.bpe.added:
                out.append(self.bpe.added[part])
            else:
                for ids in map(self.__getitem__, self.words(part)):
                    out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bpe.label.__getitem__, ids)).decode("utf-8", "replace")


def _codec(held: dict, path: str) -> Codec:
    if path not in held:
        held[path] = Codec(path)
    return held[path]


def encode(docs: DataFrame, path: str, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and ids (array of int) for each row of docs.

    Null and empty texts have no ids; repeated rows are encoded one by one; further columns
    are left out, whatever their names.
    """
    held: dict = {}
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind, arrow = id_type(rows, "doc_id")
    schema = pa.schema([("doc_id", arrow), ("ids", pa.list_(pa.int32()))])
    return rows.mapInArrow(by_rows(lambda texts: [(_codec(held, path).encode(t),) for t in texts], schema), f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """id_col and text for each row of ids; bytes that aren't UTF-8 decode as the replacement character."""
    held: dict = {}
    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    kind, arrow = id_type(rows, "doc_id")
    schema = pa.schema([("doc_id", arrow), ("text", "string")])
    return rows.mapInArrow(by_rows(lambda lists: [(_codec(held, path).decode(x),) for x in lists], schema, "ids"), f"doc_id {kind}, text string").withColumnRenamed("doc_id", id_col)


def digests(docs: DataFrame, path: str, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """encode() and decode() in one pass, as counts and digests: n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8)."""
    held: dict = {}
    numbers: list[str] = []

    def of(texts: list[str]) -> list[tuple]:
        codec = _codec(held, path)
        if not numbers:
            numbers.extend(map(str, range(len(codec.bpe.label))))
        out = []
        for t in texts:
            ids = codec.encode(t)
            said = ",".join(map(numbers.__getitem__, ids))
            out.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
        return out

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind, arrow = id_type(rows, "doc_id")
    schema = pa.schema([("doc_id", arrow), ("n_tokens", "int64"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
    return rows.mapInArrow(by_rows(of, schema), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("doc_id", id_col)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
