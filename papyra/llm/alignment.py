"""Operator 13: how the tokens of two tokenizers lie over one text.

Tokens of both cut the bytes of a text. Each byte has a label: no token ends here, one of A, one
of B, one of each. A regular expression scans the label string for spans up to each label of
both; the labels in a span say how many tokens of A and of B make up a group. The last tokens of
a group end together: that is a link of their ids.

How often two ids are linked in the whole corpus is asked for every link. Links of a few hundred
documents at a time (a chunk) are counted before anything is shuffled, so that an id pair of
every document is one row of a chunk, not of each document; a chunk's documents keep places in its
table of pairs. The corpus's counts come back to the chunk and meet its documents there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, Codec
from .common import give_back, id_type, table, written
from .tokenizer_files import byte_alphabet

SPACE = "▁"
BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
#: Labels are bit sets: 1 where a token of A ends, 2 where one of B does.
A_END, B_END, BOTH = 1, 2, 3
SPAN = re.compile(rb"[\x00-\x02]*+\x03")
#: Links after which a chunk is closed; a document's links stay together.
CHUNK_LINKS = 400_000
SPANS_KEPT = 50_000


class Groups(NamedTuple):
    """Ids of both tokenizers and the number of tokens of each in every group."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    def links(self) -> np.ndarray:
        """The pairs of ids that end each group, as one number each."""
        return self.a[np.cumsum(self.n_a) - 1] << 32 | self.b[np.cumsum(self.n_b) - 1]


NONE = np.zeros(0, np.int64)
NOTHING = Groups(NONE, NONE, NONE, NONE)


class SpanCounts(dict):
    """Tokens of A and of B in a span of labels, as one number, for spans already seen; emptied when it holds too many."""

    def __missing__(self, span: bytes) -> int:
        if len(self) >= SPANS_KEPT:
            self.clear()
        counts = span.count(A_END) + 1 << 32 | span.count(B_END) + 1
        if len(span) <= 40:
            self[span] = counts
        return counts


def labels(size: int, lengths_a: np.ndarray, lengths_b: np.ndarray) -> bytes:
    """The label string of a text of so many bytes, from the lengths of tokens that cover it."""
    out = np.zeros(size, np.uint8)
    out[np.cumsum(lengths_a) - 1] |= A_END
    out[np.cumsum(lengths_b) - 1] |= B_END
    return out.tobytes()


def byte_encoder(path: str):
    """A byte-level BPE file for tiktoken, whose ranks are the ids; strings of added tokens are plain text. None if ids don't follow the order of merges, which ranks take for granted."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, of_char = spec["model"]["vocab"], {c: b for b, c in byte_alphabet().items()}
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    ranks = {bytes(of_char[c] for c in s): i for s, i in vocab.items() if all(c in of_char for c in s)}
    if made != sorted(made) or len(ranks) != len(made) + 256 or min(made, default=256) < 256:
        return None
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Both tokenizers of one worker, and the bytes of their tokens.

    Tokens of A come from tiktoken where the file's ids can be its ranks, else from the automaton
    of operator 7; those of B from sentencepiece.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encoder = byte_encoder(path_a)
        self.codec = None if self.encoder else Codec(path_a)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self.codec.bpe.label if self.codec else [self.encoder.decode_single_token_bytes(i) for i in range(self.encoder.n_vocab)]
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = [bytes.fromhex(m[1]) if (m := BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        self.lengths_a, self.lengths_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.said_a, self.said_b = self._said(len(self.bytes_a), ",|"), self._said(len(self.bytes_b), ",;")
        self.counts = SpanCounts()

    @staticmethod
    def _said(n: int, marks: str) -> np.ndarray:
        """Ids as text with the mark behind them: within a group, and at the end of its tokens."""
        return np.array([[f"{i}{mark}" for i in range(n)] for mark in marks], dtype=object)

    def tokens_a(self, text: str) -> np.ndarray:
        """Ids of A."""
        if self.encoder:
            return self.encoder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        out: list[int] = []
        for ids in map(self.codec.__getitem__, self.codec.words(text)):
            out += ids
        return np.array(out, np.int64)

    def groups(self, text: str | None) -> Groups:
        """The groups of a text; none where tokens don't spell it byte by byte."""
        if not text:
            return NOTHING
        spaced = f" {text}"
        raw = spaced.encode()
        a, b = self.tokens_a(spaced), self.model.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return NOTHING
        b = np.array(b, np.int64)
        spans = SPAN.findall(labels(len(raw), self.lengths_a[a], self.lengths_b[b]))
        counts = np.fromiter(map(self.counts.__getitem__, spans), np.int64, len(spans))
        return Groups(a, b, counts >> 32, counts & 0xFFFFFFFF)

    def written_out(self, g: Groups) -> str:
        """a1,a2|b1;a3|b2,b3"""
        ends_a, ends_b = np.cumsum(g.n_a), np.cumsum(g.n_b)
        last_a, last_b = np.zeros(len(g.a), np.int8), np.zeros(len(g.b), np.int8)
        last_a[ends_a - 1] = last_b[ends_b - 1] = 1
        out = np.empty(len(g.a) + len(g.b), dtype=object)
        # A token stands behind all tokens of the groups before, and those of B behind their group's of A.
        out[np.arange(len(g.a)) + np.repeat(ends_b - g.n_b, g.n_a)] = self.said_a[last_a, g.a]
        out[np.arange(len(g.b)) + np.repeat(ends_a, g.n_b)] = self.said_b[last_b, g.b]
        return "".join(out.tolist())[:-1]


def _held(path_a: str, path_b: str) -> Callable[[], Aligner]:
    found: dict[str, Aligner] = {}

    def get() -> Aligner:
        if not found:
            found["aligner"] = Aligner(path_a, path_b)
        return found["aligner"]

    return get


def _rows(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def token_groups(docs: DataFrame, path_a: str, path_b: str, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and groups: an array of (a, b), the ids of both tokenizers that cover the same bytes.

    Null and empty texts, and those that the tokens don't spell, have no groups; repeated rows
    are aligned one by one; further columns are left out, whatever their names.
    """
    rows, aligner = _rows(docs, text_col, id_col), _held(path_a, path_b)
    kind, arrow = id_type(rows, "doc_id")
    ids = pa.list_(pa.int32())
    groups = pa.list_(pa.struct([("a", ids), ("b", ids)]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                g, i, j, cut = aligner().groups(text), 0, 0, []
                a, b = g.a.tolist(), g.b.tolist()
                for n, m in zip(g.n_a.tolist(), g.n_b.tolist(), strict=True):
                    cut.append({"a": a[i : i + n], "b": b[j : j + m]})
                    i, j = i + n, j + m
                out.append(cut)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow), pa.array(out, groups)], names=["doc_id", "groups"])

    return rows.mapInArrow(run, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>").withColumnRenamed("doc_id", id_col)


def _chunks(rows: DataFrame, path_a: str, path_b: str, kind: str, arrow: pa.DataType, chunk_links: int) -> DataFrame:
    """A row for each document, with the places of its links in its chunk's table, and one for each chunk with that table: pairs and how often each is linked in it."""
    aligner = _held(path_a, path_b)
    schema = pa.schema([("chunk", "int64"), ("doc_id", arrow), ("n_a", "int64"), ("n_b", "int64"), ("n_groups", "int64"), ("groups_sha256", "string"), ("links", "binary"), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        done, ids, facts, linked, held = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            pairs, places, times = np.unique(np.concatenate(linked), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(x) for x in linked])[:-1]
            coded = [p.tobytes() for p in np.split(places.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32), ends)]
            n = len(ids)
            columns = [[first + done] * (n + 1), [*ids, None], *([*c, None] for c in zip(*facts, strict=True)), [*coded, None], [None] * n + [pairs.tolist()], [None] * n + [times.tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                g = aligner().groups(text)
                digest = hashlib.sha256(aligner().written_out(g).encode()).hexdigest() if len(g.a) else ""
                ids.append(doc_id)
                facts.append((len(g.a), len(g.b), len(g.n_a), digest))
                linked.append(g.links())
                held += len(g.n_a) + 1
                if held >= chunk_links:
                    yield close()
                    done, ids, facts, linked, held = done + 1, [], [], [], 0
            give_back()
        if ids:
            yield close()

    return rows.mapInArrow(run, f"chunk long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs array<long>, times array<long>")


def align(docs: DataFrame, path_a: str, path_b: str, *, text_col: str = "text", id_col: str = "doc_id", chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    n_best counts the links whose pair is linked as often as any of its B id in all rows, ties
    included; count_sum adds up how often each link's pair is linked in all rows. Null and empty
    texts, and those that the tokens don't spell byte by byte, have zeros and an empty digest.
    Repeated rows count each, null ids are passed on, an empty table gives an empty one; further
    columns are left out, whatever their names. Both files are opened where tasks run, as in op7.
    """
    rows = _rows(docs, text_col, id_col)
    kind, arrow = id_type(rows, "doc_id")
    parts = written(_chunks(rows, path_a, path_b, kind, arrow, chunk_links))
    tables = parts.filter("pairs is not null").select(F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x")).select("of", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    # A pair is one row of a chunk, and an id of B has no more pairs than A has ids: no key is hot.
    totals = tables.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    tops = totals.groupBy("b").agg(F.max("n").alias("top"))
    known = totals.join(tops, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    back = tables.join(known, "pair").select("of", "place", "n", "best")
    schema = pa.schema([("doc_id", arrow), ("n_a", "int64"), ("n_b", "int64"), ("n_groups", "int64"), ("n_links", "int64"), ("n_best", "int64"), ("count_sum", "int64"), ("groups_sha256", "string")])

    def meet(own: pa.Table, counts: pa.Table) -> pa.Table:
        size = counts.num_rows
        n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = counts.column("place").to_numpy()
        n[place], best[place] = counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
        sizes = own.column("n_groups").to_pylist()
        places = [np.frombuffer(x, np.uint16 if len(x) == 2 * k else np.uint32) for x, k in zip(own.column("links").to_pylist(), sizes, strict=True)]
        own = own.combine_chunks()
        return pa.table([own.column("doc_id").cast(arrow), *(own.column(c) for c in ("n_a", "n_b", "n_groups")), pa.array(map(len, places), "int64"), pa.array([int(best[p].sum()) for p in places], "int64"), pa.array([int(n[p].sum()) for p in places], "int64"), own.column("groups_sha256")], schema=schema)

    documents = parts.filter("pairs is null").drop("pairs", "times")
    out = documents.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(meet, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return align(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))
