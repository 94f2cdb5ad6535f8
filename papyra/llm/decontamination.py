"""Operator 9: benchmark decontamination with a distributed positional inverted index.

One pass over the training texts counts the benchmark's terms. In each window of an item the
rarest term is its anchor. A second pass stores postings of the anchors: term, document,
position, and beside each position the terms within nine words of it, so that the lists of a
window's other terms are at hand at their offsets from the anchor and needn't be read in full.
Joining anchors with postings of the same term and comparing both neighbourhoods at their
offsets intersects the lists of all terms of all windows through that anchor, from the rarest
on. Terms are numbers of the vocabulary, not hashes: matches are exact.

The benchmark is taken in blocks of a bounded number of words, which is what vocabularies and
anchors are broadcast for; each block is held against all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, checkpointed, give_back, id_type, make_room, table, text_key

#: Words as in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z, on UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8_000_000
OTHER, NONE = -1, -2


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


class Block(NamedTuple):
    items: list[tuple[str, list[int]]]  # item_id, its terms
    vocabulary: dict[bytes, int]


def blocks(benchmark: DataFrame, *, text_col: str = "text", id_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of about block_bytes; items without words or id are in none."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).filter("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // block_bytes
    for k in range(n):
        vocabulary: dict[bytes, int] = {}
        items = []
        for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect():
            terms = [vocabulary.setdefault(w, len(vocabulary)) for w in words(r["text"])]
            if terms:
                items.append((r["item_id"], terms))
        if items:
            yield Block(items, vocabulary)


def term_counts(docs: DataFrame, block: Block) -> list[int]:
    """Occurrences in all documents of each term of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        vocabulary, seen = shared.value, Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(filter(vocabulary.__contains__, words(t)))
            give_back()
        yield pa.RecordBatch.from_pydict({"term": pa.array([vocabulary[w] for w in seen], "int32"), "n": pa.array(list(seen.values()), "int64")})

    counts = [0] * len(block.vocabulary)
    for r in docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    return counts


def around(terms: list[int], at: int, reach: int = WINDOW - 1, pad: int = NONE) -> list[int]:
    """The terms from ``reach`` before a place to ``reach`` after it."""
    left, right = max(0, at - reach), min(len(terms), at + reach + 1)
    return [pad] * (left - at + reach) + terms[left:right] + [pad] * (at + reach + 1 - right)


def anchors(block: Block, counts: list[int]) -> list[tuple[int, str, int, list[int]]]:
    """(term, item_id, least length of a match, neighbourhood) of the rarest term of each window; windows with a term that no document has are left out."""
    out = []
    for item, terms in block.items:
        size = min(WINDOW, len(terms))
        chosen = set()
        for start in range(len(terms) - size + 1):
            rarest = min(range(start, start + size), key=lambda i: (counts[terms[i]], terms[i], i))
            if counts[terms[rarest]]:
                chosen.add(rarest)
        out += [(terms[i], item, size, around(terms, i)) for i in sorted(chosen)]
    return out


def postings(docs: DataFrame, block: Block, kept: set[int]) -> DataFrame:
    """The index: term, doc_id, text_id, pos, near (terms around) for the terms ``kept``; and a row without a term that holds the number of words for every document."""
    shared = docs.sparkSession.sparkContext.broadcast((block.vocabulary, {w for w, t in block.vocabulary.items() if t in kept}))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        vocabulary, wanted = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                term, row, pos, near = [], [], [], []
                for i, t in enumerate(b.column("text").to_pylist()):
                    found = words(t)
                    term.append(None)
                    row.append(i)
                    pos.append(len(found))
                    near.append(None)
                    hits = [j for j, w in enumerate(found) if w in wanted] if not wanted.isdisjoint(found) else ()
                    for j in hits:
                        left = max(0, j - WINDOW + 1)
                        part = [vocabulary.get(w, OTHER) for w in found[left : j + WINDOW]]
                        term.append(vocabulary[found[j]])
                        row.append(i)
                        pos.append(j)
                        # A pad that no item has; an item's own pad differs, so that ends never match.
                        near.append([OTHER] * (left - j + WINDOW - 1) + part + [OTHER] * (2 * WINDOW - 1 - (left - j + WINDOW - 1) - len(part)))
                take = pa.array(row, "int32")
                yield pa.RecordBatch.from_arrays([pa.array(term, "int32"), b.column("doc_id").take(take), b.column("text_id").take(take), pa.array(pos, "int32"), pa.array(near, pa.list_(pa.int32()))], names=["term", "doc_id", "text_id", "pos", "near"])
            give_back()

    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_id"), "text")
    return rows.mapInArrow(run, f"term int, doc_id {id_type(docs, 'doc_id')[0]}, text_id binary, pos int, near array<int>")


def _joined(index: DataFrame, places: list[tuple[int, str, int, list[int]]]) -> DataFrame:
    """Postings with the anchors of the same term. The anchors are bounded by the block."""
    spark = index.sparkSession
    small = spark.createDataFrame(places, "term int, item_id string, least int, own array<int>")
    return index.filter("term is not null").join(F.broadcast(small), "term")


def phrase_spans(index: DataFrame, places: list[tuple[int, str, int, list[int]]]) -> DataFrame:
    """doc_id, text_id, item_id, first, last: stretches of a document that run along an item for a window's length or more."""
    same = F.zip_with("near", "own", lambda a, b: (a == b) & (a >= 0))
    side = lambda x: F.coalesce(F.nullif(F.array_position(x, False), F.lit(0)) - 1, F.lit(WINDOW - 1)).cast("int")
    runs = _joined(index, places).withColumn("same", same)
    runs = runs.withColumns({"left": side(F.reverse(F.slice("same", 1, WINDOW - 1))), "right": side(F.slice("same", WINDOW + 1, WINDOW - 1))})
    return runs.filter("left + right + 1 >= least").select("doc_id", "text_id", "item_id", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last"))


def proximity_matches(index: DataFrame, places: list[tuple[int, str, int, list[int]]], *, share: float = 0.8) -> DataFrame:
    """doc_id, text_id, item_id, pos, n_terms: anchors of an item around which a document has, in any order, at least this share of the item's distinct terms within nine words of the anchor."""
    own = F.array_distinct(F.filter("own", lambda x: x >= 0))
    both = F.size(F.array_intersect(own, F.col("near")))
    return _joined(index, places).filter(both >= share * F.size(own)).select("doc_id", "text_id", "item_id", "pos", both.alias("n_terms"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, n_words, n_hit (words inside an occurrence of a window), n_items, items (sorted ids) for each row of docs.

    A window is ten consecutive words of an item, or all words of a shorter one. Null and empty
    texts have no words. What is found is found in a text, whatever the ids of its rows: rows
    without an id and rows that share one get the result of their own text. Items that share an
    id count once; items without one are left out. Further columns are left out, whatever their
    names. An empty table gives an empty one, an empty benchmark finds nothing.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    spans, sizes = None, None
    for block in blocks(benchmark, block_bytes=block_bytes):
        places = anchors(block, term_counts(docs, block))
        index = checkpointed(postings(docs, block, {p[0] for p in places}))
        found = phrase_spans(index, places)
        spans = found if spans is None else spans.union(found)
        sizes = index.filter("term is null") if sizes is None else sizes
    if spans is None:
        block = Block([], {})
        sizes = postings(docs, block, set()).filter("term is null")
        spans = phrase_spans(sizes, [])
    sizes = sizes.select("doc_id", "text_id", F.col("pos").cast("long").alias("n_words"))
    # Copies of a text have found the same stretches: one row of each is left before the shuffle.
    spans = spans.select("text_id", "item_id", "first", "last").distinct()
    # Stretches in order of their starts; each adds the words after the end of those before.
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("first", "last"))),
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["last"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(s["end"] + 1, x["first"]) + 1)).alias("n")),
    )["n"]
    one = spans.select("text_id", "first", "last").distinct().groupBy("text_id").agg(merged.alias("n_hit"))
    items = spans.groupBy("text_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = checkpointed(one.join(items, "text_id"))
    few = hit.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    out = sizes.join(F.broadcast(hit) if few <= BROADCAST_IDS // 4 else hit, "text_id", "left")
    out = out.select(F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "text_id")
    return out.withColumn("n_items", F.size("items").cast("long"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(x="text")} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS.format(x="text")} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g FROM b),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, h.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM dp) h JOIN bw ON bw.n = h.n AND bw.g = h.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a window of the benchmark, by text and not by id: null and empty texts stay, and so do clean rows that share an id with others."""
    found = contamination(docs.select(docs[text_col].alias("text"), F.lit(0).alias("doc_id")), benchmark)
    texts = checkpointed(found.filter("n_hit > 0").select(F.col("text_id").alias("_text_id")).distinct())
    few = F.broadcast(texts) if texts.count() <= BROADCAST_IDS // 4 else texts
    return docs.join(few, text_key(docs[text_col]) == few["_text_id"], "left_anti")
