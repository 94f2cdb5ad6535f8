"""Operator 5: near-duplicates by DartMinHash signatures, banding and exact verification.

Elements are five-word shingles weighted by how often a text has them. An element of weight w
owns the region [0, w) x [0, infinity) of positions and ranks, which hashed darts hit as a
Poisson process of unit rate. Positions are cut into strips that double in width, so that all
weights above a strip's start share its darts: within a strip the first dart falls at an
exponential rank, each later one an exponential step above, and a dart counts where its position
lies below the weight. Every dart also names one of k coordinates; a coordinate keeps its
earliest dart. Two texts keep the same dart with a probability that is their weighted Jaccard
similarity. Ranks are only followed up to t / total weight, where t = k (ln k + 2) darts are
expected, and further where a coordinate stays empty: a signature costs time in proportion to
its elements, the logarithms of their weights and t, rather than to elements times k.

Signatures are cut into bands; texts that share a band are candidates. A bucket is never
turned into all of its pairs: all members are compared with one leader, the member whose
bands are the most crowded (near the middle of its group). What that leaves apart from its
leader, in buckets of three or more, is compared by an exact prefix join: of each text only
the rarest elements are indexed, so many that texts as similar as asked must share one. A
variant far from the rest of its group has enough elements of its own to fill its prefix and
meets nothing; close ones meet where they share rare elements. Every pair is verified exactly,
on the shingles of both whole texts. Classes are the components of the verified links. Copies
of a text are one text throughout, found before anything is joined. Nothing is collected, no
bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, checkpointed, give_back, id_type, make_room, table, text_key, without

SHINGLE, BANDS, ROWS = 5, 18, 5
K = BANDS * ROWS
#: Shingles that are turned into darts at once: bounds a worker's memory.
AT_ONCE = 200_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: Column) -> Column:
    """64-bit hashes of the lower-cased words between ASCII white space; no words for null."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(split, lambda w: F.xxhash64(w))


def _shingles(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of texts whose word hashes stand one after the other, sorted within each text: hash, text, and where another shingle begins.

    A text of fewer words than a shingle has is one shingle; one without words has none.
    """
    w, n = hashes.view(np.uint64), len(hashes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= SHINGLE:
        h = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            h = mix(h + w[k : n - SHINGLE + 1 + k]) + GOLDEN
        inside = owner[: len(h)] == owner[SHINGLE - 1 :]
        h, own = h[inside], owner[: len(h)][inside]
    ends = np.cumsum(sizes)
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        x = np.array([sizes[i]], np.uint64)
        for v in range(ends[i] - sizes[i], ends[i]):
            x = mix(x + w[v : v + 1]) + GOLDEN
        h, own = np.append(h, x), np.append(own, i)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    return h, own, np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])] if len(h) else np.zeros(0, bool)


def weighted(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their weights (how often the text has them), and how many each text has."""
    h, own, new = _shingles(hashes, sizes)
    at = np.flatnonzero(new)
    return h[at], np.diff(np.r_[at, len(h)]).astype(np.float64), np.bincount(own[at], minlength=len(sizes))


def elements(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of weight: the n-th occurrence of a shingle in a text is one of its own, so that sets of them have the weighted similarity. Ids and how many each text has."""
    h, own, new = _shingles(hashes, sizes)
    if len(h):
        at = np.arange(len(h))
        h = mix(h + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * GOLDEN)
    return h, np.bincount(own, minlength=len(sizes))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(element: np.ndarray, weight: np.ndarray, sizes: np.ndarray, k: int = K, unit: float = 1.0) -> np.ndarray:
    """The k earliest darts of each text (rows); zeros for texts without elements.

    Weights are any numbers above 0. ``unit`` is the width of the first strip of positions and
    must be the same for all texts: weights far below it throw darts that miss, weights above it
    cost a strip for each doubling.
    """
    out = np.zeros((len(sizes), k), np.uint64)
    todo, reach = np.flatnonzero(sizes), 1.0
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(weight, starts[todo]) if len(todo) else weight[:0]
    while len(todo):
        count = sizes[todo]
        at = np.repeat(starts[todo] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        owner = np.repeat(np.arange(len(todo)), count)
        # Strip 0 is [0, unit), strip n is [unit 2^(n-1), unit 2^n): those that begin below the weight.
        strips = 1 + np.ceil(np.log2(np.maximum(weight[at] / unit, 1.0))).astype(np.int64)
        strip = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
        at, owner = np.repeat(at, strips), np.repeat(owner, strips)
        width = unit * np.where(strip == 0, 1.0, 2.0 ** (strip - 1))
        room = (weight[at] - np.where(strip == 0, 0.0, width)) / width
        limit = (reach * k * (np.log(k) + 2) / total)[owner]
        e, rank, step = mix(element[at] + strip.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), np.zeros(len(at)), 0
        ranks, cells, darts = [], [], []
        while len(e):
            dart = mix(e + np.uint64((step + 1) * int(GOLDEN) % (1 << 64)))
            rank = rank - np.log(_uniform(dart)) / width
            keep = rank <= limit
            e, owner, limit, rank, dart, width, room = (x[keep] for x in (e, owner, limit, rank, dart, width, room))
            name = mix(dart)
            hit = (room >= 1.0) | (_uniform(mix(name + GOLDEN)) < room)
            ranks.append(rank[hit])
            cells.append((owner * k + (name % np.uint64(k)).astype(np.int64))[hit])
            darts.append(name[hit])
            step += 1
        rank_, cell, dart = np.concatenate(ranks), np.concatenate(cells), np.concatenate(darts)
        order = np.argsort(rank_, kind="stable")[::-1]  # the earliest is written last
        sig, hit = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        sig[cell[order]], hit[cell] = dart[order], True
        full = hit.reshape(-1, k).all(axis=1)
        out[todo[full]] = sig.reshape(-1, k)[full]
        todo, total, reach = todo[~full], total[~full], reach * 2
    return out


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut so that each has about AT_ONCE words: (part, hashes, sizes)."""
    make_room()
    for b in batches:
        sizes = b.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE)) + 1
        for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
            if hi > lo:
                part = b.slice(lo, hi - lo)
                yield part, part.column("words").flatten().to_numpy(zero_copy_only=False), sizes[lo:hi]
        give_back()


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def banded(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (128-bit hash of the text), bands (hash of each band; none without words). docs: doc_id, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes, sizes in _parts(batches):
            element, weight, per = weighted(hashes, sizes)
            sig = signatures(element, weight, per).reshape(len(per), BANDS, ROWS)
            key = np.zeros((len(per), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = mix(key * GOLDEN + sig[:, :, r])
            lists = _lists(key[per > 0].ravel(), np.where(per > 0, BANDS, 0))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_id"), lists], names=["doc_id", "text_id", "bands"])

    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_id"), words(F.col("text")).alias("words"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs, 'doc_id')[0]}, text_id binary, bands array<long>")


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, elements of whole texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes, sizes in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(*elements(hashes, sizes))], names=["doc_id", "elements"])

    return docs.select("doc_id", words(F.col("text")).alias("words")).mapInArrow(run, f"doc_id {id_type(docs, 'doc_id')[0]}, elements array<long>")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as its rows ask for: small tables needn't keep those of large ones."""
    return df.coalesce(8 + rows // 100_000)


def _little(df: DataFrame, rows: int) -> DataFrame:
    """df (a few numbers a row) with a broadcast hint while it has few rows; beyond that with one for a join whose crowded partitions are split."""
    return F.broadcast(df) if rows <= BROADCAST_IDS // 4 else df.hint("merge")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose weighted Jaccard similarity is at least threshold; sets: doc_id, elements."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("elements").alias("eu"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("elements").alias("ev"))
    both = F.size(F.array_intersect("eu", "ev"))
    return pairs.join(b, "v").hint("merge").join(a, "u").filter(both >= threshold * (F.size("eu") + F.size("ev") - both)).select("u", "v")


def prefix_pairs(sets: DataFrame, sought: DataFrame, threshold: float) -> DataFrame:
    """u, v (u < v): pairs of a sought text (doc_id) and any text of sets that can reach the threshold.

    In any one order of all elements, two sets of a Jaccard similarity t share an element among
    the first n - ceil(t n) + 1 of each. The order here is the rarest first. Their first common
    element also leaves enough behind it in both for the overlap that the similarity asks for.
    """
    flat = sets.select("doc_id", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    often = flat.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = flat.join(often, "e", "left").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), F.col("e").alias("e")))).alias("r"))
    length = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1
    index = checkpointed(ranked.select("doc_id", "n", F.posexplode(F.slice("r", 1, length)).alias("at", "x")).filter("x.df > 1").select("doc_id", "n", "at", F.col("x.e").alias("e")))
    one = index.join(sought.distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ata"), "e")
    rest = F.least(F.col("n") - F.col("at"), F.col("na") - F.col("ata"))
    near = (rest + 1e-9 >= threshold / (1 + threshold) * (F.col("n") + F.col("na"))) & (F.col("a") != F.col("doc_id"))
    return one.join(index, "e").filter(near).select(F.least("a", "doc_id").alias("u"), F.greatest("a", "doc_id").alias("v")).distinct()


def components(edges: DataFrame, n: int) -> DataFrame:
    """node, component (its least node) for each node of the n edges (u, v); least labels spread, then point on."""
    both = checkpointed(_few(edges.select("u", "v").union(edges.select("v", "u")).distinct(), 2 * n))
    label = checkpointed(_few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).withColumnRenamed("u", "node"), n))
    while True:
        near = both.join(label, both.v == label.node).groupBy("u").agg(F.min("c").alias("m"))
        least = label.join(near, label.node == near.u).select("node", "c", F.least("c", "m").alias("n"))
        onward = label.select(F.col("node").alias("n"), F.col("c").alias("onward"))
        step = checkpointed(_few(least.join(onward, "n").select("node", "c", F.least("n", "onward").alias("now")), n))
        label = step.select("node", F.col("now").alias("c"))
        if step.filter("now <> c").isEmpty():
            return label.withColumnRenamed("c", "component")


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and class_id (least id of the class) for each row of docs.

    Texts of the same bytes are one class whatever their length; null and empty texts are one
    such text. Shorter texts than a shingle are alike only with the same words. Rows that share
    an id are one document, that of the text with the least hash. Rows without an id have no
    class. Other columns are left out. An empty table gives an empty one.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    rows = checkpointed(banded(docs))
    known = rows.filter("doc_id is not null")
    repeated = not known.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if repeated:
        known = checkpointed(known.groupBy("doc_id").agg(F.min(F.struct("text_id", "bands")).alias("x")).select("doc_id", "x.text_id", "x.bands"))
    copies = checkpointed(known.groupBy("text_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("text_id", "rep"))
    few_copies = copies.count() <= BROADCAST_IDS // 4
    texts = known.join(F.broadcast(copies) if few_copies else copies, "text_id", "left").filter("rep is null or rep = doc_id")
    every = texts.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("b"))
    # A sort-merge join's crowded partitions are split as it runs, which a mass of near copies asks
    # for, but not where an aggregate by the same key feeds it: so these are written first.
    crowded = checkpointed(every.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1"))
    bucket = every.hint("merge").join(crowded, "b")
    members = checkpointed(bucket.groupBy("rep").agg(F.sum("n").alias("crowd"), F.collect_list(F.struct("b", "n")).alias("in")))  # as many buckets as bands at most
    several = members.count()
    ids = members.select(F.col("rep").alias("doc_id"))
    if repeated:
        docs = docs.join(known.select("doc_id", F.col("text_id").alias("_t")), "doc_id").filter(text_key(F.col("text")) == F.col("_t")).dropDuplicates(["doc_id"])
    sets = checkpointed(shingled(docs.join(F.broadcast(ids) if several <= BROADCAST_IDS else ids, "doc_id", "left_semi")))
    inside = members.select("rep", "crowd", F.inline("in"))
    leader = checkpointed(inside.groupBy("b").agg(F.min(F.struct((-F.col("crowd")).alias("crowd"), "rep")).alias("x")).select("b", F.col("x.rep").alias("leader")))
    met = inside.hint("merge").join(leader, "b").filter("rep <> leader")
    pairs = checkpointed(_few(met.groupBy(F.col("leader").alias("u"), F.col("rep").alias("v")).agg(F.max("n").alias("n")), several))
    links = _few(checkpointed(verified(pairs.select("u", "v"), sets, threshold)), several)
    label = components(links, links.count())
    # Texts that their bucket's leader isn't linked to, in buckets of three or more, and all texts of such a leader's buckets.
    of = label.select("node", "component")
    marked = pairs.join(_little(of.toDF("u", "cu"), several), "u", "left").join(_little(of.toDF("v", "cv"), several), "v", "left")
    marked = checkpointed(marked.select("u", "v", ((F.col("n") > 2) & (F.coalesce("cu", "u") != F.coalesce("cv", "v"))).alias("apart")))
    apart = marked.filter("apart").select(F.col("v").alias("doc_id")).distinct()
    leaders = checkpointed(marked.filter("apart").select("u").distinct())
    open_ = marked.join(_little(leaders, leaders.count()), "u", "left_semi").select(F.col("v").alias("doc_id")).union(leaders).distinct()
    more = prefix_pairs(sets.join(open_, "doc_id", "left_semi"), apart, threshold)
    # Pairs that are one class already need no look.
    more = more.join(of.toDF("u", "cu"), "u", "left").join(of.toDF("v", "cv"), "v", "left").filter("cu is null or cv is null or cu <> cv").select("u", "v")
    found = _few(checkpointed(verified(more, sets, threshold)), several)
    if not found.isEmpty():
        links = links.union(found)
        label = components(links, several)
    # Copies take their text's class, all else has its own: no join meets a key that many rows share.
    of = label.select("node", "component")
    copied = copies.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("text_id", F.coalesce("component", "rep").alias("copied"))
    out = rows.select("doc_id", "text_id")
    if repeated:
        out = out.select("doc_id").join(known.select("doc_id", "text_id"), "doc_id", "left")
    out = out.join(F.broadcast(copied) if few_copies else copied, "text_id", "left").join(of, F.col("doc_id") == F.col("node"), "left")
    return out.select(F.col("doc_id").alias(id_col), F.when(F.col("doc_id").isNotNull(), F.coalesce("copied", "component", "doc_id")).alias("class_id"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each class, that of the least id; rows without an id stay."""
    classes = checkpointed(near_duplicates(docs, threshold=threshold))
    out = without(docs, classes.filter("doc_id <> class_id").select("doc_id"))
    again = classes.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        return out
    return out.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(out.filter("doc_id is null"))
