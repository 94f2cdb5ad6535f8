"""Operator 10: nearest neighbours through a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample: nodes are split by spherical k-means until few sample
vectors are left. Every row is put into a leaf by descending it. Leaves that then hold many
rows are split further on the executors, each from a bounded sample of its own rows, so that
leaves stay small as the table grows. A query descends too, keeping the branches it passes in a
priority queue, and goes on with the nearest branch: that gives the order in which it visits
leaves. How many it visits is calibrated: for some queries the true neighbours among all rows
are found by brute force, and the visits are widened until the leaves hold the wanted share of
them. (query, leaf) pairs then meet the rows of the leaf; scores are exact cosines in double
precision.

Both sides of a leaf come in blocks of bounded size, each of which is one task's group. Of rows
with one vector only the few of the least ids can be anybody's answer, so each batch sends no
more than these on: a vector that many rows share doesn't fill a leaf.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpointed, id_type, table

SAMPLE_ROWS, LEAF_ROWS, BRANCHES = 20_000, 80, 8
#: A leaf of more rows than this is split again, by a sample of so many of its rows, into about so many leaves.
SPLIT_ROWS, SPLIT_SAMPLE, SPLIT_LEAVES = 8_192, 2_000, 50
#: Rows and queries of a leaf that meet in one group, and the cells of their product that are looked at at once.
BLOCK_ROWS, BLOCK_QUERIES, CELLS = 2_048, 1_000, 200_000
CALIBRATION_QUERIES = 100


class Tree:
    """Nodes in one list: unit centre, children, and the leaf number of those without."""

    def __init__(self, sample: np.ndarray, leaf_rows: int = LEAF_ROWS, branches: int = BRANCHES, seed: int = 11):
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.rng = np.random.default_rng(seed)
        self._grow(sample, np.zeros(sample.shape[1]), leaf_rows, branches)
        self._settle()

    def _settle(self) -> None:
        self.centre = np.stack(self.centres)
        self.node_of = [i for i, c in enumerate(self.children) if not c]
        self.n_leaves = len(self.node_of)
        self.leaf = np.full(len(self.children), -1, np.int32)
        self.leaf[self.node_of] = np.arange(self.n_leaves)

    def _grow(self, rows: np.ndarray, centre: np.ndarray, leaf_rows: int, branches: int) -> int:
        node = len(self.children)
        self.children.append([])
        self.centres.append(centre)
        part = self._means(rows, branches) if len(rows) > leaf_rows else None
        if part is not None:
            owner, centres = part
            self.children[node] = [self._grow(rows[owner == k], c, leaf_rows, branches) for k, c in enumerate(centres)]
        return node

    def _means(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        distinct = np.unique(rows, axis=0)
        if len(distinct) < 2:
            return None
        centres = distinct[self.rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(12):
            owner = np.argmax(rows @ centres.T, axis=1)
            sums = np.stack([rows[owner == j].sum(axis=0) for j in range(len(centres))])
            size = np.linalg.norm(sums, axis=1)
            moved = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
            if np.allclose(moved, centres):
                break
            centres = moved
        owner = np.argmax(rows @ centres.T, axis=1)
        used = np.unique(owner)
        return (np.searchsorted(used, owner), centres[used]) if len(used) > 1 else None

    def graft(self, leaf: int, below: Tree) -> None:
        """Puts another tree in the place of a leaf; leaves have new numbers after settle()."""
        at = len(self.children) - 1
        self.children[self.node_of[leaf]] = [c + at for c in below.children[0]]
        self.children += [[c + at for c in x] for x in below.children[1:]]
        self.centres += below.centres[1:]

    def grafted(self, parts: Iterable[tuple[int, Tree]]) -> Tree:
        for leaf, below in parts:
            self.graft(leaf, below)
        self._settle()
        return self

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each unit row."""
        out, todo = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            below = self.children[node]
            if not below:
                out[at] = self.leaf[node]
                continue
            owner = np.argmax(rows[at] @ self.centre[below].T, axis=1)
            todo += [(c, at[owner == k]) for k, c in enumerate(below) if (owner == k).any()]
        return out

    def visits(self, queries: np.ndarray, n: int, sizes: dict[int, int], least: int = 0) -> Iterator[list[int]]:
        """For each query the first n leaves in the order that best-bin-first search meets them, and more until they hold ``least`` rows."""
        slice_ = max(1, 4_000_000 // len(self.centre))
        for at in range(0, len(queries), slice_):
            for near in (queries[at : at + slice_] @ self.centre.T).tolist():
                yield self._visits(near, n, sizes, least)

    def _visits(self, near: list[float], n: int, sizes: dict[int, int], least: int) -> list[int]:
        queue, out, held, children, push = [(0.0, 0)], [], 0, self.children, heapq.heappush
        while queue and (len(out) < n or held < least):
            node = heapq.heappop(queue)[1]
            while children[node]:
                best = max(children[node], key=near.__getitem__)
                for c in children[node]:
                    if c != best:
                        push(queue, (-near[c], c))
                node = best
            leaf = int(self.leaf[node])
            if sizes.get(leaf):
                out.append(leaf)
                held += sizes[leaf]
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of double): no null, non-finite or zero vectors and no null ids."""
    v: Column = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite).filter(F.exists("v", lambda x: x != 0))


def _lists(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _coded(rows: np.ndarray) -> pa.Array:
    """Rows of doubles as bytes: what they are in a shuffle, and cheap to read."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], "binary")


def _decoded(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.str_ if pa.types.is_string(column.type) else np.int64)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow where components are large
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _least_of_each(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows with the k least ids of each vector."""
    _, which = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, which))
    start = np.r_[True, np.diff(which[order]) != 0]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(start, at, 0)) < k]


def _top(q_rows: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, places of rows and exact scores of the k nearest rows of each query, not those of its own id. Rows are as they came on both sides: unit rows find the candidates, the rows themselves give the scores."""
    qu, ru, q_size, size = _unit(q_rows), _unit(rows), np.linalg.norm(q_rows, axis=1), np.linalg.norm(rows, axis=1)
    found: list[tuple] = []
    for lo in range(0, len(qu), max(1, CELLS // max(1, len(ru)))):
        q, own = qu[lo : lo + max(1, CELLS // max(1, len(ru)))], q_ids[lo : lo + max(1, CELLS // max(1, len(ru)))]
        s = np.where(own[:, None] == ids[None, :], -np.inf, q @ ru.T)
        kth = np.partition(s, len(ru) - k, axis=1)[:, len(ru) - k, None] if len(ru) > k else -np.inf
        i, j = np.nonzero((s >= kth - 1e-9) & (s > -np.inf))
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            exact = (rows[j] * q_rows[i + lo]).sum(axis=1) / (size[j] * q_size[i + lo])
        exact = np.where(np.isfinite(exact), exact, (ru[j] * q[i]).sum(axis=1))  # components beyond the range of a product
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        at = np.arange(len(i))
        first = np.maximum.accumulate(np.where(np.r_[True, np.diff(i) != 0], at, 0)) if len(i) else at
        keep = at - first < k
        found.append((i[keep] + lo, j[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows found for each query.

    The tree is fitted on sample_rows rows at most, those whose ids hash least; all rows are
    indexed. ``recall`` is the share of true neighbours that calibration asks for. Largest
    cosine first, ties to the smaller vec_id; rows of the query's own id are left out. Vectors
    that are null or zero, or that hold null or non-finite components, take no part; vectors of
    another length have no cosine with a query and are nobody's neighbours but their like's, so
    each length is searched by itself. Rows that share an id are one vector, the least of them
    by its components in order. Fewer rows than k give all of them; an empty table gives an
    empty one. Further columns are left out, whatever their names.
    """
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    kind, arrow = id_type(rows, "vec_id")
    result = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not vectors.groupBy(id_col).count().filter(F.col("count") > 1).isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
        asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    out = None
    for dim in sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect()):  # one row a length
        of = lambda df: df.filter(F.size("v") == dim)
        part = _nearest(of(rows), of(asked), dim, kind, arrow, k, recall, sample_rows, split_rows)
        out = part if out is None else out.union(part)
    return vectors.sparkSession.createDataFrame([], result) if out is None else out


def _nearest(rows: DataFrame, asked: DataFrame, dim: int, kind: str, arrow: pa.DataType, k: int, recall: float, sample_rows: int, split_rows: int) -> DataFrame:
    spark = rows.sparkSession
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    sample = _lists(picked.column("v").combine_chunks(), dim)
    tree = Tree(_unit(sample))
    indexed = checkpointed(_placed(rows, tree, dim, kind, arrow, k, coded=False))
    sizes = _sizes(indexed)
    crowded = [leaf for leaf, n in sizes.items() if n > split_rows]
    if crowded:
        tree = tree.grafted(_subtrees(indexed, crowded, dim))
        indexed = checkpointed(_placed(indexed, tree, dim, kind, arrow, k, coded=True))
        sizes = _sizes(indexed)
    first = picked.slice(0, CALIBRATION_QUERIES)
    visits = _calibrated(indexed, tree, _ids(first.column("vec_id")), sample[:CALIBRATION_QUERIES], sizes, k, recall)
    shared = spark.sparkContext.broadcast((tree, sizes))

    def order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sizes = shared.value
        for b in batches:
            m = _lists(b.column("v"), dim)
            leaves = pa.array(list(tree.visits(_unit(m), visits, sizes, k + 1)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _coded(m), leaves], names=["query_id", "v", "leaves"])

    asked = checkpointed(asked.repartition(spark.sparkContext.defaultParallelism).mapInArrow(order, f"query_id {kind}, v binary, leaves array<int>"))
    near = asked.select("query_id", "v", F.explode("leaves").alias("leaf"))
    # A row for each leaf of the tree: blocks of its rows and of its queries.
    wanted = {r["leaf"]: r["count"] for r in near.groupBy("leaf").count().collect()}
    blocks = [(leaf, -(-sizes[leaf] // BLOCK_ROWS), -(-n // BLOCK_QUERIES)) for leaf, n in wanted.items()]
    per_leaf = F.broadcast(spark.createDataFrame(blocks, "leaf int, row_blocks int, query_blocks int"))
    mine, every = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = near.join(per_leaf, "leaf").select("query_id", "v", "leaf", mine("query_id", "query_blocks").alias("q"), every("row_blocks").alias("r"))
    held = indexed.join(per_leaf, "leaf").select("vec_id", "v", "leaf", mine("vec_id", "row_blocks").alias("r"), every("query_blocks").alias("q"))
    schema = pa.schema([("query_id", arrow), ("vec_id", arrow), ("score", "float64")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, ids = _ids(left.column("query_id")), _ids(right.column("vec_id"))
        i, j, score = _top(_decoded(left.column("v"), dim), q_ids, _decoded(right.column("v"), dim), ids, k)
        return pa.table([pa.array(q_ids[i].tolist(), arrow), pa.array(ids[j].tolist(), arrow), pa.array(score)], schema=schema)

    keys = ("leaf", "r", "q")
    found = near.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, f"query_id {kind}, vec_id {kind}, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _placed(rows: DataFrame, tree: Tree, dim: int, kind: str, arrow: pa.DataType, k: int, coded: bool) -> DataFrame:
    """vec_id, v (the vector as bytes), leaf; of a batch's rows with one vector those of the k + 1 least ids, of which a query itself may be one."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = _ids(b.column("vec_id"))
                m = _decoded(b.column("v"), dim) if coded else _lists(b.column("v"), dim)
                at = np.sort(_least_of_each(ids, m, k + 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].tolist(), arrow), _coded(m[at]), pa.array(shared.value.assign(_unit(m[at])))], names=["vec_id", "v", "leaf"])

    return rows.select("vec_id", "v").mapInArrow(place, f"vec_id {kind}, v binary, leaf int")


def _sizes(indexed: DataFrame) -> dict[int, int]:
    """Rows of each leaf: one row a leaf of the tree."""
    return {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}


def _subtrees(indexed: DataFrame, crowded: list[int], dim: int) -> list[tuple[int, Tree]]:
    """A tree for each crowded leaf, fitted on the executors from SPLIT_SAMPLE rows of it at most. Leaves of one vector have none."""
    few = W.partitionBy("leaf").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = indexed.filter(F.col("leaf").isin(crowded)).withColumn("n", F.row_number().over(few)).filter(F.col("n") <= SPLIT_SAMPLE)

    def fit(t: pa.Table) -> pa.Table:
        m = _unit(_decoded(t.column("v"), dim))
        return pa.table({"leaf": t.column("leaf").slice(0, 1), "tree": pa.array([pickle.dumps(Tree(m, max(2, len(m) // SPLIT_LEAVES)))], "binary")})

    trees = sample.select("leaf", "v").groupBy("leaf").applyInArrow(fit, "leaf int, tree binary").collect()
    return [(r["leaf"], pickle.loads(r["tree"])) for r in trees]


def brute_force(indexed: DataFrame, q_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score, leaf of the k nearest of all rows (vec_id, v, leaf) for a bounded set of queries."""
    kind, arrow = id_type(indexed, "vec_id")
    shared = indexed.sparkSession.sparkContext.broadcast((q_ids, queries))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for b in batches:
            if b.num_rows:
                ids, leaf = _ids(b.column("vec_id")), b.column("leaf").to_numpy(zero_copy_only=False)
                i, j, score = _top(q, q_ids, _decoded(b.column("v"), q.shape[1]), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i].tolist(), arrow), pa.array(ids[j].tolist(), arrow), pa.array(score), pa.array(leaf[j])], names=["query_id", "vec_id", "score", "leaf"])

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = indexed.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score double, leaf int")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _calibrated(indexed: DataFrame, tree: Tree, q_ids: np.ndarray, queries: np.ndarray, sizes: dict[int, int], k: int, recall: float) -> int:
    """Leaves to visit so that the leaves of the true neighbours of these queries are among them often enough."""
    true = brute_force(indexed, q_ids, queries, k).select("query_id", "leaf").collect()
    of = {q: {leaf: i + 1 for i, leaf in enumerate(leaves)} for q, leaves in zip(q_ids.tolist(), tree.visits(_unit(queries), tree.n_leaves, sizes), strict=True)}
    needed = sorted(of[r["query_id"]][r["leaf"]] for r in true)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)
