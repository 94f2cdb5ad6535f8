"""Operator 12: whitening by TSQR, without a covariance matrix.

Entries become whole numbers, so that sums per dimension are exact whatever the order. Rows are
centred with them (n*x - S is exact too) and each partition keeps the R factor of a QR of its
rows, batch by batch. R factors meet in rounds of a few at a time until one is left; its
singular values and right vectors are those of all rows. They turn rows into whitened ones.
What whitening has reached is measured on the whitened rows themselves, by partial moments
that are merged per entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, id_type, table

#: x = floor(SCALE * c) + SHIFT for each entry c.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: R factors that are merged in one task.
FAN = 32
#: Entries beyond this have no exact whole number in a double.
EXACT = 2.0**52
#: Eigenvalues below this share of the largest, times the dimension, are noise of the arithmetic.
NOISE = float(np.finfo(np.float64).eps)
LONG = 2**62


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of double) of rows whose vector is there and holds finite entries only; null ids stay."""
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].alias("vec_id"), v.alias("v")).filter("v is not null")
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Rows of a batch as floor(SCALE * c); SHIFT is added where x itself is asked for, as it falls out of differences."""
    m = np.floor(SCALE * batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    if np.abs(m).max(initial=0) > EXACT:
        raise ValueError(f"an entry beyond {EXACT / SCALE:.0f} has no exact whole number")
    return m.astype(np.int64)


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of floor(SCALE * c) of each dimension. Partitions send one row a dimension."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for b in batches:
            x = whole(b, dim)
            n += len(x)
            wide = x if np.abs(x).max(initial=0) < LONG // max(1, len(x)) else x.astype(object)
            sums = [a + int(c) for a, c in zip(sums, wide.sum(axis=0), strict=True)] if len(x) else sums
        if n:
            yield pa.RecordBatch.from_pydict({"k": list(range(dim)), "n": [n] * dim, "s": list(map(str, sums))}, schema=pa.schema([("k", "int32"), ("n", "int64"), ("s", "string")]))

    parts = rows.select("v").mapInArrow(partial, "k int, n long, s string")
    found = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row a dimension
    sums = {r["k"]: int(r["s"]) for r in found}
    return (int(found[0]["n"]) if found else 0), [sums.get(k, 0) for k in range(dim)]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exactly: int64 where that is wide enough, else Python's whole numbers."""
    widest = max(int(np.abs(x).max(initial=0)), max((abs(int(s)) for s in sums), default=0) // max(n, 1) + 1)
    kind = np.int64 if 2 * widest * n < LONG else object
    return x.astype(kind) * n - np.array([int(s) for s in sums], dtype=kind)


def r_factor(rows: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    return np.linalg.qr(rows if above is None else np.vstack([above, rows]), mode="r")


def _factors(batches: Iterable[np.ndarray]) -> np.ndarray | None:
    r = None
    for m in batches:
        if len(m):
            r = r_factor(m, r)
    return r


def tsqr(rows: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """R of all rows of x - S/n. A factor has dim rows at most, whatever the table's size."""
    schema = "part long, r binary"

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = np.array(sums, dtype=object)
        r = _factors((centred(whole(b, dim), n, s) / n).astype(np.float64) for b in batches)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], "int64"), pa.array([r.tobytes()], "binary")], names=["part", "r"])

    def merge(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("part").to_numpy(), kind="stable")
        stored = t.column("r").to_pylist()
        r = _factors(np.frombuffer(stored[i]).reshape(-1, dim) for i in order)
        return pa.table({"part": pa.array([int(t.column("part")[0].as_py()) // FAN], "int64"), "r": pa.array([r.tobytes()], "binary")})

    parts = checkpointed(rows.select("v").mapInArrow(own, schema))
    while parts.count() > 1:
        parts = checkpointed(parts.groupBy((F.col("part") / FAN).cast("long")).applyInArrow(merge, schema))
    return np.frombuffer(parts.first()["r"]).reshape(-1, dim)


class Whitener:
    """n, sums and the kept right vectors over their standard deviations; and shares of the variance."""

    def __init__(self, r: np.ndarray, n: int, sums: list[int], components: int):
        _, sigma, right = np.linalg.svd(r, full_matrices=False)
        values = sigma**2 / n
        trace = float(values.sum())
        kept = int((values > values.max(initial=0) * len(sums) * NOISE).sum()) if trace > 0 else 0
        kept = min(kept, components)
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.right = right[:kept].T / np.sqrt(values[:kept])
        self.explained = (values[:kept] / trace).tolist() if kept else []

    def differences(self, batch: pa.RecordBatch) -> np.ndarray:
        return centred(whole(batch, self.dim), self.n, np.array(self.sums, dtype=object))

    def apply(self, differences: np.ndarray) -> np.ndarray:
        return (differences / self.n).astype(np.float64) @ self.right


def deviations(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; null where it doesn't fit a long."""
    size = int(np.abs(d).max(initial=0))
    if size * size * max(1, d.shape[1]) < LONG:
        return np.einsum("ij,ij->i", d, d).tolist()
    sums = (d.astype(object) ** 2).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in sums]


def identity_error(rows: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity. Rows are centred by the mean of their partition, and partitions' moments are moved to the common mean; a row an entry is shuffled."""
    k = w.right.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moment = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                y = shared.value.apply(shared.value.differences(b))
                m, own = len(y), y.mean(axis=0)
                y, shift = y - own, own - mean
                moment += y.T @ y + np.outer(shift, shift) * (n * m / (n + m))
                mean, n = mean + shift * (m / (n + m)), n + m
        if n:
            i, j = (x.ravel() for x in np.indices((k, k)))
            yield pa.RecordBatch.from_arrays([pa.array(i, "int32"), pa.array(j, "int32"), pa.array(np.full(k * k, n), "int64"), pa.array(mean[i]), pa.array(mean[j]), pa.array(moment.ravel())], names=["i", "j", "n", "a", "b", "m"])

    parts = rows.select("v").mapInArrow(partial, "i int, j int, n long, a double, b double, m double")
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    moved = F.sum("m") + F.sum(n * a * b) - F.sum(n * a) * F.sum(n * b) / F.sum("n")
    entry = parts.groupBy("i", "j").agg((moved / F.sum("n") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("e"))
    return entry.agg(F.max(F.abs("e"))).first()[0] or 0.0


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or hold null or non-finite entries take no part; empty ones have no
    components and so no rows. Vectors of one length are fitted together, those of another by
    themselves. Repeated rows count each; null ids are passed on. Components without variance
    can't be scaled to one and are left out, so a table of equal vectors, or of one, gives no
    rows, as does an empty one. A deviation that doesn't fit a long is null. An entry so large
    that floor(64 * c) isn't exact in a double is an error. Further columns are left out,
    whatever their names.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    kind, arrow = id_type(rows, "vec_id")
    result = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = None
    for dim in sorted(r["dim"] for r in rows.filter("size(v) > 0").select(F.size("v").alias("dim")).distinct().collect()):  # one row a length
        part = _whitened(rows.filter(F.size("v") == dim), dim, components, kind, arrow)
        if part is not None:
            out = part if out is None else out.union(part)
    out = spark.createDataFrame([], result) if out is None else out
    return out.withColumnRenamed("vec_id", id_col)


def fitted(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitener:
    """The whitening transform of rows (vec_id, v) of one length."""
    n, sums = exact_sums(rows, dim)
    return Whitener(tsqr(rows, dim, n, sums), n, sums, components)


def _whitened(rows: DataFrame, dim: int, components: int, kind: str, arrow: pa.DataType) -> DataFrame | None:
    w = fitted(rows, dim, components)
    if not w.explained:
        return None
    error = identity_error(rows, w)
    shared = rows.sparkSession.sparkContext.broadcast(w)
    wide = rows.mapInArrow(_transform(shared, arrow), f"vec_id {kind}, deviation long, y array<double>")
    long = wide.select("vec_id", "deviation", F.posexplode("y").alias("k", "whitened"))
    shares = F.element_at(F.array(*map(F.lit, w.explained)), F.col("k") + 1)
    return long.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(float(error)).alias("identity_error"))


def _transform(shared, arrow: pa.DataType) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            d = w.differences(b)
            y = w.apply(d)
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(arrow), pa.array(deviations(d), "int64"), lists], names=["vec_id", "deviation", "y"])

    return run


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
