"""Operator 8: a quality classifier on supervised subword embeddings.

Each word and each of its character 3- and 4-grams (with word ends marked) is hashed to a row
of an embedding table, each pair of neighbouring words to a row of a second part of it. A
document is the mean of the rows of all its features, and a softmax over that mean gives the
label. Embeddings and softmax are learned together by plain stochastic gradient descent in
numpy, on a bounded sample of labelled rows; scoring is narrow.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, held_out, id_type, table
from .toxicity import training_rows

ROWS, PAIRS, DIM, GRAMS = 1 << 15, 1 << 15, 10, (3, 4)
ALL_ROWS = ROWS + PAIRS
#: A scorer keeps so many words, and so many characters of them.
WORDS_KEPT, CHARS_KEPT = 200_000, 40_000_000
#: Words are hashed so many characters at a time, longer ones in slices of so many bytes.
SLICE = 1 << 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MULTIPLIER
    return ((h >> np.uint64(32)) % np.uint64(ROWS)).astype(np.int64)


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for k in range(n):
        h = h * np.uint64(1_000_003) + data[k : k + len(h)]
    return h + np.uint64(n)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """The rows of neighbouring words whose hashes stand one after the other. A word that repeats its neighbour is paired as a repeat, whichever word it is."""
    h = np.where(hashes[1:] == hashes[:-1], np.uint64(0), hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[1:])
    h = (h ^ (h >> np.uint64(29))) * MULTIPLIER
    return ROWS + ((h >> np.uint64(32)) % np.uint64(PAIRS)).astype(np.int64)


def _powers(at: np.ndarray) -> np.ndarray:
    return MULTIPLIER ** (at.astype(np.uint64) + np.uint64(1))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all features of the words, word by word, how many each word has, and the words' hashes."""
    coded = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts, owner = ends - sizes, np.repeat(np.arange(len(coded)), sizes)
    powers = _powers(np.arange(len(data)) - np.repeat(starts, sizes))
    whole = np.add.reduceat((data + np.uint64(7)) * powers, starts) if len(coded) else np.zeros(0, np.uint64)
    rows, owners = [_mix(whole)], [np.arange(len(coded))]
    for n in GRAMS:
        h = _grams(data, n)
        inside = owner[: len(h)] == owner[len(owner) - len(h) :]
        rows.append(_mix(h[inside]))
        owners.append(owner[: len(h)][inside])
    row, own = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return row[order], np.bincount(own, minlength=len(coded)), whole


def long_features(word: str) -> tuple[np.ndarray, np.ndarray]:
    """How often features() gives each row for one word of any length, and the word's hash: a slice of its bytes at a time."""
    coded, whole, total = b"<" + word.encode("utf-8", "replace") + b">", np.zeros(1, np.uint64), np.zeros(ALL_ROWS, np.int64)
    for at in range(0, len(coded), SLICE):
        data = np.frombuffer(coded[at : at + SLICE + max(GRAMS) - 1], np.uint8).astype(np.uint64)
        own = data[:SLICE]
        whole += ((own + np.uint64(7)) * _powers(np.arange(at, at + len(own)))).sum()
        for n in GRAMS:
            total += np.bincount(_mix(_grams(data[: SLICE + n - 1], n)), minlength=ALL_ROWS)
    total[_mix(whole)] += 1
    return total, whole


def portions(words: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of words with SLICE characters at most, longer words alone."""
    start, held = 0, 0
    for i, w in enumerate(words):
        if i > start and held + len(w) > SLICE:
            yield start, i
            start, held = i, 0
        held += len(w)
    if words:
        yield start, len(words)


def tally(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature rows of a whole text and how often each is there."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, where = np.unique(np.array(words, dtype=object), return_inverse=True)
    distinct, times, total = list(distinct), np.bincount(where), np.zeros(ALL_ROWS, np.int64)
    hashes = np.zeros(len(distinct), np.uint64)
    for a, b in portions(distinct):
        if len(distinct[a]) > SLICE:
            counts, hashes[a:b] = long_features(distinct[a])
            total += times[a] * counts
        else:
            row, per, hashes[a:b] = features(distinct[a:b])
            np.add.at(total, row, np.repeat(times[a:b], per))
    total += np.bincount(_pairs(hashes[where]), minlength=ALL_ROWS)
    found = np.flatnonzero(total)
    return found, total[found]


def bag(text: str) -> np.ndarray:
    """Feature rows of a whole text, with repeats."""
    return np.repeat(*tally(text))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = 6, rate: float = 0.3, seed: int = 7) -> dict:
    """bags: distinct rows and their shares for each document. Learns one document a step."""
    rng = np.random.default_rng(seed)
    table_, out = rng.uniform(-1 / DIM, 1 / DIM, (ALL_ROWS, DIM)), np.zeros((DIM, 2))
    bias = np.log(np.bincount(labels, minlength=2) + 1.0)
    bias -= bias.mean()
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            row, share = bags[i]
            now = rate * (1 - done / steps)
            done += 1
            if not len(row):
                continue
            hidden = share @ table_[row]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= now * np.outer(hidden, p)
            bias -= 0.1 * now * p
            # Means over many features move little in a step; the rate of the table makes up for it.
            table_[row] -= (now * 20) * share[:, None] * back
    return {"table": table_.astype(np.float32), "out": out, "bias": bias}


def fit_quality(rows: DataFrame, *, max_rows: int = 6_000) -> dict:
    """A model from text and label (0 or 1); max_rows texts at most, those whose hashes are least.

    Bags of features come to the driver: the bound on rows is the bound on what it holds.
    """

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                found = [tally(t or "") for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"label": b.column("label").cast("int32"), "row": pa.array([x.astype(np.uint16).tobytes() for x, _ in found], "binary"), "times": pa.array([n.astype(np.uint32).tobytes() for _, n in found], "binary")})

    chosen = rows.filter(F.col("label").isin(0, 1)).orderBy(F.md5(F.coalesce("text", F.lit(""))), "label").limit(max_rows).repartition(8)
    # The order of what comes back isn't fixed, that of learning is.
    got = sorted((bytes(r["row"]), bytes(r["times"]), r["label"]) for r in chosen.mapInArrow(bags, "label int, row binary, times binary").collect())
    if not got:
        return {"table": np.zeros((ALL_ROWS, DIM), np.float32), "out": np.zeros((DIM, 2)), "bias": np.zeros(2)}
    pairs = []
    for row, times, _ in got:
        n = np.frombuffer(times, np.uint32).astype(np.float64)
        pairs.append((np.frombuffer(row, np.uint16).astype(np.int64), n / max(1.0, n.sum())))
    return train(pairs, np.array([x[2] for x in got]))


class Scorer(dict):
    """As a dict: words to rows of a matrix of their summed vectors; emptied when it holds too many."""

    def __init__(self, model: dict):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.sums, self.sizes, self.used, self.chars = np.zeros((1024, DIM), np.float32), np.zeros(1024, np.float32), 0, 0
        self.hashes = np.zeros(1024, np.uint64)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if not new:
            return
        if len(self) + len(new) > WORDS_KEPT or self.chars + sum(map(len, new)) > CHARS_KEPT:
            self.forget()
            new = list(words)
        new.sort()
        self.chars += sum(map(len, new))
        sums, per, hashes = np.zeros((len(new), DIM), np.float32), np.zeros(len(new), np.int64), np.zeros(len(new), np.uint64)
        for a, b in portions(new):
            if len(new[a]) > SLICE:
                total, hashes[a:b] = long_features(new[a])
                sums[a], per[a] = total @ self.model["table"].astype(np.float64), total.sum()
            else:
                row, per[a:b], hashes[a:b] = features(new[a:b])
                sums[a:b] = np.add.reduceat(self.model["table"][row], np.cumsum(per[a:b]) - per[a:b], axis=0)
        need = self.used + len(new)
        if need > len(self.sizes):
            more = max(need, 2 * len(self.sizes)) - len(self.sizes)
            self.sums = np.concatenate([self.sums, np.zeros((more, DIM), np.float32)])
            self.sizes = np.concatenate([self.sizes, np.zeros(more, np.float32)])
            self.hashes = np.concatenate([self.hashes, np.zeros(more, np.uint64)])
        self.sums[self.used : need], self.sizes[self.used : need], self.hashes[self.used : need] = sums, per, hashes
        self.update(zip(new, range(self.used, need), strict=True))
        self.used = need

    def score(self, texts: list[str]) -> list[float]:
        out = []
        for at in range(0, len(texts), 100):
            split = [t.split() for t in texts[at : at + 100]]
            self.learn(set().union(*split))
            for words in split:
                hidden = np.zeros(DIM)
                if words:
                    idx = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
                    total = self.sums[idx].sum(axis=0, dtype=np.float64) + self.model["table"][_pairs(self.hashes[idx])].sum(axis=0, dtype=np.float64)
                    hidden = total / (self.sizes[idx].sum(dtype=np.float64) + len(idx) - 1)
                z = hidden @ self.model["out"] + self.model["bias"]
                out.append(float(1 / (1 + np.exp(np.clip(z[0] - z[1], -500, 500)))))
        return out


def score_quality(docs: DataFrame, model: dict, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and score (0 to 1) for each row of docs.

    Null and empty texts score what the softmax gives without features (the share of good rows
    learned from); repeated rows are scored one by one; further columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    held: list[Scorer] = []

    def of(texts: list[str]) -> list[tuple]:
        if not held:
            held.append(Scorer(pickle.loads(shared.value)))
        return [(s,) for s in held[0].score(texts)]

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind, arrow = id_type(rows, "doc_id")
    schema = pa.schema([("doc_id", arrow), ("score", "float64")])
    return rows.mapInArrow(by_rows(of, schema), f"doc_id {kind}, score double").withColumnRenamed("doc_id", id_col)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(training_rows(docs, table(spark, sf_dir, "labels"), "quality", rows=6_000))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
