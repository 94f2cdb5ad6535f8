"""Record deduplication: by first key, in sequence by DOI and title, by similar labels."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_doi
from ..functions.text import normal_key
from ..shared import kept


def first_per_key(rows: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """The first row of each key."""
    rest = list(rows.columns)
    return rows.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*rest), order).alias("b")).select(*[F.col(f"b.{c}") for c in rest])


#: Records in play up to which one task finishes what rounds have left.
FEW = 50_000


def _in_sequence(rows: Iterable[dict]) -> dict[int, tuple[int, int]]:
    """Groups after the rows (ord, d, t, v, and what is known before: gd, vd, gt, vt) in order: group -> (version, survivor), for those that change."""
    rows = sorted(rows, key=lambda r: r["ord"])
    of, version, out = {}, {}, {}
    for r in rows:
        for key, g, v in ((r["d"], r["gd"], r["vd"]), (r["t"], r["gt"], r["vt"])):
            if g is not None:
                of[key], version[g] = g, v
    for r in rows:
        keys = [k for k in (r["d"], r["t"]) if k is not None]
        g = next((of[k] for k in keys if k in of), None)
        if g is None:
            g = r["ord"]
        elif r["v"] <= version[g]:
            continue
        version[g] = r["v"]
        out[g] = (r["v"], r["ord"])
        of.update(dict.fromkeys(keys, g))
    return out


def _known(todo: DataFrame, keys: DataFrame, groups: DataFrame) -> DataFrame:
    """todo with the groups of its keys and their versions: gd, vd, gt, vt."""
    state = keys.join(groups.select("g", "version"), "g")
    of = lambda k: state.select(F.col("key").alias(k), F.col("g").alias(f"g{k}"), F.col("version").alias(f"v{k}"))
    return todo.join(of("d"), "d", "left").join(of("t"), "t", "left").select("ord", "d", "t", "v", "gd", "vd", "gt", "vt")


def _open(x: DataFrame) -> DataFrame:
    """x without rows that can only be dropped, whatever comes of those before them.

    A DOI never leaves its group, and a group's version only grows, so a row of a known DOI that
    isn't newer goes. A row that will go by its title (``safe``: no DOI, or the first open row of
    one that isn't known) goes likewise, while no earlier row of this title can take the title elsewhere.
    """
    firsts = x.filter("d is not null").groupBy("d").agg(F.min("ord").alias("_first"))
    x = x.join(firsts, "d", "left").withColumn("_safe", F.col("d").isNull() | (F.col("gd").isNull() & (F.col("ord") == F.col("_first"))))
    moving = x.filter("not _safe and t is not null").groupBy("t").agg(F.min("ord").alias("_moves"))
    x = x.join(moving, "t", "left")
    by_title = F.col("_safe") & (F.col("v") <= F.col("vt")) & (F.col("_moves").isNull() | (F.col("ord") < F.col("_moves")))
    gone = F.coalesce(F.col("v") <= F.col("vd"), F.lit(False)) | F.coalesce(by_title, F.lit(False))
    return x.filter(~gone).select("ord", "d", "t", "v", "gd", "vd", "gt", "vt")


def _decided(y: DataFrame) -> DataFrame:
    """Rows before which no open row has one of their keys or groups: what they meet is final. Least places are aggregates, so a key of many rows is no one's task."""
    key, group = lambda c: F.concat(F.lit(b"k"), c), lambda c: F.encode(F.concat(F.lit("g"), F.col(c).cast("string")), "UTF-8")
    parts = F.array_compact(F.array(key("d"), key("t"), group("gd"), group("gt")))
    rows = y.withColumn("_parts", F.array_distinct(parts))
    least = rows.select("ord", F.explode("_parts").alias("part")).groupBy("part").agg(F.min("ord").alias("_o"))
    won = least.groupBy("_o").agg(F.count("*").alias("_n"))
    return rows.join(won, F.col("ord") == F.col("_o")).filter(F.col("_n") == F.size("_parts")).select(*y.columns)


def _keyed(records: DataFrame) -> DataFrame:
    """ord, d, t, v of records: 128 bits of SHA-256 stand for a DOI and for a title, which may be as long as a text and moves many times. Normal forms are columns of their own, as they are looked at twice."""
    r = records.select("ord", normal_doi(F.col("doi")).alias("d"), normal_key(F.col("title")).alias("t"), F.coalesce(F.col("version").cast("int"), F.lit(1)).alias("v"))
    key = lambda kind, c: F.when(F.col(c) != "", F.substring(F.unhex(F.sha2(F.concat(F.lit(kind), c), 256)), 1, 16)).alias(c)
    return r.select("ord", key("d:", "d"), key("t:", "t"), "v")


def dedup_records(records: DataFrame, *, few: int = FEW) -> DataFrame:
    """Records (ord, doi, title, version) that are left when each in turn is matched by DOI, else title, with those kept before, and the higher version (the earlier of equals) stays.

    Keys belong to groups, each with a survivor. A record that wins gives its keys to the group
    that it matched (so a title may change groups, a DOI never does); one that loses gives none. Null
    and empty keys match nothing, and records without keys all stay; a null version is 1.

    The rule is sequential, but only for records that meet: in each round those go that can only
    lose, then all records are decided at once before which no open record has a key or group of theirs.
    A key that a third of all records share needs a round for each rise of its version. The last
    ``few`` records are one task's.
    """
    spark = records.sparkSession
    r = kept(_keyed(records))
    free = r.filter("d is null and t is null").select("ord")
    todo = r.filter("d is not null or t is not null")
    keys, groups = spark.createDataFrame([], "key binary, g long"), spark.createDataFrame([], "g long, version int, survivor long")
    while (n := todo.count()) > few:
        y = kept(_open(_known(todo, keys, groups)))
        done = kept(_decided(y).withColumn("g", F.coalesce("gd", "gt", "ord")).withColumn("wins", F.coalesce(F.col("v") > F.coalesce("vd", "vt"), F.lit(True))))
        won = done.filter("wins")
        new = won.select(F.explode(F.array_compact(F.array("d", "t"))).alias("key"), "g")
        groups = kept(groups.union(won.select("g", "v", "ord")).groupBy("g").agg(F.max("version").alias("version"), F.max_by("survivor", "version").alias("survivor")))
        keys = kept(keys.join(new.select("key"), "key", "left_anti").union(new))
        todo = kept(y.join(done.select("ord"), "ord", "left_anti").select("ord", "d", "t", "v"))
    survivors = groups.select("g", "version", "survivor")
    if n:

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            return pd.DataFrame([(g, v, o) for g, (v, o) in _in_sequence(rows).items()], columns=["g", "version", "survivor"])

        last = _known(todo, keys, groups).groupBy(F.lit(True).alias("all")).applyInPandas(finish, "g long, version int, survivor long")
        survivors = survivors.union(last).groupBy("g").agg(F.max_by("survivor", "version").alias("survivor"))
    left = survivors.select(F.col("survivor").alias("ord"))
    return records.join(left.union(free), "ord", "left_semi")


#: How alike labels must be to be one method, within a source type and across two.
ALIKE, ALIKE_ACROSS = 0.75, 0.9


def _alike(a: dict, b: dict) -> bool:
    apart = None not in (types := (a["source_type"] or None, b["source_type"] or None)) and types[0] != types[1]
    return SequenceMatcher(None, b["label"].lower(), a["label"].lower()).ratio() > (ALIKE_ACROSS if apart else ALIKE)


def _filled(first: dict, second: dict) -> dict:
    """One method of two: that of the longer description (the first of equals), its gaps filled from the other."""
    by_length = sorted((first, second), key=lambda m: -len(m["description"] or ""))
    return {c: next((m[c] for m in by_length if m[c] not in (None, "")), by_length[0][c]) for c in first} | {"merged": first["merged"] + second["merged"]}


def _folded(kept: list[dict], row: dict) -> list[dict]:
    place = next((i for i, k in enumerate(kept) if _alike(k, row)), len(kept))
    return [*kept[:place], _filled(kept[place], row) if place < len(kept) else row, *kept[place + 1 :]]


def dedup_methods(methods: DataFrame) -> DataFrame:
    """Methods (paper_id, ord, label, source_type, description) of each paper, alike labels merged in order (more alike if their source types differ): the longer description stays, its gaps are filled; merged counts the rows in it. A paper's methods are a list that an extraction wrote, tens of rows. Rows without a label are left out."""
    m = methods.filter(F.trim("label") != "").select("paper_id", "ord", "label", "source_type", "description", F.lit(1).cast("long").alias("merged"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).sort_values("ord").to_dict("records")
        return pd.DataFrame(reduce(_folded, rows, []), columns=list(pdf.columns))

    return m.groupBy("paper_id").applyInPandas(fold, m.schema)


#: Labels that are embedded at once.
EMBEDDED = 2_000


def embedded(labels: list[str | None], dim: int = 1024) -> np.ndarray:
    """Unit vectors of labels: each distinct word's BLAKE2b digest names eight places and a sign for each; a label's words count in equal parts. A label without words is one word, an empty one a word of its own."""
    split = [re.findall("[a-z0-9]+", (t or "").lower()) or [(t or "").lower().strip() or "<empty>"] for t in labels]
    sizes = np.array([len(w) for w in split])
    number: dict[str, int] = {}
    which = np.array([number.setdefault(w, len(number)) for ws in split for w in ws], dtype=np.int64)
    digest = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in number), np.uint8).reshape(-1, 8, 2)
    place = (digest[:, :, 0].astype(np.int64) * 256 + digest[:, :, 1]) % dim
    sign = 1.0 - 2.0 * (digest[:, :, 0] % 2)
    owner = np.repeat(np.arange(len(labels)), sizes)
    at, share = owner[:, None] * dim + place[which], sign[which] / sizes[owner, None]
    out = np.bincount(at.ravel(), weights=share.ravel(), minlength=len(labels) * dim).reshape(len(labels), dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1.0)).astype(np.float32)


def hash_embedding(label: Column, dim: int = 1024) -> Column:
    """Deterministic unit vectors of labels, a batch at a time; each distinct label of a batch once."""

    @F.arrow_udf("array<float>")
    def embed(s: pa.Array) -> pa.Array:
        known = s.cast("string").dictionary_encode("encode")
        names, of = known.dictionary.to_pylist(), known.indices
        rows = np.concatenate([embedded(names[t : t + EMBEDDED], dim) for t in range(0, len(names), EMBEDDED)])
        whole = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * dim), pa.array(rows.ravel()))
        return whole.take(of)

    return embed(label)
