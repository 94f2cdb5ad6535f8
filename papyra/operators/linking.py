"""Entities and relations: ontology lookup, review rules, templates, ranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType
from pyspark.sql.window import Window as W

from ..functions.scalars import dot, round4
from ..functions.text import label_pattern, mentions, normal_key

#: Bytes of a vocabulary, template or query table up to which it is broadcast.
SMALL_BYTES = 32 << 20


def _bytes(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        each = F.lit(8) if not isinstance(inner, (StringType, BinaryType, ArrayType, StructType, MapType)) else None
        total = F.size(column) * each if each is not None else F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, inner))
        return F.coalesce(total, F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, MapType):
        return _bytes(F.map_keys(column), ArrayType(kind.keyType)) + _bytes(F.map_values(column), ArrayType(kind.valueType))
    return F.lit(8)


def size_of(df: DataFrame) -> int:
    """About how many bytes a table takes in memory: one aggregate over it."""
    row = sum((_bytes(df[f.name], f.dataType) for f in df.schema.fields), F.lit(16))
    return int(df.agg(F.sum(row.cast("long")).alias("n")).first()["n"] or 0)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint while its measured size is small; beyond it Spark chooses another join."""
    return F.broadcast(df) if size_of(df) <= SMALL_BYTES else df


def in_blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """df in as many parts as it takes for each to be small, each with a broadcast hint: a stated set of rows that meets all rows of another table without a join key, one scan of that table a part."""
    n = max(1, -(-size_of(df) // SMALL_BYTES))
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n))
    return [F.broadcast(df.filter(part == i) if n > 1 else df) for i in range(n)]


#: Bytes of vectors in one block, pairs that are scored at once, and how far a matrix product may be off.
BLOCK_BYTES, SCORED, OFF = 4 << 20, 2_000_000, 1e-9


def _packed(df: DataFrame, blocks: int, side: str) -> DataFrame:
    """type, size and {side}: vectors (id, type, v) of one type and length in blocks, sorted by id, with their norms. Vectors that are null, zero or hold nulls are left out."""
    v = F.col("v").cast("array<double>")
    rows = df.select("id", "type", v.alias("v"), F.sqrt(dot(v, v)).alias("n")).filter("n > 0")
    block = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(blocks)).alias("_b")
    return rows.groupBy("type", F.size("v").alias("size"), block).agg(F.array_sort(F.collect_list(F.struct("id", "n", "v"))).alias(side)).drop("_b")


def _best(of: np.ndarray, on: np.ndarray, a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray, k: int, least: float) -> tuple[np.ndarray, ...]:
    """Places in a, places in b, cosines: for each vector of a the k nearest of b with another number (of, on), ties by place. A matrix product finds all that may be among them; these are scored term by term."""
    near = (a / an[:, None]) @ (b / bn[:, None]).T
    near[np.isnan(near)] = np.inf
    near[of[:, None] == on[None, :]] = -np.inf
    bound = np.partition(near, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(a), -np.inf)
    i, j = np.nonzero((near >= np.maximum(bound, least)[:, None] - OFF) & (near > -np.inf))
    step = max(1, SCORED // a.shape[1])
    dots = [np.cumsum(a[i[t : t + step]] * b[j[t : t + step]], axis=1)[:, -1] for t in range(0, len(i), step)]
    score = np.concatenate(dots) / (an[i] * bn[j]) if dots else np.empty(0)
    order = np.lexsort((j, -np.where(np.isnan(score), np.inf, score), i))
    order = order[(score[order] >= least) | np.isnan(score[order])]
    i, j, score = i[order], j[order], score[order]
    first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, bool)
    place = np.arange(len(i))
    kept = place - np.maximum.accumulate(np.where(first, place, 0)) < k
    return i[kept], j[kept], score[kept]


def nearest(many: DataFrame, few: DataFrame, *, k: int, least: float, of_few: bool) -> DataFrame:
    """of, id, score: for each vector of ``many`` (or of_few: of ``few``) the k of greatest cosine of the other table that have its type, from each pair of blocks; the best of these are the best of all. Both have id, type, v.

    ``many`` lies in blocks, ``few`` is sent to it in parts of a measured size; pairs are matrix
    products of two blocks, of which a task sends k a vector at most.
    """
    kind = many.schema["id"].dataType
    schema = pa.schema([("of", to_arrow_type(kind)), ("id", to_arrow_type(kind)), ("score", "float64")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                sides = [batch.column(c)[n].values for c in ("few", "many")]
                x, y = sides if of_few else sides[::-1]
                ids = [s.field("id") for s in (x, y)]
                codes = pa.concat_arrays([i.cast(schema.field("id").type) for i in ids]).dictionary_encode().indices.to_numpy()
                norms = [s.field("n").to_numpy() for s in (x, y)]
                a, b = (s.field("v").flatten().to_numpy().reshape(len(s), -1) for s in (x, y))
                step = max(1, SCORED // len(b))
                for t in range(0, len(a), step):
                    i, j, score = _best(codes[: len(a)][t : t + step], codes[len(a) :], a[t : t + step], norms[0][t : t + step], b, norms[1], k, least)
                    yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(i + t)).cast(schema.field("of").type), ids[1].take(pa.array(j)).cast(schema.field("id").type), pa.array(score)], schema=schema)

    blocks = lambda df: max(1, -(-size_of(df.select("v")) // BLOCK_BYTES))
    held = _packed(many, max(blocks(many), many.sparkSession.sparkContext.defaultParallelism), "many")
    parts = [F.broadcast(_packed(part, blocks(few), "few")) for part in in_blocks(few, "id")]
    met = reduce(DataFrame.union, [held.join(part, ["type", "size"]).select("few", "many") for part in parts])
    return met.mapInArrow(run, f"of {kind.simpleString()}, id {kind.simpleString()}, score double")


def resolve(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entities (label, ...) with canonical_id, match_type: by normalised alias; the last alias row (ord) of a key wins; else new."""
    index = aliases.groupBy(normal_key(F.col("alias")).alias("_key")).agg(F.max_by("canonical_id", "ord").alias("canonical_id"))
    out = entities.withColumn("_key", normal_key(F.col("label"))).join(small(index), "_key", "left").drop("_key")
    return out.withColumn("match_type", F.when(F.col("canonical_id").isNotNull(), "exact_alias").otherwise("new"))


def review_status(match_type: Column, confidence: Column, accepted: Column, before: Column) -> Column:
    """Rejected stays; accepted matches from 0.70 and alias matches from 0.85 are approved; approved stays; else pending."""
    matched = match_type.isin("exact_alias", "embedding")
    return F.when(F.lower(before) == "rejected", "rejected").when(F.coalesce(accepted, F.lit(False)) & matched & (confidence >= 0.70), "approved").when((match_type == "exact_alias") & (confidence >= 0.85), "approved").when(F.lower(before) == "approved", "approved").otherwise("pending")


def salience(confidence: Column) -> Column:
    return F.when(confidence >= 0.88, "central").when(confidence >= 0.70, "supporting").when(confidence >= 0.55, "background").otherwise("passing")


def text_confidence(text: Column, label: str | Column) -> Column:
    """Confidence in a label by how often a text mentions it (or else its initials), more where that is early and where its short form stands behind it."""
    label = F.lit(label) if isinstance(label, str) else label
    n = mentions(text, label)
    base = F.when(n >= 8, 0.86).when(n >= 4, 0.78).when(n >= 2, 0.70).when(n >= 1, 0.62).otherwise(0.52)
    low, pattern = F.lower(F.coalesce(text, F.lit(""))), label_pattern(F.lower(label))
    early = F.when(F.regexp_count(F.substring(low, 1, 5000), pattern) > 0, 0.04).otherwise(0.0)
    short = F.when(F.regexp_count(low, F.concat(pattern, F.lit(r"\s*\([a-z0-9-]{2,8}\)"))) > 0, 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(0.93), base + early + short), 2)


def kg_layer(entities: DataFrame, *, core: Iterable[str] = (), detail: Iterable[str] = ()) -> DataFrame:
    """entities (label, review_status, source_type, salience) with kg_layer (core or detail) and kg_block_reason."""
    key = normal_key(F.col("label"))
    is_core, is_detail = key.isin(*core) if core else F.lit(False), key.isin(*detail) if detail else F.lit(False)
    reason = F.when(F.col("review_status") != "approved", "not_approved").when(is_detail, "detail_or_parameter_mention").when(F.col("source_type").isin("background", "generic_field") & (F.col("salience") != "central") & ~is_core, "background_detail")
    return entities.withColumn("kg_block_reason", reason).withColumn("kg_layer", F.when(F.col("kg_block_reason").isNull(), "core").otherwise("detail"))


def relations_from_templates(entities: DataFrame, templates: DataFrame) -> DataFrame:
    """paper_id, subj, rel, obj: templates (subj, rel, obj) both of whose ends a paper (paper_id, key) has."""
    e = entities.select("paper_id", "key").distinct()
    first = e.join(small(templates), F.col("key") == F.col("subj")).select("paper_id", "subj", "rel", "obj")
    return first.join(e, (first["paper_id"] == e["paper_id"]) & (first["obj"] == e["key"]), "left_semi")


# How much sources of relations are trusted.
SOURCE_PRIORITY = {"deterministic_relation": 3, "llm_relation": 2, "candidate_relation": 1}


def best_relations(relations: DataFrame) -> DataFrame:
    """One relation per (subject_id, relation_type, object_id): approved before others, then by source, confidence and length of evidence; the first (ord) of equals."""
    source = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in SOURCE_PRIORITY.items()], F.lit(0))
    rank = F.struct((F.lower("review_status") == "approved").cast("int"), source, F.coalesce("confidence", F.lit(0.0)), F.length(F.coalesce("evidence_span", F.lit(""))), -F.col("ord"))
    keys = ["subject_id", "relation_type", "object_id"]
    rest = [c for c in relations.columns if c not in keys]
    return relations.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("b")).select(*keys, *[F.col(f"b.{c}") for c in rest])


def align_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Approved relations with an end (paper_id, canonical_id of entities) that may not be written become pending candidates of 0.65 at most."""
    ids = entities.select("paper_id", "canonical_id").distinct()
    s = ids.select("paper_id", F.col("canonical_id").alias("subject_id"), F.lit(True).alias("_s"))
    o = ids.select("paper_id", F.col("canonical_id").alias("object_id"), F.lit(True).alias("_o"))
    j = relations.join(s, ["paper_id", "subject_id"], "left").join(o, ["paper_id", "object_id"], "left")
    blocked = (F.lower("review_status") == "approved") & (F.col("_s").isNull() | F.col("_o").isNull())
    new = {"review_status": F.when(blocked, "pending").otherwise(F.col("review_status")), "source": F.when(blocked, "candidate_relation").otherwise(F.col("source")), "confidence": F.when(blocked, F.least(F.coalesce("confidence", F.lit(0.65)), F.lit(0.65))).otherwise(F.col("confidence")), "kg_block_reason": F.when(blocked, "relation_endpoint_not_kg_writeable")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in relations.columns], new["kg_block_reason"].alias("kg_block_reason"))


def compatible_topk(entities: DataFrame, seeds: DataFrame, *, k: int = 5, least: float = 0.78, merge: float = 0.92) -> DataFrame:
    """id, rank, seed_id, score, auto_merge: the k most similar seeds of an entity's type. Both sides have id, type, v; see nearest()."""
    s = nearest(entities, seeds, k=k, least=least, of_few=False).select(F.col("of").alias("id"), F.col("id").alias("seed_id"), "score")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "seed_id"))
    return s.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "seed_id", round4(F.col("score")).alias("score"), ((F.col("rank") == 1) & (F.col("score") >= merge)).alias("auto_merge"))


def first_spelling(labels: DataFrame) -> DataFrame:
    """label of each lower-cased label (label, ord) of two characters or more: the spelling seen first."""
    clean = F.trim(F.regexp_replace("label", "[ \\t\\r\\n]+", " "))
    return labels.select(clean.alias("label"), "ord").filter(F.length("label") >= 2).groupBy(F.lower("label").alias("key")).agg(F.min_by("label", "ord").alias("label"))


def sampled_chunks(chunks: DataFrame, *, most: int = 8) -> DataFrame:
    """chunks (doc_id, k from 0) of documents with more than ``most``: those at even steps from the first to the last, half steps to the even side."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(float(most - 1))).cast("long"))
    return chunks.withColumn("n", n).filter((F.col("n") <= most) | F.array_contains(at, F.col("k").cast("long"))).drop("n")
