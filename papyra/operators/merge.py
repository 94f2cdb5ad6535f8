"""Upserts and deletes as next-state DataFrames: the caller writes what they return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import blank_to_null


def latest_wins(rows: DataFrame, keys: list[str], order: list[str], *, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key by ``order``; columns in ``keep_first`` keep their least value (creation times). One shuffle with map-side aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    firsts = [F.min(c).alias(f"_first_{c}") for c in keep_first]
    out = rows.groupBy(*keys).agg(last, *firsts)
    return out.select(*[F.col(f"_first_{c}").alias(c) if c in keep_first else F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str, *, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """old and new merged by key; new rows win, later ones (by seq) over earlier ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_wins(both, keys, ["_new", seq], keep_first=keep_first).drop("_new")


def fill_missing(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with null or empty columns filled from the row of new with the same key; filled ones stay."""
    other = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(other, old[key] == other["_key"], "left")
    text = {f.name for f in old.schema.fields if f.dataType.typeName() == "string"}
    fill = {c: F.coalesce(blank_to_null(old[c]) if c in text else old[c], F.col(f"_{c}"), old[c]) for c in columns}
    return joined.select(*[fill[c].alias(c) if c in fill else old[c] for c in old.columns])


TERMINAL = ("completed", "failed", "skipped", "cancelled")


def item_state(events: DataFrame, keys: list[str], *, status: str = "status", ts: str = "ts", seq: str = "seq", started: str = "processing", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """State of job items from their status events: status (last), started (first start), completed (last terminal time), attempts (starts)."""
    is_start, is_end = F.col(status) == started, F.col(status).isin(*terminal)
    return events.groupBy(*keys).agg(F.max_by(status, F.struct(ts, seq)).alias("status"), F.min(F.when(is_start, F.col(ts))).alias("started"), F.max(F.when(is_end, F.col(ts))).alias("completed"), F.count_if(is_start).alias("attempts"))


def job_progress(items: DataFrame) -> DataFrame:
    """Counts and status of each job from the states of its items."""
    out = items.groupBy("job_id").agg(F.count("*").alias("papers_total"), F.count_if(F.col("status") == "completed").alias("papers_completed"), F.count_if(F.col("status") == "failed").alias("papers_failed"), F.count_if(F.col("status").isin(*TERMINAL)).alias("_done"))
    status = F.when(F.col("_done") < F.col("papers_total"), "processing").when(F.col("papers_failed") > 0, "completed_with_errors").otherwise("completed")
    return out.withColumn("status", status).drop("_done")


def review(queue: DataFrame, decisions: DataFrame, *, seq: str | None = None) -> DataFrame:
    """The queue with the decided statuses (id, review_status): of several decisions on an id the last by ``seq``, or without it the greatest status; decisions on unknown ids do nothing."""
    d = decisions.groupBy("id").agg((F.max_by("review_status", F.struct(seq, "review_status")) if seq else F.max("review_status")).alias("_status"))
    return queue.join(d, "id", "left").withColumn("review_status", F.coalesce("_status", "review_status")).drop("_status")


def pending_entities(extractions: DataFrame, lists: tuple[str, ...] = ("concepts", "methods")) -> DataFrame:
    """Entities of successful extractions that wait for review: paper_id, label, entity_type, canonical_id, confidence, evidence_span."""
    items = F.concat(*[F.coalesce(F.col(c), F.array().cast(extractions.schema[c].dataType)) for c in lists])
    rows = extractions.filter("extraction_status = 'success'").select("paper_id", F.explode(items).alias("x"))
    waiting = rows.filter((F.col("x.review_status") == "pending") & (F.trim("x.label") != ""))
    return waiting.select("paper_id", F.trim("x.label").alias("label"), "x.entity_type", F.coalesce(blank_to_null(F.col("x.canonical_id")), F.lower(F.trim("x.label"))).alias("canonical_id"), F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"), F.coalesce(*[blank_to_null(F.col(f"x.{c}")) for c in ("evidence_span", "context", "description")]).alias("evidence_span"))


def without_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """A delete: rows whose column isn't among ids (one column, any name)."""
    return rows.join(ids.toDF(column).distinct(), column, "left_anti").select(*rows.columns)


def delete_note(tables: dict[str, DataFrame], note_ids: DataFrame) -> dict[str, DataFrame]:
    """The note tables without these notes and all that hangs on them. Plain Parquet has no transaction over tables: write all, then swap."""
    threads = tables["note_ai_threads"].join(note_ids.toDF("note_id"), "note_id", "left_semi").select("id")
    out = {n: without_ids(t, note_ids, "id" if n == "notes" else "note_id") for n, t in tables.items() if n != "note_ai_messages"}
    if "note_ai_messages" in tables:
        out["note_ai_messages"] = without_ids(tables["note_ai_messages"], threads, "thread_id")
    return out


def update_notes(notes: DataFrame, edits: DataFrame, versions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(notes, versions) after edits (id, markdown): a changed text goes to versions first, and only changed notes get a new time."""
    e = edits.select("id", F.col("markdown").alias("_new"))
    joined = notes.join(e, "id", "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("markdown"))
    kept = joined.filter(changed).select(F.col("id").alias("note_id"), "markdown", now.alias("created_timestamp"))
    after = joined.withColumns({"updated_timestamp": F.when(changed, now).otherwise(F.col("updated_timestamp")), "markdown": F.when(changed, F.col("_new")).otherwise(F.col("markdown"))})
    return after.select(*notes.columns), versions.unionByName(kept, allowMissingColumns=True)


def restore_notes(notes: DataFrame, versions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(notes, versions) with each note's newest version put back; the current text becomes a version, so that a second restore toggles."""
    newest = versions.groupBy("note_id").agg(F.max_by("markdown", "created_timestamp").alias("markdown"))
    return update_notes(notes, newest.withColumnRenamed("note_id", "id"), versions, now)


def latest_status(rows: DataFrame, key: str, status: str, ts: str, tie: str, *, only: str | None = None) -> DataFrame:
    """key, status, ts of the newest row of each key (of those with status ``only``)."""
    r = rows if only is None else rows.filter(F.col(status) == only)
    best = F.max_by(F.struct(status, ts), F.struct(ts, tie)).alias("b")
    return r.groupBy(key).agg(best).select(key, F.col(f"b.{status}").alias(status), F.col(f"b.{ts}").alias(ts))


def latest_and_success(rows: DataFrame, key: str, status: str, ts: str, id_: str, *, success: str = "success") -> DataFrame:
    """key, latest (status), latest_ts, latest_success (id; null without one) of each key: both in one aggregate."""
    newest = F.struct(ts, id_)
    out = rows.groupBy(key).agg(F.max_by(status, newest).alias("latest"), F.max(ts).alias("latest_ts"), F.max_by(id_, F.when(F.col(status) == success, newest)).alias("latest_success"))
    return out.select(key, "latest", "latest_ts", "latest_success")


def best_extraction(rows: DataFrame, key: str = "paper_id") -> DataFrame:
    """The newest success of each paper, else its newest row."""
    w = W.partitionBy(key).orderBy((F.col("extraction_status") == "success").desc(), F.desc("extraction_timestamp"), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cleared(tables: dict[str, DataFrame], names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The tables of these names (all, if none are given) without their rows; the others as they are."""
    return {n: t.limit(0) if names is None or n in names else t for n, t in tables.items()}


def updated_if_changed(rows: DataFrame, edits: DataFrame, key: str, columns: list[str], now: Column, *, stamp: str = "updated_timestamp") -> DataFrame:
    """rows with the given columns of edits (null: as before); the time stamp moves only where a value changes."""
    e = edits.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(e, rows[key] == e["_key"], "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(rows[c]))
    new = {c: F.coalesce(F.col(f"_{c}"), rows[c]) for c in columns} | {stamp: F.when(changed, now).otherwise(rows[stamp])}
    return joined.select(*[new[c].alias(c) if c in new else rows[c] for c in rows.columns])


def superseded(jobs: DataFrame, ids: DataFrame, by: Column, now: Column) -> DataFrame:
    """jobs (job_id, status, superseded_by, updated_timestamp) of which these (job_id) have been replaced by another; jobs that were so already stay."""
    edits = ids.select("job_id").distinct().withColumns({"status": F.lit("superseded"), "superseded_by": by})
    return updated_if_changed(jobs, edits, "job_id", ["status", "superseded_by"], now)


def to_retry(items: DataFrame, *, most: int = 3) -> DataFrame:
    """Items (job_id, paper_id, status, attempts) that a resumed job takes up: those that never ended, and failed ones with attempts left."""
    return items.filter(F.col("status").isin("pending", "processing") | ((F.col("status") == "failed") & (F.coalesce("attempts", F.lit(0)) < most)))


def edited_projects(projects: DataFrame, added: DataFrame, removed: DataFrame, renamed: DataFrame) -> DataFrame:
    """project_id, paper_id, ord after edits: members taken out (project_id, paper_id), added behind the others in order (project_id, paper_id, ord), each once, and projects renamed (project_id, new_id)."""
    kept = projects.join(removed.select("project_id", "paper_id").distinct(), ["project_id", "paper_id"], "left_anti")
    last = kept.groupBy("project_id").agg(F.max("ord").alias("_last"))
    new = added.join(last, "project_id", "left").select("project_id", "paper_id", (F.coalesce("_last", F.lit(-1)) + 1 + F.col("ord")).alias("ord"))
    both = kept.select("project_id", "paper_id", "ord").union(new).groupBy("project_id", "paper_id").agg(F.min("ord").alias("ord"))
    names = renamed.groupBy("project_id").agg(F.min("new_id").alias("_new"))
    return both.join(names, "project_id", "left").select(F.coalesce("_new", "project_id").alias("project_id"), "paper_id", "ord")


def insert_defaults(rows: DataFrame) -> DataFrame:
    """Paper rows (id, source, source_id, quality_score, citation_count, citations, references, ...) as they are stored: an id from source and source id, a score of 0.5 for none or 0, citations counted from the lists where no count is given."""
    from ..functions.scalars import record_id

    score = F.when(F.coalesce("quality_score", F.lit(0.0)) == 0, 0.5).otherwise(F.col("quality_score"))
    filled = lambda c: F.greatest(F.lit(0), F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    listed = F.when(filled("citations") > 0, filled("citations")).otherwise(filled("references"))
    count = F.when(F.coalesce("citation_count", F.lit(0)) == 0, listed).otherwise(F.col("citation_count"))
    return rows.withColumns({"id": record_id(F.col("id"), F.col("source"), F.col("source_id")), "quality_score": score, "citation_count": count})


def ensured_papers(papers: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """papers with the records of wanted (identifier and these columns): one that resolves to a paper fills what that lacks, another becomes a paper of its own. papers: id, ord and the columns."""
    from .extraction import resolve_papers

    found = resolve_papers(wanted.select("identifier").distinct(), papers.select("id", "ord")).withColumnRenamed("paper_id", "_found")
    rows = wanted.join(found, "identifier", "left")
    fills = rows.filter("_found is not null").groupBy(F.col("_found").alias("id")).agg(*[F.min_by(c, F.struct(F.col(c).isNull(), "identifier")).alias(c) for c in columns])
    new = rows.filter("_found is null").groupBy(F.col("identifier").alias("id")).agg(*[F.min(c).alias(c) for c in columns])
    have = fill_missing(papers.select("id", *columns), fills, "id", columns)
    return have.unionByName(new.select("id", *columns))


def merged_into_global(nodes: DataFrame, edges: DataFrame, similar: DataFrame, project: DataFrame, project_edges: DataFrame, project_similar: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, similar, counts) of a global graph with a project's: nodes (id, seq, ...) and edges (src, dst, seq, ...) are merged by key, the project's last; counts is a row of what the project gave: records, unique records, nodes, edges, similar."""
    unique = latest_wins(project, ["id"], ["seq"])
    out = upsert(nodes, unique, ["id"], "seq"), upsert(edges, project_edges, ["src", "dst"], "seq"), upsert(similar, project_similar, ["src", "dst"], "seq")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(project, "records_seen").crossJoin(one(unique, "records_unique")).crossJoin(one(unique, "nodes_written")).crossJoin(one(project_edges.select("src", "dst").distinct(), "edges_written")).crossJoin(one(project_similar.select("src", "dst").distinct(), "similar_written"))
    return (*out, counts)


def reindexed(labels: DataFrame, embeddings: DataFrame, embed: Column, *, model: str, version: int, now: Column) -> DataFrame:
    """The embeddings (label, label_norm, model, embedding_version, vector, updated_timestamp) after all labels (label, ord) are embedded anew: first spellings, by normalised label; those of other models and versions stay."""
    from .linking import first_spelling

    rows = first_spelling(labels).select("label", F.col("key").alias("label_norm"), F.lit(model).alias("model"), F.lit(version).alias("embedding_version"), embed.alias("vector"), now.alias("updated_timestamp"))
    return upsert(embeddings, rows, ["label_norm", "model", "embedding_version"], "updated_timestamp")
