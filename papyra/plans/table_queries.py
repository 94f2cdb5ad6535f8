"""Readers, upserts, pages and lookups on the star schema and the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import uuid5
from ..operators import merge
from ..sources.tables import listing, with_children
from .registry import query, read


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def list_page(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return listing(o, by="o_orderdate", key="o_orderkey", where=F.col("o_orderstatus") == "F", limit=50, offset=20).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ar%' AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '1')")
def title_search(spark, sf_dir):
    """A title pattern, and all query tokens somewhere in the record."""
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    tokens = F.array(F.lit("brand"), F.lit("1"))
    return read(spark, sf_dir, "part").filter(F.col("p_name").ilike("%ar%") & F.forall(tokens, lambda t: F.contains(hay, t))).select("p_partkey", "p_name")


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, max(ts) AS latest_ts, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS latest_success FROM events GROUP BY user_id""")
def latest_status(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return merge.latest_and_success(e, "user_id", "event_type", "ts", "event_id", success="purchase")


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, min(ts) FILTER (WHERE event_type = 'view') AS started,
  max(ts) FILTER (WHERE event_type IN ('purchase', 'error')) AS completed, count(*) FILTER (WHERE event_type = 'view') AS attempts FROM events GROUP BY user_id""")
def job_item_state(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnsRenamed({"event_type": "status", "event_id": "seq"})
    return merge.item_state(e, ["user_id"], started="view", terminal=("purchase", "error"))


@query("""
WITH s AS (SELECT user_id, user_id % 10 AS job_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id)
SELECT job_id, count(*) AS papers_total, count(*) FILTER (WHERE status = 'purchase') AS papers_completed, count(*) FILTER (WHERE status = 'error') AS papers_failed,
  CASE WHEN count(*) FILTER (WHERE status IN ('purchase', 'error')) < count(*) THEN 'processing' WHEN count(*) FILTER (WHERE status = 'error') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM s GROUP BY job_id""")
def job_progress(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnsRenamed({"event_type": "status", "event_id": "seq"})
    items = merge.item_state(e, ["user_id"]).withColumn("status", F.when(F.col("status") == "purchase", "completed").when(F.col("status") == "error", "failed").otherwise(F.col("status")))
    return merge.job_progress(items.withColumn("job_id", F.col("user_id") % 10))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS updated, min(ts) AS created, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def upsert_latest_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").alias("updated"), F.col("ts").alias("created"), "event_id")
    return merge.latest_wins(e, ["user_id", "event_type"], ["updated", "event_id"], keep_first=("created",))


@query("""
WITH old AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN '' END AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS bal FROM customer),
new AS (SELECT c_custkey, c_mktsegment AS name, CAST(c_nationkey AS DOUBLE) AS bal FROM customer WHERE c_custkey % 7 <> 0)
SELECT o.c_custkey, coalesce(nullif(o.name, ''), n.name, o.name) AS name, coalesce(o.bal, n.bal) AS bal FROM old o LEFT JOIN new n USING (c_custkey)""")
def fill_missing(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 0, "").alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("bal"))
    new = c.filter("c_custkey % 7 <> 0").select("c_custkey", F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("double").alias("bal"))
    return merge.fill_missing(old, new, "c_custkey", ["name", "bal"])


@query("""
WITH q AS (SELECT event_id AS id, event_type AS label, CASE WHEN event_id % 3 = 0 THEN 'approved' ELSE 'pending' END AS review_status FROM events)
SELECT id, label, CASE WHEN id % 5 = 0 THEN 'rejected' ELSE review_status END AS review_status FROM q""")
def review_decisions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    queue = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.when(F.col("event_id") % 3 == 0, "approved").otherwise("pending").alias("review_status"))
    decided = e.filter("event_id % 5 = 0").select(F.col("event_id").alias("id"), F.lit("rejected").alias("review_status"))
    return merge.review(queue, decided).select("id", "label", "review_status")


@query("SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return merge.without_ids(line, o.filter("o_orderstatus = 'F'").select("o_orderkey"), "l_orderkey")


@query("SELECT r_name AS project_id, string_agg(n_name, ',' ORDER BY n_name) AS papers, count(*) AS n_papers FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def membership(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("r_name").alias("project_id")).agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("papers"), F.count("*").alias("n_papers"))


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_children, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey), '') AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def notes_with_children(spark, sf_dir):
    """A parent row with its children in order of time, one join instead of one query a parent."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    out = with_children(c.select(F.col("c_custkey").alias("id"), "c_name"), o.select(F.col("o_custkey").alias("id"), "o_orderdate", "o_orderkey"), on="id", order="o_orderdate", name="kids")
    return out.select(F.col("id").alias("c_custkey"), "c_name", F.size("kids").cast("long").alias("n_children"), F.array_join(F.transform("kids", lambda k: k["o_orderkey"].cast("string")), ",").alias("children"))


@query("SELECT event_id, TRY_CAST(props->>'$.k' AS INTEGER) AS k FROM events WHERE TRY_CAST(props->>'$.k' AS INTEGER) > 50")
def json_items(spark, sf_dir):
    from ..sources.tables import json_items as items

    e = read(spark, sf_dir, "events").select("event_id", F.explode(items(F.col("props"), "struct<k:int>")).alias("x"))
    return e.filter("x.k > 50").select("event_id", F.col("x.k").alias("k"))


@query()
def uuid5_ids(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", uuid5(F.concat_ws("|", "conv_id", "turn", "role")).alias("id"))


@query("SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Assistant' WHEN 'user' THEN 'User' ELSE 'System' END || ': ' || substr(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), 1, 900) AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def last_turns(spark, sf_dir):
    from ..operators.answers import last_turns as last

    return last(read(spark, sf_dir, "conversations"))
