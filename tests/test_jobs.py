"""Jobs over their log: plans, outcomes, and a stream that is stopped and started again."""

from __future__ import annotations

from datetime import datetime, timedelta

LOG = "job_id string, paper_id string, status string, ts timestamp, seq long"


def log_rows():
    t = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    return [
        ("j", "done", "processing", t(1), 1), ("j", "done", "completed", t(2), 2), ("j", "again", "processing", t(1), 3), ("j", "again", "failed", t(3), 4),
        ("j", "often", "processing", t(1), 5), ("j", "often", "failed", t(2), 6), ("j", "often", "processing", t(3), 7), ("j", "often", "failed", t(4), 8), ("j", "often", "processing", t(5), 9), ("j", "often", "failed", t(6), 10),
        ("old", "done", "processing", t(1), 11), ("k", "x", "processing", t(9), 12), ("k", "x", "failed", t(8), 13),
    ]


def test_plan_and_outcome(spark):
    from papyra.streaming.jobs import after, planned

    requests = [("j", p, None if p == "nofile" else f"/{p}.pdf", k) for k, p in enumerate(("done", "again", "often", "nofile", "new", "done"))] + [("old", "done", "/d.pdf", 0), ("l", "done", "/d.pdf", 0)]
    r = spark.createDataFrame(requests, "job_id string, paper_id string, pdf_path string, ord int")
    jobs = spark.createDataFrame([("old", "superseded"), ("j", "processing")], "job_id string, status string")
    plan = planned(r, spark.createDataFrame(log_rows(), LOG), jobs)
    assert {(x["job_id"], x["paper_id"]): x["action"] for x in plan.collect()} == {("j", "done"): "skip", ("j", "again"): "retry", ("j", "often"): "give_up", ("j", "nofile"): "fail", ("j", "new"): "run", ("old", "done"): "superseded", ("l", "done"): "run"}
    outcomes = spark.createDataFrame([("j", "again", "completed"), ("j", "new", "completed"), ("l", "done", "completed")], "job_id string, paper_id string, status string")
    got = {x["job_id"]: (x["papers_total"], x["papers_completed"], x["papers_failed"], x["status"]) for x in after(plan, outcomes).collect()}
    assert got == {"j": (5, 3, 2, "completed_with_errors"), "old": (1, 0, 0, "superseded"), "l": (1, 1, 0, "completed")}
    fresh = planned(r, spark.createDataFrame(log_rows(), LOG), jobs, resume=False)
    assert {x["action"] for x in fresh.filter("paper_id = 'done' and job_id = 'j'").collect()} == {"run"}
    assert planned(r.limit(0), spark.createDataFrame([], LOG), jobs.limit(0)).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from papyra.operators.merge import item_state
    from papyra.streaming.jobs import KEYS, item_states

    rows = log_rows()
    source, checkpoint, latest = str(tmp_path / "log"), str(tmp_path / "state"), {}

    def run():
        stream = item_states(spark.readStream.schema(LOG).parquet(source))

        def keep(batch, _):
            for r in batch.collect():
                latest[r["job_id"], r["paper_id"]] = tuple(r)[2:]

        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    for part in (rows[::2], rows[1::2]):  # the second half has events of the same papers, some of them earlier
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        run()
    want = {(r["job_id"], r["paper_id"]): (r["status"], r["started"], r["completed"], r["attempts"]) for r in item_state(spark.createDataFrame(rows, LOG), KEYS).collect()}
    assert latest == want
