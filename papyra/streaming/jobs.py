"""Batch jobs of papers over a log of their events: what is done, what is left to do, what another job has replaced. As a batch and as a stream with the same result.

Events are rows: job_id, paper_id, status, ts, seq. Requests are rows: job_id, paper_id, pdf_path, ord.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import TERMINAL, item_state, job_progress

KEYS = ["job_id", "paper_id"]
STARTED = "processing"
MISSING = "missing_pdf"


def planned(requests: DataFrame, log: DataFrame, jobs: DataFrame, *, resume: bool = True, most: int = 3) -> DataFrame:
    """requests with status, attempts and action: what a run of the jobs has to do with each paper.

    jobs (job_id, status): jobs that are superseded do nothing ("superseded"). With resume a
    completed paper is "skip"; without a path a paper is "fail"; one that failed ``most`` times is
    "give_up", one that failed less often "retry", any other "run". A paper that a job names twice is
    one paper, its first request by ord. Null paths are missing ones.
    """
    first = requests.groupBy(*KEYS).agg(F.min_by(F.struct("pdf_path", "ord"), "ord").alias("r")).select(*KEYS, "r.pdf_path", "r.ord")
    state = item_state(log, KEYS).select(*KEYS, "status", "attempts")
    gone = jobs.filter("status = 'superseded'").select("job_id", F.lit(True).alias("_gone")).distinct()
    rows = first.join(state, KEYS, "left").join(gone, "job_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0).cast("long")))
    failed = F.col("status") == "failed"
    action = (
        F.when(F.col("_gone"), "superseded")
        .when((F.col("status") == "completed") & F.lit(resume), "skip")
        .when(F.coalesce(F.trim("pdf_path"), F.lit("")) == "", "fail")
        .when(failed & (F.col("attempts") >= most), "give_up")
        .when(failed, "retry")
        .otherwise("run")
    )
    return rows.select(*KEYS, "pdf_path", "ord", "status", "attempts", action.alias("action"))


def after(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """job_id, papers_total, papers_completed, papers_failed, status of jobs once their plan has run: outcomes (job_id, paper_id, status) of papers that were run or retried; papers without a path and given-up ones have failed, skipped ones are completed. Superseded jobs stay so."""
    done = plan.join(outcomes.select(*KEYS, F.col("status").alias("_new")), KEYS, "left")
    status = F.when(F.col("action") == "skip", "completed").when(F.col("action").isin("fail", "give_up"), "failed").when(F.col("action") == "superseded", F.coalesce("status", F.lit("queued"))).otherwise(F.coalesce("_new", "status", F.lit("queued")))
    progress = job_progress(done.select("job_id", "paper_id", status.alias("status")))
    gone = plan.groupBy("job_id").agg(F.bool_or(F.col("action") == "superseded").alias("_gone"))
    out = progress.join(gone, "job_id")
    return out.withColumn("status", F.when(F.col("_gone"), "superseded").otherwise(F.col("status"))).drop("_gone")


STATE = "status string, started timestamp, completed timestamp, attempts long, ts timestamp, seq long"
OUT = "job_id string, paper_id string, status string, started timestamp, completed timestamp, attempts long"


def _later(a: Any, b: Any) -> Any:
    return b if a is None else a if b is None else max(a, b)


def item_states(events: DataFrame) -> DataFrame:
    """item_state() of a stream of events, kept for each paper of a job: a row for each paper whenever it has new events.

    State is one row a paper. Events may come late and in any order: the last by (ts, seq) gives
    the status, first starts and last ends are minima and maxima, so a replay gives the same.
    """

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, started, completed, attempts, ts, seq = state.get if state.exists else (None, None, None, 0, None, None)
        for rows in batches:
            for r in rows.itertuples():
                at = r.ts.to_pydatetime()
                if ts is None or (at, r.seq) > (ts, seq):
                    status, ts, seq = r.status, at, int(r.seq)
                if r.status == STARTED:
                    attempts += 1
                    started = at if started is None else min(started, at)
                if r.status in TERMINAL:
                    completed = _later(completed, at)
        state.update((status, started, completed, attempts, ts, seq))
        yield pd.DataFrame([(*key, status, started, completed, attempts)], columns=["job_id", "paper_id", "status", "started", "completed", "attempts"])

    return events.groupBy(*KEYS).applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
