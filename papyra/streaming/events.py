"""Extensions: the same operators on streams. The batch library doesn't need them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import upsert


def windowed_counts(events: DataFrame, *, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, event_type, n, total of events by event time; on a stream, rows later than ``late`` are left out and windows are final once they can't change."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("window_start"), "event_type", "n", "cents")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """user_id, session_start, n of bursts of a user's events."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def upsert_sink(folder: str, keys: list[str], seq: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the latest row of each key under folder, one version a batch; a repeated batch writes the same version again, so that retries change nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates()
        if number:
            new = upsert(spark.read.parquet(f"{folder}/v{number - 1}"), new, keys, seq)
        else:
            new = upsert(new.limit(0), new, keys, seq)
        new.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return write


def run_available(stream: DataFrame, folder: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, to Parquet."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/event[s].parquet")
