"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a folder of this machine, which only a local session allows."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="papyra-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; not made yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: its lineage ends there."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where it has fewer: a file of one row group is one task, whatever its splits. Tables of a cluster's size have more and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of text whose parts one task counts before it shuffles them.
PIECE = 32_000_000


def in_pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, size: int = PIECE) -> DataFrame:
    """docs in partitions of about ``size`` bytes of text, by id, where the files' splits are larger: what a task counts before a shuffle then doesn't grow with the split."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-total // size)
    return docs.repartition(n, id_col) if n > docs.rdd.getNumPartitions() else docs
