"""What the operators of this subpackage share: tables, folds, checkpoints, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..ship import ship

#: Rows of text in one Arrow batch: bounds a worker's memory where texts are long.
TEXT_ROWS = 1000
#: The session's setting for that; 10,000 where nobody has set it.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, in a session whose Arrow batches have TEXT_ROWS rows, unless it says otherwise: whole texts and their word lists make rows large."""
    ship(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, TEXT_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RESIDENT: dict = {}


def resident(key: tuple, make: Callable[[], Any]) -> Any:
    """What make() gives, kept in this worker for further tasks; one such thing at a time, as workers are reused by all operators."""
    if key not in _RESIDENT:
        make_room()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def make_room() -> None:
    """Drops what other operators have left in this worker."""
    _RESIDENT.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Returns to the machine what this worker has freed but its allocators keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a folder of this machine is taken, which only a local session allows.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="papyra-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder until nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; not made yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written as Parquet (to a new folder in the shared one) and read again."""
    path = path or new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_folder() named, once nothing reads it any more."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null and empty texts are one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def id_type(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    """The type of an id column, which operators pass on as it is: for Spark's schemas and for Arrow's."""
    kind = df.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels nothing may learn from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def by_rows(f: Callable[[list], list[tuple]], schema: pa.Schema, column: str = "text", keep: str = "doc_id") -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow: f gets a list of texts (null: empty) and gives a tuple of the further columns for each; column ``keep`` is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(at, TEXT_ROWS)
                rows = f([t or "" for t in part.column(column).to_pylist()])
                columns = list(zip(*rows, strict=True)) or [()] * (len(schema) - 1)
                yield pa.RecordBatch.from_arrays([part.column(keep).cast(schema.field(0).type), *(pa.array(list(c), t.type) for c, t in zip(columns, list(schema)[1:], strict=True))], schema=schema)
            give_back()

    return run


#: Ids up to which ``without`` broadcasts them (8 bytes each).
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows of these ids (one column of the same name), in the columns of docs.

    The ids are broadcast while a count shows that they are few, so that texts stay where they
    are; else both sides are shuffled.
    """
    few = checkpointed(ids.distinct())
    if few.count() <= BROADCAST_IDS:
        few = F.broadcast(few)
    return docs.join(few, id_col, "left_anti").select(*docs.columns)
