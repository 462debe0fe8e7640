"""What the operators of this subpackage share: lineage cuts and text transport."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_AT_ONCE = 1000  # texts that pass between an executor and Python together


ROWS_OF_A_FILE, LEAST_FILES = 200_000, 6


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent the session must be local; a temporary folder is used then.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def files_for(rows: int) -> int:
    """A file for each ROWS_OF_A_FILE of narrow rows, at least a few."""
    return max(LEAST_FILES, -(-rows // ROWS_OF_A_FILE))


def cut(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: later stages start from files."""
    return put(df, spark, name)[0]


def put(df: DataFrame, spark: SparkSession, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """As ``cut``, with the path of the table, so that ``drop`` can remove it once nothing reads it.

    Where the most ``rows`` it can have are known, it becomes a file for each ROWS_OF_A_FILE of them, at least a few:
    rounds over narrow tables would else write a small file for each partition of a shuffle.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(files_for(rows))
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def trim() -> None:
    """Give freed memory of a Python worker back: workers live on through later stages, beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


CLEAR: list = []  # what empties the caches of the operators that a worker has loaded
_owner: list = [None]


def owned(name: str) -> None:
    """Tell that a Python worker works for an operator now: what it kept for another one is dropped."""
    if _owner[0] != name:
        for clear in CLEAR:
            clear()
        _owner[0] = name
        trim()


def vectorised(schema: str):
    """A pandas UDF of a function of series; it is made when it is called, as its schema is read by a session.

    Batches of whole texts are held at once by an executor and its Python worker, so the session's batches are made
    no larger than ROWS_AT_ONCE.
    """

    def called(f):
        @functools.wraps(f)
        def run(*batch):
            owned(f.__module__)
            out = f(*batch)
            trim()
            return out

        def on(*columns):
            conf, key = SparkSession.active().conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
            if not 0 < int(conf.get(key, "10000")) <= ROWS_AT_ONCE:
                conf.set(key, str(ROWS_AT_ONCE))
            return F.pandas_udf(run, schema)(*columns)

        return on

    return called


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that ``put`` wrote."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
