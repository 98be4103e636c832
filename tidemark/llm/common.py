"""Shared helpers: table access, shared scratch space and the word definition."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

#: A word, everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space that ends a word.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes behind a task that writes a table whose size is known beforehand.
TASK_BYTES = 128 << 20
#: The tables that this process has written to the shared folder, in order.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, one of our own on a local master, as in tests; a
    cluster's executors share no temporary folder, so there it must be set."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def files_at(spark: SparkSession, path: str):  # noqa: ANN201
    """The file system of a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    files, where = files_at(spark, path)
    files.deleteOnExit(where)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that stored() wrote and that nothing reads any more."""
    for path in paths:
        files, where = files_at(spark, path)
        files.delete(where, True)


def stored(df: DataFrame, name: str, waves: int = 1, size: int = 0) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors.

    It is written by as many tasks as the cluster runs at once, or `waves` times as many, and by more if `size`, the
    bytes that are known to lie behind it, gives a task more than TASK_BYTES: a small table spread over all shuffle
    partitions would be thousands of small files, a large one in few tasks would cost much to repeat. The table is
    deleted when the driver ends, or before by discard().
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    tasks = max(max(1, spark.sparkContext.defaultParallelism) * waves, -(-size // TASK_BYTES))
    df.coalesce(tasks).write.option("compression", "zstd").parquet(path)
    gone_at_exit(spark, path)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Readies a session for Python functions: sends them the package, and keeps Arrow batches small unless the session
    has settings of its own, as texts differ much in length."""
    ship(spark)
    for name, usual, bound in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "8m")):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, bound)


def release() -> None:
    """Gives a worker's freed memory back to the machine: workers wait for more tasks, and their memory counts meanwhile."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to ask for
        pass


def word_count(text: Column) -> Column:
    """Words of the text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8; bytes.split() separates by exactly the white space of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
