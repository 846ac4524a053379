"""What the operators of this subpackage share: tables, the shared folder, Hadoop paths, word lists."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words: space and \t \n \v \f \r. Fixed by the contracts.
SPACE_CLASS = r"[ \t-\r]+"
#: Bytes after which an Arrow batch to a Python worker ends; a longer row goes alone.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    spark.checkpoint.dir is read from the session; only where it is unset (tests on one machine) a
    temporary folder of this machine is set as the session's checkpoint folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        top = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{top.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """The words of a text (null: none) as an array, unchanged and in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that go to Python workers, by rows and by bytes: texts are long, and the default is 10,000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release_memory() -> None:
    """Give what a finished task of a Python worker held back to the system: workers stay alive between tasks."""
    gc.collect()
    with contextlib.suppress(Exception):
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(parts: Iterator) -> Iterator:
    """The same, and what the task held is given back after the last one."""
    yield from parts
    release_memory()


def private(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the given columns, so that other columns of df can have any name."""
    return df.select(*[c.alias(k) for k, c in columns.items()])


def crc32_sql(text: str) -> str:
    """DuckDB's expression of the unsigned crc32 of an ASCII string, which it has no function for: the division bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    byte = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"
