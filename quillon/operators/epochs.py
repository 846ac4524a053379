"""Keyed tables as epochs of changes: what a batch writes follows the batch, not the table.

A folder holds one base and later epochs, each with one sub-folder a table; the file `_done` makes an epoch's tables visible all
at once, so tables that belong together change in lockstep. Every table has the key `id` and the `epoch` that wrote the row; the table
`ids` has one row for each id that an epoch touched. The current rows of a table are the base's whose ids no later epoch touched, and of each
touched id those of its last epoch; only the touched ids are compared, and a base is not shuffled while they fit a broadcast.

An epoch is written once: a batch that is run again after it was committed changes nothing, one that failed before is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Epochs:
    """Tables in `folder`; schemas: the columns of each table but `epoch`, `id` among them; buckets: the partition column of some."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], buckets: dict[str, str] | None = None):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets or {}
        self.schemas = {name: f"{ddl}, epoch long" for name, ddl in schemas.items()}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self, kind: str) -> list[int]:
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(self._path(self.folder))]  # one for each epoch since the last compaction
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and self._files.exists(self._path(f"{self.folder}/{n}/_done")))

    def base(self) -> int | None:
        return max(self._done("base"), default=None)

    def committed(self) -> list[int]:
        """Epochs after the base, in order."""
        base = self.base()
        return [e for e in self._done("e") if base is None or e > base]

    def last(self) -> int:
        """The last epoch, -1 before any."""
        return max([*self.committed(), -1 if (b := self.base()) is None else b])

    def write(self, epoch: int, tables: dict[str, DataFrame | Callable]) -> bool:
        """Write and commit an epoch; False where it was committed before. A function gets a reader of the epoch's tables that are written before it."""
        if epoch <= self.last():
            return False
        self._put(f"e={epoch}", tables, F.lit(epoch).cast("long"))
        return True

    def _put(self, name: str, tables: dict[str, DataFrame | Callable], epoch: Column | None = None) -> None:
        for table, df in tables.items():
            df = df(lambda written: self._read([name], written)) if callable(df) else df
            rows = (df if epoch is None else df.withColumn("epoch", epoch)).select(*self._schema(table).names)
            out = rows.repartition(self.buckets[table]).write.partitionBy(self.buckets[table]) if table in self.buckets else rows.write
            out.mode("overwrite").parquet(f"{self.folder}/{name}/{table}")
        self._files.create(self._path(f"{self.folder}/{name}/_done"), True).close()

    def _schema(self, table: str):
        return self.spark.createDataFrame([], self.schemas[table]).schema

    def _read(self, names: list[str], table: str) -> DataFrame:
        schema = self._schema(table)
        frames = [self.spark.read.schema(schema).parquet(f"{self.folder}/{n}/{table}") for n in names] if table in self.buckets else [self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}/{table}" for n in names])] if names else []
        out = self.spark.createDataFrame([], schema)
        for df in frames:
            out = df.select(*schema.names) if df is frames[0] else out.unionByName(df.select(*schema.names))
        return out

    def deltas(self, table: str) -> DataFrame:
        """What the epochs after the base wrote, superseded rows too."""
        return self._read([f"e={e}" for e in self.committed()], table)

    def current(self, table: str) -> DataFrame:
        """Nothing is compared where there is one folder; of several, the first is the base or else stands for it, and the last is current as it is."""
        base = self.base()
        names = [*([] if base is None else [f"base={base}"]), *(f"e={e}" for e in self.committed())]
        if len(names) < 2:
            return self._read(names, table)
        touched = self._read(names[1:], "ids").groupBy(F.col("id").alias("_id")).agg(F.max("epoch").alias("_last"))
        out = self._read(names[:1], table).join(touched, F.col("id") == F.col("_id"), "left_anti")
        if names[1:-1]:
            out = out.unionByName(self._read(names[1:-1], table).join(touched, (F.col("id") == F.col("_id")) & (F.col("epoch") == F.col("_last"))).drop("_id", "_last"))
        return out.unionByName(self._read(names[-1:], table))

    def compact(self) -> None:
        """Fold the epochs into a new base; folders that it replaces are removed once it is committed."""
        done, before = self.committed(), self.base()
        if done:
            self._put(f"base={done[-1]}", {name: self.current(name) for name in self.schemas})
            for name in [*(f"e={e}" for e in done), *([] if before is None else [f"base={before}"])]:
                self._files.delete(self._path(f"{self.folder}/{name}"), True)

    def bytes_of(self, epoch: int) -> int:
        """Bytes that an epoch wrote."""
        return self._files.getContentSummary(self._path(f"{self.folder}/e={epoch}")).getLength()
