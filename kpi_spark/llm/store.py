"""Intermediate tables in the folder that the whole cluster shares.

A table written here cuts a plan's lineage and survives the loss of executors.
The folder is the session's ``spark.checkpoint.dir``; where that is unset and everything
runs in one process, as in tests, a local folder of this session's own takes its place.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Narrow rows (a few longs each) that one task works on before a further one is worth its start.
PER_TASK = 50_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than about so many narrow rows are worth; many rows stay as they are dealt."""
    return df.coalesce(rows // PER_TASK + 1)


def folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL[context.applicationId]


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs meanwhile passes at most so many rows at once to Python.  The setting is the session's: keep such a stretch to the writing of one table."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Tables:
    """The intermediate tables of one run of an operator, each under a name."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root, self.names = spark, f"{folder(spark)}/tables/{label}-{uuid.uuid4().hex[:12]}", set()

    def put(self, df: DataFrame, name: str, batch: int | None = None, rows: int | None = None) -> DataFrame:
        """Writes ``df`` and returns what was written.

        batch: rows that go to Python at once, where the session's number is too many.
        rows: how many there are at most, where they are narrow and this is known.
        """
        df = df if rows is None else few_tasks(df, rows)
        path = f"{self.root}/{name}"
        with small_batches(self.spark, batch) if batch else nullcontext():
            df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, which the result still reads."""
        self.drop(*(self.names - set(names)))
