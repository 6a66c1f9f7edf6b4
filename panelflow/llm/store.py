"""Intermediate tables in the shared folder, removed once they are read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from panelflow.session import scratch_path


class Store:
    """Writes frames below one folder of the run."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = scratch_path(spark, label)
        self._n = 0
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame, label: str = "part") -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage, fixes every choice made so far."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a kept frame that nothing reads any more."""
        if path := self._paths.pop(id(df), None):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows while a plan is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)
