"""Sinks for ``foreachBatch`` that a replayed micro-batch changes once: data by batch, and a ledger of the batches that count.

A batch's rows go to a folder of their own, ``data/batch=N``, which a replay of N overwrites;
then N goes to the ledger. Readers see the batches of the ledger alone, so what a
stopped run left behind is never read, and a batch that the ledger holds is not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import audit
from talus.sources.store import latest_records

Batch = Callable[[DataFrame, int], None]


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that count: as many rows as batches."""
    try:
        return sorted(r["batch"] for r in spark.read.schema("batch LONG, rows LONG").parquet(f"{path}/ledger/*").collect())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the batches of the ledger, with ``batch``. Other batches' folders are not opened."""
    batches = committed(spark, path)
    folders = [f"{path}/data/batch={b}" for b in batches]
    if not folders:
        return spark.createDataFrame([], f"{schema}, batch LONG")
    return spark.read.schema(f"{schema}, batch LONG").option("basePath", f"{path}/data").parquet(*folders)


def once(path: str, make: Callable[[DataFrame], DataFrame] = lambda df: df, before_commit: Callable[[int], None] = lambda batch: None) -> Batch:
    """A function for ``foreachBatch`` that appends make(rows) to path, each batch once."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if batch in committed(spark, path):
            return
        folder = f"{path}/data/batch={batch}"
        make(df).write.mode("overwrite").parquet(folder)
        before_commit(batch)
        n = spark.read.parquet(folder).count()
        spark.createDataFrame([(batch, n)], "batch LONG, rows LONG").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/{batch}")

    return write


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Alert records as upserts leave them: of each alert the last update of all batches, its first times kept (merged as it is read)."""
    return latest_records(read(spark, path, schema)).drop("batch")


def chained(path: str, schema: str, chain: str = "alert_id", before_commit: Callable[[int], None] = lambda batch: None) -> Batch:
    """A function for ``foreachBatch`` that appends events to the hash-chained log at path. A replay finds the same log as the first run, so it chains the same rows again."""

    def write(df: DataFrame, batch: int) -> None:
        log = read(df.sparkSession, path, schema)
        once(path, lambda rows: audit.append(rows, chain, log=log), before_commit)(df, batch)

    return write
