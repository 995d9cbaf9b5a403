"""What the operators share: the work folder, stored intermediate tables, bounded broadcasts, names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Rows of one key that meet in one task of ``spread_join``.
KEY_ROWS = 50_000


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that ``spark.checkpoint.dir`` names.

    Only where that setting is missing, and Spark runs on one machine (tests, a
    laptop), a temporary folder takes its place.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("talus.work.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("talus.work.dir", root)
    return f"{root.rstrip('/')}/talus-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the work folder and read it back: its lineage ends there.

    The folder's owner clears it after the job: results are lazy and may read it.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose row count was measured, if that count is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", most: int = KEY_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """many joined with one (a row for each key) where a key may have very many rows in many.

    The right rows of keys with more than ``most`` rows are copied, and the left rows
    are dealt to the copies by a hash of ``by``. Keys are counted first, with partial
    counts; there are at most so many hot ones as ``most`` goes into all rows, and they
    are broadcast within the bound (beyond it, adaptive execution has to split them).
    counts: key and its rows ``n``, if they are known.
    """
    counts = many.groupBy(key).agg(F.count("*").alias("_rows")) if counts is None else counts.select(key, F.col("n").alias("_rows"))
    hot = stored(counts.where(F.col("_rows") > most).select(key, F.ceil(F.col("_rows") / most).cast("int").alias("_copies")))
    n = hot.where(F.col(key).isNotNull()).count()
    if not 0 < n <= BROADCAST_ROWS:
        return many.join(one, key, how)
    copies = F.broadcast(hot)
    dealt = many.join(copies, key, "left").withColumn("_copy", F.pmod(F.xxhash64(by), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    copied = one.join(copies, key, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return dealt.join(copied, [key, "_copy"], how).drop("_copy")


def with_row(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one column ``row`` beside the given ones, so that no name of docs clashes with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
