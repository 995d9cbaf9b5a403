"""The source store and the alert records as Parquet tables."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def write_transactions(tx: DataFrame, path: str) -> None:
    """Always rebuilt, sorted within files by account and time, so that scans by account prune."""
    tx.repartition("sender_account").sortWithinPartitions("sender_account", "timestamp").write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, account: str, buckets: int, order: str | None = None) -> DataFrame:
    """df as a table bucketed by account, each bucket one sorted file: joins, groups and windows by account read it without an exchange.

    A bucket is read by one task, so it has to fit one: the number of buckets grows with the
    table (128 MB each), and an account with a large share of all rows is better
    served by the plain store, whose exchanges part accounts by time.
    """
    named = df.repartition(buckets, account)
    named.write.bucketBy(buckets, account).sortBy(account, *([order] if order else [])).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def accounts_in_order(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stored transactions of the accounts from first to last, in order of account and time: range partitions, each sorted."""
    tx = spark.read.parquet(path)
    tx = tx if first is None else tx.where(F.col("sender_account") >= first)
    tx = tx if last is None else tx.where(F.col("sender_account") <= last)
    return tx.repartitionByRange("sender_account", "timestamp").sortWithinPartitions("sender_account", "timestamp", "transaction_id")


def write_customers(customers: DataFrame, path: str) -> None:
    """customers (with an ``accounts`` array) as two tables: customers, and one row for each account."""
    customers.drop("accounts").write.mode("overwrite").parquet(f"{path}/customers")
    customers.select(F.explode("accounts").alias("account"), "customer_id").write.mode("overwrite").parquet(f"{path}/accounts")


def write_meta(spark: SparkSession, values: dict[str, str], path: str) -> None:
    spark.createDataFrame(sorted(values.items()), "key STRING, value STRING").coalesce(1).write.mode("overwrite").parquet(path)


def constraint_violations(tx: DataFrame, customers: DataFrame, accounts: DataFrame) -> DataFrame:
    """check, n: breaches of keys, references and ranges of the store."""
    repeated = lambda df, key, name: df.groupBy(key).count().where("count > 1").agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    orphan = accounts.join(customers, "customer_id", "left_anti").agg(F.lit("account without customer").alias("check"), F.count("*").alias("n"))
    ranges = tx.agg(F.lit("amount not positive").alias("check"), F.count_if(~F.coalesce(F.col("amount_brl") > 0, F.lit(False))).alias("n"))
    flags = tx.agg(F.lit("flag neither 0 nor 1").alias("check"), F.count_if(~F.coalesce(F.col("is_laundering").isin(0, 1), F.lit(False))).alias("n"))
    return (
        repeated(tx, "transaction_id", "repeated transaction_id").unionByName(repeated(customers, "customer_id", "repeated customer_id"))
        .unionByName(repeated(accounts, "account", "repeated account")).unionByName(orphan).unionByName(ranges).unionByName(flags)
    )


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that ``spark.checkpoint.dir`` names.

    Without that setting, and on one machine alone, a temporary folder takes its place.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("talus.work.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("talus.work.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written once to the work folder and read back, for plans that use it several times."""
    path = work_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_sha256(tables: list[DataFrame]) -> str:
    """SHA-256 over each table's row count and sums of row hashes (``content_sum``): no order is needed. ``hashtree.content_digest`` is the ordered form."""
    return hashlib.sha256("|".join(f"{r['n']}:{r['content_hash']}" for r in (content_sum(df).first() for df in tables)).encode()).hexdigest()


def content_sum(df: DataFrame) -> DataFrame:
    """n, content_hash: row count and order-free sums of row hashes, the first and the second 15 hex digits of each.

    A row is hashed as JSON with nulls written: null, empty and moved separators differ.
    """
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("n"), F.concat_ws(":", part(1), part(16)).alias("content_hash"))


def latest_records(records: DataFrame) -> DataFrame:
    """One row for each alert_id: the last update's values, the first one's created_at and selected_at."""
    by = W.partitionBy("alert_id")
    first = by.orderBy("updated_at", "seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        records.withColumn("created_at", F.first("created_at").over(first)).withColumn("selected_at", F.first("selected_at").over(first))
        .withColumn("_n", F.row_number().over(by.orderBy(F.desc("updated_at"), F.desc("seq")))).where("_n = 1").drop("_n")
    )


def upsert(table: DataFrame, news: DataFrame, key: list[str]) -> DataFrame:
    """The table with the rows of news in place of those of the same key."""
    return table.join(news.select(*key).distinct(), key, "left_anti").unionByName(news)


def refreshed(table: DataFrame, news: DataFrame, key: list[str]) -> DataFrame:
    """Like upsert, but selected_at of a key that is known is overwritten too, while created_at stays the table's."""
    old = table.select(*key, F.col("created_at").alias("_created"))
    merged = news.join(old, key, "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")
    return table.join(news.select(*key).distinct(), key, "left_anti").unionByName(merged.select(*table.columns))


def write_golden(manifest: dict, payloads: DataFrame, path: str) -> None:
    """Payloads as JSON files and the manifest as one."""
    payloads.write.mode("overwrite").json(f"{path}/payloads")
    text = json.dumps(manifest, sort_keys=True, ensure_ascii=False)
    payloads.sparkSession.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def manifest_sha256(manifest: dict) -> str:
    body = {k: v for k, v in manifest.items() if k != "manifest_sha256"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def read_golden(spark: SparkSession, path: str) -> dict:
    """The manifest, its hash checked."""
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    if manifest.get("manifest_sha256") != manifest_sha256(manifest):
        raise ValueError("the manifest's hash does not fit its content")
    return manifest
