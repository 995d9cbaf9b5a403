"""The TPC-H-like tables seen as transactions, accounts, customers and alert records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus import config

#: Labels by number: the suspicious ones, then the normal ones.
LABELS = [x[0] for x in config.SUSPICIOUS] + config.NORMAL


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def transactions(spark: SparkSession, sf_dir: str, located: bool = True) -> DataFrame:
    """Line items as transactions of the customer (holder) with the supplier; returned ones come in, others go out.

    Without ``located`` the joins with customers, suppliers and nations are left out.
    """
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tx = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    holder, other = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    inbound = F.col("l_returnflag") == "R"
    columns = [
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents("l_extendedprice").cast("string")).alias("transaction_id"),
        F.col("l_shipdate").alias("timestamp"),
        cents("l_extendedprice").alias("amount_brl"),
        F.element_at(F.array(*[F.lit(p) for _, p in config.PAYMENT_TYPES]), ((F.col("l_partkey") + F.col("l_linenumber")) % 7 + 1).cast("int")).alias("payment_type"),
        holder.alias("holder"),
        F.when(inbound, other).otherwise(holder).alias("sender_account"),
        F.when(inbound, holder).otherwise(other).alias("receiver_account"),
        F.element_at(F.array(*[F.lit(x) for x in LABELS]), ((F.col("l_orderkey") + F.col("l_partkey")) % 28 + 1).cast("int")).alias("laundering_type"),
        F.when((F.col("l_orderkey") + F.col("l_partkey")) % 28 < len(config.SUSPICIOUS), 1).otherwise(0).alias("is_laundering"),
    ]
    if not located:
        return tx.select(*columns)
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"))
    where = lambda name, p: read(spark, sf_dir, name).join(F.broadcast(nation), F.col(f"{p}_nationkey") == F.col("n_nationkey"))  # noqa: E731  25 nations
    customer = where("customer", "c").select("c_custkey", F.col("region").alias("c_region"))
    supplier = where("supplier", "s").select("s_suppkey", F.col("region").alias("s_region"))
    tx = tx.join(customer, tx["o_custkey"] == customer["c_custkey"]).join(supplier, tx["l_suppkey"] == supplier["s_suppkey"])
    return tx.select(*columns, F.when(inbound, F.col("s_region")).otherwise(F.col("c_region")).alias("sender_location"), F.when(inbound, F.col("c_region")).otherwise(F.col("s_region")).alias("receiver_location"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, customer_id, name, cpf_cnpj, restriction_flags of every customer: flags by the key's remainders."""
    from talus.functions.checkdigits import cpf

    key = F.col("c_custkey")
    flags = F.array_compact(F.array(F.when(key % 97 == 0, F.lit("pep")), F.when(key % 193 == 0, F.lit("ceis")), F.when(key % 197 == 0, F.lit("cnep"))))
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), key.cast("string")).alias("account"), F.concat(F.lit("CUST-"), F.lpad(key.cast("string"), 7, "0")).alias("customer_id"), F.col("c_name").alias("name"),
        cpf(F.lpad((key * 7919 % 1_000_000_000).cast("string"), 9, "0")).alias("cpf_cnpj"), flags.alias("restriction_flags"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions of their user."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("ts").alias("timestamp"), F.col("value").cast("decimal(18,2)").alias("amount_brl"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sender_account")
    )
