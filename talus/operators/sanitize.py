"""Tokens for personal data in alerts, their restricted lookup table, and scans for what is left."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus.functions.checkdigits import valid_document
from talus.operators.marked import hits, text_columns
from talus.operators.ranks import placed


def appearances(alerts: DataFrame, alert_tx: DataFrame) -> DataFrame:
    """alert_id, kind, value, at: where personal data stands in alerts (alert_id, name, cpf_cnpj) and their transactions.

    The holder comes first, then senders and receivers in the transactions' order.
    """
    person = [
        alerts.select("alert_id", F.lit(kind).alias("kind"), F.col(column).alias("value"), F.lit(0).alias("at"))
        for kind, column in (("NOME", "name"), ("DOCUMENTO", "cpf_cnpj"))
    ]
    account = alert_tx.select(
        "alert_id", F.lit("CONTA").alias("kind"),
        F.inline(F.array(F.struct(F.col("holder").alias("value"), F.lit(0).alias("at")), F.struct(F.col("sender_account").alias("value"), (F.col("seq") * 2).cast("int").alias("at")), F.struct(F.col("receiver_account").alias("value"), (F.col("seq") * 2 + 1).cast("int").alias("at")))),
    )
    return reduce(DataFrame.unionByName, [*person, account]).where("value IS NOT NULL")


def token_table(alerts: DataFrame, alert_tx: DataFrame) -> DataFrame:
    """alert_id, kind, value, token: one token for each value of an alert, numbered by kind in order of first appearance within the alert.

    The table is what re-identification reads; it is stored apart, with access of its own.
    """
    first = appearances(alerts, alert_tx).groupBy("alert_id", "kind", "value").agg(F.min("at").alias("at"))
    number = F.row_number().over(W.partitionBy("alert_id", "kind").orderBy("at", "value"))
    return first.select("alert_id", "kind", "value", F.format_string("%s_%02d", "kind", number).alias("token"))


VAULT = "kind string, value string, number long, token string"


def new_tokens(seen: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """kind, value, number, token of the values of seen (appearances) that the vault does not hold: what is to be appended to it.

    Numbers go on from the vault's highest of each kind, without gaps, in order of first
    appearance by alert_id and place. So a token stands for one value in all alerts that share the vault.
    """
    first = seen.groupBy("kind", "value").agg(F.min(F.struct("alert_id", "at")).alias("first"))
    if vault is not None:
        first = first.join(vault.select("kind", "value"), ["kind", "value"], "left_anti")
    new = placed(first.select("kind", "value", "first.alert_id", "first.at"), ["alert_id", "at", "value"], ["kind"], "number")
    if vault is not None:
        top = vault.groupBy("kind").agg(F.max("number").alias("_top"))
        new = new.join(top, "kind", "left").withColumn("number", F.col("number") + F.coalesce("_top", F.lit(0)))
    return new.select("kind", "value", "number", F.format_string("%s_%02d", "kind", "number").alias("token"))


def shared_tokens(seen: DataFrame, vault: DataFrame) -> DataFrame:
    """alert_id, kind, value, token of alerts whose values the vault holds, as ``sanitised`` and ``reidentified`` want them."""
    return seen.select("alert_id", "kind", "value").distinct().join(vault.select("kind", "value", "token"), ["kind", "value"]).select("alert_id", "kind", "value", "token")


def sanitised(alerts: DataFrame, alert_tx: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts and transactions with tokens for values. An invalid document or a missing token gives NEEDS_HUMAN, and its transactions are left out."""
    t = lambda kind, column, name: tokens.where(F.col("kind") == kind).select("alert_id", F.col("value").alias(column), F.col("token").alias(name))
    n = alert_tx.groupBy("alert_id").agg(F.count("*").alias("n_tx"))
    head = alerts.join(t("NOME", "name", "name_token"), ["alert_id", "name"], "left").join(t("DOCUMENTO", "cpf_cnpj", "document_token"), ["alert_id", "cpf_cnpj"], "left").join(n, "alert_id", "left")
    ok = valid_document(F.col("cpf_cnpj")) & F.col("name_token").isNotNull() & F.col("n_tx").isNotNull()
    head = head.select(
        "alert_id", F.when(ok, F.lit("SANITIZED")).otherwise(F.lit("NEEDS_HUMAN")).alias("state"), F.when(ok, F.col("name_token")).alias("name_token"),
        F.when(ok, F.col("document_token")).alias("document_token"), F.when(ok, 3 + 2 * F.col("n_tx")).alias("pii_token_count"),
        F.when(~ok, F.lit("document or name cannot be tokenised")).alias("failure_reason"),
    )
    rows = alert_tx.join(head.where("state = 'SANITIZED'").select("alert_id"), "alert_id", "left_semi")
    for column in ("holder", "sender_account", "receiver_account"):
        rows = rows.join(t("CONTA", column, "_token"), ["alert_id", column]).drop(column).withColumnRenamed("_token", column)
    return head, rows


def reidentified(rows: DataFrame, column: str, tokens: DataFrame) -> DataFrame:
    """rows with ``value``, what the column's token stands for."""
    return rows.join(tokens.select("alert_id", F.col("token").alias(column), "value"), ["alert_id", column], "left")


def vault_key(password: str, salt: bytes, rounds: int = 600_000) -> bytes:
    """A key of 32 bytes from a password, by PBKDF2 with SHA-256, on the driver: the password never reaches a task."""
    if not password or len(salt) < 16:
        raise ValueError("a password and a salt of 16 bytes are needed")
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypted(tokens: DataFrame, key: Column) -> DataFrame:
    """The lookup table with its values under AES-GCM; a value's ciphertext differs from run to run."""
    return tokens.withColumn("value", F.base64(F.aes_encrypt(F.encode("value", "UTF-8"), key, F.lit("GCM"))))


def decrypted(tokens: DataFrame, key: Column) -> DataFrame:
    """The values again; null where the key or the text does not fit."""
    return tokens.withColumn("value", F.decode(F.try_aes_decrypt(F.unbase64("value"), key, F.lit("GCM")), "UTF-8"))


def canary_scan(table: DataFrame, name: str, marked: list[str]) -> DataFrame:
    """table_name, column, n: rows in which a marked value is found in a text column, 0 included."""
    spark = table.sparkSession
    found = hits(table, spark.createDataFrame([(m,) for m in marked], "value string")).groupBy("column").agg(F.count_distinct("row").alias("n"))
    columns = spark.createDataFrame([(c,) for c in text_columns(table)], "column string")
    return columns.join(found, "column", "left").select(F.lit(name).alias("table_name"), "column", F.coalesce("n", F.lit(0)).alias("n"))


def span_violations(cases: DataFrame) -> DataFrame:
    """cases (text, entities: array of type, start, end) with ``violations``: spans empty, outside the text or overlapping."""
    spans = F.array_sort(F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
    empty = F.exists(spans, lambda s: s["start"] >= s["end"])
    outside = F.exists(spans, lambda s: (s["start"] < 0) | (s["end"] > F.length("text")))
    pairs = F.zip_with(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), lambda a, b: a["end"] > b["start"])
    checks = F.array(F.when(empty, F.lit("empty span")), F.when(outside, F.lit("span outside the text")), F.when(F.exists(pairs, lambda p: F.coalesce(p, F.lit(False))), F.lit("overlapping spans")))
    return cases.withColumn("violations", F.filter(checks, lambda v: v.isNotNull()))
