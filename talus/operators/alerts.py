"""Rule-based alerts: triggers, episodes, ids, the alerts' transactions, false positives.

All windows look a bounded number of days back or ahead. So they run in buckets
of time within an account, each with a halo of rows from its neighbours: an
account with a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus import config
from talus.functions.identity import iso_time, uuid5

_DAY = 86_400_000_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def in_buckets(tx: DataFrame, days: int, buckets_of: int = 4) -> DataFrame:
    """tx with ``at`` (microseconds), ``bucket`` and ``own``; rows within ``days`` of a neighbouring bucket are there too, not own."""
    width = days * buckets_of * _DAY
    halo = days * _DAY
    home = F.floor(F.col("at") / F.lit(width))
    inside = F.col("at") - home * width
    # rows near the beginning also serve the bucket before (which looks ahead), rows near the end the one after
    spread = F.array_compact(F.array(home, F.when(inside <= halo, home - 1), F.when(inside >= width - halo, home + 1)))
    return tx.withColumn("at", _micros("timestamp")).withColumn("home", home).withColumn("bucket", F.explode(spread)).withColumn("own", F.col("home") == F.col("bucket")).drop("home")


def _back(account: str, days: int) -> object:
    return W.partitionBy(account, "bucket").orderBy("at").rangeBetween(-days * _DAY, 0)


def _ahead(account: str, days: int) -> object:
    return W.partitionBy(account, "bucket").orderBy("at").rangeBetween(1, days * _DAY)


def value_trigger(rule: config.ValueRule) -> Column:
    return F.col("amount_brl") >= F.lit(rule.least_brl)


def episodes(tx: DataFrame, rule: config.ValueRule | config.VelocityRule, account: str = "sender_account") -> DataFrame:
    """account, rule_id, start, end: triggers that no other follows within the window end an episode.

    It starts with the account's first transaction in the window that the end closes.
    """
    days = rule.days
    rows = tx.select(F.col(account).alias("account"), "timestamp", "amount_brl").where("account IS NOT NULL AND timestamp IS NOT NULL")
    named = lambda df: df.select("account", F.lit(rule.rule_id).alias("rule_id"), "start", F.col("timestamp").alias("end")).distinct()
    more = F.count(F.when(F.col("trigger"), 1)).over(_ahead("account", days))
    if isinstance(rule, config.ValueRule):
        # triggers are few and known from their own row: ends come from them alone, and only their windows are looked up
        hits = in_buckets(rows.where(value_trigger(rule)).select("account", "timestamp").distinct(), days).withColumn("trigger", F.lit(True))
        ends = hits.withColumn("more", more).where("own AND more = 0").select(F.col("account").alias("_account"), (F.col("timestamp") - F.expr(f"INTERVAL {days} DAYS")).alias("_from"), F.col("timestamp").alias("_to"))
        first = within(rows.select("account", "timestamp"), ends, "account", days).groupBy("_account", "_to").agg(F.min("timestamp").alias("start"))
        return named(first.select(F.col("_account").alias("account"), "start", F.col("_to").alias("timestamp")))
    # a trigger ahead looks back itself, which the halo of one window on both sides covers
    marked = in_buckets(rows, days).withColumn("trigger", F.count("*").over(_back("account", days)) >= rule.least_count)
    return named(marked.withColumn("start", F.min("timestamp").over(_back("account", days))).withColumn("more", more).where("own AND trigger AND more = 0"))


def alerts(tx: DataFrame, rules: list[config.ValueRule | config.VelocityRule], account: str = "sender_account", accounts: DataFrame | None = None, customers: DataFrame | None = None) -> DataFrame:
    """alert_id, account, rule_id, start, end, selected_at of all rules; with accounts and customers, only of accounts that have a customer."""
    found = None
    for rule in rules:
        one = episodes(tx, rule, account)
        found = one if found is None else found.unionByName(one)
    name = F.concat_ws("|", "account", "rule_id", iso_time(F.col("start")), iso_time(F.col("end")))
    out = found.select(uuid5(config.ALERT_NAMESPACE, name).alias("alert_id"), "account", "rule_id", "start", "end", F.col("end").alias("selected_at"))
    return out if accounts is None else out.join(account_customers(accounts, customers), "account")


def account_customers(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """account, customer_id, name, cpf_cnpj."""
    return accounts.join(customers.select("customer_id", "name", "cpf_cnpj"), "customer_id").select("account", "customer_id", "name", "cpf_cnpj")


def within(tx: DataFrame, spans: DataFrame, account: str, days: int, last: bool = True) -> DataFrame:
    """tx joined with spans (_account, _from, _to) of its account that hold its time, ``_to`` itself too if last.

    The join is on account and bucket of time, so an account with very many rows
    and spans meets them bucket by bucket.
    """
    width = F.lit(days * _DAY)
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width)
    side = spans.withColumn("_bucket", F.explode(F.sequence(bucket("_from"), bucket("_to"))))
    rows = tx.withColumn("_bucket", bucket("timestamp"))
    upper = rows["timestamp"] <= side["_to"] if last else rows["timestamp"] < side["_to"]
    return rows.join(side, (rows[account] == side["_account"]) & (rows["_bucket"] == side["_bucket"]) & (rows["timestamp"] >= side["_from"]) & upper).drop("_bucket")


def alert_transactions(found: DataFrame, tx: DataFrame, account: str = "sender_account", days: int = 30) -> DataFrame:
    """alert_id, holder, selected_at, seq and the transactions of the account within [start, end], in order of time."""
    side = found.select("alert_id", F.col("account").alias("_account"), F.col("start").alias("_from"), F.col("end").alias("_to"), "selected_at")
    order = W.partitionBy("alert_id").orderBy("timestamp", "transaction_id")
    inside = within(tx, side, account, days)
    return inside.drop("holder").withColumnRenamed("_account", "holder").withColumn("seq", F.row_number().over(order)).drop("_from", "_to")


def false_positives(found: DataFrame, alert_tx: DataFrame) -> DataFrame:
    """rule_id (null: all), alerts, false_positives, rate. An alert none of whose transactions is labelled is false."""
    hit = alert_tx.groupBy("alert_id").agg(F.max("is_laundering").alias("hit"))
    judged = found.select("alert_id", "rule_id").join(hit, "alert_id", "left")
    judged = judged.withColumn("hit", F.coalesce("hit", F.raise_error(F.lit("an alert without labelled transactions")).cast("int")))
    rates = judged.rollup("rule_id").agg(F.count("*").alias("alerts"), F.count_if(F.col("hit") == 0).alias("false_positives"))
    return rates.withColumn("rate", F.coalesce(F.try_divide(F.col("false_positives").cast("double"), F.col("alerts")), F.lit(0.0)))


def nested(found: DataFrame, alert_tx: DataFrame) -> DataFrame:
    """One row for each alert with its transactions as an ordered array, as sinks want it."""
    fields = [c for c in ("transaction_id", "timestamp", "amount_brl", "payment_type", "sender_account", "receiver_account", "sender_location", "receiver_location") if c in alert_tx.columns]
    packed = alert_tx.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("transactions"))
    return found.join(packed, "alert_id", "left")
