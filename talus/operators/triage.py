"""Deterministic triage of alert transactions: four critical detectors and the level.

Input rows are alert transactions: alert_id, holder, seq, timestamp, amount_brl,
payment_type, sender_account, receiver_account, sender_location,
receiver_location. An alert's rows lie within one rule window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus.config import TriageRules

RULE_ORDER = ["FRAGMENTACAO", "CAMADAS", "ESPECIE_DEPOIS_EXTERIOR", "LISTA_RESTRICAO"]


def below(rules: TriageRules) -> Column:
    return F.col("amount_brl") < F.lit(rules.below_brl)


def cross_border() -> Column:
    return (F.col("payment_type") == "TRANSFERENCIA_INTERNACIONAL") | (F.col("sender_location") != F.col("receiver_location"))


def cash_deposit() -> Column:
    return F.col("payment_type") == "ESPECIE_DEPOSITO"


def outbound_transfer() -> Column:
    return F.col("payment_type").isin("PIX", "TED") & (F.col("sender_account") == F.col("holder"))


def fragmentation(alert_tx: DataFrame, rules: TriageRules = TriageRules()) -> DataFrame:
    """alert_id, fired: enough transactions below the limit in a row within the days."""
    order = W.partitionBy("alert_id").orderBy("timestamp", "seq")
    first = F.lag("timestamp", rules.fragment_count - 1).over(order)
    run = alert_tx.where(below(rules)).withColumn("hit", F.col("timestamp") - first <= F.expr(f"INTERVAL {rules.fragment_days} DAYS"))
    fired = run.groupBy("alert_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))
    return alert_tx.select("alert_id").distinct().join(fired, "alert_id", "left").select("alert_id", F.coalesce("hit", F.lit(False)).alias("fired"))


def counterparties(alert_tx: DataFrame, days: int | None = None) -> DataFrame:
    """alert_id, counterparty, direction (in, out), first_seq and the row's seq, id and amount; self-transfers are left out.

    With days, only transactions at most so long before the alert's last one.
    """
    rows = alert_tx
    if days is not None:
        last = F.max("timestamp").over(W.partitionBy("alert_id"))
        rows = rows.withColumn("_last", last).where(F.col("_last") - F.col("timestamp") <= F.expr(f"INTERVAL {days} DAYS"))
    direction = F.when((F.col("receiver_account") == F.col("holder")) & (F.col("sender_account") != F.col("holder")), F.lit("in")).when(
        (F.col("sender_account") == F.col("holder")) & (F.col("receiver_account") != F.col("holder")), F.lit("out")
    )
    other = F.when(F.col("direction") == "in", F.col("sender_account")).otherwise(F.col("receiver_account"))
    return rows.withColumn("direction", direction).where("direction IS NOT NULL").select("alert_id", other.alias("counterparty"), "direction", "seq", "transaction_id", "amount_brl")


def layers(alert_tx: DataFrame, rules: TriageRules = TriageRules()) -> DataFrame:
    """alert_id, depth (directions that have a counterparty), n_counterparties, fired."""
    sides = counterparties(alert_tx, rules.layer_days).groupBy("alert_id", "counterparty").agg(F.bool_or(F.col("direction") == "in").alias("i"), F.bool_or(F.col("direction") == "out").alias("o"))
    found = sides.groupBy("alert_id").agg((F.bool_or("i").cast("int") + F.bool_or("o").cast("int")).alias("depth"), F.count("*").alias("n_counterparties"))
    out = alert_tx.select("alert_id").distinct().join(found, "alert_id", "left").fillna(0, ["depth", "n_counterparties"])
    return out.withColumn("fired", (F.col("depth") >= rules.layer_depth) & (F.col("n_counterparties") >= rules.layer_counterparties))


def cash_then_abroad(alert_tx: DataFrame, rules: TriageRules = TriageRules()) -> DataFrame:
    """alert_id, deposit_id, sending_id: the earliest cash deposit with a cross-border sending by the holder in the days after it.

    A deposit that is itself cross-border pairs with itself.
    """
    # the first sending at or after each deposit's time, by one window over both, instead of all pairs
    send = cross_border() & (F.col("sender_account") == F.col("holder"))
    item = F.struct(F.col("timestamp").alias("s_at"), F.col("seq").alias("s_seq"), F.col("transaction_id").alias("sending_id"))
    ahead = W.partitionBy("alert_id").orderBy(F.unix_micros(F.col("timestamp").cast("timestamp"))).rangeBetween(0, rules.abroad_days * 86_400_000_000)
    rows = alert_tx.where(cash_deposit() | send).withColumn("s", F.min(F.when(send, item)).over(ahead)).where(cash_deposit() & F.col("s").isNotNull())
    first = F.min(F.struct(F.col("timestamp").alias("d_at"), F.col("seq").alias("d_seq"), "s.s_at", "s.s_seq", F.col("transaction_id").alias("deposit_id"), "s.sending_id")).alias("p")
    return rows.groupBy("alert_id").agg(first).select("alert_id", "p.deposit_id", "p.sending_id")


def restriction(alerts: DataFrame, customers: DataFrame, rules: TriageRules = TriageRules()) -> DataFrame:
    """alert_id, one of sim/nao for each list, fired, lookup_ok. alerts: alert_id, customer_id."""
    known = customers.select("customer_id", "restriction_flags", F.lit(True).alias("lookup_ok"))
    joined = alerts.select("alert_id", "customer_id").join(known, "customer_id", "left")
    has = lambda x: F.coalesce(F.array_contains("restriction_flags", x), F.lit(False))
    return joined.select(
        "alert_id",
        *[F.when(has(x), F.lit("sim")).otherwise(F.lit("nao")).alias(x) for x in rules.lists],
        F.exists(F.array(*[has(x) for x in rules.lists]), lambda v: v).alias("fired"),
        F.coalesce("lookup_ok", F.lit(False)).alias("lookup_ok"),
    )


def decide(alert_tx: DataFrame, lists: DataFrame, rules: TriageRules = TriageRules()) -> DataFrame:
    """alert_id, level, state, fired_rules (in the rules' order), rules_version, failure_reason.

    A failed lookup gives NEEDS_HUMAN without a level.
    """
    frag = fragmentation(alert_tx, rules).withColumnRenamed("fired", "f0")
    lay = layers(alert_tx, rules).select("alert_id", F.col("fired").alias("f1"))
    cash = cash_then_abroad(alert_tx, rules).select("alert_id", F.lit(True).alias("f2"))
    rest = lists.select("alert_id", F.col("fired").alias("f3"), "lookup_ok")
    all_ = frag.join(lay, "alert_id", "left").join(cash, "alert_id", "left").join(rest, "alert_id", "left")
    fired = F.filter(F.array(*[F.when(F.col(f"f{i}"), F.lit(r)) for i, r in enumerate(RULE_ORDER)]), lambda r: r.isNotNull())
    ok = F.coalesce("lookup_ok", F.lit(False))
    return all_.select(
        "alert_id",
        F.when(ok, F.when(F.size(fired) > 0, F.lit("INVESTIGAR")).otherwise(F.lit("PROPOR_ARQUIVAMENTO"))).alias("level"),
        F.when(ok, F.lit("TRIAGED")).otherwise(F.lit("NEEDS_HUMAN")).alias("state"),
        F.when(ok, fired).alias("fired_rules"),
        F.lit(rules.version).alias("rules_version"),
        F.when(~ok, F.lit("restriction lookup failed")).alias("failure_reason"),
    )
