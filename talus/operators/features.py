"""Indicators of alerts in long form: F01 to F13, and F14 on for each counterparty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus.config import TriageRules
from talus.functions.dates import duration_days
from talus.operators.alerts import within
from talus.operators.triage import below, cash_deposit, cash_then_abroad, counterparties, cross_border, outbound_transfer


def _ids(condition: Column | None = None) -> Column:
    """Transaction ids in the alert's order."""
    item = F.struct("seq", "transaction_id")
    return F.transform(F.array_sort(F.collect_list(item if condition is None else F.when(condition, item))), lambda x: x["transaction_id"])


def reais(total: Column) -> Column:
    """Half up to whole reais."""
    return F.round(total, 0).cast("long")


def basic(alert_tx: DataFrame, rules: TriageRules = TriageRules()) -> DataFrame:
    """One wide row for each alert: F01 to F05, F09 and F12, in one aggregation."""
    return alert_tx.groupBy("alert_id").agg(
        F.count("*").alias("f01"),
        reais(F.sum("amount_brl")).alias("f02"),
        F.count_if(below(rules)).alias("f03"),
        F.count_if(cash_deposit()).alias("f04"),
        F.count_if(outbound_transfer()).alias("f05"),
        F.count_if(cross_border()).alias("f09"),
        F.count_distinct(F.to_date("timestamp")).alias("f12"),
    )


def by_counterparty(alert_tx: DataFrame) -> DataFrame:
    """alert_id, counterparty, n_in, n_out, brl, first seen in and out, ids."""
    return counterparties(alert_tx).groupBy("alert_id", "counterparty").agg(
        F.count_if(F.col("direction") == "in").alias("n_in"),
        F.count_if(F.col("direction") == "out").alias("n_out"),
        reais(F.sum("amount_brl")).alias("brl"),
        F.min(F.when(F.col("direction") == "in", F.col("seq"))).alias("first_in"),
        F.min(F.when(F.col("direction") == "out", F.col("seq"))).alias("first_out"),
        _ids().alias("ids"),
        _ids(F.col("direction") == "in").alias("ids_in"),
        _ids(F.col("direction") == "out").alias("ids_out"),
    )


def ranked_counterparties(alert_tx: DataFrame) -> DataFrame:
    """F14 on: by reais, largest first, ties by counterparty."""
    order = W.partitionBy("alert_id").orderBy(F.desc("brl"), "counterparty")
    rows = by_counterparty(alert_tx).withColumn("n", F.row_number().over(order))
    return rows.select("alert_id", F.format_string("F%02d", F.col("n") + 13).alias("feature_id"), "counterparty", "n_in", "n_out", "brl", F.format_string("in=%d out=%d brl=%d", "n_in", "n_out", "brl").alias("value"), "ids")


def history(alerts: DataFrame, tx: DataFrame, account: str = "sender_account", days: int = 180) -> DataFrame:
    """alert_id, history_brl: the account's total in [selected_at - days, selected_at), joined by month."""
    side = alerts.select("alert_id", F.col("account").alias("_account"), (F.col("selected_at") - F.expr(f"INTERVAL {days} DAYS")).alias("_from"), F.col("selected_at").alias("_to"))
    past = within(tx.select(account, "timestamp", "amount_brl"), side, account, 30, last=False)
    return alerts.select("alert_id").join(past.groupBy("alert_id").agg(F.sum("amount_brl").alias("history_brl")), "alert_id", "left").fillna(0, ["history_brl"])


def volume_ratio(total: Column, history_brl: Column, start: Column, end: Column) -> Column:
    """The window's total against the history's for as long a time, one decimal, half to even, as ``16.4x``.

    A window lasts at least a millionth of a day and the divisor is at least a cent.
    """
    days = F.greatest(duration_days(start, end), F.lit(1e-6)).cast("decimal(18,6)")
    expected = F.greatest(history_brl.cast("decimal(18,2)") * days / F.lit(180).cast("decimal(4,0)"), F.lit("0.01").cast("decimal(18,2)"))
    return F.concat(F.bround(total.cast("decimal(18,2)") / expected, 1).cast("decimal(38,1)").cast("string"), F.lit("x"))


def indicators(alerts: DataFrame, alert_tx: DataFrame, past: DataFrame, lists: DataFrame, rules: TriageRules = TriageRules()) -> DataFrame:
    """All features in long form: alert_id, feature_id, name, value_int, value_str, transaction_ids.

    alerts: alert_id, start, end; past: alert_id, history_brl; lists: alert_id and one column for each list.
    """
    own = alert_tx.groupBy("alert_id").agg(
        F.count("*").alias("F01"), reais(F.sum("amount_brl")).alias("F02"), F.sum("amount_brl").alias("total"), F.count_if(below(rules)).alias("F03"), F.count_if(cash_deposit()).alias("F04"),
        F.count_if(outbound_transfer()).alias("F05"), F.count_if(cross_border()).alias("F09"), F.count_distinct(F.to_date("timestamp")).alias("F12"),
        _ids().alias("i_all"), _ids(below(rules)).alias("i_F03"), _ids(cash_deposit()).alias("i_F04"), _ids(outbound_transfer()).alias("i_F05"), _ids(cross_border()).alias("i_F09"),
    )
    ordered = lambda first, ids: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(first).isNotNull(), F.struct(first, ids)))), lambda x: x[ids]))
    sides = by_counterparty(alert_tx).groupBy("alert_id").agg(
        F.count("first_in").alias("F06"), F.count("first_out").alias("F07"), ordered("first_in", "ids_in").alias("i_F06"), ordered("first_out", "ids_out").alias("i_F07")
    )
    depth = counterparties(alert_tx, rules.layer_days).groupBy("alert_id").agg(
        (F.bool_or(F.col("direction") == "in").cast("int") + F.bool_or(F.col("direction") == "out").cast("int")).cast("long").alias("F08"), F.array_sort(F.collect_set("transaction_id")).alias("i_F08")
    )
    wide = (
        alerts.select("alert_id", "start", "end").join(own, "alert_id").join(sides, "alert_id", "left").join(depth, "alert_id", "left")
        .join(cash_then_abroad(alert_tx, rules), "alert_id", "left").join(past.select("alert_id", "history_brl"), "alert_id", "left").join(lists.select("alert_id", *rules.lists), "alert_id", "left")
    )
    none = F.array().cast("array<string>")
    listed = F.concat_ws(",", *[F.concat(F.lit(f"{x}:"), F.coalesce(F.col(x), F.lit("nao"))) for x in rules.lists])
    pair = F.when(F.col("deposit_id").isNotNull(), F.array_distinct(F.array("deposit_id", "sending_id"))).otherwise(none)
    ratio = volume_ratio(F.col("total"), F.coalesce("history_brl", F.lit(0)), F.col("start"), F.col("end"))

    def row(i: str, name: str, number: Column | None, text: Column | None, ids: Column) -> Column:
        return F.struct(
            F.lit(i).alias("feature_id"), F.lit(name).alias("name"), (F.lit(None) if number is None else F.coalesce(number, F.lit(0))).cast("long").alias("value_int"),
            (F.lit(None) if text is None else text).cast("string").alias("value_str"), F.coalesce(ids, none).alias("transaction_ids"),
        )

    c = F.col
    rows = F.array(
        row("F01", "tx_janela", c("F01"), None, c("i_all")), row("F02", "total_brl", c("F02"), None, c("i_all")), row("F03", "abaixo_limiar", c("F03"), None, c("i_F03")),
        row("F04", "dep_especie", c("F04"), None, c("i_F04")), row("F05", "saida_pix_ted", c("F05"), None, c("i_F05")), row("F06", "contrap_entrada", c("F06"), None, c("i_F06")),
        row("F07", "contrap_saida", c("F07"), None, c("i_F07")), row("F08", "profundidade_camadas", c("F08"), None, c("i_F08")), row("F09", "transfronteira", c("F09"), None, c("i_F09")),
        row("F10", "especie_depois_exterior", None, F.when(c("deposit_id").isNotNull(), F.lit("sim")).otherwise(F.lit("nao")), pair),
        row("F11", "vol_vs_media180d", None, ratio, c("i_all")), row("F12", "dias_ativos", c("F12"), None, c("i_all")), row("F13", "listas", None, listed, none),
    )
    fixed = wide.select("alert_id", F.inline(rows))
    ranked = ranked_counterparties(alert_tx).select("alert_id", "feature_id", F.col("counterparty").alias("name"), F.lit(None).cast("long").alias("value_int"), F.col("value").alias("value_str"), F.col("ids").alias("transaction_ids"))
    return reduce(DataFrame.unionByName, [fixed, ranked])


def rendered(f: Column | str = "value_int", s: Column | str = "value_str") -> Column:
    return F.coalesce(F.col(s) if isinstance(s, str) else s, (F.col(f) if isinstance(f, str) else f).cast("string"))


def prompt_lines(features: DataFrame, budget: int = 300, tokens: Column | None = None) -> DataFrame:
    """alert_id, feature_id, line, kept: lines in the prompt. F14 on are dropped, least reais first (ties: highest id), until all fit.

    tokens: tokens of a line, additive; words between blanks by default.
    """
    line = F.when(F.col("feature_id") > "F13", F.concat_ws(" ", "feature_id", "name", rendered())).otherwise(F.concat(F.col("feature_id"), F.lit(" "), F.col("name"), F.lit("="), rendered()))
    rows = features.withColumn("line", line).withColumn("number", F.substring("feature_id", 2, 9).cast("int"))
    rows = rows.withColumn("brl", F.regexp_extract("value_str", r"brl=(-?\d+)", 1).try_cast("long"))
    rows = rows.withColumn("n_tokens", F.size(F.split(F.trim("line"), r"\s+")).cast("long") if tokens is None else tokens)
    extra = F.col("number") > 13
    base = F.sum(F.when(~extra, F.col("n_tokens")).otherwise(0)).over(W.partitionBy("alert_id"))
    running = F.sum(F.when(extra, F.col("n_tokens")).otherwise(0)).over(W.partitionBy("alert_id").orderBy(extra.cast("int"), F.desc("brl"), "number").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("kept", ~extra | (base + running <= budget)).select("alert_id", "feature_id", "line", "n_tokens", "kept")


def prompts(features: DataFrame, head: str, budget: int = 300) -> DataFrame:
    """alert_id, prompt, dropped: instructions and the kept lines in order of their ids."""
    lines = prompt_lines(features, budget)
    item = F.struct(F.substring("feature_id", 2, 9).cast("int").alias("n"), "line")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), item))), lambda x: x["line"])
    return lines.groupBy("alert_id").agg(F.concat(F.lit(head + "\n"), F.array_join(kept, "\n")).alias("prompt"), F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("feature_id")))).alias("dropped"))
