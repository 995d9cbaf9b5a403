"""Streaming forms of the alert rules, with event time and watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talus import config
from talus.operators.alerts import within


def value_episodes(tx: DataFrame, rule: config.ValueRule, account: str = "sender_account", late: str = "1 day") -> DataFrame:
    """account, start, end, n_triggers, total_brl of episodes of high-value triggers: sessions with the rule's days as the gap.

    A session's end is the gap's end, so the last trigger is the maximum time. Its
    start is the first trigger; ``episode_starts`` gives the batch rule's, the
    account's first transaction in the window that the end closes.
    """
    hits = tx.where(F.col("amount_brl") >= F.lit(rule.least_brl)).withWatermark("timestamp", late)
    session = F.session_window("timestamp", f"{rule.days} days")
    return hits.groupBy(F.col(account).alias("account"), session.alias("w")).agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("n_triggers"), F.sum("amount_brl").alias("total_brl")
    ).drop("w")


def episode_starts(ended: DataFrame, tx: DataFrame, rule: config.ValueRule, account: str = "sender_account") -> DataFrame:
    """account, rule_id, start, end as the batch rule gives them: ended episodes (of a micro-batch) looked up in the stored transactions."""
    spans = ended.select(F.col("account").alias("_account"), (F.col("end") - F.expr(f"INTERVAL {rule.days} DAYS")).alias("_from"), F.col("end").alias("_to"))
    first = within(tx.select(account, "timestamp"), spans, account, rule.days).groupBy("_account", "_to").agg(F.min("timestamp").alias("start"))
    return first.select(F.col("_account").alias("account"), F.lit(rule.rule_id).alias("rule_id"), "start", F.col("_to").alias("end"))


def velocity_windows(tx: DataFrame, rule: config.VelocityRule, account: str = "sender_account", late: str = "1 day", slide: str = "1 day") -> DataFrame:
    """account, start, end, n of every trigger: end is a transaction's time, n the account's transactions in the rule's days up to it, start the first of these.

    Time windows are the rule's days and one slide long, so the days before each
    time in a window's last slide lie within it; the exact trailing windows of
    these times are counted once the window is complete. Equal times give one row.
    """
    span = rule.days * 86_400_000_000
    rows = tx.withWatermark("timestamp", late).where(F.col(account).isNotNull() & F.col("timestamp").isNotNull())
    windows = F.window("timestamp", f"{rule.days} days {slide}", slide)
    times = rows.groupBy(F.col(account).alias("account"), windows.alias("w")).agg(F.collect_list(F.unix_micros("timestamp")).alias("times"))
    kind = tx.schema[account].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for i, (first, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                t = np.sort(own.values.to_numpy())
                last = np.flatnonzero(np.append(t[1:] != t[:-1], True))
                left = np.searchsorted(t, t[last] - span)
                n = last + 1 - left
                keep = (n >= rule.least_count) & (t[last] >= first + span)
                owner += [i] * int(keep.sum())
                found.append(np.stack([t[left], t[last], n])[:, keep])
            start, end, n = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(start), pa.array(end), pa.array(n)], ["account", "start", "end", "n"])

    enough = times.where(F.size("times") >= rule.least_count).select("account", F.unix_micros("w.start").alias("first"), "times")
    found = enough.mapInArrow(task, f"account {kind}, start long, end long, n long")
    return found.select("account", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n")


def first_arrivals(alerts: DataFrame, late: str = "1 day") -> DataFrame:
    """Alerts without the repeats of an id within the watermark."""
    return alerts.withWatermark("selected_at", late).dropDuplicatesWithinWatermark(["alert_id"])


# The states that may follow each state.
NEXT = {
    "": ("RECEIVED",), "RECEIVED": ("SANITIZED", "NEEDS_HUMAN"), "SANITIZED": ("TRIAGED", "NEEDS_HUMAN"), "TRIAGED": ("INVESTIGATING", "DRAFT_READY", "NEEDS_HUMAN"),
    "INVESTIGATING": ("RESEARCHING", "NEEDS_HUMAN"), "RESEARCHING": ("REVIEWING", "NEEDS_HUMAN"), "REVIEWING": ("DRAFT_READY", "NEEDS_HUMAN"), "DRAFT_READY": ("SUBMITTED", "APPROVED", "RETURNED"),
    "SUBMITTED": ("APPROVED", "RETURNED"), "RETURNED": ("SUBMITTED",), "APPROVED": (), "NEEDS_HUMAN": ("DRAFT_READY",),
}


def state_machine(events: DataFrame) -> DataFrame:
    """alert_id, state, accepted of each arriving event (alert_id, at, state): the state is kept for each alert, and a step that may not follow is refused.

    An alert's state, one short text, is kept for good: a decision may come after years.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else ""
        rows = pd.concat(list(parts)).sort_values(["at", "state"])
        accepted = []
        for wanted in rows["state"]:
            ok = wanted in NEXT.get(now, ())
            now = wanted if ok else now
            accepted.append(ok)
        state.update((now,))
        yield pd.DataFrame({"alert_id": [key[0]] * len(rows), "state": rows["state"].to_numpy(), "accepted": accepted})

    return events.groupBy("alert_id").applyInPandasWithState(step, "alert_id string, state string, accepted boolean", "state string", "append", GroupStateTimeout.NoTimeout)
