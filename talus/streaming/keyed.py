"""The velocity rule as a keyed state machine: each event is held once, in its account's state, and timers end what is complete.

State needs the RocksDB provider: ``spark.sql.streaming.stateStore.providerClass``,
see ``STATE_PROVIDER``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from talus import config

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MS = 1000


class VelocityEpisodes(StatefulProcessor):
    """Episodes of velocity triggers of one account.

    ``times`` maps a time (microseconds) to its number of events, ``open`` holds the start and
    end of the last trigger that no later one has joined or closed, ``done`` the time up to which triggers are known,
    ``alarm`` the timer that is set. A time is judged once the watermark passes
    it, so late rows within the watermark count, and times older than the rule's days
    before that are dropped: the state is bounded by the window. With nothing
    left to wait for, the account's state is gone.
    """

    def __init__(self, rule: config.VelocityRule):
        self._span, self._least, self._rule_id = rule.days * 86_400_000_000, rule.least_count, rule.rule_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._times = handle.getMapState("times", "at LONG", "n LONG")
        self._open = handle.getValueState("open", "start LONG, end LONG")
        self._done = handle.getValueState("done", "at LONG")
        self._alarm = handle.getValueState("alarm", "at LONG")

    def _rows(self, key: tuple, ended: list[tuple[int, int]]) -> pd.DataFrame:
        text = lambda v: pd.Series([v] * len(ended), dtype=object)
        return pd.DataFrame({"account": text(key[0]), "rule_id": text(self._rule_id), "start": np.array([a for a, _ in ended], np.int64), "end": np.array([b for _, b in ended], np.int64)})

    def _set_alarm(self, at_ms: int | None) -> None:
        before = self._alarm.get()[0] if self._alarm.exists() else None
        if before == at_ms:
            return
        if before is not None:
            self._handle.deleteTimer(before)
        if at_ms is None:
            self._alarm.clear()
        else:
            self._handle.registerTimer(at_ms)
            self._alarm.update((at_ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for at, n in part["at"].value_counts().items():
                k = (int(at),)
                self._times.updateValue(k, ((self._times.getValue(k)[0] if self._times.containsKey(k) else 0) + int(n),))
                first = int(at) if first is None else min(first, int(at))
        if first is not None:
            due = -(-first // _MS)
            before = self._alarm.get()[0] if self._alarm.exists() else None
            self._set_alarm(due if before is None else min(before, due))
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * _MS
        pairs = sorted((k[0], v[0]) for k, v in self._times.iterator())
        t = np.array([p[0] for p in pairs], np.int64)
        total = np.concatenate([[0], np.cumsum([p[1] for p in pairs])]).astype(np.int64)
        done = self._done.get()[0] if self._done.exists() else -(2**62)
        open_ = tuple(self._open.get()) if self._open.exists() else None
        ended = []
        left = np.searchsorted(t, t - self._span)
        counts = total[1:] - total[left]
        for i in np.flatnonzero((t > done) & (t <= upto) & (counts >= self._least)).tolist():
            if open_ is not None and int(t[i]) - open_[1] > self._span:
                ended.append(open_)
            open_ = (int(t[left[i]]), int(t[i]))
        done = upto
        if open_ is not None and open_[1] + self._span < done:  # no trigger can follow within the rule's days
            ended.append(open_)
            open_ = None
        for at in t[t < done - self._span].tolist():
            self._times.removeKey((at,))
        self._done.update((done,))
        if open_ is None:
            self._open.clear()
        else:
            self._open.update(open_)
        self._alarm.clear()  # it has rung
        waiting = t[t > done]
        kept = t[t >= done - self._span]
        next_ = [-(-int(waiting[0]) // _MS)] if len(waiting) else []
        next_ += [(open_[1] + self._span) // _MS + 1] if open_ is not None else []
        if not next_ and len(kept):
            next_ = [(int(kept[-1]) + self._span) // _MS + 1]  # only to let go of the last times
        if next_:
            self._set_alarm(max(min(next_), upto // _MS + 1))
        else:
            self._done.clear()
        yield self._rows(key, ended)

    def close(self) -> None:
        pass


def velocity_episodes(tx: DataFrame, rule: config.VelocityRule, account: str = "sender_account", late: str = "1 day") -> DataFrame:
    """account, rule_id, start, end as ``operators.alerts.episodes`` gives them, each once the watermark has passed the rule's days after its end."""
    rows = tx.where(F.col(account).isNotNull() & F.col("timestamp").isNotNull()).select(F.col(account).cast("string").alias("account"), F.col("timestamp").cast("timestamp").alias("timestamp"))
    rows = rows.withWatermark("timestamp", late).withColumn("at", F.unix_micros("timestamp"))
    found = rows.groupBy("account").transformWithStateInPandas(VelocityEpisodes(rule), "account STRING, rule_id STRING, start LONG, end LONG", "append", "EventTime")
    return found.select("account", "rule_id", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"))
