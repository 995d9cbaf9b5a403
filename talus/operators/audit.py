"""The hash-chained audit log: append, read, verify, count."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus.schemas import AUDIT_EVENTS

#: Fields under an event's hash, in the order of their names.
HASHED = [
    "actor", "alert_id", "corpus_version", "event_key", "event_type", "latency_ms", "mapping_version", "model_id", "occurred_at", "prev_hash", "prompt_sha256", "prompt_version",
    "rules_version", "seq", "state_from", "state_to", "tokens_in", "tokens_out",
]


def event_hash(columns: list[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON: sorted keys, no blanks, nulls written."""
    return F.sha2(F.to_json(F.struct(*(columns or HASHED)), {"ignoreNullFields": "false"}), 256)


def verify(events: DataFrame, chain: str | None = None) -> DataFrame:
    """(chain,) valid, n_events, first_invalid: each row's own hash and its link to the one before, in parallel.

    chain names the column of independent chains; without it there is one log
    whose rows are linked by a join on seq, not by one sorted task.
    """
    keys = [chain] if chain else []
    own = events.withColumn("_own", event_hash())
    before = own.select(*keys, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    rows = own.join(before, [*keys, "seq"], "left")
    good = (F.col("_own") == F.col("hash")) & F.when(F.col("seq") == 1, F.col("prev_hash").isNull()).otherwise(F.coalesce(F.col("prev_hash") == F.col("_before"), F.lit(False)))
    rows = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    first = F.min(F.when(~F.col("_good"), F.col("seq"))).alias("first_invalid")
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(F.coalesce(F.bool_and("_good"), F.lit(True)).alias("valid"), F.count("*").alias("n_events"), first)


def append(events: DataFrame, chain: str, last: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Events with seq, prev_hash and hash, chained in order of occurred_at and event_key within each chain.

    A chain is one fold, so a chain is one group; many chains run in parallel. A null
    chain is a chain like others. last: chain, seq, hash of what is stored (by default
    those of log). Repeated event keys count once, the first, and keys that log holds
    already are not appended again; events without key are all appended.
    """
    if log is not None:
        events = events.join(log.select("event_key").distinct(), "event_key", "left_anti")
        last = last_events(log, chain) if last is None else last
    kinds = {c.strip().split(" ")[0]: c.strip().split(" ")[1].lower() for c in AUDIT_EVENTS.split(", ")}
    wanted = list(kinds)
    own = [c for c in wanted if c not in ("seq", "prev_hash", "hash")]
    first = W.partitionBy("event_key").orderBy("occurred_at")
    named = events.where("event_key IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rows = named.unionByName(events.where("event_key IS NULL"))
    filled = rows.select(F.col(chain).alias("_chain"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in own])
    if last is None:
        filled = filled.withColumn("_seq", F.lit(0).cast("long")).withColumn("_hash", F.lit(None).cast("string"))
    else:
        side = last.select(F.col(chain).alias("_of"), F.col("seq").cast("long").alias("_seq"), F.col("hash").alias("_hash"))
        filled = filled.join(side, F.col("_chain").eqNullSafe(F.col("_of")), "left").drop("_of").fillna(0, ["_seq"])
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seq, link = [], 0, None  # no chain yet
        for batch in batches:
            out = []
            for r in batch.to_pylist():  # whole numbers stay whole, whatever their size
                if [r["_chain"]] != before:
                    before, seq, link = [r["_chain"]], r["_seq"], r["_hash"]
                seq += 1
                event = {c: r[c] for c in own} | {"seq": seq, "prev_hash": link}
                link = hashlib.sha256(json.dumps(event, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
                out.append(event | {"hash": link})
            yield pa.RecordBatch.from_arrays([pa.array([e[c] for e in out], types[kinds[c]]) for c in wanted], wanted)

    return filled.repartition("_chain").sortWithinPartitions("_chain", "occurred_at", "event_key").mapInArrow(fold, AUDIT_EVENTS)


def last_events(events: DataFrame, chain: str) -> DataFrame:
    """chain, seq, hash of each chain's last event."""
    return events.groupBy(chain).agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def events_of(events: DataFrame, alert_id: str) -> DataFrame:
    return events.where(F.col("alert_id") == alert_id).orderBy("seq")


def first_of_type(events: DataFrame, event_type: str = "MODEL_CALLED") -> DataFrame:
    """alert_id, seq, latency_ms, model_id of each alert's first event of a type."""
    first = F.min_by(F.struct("seq", "latency_ms", "model_id"), "seq").alias("e")
    return events.where(F.col("event_type") == event_type).groupBy("alert_id").agg(first).select("alert_id", "e.*")


def usage(events: DataFrame) -> DataFrame:
    """alert_id, calls, tokens in and out of model calls."""
    return events.where("model_id IS NOT NULL").groupBy("alert_id").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def node_key(alert_id: Column, node: Column, attempt: Column, event_type: Column) -> Column:
    """Event key; the type is part of it, so two events of one attempt never collide."""
    return F.concat_ws("_", alert_id, node, attempt.cast("string"), event_type)


def tool_event(server: Column, function: Column, params: Column) -> Column:
    """What is logged of a tool call: its name and the hash of its canonical input."""
    return F.struct(F.concat_ws(".", server, function).alias("tool"), F.sha2(params, 256).alias("input_sha256"))


def append_only_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of the earlier log that are missing or changed in the later one."""
    return before.join(after, ["seq", "event_key", "hash"], "left_anti")
