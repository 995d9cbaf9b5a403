"""Keyed velocity state against the batch rule, and sinks whose stream is stopped between write and commit."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from talus import config
from talus.operators import audit
from talus.operators.alerts import episodes
from talus.schemas import AUDIT_EVENTS
from talus.streaming import keyed, sinks

SCHEMA = "sender_account STRING, timestamp TIMESTAMP, amount_brl DECIMAL(18,2)"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.STATE_PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("days", [1, 30])
def test_keyed_episodes_equal_the_batch_rule(rocks, tmp_path, days):
    spark, rule, r, start = rocks, config.VelocityRule(least_count=6, days=days), random.Random(days), dt.datetime(2023, 1, 1)
    hour = dt.timedelta(hours=days)
    rows = [("midnight", start + h * hour) for h in (21, 22, 23, 24, 25, 26)] + [("equal", start + 30 * hour)] * 6
    rows += [("exact", start + h * hour) for h in (23.5, 30, 31, 32, 33, 47.5)] + [("over", start + h * hour) for h in (23, 30, 31, 32, 33, 47.5)]
    rows += [("hot", start + r.random() * 300 * hour) for _ in range(120)] + [(f"u{i % 4}", start + r.random() * 300 * hour) for i in range(160)]
    rows += [(None, start + h * hour) for h in range(6)] + [("null", None)] * 6
    df = spark.createDataFrame([(a, t, Decimal(1)) for a, t in rows], SCHEMA)
    # files in order of time but for rows up to half a day late, as the watermark allows
    late = df.withColumn("due", F.unix_micros("timestamp") + F.pmod(F.xxhash64("sender_account", "timestamp"), F.lit(12 * 3600 * 10**6)))
    late = [tuple(x) for x in late.orderBy(F.col("due").asc_nulls_first()).drop("due").collect()]
    for i in range(6):
        spark.createDataFrame(late[i * len(late) // 6 : (i + 1) * len(late) // 6], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for day in (dt.datetime(2030, 1, 1), dt.datetime(2031, 1, 1)):  # times move on, so timers ring
        spark.createDataFrame([("z", day, Decimal(1))], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"episodes_{days}"
    q = keyed.velocity_episodes(stream, rule).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = sorted(map(tuple, spark.table(name).collect()))
    assert got == sorted(map(tuple, episodes(df, rule).collect())) and len(got) > 5
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "times").load()
    assert state.count() <= 2  # all windows have passed: only the last file's account may wait


def test_replayed_batches_count_once(spark, tmp_path):
    path, seen = str(tmp_path / "sink"), []
    schema = "alert_id STRING, seq LONG, state STRING, updated_at TIMESTAMP, created_at TIMESTAMP, selected_at TIMESTAMP"
    day = lambda i: dt.datetime(2023, 1, 1) + dt.timedelta(days=i)
    for i in range(4):
        spark.createDataFrame([(f"a{k}", i, f"s{i}", day(i), day(i), day(i)) for k in range(5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stop_at_two(batch):
        seen.append(batch)
        if batch == 2 and seen.count(2) == 1:
            raise RuntimeError("stopped")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(sinks.once(path, before_commit=stop_at_two)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)

    with pytest.raises(StreamingQueryException):
        run()
    assert sinks.committed(spark, path) == [0, 1] and sinks.read(spark, path, schema).count() == 10
    run()
    assert sinks.committed(spark, path) == [0, 1, 2, 3] and seen == [0, 1, 2, 2, 3]
    assert sinks.read(spark, path, schema).count() == 20
    got = sinks.records(spark, path, schema).collect()
    assert len(got) == 5 and all((r["seq"], r["created_at"].day) == (3, 1) for r in got)
    sinks.once(path)(spark.createDataFrame([("b", 9, "x", day(1), day(1), day(1))], schema), 3)  # a batch that counts already
    assert sinks.read(spark, path, schema).count() == 20


def test_chain_goes_on_after_a_stop(spark, tmp_path):
    path = str(tmp_path / "log")
    events = lambda i: spark.createDataFrame([(f"a{k}", f"e{i}-{k}", f"2023-01-0{i + 1}") for k in range(3)], "alert_id STRING, event_key STRING, occurred_at STRING")

    def stop(batch):
        raise RuntimeError("stopped")

    sinks.chained(path, AUDIT_EVENTS)(events(0), 0)
    with pytest.raises(RuntimeError):
        sinks.chained(path, AUDIT_EVENTS, before_commit=stop)(events(1), 1)
    for batch, i in ((1, 1), (1, 1), (2, 2)):
        sinks.chained(path, AUDIT_EVENTS)(events(i), batch)
    log = sinks.read(spark, path, AUDIT_EVENTS)
    assert log.count() == 9 and all(r["valid"] and r["n_events"] == 3 for r in audit.verify(log, "alert_id").collect())
