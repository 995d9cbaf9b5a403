"""The streamed velocity rule against the batch rule and against brute force, with bursts over midnight."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from talus import config
from talus.operators.alerts import episodes
from talus.streaming import alerts as S

SCHEMA = "sender_account STRING, timestamp TIMESTAMP, amount_brl DECIMAL(18,2)"


@pytest.mark.parametrize("days", [1, 30])
def test_stream_finds_every_trigger(spark, tmp_path, days):
    rule, r, start = config.VelocityRule(least_count=6, days=days), random.Random(days), dt.datetime(2023, 1, 1)
    hour = dt.timedelta(hours=days)
    rows = [("midnight", start + h * hour) for h in (21, 22, 23, 24, 25, 26)]
    rows += [("exact", start + h * hour) for h in (23.5, 30, 31, 32, 33, 47.5)] + [("over", start + h * hour) for h in (23, 30, 31, 32, 33, 47.5)]
    rows += [("equal", start + 30 * hour)] * 6 + [("hot", start + r.random() * 200 * hour) for _ in range(60)]
    rows += [(None, start + h * hour) for h in range(6)] + [("null", None)] * 6
    brute = set()
    for a, t in rows:
        seen = [x for b, x in rows if a and t and a == b and x and t - 24 * hour <= x <= t]
        if len(seen) >= 6:
            brute.add((a, min(seen), t, len(seen)))
    df = spark.createDataFrame([(a, t, Decimal(1)) for a, t in rows], SCHEMA).coalesce(1)
    end = spark.createDataFrame([("z", dt.datetime(2025, 1, 1), Decimal(1))], SCHEMA)
    df.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.velocity_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rule)
    q = stream.writeStream.format("memory").queryName(f"triggers_{days}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = [tuple(x) for x in spark.table(f"triggers_{days}").collect()]
    assert len(got) == len(set(got)) and set(got) == brute
    assert sorted(map(tuple, S.velocity_windows(df, rule).collect())) == sorted(brute)
    batch = {(x["account"], x["start"], x["end"]) for x in episodes(df, rule).collect()}
    assert batch and batch <= {x[:3] for x in got} and {a for a, _, _ in batch} >= {"midnight", "exact", "equal"} and "over" not in {a for a, _, _ in batch}
