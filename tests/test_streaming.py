import datetime as dt
from decimal import Decimal

from talus import config
from talus.operators.alerts import episodes
from talus.streaming import alerts as S

SCHEMA = "sender_account STRING, timestamp TIMESTAMP, amount_brl DECIMAL(18,2)"


def run(spark, df, path, make, name, mode="append"):
    df.write.mode("overwrite").parquet(str(path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_sessions_equal_batch_rule(spark, tmp_path):
    days = [(1, 200000), (5, 150000), (20, 300000), (21, 50), (80, 1)]
    df = spark.createDataFrame([("a", dt.datetime(2023, 1, 1) + dt.timedelta(days=d), Decimal(x)) for d, x in days], SCHEMA).coalesce(1)
    end = spark.createDataFrame([("z", dt.datetime(2024, 1, 1), Decimal(200000))], SCHEMA).coalesce(1)
    df.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "seed"))
    got = run(spark, df.unionByName(end), tmp_path, lambda s: S.value_episodes(s, config.ValueRule()), "value_stream")
    assert {(r["start"].day, r["end"].day, r["n_triggers"]) for r in got.where("account = 'a'").collect()} == {(2, 6, 2), (21, 21, 1)}
    batch = {tuple(r) for r in episodes(df, config.ValueRule()).collect()}
    assert {tuple(r) for r in S.episode_starts(got.where("account = 'a'"), df, config.ValueRule()).collect()} == batch and len(batch) == 2


def test_velocity_and_duplicates(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2023, 1, 1, h), Decimal(1)) for h in range(6)] + [("z", dt.datetime(2023, 3, 1), Decimal(1))], SCHEMA).coalesce(1)
    got = run(spark, df, tmp_path / "v", lambda s: S.velocity_windows(s, config.VelocityRule(least_count=6, days=1)), "velocity_stream")
    assert {(r["account"], r["n"]) for r in got.collect()} == {("a", 6)}
    arriving = spark.createDataFrame([("x", dt.datetime(2023, 1, 1)), ("x", dt.datetime(2023, 1, 1)), ("y", dt.datetime(2023, 1, 1))], "alert_id STRING, selected_at TIMESTAMP").coalesce(1)
    assert run(spark, arriving, tmp_path / "d", S.first_arrivals, "arrivals").count() == 2


def test_state_machine(spark, tmp_path):
    steps = ["RECEIVED", "SANITIZED", "REVIEWING", "TRIAGED"]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(steps)], "alert_id STRING, at INT, state STRING").coalesce(1)
    got = run(spark, df, tmp_path / "s", S.state_machine, "states")
    assert {r["state"]: r["accepted"] for r in got.collect()} == {"RECEIVED": True, "SANITIZED": True, "REVIEWING": False, "TRIAGED": True}
