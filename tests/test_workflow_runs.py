"""Node steps, records, audit details and helpers against small known cases."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from talus import config
from talus.operators import audit, evaluation, retrieval, sampling, sanitize, workflow
from talus.sources import saml, store

RECORDS = "alert_id STRING, node STRING, state STRING, level STRING, failure_reason STRING, occurred_at STRING"
OUTCOMES = "alert_id STRING, node STRING, attempt INT, state STRING, level STRING, error STRING, occurred_at STRING"


def test_nodes_fail_closed_and_resume(spark, tmp_path):
    records = spark.createDataFrame([(a, "sanitizer", "RECEIVED", None, None, "t0") for a in "abcd"], RECORDS)
    good = [("a", "sanitizer", 1, "SANITIZED", None, None, "t1"), ("b", "sanitizer", 1, None, None, "no", "t1"), ("b", "sanitizer", 2, "SANITIZED", None, None, "t2")]
    bad = [("c", "sanitizer", i, None, None, f"bad {i}", f"t{i}") for i in (1, 2, 3)] + [("c", "sanitizer", 4, "SANITIZED", None, None, "t4")]
    triage = [("a", "triage", 1, "TRIAGED", "PROPOR_ARQUIVAMENTO", None, "t5"), ("b", "triage", 1, "TRIAGED", "INVESTIGAR", None, "t5")]
    after = [("a", "dossier", 1, "DRAFT_READY", None, None, "t6")]
    outcomes = spark.createDataFrame(good + bad + triage + after, OUTCOMES)
    kept = []

    def checkpoint(df, name):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        kept.append(name)
        return spark.read.parquet(str(tmp_path / name))

    final, events = workflow.run_nodes(records, outcomes, checkpoint)
    got = {r["alert_id"]: (r["node"], r["state"], r["level"], r["failure_reason"]) for r in final.collect()}
    assert got["a"] == ("end", "DRAFT_READY", "PROPOR_ARQUIVAMENTO", None)
    assert got["b"] == ("human_handoff", "NEEDS_HUMAN", "INVESTIGAR", "investigation: no outcome")
    assert got["c"] == ("human_handoff", "NEEDS_HUMAN", None, "bad 3") and got["d"][3] == "sanitizer: no outcome"
    keys = [r["event_key"] for r in events.collect()]
    assert len(keys) == len(set(keys)) == 9 and "c_sanitizer_3_NODE_FAILED" in keys and not any("sanitizer_4" in k for k in keys)
    assert kept[0] == "records-sanitizer" and len(kept) == 2 * len(config.NODES)
    log = audit.append(events, "alert_id")
    again = audit.append(events, "alert_id", log=log)
    assert again.count() == 0 and all(r["valid"] for r in audit.verify(log, "alert_id").collect())
    day = dt.datetime(2026, 9, 1)
    alerts = spark.createDataFrame([(a, "x", "r", day, day, day) for a in "abcd"], "alert_id STRING, account STRING, rule_id STRING, start TIMESTAMP, end TIMESTAMP, selected_at TIMESTAMP")
    rows = {r["alert_id"]: r for r in workflow.to_records(final.drop("node"), alerts).collect()}
    assert all(r["violations"] == [] for r in rows.values()) and rows["a"]["prazo_interno"] == day + dt.timedelta(5)


def test_chain_of_odd_text(spark):
    """The appended hash (Python) and the verified one (Spark) agree beyond ASCII."""
    odd = ["é ß 한", 'quote " back \\ slash /', "tab\t line\n feed\r \x07 \x7f", "  ", "😀 ퟿", "<&>'"]
    rows = [("a", f"a_{i}", f"2026-01-0{i + 1}", t, "system") for i, t in enumerate(odd)]
    log = audit.append(spark.createDataFrame(rows, "alert_id STRING, event_key STRING, occurred_at STRING, event_type STRING, actor STRING"), "alert_id")
    assert tuple(audit.verify(log, "alert_id").first()) == ("a", True, len(odd), None)


def test_audit_readers(spark):
    cols = "alert_id STRING, event_key STRING, occurred_at STRING, event_type STRING, actor STRING, model_id STRING, prompt_sha256 STRING, prompt_version STRING, tokens_in LONG, tokens_out LONG, latency_ms LONG"
    rows = [("a", f"a_{i}", f"t{i}", kind, "x", m, "h" if m else None, "p" if m else None, ti, to, ms) for i, (kind, m, ti, to, ms) in enumerate([("T", None, None, None, None), ("MODEL_CALLED", "m", 10, 2, 50), ("MODEL_CALLED", "m", 5, 1, 70)], 1)]
    log = audit.append(spark.createDataFrame(rows, cols), "alert_id")
    assert audit.verify(log).first()["valid"] and [r["seq"] for r in audit.events_of(log, "a").collect()] == [1, 2, 3]
    assert tuple(audit.first_of_type(log).first()) == ("a", 2, 50, "m") and tuple(audit.usage(log).first()) == ("a", 2, 15, 3)
    assert all(r["violations"] == [] for r in workflow.event_violations(log).collect())
    wrong = log.withColumn("model_id", F.lit(None).cast("string")).withColumn("event_key", F.lit("zz"))
    assert [len(r["violations"]) for r in workflow.event_violations(wrong).orderBy("seq").collect()] == [1, 3, 3]
    key = spark.range(1).select(audit.node_key(F.lit("a"), F.lit("triage"), F.lit(2), F.lit("NODE_FAILED")).alias("k"), audit.tool_event(F.lit("s"), F.lit("f"), F.lit("{}")).alias("t")).first()
    assert key["k"] == "a_triage_2_NODE_FAILED" and key["t"]["tool"] == "s.f" and len(key["t"]["input_sha256"]) == 64


def test_contract_rows(spark):
    r = spark.createDataFrame([("NEEDS_HUMAN", None, None, 1, 2, 5), ("TRIAGED", None, None, 1, 2, 5), ("INVESTIGATING", "PROPOR_ARQUIVAMENTO", None, 3, 2, 0), ("?", "INVESTIGAR", "x", 1, 2, 5), ("RECEIVED", None, None, 1, 1, 1)], "state STRING, triage_level STRING, failure_reason STRING, start INT, end INT, amount INT")
    assert [len(x["violations"]) for x in workflow.record_violations(r).collect()] == [1, 1, 3, 2, 0]
    v = spark.createDataFrame([(["a"], ["b"]), (["a", "b"], ["b"]), (["a", "a"], [])], "verified ARRAY<STRING>, rejected ARRAY<STRING>")
    assert [len(x["violations"]) for x in workflow.disjoint_violations(v).collect()] == [0, 1, 1]
    t = spark.createDataFrame([("Structuring",), ("NENHUMA",)], "typology STRING")
    found = {x["typology"]: x["incisos"] for x in workflow.typology_incisos(t, config.labels(spark)).collect()}
    assert found == {"Structuring": ["I", "IV"], "NENHUMA": None}
    with pytest.raises(ValueError):
        workflow.typology_incisos(spark.createDataFrame([("?",)], "typology STRING"), config.labels(spark))
    e = spark.createDataFrame([("a", ["F02", "F99", "F01"])], "alert_id STRING, evidence ARRAY<STRING>")
    f = spark.createDataFrame([("a", "F01", "n1", 1, None), ("a", "F02", "n2", 2, None)], "alert_id STRING, feature_id STRING, name STRING, value_int LONG, value_str STRING")
    assert [x["feature_id"] for x in workflow.evidence_features(e, f).first()["evidence"]] == ["F02", "F01"]
    assert e.select(workflow.missing_evidence(F.col("evidence"), F.array(F.lit("F01"), F.lit("F02")))).first()[0] == ["F99"]
    assert config.label_coverage({"a", "b"}, {"b"}, {"a", "c"}) == ["on both sides: b", "unknown: c", "missing: b"]


def test_retrieval_texts(spark):
    q = spark.createDataFrame([("Structuring", ["I", "IV"])], "t STRING, i ARRAY<STRING>")
    assert q.select(retrieval.search_query(F.col("t"), F.col("i"))).first()[0] == "Structuring: indícios enquadrados no art. 1º, incisos {I, IV}, da CC 4.001/2020"
    chunks = spark.createDataFrame([("c1", "v1", "x", "h")], "chunk_id STRING, corpus_version STRING, text STRING, text_sha256 STRING")
    asked = spark.createDataFrame([("c1", "v1"), ("c1", "v0")], "chunk_id STRING, corpus_version STRING")
    assert {(r["corpus_version"], r["found"]) for r in retrieval.passages(asked, chunks).collect()} == {("v1", True), ("v0", False)}
    tokens = spark.createDataFrame([("a", "CONTA", "123", "CONTA_01")], "alert_id STRING, kind STRING, value STRING, token STRING")
    rows = spark.createDataFrame([("a", "CONTA_01"), ("b", "CONTA_01")], "alert_id STRING, token STRING")
    assert {(r["alert_id"], r["value"]) for r in sanitize.reidentified(rows, "token", tokens).collect()} == {("a", "123"), ("b", None)}


def test_percentiles_against_sorting(spark):
    r = random.Random(7)
    cases = {"one": [3.0], "ties": [1.0] * 50 + [2.0], "many": [r.gauss(0, 9) for _ in range(5000)], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs] + [("none", None), (None, 5.0)], "g STRING, v DOUBLE")
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(x["g"], x["share"]): (x["linear"], x["nearest"]) for x in evaluation.percentiles(df, "v", shares, ["g"]).collect()}
    for (g, vs), p in itertools.product([*cases.items(), (None, [5.0])], shares):
        s = sorted(vs)
        at = (len(s) - 1) * p
        lo = int(at)
        want = s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (at - lo)
        near = s[max(1, -(-round(len(s) * p * 1e9) // 10**9)) - 1]
        assert got[g, p] == (pytest.approx(want), near)
    assert len(got) == 5 * len(shares)
    whole = evaluation.latency_summary(df.where("g = 'many'"), "v").first()
    assert whole["n"] == 5000 and whole["p50"] == pytest.approx(got["many", 0.5][0])
    assert evaluation.latency_summary(df.limit(0), "v").first()["p50"] is None


def test_samples_by_hash(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    order = [r["k"] for r in df.orderBy(sampling.hash_order(5, F.col("k")), "k").collect()]
    for n in (0, 1, 37, 1500, 2999, 3000, 4000):
        for digits in (1, 4):
            assert {r["k"] for r in sampling.first_by_hash(df, n, 5, "k", digits).collect()} == set(order[:n])


def test_golden_set_is_apart_from_development(spark):
    labels = config.labels(spark)
    rules = config.SplitRules(per_critical=2, per_other=1, normals=20)
    names = [r["label"] for r in labels.collect()]
    alerts = [(f"{x}-{i}", f"acc-{x}-{i}") for x in names for i in range(60)]
    tx = spark.createDataFrame([(a, x) for x in names for a, _ in [al for al in alerts if al[0].rsplit("-", 1)[0] == x]], "alert_id STRING, laundering_type STRING")
    found = spark.createDataFrame(alerts, "alert_id STRING, account STRING")
    bad = {r["label"] for r in labels.where("suspicious").collect()}
    classes = spark.createDataFrame([(c, a.rsplit("-", 1)[0] in bad) for a, c in alerts], "account STRING, suspicious BOOLEAN")
    golden, dev = sampling.golden_set(found, tx, classes, labels, rules)
    chosen = golden.join(found, "alert_id")
    assert golden.groupBy().agg(F.count("*")).first()[0] == 6 * 2 + 11 + 20
    assert chosen.join(dev.select("account"), "account", "left_semi").count() == 0
    sizes = {r["label"]: r["available"] for r in sampling.development_sizes(dev, labels).collect()}
    assert len(sizes) == 28 and sum(sizes.values()) == dev.count() == classes.count() - sampling.split_accounts(classes, rules).where("golden").count()


def test_positions_over_many_partitions(spark, tmp_path):
    header = ",".join([*saml.FIXED, "Is_laundering", "Laundering_type"])
    lines = [f"10:00:00,2022-10-07,{i + 1},2,1.00,Euro,Euro,UK,UK,ACH,0,Normal_Group" for i in range(4000)]
    (tmp_path / "f.csv").write_text("\n".join([header, *lines]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        got = saml.with_position(saml.scan(spark, str(tmp_path / "f.csv"))).select("position", F.col("Sender_account").cast("long").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4000 and all(r["position"] == r["n"] for r in got)


def test_store_tables(spark, tmp_path):
    day = dt.datetime(2023, 1, 1)
    tx = spark.createDataFrame([(f"t{i}", day + dt.timedelta(hours=-i), Decimal(i), f"a{i % 3}", i % 2) for i in range(30)], "transaction_id STRING, timestamp TIMESTAMP, amount_brl DECIMAL(18,2), sender_account STRING, is_laundering INT")
    customers = spark.createDataFrame([("c1", "n", ["a0", "a1"])], "customer_id STRING, name STRING, accounts ARRAY<STRING>")
    store.write_transactions(tx, str(tmp_path / "tx"))
    store.write_customers(customers, str(tmp_path / "c"))
    store.write_meta(spark, {"seed": "1"}, str(tmp_path / "m"))
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    assert read("m").first()["value"] == "1" and read("c/accounts").count() == 2
    rows = [(r["sender_account"], r["timestamp"]) for r in store.accounts_in_order(spark, str(tmp_path / "tx"), "a1", "a2").collect()]
    assert rows == sorted(rows) and len(rows) == 20
    checks = {r["check"]: r["n"] for r in store.constraint_violations(tx, read("c/customers"), read("c/accounts")).collect()}
    assert checks["amount not positive"] == 1 and sum(checks.values()) == 1
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "alert_id STRING, created_at INT, selected_at INT")
    new = spark.createDataFrame([("a", 9, 9), ("c", 3, 3)], old.schema)
    assert sorted(map(tuple, store.refreshed(old, new, ["alert_id"]).collect())) == [("a", 1, 9), ("b", 2, 2), ("c", 3, 3)]
    gates = spark.createDataFrame([("g", 1.0, ">= 1", "aprovada")], "gate STRING, value DOUBLE, target STRING, status STRING")
    evaluation.write_report(evaluation.report(gates, {"rules": "1"}), str(tmp_path / "r"))
    assert "g | 1.0 | >= 1 | aprovada" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "r/markdown")).collect())
    assert sampling.synthetic_alerts(spark, 3, 4, "a", "b").count() == 12
