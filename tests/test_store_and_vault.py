"""Marked values, the shared vault, drawn documents, bucketed tables, the observed scan and the golden manifest."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from talus import config
from talus.functions.checkdigits import valid_document
from talus.functions.identity import permuted
from talus.operators import alerts as A
from talus.operators import evaluation, marked, sampling, sanitize
from talus.sources import saml, store


def test_a_hundred_thousand_marked_values(spark):
    r = random.Random(2)
    values = [f"{r.randrange(10**10):010d}" for _ in range(100_000)] + ["aba", "ab", "é-x", "", None]
    rows = [(f"n {r.choice(values[:100_000])} {r.choice(values[:100_000])}x", None if i % 3 else "ababa é-x", i) for i in range(40)] + [(None, "nothing", 1), ("", "", 2)]
    table = spark.createDataFrame(rows, "a STRING, b STRING, n INT").repartition(3)
    df = spark.createDataFrame([(v,) for v in values], "value STRING")
    known = {v for v in values if v}
    want = {}
    for a, b, _ in rows:
        found = {t[i : i + k] for t in (a, b) if t for k in (2, 3, 10) for i in range(len(t) - k + 1)} & known
        for v in found:
            want[v] = want.get(v, 0) + 1
    for size in (marked.SLICE_BYTES, 300_000):
        got = {x["value"]: x["n_rows"] for x in marked.rows_by_value(table, df, size).collect()}
        assert got == want and want["aba"] == 14
    scan = {x["column"]: x["n"] for x in sanitize.canary_scan(table, "t", ["ab", "nothing", ""]).collect()}
    assert scan == {"a": 0, "b": 15}
    assert marked.hits(table, df.limit(0)).count() == 0 and marked.hits(table.limit(0), df).count() == 0


def test_many_marked_values_take_one_pass_over_the_texts(spark, monkeypatch):
    r = random.Random(3)
    letters = "abé😀z"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    rows = [(word(r.randrange(400)), word(40) if i % 5 else None) for i in range(60)] + [("", "a"), ("x" * 70 + word(40), "x" * 69)]
    windows = [t[i : i + k] for a, b in rows for t in (a, b) if t for k in (5, 9, 66) for i in range(0, len(t) - k, 7)]
    values = {*windows, *(word(9) for _ in range(3000)), *(word(6) for _ in range(100)), "x" * 66, "no such value"}
    table = spark.createDataFrame(rows, "a STRING, b STRING").repartition(3)
    df = spark.createDataFrame([(v,) for v in [*values, *values, "", None]], "value STRING")
    want = {v: n for v in values if (n := sum(any(v in t for t in row if t) for row in rows))}
    passes = []
    for f in ("_searched", "_candidates"):
        monkeypatch.setattr(marked, f, lambda *a, f=getattr(marked, f): passes.append(a) or f(*a))
    monkeypatch.setattr(marked, "STEP", 50)
    got = [(x["value"], x["n_rows"]) for x in marked.rows_by_value(table, df, 4000).collect()]
    assert dict(got) == want and len(got) == len(want) and len(passes) == 2  # the lengths of many values, and all others
    found = {tuple(x) for x in marked.hits(table, df, ["a"], 4000).select("column", "value").collect()}
    assert found == {("a", v) for v in values if any(v in a for a, _ in rows)}


def test_the_vault_numbers_on(spark):
    seen = [("a1", "CONTA", "x", 0), ("a1", "CONTA", "y", 2), ("a1", "NOME", "ana", 0), ("a2", "CONTA", "y", 0), ("a2", "CONTA", "z", 3)]
    schema = "alert_id STRING, kind STRING, value STRING, at INT"
    first = sanitize.new_tokens(spark.createDataFrame(seen[:3], schema))
    assert {(r["value"], r["token"]) for r in first.collect()} == {("x", "CONTA_01"), ("y", "CONTA_02"), ("ana", "NOME_01")}
    vault = store.staged(first)
    later = spark.createDataFrame([*seen[3:], ("a3", "CONTA", "w", 1), ("a3", "DOCUMENTO", "d", 0)], schema).repartition(4)
    new = store.staged(sanitize.new_tokens(later, vault))
    assert {(r["value"], r["token"], r["number"]) for r in new.collect()} == {("z", "CONTA_03", 3), ("w", "CONTA_04", 4), ("d", "DOCUMENTO_01", 1)}
    whole = vault.unionByName(new)
    assert sanitize.new_tokens(later, whole).count() == 0 and whole.count() == whole.select("token").distinct().count()
    tokens = sanitize.shared_tokens(later, whole)
    back = sanitize.reidentified(tokens.select("alert_id", "token"), "token", tokens).collect()
    assert {(r["alert_id"], r["value"]) for r in back} == {("a2", "y"), ("a2", "z"), ("a3", "w"), ("a3", "d")}


@pytest.mark.parametrize("digits", [2, 3])
def test_permutation_gives_each_number_once(spark, digits):
    n = 10**digits - 10
    df = spark.range(n).select(*[permuted(F.col("id"), digits, seed).alias(f"p{seed}") for seed in (1, 2)]).collect()
    want = {x for x in range(10**digits) if len(set(f"{x:0{digits}d}")) > 1}
    assert {r["p1"] for r in df} == {r["p2"] for r in df} == want and sum(r["p1"] == r["p2"] for r in df) < n / 4
    with pytest.raises(Exception, match="no number"):
        spark.range(n, n + 1).select(permuted(F.col("id"), digits, 1)).collect()


def test_drawn_documents_are_valid_and_unique(spark):
    rows = sampling.drawn_documents(spark.range(3000), "id", 5).withColumns({c: valid_document(F.col(d)) for c, d in (("v", "cpf"), ("w", "cnpj"))}).collect()
    assert all(r["v"] and r["w"] for r in rows) and len({r["cpf"] for r in rows}) == len({r["cnpj"] for r in rows}) == 3000


def test_a_drawn_document_is_worked_out_once(spark):
    drawn = sampling.drawn_documents(spark.range(0, 600, 1, 1), "id", 5).withColumn("v", valid_document(F.col("cpf")) & valid_document(F.col("cnpj")))
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 6 and plan.count("lpad(") <= 2  # a first pass and two walks for each of both numbers
    assert sum(n > 0 for n in drawn.rdd.glom().map(len).collect()) > 1  # one file's rows, several tasks
    rows = {r["id"]: r for r in drawn.collect()}
    assert len(rows) == 600 and all(r["v"] for r in rows.values())
    with pytest.raises(Exception, match="no number"):
        sampling.drawn_documents(spark.range(3).select(F.nullif("id", F.lit(1)).alias("id")), "id", 5).collect()


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    tx = spark.range(4000).select(F.concat(F.lit("a"), F.col("id") % 40).alias("sender_account"), F.timestamp_seconds(F.col("id") * 5000 + 1_600_000_000).alias("timestamp"), F.lit(1).cast("decimal(18,2)").alias("amount_brl"))
    accounts = tx.select(F.col("sender_account").alias("account")).distinct().withColumn("customer_id", F.concat(F.lit("c"), "account"))
    name = lambda: f"t_{uuid.uuid4().hex}"
    stored = store.write_bucketed(tx, name(), str(tmp_path / "tx"), "sender_account", 8, "timestamp")
    owners = store.write_bucketed(accounts, name(), str(tmp_path / "accounts"), "account", 8)
    rule = config.VelocityRule(least_count=10, days=30)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        found = A.episodes(stored, rule)
        joined = stored.groupBy(F.col("sender_account").alias("account")).agg(F.count("*").alias("n")).join(owners, "account")
        assert "Exchange" not in plan(found) and "Exchange" not in plan(joined) and "Exchange" in plan(A.episodes(tx, rule))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, A.episodes(tx, rule).collect())) and found.count()
        assert joined.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


HEADER = "Time,Date,Sender_account,Receiver_account,Amount,Payment_currency,Received_currency,Sender_bank_location,Receiver_bank_location,Payment_type,Is_laundering,Laundering_type"


def lines(n, labels):
    return [f"10:00:00,2023-01-01,{i + 1},{i + 2},5.0,UK pounds,UK pounds,UK,UK,Cheque,{1 if labels[i % len(labels)] in dict.fromkeys(x[0] for x in config.SUSPICIOUS) else 0},{labels[i % len(labels)]}" for i in range(n)]


def test_one_pass_counts_and_names_the_first_bad_line(spark, tmp_path):
    labels = [config.SUSPICIOUS[0][0], config.NORMAL[0], config.NORMAL[1]]
    rows = lines(5000, labels)
    path = tmp_path / "in.csv"
    path.write_text("\n".join([HEADER, *rows]) + "\n")
    counts = saml.write_observed(spark, str(path), str(tmp_path / "out"))
    assert counts == {labels[0]: 1667, labels[1]: 1667, labels[2]: 1666} and spark.read.parquet(str(tmp_path / "out")).count() == 5000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for bad in (0, 17, 3333, 4999):
        broken = list(rows)
        broken[bad] = broken[bad].rsplit(",", 1)[0] + ",No Such Label"
        broken[4999] = broken[4999].rsplit(",", 2)[0] + ",7," + labels[0] if bad != 4999 else broken[4999]
        path.write_text("\n".join([HEADER, *broken]) + "\n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
        try:
            with pytest.raises(ValueError, match=f"line {bad + 2}: unknown label"):
                saml.write_observed(spark, str(path), str(tmp_path / "bad"))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_percentiles_of_many_groups_without_broadcast(spark, monkeypatch):
    r = random.Random(3)
    rows = [(f"g{i % 37}" if i % 50 else None, float(r.randrange(20))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    want = sorted(map(str, evaluation.percentiles(df, "v", [0.1, 0.5, 0.95], ["g"]).collect()))
    monkeypatch.setattr(evaluation, "BROADCAST_ROWS", 10)
    assert sorted(map(str, evaluation.percentiles(df, "v", [0.1, 0.5, 0.95], ["g"]).collect())) == want and len(want) == 38 * 3


def test_golden_manifest_from_sample_to_disk(spark, tmp_path):
    labels = config.labels(spark)
    rules = config.SplitRules(per_critical=2, per_other=1, normals=20)
    names = [r["label"] for r in labels.collect()]
    ids = [(f"{x}-{i}", f"acc-{x}-{i}", x) for x in names for i in range(40)]
    found = spark.createDataFrame([(a, c) for a, c, _ in ids], "alert_id STRING, account STRING")
    tx = spark.createDataFrame([(a, x) for a, _, x in ids], "alert_id STRING, laundering_type STRING")
    bad = {r["label"] for r in labels.where("suspicious").collect()}
    classes = spark.createDataFrame([(c, x in bad) for _, c, x in ids], "account STRING, suspicious BOOLEAN")
    golden, _ = sampling.golden_set(found, tx, classes, labels, rules)
    golden = store.staged(golden)
    payload = found.join(golden.select("alert_id"), "alert_id", "left_semi")
    made = sampling.manifest(golden, payload, {"alert_rules_version": 1, "seed": rules.seed})
    assert made == sampling.manifest(golden.repartition(7), payload.repartition(5), {"alert_rules_version": 1, "seed": rules.seed})
    order = [a["alert_id"] for a in made["alerts"]]
    assert order == sorted(order) and len(order) == 43 and sum(made["selected_by_stratum"].values()) == 43
    assert all(made["selected_by_stratum"][r["label"]] == (2 if r["critical"] else 1) for r in labels.where("suspicious").collect())
    store.write_golden(made, payload, str(tmp_path / "golden"))
    assert store.read_golden(spark, str(tmp_path / "golden")) == made
    changed = json.loads(json.dumps(made))
    changed["alerts"][0]["stratum"] = "other"
    store.write_golden(changed, payload, str(tmp_path / "changed"))
    with pytest.raises(ValueError, match="hash"):
        store.read_golden(spark, str(tmp_path / "changed"))


def test_transactions_of_accounts_come_once(spark):
    tx = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "a", "a"), (4, "c", "d"), (5, None, "a"), (6, "c", None), (7, "d", "b")], "i INT, sender_account STRING, receiver_account STRING")
    some = spark.createDataFrame([("a",), ("b",), (None,)], "account STRING")
    both = sampling.of_accounts(tx, some, ("sender_account", "receiver_account"))
    assert sorted(r["i"] for r in both.collect()) == [1, 2, 3, 5, 7] and both.columns == tx.columns
    assert sorted(r["i"] for r in sampling.of_accounts(tx, some).collect()) == [1, 2, 3]


def test_vault_under_a_derived_key(spark):
    key = sanitize.vault_key("secret", b"0123456789abcdef", 1000)
    assert len(key) == 32 and key == sanitize.vault_key("secret", b"0123456789abcdef", 1000) != sanitize.vault_key("other", b"0123456789abcdef", 1000)
    tokens = spark.createDataFrame([("a1", "CONTA", "x-1", "CONTA_01"), ("a1", "NOME", None, "NOME_01")], "alert_id STRING, kind STRING, value STRING, token STRING")
    hidden = sanitize.encrypted(tokens, F.lit(key))
    assert [r["value"] for r in sanitize.decrypted(hidden, F.lit(key)).orderBy("kind").collect()] == ["x-1", None]
    assert sanitize.decrypted(hidden, F.lit(sanitize.vault_key("other", b"0123456789abcdef", 1000))).where("value IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="salt"):
        sanitize.vault_key("secret", b"short")
