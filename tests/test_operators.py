import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from talus import config
from talus.operators import alerts as A
from talus.operators import audit, features, norms, retrieval, sampling, sanitize, triage, workflow

TX = "transaction_id STRING, timestamp TIMESTAMP, amount_brl DECIMAL(18,2), sender_account STRING, is_laundering INT"


def noon(y, m, d):
    return dt.datetime(y, m, d, 12)


@pytest.fixture(scope="module")
def tx(spark):
    rows = [("conta-valor", 1, 10, 5000, 0), ("conta-valor", 1, 12, 15000, 0), ("conta-valor", 4, 1, 20000, 1)]
    rows += [("conta-velocidade", m, d, 100, x) for m, d, x in ((2, 1, 0), (2, 5, 0), (2, 8, 0), (6, 1, 0), (6, 3, 1), (6, 5, 0))]
    rows += [("conta-normal", 3, 1, 500, 0), ("conta-normal", 3, 20, 500, 0)]
    return spark.createDataFrame([(f"t{i}", noon(2023, m, d), Decimal(a), s, x) for i, (s, m, d, a, x) in enumerate(rows)], TX)


def test_alerts(spark, tx):
    found = A.alerts(tx, [config.ValueRule(least_brl=Decimal(10000), days=7), config.VelocityRule(least_count=3, days=10)])
    rows = A.alert_transactions(found, tx)
    sizes = {(r["rule_id"], r["account"], r["n"]) for r in rows.join(found.select("alert_id", "rule_id", "account"), "alert_id").groupBy("alert_id", "rule_id", "account").agg(F.count("*").alias("n")).collect()}
    assert found.count() == 4
    assert sizes == {(config.VALUE_RULE, "conta-valor", 2), (config.VALUE_RULE, "conta-valor", 1), (config.VELOCITY_RULE, "conta-velocidade", 3)}
    assert "9dc86f76-0cbf-5844-beee-8474cba5bef8" in {r[0] for r in found.select("alert_id").collect()}
    report = {r["rule_id"]: (r["alerts"], r["false_positives"], r["rate"]) for r in A.false_positives(found, rows).collect()}
    assert report == {None: (4, 2, 0.5), config.VALUE_RULE: (2, 1, 0.5), config.VELOCITY_RULE: (2, 1, 0.5)}
    accounts = spark.createDataFrame([("conta-valor", "c1")], "account STRING, customer_id STRING")
    customers = spark.createDataFrame([("c1", "n", "d")], "customer_id STRING, name STRING, cpf_cnpj STRING")
    assert A.alerts(tx, [config.ValueRule(least_brl=Decimal(10000))], accounts=accounts, customers=customers).count() == 2


def test_hot_account_in_buckets(spark):
    """One account, rows across many buckets, against a plain scan."""
    import random

    r = random.Random(4)
    times = sorted({dt.datetime(2023, 1, 1) + dt.timedelta(hours=r.randrange(24 * 400)) for _ in range(700)})
    rows = [(f"t{i}", t, Decimal(r.choice([1, 20])), "hot", 0) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, TX)
    for rule in (config.ValueRule(least_brl=Decimal(10), days=2), config.VelocityRule(least_count=6, days=3)):
        w = dt.timedelta(days=rule.days)
        hit = [t for _, t, a, _, _ in rows if (a >= 10 if isinstance(rule, config.ValueRule) else sum(t - w <= u <= t for u in times) >= rule.least_count)]
        ends = [a for a, b in zip(hit, [*hit[1:], None], strict=True) if b is None or b - a > w]
        want = {(min(u for u in times if e - w <= u <= e), e) for e in ends}
        assert {(x["start"], x["end"]) for x in A.episodes(df, rule).collect()} == want


ATX = "alert_id STRING, holder STRING, seq INT, transaction_id STRING, timestamp TIMESTAMP, amount_brl DECIMAL(18,2), payment_type STRING, sender_account STRING, receiver_account STRING, sender_location STRING, receiver_location STRING"


def rows_of(spark, name, items):
    base = noon(2026, 9, 1)
    data = [(name, "CONTA_01", i, f"tx-{i:04d}", base + dt.timedelta(days=day), Decimal(a), kind, s, r, "BR", to) for i, (day, a, kind, s, r, to) in enumerate(items, 1)]
    return spark.createDataFrame(data, ATX)


@pytest.fixture(scope="module")
def atx(spark):
    return rows_of(spark, "a", [
        (0, "3000.00", "PIX", "CONTA_02", "CONTA_01", "BR"), (1, "4000.00", "TED", "CONTA_01", "CONTA_03", "BR"), (2, "2000.00", "ESPECIE_DEPOSITO", "CONTA_01", "CONTA_01", "BR"),
        (3, "2000.00", "TRANSFERENCIA_INTERNACIONAL", "CONTA_01", "CONTA_04", "US"), (4, "500.00", "PIX", "CONTA_01", "CONTA_03", "BR"),
    ])


def test_features(spark, atx):
    head = spark.createDataFrame([("a", noon(2026, 9, 1), noon(2026, 9, 8))], "alert_id STRING, start TIMESTAMP, end TIMESTAMP")
    past = spark.createDataFrame([("a", Decimal("18000.00"))], "alert_id STRING, history_brl DECIMAL(18,2)")
    lists = spark.createDataFrame([("a", "nao", "nao", "sim")], "alert_id STRING, pep STRING, ceis STRING, cnep STRING")
    got = {r["feature_id"]: (r["value_int"] if r["value_int"] is not None else r["value_str"], r["transaction_ids"], r["name"]) for r in features.indicators(head, atx, past, lists).collect()}
    values = {k: v[0] for k, v in got.items()}
    assert values == {
        "F01": 5, "F02": 11500, "F03": 5, "F04": 1, "F05": 2, "F06": 1, "F07": 2, "F08": 2, "F09": 1, "F10": "sim", "F11": "16.4x", "F12": 5, "F13": "pep:nao,ceis:nao,cnep:sim",
        "F14": "in=0 out=2 brl=4500", "F15": "in=1 out=0 brl=3000", "F16": "in=0 out=1 brl=2000",
    }
    assert got["F04"][1] == ["tx-0003"] and got["F05"][1] == ["tx-0002", "tx-0005"] and got["F10"][1] == ["tx-0003", "tx-0004"] and [got[f][2] for f in ("F14", "F15", "F16")] == ["CONTA_03", "CONTA_02", "CONTA_04"]


@pytest.mark.parametrize(
    "items, flag, fired",
    [
        ([(d, "500.00", "PIX", "CONTA_01", "CONTA_09", "BR") for d in range(3)], False, ["FRAGMENTACAO"]),
        ([(0, "15000", "TED", "CONTA_02", "CONTA_01", "BR"), (1, "16000", "TED", "CONTA_03", "CONTA_01", "BR"), (2, "17000", "TED", "CONTA_01", "CONTA_04", "BR")], False, ["CAMADAS"]),
        ([(0, "9000", "ESPECIE_DEPOSITO", "CONTA_01", "CONTA_01", "BR"), (1, "9000", "TRANSFERENCIA_INTERNACIONAL", "CONTA_01", "CONTA_05", "US")], False, ["ESPECIE_DEPOIS_EXTERIOR"]),
        ([(0, "50.00", "PIX", "CONTA_01", "CONTA_09", "BR")], True, ["LISTA_RESTRICAO"]),
        ([(0, "50.00", "PIX", "CONTA_01", "CONTA_09", "BR")], False, []),
        ([(0, "50.00", "PIX", "CONTA_01", "CONTA_09", "BR")], None, None),
    ],
)
def test_triage(spark, items, flag, fired):
    customers = spark.createDataFrame([] if flag is None else [("c", ["pep"] if flag else [])], "customer_id STRING, restriction_flags ARRAY<STRING>")
    lists = triage.restriction(spark.createDataFrame([("a", "c")], "alert_id STRING, customer_id STRING"), customers)
    got = triage.decide(rows_of(spark, "a", items), lists).first()
    assert got["fired_rules"] == fired
    assert (got["level"], got["state"]) == ((None, "NEEDS_HUMAN") if fired is None else ("INVESTIGAR" if fired else "PROPOR_ARQUIVAMENTO", "TRIAGED"))


def test_water_filling():
    w = sampling.water_filling
    assert w({"A": 50, "B": 50, "C": 50}, 30) == {"A": 10, "B": 10, "C": 10}
    assert w({"A": 2, "B": 50, "C": 50}, 30) == {"A": 2, "B": 14, "C": 14}
    assert w({"A": 50, "B": 50, "C": 50}, 31) == {"A": 11, "B": 10, "C": 10}
    assert w({"A": 1, "B": 2, "C": 50, "D": 50}, 30) == {"A": 1, "B": 2, "C": 14, "D": 13}
    with pytest.raises(ValueError):
        w({"A": 1, "B": 1}, 10)


def test_strata(spark):
    cases = {"s": ["Normal_Fan_Out", "Structuring", "Normal_Fan_Out"], "n": ["Normal_Fan_Out", "Normal_Fan_Out", "Normal_Cash_Deposits"], "t": ["Normal_Fan_Out", "Normal_Cash_Deposits"], "m": ["Structuring", "Smurfing"]}
    df = spark.createDataFrame([(k, x) for k, v in cases.items() for x in v], "alert_id STRING, laundering_type STRING")
    assert dict(sampling.strata(df, config.labels(spark)).collect()) == {"s": "Structuring", "n": "Normal_Fan_Out", "t": "Normal_Cash_Deposits", "m": None}


NORMS = {
    "Circ": "Preâmbulo.\nArt. 43.  As instituições devem.\n§ 1º  O período de\nquarenta e cinco dias.\n§ 2º  A análise.\nArt. 44.  É vedada:\nI - a contratação; e\nII - a realização.\n",
    "CC": "Art. 1º  As operações:\nI - espécie:\na) depósitos;\nb) movimentações;\nIV - contas:\na) recursos;\n",
    "Sole": "Art. 2º Caput.\nParágrafo único. Texto.\n",
}


def test_norm_chunks(spark):
    df = spark.createDataFrame([(k, v, "u") for k, v in NORMS.items()], "doc_id STRING, text STRING, source_url STRING")
    got = {r["article_ref"]: r["text"] for r in norms.ingest(df).collect()}
    assert set(got) == {
        "Circ/art43/caput", "Circ/art43/p1", "Circ/art43/p2", "Circ/art44/caput", "Circ/art44/i1", "Circ/art44/i2", "CC/art1/caput", "CC/art1/i1", "CC/art1/i1/a", "CC/art1/i1/b", "CC/art1/i4", "CC/art1/i4/a",
        "Sole/art2/caput", "Sole/art2/pu",
    }
    assert got["Circ/art43/p1"] == "O período de\nquarenta e cinco dias."


def test_selection(spark):
    rows = [("q", f"chunk-{c}", i, s, f"art{c}", "texto", ["texto", c], ["texto"]) for i, (c, s) in enumerate((("a", 0.9), ("b", 0.5), ("c", 0.2), ("d", 0.4), ("e", 0.95)), 1)]
    cand = spark.createDataFrame(rows, "query_id STRING, chunk_id STRING, pos INT, score DOUBLE, article_ref STRING, text STRING, tokens ARRAY<STRING>, query_tokens ARRAY<STRING>")
    pref = spark.createDataFrame([("q", "applies", ["artd"])], "query_id STRING, applicability STRING, refs ARRAY<STRING>")
    got = [r["chunk_id"] for r in retrieval.select_citations(cand, pref, 0.35).orderBy("pos").collect()]
    assert got[0] == "chunk-d" and len(got) == 3 and "chunk-c" not in got
    assert retrieval.select_citations(cand, pref.withColumn("applicability", F.lit(None).cast("string")), 0.35).count() == 0
    for bad in (0, 9, True):
        with pytest.raises(ValueError):
            retrieval.check_search(bad)


def test_review(spark):
    chunks = spark.createDataFrame([("c1", "v1", "h1"), ("c2", "v0", "h2")], "chunk_id STRING, corpus_version STRING, text_sha256 STRING")
    cited = spark.createDataFrame([("a", "c1", "h1"), ("b", "c1", "hx"), ("c", "c2", "h2"), ("d", "c1", "h1")], "alert_id STRING, chunk_id STRING, quoted STRING")
    seen = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("c", "c2")], "alert_id STRING, chunk_id STRING")
    got = {r["alert_id"]: r["reason"] for r in retrieval.reviewed(cited, seen, chunks, "v1", F.col("quoted")).collect()}
    assert got == {"a": None, "b": "SHA-256 differs", "c": "not in the corpus version", "d": "not retrieved"}


def test_sanitise(spark, atx):
    head = spark.createDataFrame([("a", "Ana", "11144477735"), ("x", "Bob", "1")], "alert_id STRING, name STRING, cpf_cnpj STRING")
    tokens = sanitize.token_table(head, atx)
    alerts, rows = sanitize.sanitised(head, atx, tokens)
    states = {r["alert_id"]: (r["state"], r["pii_token_count"]) for r in alerts.collect()}
    assert states == {"a": ("SANITIZED", 13), "x": ("NEEDS_HUMAN", None)}
    values = {r["value"]: r["token"] for r in tokens.where("alert_id = 'a' AND kind = 'CONTA'").collect()}
    assert values == {"CONTA_01": "CONTA_01", "CONTA_02": "CONTA_02", "CONTA_03": "CONTA_03", "CONTA_04": "CONTA_04"}
    assert rows.where("sender_account = holder").count() == 4
    key = F.lit("0123456789abcdef")
    assert {r["value"] for r in sanitize.decrypted(sanitize.encrypted(tokens, key), key).collect()} == {r["value"] for r in tokens.collect()}
    assert sanitize.canary_scan(head, "head", ["11144477735"]).where("n > 0").select("column").first()[0] == "cpf_cnpj"
    spans = spark.createDataFrame([("abcdef", [(0, 2), (2, 4)]), ("abc", [(0, 2), (1, 3)]), ("abc", [(2, 2)]), ("abc", [(1, 9)])], "text STRING, entities ARRAY<STRUCT<start: INT, end: INT>>")
    assert [len(r["violations"]) for r in sanitize.span_violations(spans).collect()] == [0, 1, 1, 1]


def test_audit(spark):
    e = spark.createDataFrame([("a", f"a_{i}", f"2026-01-0{i}", "T", "system") for i in (1, 2, 3)] + [("a", "a_2", "2026-01-09", "T", "system")], "alert_id STRING, event_key STRING, occurred_at STRING, event_type STRING, actor STRING")
    log = audit.append(e, "alert_id")
    rows = log.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [1, 2, 3] and rows[0]["prev_hash"] is None and rows[1]["prev_hash"] == rows[0]["hash"]
    assert tuple(audit.verify(log, "alert_id").first()) == ("a", True, 3, None)
    changed = log.withColumn("actor", F.when(F.col("seq") == 2, F.lit("x")).otherwise(F.col("actor")))
    assert tuple(audit.verify(changed).first()) == (False, 3, 2)
    cut = log.where("seq <> 2")
    assert tuple(audit.verify(cut).first()) == (False, 2, 3)
    more = audit.append(spark.createDataFrame([("a", "a_9", "2026-02-01", "T", "system")], e.schema), "alert_id", audit.last_events(log, "alert_id"))
    assert audit.verify(log.unionByName(more)).first()["valid"] and audit.append_only_violations(log, log.unionByName(more)).count() == 0


def test_workflow(spark):
    good, bad = '{"t":"Structuring","c":0.5,"r":"ARQUIVAR","e":[1,14]}', '{"t":"Structuring","c":2,"r":"ARQUIVAR","e":[]}'
    tries = spark.createDataFrame([("a", 1, bad), ("a", 2, good), ("b", 1, bad), ("b", 2, "x"), ("b", 3, bad), ("b", 4, good)], "alert_id STRING, attempt INT, answer STRING")
    got = {r["alert_id"]: r for r in workflow.first_valid(tries).collect()}
    assert got["a"]["output"]["evidence"] == ["F01", "F14"] and got["a"]["attempts"] == 2 and got["b"]["state"] == "NEEDS_HUMAN"
    g = spark.createDataFrame([("ARQUIVAR", "Structuring", []), ("ARQUIVAR", "Cycle", ["CAMADAS"]), ("ARQUIVAR", "Cycle", []), ("COMUNICAR", "Structuring", ["CAMADAS"])], "recommendation STRING, typology STRING, fired_rules ARRAY<STRING>")
    assert [r["state"] for r in workflow.guarded(g).collect()] == ["NEEDS_HUMAN", "NEEDS_HUMAN", "RESEARCHING", "RESEARCHING"]
    records = spark.createDataFrame([("a", "DRAFT_READY"), ("b", "APPROVED"), ("c", "DRAFT_READY")], "alert_id STRING, state STRING")
    d = spark.createDataFrame([("a", "COMUNICAR", "x" * 50, 1), ("a", "DEVOLVER", "x" * 50, 2), ("b", "ARQUIVAR", "x" * 50, 1), ("c", "ARQUIVAR", "short", 1)], "alert_id STRING, decision STRING, justification STRING, decided_at INT")
    assert {r["alert_id"]: (r["accepted"], r["state"]) for r in workflow.decided(records, d).collect()} == {"a": (True, "APPROVED"), "b": (False, "APPROVED"), "c": (False, "DRAFT_READY")}
    calendar = config.business_calendar(spark)
    day = spark.createDataFrame([(dt.datetime(2026, 9, 22, 1, 30), dt.date(2026, 9, 22))], "decided_at TIMESTAMP, prazo_comunicacao DATE")
    assert workflow.reporting_day_violations(day, calendar).first()["valid"]
    assert workflow.generation_schema(["F01", "F14"])["properties"]["e"]["items"]["enum"] == [1, 14]


def test_prompt_drops_least_counterparties(spark):
    rows = [("a", "F01", "n", 1, None)] + [("a", f"F{14 + i}", f"CONTA_{i:02d}", None, f"in=1 out=0 brl={b}") for i, b in enumerate((900, 50, 50))]
    f = spark.createDataFrame(rows, "alert_id STRING, feature_id STRING, name STRING, value_int LONG, value_str STRING")
    got = features.prompts(f, "head", budget=12).first()
    assert got["dropped"] == ["F16"] and got["prompt"].splitlines() == ["head", "F01 n=1", "F14 CONTA_00 in=1 out=0 brl=900", "F15 CONTA_01 in=1 out=0 brl=50"]
