import datetime as dt
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from talus import config
from talus.functions import checkdigits, dates, identity, text
from talus.sources import saml, store


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_check_digits(spark):
    good = one(spark, checkdigits.cpf(F.lit("111444777")), checkdigits.cnpj(F.lit("112223330001")))
    assert tuple(good) == ("11144477735", "11222333000181")
    df = spark.createDataFrame([("111.444.777-35", True), ("11144477734", False), ("11111111111", False), ("11.222.333/0001-81", True), ("1", False), (None, False)], "d STRING, ok BOOLEAN")
    assert all(r[0] == r[1] for r in df.select(checkdigits.valid_document(F.col("d")), "ok").collect())


def test_account_number(spark):
    df = spark.createDataFrame([("8724731955", "0872-4731955-0"), ("1", "0000-0000001-9"), ("1234", "0000-0001234-3"), ("012", None), ("x", None), ("123456789012", None)], "raw STRING, want STRING")
    assert all(r[0] == r[1] for r in df.select(checkdigits.account_number(F.col("raw")), "want").collect())


def test_uuid5(spark):
    name = "conta-valor|LEG-VALOR-ELEVADO-01|2023-01-10T12:00:00+00:00|2023-01-12T12:00:00+00:00"
    got = one(spark, identity.uuid5(config.ALERT_NAMESPACE, F.lit(name)))[0]
    assert got == "9dc86f76-0cbf-5844-beee-8474cba5bef8" == str(uuid.uuid5(uuid.UUID(config.ALERT_NAMESPACE), name))


def test_text(spark):
    a, b = "Texto  com   espaços\nquebrados ", "Texto com espaços quebrados"
    assert one(spark, text.text_sha256(F.lit(a)) == text.text_sha256(F.lit(b)))[0]
    assert one(spark, text.words(F.lit("Olá, Mundo_1!")))[0] == ["olá", "mundo_1"]
    assert one(spark, text.redacted(F.lit("cpf 529.982.247-25 ok")))[0] == "cpf <CPF> ok"


def test_fx(spark):
    rates = {a: Decimal(c) for a, _, c in config.FX}
    cases = [("1459.15", "UK pounds", "9046.73"), ("100.00", "US dollar", "500.00"), ("13.91", "Naira", "0.09"), ("0.01", "Naira", None), ("x", "Euro", None)]
    for amount, label, want in cases:
        got = one(spark, saml.convert(F.lit(amount), F.lit(rates[label]).cast("decimal(18,6)")))[0]
        assert got == (None if want is None else Decimal(want))


def test_calendar(spark):
    assert config.easter(2023) == dt.date(2023, 4, 9)
    days = config.holidays()
    assert dt.date(2022, 3, 1) in days and dt.date(2025, 6, 19) in days and dt.date(2023, 11, 20) not in days and dt.date(2024, 11, 20) in days
    cal = config.business_calendar(spark)
    rows = spark.createDataFrame([(dt.date(2026, 9, 4),), (dt.date(2026, 12, 24),)], "day DATE")
    assert sorted(r[0] for r in dates.next_business_day(rows, "day", cal).select("next_business").collect()) == [dt.date(2026, 9, 8), dt.date(2026, 12, 28)]
    with pytest.raises(Exception, match="no business day"):
        dates.next_business_day(spark.createDataFrame([(dt.date(2030, 1, 1),)], "day DATE"), "day", cal).collect()
    d = one(spark, *dates.deadlines(F.lit(dt.datetime(2026, 9, 17, 10))))
    assert (d[0], d[1]) == (dt.datetime(2026, 9, 22, 10), dt.datetime(2026, 11, 1, 10))
    assert one(spark, dates.brasilia_date(F.lit("2026-09-22 01:30:00").cast("timestamp")))[0] == dt.date(2026, 9, 21)


def test_rules_file(tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"rule_id": "x", "least_brl": "10.00", "days": 7}')
    assert config.load_rules(p, config.ValueRule).least_brl == Decimal("10.00")
    for bad in ('{"rule_id": "x"}', '{"rule_id": "x", "least_brl": "1", "days": 7, "z": 1}'):
        p.write_text(bad)
        with pytest.raises(ValueError, match="key"):
            config.load_rules(p, config.ValueRule)
    p.write_text('{"rule_id": "x", "least_brl": 10.0, "days": 7}')
    with pytest.raises(ValueError, match="decimal"):
        config.load_rules(p, config.ValueRule)


HEADER = "Time,Date,Sender_account,Receiver_account,Amount,Payment_currency,Received_currency,Sender_bank_location,Receiver_bank_location,Payment_type,Is_laundering,Laundering_type"


def test_header():
    names = HEADER.split(",")
    assert saml.validate_header(names).flag == "Is_laundering"
    for bad in (names[1:], [*names, "Type"], [*names, "More"], [*names, "Time"], [""]):
        with pytest.raises(ValueError):
            saml.validate_header(bad)


def test_scan_and_project(spark, tmp_path):
    rows = [
        "10:35:19,2022-10-07,8724731955,2769355426,1459.15,UK pounds,UK pounds,UK,UK,Cash Deposit,0,Normal_Cash_Deposits",
        "10:35:20,2022-10-07,1000000001,2769355426,9500.00,UK pounds,Euro,UK,Germany,Cross-border,1,Structuring",
        "10:35:21,2022-10-07,1000000001,2769355426,9500.00,UK pounds,Euro,UK,Germany,Cross-border,0,Structuring",
        "10:35:22,2022-10-07,1000000001,2769355426,9500.00,UK pounds,Euro,UK,Germany,Cross-border,2,Nothing",
        "10:35:23,2022-10-07,1000000001",
    ]
    p = tmp_path / "saml.csv"
    p.write_text("\n".join([HEADER, *rows]) + "\n")
    got = saml.problems(saml.with_position(saml.scan(spark, str(p))), config.labels(spark)).orderBy("position")
    bad = [r["violations"] for r in got.collect()]
    assert bad[:4] == [[], [], ["flag does not fit label"], ["unknown label", "flag is neither 0 nor 1"]] and "wrong number of cells" in bad[4]
    with pytest.raises(Exception, match="invalid row"):
        saml.strict(got).collect()
    tx = saml.transactions(got.where("position <= 2")).orderBy("transaction_id").collect()
    assert [r["transaction_id"] for r in tx] == ["tx-00000001", "tx-00000002"] and all(r["violations"] == [] for r in tx)
    assert tx[0]["amount_brl"] == Decimal("9046.73") and tx[0]["sender_account"] == "0872-4731955-0" and tx[1]["receiver_location"] == "DE" and tx[1]["payment_type"] == "TRANSFERENCIA_INTERNACIONAL"
    assert saml.totals(got.where("position <= 2")).first().asDict() == {"n": 2, "n_suspicious": 1, "n_normal": 1}


def test_store(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k INT, v STRING")
    b = a.repartition(2).orderBy(F.desc("k"))
    assert store.content_sha256([a]) == store.content_sha256([b]) != store.content_sha256([a.limit(1)])
    assert store.content_sum(a).first() == store.content_sum(b).first()
    merged = store.upsert(a, spark.createDataFrame([(2, "y"), (3, "z")], "k INT, v STRING"), ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, "x"), (2, "y"), (3, "z")]
    body = {"alerts": [], "seed": 1}
    store.write_golden(body | {"manifest_sha256": store.manifest_sha256(body)}, a, str(tmp_path / "g"))
    assert store.read_golden(spark, str(tmp_path / "g"))["seed"] == 1
    store.write_golden(body | {"manifest_sha256": "0"}, a, str(tmp_path / "h"))
    with pytest.raises(ValueError):
        store.read_golden(spark, str(tmp_path / "h"))
