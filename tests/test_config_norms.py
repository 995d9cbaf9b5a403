import datetime as dt
import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from talus import config
from talus.operators import norms

APPROVAL = {"by": "someone", "on": "2026-09-16", "status": "provisional", "reference": "first values"}
ALERTS = {"version": 2, "approval": APPROVAL, "value": {"rule_id": "V", "least_brl": "5000.00", "days": 3}, "velocity": {"rule_id": "N", "least_count": 4, "days": 10}}
FX = {"version": 1, "approval": APPROVAL, "currencies": [{"label": "A", "iso": "AAA", "rate": "1.5"}, {"label": "B", "iso": "BBB", "rate": "0.25"}]}


def load(tmp_path, given, kind):
    path = tmp_path / "c.json"
    path.write_text(given if isinstance(given, str) else json.dumps(given))
    return config.load_config(path, kind)


def test_nested_configuration(spark, tmp_path):
    got = load(tmp_path, ALERTS, config.AlertConfig)
    assert got.value == config.ValueRule("V", Decimal("5000.00"), 3) and got.velocity.least_count == 4 and got.approval.on == dt.date(2026, 9, 16)
    fx = load(tmp_path, FX, config.FxConfig)
    assert {(r["iso"], r["rate"]) for r in config.fx(spark, fx).collect()} == {("AAA", Decimal("1.500000")), ("BBB", Decimal("0.250000"))}
    assert load(tmp_path, {"first": 2023, "last": 2024, "days": ["2023-01-01"]}, config.HolidayConfig).days == (dt.date(2023, 1, 1),)


@pytest.mark.parametrize(("change", "said"), [
    ({"extra": 1}, "unknown key c.json.extra"), ({"version": "2"}, "c.json.version: int"), ({"version": True}, "c.json.version: int"), ({"approval": 3}, "c.json.approval: an object"),
    ({"approval": {**APPROVAL, "status": "maybe"}}, "c.json.approval.status: one of"), ({"approval": {**APPROVAL, "on": "16.09.2026"}}, "is no date"), ({"approval": {**APPROVAL, "by": " "}}, "c.json.approval.by: text"),
    ({"value": {**ALERTS["value"], "least_brl": 5000.0}}, "c.json.value.least_brl: a decimal"), ({"value": {"rule_id": "V", "days": 3}}, "missing key c.json.value.least_brl"),
])
def test_errors_name_their_place(tmp_path, change, said):
    with pytest.raises(config.ConfigError, match=said):
        load(tmp_path, {**ALERTS, **change}, config.AlertConfig)


def test_files_that_are_no_configuration(tmp_path):
    with pytest.raises(config.ConfigError, match="cannot be read"):
        config.load_config(tmp_path / "none.json", config.AlertConfig)
    for text in ("{", "[1]", "3"):
        with pytest.raises(config.ConfigError):
            load(tmp_path, text, config.AlertConfig)
    with pytest.raises(config.ConfigError, match=r"currencies\[1\].rate"):
        load(tmp_path, {**FX, "currencies": [FX["currencies"][0], {"label": "B", "iso": "BBB", "rate": 2}]}, config.FxConfig)


def test_norm_manifest_keeps_its_version(spark, tmp_path):
    rows = [(f"N{i}", f"http://norms/{i}", dt.datetime(2026, 9, 1), hashlib.sha256(b"%d" % i).hexdigest(), f"{i}.pdf") for i in (3, 1, 2)]
    documents = spark.createDataFrame(rows, norms.MANIFEST)
    norms.write_manifest(documents, str(tmp_path / "m"))
    back = norms.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    texts = spark.createDataFrame([(f"N{i}", f"Art. 1º Do item {i}.\n§ 1º Do par.") for i in (1, 2, 3)], "doc_id STRING, text STRING")
    version = lambda m: {r["corpus_version"] for r in norms.ingest_manifest(m, texts).collect()}
    want = hashlib.sha256("|".join(f"N{i}:{hashlib.sha256(b'%d' % i).hexdigest()}" for i in (1, 2, 3)).encode()).hexdigest()[:16]
    assert version(back) == version(documents.repartition(3)) == {want}
    changed = back.withColumn("doc_sha256", F.when(F.col("doc_id") == "N2", "x").otherwise(F.col("doc_sha256")))
    assert version(changed) != {want}
    with pytest.raises(ValueError, match="no text of N9"):
        norms.ingest_manifest(back.withColumn("doc_id", F.lit("N9")), texts)
    with pytest.raises(ValueError, match="given twice"):
        norms.write_manifest(documents.unionByName(documents), str(tmp_path / "twice"))
    spark.createDataFrame([("a", 1)], "doc_id STRING, other INT").write.json(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="unknown or missing"):
        norms.read_manifest(spark, str(tmp_path / "bad"))
