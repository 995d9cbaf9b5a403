"""Queries over the driver tables, one for each group of operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus import config
from talus.functions import checkdigits, dates, identity, text
from talus.operators import alerts as A
from talus.operators import audit, evaluation, features, hashtree, marked, norms, pivots, retrieval, sampling, sanitize, triage, workflow
from talus.plans import driver_tables as D
from talus.sources import saml, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

VALUE = config.ValueRule()
VELOCITY = config.VelocityRule(days=1)

# ---- SQL that several oracles begin with

_PAY = " ".join(f"WHEN {i} THEN '{p}'" for i, (_, p) in enumerate(config.PAYMENT_TYPES))
_LABELS = "[" + ", ".join(f"'{x}'" for x in D.LABELS) + "]"
TX = f"""
WITH tx AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2))) AS transaction_id, l_shipdate AS timestamp,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_brl, CASE (l_partkey + l_linenumber) % 7 {_PAY} END AS payment_type, 'C' || o_custkey AS holder,
    CASE WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'C' || o_custkey END AS sender_account, CASE WHEN l_returnflag = 'R' THEN 'C' || o_custkey ELSE 'S' || l_suppkey END AS receiver_account,
    {_LABELS}[(l_orderkey + l_partkey) % 28 + 1] AS laundering_type, CASE WHEN (l_orderkey + l_partkey) % 28 < 17 THEN 1 ELSE 0 END AS is_laundering,
    CASE WHEN l_returnflag = 'R' THEN 'R' || sn.n_regionkey ELSE 'R' || cn.n_regionkey END AS sender_location, CASE WHEN l_returnflag = 'R' THEN 'R' || cn.n_regionkey ELSE 'R' || sn.n_regionkey END AS receiver_location
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
)"""
CUSTOMERS = """, dv1 AS (
  SELECT *, lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS base FROM customer
), dv2 AS (
  SELECT *, list_sum(list_transform(range(1, 10), lambda i: CAST(base[i] AS INT) * (11 - i))) % 11 AS r1 FROM dv1
), dv3 AS (
  SELECT *, base || CASE WHEN r1 < 2 THEN 0 ELSE 11 - r1 END AS base10 FROM dv2
), dv4 AS (
  SELECT *, list_sum(list_transform(range(1, 11), lambda i: CAST(base10[i] AS INT) * (12 - i))) % 11 AS r2 FROM dv3
), cust AS (
  SELECT 'C' || c_custkey AS account, 'CUST-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS customer_id, c_name AS name, base10 || CASE WHEN r2 < 2 THEN 0 ELSE 11 - r2 END AS cpf_cnpj,
    c_custkey % 97 = 0 AS pep, c_custkey % 193 = 0 AS ceis, c_custkey % 197 = 0 AS cnep FROM dv4
)"""


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('{config.ALERT_NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', (strpos('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12) FROM (SELECT {h} AS h))"


ALERTS = f"""{TX}, hits AS (
  SELECT DISTINCT holder AS account, timestamp FROM tx WHERE amount_brl >= 100000
), ends AS (
  SELECT account, timestamp AS "end", lead(timestamp) OVER (PARTITION BY account ORDER BY timestamp) AS nxt FROM hits
), episodes AS (
  SELECT account, "end", (SELECT MIN(t.timestamp) FROM tx t WHERE t.holder = account AND t.timestamp BETWEEN "end" - INTERVAL 7 DAY AND "end") AS start
  FROM ends WHERE nxt IS NULL OR nxt - "end" > INTERVAL 7 DAY
), alerts AS (
  SELECT {_uuid5("account || '|LEG-VALOR-ELEVADO-01|' || strftime(start, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || strftime(" + '"end"' + ", '%Y-%m-%dT%H:%M:%S') || '+00:00'")} AS alert_id,
    account, 'LEG-VALOR-ELEVADO-01' AS rule_id, start, "end", "end" AS selected_at FROM episodes
)"""
ATX = f"""{ALERTS}, atx AS (
  SELECT a.alert_id, t.*, a.selected_at, row_number() OVER (PARTITION BY a.alert_id ORDER BY t.timestamp, t.transaction_id) AS seq
  FROM alerts a JOIN tx t ON t.holder = a.account AND t.timestamp BETWEEN a.start AND a."end"
), cp AS (
  SELECT alert_id, seq, transaction_id, amount_brl, timestamp, CASE WHEN receiver_account = holder THEN 'in' ELSE 'out' END AS direction, CASE WHEN receiver_account = holder THEN sender_account ELSE receiver_account END AS counterparty,
    MAX(timestamp) OVER (PARTITION BY alert_id) AS last FROM atx WHERE sender_account <> receiver_account
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _tx(spark: SparkSession, d: str, located: bool = False) -> DataFrame:
    return D.transactions(spark, d, located)


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return A.alerts(_tx(spark, d), [VALUE], "holder")


def _atx(spark: SparkSession, d: str) -> DataFrame:
    tx = D.transactions(spark, d)
    return A.alert_transactions(A.alerts(tx.select("holder", "timestamp", "amount_brl"), [VALUE], "holder"), tx, "holder")


def _staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions, alerts and alerts' transactions; the last two, a small part of the first, are stored once for all that is derived from them."""
    tx = D.transactions(spark, d)
    found = store.staged(A.alerts(tx.select("holder", "timestamp", "amount_brl"), [VALUE], "holder"))
    return tx, found, store.staged(A.alert_transactions(found, tx, "holder"))


@query(f"{TX} SELECT laundering_type AS label, COUNT(*) AS n, MAX(is_laundering) = 1 AS suspicious FROM tx GROUP BY 1")
def scan_profile(spark: SparkSession, d: str) -> DataFrame:
    return saml.profile(_tx(spark, d).select(F.col("laundering_type").alias("label"), (F.col("is_laundering") == 1).alias("suspicious")))


@query(f"""{TX}, flagged AS (SELECT laundering_type AS label, CAST(CASE WHEN strlen(transaction_id) % 11 = 0 THEN 2 ELSE is_laundering END AS VARCHAR) AS flag, is_laundering FROM tx)
SELECT CASE WHEN flag NOT IN ('0','1') THEN 'flag is neither 0 nor 1' ELSE '' END AS violations, COUNT(*) AS n FROM flagged GROUP BY 1""")
def label_flag_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = _tx(spark, d).select(F.col("laundering_type").alias("label"), F.when(F.length("transaction_id") % 11 == 0, F.lit("2")).otherwise(F.col("is_laundering").cast("string")).alias("flag"))
    return saml.problems(rows, config.labels(spark)).groupBy(F.array_join("violations", "; ").alias("violations")).agg(F.count("*").alias("n"))


@query(
    "WITH fx(label, iso, rate, i) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DECIMAL(18,6), {i})" for i, (a, b, c) in enumerate(config.FX)) + ") "
    "SELECT iso, COUNT(*) AS n, SUM(CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * rate, 2) AS DECIMAL(18,2))) AS total_brl FROM orders JOIN fx ON o_orderkey % 13 = i GROUP BY iso"
)
def fx_convert(spark: SparkSession, d: str) -> DataFrame:
    fx = config.fx(spark)
    label = F.element_at(F.array(*[F.lit(a) for a, _, _ in config.FX]), (F.col("o_orderkey") % 13 + 1).cast("int"))
    rows = D.read(spark, d, "orders").select(label.alias("label"), D.cents("o_totalprice").alias("amount")).join(F.broadcast(fx), "label")
    return rows.withColumn("brl", saml.convert(F.col("amount"), F.col("rate"))).groupBy("iso").agg(F.count("*").alias("n"), F.sum("brl").alias("total_brl"))


@query("""WITH k AS (SELECT c_custkey, CAST(c_custkey * 104729 % 99999999999 + 1 AS VARCHAR) AS raw FROM customer), p AS (SELECT *, lpad(raw, 11, '0') AS z FROM k),
s AS (SELECT *, list_sum(list_transform(range(1, 12), lambda i: CAST(z[12 - i] AS INT) * ((i - 1) % 8 + 2))) % 11 AS r FROM p)
SELECT c_custkey, substr(z, 1, 4) || '-' || substr(z, 5, 7) || '-' || CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS account FROM s""")
def account_format(spark: SparkSession, d: str) -> DataFrame:
    raw = (F.col("c_custkey") * 104729 % 99999999999 + 1).cast("string")
    return D.read(spark, d, "customer").select("c_custkey", checkdigits.account_number(raw).alias("account"))


@query(f"""WITH z AS (SELECT 1) {CUSTOMERS} SELECT customer_id, cpf_cnpj, cpf_cnpj <> repeat('0', 11) AS valid, FALSE AS valid_changed FROM cust""")
def cpf_generate_validate(spark: SparkSession, d: str) -> DataFrame:
    c = D.customers(spark, d)
    changed = F.concat(F.substring("cpf_cnpj", 1, 10), ((F.substring("cpf_cnpj", 11, 1).cast("int") + 1) % 10).cast("string"))
    return c.select("customer_id", "cpf_cnpj", checkdigits.valid_document(F.col("cpf_cnpj")).alias("valid"), checkdigits.valid_document(changed).alias("valid_changed"))


@query(f"""{TX} {CUSTOMERS} SELECT customer_id, COUNT(*) AS n_tx, SUM(amount_brl) AS total_brl FROM tx JOIN cust ON holder = account GROUP BY 1""")
def accounts_customers_join(spark: SparkSession, d: str) -> DataFrame:
    totals = _tx(spark, d).groupBy(F.col("holder").alias("account")).agg(F.count("*").alias("n_tx"), F.sum("amount_brl").alias("total_brl"))  # aggregated before the join
    c = D.customers(spark, d)
    return totals.join(A.account_customers(c.select("account", "customer_id"), c), "account").select("customer_id", "n_tx", "total_brl")


@query(f"{TX} SELECT holder AS account, MAX(is_laundering) = 1 AS suspicious FROM tx GROUP BY 1")
def account_classes(spark: SparkSession, d: str) -> DataFrame:
    return sampling.account_classes(_tx(spark, d), "holder")


@query(f"""{TX}, c AS (SELECT sender_account AS account, MAX(is_laundering) AS s FROM tx GROUP BY 1), a AS (SELECT account FROM c), b AS (SELECT account FROM c WHERE s = 1), r AS (SELECT DISTINCT receiver_account AS account FROM tx)
SELECT 'all' AS set_name, COUNT(*) AS n FROM a UNION ALL SELECT 'normal', COUNT(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both sides', COUNT(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM r)
UNION ALL SELECT 'either side', COUNT(*) FROM (SELECT * FROM a UNION SELECT * FROM r)""")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    tx = _tx(spark, d)
    a, r = tx.select(F.col("sender_account").alias("account")).distinct(), tx.select(F.col("receiver_account").alias("account")).distinct()
    n = lambda df, name: df.agg(F.lit(name).alias("set_name"), F.count("*").alias("n"))
    return n(a, "all").unionByName(n(sampling.normal_accounts(tx), "normal")).unionByName(n(a.intersect(r), "both sides")).unionByName(n(a.union(r).distinct(), "either side"))


@query(f"{ALERTS} SELECT alert_id, account, rule_id, start, \"end\", selected_at FROM alerts")
def alerts_high_value(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d)


@query("""WITH ev AS (SELECT 'U' || user_id AS account, ts, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n,
 MIN(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS start FROM events),
g AS (SELECT account, ts, start, lead(ts) OVER (PARTITION BY account ORDER BY ts) AS nxt FROM ev WHERE n >= 6)
SELECT DISTINCT account, 'LEG-CONTAGEM-VELOC-01' AS rule_id, start, ts AS "end" FROM g WHERE nxt IS NULL OR nxt - ts > INTERVAL 1 DAY""")
def alerts_velocity(spark: SparkSession, d: str) -> DataFrame:
    return A.episodes(D.events(spark, d), VELOCITY)


@query(f"""{ALERTS}, v AS (SELECT holder AS account, timestamp, COUNT(*) OVER (PARTITION BY holder ORDER BY timestamp RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS n FROM tx),
vg AS (SELECT account, timestamp, lead(timestamp) OVER (PARTITION BY account ORDER BY timestamp) AS nxt FROM (SELECT DISTINCT account, timestamp FROM v WHERE n >= 6))
SELECT rule_id, COUNT(*) AS n FROM (SELECT rule_id FROM alerts UNION ALL SELECT 'LEG-CONTAGEM-VELOC-01' FROM vg WHERE nxt IS NULL OR nxt - timestamp > INTERVAL 30 DAY) GROUP BY 1""")
def alerts_union(spark: SparkSession, d: str) -> DataFrame:
    return A.alerts(_tx(spark, d), [VALUE, config.VelocityRule()], "holder").groupBy("rule_id").agg(F.count("alert_id").alias("n"))


@query(f"{ATX} SELECT alert_id, holder, seq, transaction_id, timestamp, amount_brl FROM atx")
def alert_transactions(spark: SparkSession, d: str) -> DataFrame:
    tx = _tx(spark, d).select("transaction_id", "timestamp", "amount_brl", "holder")
    return A.alert_transactions(_alerts(spark, d), tx, "holder").select("alert_id", "holder", "seq", "transaction_id", "timestamp", "amount_brl")


@query(f"""{ATX}, j AS (SELECT a.alert_id, a.rule_id, MAX(is_laundering) AS hit FROM alerts a JOIN atx USING (alert_id) GROUP BY 1, 2)
SELECT rule_id, COUNT(*) AS alerts, COUNT(*) FILTER (hit = 0) AS false_positives, COUNT(*) FILTER (hit = 0)::DOUBLE / COUNT(*) AS rate FROM j GROUP BY ROLLUP (rule_id)""")
def fp_report(spark: SparkSession, d: str) -> DataFrame:
    found = _alerts(spark, d)
    return A.false_positives(found, A.alert_transactions(found, _tx(spark, d).select("transaction_id", "timestamp", "holder", "is_laundering"), "holder"))


_STRATA = f"""{ATX}, lc AS (SELECT alert_id, laundering_type, MAX(is_laundering) AS s, COUNT(*) AS n FROM atx GROUP BY 1, 2),
st AS (SELECT alert_id, CASE COUNT(*) FILTER (s = 1) WHEN 1 THEN MIN(laundering_type) FILTER (s = 1) WHEN 0 THEN arg_min(laundering_type, (-n, laundering_type)) END AS stratum FROM lc GROUP BY 1)"""


def _strata(spark: SparkSession, d: str) -> DataFrame:
    tx = _tx(spark, d).select("transaction_id", "timestamp", "holder", "laundering_type")
    return sampling.strata(A.alert_transactions(_alerts(spark, d), tx, "holder"), config.labels(spark))


@query(f"{_STRATA} SELECT alert_id, stratum FROM st")
def alert_strata(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d)


@query(f"{_STRATA}, l AS (SELECT unnest({_LABELS}) AS label, unnest(range(0, 28)) AS i) SELECT label, i < 17 AS suspicious, i < 6 AS critical, COUNT(alert_id) AS available FROM l LEFT JOIN st ON label = stratum GROUP BY ALL")
def strata_pools(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pool_sizes(_strata(spark, d), config.labels(spark))


@query(f"""{_STRATA}, q AS (SELECT alert_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('20260916|' || alert_id), alert_id) AS place FROM st WHERE stratum IS NOT NULL)
SELECT alert_id, stratum, place FROM q WHERE place <= 10""")
def golden_sample(spark: SparkSession, d: str) -> DataFrame:
    quota = config.labels(spark).select(F.col("label").alias("stratum"), F.lit(10).alias("quota"))
    return sampling.stratified(_strata(spark, d), quota, config.SplitRules().seed)


@query(f"""{TX}, c AS (SELECT holder AS account, MAX(is_laundering) = 1 AS suspicious FROM tx GROUP BY 1), n AS (SELECT suspicious, round_even(COUNT(*) * CASE WHEN suspicious THEN 0.5 ELSE 0.3 END, 0) AS k FROM c GROUP BY 1),
r AS (SELECT account, suspicious, row_number() OVER (PARTITION BY suspicious ORDER BY sha256('20260916|' || account), account) AS p FROM c) SELECT account, suspicious, p <= k AS golden FROM r JOIN n USING (suspicious)""")
def golden_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_accounts(sampling.account_classes(_tx(spark, d), "holder"))


@query(f"""{ATX}, lo AS (SELECT alert_id, timestamp - lag(timestamp, 2) OVER (PARTITION BY alert_id ORDER BY timestamp, seq) AS span FROM atx WHERE amount_brl < 10000),
h AS (SELECT alert_id, bool_or(span <= INTERVAL 7 DAY) AS hit FROM lo GROUP BY 1) SELECT alert_id, COALESCE(hit, FALSE) AS fired FROM alerts LEFT JOIN h USING (alert_id)""")
def triage_fragmentation(spark: SparkSession, d: str) -> DataFrame:
    tx = _tx(spark, d).select("transaction_id", "timestamp", "holder", "amount_brl")
    return triage.fragmentation(A.alert_transactions(_alerts(spark, d), tx, "holder"))


_LAYERS = f"""{ATX}, ly AS (SELECT alert_id, bool_or(direction = 'in')::INT + bool_or(direction = 'out')::INT AS depth, COUNT(DISTINCT counterparty) AS n_counterparties FROM cp WHERE last - timestamp <= INTERVAL 30 DAY GROUP BY 1),
lay AS (SELECT alert_id, COALESCE(depth, 0) AS depth, COALESCE(n_counterparties, 0) AS n_counterparties, COALESCE(depth >= 2 AND n_counterparties >= 3, FALSE) AS fired FROM alerts LEFT JOIN ly USING (alert_id))"""


@query(f"{_LAYERS} SELECT alert_id, depth, n_counterparties, fired FROM lay")
def triage_layering(spark: SparkSession, d: str) -> DataFrame:
    return triage.layers(_atx(spark, d))


_CASH = """, cash AS (SELECT d.alert_id, arg_min(d.transaction_id, (d.timestamp, d.seq, s.timestamp, s.seq)) AS deposit_id, arg_min(s.transaction_id, (d.timestamp, d.seq, s.timestamp, s.seq)) AS sending_id
 FROM atx d JOIN atx s ON d.alert_id = s.alert_id AND s.timestamp BETWEEN d.timestamp AND d.timestamp + INTERVAL 7 DAY
 WHERE d.payment_type = 'ESPECIE_DEPOSITO' AND s.sender_account = s.holder AND (s.payment_type = 'TRANSFERENCIA_INTERNACIONAL' OR s.sender_location <> s.receiver_location) GROUP BY 1)"""


@query(f"{ATX} {_CASH} SELECT * FROM cash")
def triage_cash_abroad(spark: SparkSession, d: str) -> DataFrame:
    return triage.cash_then_abroad(_atx(spark, d))


def _lists(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    c = D.customers(spark, d)
    return triage.restriction(found.join(c.select("account", "customer_id"), "account").select("alert_id", "customer_id"), c)


_LISTS = f"""{CUSTOMERS}, lists AS (SELECT alert_id, CASE WHEN pep THEN 'sim' ELSE 'nao' END AS pep, CASE WHEN ceis THEN 'sim' ELSE 'nao' END AS ceis, CASE WHEN cnep THEN 'sim' ELSE 'nao' END AS cnep, pep OR ceis OR cnep AS fired, TRUE AS lookup_ok
 FROM alerts JOIN cust USING (account))"""


@query(f"{ATX} {_LISTS} SELECT * FROM lists")
def triage_restriction(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d, _alerts(spark, d))


_DECISION = f"""{_LAYERS} {_CASH} {_LISTS}, lo AS (SELECT alert_id, timestamp - lag(timestamp, 2) OVER (PARTITION BY alert_id ORDER BY timestamp, seq) AS span FROM atx WHERE amount_brl < 10000),
fr AS (SELECT alert_id, bool_or(span <= INTERVAL 7 DAY) AS hit FROM lo GROUP BY 1),
dec AS (SELECT alert_id, concat_ws(',', CASE WHEN fr.hit THEN 'FRAGMENTACAO' END, CASE WHEN lay.fired THEN 'CAMADAS' END, CASE WHEN cash.deposit_id IS NOT NULL THEN 'ESPECIE_DEPOIS_EXTERIOR' END, CASE WHEN lists.fired THEN 'LISTA_RESTRICAO' END) AS rules
 FROM alerts LEFT JOIN fr USING (alert_id) JOIN lay USING (alert_id) LEFT JOIN cash USING (alert_id) JOIN lists USING (alert_id)),
decision AS (SELECT alert_id, CASE WHEN rules = '' THEN 'PROPOR_ARQUIVAMENTO' ELSE 'INVESTIGAR' END AS level, 'TRIAGED' AS state, rules FROM dec)"""


def _decision(spark: SparkSession, d: str) -> DataFrame:
    _, found, atx = _staged(spark, d)
    return triage.decide(atx, _lists(spark, d, found)).join(found.select("alert_id", "selected_at"), "alert_id")


@query(f"{_DECISION} SELECT alert_id, level, state, rules FROM decision")
def triage_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decision(spark, d).select("alert_id", "level", "state", F.array_join("fired_rules", ",").alias("rules"))


_BASIC = """SELECT alert_id, COUNT(*) AS f01, CAST(round(SUM(amount_brl), 0) AS BIGINT) AS f02, COUNT(*) FILTER (amount_brl < 10000) AS f03, COUNT(*) FILTER (payment_type = 'ESPECIE_DEPOSITO') AS f04,
 COUNT(*) FILTER (payment_type IN ('PIX', 'TED') AND sender_account = holder) AS f05, COUNT(*) FILTER (payment_type = 'TRANSFERENCIA_INTERNACIONAL' OR sender_location <> receiver_location) AS f09, COUNT(DISTINCT CAST(timestamp AS DATE)) AS f12 FROM atx GROUP BY 1"""


@query(f"{ATX} {_BASIC}")
def features_basic(spark: SparkSession, d: str) -> DataFrame:
    return features.basic(_atx(spark, d))


_TOP = """ranked AS (SELECT alert_id, counterparty, COUNT(*) FILTER (direction = 'in') AS n_in, COUNT(*) FILTER (direction = 'out') AS n_out, CAST(round(SUM(amount_brl), 0) AS BIGINT) AS brl FROM cp GROUP BY 1, 2),
top AS (SELECT alert_id, 'F' || lpad(CAST(13 + row_number() OVER (PARTITION BY alert_id ORDER BY brl DESC, counterparty) AS VARCHAR), 2, '0') AS feature_id, counterparty, n_in, n_out, brl,
 'in=' || n_in || ' out=' || n_out || ' brl=' || brl AS value FROM ranked)"""


@query(f"{ATX}, {_TOP} SELECT * FROM top")
def features_top_counterparties(spark: SparkSession, d: str) -> DataFrame:
    return features.ranked_counterparties(_atx(spark, d)).drop("ids")


@query(f"{ATX} SELECT alert_id, COUNT(DISTINCT counterparty) FILTER (direction = 'in') AS f06, COUNT(DISTINCT counterparty) FILTER (direction = 'out') AS f07 FROM cp GROUP BY 1")
def features_counterparty(spark: SparkSession, d: str) -> DataFrame:
    return features.by_counterparty(_atx(spark, d)).groupBy("alert_id").agg(F.count("first_in").alias("f06"), F.count("first_out").alias("f07"))


_PAST = """, past AS (SELECT a.alert_id, COALESCE(SUM(t.amount_brl), 0) AS history_brl FROM alerts a LEFT JOIN tx t ON t.holder = a.account AND t.timestamp >= a.selected_at - INTERVAL 180 DAY AND t.timestamp < a.selected_at GROUP BY 1)"""


@query(f"{ATX} {_PAST} SELECT alert_id, CAST(history_brl AS DECIMAL(28,2)) AS history_brl FROM past")
def customer_history(spark: SparkSession, d: str) -> DataFrame:
    past = features.history(_alerts(spark, d), _tx(spark, d).select("holder", "timestamp", "amount_brl"), "holder")
    return past.withColumn("history_brl", F.col("history_brl").cast("decimal(28,2)"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    _, found, atx = _staged(spark, d)
    return features.indicators(found, atx, features.history(found, _tx(spark, d), "holder"), _lists(spark, d, found))


@query(f"""{_LAYERS} {_CASH} {_LISTS}, {_TOP}, b AS ({_BASIC}), c6 AS (SELECT alert_id, COUNT(DISTINCT counterparty) FILTER (direction = 'in') AS f06, COUNT(DISTINCT counterparty) FILTER (direction = 'out') AS f07 FROM cp GROUP BY 1),
w AS (SELECT b.*, f06, f07, depth AS f08, CASE WHEN deposit_id IS NULL THEN 'nao' ELSE 'sim' END AS f10, 'pep:' || pep || ',ceis:' || ceis || ',cnep:' || cnep AS f13 FROM b LEFT JOIN c6 USING (alert_id) JOIN lay USING (alert_id) LEFT JOIN cash USING (alert_id) JOIN lists USING (alert_id))
SELECT alert_id, x.feature_id AS feature_id, x.value AS value FROM (SELECT alert_id, unnest([{', '.join("{'feature_id': 'F%02d', 'value': CAST(f%02d AS VARCHAR)}" % (i, i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13))}]) AS x FROM w)
UNION ALL SELECT alert_id, feature_id, value FROM top""")
def features_long(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).where("feature_id <> 'F11'").select("alert_id", "feature_id", features.rendered().alias("value"))


@query(f"""{ATX} {_PAST}, t AS (SELECT alert_id, SUM(amount_brl) AS total FROM atx GROUP BY 1),
v AS (SELECT alert_id, total::DOUBLE / greatest(history_brl::DOUBLE * round(greatest(epoch_us("end") - epoch_us(start), 86400) / 86400000000.0, 6) / 180, 0.01) AS r FROM alerts JOIN t USING (alert_id) JOIN past USING (alert_id))
SELECT alert_id, printf('%.1fx', round_even(r, 1)) AS value_str FROM v""")
def features_volume_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).where("feature_id = 'F11'").select("alert_id", "value_str")


@query(f"""{ATX}, {_TOP}, n AS (SELECT alert_id, feature_id, counterparty, brl, row_number() OVER (PARTITION BY alert_id ORDER BY brl DESC, CAST(feature_id[2:] AS INT)) AS r FROM top) SELECT alert_id, feature_id, 5 AS n_tokens, r * 5 <= 20 AS kept FROM n""")
def prompt_budget(spark: SparkSession, d: str) -> DataFrame:
    top = features.ranked_counterparties(_atx(spark, d)).select("alert_id", "feature_id", F.col("counterparty").alias("name"), F.lit(None).cast("long").alias("value_int"), F.col("value").alias("value_str"))
    return features.prompt_lines(top, 20).select("alert_id", "feature_id", F.col("n_tokens").cast("int").alias("n_tokens"), "kept")


@query(f"""{ATX}, f AS (SELECT alert_id, value, MIN(spot) AS spot FROM (SELECT alert_id, holder AS value, 0 AS spot FROM atx UNION ALL SELECT alert_id, sender_account, 2 * seq FROM atx UNION ALL SELECT alert_id, receiver_account, 2 * seq + 1 FROM atx) GROUP BY 1, 2)
SELECT alert_id, 'CONTA' AS kind, value, 'CONTA_' || lpad(CAST(row_number() OVER (PARTITION BY alert_id ORDER BY spot, value) AS VARCHAR), greatest(2, strlen(CAST(row_number() OVER (PARTITION BY alert_id ORDER BY spot, value) AS VARCHAR)))::INT, '0') AS token FROM f""")
def pii_tokens(spark: SparkSession, d: str) -> DataFrame:
    nobody = _alerts(spark, d).select("alert_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("cpf_cnpj"))
    return sanitize.token_table(nobody, _atx(spark, d))


@query(f"""{ATX} {CUSTOMERS}, seen AS (SELECT alert_id, 'CONTA' AS kind, holder AS value, 0 AS spot FROM atx UNION ALL SELECT alert_id, 'CONTA', sender_account, 2 * seq FROM atx UNION ALL SELECT alert_id, 'CONTA', receiver_account, 2 * seq + 1 FROM atx
UNION ALL SELECT alert_id, 'NOME', name, 0 FROM alerts JOIN cust USING (account) UNION ALL SELECT alert_id, 'DOCUMENTO', cpf_cnpj, 0 FROM alerts JOIN cust USING (account)),
f AS (SELECT kind, value, min((alert_id < '8', alert_id, spot)) AS late, min((alert_id >= '8', alert_id, spot)) AS o FROM seen GROUP BY 1, 2), r AS (SELECT kind, value, o[1] AS second, row_number() OVER (PARTITION BY kind ORDER BY o, value) AS number FROM f)
SELECT kind, value, number, CASE WHEN second THEN 2 ELSE 1 END AS batch, kind || '_' || lpad(CAST(number AS VARCHAR), greatest(2, strlen(CAST(number AS VARCHAR)))::INT, '0') AS token FROM r""")
def pii_shared_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The vault after two batches of alerts: numbers of the second go on where the first one's ended."""
    _, found, atx = _staged(spark, d)
    named = found.join(D.customers(spark, d), "account").select("alert_id", "name", "cpf_cnpj")
    seen = store.staged(sanitize.appearances(named, atx))
    first = store.staged(sanitize.new_tokens(seen.where("alert_id < '8'")))
    second = sanitize.new_tokens(seen.where("alert_id >= '8'"), first)
    return first.withColumn("batch", F.lit(1)).unionByName(second.withColumn("batch", F.lit(2))).select("kind", "value", "number", "batch", "token")


@query("""WITH v AS (SELECT DISTINCT substr(text, 41, 20) AS value FROM documents WHERE length(text) >= 60) SELECT value, COUNT(*) AS n_rows FROM v JOIN documents ON contains(text, value) GROUP BY 1""")
def canary_documents(spark: SparkSession, d: str) -> DataFrame:
    """Twenty characters of every document as marked values, looked for in all documents."""
    documents = D.read(spark, d, "documents").select("text")
    return marked.rows_by_value(documents, documents.where(F.length("text") >= 60).select(F.substring("text", 41, 20).alias("value")))


@query(f"""{ATX} {CUSTOMERS}, n AS (SELECT alert_id, COUNT(*) AS n FROM atx GROUP BY 1) SELECT alert_id, CASE WHEN cpf_cnpj = repeat('0', 11) THEN 'NEEDS_HUMAN' ELSE 'SANITIZED' END AS state, CASE WHEN cpf_cnpj <> repeat('0', 11) THEN 3 + 2 * n END AS pii_token_count FROM alerts JOIN n USING (alert_id) JOIN cust USING (account)""")
def pii_sanitised(spark: SparkSession, d: str) -> DataFrame:
    _, found, atx = _staged(spark, d)
    named = found.join(D.customers(spark, d), "account").select("alert_id", "name", "cpf_cnpj")
    head, _ = sanitize.sanitised(named, atx, sanitize.token_table(named, atx))
    return head.select("alert_id", "state", "pii_token_count")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\b(\d{3}\.?\d{3}\.?\d{3}-?\d{2})\b', 1)) AS n_cpf, len(regexp_extract_all(text, '\b(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})\b', 1)) AS n_cnpj,
 len(regexp_extract_all(text, '\b([0-9]{10,20})\b', 1)) AS n_account FROM documents""")
def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    return D.read(spark, d, "documents").select("doc_id", *text.pii_counts(F.col("text")))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS text_sha256 FROM documents")
def text_norm_hash(spark: SparkSession, d: str) -> DataFrame:
    return D.read(spark, d, "documents").select("doc_id", text.text_sha256(F.col("text")).alias("text_sha256"))


_VEC = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, c.vec_id::VARCHAR AS chunk_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
 FROM v q JOIN v c ON q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM s), near AS (SELECT * FROM r WHERE pos <= 8)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    e = D.read(spark, d, "embeddings")
    chunks = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), F.lit("v1").alias("corpus_version"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit("v1").alias("corpus_version"))
    return retrieval.vector_top_k(asked, chunks, 8)


@query(f"{_VEC} SELECT query_id, chunk_id, round(score, 6) AS score, pos FROM near")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).withColumn("score", F.round(F.col("score"), 6))


@query(f"{_VEC} SELECT query_id, chunk_id, round(score, 6) AS score, pos FROM near")
def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The index as built from two thirds of the vectors, some of them wrong, then brought up to date; the same queries as ``vector_topk``."""
    e = D.read(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), F.lit("v1").alias("corpus_version"))
    wrong = F.transform("vector", lambda x: -x)
    path = store.work_path(spark, "index")
    pivots.build(e.where("vec_id % 3 <> 0").withColumn("vector", F.when(F.col("vec_id") % 7 == 0, wrong).otherwise(F.col("vector"))), path)
    pivots.upsert(e.where("vec_id % 3 = 0 OR vec_id % 7 = 0"), path)
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector", "corpus_version")
    return pivots.search(asked, path, 8).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "pos")


_CACHE = """WITH a AS (SELECT vec_id, 'v' || vec_id % 2 AS v, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
q AS (SELECT vec_id, v, list_transform(e, lambda x, i: CASE WHEN vec_id % 5 = 0 AND i % 2 = 0 THEN x * 0.3::DOUBLE WHEN i % 4 = 0 THEN x * 0.5::DOUBLE ELSE x END) AS e FROM a),
s AS (SELECT q.vec_id AS query_id, a.vec_id AS answer_id, list_dot_product(q.e, a.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(a.e, a.e))) AS score FROM q JOIN a USING (v)),
h AS (SELECT query_id, COUNT(*) AS n_links, arg_min(answer_id, (-round(score, 9), answer_id)) AS answer_id, MAX(score) AS score FROM s WHERE score >= 0.92 GROUP BY 1)"""


@query(f"{_CACHE} SELECT vec_id AS query_id, v AS corpus_version, answer_id, round(score, 6) AS score, COALESCE(n_links, 0) AS n_links FROM q LEFT JOIN h ON vec_id = query_id")
def similarity_cache(spark: SparkSession, d: str) -> DataFrame:
    """Every vector, changed a little, as a question to the answers stored under the vectors; a fifth is changed beyond the threshold."""
    e = D.read(spark, d, "embeddings").select(F.col("vec_id").alias("answer_id"), F.col("embedding").alias("vector"), F.concat(F.lit("v"), (F.col("vec_id") % 2).cast("string")).alias("corpus_version"))
    far = F.col("answer_id") % 5 == 0
    changed = F.transform("vector", lambda x, i: F.when(far & (i % 2 == 1), x.cast("double") * 0.3).when(i % 4 == 3, x.cast("double") * 0.5).otherwise(x.cast("double")))
    asked = e.select(F.col("answer_id").alias("query_id"), changed.alias("vector"), "corpus_version")
    return pivots.cached_answers(asked, e, 0.92).withColumn("score", F.round("score", 6))


_BM = r""", d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents), cand AS (SELECT query_id, chunk_id, pos, score, c.tokens, q.tokens AS qt, vec_id FROM near JOIN d c ON c.doc_id = vec_id JOIN d q ON q.doc_id = query_id {where}),
tfs AS (SELECT query_id, chunk_id, word, COUNT(*) AS tf, MAX(size) AS size FROM (SELECT query_id, chunk_id, len(tokens) AS size, unnest(tokens) AS word FROM cand) GROUP BY 1, 2, 3),
n AS (SELECT query_id, COUNT(*) AS n, AVG(len(tokens)) AS mean_size FROM cand GROUP BY 1), dfs AS (SELECT query_id, word, COUNT(*) AS df FROM tfs GROUP BY 1, 2),
raw AS (SELECT query_id, word, mean_size, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs JOIN n USING (query_id)), m AS (SELECT query_id, AVG(raw) AS mr FROM raw GROUP BY 1),
idf AS (SELECT query_id, word, mean_size, CASE WHEN raw < 0 THEN 0.25 * mr ELSE raw END AS idf FROM raw JOIN m USING (query_id)),
qw AS (SELECT query_id, word, COUNT(*) AS times FROM (SELECT doc_id AS query_id, unnest(tokens) AS word FROM d WHERE doc_id % 100 = 0) GROUP BY 1, 2),
bm AS (SELECT query_id, chunk_id, SUM(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean_size))) AS bm25 FROM tfs JOIN idf USING (query_id, word) JOIN qw USING (query_id, word) GROUP BY 1, 2),
sc AS (SELECT query_id, chunk_id, vec_id, pos, score, COALESCE(bm25, 0) AS bm25 FROM cand LEFT JOIN bm USING (query_id, chunk_id))"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """The eight passages nearest to each query by vector, of all documents, with both whole texts as words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    doc = D.read(spark, d, "documents").select("doc_id", words.alias("tokens"), "text")
    found = store.staged(_near(spark, d))
    with_text = found.join(doc.select(F.col("doc_id").cast("string").alias("chunk_id"), "tokens", "text"), "chunk_id")
    return with_text.join(doc.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("tokens").alias("query_tokens")), "query_id")


@query(f"{_VEC}{_BM.format(where='')} SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM sc")
def bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_candidates(spark, d), F.col("tokens"), F.col("query_tokens")).withColumn("bm25", F.round(F.col("bm25"), 6))


@query(f"""{_VEC}{_BM.format(where='WHERE score >= 0.35')}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rv, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, pos) AS rb FROM sc),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_id % 5 = 0 DESC, 1.0::DOUBLE / (60 + rv) + 1.0::DOUBLE / (60 + rb) DESC, pos) AS place FROM k) SELECT query_id, chunk_id, 'art' || (vec_id % 5) AS article_ref, place AS pos FROM o WHERE place <= 3""")
def rrf_select(spark: SparkSession, d: str) -> DataFrame:
    """Passages of article 0 are preferred."""
    c = _candidates(spark, d).withColumn("article_ref", F.concat(F.lit("art"), (F.col("chunk_id").cast("long") % 5).cast("string")))
    preferred = D.read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit("applies").alias("applicability"), F.array(F.lit("art0")).alias("refs"))
    return retrieval.select_citations(c, preferred, 0.35).select("query_id", "chunk_id", "article_ref", "pos")


_REVIEW = """WITH c AS (SELECT 'a' || (doc_id % 50) AS alert_id, 'c' || doc_id AS chunk_id, doc_id % 7 <> 0 AS retrieved, doc_id % 11 <> 0 AS known, doc_id % 13 <> 0 AS same FROM documents),
r AS (SELECT alert_id, chunk_id, CASE WHEN NOT retrieved THEN 'not retrieved' WHEN NOT known THEN 'not in the corpus version' WHEN NOT same THEN 'SHA-256 differs' END AS reason FROM c)"""


@query(f"{_REVIEW} SELECT alert_id, COUNT(*) AS n_proposed, COUNT(*) FILTER (reason IS NULL) AS n_verified, COUNT(*) FILTER (reason IS NULL)::DOUBLE / COUNT(*) AS grounding FROM r GROUP BY 1")
def citation_review(spark: SparkSession, d: str) -> DataFrame:
    doc = D.read(spark, d, "documents")
    c = doc.select("doc_id", F.concat(F.lit("a"), (F.col("doc_id") % 50).cast("string")).alias("alert_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.md5("text").alias("text_sha256"))
    chunks = c.withColumn("corpus_version", F.when(F.col("doc_id") % 11 == 0, F.lit("v0")).otherwise(F.lit("v1")))
    cited = c.withColumn("quoted", F.when(F.col("doc_id") % 13 == 0, F.lit("x")).otherwise(F.col("text_sha256"))).select("alert_id", "chunk_id", "quoted")
    return retrieval.verdicts(retrieval.reviewed(cited, c.where("doc_id % 7 <> 0"), chunks, "v1", F.col("quoted")))


@query(r"""WITH l AS (SELECT 'D' || doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc, doc || '/art1/p' || i AS ref, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l UNION ALL SELECT 'D' || doc_id, 'D' || doc_id || '/art1/caput', 'caput' FROM documents WHERE text IS NOT NULL)
SELECT doc || ':' || ref || ':v1' AS chunk_id, ref AS article_ref, sha256(trim(regexp_replace(nfc_normalize(t), '\s+', ' ', 'g'))) AS text_sha256 FROM p WHERE t <> ''""")
def norm_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents set as articles with paragraphs, one for each line."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("§ "), (i + 1).cast("string"), F.lit("º "), line)), "\n")
    norm = D.read(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.lit("Art. 1º "), F.lit("caput\n"), body).alias("text"), F.lit("local").alias("source_url"))
    return norms.chunks(norm, "v1").select("chunk_id", "article_ref", "text_sha256")


@query(r"""WITH l AS (SELECT 'D' || doc_id AS doc, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
g AS (SELECT doc, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t, doc || '/art1/p' || (i + 3) // 4 || CASE i % 4 WHEN 1 THEN CASE WHEN i < n THEN '/caput' ELSE '' END WHEN 2 THEN '/i4' WHEN 3 THEN '/i4/a' ELSE '/i4/b' END AS ref FROM l
 UNION ALL SELECT 'D' || doc_id, 'caput', 'D' || doc_id || '/art1/caput' FROM documents WHERE text IS NOT NULL)
SELECT doc || ':' || ref || ':v1' AS chunk_id, ref AS article_ref, sha256(trim(regexp_replace(nfc_normalize(t), '\s+', ' ', 'g'))) AS text_sha256 FROM g WHERE t <> ''""")
def norm_levels(spark: SparkSession, d: str) -> DataFrame:
    """Documents set as articles of paragraphs, incisos and alíneas: of every four lines one begins a paragraph, one an inciso of it, two are its alíneas."""
    mark = lambda i: F.when(i % 4 == 0, F.concat(F.lit("§ "), F.floor(i / 4 + 1).cast("string"), F.lit("º "))).when(i % 4 == 1, F.lit("IV - ")).when(i % 4 == 2, F.lit("a) ")).otherwise(F.lit("b) "))
    body = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(mark(i), line)), "\n")
    norm = D.read(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.lit("Art. 1º "), F.lit("caput\n"), body).alias("text"), F.lit("local").alias("source_url"))
    return norms.chunks(norm, "v1").select("chunk_id", "article_ref", "text_sha256")


@query("SELECT o_orderkey, o_orderdate + INTERVAL 5 DAY AS prazo_interno, o_orderdate + INTERVAL 45 DAY AS prazo_regulatorio FROM orders")
def deadlines(spark: SparkSession, d: str) -> DataFrame:
    return D.read(spark, d, "orders").select("o_orderkey", *dates.deadlines(F.col("o_orderdate")))


_CLOSED = "[" + ", ".join(f"DATE '{x}'" for x in config.holidays(1994, 2003)) + "]"


@query(f"""WITH k AS (SELECT CAST(x AS DATE) AS day FROM (SELECT unnest(range(DATE '1994-01-01', DATE '2003-12-31', INTERVAL 1 DAY)) AS x)), b AS (SELECT day FROM k WHERE isodow(day) < 6 AND NOT list_contains({_CLOSED}, day)),
n AS (SELECT k.day, MIN(b.day) AS next_business FROM k JOIN b ON b.day > k.day AND b.day < k.day + 15 GROUP BY 1) SELECT o_orderkey, next_business FROM orders JOIN n ON CAST(o_orderdate AS DATE) = day""")
def next_business_day(spark: SparkSession, d: str) -> DataFrame:
    rows = D.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return dates.next_business_day(rows, "day", config.business_calendar(spark, 1994, 2003)).select("o_orderkey", "next_business")


@query(f"{_DECISION} SELECT alert_id, CASE level WHEN 'INVESTIGAR' THEN 'investigation' ELSE 'dossier' END AS next_node FROM decision")
def state_routing(spark: SparkSession, d: str) -> DataFrame:
    return workflow.routed(_decision(spark, d).withColumn("node", F.lit("triage"))).select("alert_id", "next_node")


_OUT = """, o AS (SELECT alert_id, state, level, list_extract(['COMUNICAR','ARQUIVAR','INCONCLUSIVO'], (strpos('0123456789abcdef', alert_id[1]) - 1) % 3 + 1) AS recommendation, (strpos('0123456789abcdef', alert_id[2]) - 1) % 2 AS n_verified FROM decision)"""


@query(f"""{_DECISION} {_OUT} SELECT alert_id, CASE WHEN level = 'PROPOR_ARQUIVAMENTO' THEN 'ARQUIVAMENTO' WHEN recommendation = 'INCONCLUSIVO' OR recommendation = 'COMUNICAR' AND n_verified = 0 THEN NULL WHEN recommendation = 'COMUNICAR' THEN 'COS' ELSE 'ARQUIVAMENTO' END AS dossier_type,
 CASE WHEN level = 'INVESTIGAR' AND (recommendation = 'INCONCLUSIVO' OR recommendation = 'COMUNICAR' AND n_verified = 0) THEN 'NEEDS_HUMAN' ELSE 'DRAFT_READY' END AS state FROM o""")
def dossier_type(spark: SparkSession, d: str) -> DataFrame:
    decision = _decision(spark, d)
    digit = lambda i: F.conv(F.substring("alert_id", i, 1), 16, 10).cast("int")
    recommendation = F.element_at(F.array(*[F.lit(x) for x in config.RECOMMENDATIONS]), digit(1) % 3 + 1)
    outputs = decision.select("alert_id", F.lit("Structuring").alias("typology"), F.lit(0.5).alias("confidence"), recommendation.alias("recommendation"))
    return workflow.dossiers(decision, outputs, decision.select("alert_id", (digit(2) % 2).alias("n_verified"))).select("alert_id", "dossier_type", "state")


@query("""WITH r AS (SELECT 'a' || user_id AS alert_id, event_id AS seq, ts AS updated_at, ts AS created_at, ts AS selected_at, event_type AS state FROM events)
SELECT alert_id, arg_max(state, (updated_at, seq)) AS state, MAX(updated_at) AS updated_at, MIN(created_at) AS created_at, MIN(selected_at) AS selected_at FROM r GROUP BY 1""")
def alert_record_latest(spark: SparkSession, d: str) -> DataFrame:
    e = D.read(spark, d, "events").select(F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("alert_id"), F.col("event_id").alias("seq"), *[F.col("ts").alias(x) for x in ("updated_at", "created_at", "selected_at")], F.col("event_type").alias("state"))
    return store.latest_records(e).select("alert_id", "state", "updated_at", "created_at", "selected_at")


def _audit_events(spark: SparkSession, d: str) -> DataFrame:
    e = D.read(spark, d, "events")
    user = F.concat(F.lit("a"), F.col("user_id").cast("string"))
    return e.select(user.alias("alert_id"), F.concat_ws("_", user, F.col("event_id").cast("string")).alias("event_key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("occurred_at"), F.col("event_type"), F.lit("system").alias("actor"))


def _json(before: str, of: str = "") -> str:
    """SQL for the canonical JSON of an event."""
    fields = {k: "'null'" for k in audit.HASHED} | {"actor": "'\"system\"'", "prev_hash": before, "seq": f"{of}seq"}
    fields |= {k: f"'\"' || {of}{k} || '\"'" for k in ("alert_id", "event_key", "event_type", "occurred_at")}
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items()) + " || '}'"


@query(f"""WITH RECURSIVE e AS (SELECT 'a' || user_id AS alert_id, 'a' || user_id || '_' || event_id AS event_key, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS occurred_at, event_type FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY occurred_at, event_key) AS seq FROM e), c AS (SELECT alert_id, seq, event_key, NULL::VARCHAR AS prev_hash, sha256({_json("'null'")}) AS hash FROM n WHERE seq = 1
UNION ALL SELECT n.alert_id, n.seq, n.event_key, c.hash, sha256({_json("'" + '"' + "' || c.hash || '" + '"' + "'", "n.")}) FROM n JOIN c ON n.alert_id = c.alert_id AND n.seq = c.seq + 1) SELECT * FROM c""")
def audit_chain_append(spark: SparkSession, d: str) -> DataFrame:
    """The log so far holds the chains' first halves; all events come again, and only new keys are appended."""
    events = _audit_events(spark, d)
    each = W.partitionBy("alert_id")
    placed = events.withColumn("p", F.row_number().over(each.orderBy("occurred_at", "event_key"))).withColumn("n", F.count("*").over(each))
    log = store.staged(audit.append(placed.where("p <= n / 2").drop("p", "n"), "alert_id"))
    return log.unionByName(audit.append(events, "alert_id", log=log)).select("alert_id", "seq", "event_key", "prev_hash", "hash")


@query("""WITH u AS (SELECT user_id, COUNT(*) AS n, user_id % 5 = 1 AS changed, user_id % 5 = 2 AS cut FROM events GROUP BY 1)
SELECT 'a' || user_id AS alert_id, NOT (changed AND n >= 2 OR cut AND n >= 3) AS valid, CASE WHEN cut AND n >= 2 THEN n - 1 ELSE n END AS n_events, CASE WHEN changed AND n >= 2 THEN 2 WHEN cut AND n >= 3 THEN 3 END::BIGINT AS first_invalid FROM u""")
def audit_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Chains as appended, chains with a changed second event, chains without their second event."""
    log = audit.append(_audit_events(spark, d), "alert_id").withColumn("kind", F.substring("alert_id", 2, 19).cast("long") % 5)
    second = F.col("seq") == 2
    log = log.withColumn("actor", F.when((F.col("kind") == 1) & second, F.lit("changed")).otherwise(F.col("actor"))).where(~((F.col("kind") == 2) & second))
    return audit.verify(log, "alert_id")


@query("SELECT event_type, COUNT(value) AS n, round(AVG(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.95), 6) AS p95_nearest FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    s = evaluation.latency_summary(D.read(spark, d, "events"), "value", ["event_type"])
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p95_nearest")])


@query("""SELECT 'velocidade' AS gate, round(120 / (AVG(value * 100) / 60000 + 15), 6) AS value, CASE WHEN 120 / (AVG(value * 100) / 60000 + 15) >= 3 THEN 'aprovada' ELSE 'reprovada' END AS status FROM events
UNION ALL SELECT 'latencia_p95_ms', round(quantile_cont(value * 100, 0.95), 6), CASE WHEN quantile_cont(value * 100, 0.95) < 20000 THEN 'aprovada' ELSE 'reprovada' END FROM events
UNION ALL SELECT 'auditoria', MIN((event_id % 1009 <> 8)::INT), CASE WHEN MIN((event_id % 1009 <> 8)::INT) = 1 THEN 'aprovada' ELSE 'reprovada' END FROM events UNION ALL SELECT 'recall', round(AVG((event_id % 10 <> 0)::INT), 6), CASE WHEN AVG((event_id % 10 <> 0)::INT) >= 0.95 THEN 'aprovada' ELSE 'reprovada' END FROM events WHERE event_id % 3 = 0
UNION ALL SELECT 'reducao_falso_positivo', round(1 - AVG((event_id % 10 <> 0)::INT), 6), CASE WHEN 1 - AVG((event_id % 10 <> 0)::INT) >= 0.3 THEN 'aprovada' ELSE 'reprovada' END FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT 'grounding', round(SUM(event_id % 3) / SUM(3.0), 6), 'reprovada' FROM events UNION ALL SELECT 'tokens_p95', round(quantile_cont(event_id % 3000, 0.95), 6), CASE WHEN quantile_cont(event_id % 3000, 0.95) <= 2000 THEN 'aprovada' ELSE 'reprovada' END FROM events
UNION ALL SELECT 'prazo_interno', round(AVG((event_id % 7 <= 5)::INT), 6), CASE WHEN AVG((event_id % 7 <= 5)::INT) >= 1 THEN 'aprovada' ELSE 'reprovada' END FROM events
UNION ALL SELECT 'privacidade', COUNT(*) FILTER (contains(CAST(event_id AS VARCHAR), '77')), CASE WHEN COUNT(*) FILTER (contains(CAST(event_id AS VARCHAR), '77')) = 0 THEN 'aprovada' ELSE 'reprovada' END FROM events""")
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    e = D.read(spark, d, "events")
    level = F.when(F.col("event_id") % 10 == 0, F.lit("PROPOR_ARQUIVAMENTO")).otherwise(F.lit("INVESTIGAR"))
    golden = e.select((F.col("event_id") % 3 == 0).alias("is_suspicious"), level.alias("level"))
    review = e.select((F.col("event_id") % 3).alias("n_verified"), F.lit(3).alias("n_proposed"))
    calls = e.select("event_id", (F.col("event_id") % 3000).alias("tokens"))
    records = e.select((F.col("ts") + F.make_dt_interval((F.col("event_id") % 7).cast("int"))).alias("decided_at"), (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("prazo_interno"))
    leaks = sanitize.canary_scan(e.select(F.col("event_id").cast("string").alias("text")), "events", ["77", "529.982.247-25"])
    rows = evaluation.gates(e.select((F.col("value") * 100).alias("latency_ms")), e.select((F.col("event_id") % 1009 != 8).alias("valid")), golden, review, calls, records, leaks)
    return rows.select("gate", F.round("value", 6).alias("value"), "status")


_ROW = """'{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"status":' || CASE WHEN o_orderstatus = 'F' THEN 'null' WHEN o_orderstatus = 'P' THEN '""' ELSE '"' || o_orderstatus || '"' END || '}'"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a status that is null for some and empty for others."""
    status = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return D.read(spark, d, "orders").select("o_orderkey", "o_custkey", status.alias("status"))


@query(f"""WITH h AS (SELECT sha256({_ROW}) AS x FROM orders), p AS (SELECT ('0x' || substr(x, 1, 15))::BIGINT::HUGEINT AS a, ('0x' || substr(x, 16, 15))::BIGINT::HUGEINT AS b FROM h)
SELECT COUNT(*) AS n, CAST(SUM(a) AS VARCHAR) || ':' || CAST(SUM(b) AS VARCHAR) AS content_hash FROM p""")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return store.content_sum(_states(spark, d))


@query(f"""WITH RECURSIVE r AS (SELECT o_orderkey AS k, {_ROW} AS j FROM orders), s AS (SELECT k, j, row_number() OVER (ORDER BY k) - 1 AS i, COUNT(*) OVER () AS n FROM r),
l AS (SELECT 'whole' AS log, i, j FROM s UNION ALL SELECT 'prefix', i, j FROM s WHERE i < 2 * n // 3 UNION ALL SELECT 'swapped', CASE i WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE i END, j FROM s WHERE i < 2 * n // 3),
t AS (SELECT log, 0 AS level, CAST(i AS BIGINT) AS i, sha256('leaf|' || j) AS h, COUNT(*) OVER (PARTITION BY log) AS size FROM l
UNION ALL SELECT log, level + 1, i // 2, CASE WHEN COUNT(*) = 1 THEN MAX(h) ELSE sha256('node|' || MAX(h) FILTER (i % 2 = 0) || '|' || MAX(h) FILTER (i % 2 = 1)) END, (size + 1) // 2 FROM t WHERE size > 1 GROUP BY log, level, i // 2, size)
SELECT log, (SELECT COUNT(*) FROM l WHERE l.log = t.log) AS n, h AS root, log <> 'swapped' AS extended FROM t WHERE size = 1""")
def log_extension(spark: SparkSession, d: str) -> DataFrame:
    """Roots of a log, of its first two thirds and of these with two rows swapped, and whether the whole log is proved to extend each."""
    rows = store.staged(hashtree.leaves(_states(spark, d), ["o_orderkey"]))
    n = rows.count()
    first = rows.where(F.col("at") < 2 * n // 3)
    swapped = first.withColumn("at", F.when(F.col("at") < 2, 1 - F.col("at")).otherwise(F.col("at")))
    whole, prefix, other = hashtree.build(rows), hashtree.build(first), hashtree.build(swapped)
    proof = whole.consistency_proof(prefix.n)
    found = [("whole", whole.n, whole.root, hashtree.extends(n, whole.root, n, whole.root, []))]
    found += [(name, t.n, t.root, hashtree.extends(t.n, t.root, n, whole.root, proof)) for name, t in (("prefix", prefix), ("swapped", other))]
    return spark.createDataFrame(found, "log STRING, n LONG, root STRING, extended BOOLEAN")


@query("SELECT p_brand AS corpus, COUNT(*) AS n_documents, substr(sha256(string_agg(CAST(p_partkey AS VARCHAR) || ':' || sha256(p_name), '|' ORDER BY CAST(p_partkey AS VARCHAR))), 1, 16) AS corpus_version FROM part GROUP BY 1")
def corpus_version(spark: SparkSession, d: str) -> DataFrame:
    """Parts as documents, a corpus for each brand."""
    m = D.read(spark, d, "part").select(F.col("p_brand").alias("corpus"), F.col("p_partkey").cast("string").alias("doc_id"), F.sha2("p_name", 256).alias("sha256"))
    return m.groupBy("corpus").agg(F.count("*").alias("n_documents"), norms.corpus_version(m).alias("corpus_version"))


@query("""SELECT from_node, to_node, COUNT(*) AS n FROM (SELECT unnest(['sanitizer','triage','triage','investigation']) AS from_node, unnest(['triage','dossier','retrieval','retrieval']) AS to_node, unnest(['DT-04.v1','DT-06.v1','x','DT-09[].v1']) AS s) e
JOIN events ON TRUE WHERE NOT (from_node = 'sanitizer' OR from_node = 'triage' AND to_node = 'dossier') GROUP BY 1, 2""")
def envelope_edges(spark: SparkSession, d: str) -> DataFrame:
    sent = [("sanitizer", "triage", "TASK", "DT-04.v1"), ("triage", "dossier", "TASK", "DT-06.v1"), ("triage", "retrieval", "TASK", "x"), ("investigation", "retrieval", "RESULT", "DT-09[].v1")]
    message = F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(m, ("from_node", "to_node", "message_type", "schema"), strict=True)]) for m in sent]))
    e = D.read(spark, d, "events").select(F.col("event_id").cast("string").alias("alert_id"), F.col("event_id").cast("string").alias("payload_alert_id"), message)
    return workflow.envelope_violations(e, config.edges(spark)).where(F.size("violations") > 0).groupBy("from_node", "to_node").agg(F.count("*").alias("n"))


_ANSWERS = [
    '{"t":"Structuring","c":0.5,"r":"COMUNICAR","e":[1,14]}', '{"t":"Structuring","c":1.5,"r":"COMUNICAR","e":[1]}', '{"t":"Structuring","c":0.5,"r":"COMUNICAR","e":["1"]}', '{"t":"Structuring","c":0.5,"r":"COMUNICAR"}',
    ' {"t":"Structuring","c":1,"r":"ARQUIVAR","e":[]} ', '{"t":"Structuring","c":0.5,"r":"COMUNICAR","e":[1]} and more', '{"t":"Structuring","c":0.5,"r":"COMUNICAR","e":[1]}{"t":"Structuring","c":0.5,"r":"COMUNICAR","e":[1]}',
    'so: {"t":"Structuring","c":0.5,"r":"COMUNICAR","e":[1]}', '{"t":"Structuring","t":"Structuring","c":0.5,"r":"COMUNICAR","e":[1]}', '{"t":null,"c":0.5,"r":"COMUNICAR","e":[1]}', '{"t":"Structuring","c":0.5,"r":"COMUNICAR","e":[1,2,3,4]}', "",
]


@query("""WITH a AS (SELECT event_type, event_id % 12 AS k FROM events) SELECT event_type, k AS answer, COUNT(*) AS n, CASE WHEN k IN (0, 4) THEN COUNT(*) ELSE 0 END AS n_valid,
 CASE k WHEN 0 THEN 'Structuring COMUNICAR F01,F14' WHEN 4 THEN 'Structuring ARQUIVAR ' END AS output FROM a GROUP BY event_type, k""")
def model_output_check(spark: SparkSession, d: str) -> DataFrame:
    """Answers of twelve kinds: two are valid, the others have text around the object, two objects, repeated keys, nulls, wrong types or numbers."""
    k = (F.col("event_id") % 12).cast("int")
    answer = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), k + 1)
    e = D.read(spark, d, "events").select("event_type", k.alias("answer"), workflow.expanded_output(answer).alias("o"))
    told = F.concat_ws(" ", "o.typology", "o.recommendation", F.array_join("o.evidence", ","))
    return e.groupBy("event_type", "answer").agg(F.count("*").alias("n"), F.count("o").alias("n_valid"), F.max(F.when(F.col("o").isNotNull(), told)).alias("output"))


# Roman digits of thousands, hundreds, tens and ones.
_ROMAN = [["", "M", "MM", "MMM"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]]


@query(f"""WITH n AS (SELECT o_orderkey, o_orderkey % 3999 + 1 AS number FROM orders)
SELECT o_orderkey, CAST(number AS INT) AS number, {' || '.join(f"{digits}[number // {10 ** (3 - i)} % 10 + 1]" for i, digits in enumerate(_ROMAN))} AS roman FROM n""")
def roman_numerals(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the orders written in roman digits, and read again."""
    n = F.col("o_orderkey") % 3999 + 1
    digit = lambda i: F.element_at(F.array(*[F.lit(x) for x in _ROMAN[i]]), (F.floor(n / 10 ** (3 - i)) % 10 + 1).cast("int"))
    df = D.read(spark, d, "orders").select("o_orderkey", F.concat(*[digit(i) for i in range(4)]).alias("roman"))
    return df.select("o_orderkey", text.roman(F.col("roman")).cast("int").alias("number"), "roman")


@query("""WITH a AS (SELECT event_id % 1000 AS k, CASE WHEN event_id % 1000 % 3 = 0 AND event_id % 7 = 0 THEN 'q' ELSE 'p' END AS p FROM events), g AS (SELECT k, MIN(p) AS lo, MAX(p) AS hi FROM a GROUP BY 1)
SELECT 'a' || k AS alert_id, CASE WHEN lo <> hi OR k < 500 AND lo <> CASE WHEN k % 2 = 0 THEN 'p' ELSE 'z' END THEN 'conflict' WHEN k < 500 THEN 'repeated' ELSE 'created' END AS status FROM g""")
def alert_idempotency(spark: SparkSession, d: str) -> DataFrame:
    """Half of the alerts are known, every second of these under another payload."""
    k = F.col("event_id") % 1000
    name, sha = F.concat(F.lit("a"), k.cast("string")).alias("alert_id"), lambda c: F.sha2(c, 256).alias("payload_sha256")
    e = D.read(spark, d, "events")
    arriving = e.select(name, sha(F.when((k % 3 == 0) & (F.col("event_id") % 7 == 0), F.lit("q")).otherwise(F.lit("p"))))
    known = e.where(k < 500).select(name, sha(F.when(k % 2 == 0, F.lit("p")).otherwise(F.lit("z")))).distinct()
    return workflow.new_alerts(arriving, known).select("alert_id", "status")


def _permuted(number: str, digits: int, seed: int) -> str:
    """SQL of ``identity.permuted``: a round packs both halves into one number."""
    size, ones = 10**digits, (10**digits - 1) // 9
    half = -(-(size - 1).bit_length() // 2)
    mask = (1 << half) - 1
    once = f"list_reduce([{{x}}] || range(1, {identity.ROUNDS + 1}), lambda a, i: (a & {mask}) << {half} | xor(a >> {half}, ('0x' || substr(md5('{seed}|' || i || '|' || (a & {mask})), 1, 8))::BIGINT & {mask}))"
    start = f"({number} + {number} // {ones - 1} + 1)"
    return f"list_reduce([{once.format(x=start)}] || range(1, {identity.STEPS + 1}), lambda v, j: CASE WHEN v < {size} AND v % {ones} <> 0 THEN v ELSE {once.format(x='v')} END)"


def _digit(base: str, weights: list[int]) -> str:
    total = " + ".join(f"CAST({base}[{i}] AS INT) * {w}" for i, w in enumerate(weights, 1))
    return f"CASE WHEN ({total}) % 11 < 2 THEN '0' ELSE CAST(11 - ({total}) % 11 AS VARCHAR) END"


@query(f"""WITH a AS (SELECT 'C' || c_custkey AS account, c_custkey AS n FROM customer), r AS (SELECT *, {', '.join(f"('0x' || substr(md5('20260916|' || account || '|{k}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u_{k}" for k in ('kind', 'pep', 'ceis', 'cnep'))} FROM a),
b AS (SELECT *, u_kind < 0.2 AS company, lpad(CAST(n + 1 AS VARCHAR), 9, '0') AS p, lpad(CAST(n + 1 AS VARCHAR), 8, '0') || '0001' AS j FROM r), c AS (SELECT *, p || {_digit('p', list(range(10, 1, -1)))} AS p1, j || {_digit('j', [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} AS j1 FROM b),
e AS (SELECT *, p1 || {_digit('p1', list(range(11, 1, -1)))} AS p2, j1 || {_digit('j1', [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} AS j2 FROM c)
SELECT printf('CUST-%07d', n) AS customer_id, CASE WHEN company THEN 'Empresa ' ELSE 'Cliente ' END || printf('%07d', n) AS name, CASE WHEN company THEN j2 ELSE p2 END AS cpf_cnpj, CASE WHEN company THEN 'PJ' ELSE 'PF' END AS segment,
 concat_ws(',', CASE WHEN u_pep < 0.01 THEN 'pep' END, CASE WHEN u_ceis < 0.005 THEN 'ceis' END, CASE WHEN u_cnep < 0.005 THEN 'cnep' END) AS flags, account, CASE WHEN company THEN j2 <> repeat(j2[1], 14) ELSE p2 <> repeat(p2[1], 11) END AS valid FROM e""")
def synthetic_customers(spark: SparkSession, d: str) -> DataFrame:
    accounts = D.read(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("account"), F.col("c_custkey").alias("n"))
    c = sampling.synthetic_customers(accounts, config.SplitRules().seed)
    return c.select("customer_id", "name", "cpf_cnpj", "segment", F.array_join("restriction_flags", ",").alias("flags"), F.col("accounts")[0].alias("account"), checkdigits.valid_document(F.col("cpf_cnpj")).alias("valid"))


@query(f"""WITH a AS (SELECT c_custkey, lpad(CAST({_permuted('CAST(c_custkey AS BIGINT)', 9, 20260916)} AS VARCHAR), 9, '0') AS p, lpad(CAST({_permuted('CAST(c_custkey AS BIGINT)', 12, 20260916)} AS VARCHAR), 12, '0') AS j FROM customer),
c AS (SELECT *, p || {_digit('p', list(range(10, 1, -1)))} AS p1, j || {_digit('j', [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} AS j1 FROM a)
SELECT c_custkey, p1 || {_digit('p1', list(range(11, 1, -1)))} AS cpf, j1 || {_digit('j1', [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} AS cnpj, TRUE AS valid FROM c""")
def drawn_documents(spark: SparkSession, d: str) -> DataFrame:
    """A CPF and a CNPJ for every customer, drawn without repeats."""
    rows = D.read(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("long").alias("number"))
    drawn = sampling.drawn_documents(rows, "number", config.SplitRules().seed)
    return drawn.select("c_custkey", "cpf", "cnpj", (checkdigits.valid_document(F.col("cpf")) & checkdigits.valid_document(F.col("cnpj"))).alias("valid"))


@query(f"""{TX}, c AS (SELECT holder AS account, MAX(is_laundering) = 1 AS suspicious FROM tx GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY sha256('20260916|' || account), account) AS p FROM c WHERE NOT suspicious)
SELECT account, suspicious FROM c WHERE suspicious UNION ALL SELECT account, suspicious FROM n WHERE p <= {config.SplitRules().normal_accounts}""")
def account_sample(spark: SparkSession, d: str) -> DataFrame:
    """All suspicious accounts and the normal ones of least hash, as many as the rules say."""
    return sampling.sample_accounts(sampling.account_classes(_tx(spark, d), "holder"))


@query(f"""{TX}, s AS (SELECT account FROM (SELECT holder AS account, MAX(is_laundering) AS l FROM tx GROUP BY 1) WHERE l = 1)
SELECT holder, COUNT(*) AS n, SUM(amount_brl) AS total_brl FROM tx WHERE sender_account IN (SELECT account FROM s) OR receiver_account IN (SELECT account FROM s) GROUP BY 1""")
def sampled_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with a suspicious account on either side."""
    tx = store.staged(_tx(spark, d))
    some = sampling.account_classes(tx, "holder").where("suspicious")
    return sampling.of_accounts(tx, some, ("sender_account", "receiver_account")).groupBy("holder").agg(F.count("*").alias("n"), F.sum("amount_brl").alias("total_brl"))


_EVENTS_VELOCITY = """WITH ev AS (SELECT 'U' || user_id AS account, ts, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n,
 MIN(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS start FROM events),
g AS (SELECT account, ts, start, lead(ts) OVER (PARTITION BY account ORDER BY ts) AS nxt FROM ev WHERE n >= 6)
SELECT DISTINCT account, 'LEG-CONTAGEM-VELOC-01' AS rule_id, CAST(start AS TIMESTAMP) AS start, CAST(ts AS TIMESTAMP) AS "end" FROM g WHERE nxt IS NULL OR nxt - ts > INTERVAL 1 DAY"""


@query(_EVENTS_VELOCITY)
def bucketed_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The velocity rule over events stored by account: no exchange of accounts."""
    table = f"bucketed_{uuid.uuid4().hex}"
    e = D.events(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return A.episodes(store.write_bucketed(e, table, store.work_path(spark, "bucketed"), "sender_account", 16, "timestamp"), VELOCITY)


@query(_EVENTS_VELOCITY)
def stream_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The velocity rule as a stream with keyed state over all events, through an idempotent sink; two late marks move the watermark on."""
    from talus.streaming import keyed, sinks

    path = store.work_path(spark, "stream")
    e = D.events(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    e.write.parquet(f"{path}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, keyed.STATE_PROVIDER)
    try:
        for years in (None, 10, 20):
            if years:
                mark = e.agg(F.max("timestamp").alias("t")).select(F.lit("mark").alias("transaction_id"), (F.col("t") + F.make_ym_interval(F.lit(years))).alias("timestamp"), F.lit(0).cast("decimal(18,2)").alias("amount_brl"), F.lit("mark").alias("sender_account"))
                mark.write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
            found = keyed.velocity_episodes(stream, VELOCITY)
            found.writeStream.foreachBatch(sinks.once(f"{path}/out")).outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return sinks.read(spark, f"{path}/out", "account STRING, rule_id STRING, start TIMESTAMP, end TIMESTAMP").drop("batch")


@query(f"""{_DECISION} {_OUT}, dd AS (SELECT o.*, selected_at FROM o JOIN alerts USING (alert_id)), t AS (SELECT alert_id, CASE WHEN level = 'PROPOR_ARQUIVAMENTO' THEN 'ARQUIVAMENTO' WHEN recommendation = 'COMUNICAR' THEN 'COS' ELSE 'ARQUIVAMENTO' END AS kind, level, recommendation, n_verified, selected_at
 FROM dd WHERE level = 'PROPOR_ARQUIVAMENTO' OR NOT (recommendation = 'INCONCLUSIVO' OR recommendation = 'COMUNICAR' AND n_verified = 0))
SELECT alert_id, CASE WHEN kind = 'COS' THEN '# Comunicação de operação suspeita' ELSE '# Arquivamento' END || chr(10) || chr(10) || CASE WHEN level = 'PROPOR_ARQUIVAMENTO' THEN 'Arquivamento proposto pela triagem determinística (rules_version 1): nenhum detector crítico disparado.'
 ELSE 'Recomendação ' || recommendation || ': hipótese Structuring, confiança 0.50, ' || n_verified || ' citação(ões) verificada(s).' END || chr(10) || chr(10) || 'Prazo interno: ' || strftime(selected_at + INTERVAL 5 DAY, '%Y-%m-%d') || '; regulatório: ' || strftime(selected_at + INTERVAL 45 DAY, '%Y-%m-%d') AS text FROM t""")
def dossier_markdown(spark: SparkSession, d: str) -> DataFrame:
    decision = _decision(spark, d).withColumn("rules_version", F.lit(1))
    digit = lambda i: F.conv(F.substring("alert_id", i, 1), 16, 10).cast("int")
    recommendation = F.element_at(F.array(*[F.lit(x) for x in config.RECOMMENDATIONS]), digit(1) % 3 + 1)
    outputs = decision.select("alert_id", F.lit("Structuring").alias("typology"), F.lit(0.5).alias("confidence"), recommendation.alias("recommendation"))
    return workflow.markdown(workflow.dossiers(decision, outputs, decision.select("alert_id", (digit(2) % 2).alias("n_verified"))))


@query("""WITH e AS (SELECT 'U' || user_id AS account, ts, COUNT(*) OVER w AS n, MIN(ts) OVER w AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))
SELECT DISTINCT account, CAST(start AS TIMESTAMP) AS start, CAST(ts AS TIMESTAMP) AS "end", n FROM e WHERE n >= 6""")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The streaming rule's plan on a batch of the same events; tests run it as a stream."""
    from talus.streaming.alerts import velocity_windows

    return velocity_windows(D.events(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp")), VELOCITY)


@query(f"""{_STRATA}, c AS (SELECT holder AS account, MAX(is_laundering) = 1 AS suspicious FROM tx GROUP BY 1), n AS (SELECT suspicious, round_even(COUNT(*) * CASE WHEN suspicious THEN 0.5 ELSE 0.3 END, 0) AS k FROM c GROUP BY 1),
r AS (SELECT account, suspicious, row_number() OVER (PARTITION BY suspicious ORDER BY sha256('20260916|' || account), account) AS p FROM c), dev AS (SELECT account FROM r JOIN n USING (suspicious) WHERE p > k)
SELECT alert_id, stratum, account FROM st JOIN alerts USING (alert_id) JOIN dev USING (account)""")
def development_alerts(spark: SparkSession, d: str) -> DataFrame:
    accounts = sampling.split_accounts(sampling.account_classes(_tx(spark, d), "holder"))
    return sampling.development(_strata(spark, d), _alerts(spark, d), accounts)


@query("""WITH r AS (SELECT event_id, 'a' || event_id AS alert_id, CASE WHEN event_id % 2 = 0 THEN 'triage' ELSE 'sanitizer' END AS node FROM events), b AS (SELECT *, node = 'triage' AND event_id % 4 <> 2 AS good, node = 'triage' AS ran FROM r)
SELECT alert_id, CASE WHEN NOT ran THEN node WHEN NOT good THEN 'human_handoff' WHEN event_id % 3 = 0 THEN 'investigation' ELSE 'dossier' END AS node, CASE WHEN NOT ran THEN 'RECEIVED' WHEN good THEN 'TRIAGED' ELSE 'NEEDS_HUMAN' END AS state,
 CASE WHEN ran AND NOT good THEN 'attempt 3 failed' END AS failure_reason, CASE WHEN NOT ran THEN 0 WHEN good THEN event_id % 3 + 1 ELSE 3 END AS n_events FROM b""")
def node_run(spark: SparkSession, d: str) -> DataFrame:
    """Triage over the alerts that stand before it: three attempts each, of which some succeed at the first, second or third."""
    e = D.read(spark, d, "events").select("event_id", F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("alert_id"), F.col("ts").cast("string").alias("occurred_at"))
    waits = F.col("event_id") % 2 == 0
    records = e.select("alert_id", F.when(waits, F.lit("triage")).otherwise(F.lit("sanitizer")).alias("node"), F.when(waits, F.lit("SANITIZED")).otherwise(F.lit("RECEIVED")).alias("state"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("failure_reason"), "occurred_at")
    fails = (F.col("event_id") % 4 == 2) | (F.col("attempt") <= F.col("event_id") % 3)
    tries = e.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(4))))
    level = F.when(F.col("event_id") % 3 == 0, F.lit("INVESTIGAR")).otherwise(F.lit("PROPOR_ARQUIVAMENTO"))
    outcomes = tries.select("alert_id", "attempt", F.lit("TRIAGED").alias("state"), level.alias("level"), F.when(fails, F.format_string("attempt %d failed", "attempt")).alias("error"), "occurred_at")
    after, events = workflow.node_step(records, "triage", outcomes)
    n = events.groupBy("alert_id").agg(F.count_distinct("event_key").alias("n_events"))
    return after.join(n, "alert_id", "left").fillna(0, ["n_events"]).select("alert_id", "node", "state", "failure_reason", "n_events")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: high-value alerts with their transactions' count and total."""
    tx = _tx(spark, sf_dir).select("transaction_id", "timestamp", "amount_brl", "holder")
    found = A.alerts(tx, [VALUE], "holder")
    totals = A.alert_transactions(found, tx, "holder").groupBy("alert_id").agg(F.count("*").alias("n_tx"), F.sum("amount_brl").alias("total_brl"))
    return found.join(totals, "alert_id")


@query(f"{ATX} SELECT a.alert_id, a.account, a.rule_id, a.start, a.\"end\", a.selected_at, COUNT(*) AS n_tx, SUM(t.amount_brl) AS total_brl FROM alerts a JOIN atx t USING (alert_id) GROUP BY ALL")
def alert_headers(spark: SparkSession, d: str) -> DataFrame:
    return entry(spark, d)


