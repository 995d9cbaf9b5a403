"""Versioned rules and dimensions: fixed values that results depend on, as dataclasses and small DataFrames."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, fields, is_dataclass
from decimal import Decimal, InvalidOperation
from pathlib import Path
from typing import Any, Literal, TypeVar, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession

# Currency label, ISO code, reais for one unit.
FX = [
    ("UK pounds", "GBP", "6.20"),
    ("Euro", "EUR", "5.40"),
    ("US dollar", "USD", "5.00"),
    ("Swiss franc", "CHF", "5.60"),
    ("Dirham", "AED", "1.36"),
    ("Moroccan dirham", "MAD", "0.50"),
    ("Mexican Peso", "MXN", "0.29"),
    ("Turkish lira", "TRY", "0.19"),
    ("Indian rupee", "INR", "0.060"),
    ("Albanian lek", "ALL", "0.053"),
    ("Yen", "JPY", "0.035"),
    ("Pakistani rupee", "PKR", "0.018"),
    ("Naira", "NGN", "0.0065"),
]
# Payment label of the source, payment type.
PAYMENT_TYPES = [
    ("Cash Deposit", "ESPECIE_DEPOSITO"),
    ("Cash Withdrawal", "ESPECIE_SAQUE"),
    ("Cross-border", "TRANSFERENCIA_INTERNACIONAL"),
    ("Debit card", "CARTAO"),
    ("Credit card", "CARTAO"),
    ("ACH", "PIX"),
    ("Cheque", "TED"),
]
# Country label of the source, ISO code; the source's home country stands for Brazil.
COUNTRIES = [
    ("UK", "BR"), ("Germany", "DE"), ("France", "FR"), ("Italy", "IT"), ("Spain", "ES"), ("Netherlands", "NL"), ("Austria", "AT"), ("Switzerland", "CH"), ("Turkey", "TR"),
    ("Albania", "AL"), ("USA", "US"), ("Mexico", "MX"), ("Japan", "JP"), ("India", "IN"), ("Pakistan", "PK"), ("UAE", "AE"), ("Morocco", "MA"), ("Nigeria", "NG"),
]
# Label of the source, typology, incisos, critical.
SUSPICIOUS = [
    ("Deposit-Send", "Deposit-Send", ["IX"], True),
    ("Structuring", "Structuring", ["I", "IV"], True),
    ("Smurfing", "Smurfing", ["I", "IV"], True),
    ("Layered_Fan_In", "Layered Fan-In", ["IV"], True),
    ("Layered_Fan_Out", "Layered Fan-Out", ["IV"], True),
    ("Stacked Bipartite", "Stacked Bipartite", ["IV"], True),
    ("Fan_Out", "Fan-Out", ["IV"], False),
    ("Fan_In", "Fan-In", ["IV"], False),
    ("Cycle", "Cycle", ["IV"], False),
    ("Bipartite", "Bipartite", ["IV"], False),
    ("Scatter-Gather", "Scatter-Gather", ["IV"], False),
    ("Gather-Scatter", "Gather-Scatter", ["IV"], False),
    ("Over-Invoicing", "Over-Invoicing", ["X"], False),
    ("Cash_Withdrawal", "Cash Withdrawal", ["I"], False),
    ("Single_large", "Single Large Transaction", ["IV"], False),
    ("Behavioural_Change_1", "Behavioural Change 1", ["IV"], False),
    ("Behavioural_Change_2", "Behavioural Change 2", ["IV"], False),
]
# The typology with curated passages, and why they apply.
PREFERRED_REFS = {"Structuring": ["CC4001/art1/i1/d", "CC4001/art1/i1/e", "CC4001/art1/i1/k", "CC4001/art1/i4"]}
APPLICABILITY = {
    "Structuring": "Fragmentação de depósitos, saques ou movimentações em espécie, ou de operações em conta, para dissimular o valor total ou driblar limites de comunicação "
    "de operações (CC 4.001/2020, art. 1º, I, alíneas d, e, k, e IV)."
}
# Labels of normal behaviour.
NORMAL = [
    "Normal_Small_Fan_Out", "Normal_Fan_Out", "Normal_Fan_In", "Normal_Group", "Normal_Cash_Withdrawal", "Normal_Cash_Deposits", "Normal_Periodical", "Normal_Plus_Mutual",
    "Normal_Mutual", "Normal_Foward", "Normal_single_large",
]
# States of an alert, and the edges of its workflow with message type and schema.
STATES = ["RECEIVED", "SANITIZED", "TRIAGED", "INVESTIGATING", "RESEARCHING", "REVIEWING", "DRAFT_READY", "SUBMITTED", "APPROVED", "RETURNED", "NEEDS_HUMAN"]
NODES = ["sanitizer", "triage", "investigation", "retrieval", "selection", "reviewer", "dossier"]
EDGES = [
    ("sanitizer", "triage", "TASK", "DT-04.v1"),
    ("triage", "dossier", "TASK", "DT-06.v1"),
    ("triage", "investigation", "TASK", "DT-04+DT-06.v1"),
    ("investigation", "retrieval", "RESULT", "DT-16+DT-07.v1"),
    ("retrieval", "selection", "RESULT", "retrieved_chunk_ids.v1"),
    ("selection", "reviewer", "RESULT", "DT-09[].v1"),
    ("reviewer", "dossier", "RESULT", "DT-10.v1"),
] + [(node, "human_handoff", "ERROR", "error.v1") for node in NODES]

TYPOLOGIES = [x[1] for x in SUSPICIOUS] + ["NENHUMA"]
RECOMMENDATIONS = ["COMUNICAR", "ARQUIVAR", "INCONCLUSIVO"]
VALUE_RULE, VELOCITY_RULE = "LEG-VALOR-ELEVADO-01", "LEG-CONTAGEM-VELOC-01"
#: Namespace of the alert ids.
ALERT_NAMESPACE = "6f1b1d8a-9b3e-4c7a-8f2e-2a9c7d4b5e10"


@dataclass(frozen=True)
class ValueRule:
    rule_id: str = VALUE_RULE
    least_brl: Decimal = Decimal("100000.00")
    days: int = 7


@dataclass(frozen=True)
class VelocityRule:
    rule_id: str = VELOCITY_RULE
    least_count: int = 6
    days: int = 30


@dataclass(frozen=True)
class TriageRules:
    version: int = 1
    below_brl: Decimal = Decimal("10000.00")
    fragment_count: int = 3
    fragment_days: int = 7
    layer_depth: int = 2
    layer_counterparties: int = 3
    layer_days: int = 30
    abroad_days: int = 7
    lists: tuple[str, ...] = ("pep", "ceis", "cnep")


@dataclass(frozen=True)
class SplitRules:
    seed: int = 20260916
    suspicious_share: float = 0.5
    normal_share: float = 0.3
    per_critical: int = 30
    per_other: int = 10
    normals: int = 210
    normal_accounts: int = 8000


@dataclass(frozen=True)
class Baseline:
    manual_minutes: int = 120
    review_minutes: int = 15
    least_speedup: float = 3.0
    most_p95_ms: int = 20_000
    min_score: float = 0.35


@dataclass(frozen=True)
class Approval:
    """Who accepted a file's values, when, and how firmly."""

    by: str
    on: dt.date
    status: Literal["provisional", "final"]
    reference: str


@dataclass(frozen=True)
class AlertConfig:
    version: int
    approval: Approval
    value: ValueRule
    velocity: VelocityRule


@dataclass(frozen=True)
class Currency:
    label: str
    iso: str
    rate: Decimal


@dataclass(frozen=True)
class FxConfig:
    version: int
    approval: Approval
    currencies: tuple[Currency, ...]


@dataclass(frozen=True)
class HolidayConfig:
    first: int
    last: int
    days: tuple[dt.date, ...]


class ConfigError(ValueError):
    """A configuration file that is missing, is no JSON object or does not fit its schema."""


T = TypeVar("T")


def _read(value: Any, kind: Any, at: str) -> Any:
    """value as the type asks; at: where it stands, for the error."""
    if is_dataclass(kind):
        if not isinstance(value, dict):
            raise ConfigError(f"{at}: an object is expected")
        types = get_type_hints(kind)
        needed = {f.name for f in fields(kind)}
        if problems := [f"unknown key {at}.{k}" for k in sorted(set(value) - needed)] + [f"missing key {at}.{k}" for k in sorted(needed - set(value))]:
            raise ConfigError("; ".join(problems))
        return kind(**{k: _read(v, types[k], f"{at}.{k}") for k, v in value.items()})
    if get_origin(kind) is tuple:
        if not isinstance(value, list):
            raise ConfigError(f"{at}: a list is expected")
        return tuple(_read(v, get_args(kind)[0], f"{at}[{i}]") for i, v in enumerate(value))
    if get_origin(kind) is Literal:
        if value not in get_args(kind):
            raise ConfigError(f"{at}: one of {', '.join(map(str, get_args(kind)))} is expected")
        return value
    if kind in (Decimal, dt.date):
        if not isinstance(value, str):
            raise ConfigError(f"{at}: a {'decimal' if kind is Decimal else 'date'} is given as text")
        try:
            return Decimal(value) if kind is Decimal else dt.date.fromisoformat(value)
        except (InvalidOperation, ValueError) as e:
            raise ConfigError(f"{at}: {value!r} is no {'decimal' if kind is Decimal else 'date'}") from e
    if type(value) is not kind or kind is str and not value.strip():
        raise ConfigError(f"{at}: {'text' if kind is str else kind.__name__} is expected")
    return value


def load_config(path: str | Path, kind: type[T]) -> T:
    """A configuration of nested dataclasses from a JSON file. Unknown and missing keys and wrong types are errors that name their place."""
    name = Path(path).name
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError(f"{name}: cannot be read ({e})") from e
    except json.JSONDecodeError as e:
        raise ConfigError(f"{name}: no valid JSON ({e})") from e
    return _read(given, kind, name)


def load_rules(path: str | Path, kind: type[T]) -> T:
    """A rules dataclass without nested parts; the same checks."""
    return load_config(path, kind)


def fx(spark: SparkSession, given: FxConfig | None = None) -> DataFrame:
    """label, iso, rate: the fixed values, or those of a configuration."""
    rows = [(c.label, c.iso, c.rate) for c in given.currencies] if given else [(a, b, Decimal(c)) for a, b, c in FX]
    return spark.createDataFrame(rows, "label STRING, iso STRING, rate DECIMAL(18,6)")


def payment_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAYMENT_TYPES, "label STRING, payment_type STRING")


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUNTRIES, "label STRING, country STRING")


def labels(spark: SparkSession) -> DataFrame:
    rows = [(a, True, c, b, i) for a, b, i, c in SUSPICIOUS] + [(a, False, False, None, None) for a in NORMAL]
    return spark.createDataFrame(rows, "label STRING, suspicious BOOLEAN, critical BOOLEAN, typology STRING, incisos ARRAY<STRING>")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "from_node STRING, to_node STRING, message_type STRING, schema STRING")


def label_coverage(suspicious: set[str], normal: set[str], seen: set[str]) -> list[str]:
    """Problems of a label universe: labels on both sides, unknown ones, ones that never occur."""
    both, known = suspicious & normal, suspicious | normal
    return [f"on both sides: {x}" for x in sorted(both)] + [f"unknown: {x}" for x in sorted(seen - known)] + [f"missing: {x}" for x in sorted(known - seen)]


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday, from the golden number, the century's corrections and the week day."""
    golden, century = year % 19, year // 100
    moon = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    sunday = (32 + 2 * (century % 4) + 2 * (year % 100 // 4) - moon - year % 100 % 4) % 7
    late = (golden + 11 * moon + 22 * sunday) // 451
    month, day = divmod(moon + sunday - 7 * late + 114, 31)
    return dt.date(year, month, day + 1)


def holidays(first: int = 2022, last: int = 2027) -> list[dt.date]:
    """National holidays and the market's Carnival and Corpus Christi; 20 November from 2024."""
    days = []
    for y in range(first, last + 1):
        fixed = [(1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (12, 25)] + [(11, 20)] * (y >= 2024)
        days += [dt.date(y, m, d) for m, d in fixed] + [easter(y) + dt.timedelta(n) for n in (-48, -47, 60)]
    return sorted(days)


def business_calendar(spark: SparkSession, first: int = 2022, last: int = 2027) -> DataFrame:
    """day, is_business, next_business (the first business day after the day, null at the calendar's end)."""
    closed = set(holidays(first, last))
    days = [dt.date(first, 1, 1) + dt.timedelta(n) for n in range((dt.date(last, 12, 31) - dt.date(first, 1, 1)).days + 1)]
    rows, ahead = [], None
    for day in reversed(days):
        business = day.weekday() < 5 and day not in closed
        rows.append((day, business, ahead))
        ahead = day if business else ahead
    return spark.createDataFrame(rows[::-1], "day DATE, is_business BOOLEAN, next_business DATE")
