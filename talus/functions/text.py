"""Text expressions: normal form, tokens, roman numerals, personal data."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of personal data.
CPF_PATTERN = r"\b(\d{3}\.?\d{3}\.?\d{3}-?\d{2})\b"
CNPJ_PATTERN = r"\b(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})\b"
ACCOUNT_PATTERN = r"\b([0-9]{10,20})\b"
PII = {"CPF": CPF_PATTERN, "CNPJ": CNPJ_PATTERN, "ACCOUNT": ACCOUNT_PATTERN}


@F.pandas_udf(StringType())  # type: ignore[call-overload]
def nfc(text: pd.Series) -> pd.Series:
    """Composed form; Spark has no function for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised(text: Column) -> Column:
    return collapsed(nfc(text))


def text_sha256(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def words(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), F.lower)


def roman(text: Column) -> Column:
    """A roman numeral's number: a sign counts negative before a greater one."""
    value = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    numbers = F.transform(F.reverse(F.split(text, "")), lambda c: F.coalesce(F.try_element_at(value, c), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    return F.aggregate(
        numbers,
        start,
        lambda acc, v: F.struct((acc["total"] + F.when(v < acc["most"], -v).otherwise(v)).alias("total"), F.greatest(acc["most"], v).alias("most")),
        lambda acc: acc["total"],
    )


def pii_counts(text: Column) -> list[Column]:
    """Matches of each pattern."""
    return [F.size(F.regexp_extract_all(text, F.lit(p), F.lit(1))).cast("long").alias(f"n_{k.lower()}") for k, p in PII.items()]


def redacted(text: Column) -> Column:
    """The text with personal data replaced by its kind."""
    for kind, pattern in PII.items():
        text = F.regexp_replace(text, pattern, f"<{kind}>")
    return text
