"""Check digits of documents and accounts, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions.identity import named


def digits(text: Column) -> Column:
    """The text without anything but digits."""
    return F.regexp_replace(text, r"[^0-9]", "")


def _check_digit(text: Column, weights: list[int]) -> Column:
    numbers = [F.coalesce(F.substring(text, i, 1).try_cast("int"), F.lit(0)) * w for i, w in enumerate(weights, 1)]
    return (11 - reduce(Column.__add__, numbers) % 11) % 11 % 10


def check_digit(text: Column, weights: list[int]) -> Column:
    """Modulo 11 over the weighted digits: 11 minus the remainder, 0 for remainders below 2."""
    return named(text, lambda t: F.when(t.isNotNull(), _check_digit(t, weights)))


_CPF = [list(range(10, 1, -1)), list(range(11, 1, -1))]
_CNPJ = [[5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]]


def _with_digit(base: Column, weights: list[int]) -> Column:
    return named(base, lambda b: F.concat(b, _check_digit(b, weights).cast("string")))


def _with_digits(base: Column, weights: list[list[int]]) -> Column:
    return reduce(_with_digit, weights, base)


def cpf(base: Column) -> Column:
    """Nine digits with their two check digits."""
    return _with_digits(base, _CPF)


def cnpj(base: Column) -> Column:
    """Twelve digits with their two check digits."""
    return _with_digits(base, _CNPJ)


def _valid_cpf(d: Column) -> Column:
    return F.coalesce((F.length(d) == 11) & ~d.rlike(r"^(\d)\1{10}$") & (d == cpf(F.substring(d, 1, 9))), F.lit(False))


def _valid_cnpj(d: Column) -> Column:
    return F.coalesce((F.length(d) == 14) & ~d.rlike(r"^(\d)\1{13}$") & (d == cnpj(F.substring(d, 1, 12))), F.lit(False))


def valid_cpf(text: Column) -> Column:
    return named(digits(text), _valid_cpf)


def valid_cnpj(text: Column) -> Column:
    return named(digits(text), _valid_cnpj)


def valid_document(text: Column) -> Column:
    """CPF if it has 11 digits, else CNPJ."""
    return named(digits(text), lambda d: F.when(F.length(d) == 11, _valid_cpf(d)).otherwise(_valid_cnpj(d)))


def account_number(text: Column) -> Column:
    """At most 11 digits without a leading zero, as branch-account-check digit; null if the text is none."""
    padded = F.lpad(text, 11, "0")
    digit = check_digit(F.reverse(padded), [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4])
    formatted = F.concat_ws("-", F.substring(padded, 1, 4), F.substring(padded, 5, 7), digit.cast("string"))
    return F.when(text.rlike(r"^[1-9][0-9]{0,10}$"), formatted)
