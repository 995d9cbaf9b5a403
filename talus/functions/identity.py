"""Deterministic ids, hashes and hash order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name: SHA-1 with the version and variant put in."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def iso_time(ts: Column) -> Column:
    """2023-01-10T12:00:00+00:00, with microseconds only if there are any. For times without zone, UTC is written."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def hash_order(seed: int, *parts: Column) -> Column:
    """A key that puts rows in an order which looks random, the same in every run."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often use has it."""
    return F.transform(F.array(value), use)[0]


#: Rounds of the permutation, most steps of a walk back into its range, and those that are tried first.
ROUNDS, STEPS, FEW_STEPS = 4, 200, 6


def permuted(number: Column, digits: int, seed: int) -> Column:
    """The number's place in a keyed permutation of the numbers of so many digits that are not one digit repeated.

    number counts from 0; the first 10^digits - 10 numbers give as many different results,
    in an order that the seed decides. A Feistel network permutes the next even
    power of two; what falls outside is permuted again until it falls inside (a
    cycle walk), which keeps different numbers different.
    """
    size, ones = 10**digits, (10**digits - 1) // 9
    half = -(-(size - 1).bit_length() // 2)
    mask = (1 << half) - 1

    def mixed(turn: Column, right: Column) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), turn.cast("string"), right.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(mask))

    def one_round(x: Column, turn: Column) -> Column:
        right = x.bitwiseAND(F.lit(mask))
        return F.shiftleft(right, half).bitwiseOR(F.shiftright(x, half).bitwiseXOR(mixed(turn, right)))

    def walk(x: Column, steps: int) -> Column:
        return named(x, lambda v: F.when(inside(v), v).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), v, lambda w, _: F.when(inside(w), w).otherwise(once(w)))))

    once = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, one_round)
    inside = lambda x: (x < size) & (x % ones != 0)
    # the number-th one that is not a digit repeated: those are the multiples of 11...1
    start = number + F.floor(number / F.lit(ones - 1)).cast("long") + 1
    # most walks have no step, and nearly all others a few
    found = walk(walk(once(start.cast("long")), FEW_STEPS), STEPS - FEW_STEPS)
    return named(found, lambda x: F.when(inside(x) & (number >= 0) & (number < size - 10), x).otherwise(F.raise_error(F.lit("no number of these digits is left")).cast("long")))
