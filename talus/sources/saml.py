"""The labelled transaction file: header check, scan, validation, profile, and its projection to transactions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus import config
from talus.functions.checkdigits import account_number

# Columns of the file; the last two have an alternative name each.
FIXED = ["Time", "Date", "Sender_account", "Receiver_account", "Amount", "Payment_currency", "Received_currency", "Sender_bank_location", "Receiver_bank_location", "Payment_type"]
ALTERNATIVES = {"flag": ("Is_laundering", "Is_Suspicious"), "label": ("Laundering_type", "Type")}


@dataclass(frozen=True)
class Header:
    names: list[str]
    flag: str
    label: str


def validate_header(names: list[str]) -> Header:
    """The header's roles, or one error with all its problems."""
    names = [n.strip().lstrip("\ufeff") for n in names]
    problems = [f"missing column {c}" for c in FIXED if c not in names]
    problems += [f"column given twice {c}" for c in sorted({c for c in names if names.count(c) > 1})]
    roles = {}
    for role, options in ALTERNATIVES.items():
        have = [o for o in options if o in names]
        if len(have) != 1:
            problems.append(f"exactly one of {' and '.join(options)} is needed")
        else:
            roles[role] = have[0]
    allowed = {*FIXED, *(o for pair in ALTERNATIVES.values() for o in pair)}
    problems += [f"unknown column {c}" for c in names if c not in allowed]
    if problems:
        raise ValueError("; ".join(problems))
    return Header(names, roles["flag"], roles["label"])


def read_header(spark: SparkSession, path: str) -> Header:
    """The first line alone is read."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    return validate_header(first[0][0].split(","))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under their own names, plus flag, label and _corrupt (a row with a wrong number of cells)."""
    header = read_header(spark, path)
    schema = ", ".join(f"`{n}` STRING" for n in header.names) + ", _corrupt STRING"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return rows.withColumnsRenamed({header.flag: "flag", header.label: "label"})


def problems(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with ``suspicious`` and ``violations``: unknown label, flag not 0 or 1, flag against label, wrong cell count."""
    known = F.broadcast(labels.select(F.col("label").alias("_label"), "suspicious"))  # 28 labels
    joined = rows.join(known, F.col("label") == F.col("_label"), "left").drop("_label")
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in rows.columns else F.lit(False)
    flags = F.col("flag").isin("0", "1")
    checks = F.array(
        F.when(corrupt, F.lit("wrong number of cells")),
        F.when(F.col("suspicious").isNull(), F.lit("unknown label")),
        F.when(~F.coalesce(flags, F.lit(False)), F.lit("flag is neither 0 nor 1")),
        F.when(flags & (F.col("suspicious") != (F.col("flag") == "1")), F.lit("flag does not fit label")),
    )
    return joined.withColumn("violations", F.filter(checks, lambda v: v.isNotNull()))


def strict(rows: DataFrame) -> DataFrame:
    """Rows with violations end the job."""
    bad = F.raise_error(F.concat(F.lit("invalid row: "), F.array_join("violations", "; "))).cast("array<string>")
    return rows.withColumn("violations", F.when(F.size("violations") > 0, bad).otherwise(F.col("violations")))


def write_observed(spark: SparkSession, path: str, out: str, make: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Writes the file's valid rows (or make(rows) of them) in one scan, and returns the rows of each label, counted on the way.

    The first bad row is observed in the same pass, by its file and the block that it
    was read in. If there is one, its line is looked up by a second read of that
    file alone, and the error names it; out is then no store and is to be thrown away.
    """
    rows = problems(scan(spark, path).withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}), config.labels(spark))
    bad = F.size("violations") > 0
    labels = [r["label"] for r in config.labels(spark).collect()]  # 28
    counts = [F.count_if((F.col("label") == x) & ~bad).alias(f"n{i}") for i, x in enumerate(labels)]
    seen = Observation()
    watched = rows.observe(seen, F.min(F.when(bad, F.struct("_file", "_block"))).alias("first"), F.count_if(bad).alias("bad"), *counts)
    good = watched.where(~bad).drop("_file", "_block")
    (make(good) if make else good.drop("violations")).write.mode("overwrite").parquet(out)
    got = seen.get
    if got["bad"]:
        line, said = _first_bad_line(rows, got["first"]["_file"], got["first"]["_block"])
        raise ValueError(f"{got['first']['_file']}, line {line}: {said} ({got['bad']} bad rows in all)")
    return {x: got[f"n{i}"] for i, x in enumerate(labels) if got[f"n{i}"]}


def _first_bad_line(rows: DataFrame, file: str, block: int) -> tuple[int, str]:
    """Number (the header is line 1) and violations of the first bad row of a block: rows of the file's earlier blocks are counted, those of its own numbered."""
    own = rows.where(F.col("_file") == file)
    before = own.where(F.col("_block") < block).count()
    at = own.withColumn("_at", F.monotonically_increasing_id()).where(F.col("_block") == block)
    first = at.agg(F.min("_at").alias("from"), F.min_by(F.struct("_at", "violations"), F.when(F.size("violations") > 0, F.col("_at"))).alias("bad")).first()
    return before + first["bad"]["_at"] - first["from"] + 2, "; ".join(first["bad"]["violations"])


def profile(rows: DataFrame) -> DataFrame:
    """label, n, suspicious of each label, in one pass."""
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.max("suspicious").alias("suspicious"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if("suspicious").alias("n_suspicious"), F.count_if(~F.col("suspicious")).alias("n_normal"))


def convert(amount: Column, rate: Column) -> Column:
    """Reais, half up to cents; null if there is no rate or the result is not positive."""
    reais = F.round(amount.try_cast("decimal(18,2)") * rate, 2).cast("decimal(18,2)")
    return F.when(reais > 0, reais)


def with_position(rows: DataFrame) -> DataFrame:
    """rows (a scan) with ``position``, the 1-based place in the file.

    A row's number within its input partition is in the lower 33 bits of
    ``monotonically_increasing_id``; partitions follow each other in the file, so
    the rows before each one come from a running sum over one count a partition.
    """
    numbered = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as input partitions
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(offsets, "_part").withColumn("position", F.col("_before") + inside + 1).drop("_at", "_part", "_before")


def transactions(rows: DataFrame) -> DataFrame:
    """Validated rows (with position) as transactions; what cannot be mapped ends up in ``violations``.

    All dimensions are fixed tables of at most 28 rows, so they are broadcast.
    """
    spark = rows.sparkSession
    fx = config.fx(spark)
    side = lambda df, key, **names: F.broadcast(df.select(F.col("label").alias(key), *[F.col(b).alias(a) for a, b in names.items()]))
    out = (
        rows.join(side(fx, "Payment_currency", currency_sent="iso", rate="rate"), "Payment_currency", "left")
        .join(side(fx, "Received_currency", currency_received="iso"), "Received_currency", "left")
        .join(side(config.payment_types(spark), "Payment_type", payment="payment_type"), "Payment_type", "left")
        .join(side(config.countries(spark), "Sender_bank_location", sender_location="country"), "Sender_bank_location", "left")
        .join(side(config.countries(spark), "Receiver_bank_location", receiver_location="country"), "Receiver_bank_location", "left")
    )
    columns = {
        "transaction_id": F.format_string("tx-%08d", "position"),
        "timestamp": F.try_to_timestamp(F.concat_ws(" ", "Date", "Time"), F.lit("yyyy-MM-dd HH:mm:ss")),
        "amount_brl": convert(F.col("Amount"), F.col("rate")),
        "payment_type": F.col("payment"),
        "sender_account": account_number(F.col("Sender_account")),
        "receiver_account": account_number(F.col("Receiver_account")),
        "sender_location": F.col("sender_location"),
        "receiver_location": F.col("receiver_location"),
        "currency_sent": F.col("currency_sent"),
        "currency_received": F.col("currency_received"),
        "laundering_type": F.col("label"),
        "is_laundering": F.col("flag").try_cast("int"),
    }
    missing = F.filter(F.array(*[F.when(c.isNull(), F.lit(f"no {n}")) for n, c in columns.items()]), lambda v: v.isNotNull())
    before = F.col("violations") if "violations" in rows.columns else F.array().cast("array<string>")
    return out.select(*[c.alias(n) for n, c in columns.items()], F.concat(before, missing).alias("violations"))
