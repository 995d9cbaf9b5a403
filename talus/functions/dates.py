"""Deadlines and business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deadlines(selected_at: Column) -> list[Column]:
    """Internal deadline after 5 days, regulatory one after 45."""
    return [(selected_at + F.expr("INTERVAL 5 DAYS")).alias("prazo_interno"), (selected_at + F.expr("INTERVAL 45 DAYS")).alias("prazo_regulatorio")]


def at_risk(deadline: Column, now: Column, days: int = 2) -> Column:
    return (deadline - F.expr(f"INTERVAL {days} DAYS")) <= now


def brasilia_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "-03:00"))


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def next_business_day(rows: DataFrame, day_col: str, calendar: DataFrame) -> DataFrame:
    """rows with next_business; a day outside the calendar is an error. The calendar has a few thousand days."""
    side = F.broadcast(calendar.select(F.col("day").alias("_day"), "next_business"))
    found = rows.join(side, rows[day_col] == F.col("_day"), "left").drop("_day")
    missing = F.raise_error(F.concat(F.lit("no business day known after "), F.col(day_col).cast("string"))).cast("date")
    return found.withColumn("next_business", F.when(F.col(day_col).isNull() | F.col("next_business").isNotNull(), F.col("next_business")).otherwise(missing))


def duration_days(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)
