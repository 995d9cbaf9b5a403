"""Evaluation: percentiles, gates and the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus.config import Baseline
from talus.sources.store import staged


#: Rank error of the bounds between which a percentile is looked for, as a share of the rows.
ACCURACY = 100_000
#: Bounds (one row for each group and share) are broadcast up to so many rows.
BROADCAST_ROWS = 100_000


def percentiles(samples: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, share, linear, nearest: exact percentiles by linear interpolation and by nearest rank.

    Approximate percentiles bound each one from both sides; rows below the lower
    bound are counted, and only rows between the bounds, a few in ``ACCURACY``, are
    ordered, by distinct value.
    """
    by = by or []
    rows = samples.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    edge = lambda p: F.percentile_approx("_v", min(1.0, max(0.0, p)), ACCURACY)
    asked = F.array(*[F.struct(F.lit(p).alias("share"), edge(p - 2 / ACCURACY).alias("lo"), edge(p + 2 / ACCURACY).alias("hi")) for p in shares])
    bounds = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), asked.alias("_asked"))
    bounds = bounds.select(*by, "n", "_min", "_max", F.inline("_asked")).select(
        *by, "n", "share", F.when(F.col("share") <= 2 / ACCURACY, F.col("_min")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("share") >= 1 - 2 / ACCURACY, F.col("_max")).otherwise(F.col("hi")).alias("hi")
    )
    if by:
        small = staged(bounds.withColumnsRenamed({c: f"_{c}" for c in by}))  # groups times shares, as many rows as the result
        if small.count() <= BROADCAST_ROWS:
            small = F.broadcast(small)
        else:  # equal values of a group are counted before they are dealt out, so a large group is few rows if its values repeat; adaptive joins split it else
            rows = rows.groupBy(*by, "_v").agg(F.count("*").alias("_times"))
        condition = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
        joined = rows.join(small, condition).select(*by, "share", "n", "lo", "hi", "_v", (F.col("_times") if "_times" in rows.columns else F.lit(1)).alias("_times"))
    else:  # one row for each share
        known = [F.struct(*[F.lit(r[c]).alias(c) for c in ("share", "n", "lo", "hi")]) for r in bounds.collect()]
        each = F.inline(F.array(*known) if known else F.from_json(F.lit("[]"), "array<struct<share: double, n: bigint, lo: double, hi: double>>"))
        joined = rows.select("_v", F.lit(1).alias("_times"), each)
    zone = F.when(F.col("_v") < F.col("lo"), 0).when(F.col("_v") > F.col("hi"), 2).otherwise(1)
    inside = F.when(zone == 1, F.col("_v"))
    counts = joined.groupBy(*by, "share", "n", zone.alias("_zone"), inside.alias("_inside")).agg(F.sum("_times").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    # of the rows outside only the nearest may be asked for: interpolation needs one rank more
    counts = counts.withColumn("_v", F.when(F.col("_zone") == 0, F.col("_most")).otherwise(F.col("_least")))
    upto = F.sum("_c").over(W.partitionBy(*by, "share").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto)
    at = (F.col("n") - 1) * F.col("share")
    value_at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))  # noqa: E731  the value of this 1-based rank
    got = placed.groupBy(*by, "share").agg(value_at(F.floor(at) + 1).alias("_low"), value_at(F.ceil(at) + 1).alias("_high"), value_at(F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("share")))).alias("nearest"), F.max("n").alias("n"))
    rest = at - F.floor(at)
    return got.select(*by, "share", (F.col("_low") + (F.col("_high") - F.col("_low")) * rest).alias("linear"), "nearest")


def latency_summary(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, p50 and p95 by linear interpolation, p95 by nearest rank."""
    by = by or []
    found = percentiles(samples, value, [0.5, 0.95], by)
    of = lambda p, c: F.max(F.when(F.col("share") == p, F.col(c)))
    wide = found.groupBy(*by).agg(of(0.5, "linear").alias("p50"), of(0.95, "linear").alias("p95"), of(0.95, "nearest").alias("p95_nearest"))
    base = samples.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    if not by:
        one = wide.first() or (None, None, None)
        return base.select("n", "mean", *[F.lit(v).cast("double").alias(c) for v, c in zip(one, ("p50", "p95", "p95_nearest"), strict=True)])
    side = wide.withColumnsRenamed({c: f"_{c}" for c in by})
    return base.join(side, reduce(lambda x, y: x & y, [base[c].eqNullSafe(side[f"_{c}"]) for c in by]), "left").select(*by, "n", "mean", "p50", "p95", "p95_nearest")


def _gate(df: DataFrame, name: str, value: Column, passed: Column, target: str) -> DataFrame:
    status = F.when(value.isNull(), F.lit("não medida")).when(passed, F.lit("aprovada")).otherwise(F.lit("reprovada"))
    return df.select(F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(target).alias("target"), status.alias("status"))


def gates(latency: DataFrame, chain: DataFrame, golden: DataFrame, review: DataFrame, calls: DataFrame, records: DataFrame, leaks: DataFrame, base: Baseline = Baseline()) -> DataFrame:
    """gate, value, target, status of all nine gates, each one row of aggregates.

    latency: latency_ms; chain: valid; golden: is_suspicious, level, was_alert;
    review: n_proposed, n_verified; calls: alert_id, tokens; records: decided_at,
    prazo_interno; leaks: n.
    """
    speed = latency.agg((F.lit(base.manual_minutes) / (F.avg("latency_ms") / 60_000 + base.review_minutes)).alias("v"))
    p95 = percentiles(latency, "latency_ms", [0.95]).agg(F.max("linear").alias("v"))
    valid = chain.agg(F.bool_and("valid").cast("double").alias("v"))
    recall = golden.where("is_suspicious").agg(F.avg((F.col("level") == "INVESTIGAR").cast("double")).alias("v"))
    false_rate = golden.agg(F.try_divide(F.count_if(~F.col("is_suspicious") & (F.col("level") == "INVESTIGAR")).cast("double"), F.count_if(~F.col("is_suspicious"))).alias("kept")).select((1 - F.col("kept")).alias("v"))
    grounding = review.agg(F.try_divide(F.sum("n_verified").cast("double"), F.sum("n_proposed")).alias("v"))
    tokens = percentiles(calls, "tokens", [0.95]).agg(F.max("linear").alias("v"))
    in_time = records.agg(F.avg((F.col("decided_at") <= F.col("prazo_interno")).cast("double")).alias("v"))
    private = leaks.agg(F.sum("n").cast("double").alias("v"))
    v = F.col("v")
    return reduce(
        DataFrame.unionByName,
        [
            _gate(speed, "velocidade", v, v >= base.least_speedup, f">= {base.least_speedup}"), _gate(p95, "latencia_p95_ms", v, v < base.most_p95_ms, f"< {base.most_p95_ms}"),
            _gate(valid, "auditoria", v, v == 1, "= 1"), _gate(recall, "recall", v, v >= 0.95, ">= 0.95"), _gate(false_rate, "reducao_falso_positivo", v, v >= 0.3, ">= 0.3"),
            _gate(grounding, "grounding", v, v >= 1.0, ">= 1.0"), _gate(tokens, "tokens_p95", v, v <= 2000, "<= 2000"), _gate(in_time, "prazo_interno", v, v >= 1.0, ">= 1.0"), _gate(private, "privacidade", v, v == 0, "= 0"),
        ],
    )


def report(gate_rows: DataFrame, versions: dict[str, str]) -> DataFrame:
    """One row: versions, the gates as an array, and whether all measured ones passed."""
    item = F.array_sort(F.collect_list(F.struct("gate", "value", "target", "status")))
    return gate_rows.agg(item.alias("gates"), (F.count_if(F.col("status") == "reprovada") == 0).alias("passed")).select(*[F.lit(v).alias(k) for k, v in versions.items()], "gates", "passed")


def write_report(row: DataFrame, path: str) -> None:
    """The report as JSON and as a Markdown table."""
    row.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    lines = F.transform("gates", lambda g: F.concat_ws(" | ", g["gate"], F.coalesce(F.round(g["value"], 4).cast("string"), F.lit("-")), g["target"], g["status"]))
    row.select(F.concat(F.lit("gate | value | target | status\n-|-|-|-\n"), F.array_join(lines, "\n")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
