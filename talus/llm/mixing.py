"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture's bytes. Its mean repetition
rate is its target divided by what it has. Each document draws its number of
copies from a Poisson distribution of that mean, by inverting the distribution
at a uniform number that a hash of the seed and the document gives: runs agree
whatever the partitioning. Copies are then dealt out over the whole cluster by
a second hash and sorted by it within each partition, a global shuffle.

Only per-source sums are aggregated, with partial sums before the shuffle. The
sums are joined back by broadcast as long as there are few sources (a checked
count), so that a source with a third of all rows stays spread out.

Defined results: a null source is a source of its own; a null or empty text
counts one byte, as every text has one more for its end; a null id takes its
text's hash; repeated rows draw the same number; a source without a target has
weight 0 and goes; an empty table gives no rows; in ``mix``, columns called
``copy`` or ``shuffle_key`` are replaced, all others stay; ``replicated`` keeps all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.shared import checked_broadcast, stored, with_row


@dataclass(frozen=True)
class MixingRules:
    seed: int = 20
    #: The mixture's bytes as a multiple of the input's.
    epochs: float = 1.0
    #: Without given weights, a source's weight is its bytes to this power.
    temperature: float = 0.5
    #: A larger mean is split into so many equal parts that each is below this; the draws add up.
    part_mean: float = 32.0
    #: Counts up to this are in the table of the distribution; P(more) is below 1e-16 at part_mean.
    most: int = 120


def rates(docs: DataFrame, weights: DataFrame | None, rules: MixingRules) -> DataFrame:
    """source, own bytes, mean repetition rate, number of parts, distribution function of one part."""
    sums = docs.groupBy("source").agg(F.sum(_bytes()).cast("double").alias("own"))
    if weights is None:
        sums = sums.withColumn("weight", F.pow("own", F.lit(rules.temperature)))
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double"))
        sums = sums.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").fillna(0.0, ["weight"])
    sums = stored(sums)
    all_own, all_weight = sums.agg(F.sum("own"), F.sum("weight")).first()
    rate = F.lit(all_own) * rules.epochs * F.col("weight") / F.lit(all_weight) / F.col("own") if all_weight else F.lit(0.0)
    rated = (
        sums.withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / rules.part_mean)).cast("int"))
        .withColumn("mean", F.col("rate") / F.col("parts"))
    )
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(rules.most)),
        start,
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k)).alias("cdf")),
        lambda acc: acc["cdf"],
    )
    return rated.select("source", "own", "rate", "parts", grown.alias("cdf"))


def _bytes():
    return F.coalesce(F.octet_length("text"), F.lit(0)) + 1


def _hex(*parts, digits: int):
    """The first hex digits of an MD5 over the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("long")


def _copies(docs: DataFrame, weights: DataFrame | None, rules: MixingRules) -> DataFrame:
    """row (docs' columns), copy (from 1) and shuffle_key, each document as often as drawn, dealt out and sorted by the key."""
    source_rates = stored(rates(docs, weights, rules))
    side = source_rates.select(F.col("source").alias("rated"), "parts", "cdf")
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("null"))
    uniform = lambda part: _hex(F.lit(str(rules.seed)), F.col("key"), part.cast("string"), digits=13) / F.lit(float(2**52))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda acc, part: acc + F.size(F.filter(F.col("cdf"), lambda c: c <= uniform(part))),
    )
    return (
        with_row(docs, key=key, own=F.col("source"))
        .join(checked_broadcast(side, source_rates.count()), F.col("own").eqNullSafe(F.col("rated")))
        .withColumn("n", drawn)
        .where("n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .select("row", "copy", _hex(F.lit(str(rules.seed)), F.lit("order"), F.col("key"), F.col("copy").cast("string"), digits=15).alias("shuffle_key"))
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key", "copy")
    )


ADDED = ("copy", "shuffle_key")


def mix(docs: DataFrame, weights: DataFrame | None = None, rules: MixingRules = MixingRules()) -> DataFrame:
    """All columns of docs, ``copy`` and ``shuffle_key`` (columns of these names are replaced); each document as often as drawn."""
    found = _copies(docs, weights, rules)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ADDED], *ADDED)


def replicated(docs: DataFrame, weights: DataFrame | None = None, rules: MixingRules = MixingRules()) -> DataFrame:
    """The rows of docs, each as often as drawn, shuffled; docs' own columns as they are."""
    return _copies(docs, weights, rules).select("row.*")


ORACLE_SQL = """
WITH sums AS (
  SELECT source, SUM(COALESCE(strlen(text), 0) + 1)::DOUBLE AS own FROM documents GROUP BY source
), weighted AS (
  SELECT *, pow(own, 0.5) AS weight FROM sums
), rated AS (
  SELECT source, (SELECT SUM(own) FROM weighted) * weight / (SELECT SUM(weight) FROM weighted) / own AS rate FROM weighted
), parts AS (
  SELECT source, greatest(1, ceil(rate / 32.0))::INT AS parts, rate / greatest(1, ceil(rate / 32.0)) AS mean FROM rated
), pmf AS (
  SELECT source, parts, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM parts, range(0, 121) r(k)
), cdf AS (
  SELECT source, parts, k, SUM(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf
), draws AS (
  SELECT d.doc_id, d.source, d.text, p.source AS s, g.part,
         ('0x' || substr(md5('20|' || d.doc_id || '|' || g.part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS part) g
), counts AS (
  SELECT doc_id, draws.source, text, COUNT(cdf.k) AS n
  FROM draws LEFT JOIN cdf ON cdf.source IS NOT DISTINCT FROM draws.source AND cdf.c <= draws.u
  GROUP BY doc_id, draws.source, text
)
SELECT doc_id, source, strlen(text) AS n_bytes, md5(text) AS text_md5, copy::INT AS copy,
       ('0x' || substr(md5('20|order|' || doc_id || '|' || copy), 1, 15))::BIGINT AS shuffle_key
FROM counts, LATERAL (SELECT unnest(range(1, n + 1)) AS copy) g
"""
