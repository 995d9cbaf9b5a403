"""Sharding under a byte limit by extendible hashing, in DataFrame functions only.

A document's place is a prefix of its key's hash. The directory starts as one
bucket; a bucket above the byte limit splits on the next bit, and no other
bucket does. Instead of splitting one by one, bytes are summed once for each
prefix of a depth that is fine enough (partial sums first, so no group of rows
meets in one task), and the sums give every coarser prefix's bytes: those a few
bits coarser at once, and all above from these. A bucket is the shortest prefix
whose bytes fit. Prefixes that are too large even at that depth go into another
round with more bits.

A hash that is by itself above the limit (one long document, or rows that
share a key) can't be split by bits. Its rows fill overflow pages within the
limit, in order of their texts' digests, numbered by counts of each digest and
place; a single longer document has a page of its own. Pages depend on the rows
alone, but for which of two rows of equal key and text comes first.

Defined results: a null text has 0 bytes; a null key takes the hash of the
text; repeated rows share a bucket, in overflow pages if need be; an empty
table gives no rows; columns of the same names as the added ones are replaced,
all others stay.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus.llm.shared import checked_broadcast, stored, with_row

#: Bits of the hash.
BITS = 60
#: The first round's depth is so many bits finer than the mean bucket; each later one's by so many again.
FINER = 6
ADDED = ("n_bytes", "shard_id", "depth", "page")


def _hash(key: str):
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.col("text"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: int):
    return F.shiftright("hash", BITS - bits)


def _depths(nodes: DataFrame, bits: int, least: int, limit: int) -> DataFrame:
    """leaf, depth: the shortest prefix of ``least`` to ``bits`` bits whose bytes fit, of the leaves (leaf, bytes) of ``bits`` bits that have one."""
    above = nodes.withColumn("d", F.explode(F.sequence(F.lit(least), F.lit(bits)))).withColumn("p", F.expr(f"shiftright(leaf, {bits} - d)"))
    fits = above.groupBy("d", "p").agg(F.sum("bytes").alias("b")).where(F.col("b") <= limit).select("d", "p")
    return above.join(fits, ["d", "p"], "left_semi").groupBy("leaf").agg(F.min("d").alias("depth"))


def _buckets(leaves: DataFrame, bits: int, least: int, limit: int) -> DataFrame:
    """For each leaf its bucket's depth, null if even the leaf is too large. A bucket is not above depth ``least``."""
    middle = max(least, bits - FINER)
    coarse = leaves.groupBy(F.expr(f"shiftright(leaf, {bits - middle})").alias("leaf")).agg(F.sum("bytes").alias("bytes"))
    high = _depths(stored(coarse), middle, least, limit).select(F.col("leaf").alias("top"), F.col("depth").alias("high"))
    below = leaves.withColumn("top", F.expr(f"shiftright(leaf, {bits - middle})")).join(high, "top", "left")
    if bits == middle:
        return below.withColumnRenamed("high", "depth").drop("top")
    low = _depths(below.where("high IS NULL").select("leaf", "bytes"), bits, middle + 1, limit).withColumnRenamed("depth", "low")
    return below.join(low, "leaf", "left").withColumn("depth", F.coalesce("high", "low")).drop("top", "high", "low")


def shard(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """docs with n_bytes, shard_id (depth, prefix and any overflow page as text), depth and page."""
    keyed = with_row(docs, hash=_hash(key), n_bytes=F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    total = keyed.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(BITS, FINER + max(0, math.ceil(math.log2(max(1, total / limit)))))
    least, rest, parts = 0, keyed, []
    while True:
        leaves = rest.groupBy(_prefix(bits).alias("leaf")).agg(F.sum("n_bytes").alias("bytes"), (F.min("hash") == F.max("hash")).alias("single"), F.max("n_bytes").alias("longest"))
        found = stored(_buckets(stored(leaves), bits, least, limit)).select("leaf", "depth", "single", "longest")
        n, deeper, over = found.agg(F.count("*"), F.count(F.when(F.col("depth").isNull() & ~F.col("single"), 1)), F.count(F.when(F.col("depth").isNull() & F.col("single"), 1))).first()
        placed = rest.withColumn("leaf", _prefix(bits)).join(checked_broadcast(found, n), "leaf")
        parts.append(placed.where("depth IS NOT NULL").select("row", "n_bytes", "depth", F.expr(f"shiftright(leaf, {bits} - depth)").alias("prefix"), F.lit(None).cast("string").alias("page")))
        if over:
            paged = _pages(placed.where("depth IS NULL AND single"), limit)
            parts.append(paged.select("row", "n_bytes", F.lit(bits).alias("depth"), F.col("leaf").alias("prefix"), "page"))
        if not deeper:
            break
        rest = placed.where("depth IS NULL AND NOT single").select("row", "hash", "n_bytes")
        least, bits = bits, min(BITS, bits + FINER)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ADDED]
    name = F.concat_ws("-", F.col("depth"), F.col("prefix"), F.col("page")).alias("shard_id")
    return reduce(DataFrame.unionByName, parts).select(*own, "n_bytes", name, F.col("depth").cast("int").alias("depth"), "page")


def _pages(over: DataFrame, limit: int) -> DataFrame:
    """over (rows of hashes above the limit, with longest) with the page of each.

    Rows are numbered by two sums of counts, over the digests' first four digits
    and within these, and by their order within one digest and one stored part.
    """
    digest = F.md5(F.coalesce(F.col("row.text"), F.lit("")))
    rows = stored(over.select("row", "hash", "leaf", "n_bytes", "longest", digest.alias("digest"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    n = stored(rows.groupBy("hash", F.substring("digest", 1, 4).alias("salt"), "digest", "part").agg(F.count("*").alias("n")))
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    salts = n.groupBy("hash", "salt").agg(F.sum("n").alias("n")).withColumn("salt_before", F.coalesce(F.sum("n").over(before("hash").orderBy("salt")), F.lit(0))).drop("n")
    within = n.withColumn("digest_before", F.coalesce(F.sum("n").over(before("hash", "salt").orderBy("digest", "part")), F.lit(0)))
    first = within.join(salts, ["hash", "salt"]).select("hash", "digest", "part", (F.col("salt_before") + F.col("digest_before")).alias("first"))
    number = F.col("first") + F.row_number().over(W.partitionBy("hash", "digest", "part").orderBy("place")) - 1
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("longest"), F.lit(1))))
    return rows.join(first, ["hash", "digest", "part"]).withColumn("page", F.floor(number / per_page).cast("string"))


ORACLE_SQL = """
WITH keyed AS (
  SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h, COALESCE(strlen(text), 0) AS n_bytes FROM documents
), above AS (
  SELECT doc_id, n_bytes, d, h >> (60 - d) AS p FROM keyed, range(0, 31) r(d)
), sums AS (
  SELECT d, p, SUM(n_bytes) AS b FROM above GROUP BY d, p
), fits AS (
  SELECT a.doc_id, a.n_bytes, MIN(a.d) AS depth FROM above a JOIN sums s USING (d, p) WHERE s.b <= 1048576 GROUP BY a.doc_id, a.n_bytes
)
SELECT f.doc_id, f.n_bytes::BIGINT AS n_bytes, f.depth || '-' || (k.h >> (60 - f.depth)) AS shard_id, f.depth::INT AS depth, NULL::VARCHAR AS page
FROM fits f JOIN keyed k USING (doc_id)
"""
