"""Norm texts as passages: article, paragraph, inciso, alínea.

A text is a table of lines. Each line's marker, if any, is a regular expression;
running counts over the lines tell where a line belongs, and lines of one place
make a passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus.functions.text import roman, text_sha256

# Markers at the beginning of a line.
ARTICLE = r"^[ \t]*Art\.\s*(\d+)[º°]?\.?[ \t]+"
PARAGRAPH = r"^[ \t]*§\s*(\d+)[º°][ \t]+"
SOLE_PARAGRAPH = r"^[ \t]*Par[aá]grafo\s+[uú]nico\.[ \t]+"
INCISO = r"^[ \t]*([IVXLCDM]+)\s*-\s+"
ALINEA = r"^[ \t]*([a-z])\)[ \t]+"


def chunks(norms: DataFrame, corpus_version: str) -> DataFrame:
    """chunk_id, doc_id, article_ref, text, text_sha256, corpus_version, source_url of all passages. norms: doc_id, text, source_url."""
    lines = norms.select("doc_id", "source_url", F.posexplode(F.split("text", r"\r?\n")).alias("line", "t"))
    at = lambda pattern: F.regexp_like("t", F.lit(pattern))
    one = lambda condition: F.sum(F.when(condition, 1).otherwise(0))
    so_far = lambda *keys: W.partitionBy(*keys).orderBy("line").rowsBetween(W.unboundedPreceding, 0)

    rows = lines.withColumn("art", at(ARTICLE)).withColumn("a", one(F.col("art")).over(so_far("doc_id"))).where("a > 0")
    article = W.partitionBy("doc_id", "a")
    rows = rows.withColumn("number", F.max(F.when(F.col("art"), F.regexp_extract("t", ARTICLE, 1))).over(article))
    # what follows an article's marker on its line may itself begin with a marker
    rows = rows.withColumn("t", F.when(F.col("art"), F.regexp_replace("t", ARTICLE, "")).otherwise(F.col("t")))
    rows = rows.withColumn("numbered", F.max(at(PARAGRAPH) & ~F.col("art")).over(article)).withColumn("par", ~F.col("art") & F.when(F.col("numbered"), at(PARAGRAPH)).otherwise(at(SOLE_PARAGRAPH)))
    rows = rows.withColumn("pars", F.max("par").over(article)).withColumn("p", one(F.col("par")).over(so_far("doc_id", "a")))
    part = W.partitionBy("doc_id", "a", "p")
    rows = rows.withColumn("p_ref", F.max(F.when(F.col("par"), F.when(F.col("numbered"), F.concat(F.lit("p"), F.regexp_extract("t", PARAGRAPH, 1))).otherwise(F.lit("pu")))).over(part))
    rows = rows.withColumn("t", F.when(F.col("par"), F.regexp_replace(F.regexp_replace("t", PARAGRAPH, ""), SOLE_PARAGRAPH, "")).otherwise(F.col("t")))
    fresh = ~F.col("art") & ~F.col("par")
    rows = rows.withColumn("inc", fresh & at(INCISO)).withColumn("incs", F.max("inc").over(part)).withColumn("i", one(F.col("inc")).over(so_far("doc_id", "a", "p")))
    item = W.partitionBy("doc_id", "a", "p", "i")
    rows = rows.withColumn("i_ref", F.max(F.when(F.col("inc"), roman(F.regexp_extract("t", INCISO, 1)))).over(item)).withColumn("t", F.when(F.col("inc"), F.regexp_replace("t", INCISO, "")).otherwise(F.col("t")))
    rows = rows.withColumn("ali", fresh & ~F.col("inc") & (F.col("i") > 0) & at(ALINEA)).withColumn("l", one(F.col("ali")).over(so_far("doc_id", "a", "p", "i")))
    letter = F.max(F.when(F.col("ali"), F.regexp_extract("t", ALINEA, 1)))
    rows = rows.withColumn("t_", F.when(F.col("ali"), F.regexp_replace("t", ALINEA, "")).otherwise(F.col("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t_"))), lambda x: x["t_"]), "\n")
    found = rows.groupBy("doc_id", "source_url", "a", "p", "i", "l").agg(
        F.max("number").alias("number"), F.max("pars").alias("pars"), F.max("p_ref").alias("p_ref"), F.max("incs").alias("incs"), F.max("i_ref").alias("i_ref"), letter.alias("letter"),
        F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"),
    )
    ref = F.concat_ws(
        "/", "doc_id", F.concat(F.lit("art"), "number"), F.when(F.col("p") > 0, F.col("p_ref")).when(F.col("pars"), F.lit("caput")),
        F.when(F.col("i") > 0, F.concat(F.lit("i"), F.col("i_ref").cast("string"))).when(F.col("incs"), F.lit("caput")), "letter",
    )
    return found.where("text <> ''").withColumn("article_ref", ref).select(
        F.concat_ws(":", "doc_id", "article_ref", F.lit(corpus_version)).alias("chunk_id"), "doc_id", "article_ref", "text", text_sha256(F.col("text")).alias("text_sha256"), F.lit(corpus_version).alias("corpus_version"), "source_url"
    )


def corpus_version(manifest: DataFrame) -> Column:
    """First 16 hex digits of the SHA-256 of doc:sha pairs in order of doc_id, joined by bars; an aggregate over (doc_id, sha256)."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "sha256"))), lambda x: F.concat_ws(":", x["doc_id"], x["sha256"]))
    return F.substring(F.sha2(F.array_join(pairs, "|"), 256), 1, 16)


MANIFEST = "doc_id string, source_url string, downloaded_at timestamp, doc_sha256 string, local_filename string"


def write_manifest(documents: DataFrame, path: str) -> None:
    """The norms' manifest as JSON lines, in order of doc_id; ids are unique."""
    names = [f.split(" ")[0] for f in MANIFEST.split(", ")]
    if documents.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        raise ValueError("a doc_id is null or given twice")
    documents.select(*names).coalesce(1).sortWithinPartitions("doc_id").write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; unknown or missing fields are errors."""
    names = [f.split(" ")[0] for f in MANIFEST.split(", ")]
    found = spark.read.json(path).columns
    if problems := sorted(set(found) ^ set(names)):
        raise ValueError(f"unknown or missing fields: {', '.join(problems)}")
    return spark.read.schema(MANIFEST).json(path)


def ingest_manifest(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """Passages of the manifest's norms (texts: doc_id, text) under the version of its hashes: unchanged files keep their version. A norm without text is an error."""
    missing = manifest.join(texts.where("text IS NOT NULL"), "doc_id", "left_anti").select("doc_id").limit(5).collect()
    if missing:
        raise ValueError(f"no text of {', '.join(r['doc_id'] for r in missing)}")
    hashed = manifest.select("doc_id", F.col("doc_sha256").alias("sha256"))
    version = hashed.agg(corpus_version(hashed)).first()[0]
    return chunks(texts.join(manifest.select("doc_id", "source_url"), "doc_id").select("doc_id", "text", "source_url"), version)


def ingest(texts: DataFrame) -> DataFrame:
    """Passages of all norms (doc_id, text, source_url) under the version that their hashes give. A corpus has a handful of norms."""
    hashed = texts.select("doc_id", F.sha2("text", 256).alias("sha256"))
    version = hashed.agg(corpus_version(hashed)).first()[0]
    return chunks(texts, version)


def without_running_heads(text: Column, pattern: str) -> Column:
    """Page heads and feet removed, given as a pattern of whole lines."""
    return F.regexp_replace(text, f"(?m)^{pattern}$\\n?", "")
