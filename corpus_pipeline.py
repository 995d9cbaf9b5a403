"""The corpus pipeline: quality, language, near-duplicates, mixing, packing, one after another.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
it kept and returns a DataFrame, which ``run`` writes as Parquet to the shared
work folder and reads again for the next. All stages take whole texts, keep docs' own
columns by value whatever their names are, treat repeated rows as rows of their own
unless they say otherwise, and give no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import langid, mixing, neardup, packing, quality
from talus.llm.queries import tokenizer_path
from talus.llm.shared import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer does not reject. Texts that are null, empty or blank are rejected; equal texts share a fate."""
    return quality.filtered(docs)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found without ambiguity.

    Learnt from all documents of this stage that have a language; a null or wrong lang is
    no reason to go. Texts that are null or have no letters go. Without any known language all go.
    """
    return langid.identified(docs, learn=F.lit(True))


#: Near copies share four fifths of their word shingles; op8's contract alone asks for 85 percent.
NEAR = neardup.NearRules(percent=80)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id.

    Of rows that share that id one stays, the least by text and other columns. Null or
    blank texts and rows without id are nobody's copies and stay.
    """
    return neardup.deduplicated(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate draws them, shuffled. A null source is a source; rows without text or id are drawn like others."""
    return mixing.replicated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens. A null text is empty: its end alone is a piece; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models and tokens are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
