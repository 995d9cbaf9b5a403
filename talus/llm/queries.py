"""The operators' queries, over their whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import decontaminate, mixing, neardup, repeats, sharding, turns, vectors
from talus.llm.shared import table

#: A shard's byte limit.
SHARD_BYTES = 1 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talus.llm.lm import score

    return score(table(spark, sf_dir, "documents"), tokenizer_path(), learn=fold(7) != 2, held_out=fold(7) == 2)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talus.llm.media import features, stored_media

    return features(stored_media(table(spark, sf_dir, "documents")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talus.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"), learn=fold(4) != 2, held_out=fold(4) == 2)


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talus.llm.vectors import top_k

    embeddings = table(spark, sf_dir, "embeddings")
    return top_k(embeddings, embeddings.where("vec_id % 100 = 0"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talus.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), limit=SHARD_BYTES).select("doc_id", "n_bytes", "shard_id", "depth", "page")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talus.llm.quality import scored

    return scored(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "weak_label", "score", "kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talus.llm.tokenfiles import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talus.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"), "copy", "shuffle_key")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talus.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(table(spark, sf_dir, "conversations"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.periodic_runs(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_media": op2_media,
    "op3_language": op3_language,
    "op4_vectors": op4_vectors,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_neardup": op8_neardup,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_repair": op11_repair,
    "op12_repeats": op12_repeats,
    "op13_decontamination": op13_decontamination,
}

ORACLE_SQL = {
    "op4_vectors": vectors.ORACLE_SQL,
    "op5_sharding": sharding.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op11_repair": turns.ORACLE_SQL,
    "op12_repeats": repeats.ORACLE_SQL,
    "op13_decontamination": decontaminate.ORACLE_SQL,
}
