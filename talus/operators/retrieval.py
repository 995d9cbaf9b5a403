"""Passage retrieval: vector top-k, BM25 over the candidates, rank fusion, selection, review of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Most candidates of a query, and most citations.
CANDIDATES, CITATIONS = 8, 3


def check_search(top_k: int, query: str | None = None, window_days: int | None = None) -> None:
    """Arguments of the search and history tools."""
    if isinstance(top_k, bool) or not 1 <= top_k <= CANDIDATES:
        raise ValueError(f"top_k is 1 to {CANDIDATES}")
    if query is not None and not query.strip():
        raise ValueError("the query is blank")
    if window_days is not None and not 1 <= window_days <= 180:
        raise ValueError("window_days is 1 to 180")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_top_k(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, pos: the k passages of greatest cosine for each query, ties to the smaller chunk_id.

    queries: query_id, vector, corpus_version; chunks: chunk_id, vector,
    corpus_version. A query set against all passages of its version, without an index:
    queries are broadcast in blocks, passages stay where they are, and each task keeps
    k of each query. ``pivots.search`` is the indexed form.
    """
    from talus.operators import pivots

    return pivots.scan(queries, chunks, k).select("query_id", "chunk_id", "score", "pos")


def bm25(candidates: DataFrame, tokens: Column, query_tokens: Column, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_id, chunk_id, bm25: Okapi scores with a query's own candidates as the corpus.

    Words in more than half of the candidates have a negative weight; they get
    epsilon times the mean weight of the corpus's words. Repeated query words count again.
    """
    docs = candidates.select("query_id", "chunk_id", tokens.alias("tokens"))
    size = F.size("tokens").cast("double")
    stats = docs.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(size).alias("mean_size"))
    tf = docs.select("query_id", "chunk_id", size.alias("size"), F.explode("tokens").alias("word")).groupBy("query_id", "chunk_id", "word").agg(F.count("*").alias("tf"), F.first("size").alias("size"))
    df = tf.groupBy("query_id", "word").agg(F.count("*").alias("df")).join(stats, "query_id")
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("query_id").agg(F.avg("raw").alias("mean_raw"))
    idf = raw.join(mean, "query_id").select("query_id", "word", "mean_size", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"))
    asked = candidates.select("query_id", query_tokens.alias("q")).distinct().select("query_id", F.explode("q").alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
    hits = tf.join(idf, ["query_id", "word"]).join(asked, ["query_id", "word"])
    one = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean_size")))
    scores = hits.groupBy("query_id", "chunk_id").agg(F.sum(one).alias("bm25"))
    return candidates.select("query_id", "chunk_id").join(scores, ["query_id", "chunk_id"], "left").fillna(0.0, ["bm25"])


def ranked(rows: DataFrame, score: str, name: str, by: str = "query_id", order: str = "pos") -> DataFrame:
    """rows with a 1-based rank by score, largest first, ties in input order."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), order)))


def fused(rows: DataFrame, ranks: list[str], k: int = 60) -> DataFrame:
    """rows with ``rrf``, the sum of 1 / (k + rank)."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.lit(1.0) / (F.lit(k) + F.col(r))
    return rows.withColumn("rrf", total)


def select_citations(candidates: DataFrame, preferred: DataFrame, min_score: float, most: int = CITATIONS) -> DataFrame:
    """query_id, chunk_id, article_ref, text, applicability, pos: at most three passages, preferred articles first, then by fused rank.

    candidates: query_id, chunk_id, pos, score, article_ref, text, tokens,
    query_tokens; preferred: query_id, applicability, refs. A query without
    applicability selects nothing.
    """
    good = candidates.where(F.col("score") >= min_score).join(preferred.where("applicability IS NOT NULL"), "query_id")
    scores = bm25(good, F.col("tokens"), F.col("query_tokens"))
    rounded = scores.withColumn("bm25", F.round("bm25", 9))  # sums of equal terms in any order are equal
    both = ranked(ranked(good.join(rounded, ["query_id", "chunk_id"]), "score", "rank_vector"), "bm25", "rank_words")
    rows = fused(both, ["rank_vector", "rank_words"]).withColumn("preferred", F.array_contains("refs", F.col("article_ref")))
    order = W.partitionBy("query_id").orderBy(F.desc("preferred"), F.desc("rrf"), "pos")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "chunk_id", "article_ref", "text", "applicability", F.col("place").alias("pos"))


def passages(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """ids (chunk_id, corpus_version) with text, text_sha256 and ``found``; both must fit."""
    side = chunks.select("chunk_id", "corpus_version", "text", "text_sha256", F.lit(True).alias("found"))
    return ids.join(side, ["chunk_id", "corpus_version"], "left").fillna(False, ["found"])


def reviewed(citations: DataFrame, retrieved: DataFrame, chunks: DataFrame, version: str, quoted_sha256: Column) -> DataFrame:
    """citations with ``verified`` and the first reason against: not retrieved, not in the corpus version, text changed."""
    got = retrieved.select("alert_id", "chunk_id", F.lit(True).alias("_retrieved")).distinct()
    own = chunks.where(F.col("corpus_version") == version).select("chunk_id", F.col("text_sha256").alias("_sha"))
    reason = (
        F.when(F.col("_retrieved").isNull(), F.lit("not retrieved")).when(F.col("_sha").isNull(), F.lit("not in the corpus version")).when(F.col("_sha") != quoted_sha256, F.lit("SHA-256 differs"))
    )
    return citations.join(got, ["alert_id", "chunk_id"], "left").join(own, "chunk_id", "left").withColumn("reason", reason).withColumn("verified", F.col("reason").isNull()).drop("_retrieved", "_sha")


def verdicts(review: DataFrame) -> DataFrame:
    """alert_id, n_proposed, n_verified, grounding (0.0 if nothing was proposed)."""
    n = review.groupBy("alert_id").agg(F.count("chunk_id").alias("n_proposed"), F.count_if(F.col("verified") & F.col("chunk_id").isNotNull()).alias("n_verified"))
    return n.withColumn("grounding", F.coalesce(F.try_divide(F.col("n_verified").cast("double"), F.col("n_proposed")), F.lit(0.0)))


def search_query(typology: Column, incisos: Column) -> Column:
    return F.format_string("%s: indícios enquadrados no art. 1º, incisos {%s}, da CC 4.001/2020", typology, F.array_join(incisos, ", "))
