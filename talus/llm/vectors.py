"""Exact top-k by inner product over vector-approximation blocks.

Every distinct integer vector is stored once, with an approximation: a grid of
256 cells over its own range. A query's product with a vector's lower cell
corners, plus a slack that depends on the query and the grid's width, bounds
the exact product from both sides, and one matrix product gives all bounds of
a block of queries against a block of vectors. Only vectors whose upper bound
reaches the query's (k+1)th best lower bound (one may be the query itself) are
read exactly, best bound first, until no unread bound can enter the result.

Queries come in blocks of bounded size. Each is broadcast (``QUERY_BYTES`` at most)
to the approximations, one byte a component, which are stored once and stay where
they are; for more queries than one block holds they are scanned again. A first
pass over a few vectors gives each query a bound to begin with, and a task
raises it from block to block. A query with many candidates left (one to which
all vectors are alike, say) is dealt to several groups. Equal vectors are
merged before: as ties go to the smaller id, only their k + 1 smallest ids can
appear in any result.

Defined results: a vector that is null, empty or holds a null or non-finite
component takes no part, nor one whose components leave a double's range when
scaled, nor a row without id; vectors are compared with those of their own
length; a query's own id is never its result, on all rows that bear it; rows of
one id with several vectors are several candidates and queries; products are
exact whole numbers of any size and ranked as such, ``score`` stays at the ends
of the long range where they leave it; no rows give no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus.llm.shared import checked_broadcast, spread_join, stored

#: Vectors in a block, bytes of a block of queries, vectors in the first pass.
BLOCK = 16_384
QUERY_BYTES = 16_000_000
FIRST = 16_384
#: A query's candidates that are read in one group.
CANDIDATES = 256
#: Beyond this, components have no bounds (their products could leave a double's range) and are always read exactly.
_BOUNDED = 2.0**400


def integers(embeddings: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, dim, vec of the rows that take part: components floor(scale * x), little-endian int32 if all fit, else double."""
    good = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < float("inf")))
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            x = np.floor(scale * np.asarray(v.flatten(), np.float64))
            at = np.concatenate([[0], np.cumsum(np.asarray(v.value_lengths()))]).astype(np.int64)
            wide = np.maximum.reduceat(np.abs(x), at[:-1]) >= 2.0**31 if len(at) > 1 else np.zeros(0, bool)
            small = np.clip(x, -(2.0**31), 2.0**31 - 1).astype("<i4").tobytes()
            vec = [x[i:j].astype("<f8").tobytes() if w else small[4 * i : 4 * j] for i, j, w in zip(at[:-1].tolist(), at[1:].tolist(), wide.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(at), pa.int32()), pa.array(vec, pa.binary())], ["id", "dim", "vec"])

    return good.mapInArrow(task, "id long, dim int, vec binary")


def _components(vec: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(vec, "<i4" if len(vec) == 4 * dim else "<f8").astype(np.float64)


def product(a: bytes, b: bytes, dim: int) -> int:
    """The exact product of two stored vectors."""
    x, y = _components(a, dim), _components(b, dim)
    with np.errstate(over="ignore"):
        if float(np.abs(x) @ np.abs(y)) < 2.0**62:
            return int(x.astype(np.int64) @ y.astype(np.int64))
    return sum(int(p) * int(q) for p, q in zip(x.tolist(), y.tolist(), strict=True))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """dim, vec and its smallest ids, ``ids`` at most, merged within batches before any shuffle."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df = pd.DataFrame({"id": b.column(0).to_numpy(zero_copy_only=False), "dim": b.column(1).to_numpy(zero_copy_only=False), "vec": b.column(2).to_pylist()}).drop_duplicates().sort_values("id")
            got = df.groupby(["dim", "vec"], sort=False)["id"].agg(lambda x: x.tolist()[:ids]).reset_index()
            yield pa.RecordBatch.from_arrays([pa.array(got["dim"], pa.int32()), pa.array(got["vec"].tolist(), pa.binary()), pa.array(got["id"].tolist(), pa.list_(pa.int64()))], ["dim", "vec", "ids"])

    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids)
    part = rows.mapInArrow(least, "dim int, vec binary, ids array<long>")
    return part.groupBy("dim", "vec", F.pmod(F.element_at("ids", 1), F.lit(32)).alias("salt")).agg(merged.alias("ids")).groupBy("dim", "vec").agg(merged.alias("ids"))


_GRID = "dim int, rows binary, low binary, width binary, cells binary"


def _approximations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length: their row ids and grids; cells are bytes. A vector without bounds has no low corner."""
    schema = pa.schema([("dim", pa.int32())] + [(n, pa.binary()) for n in ("rows", "low", "width", "cells")])
    for b in batches:
        row, dims, vec = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
        for dim in np.unique(dims).tolist():
            which = np.flatnonzero(dims == dim)
            for at in range(0, len(which), BLOCK):
                part = which[at : at + BLOCK]
                x = np.stack([_components(vec[i], dim) for i in part.tolist()])
                bounded = np.abs(x).max(1) < _BOUNDED
                x[~bounded] = 0
                low = x.min(1)
                width = np.maximum(x.max(1) - low, 1.0) / 255
                cells = np.clip(np.floor((x - low[:, None]) / width[:, None]), 0, 255).astype(np.uint8)
                low = np.where(bounded, low, np.nan)
                values = {"dim": [dim], "rows": [row[part].astype("<i8").tobytes()], "low": [low.tobytes()], "width": [width.tobytes()], "cells": [cells.tobytes()]}
                yield pa.RecordBatch.from_pydict(values, schema=schema)


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of queries (rows of q) with approximated vectors."""
    far = (np.abs(q).max(1) >= _BOUNDED)[:, None]
    unbounded = far | np.isnan(low)[None, :]
    q, low = np.where(far, 0, q), np.nan_to_num(low)
    corner = q.sum(1)[:, None] * low[None, :] + (q @ cells.T.astype(np.float64)) * width[None, :]
    # of the arithmetic itself: each sum's error is within so many units of the largest it could be
    slack = (q.shape[1] + 16) * 2.0**-50 * np.abs(q).sum(1)[:, None] * (np.abs(low) + 256 * width)[None, :] + 1
    lower = corner + np.minimum(q, 0).sum(1)[:, None] * width[None, :] - slack
    upper = corner + np.maximum(q, 0).sum(1)[:, None] * width[None, :] + slack
    return np.where(unbounded, -np.inf, lower), np.where(unbounded, np.inf, upper)


def _grid(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["low"], "<f8"), np.frombuffer(r["width"], "<f8"), np.frombuffer(r["cells"], np.uint8).reshape(-1, r["dim"])


_QUERIES = "dim int, qb int, q_rows binary, queries binary, reached binary"


def _first_bounds(k: int):
    """A block of queries and the first pass's vectors -> the block with the bound that each query begins with."""

    def block(own: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c.split(" ")[0]: [] for c in _QUERIES.split(", ")})
        dim = int(own["dim"].iloc[0])
        q = np.stack([_components(v, dim) for v in own["vec"]])
        best = np.full((len(q), k + 1), -np.inf)
        for r in first.to_dict("records"):
            _, *grid = _grid(r)
            for at in range(0, len(q), 64):
                lower = np.concatenate([best[at : at + 64], bounds(q[at : at + 64], *grid)[0]], axis=1)
                best[at : at + 64] = np.partition(lower, lower.shape[1] - k - 1, axis=1)[:, -k - 1 :]
        return pd.DataFrame({"dim": [dim], "qb": [own["qb"].iloc[0]], "q_rows": [own["q_row"].to_numpy("<i8").tobytes()], "queries": [q.tobytes()], "reached": [best.min(1).tobytes()]})

    return block


def _scan(k: int):
    """(block of vectors, block of queries) -> each query's vectors that may belong to its best k + 1."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, reached = None, np.zeros((0, 0)), np.zeros(0)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                rows, *grid = _grid(r)
                q, q_rows = np.frombuffer(r["queries"], "<f8").reshape(-1, r["dim"]), np.frombuffer(r["q_rows"], "<i8")
                if now != (r["dim"], r["qb"]):
                    now, best, reached = (r["dim"], r["qb"]), np.full((len(q), k + 1), -np.inf), np.frombuffer(r["reached"], "<f8").copy()
                for at in range(0, len(q), 64):
                    lower, upper = bounds(q[at : at + 64], *grid)
                    both = np.concatenate([best[at : at + 64], lower], axis=1)
                    best[at : at + 64] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -k - 1 :]
                    reached[at : at + 64] = np.maximum(reached[at : at + 64], best[at : at + 64].min(1))
                    x, y = np.nonzero(upper >= reached[at : at + 64, None])
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(q_rows[at + x]), pa.array(rows[y]), pa.array(upper[x, y]), pa.array(reached[at + x])], ["q_row", "row", "upper", "reached"])

    return task


_LONG = 2**63


def _order(score: int) -> str:
    """Text that sorts like whole numbers beyond the long range, and between them within it."""
    if -_LONG <= score < _LONG:
        return "1"
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    return f"2{text}" if score > 0 else "0" + text.translate(str.maketrans("0123456789", "9876543210"))


def _certain(k: int):
    """One group of a query's candidates -> its k best (exactly), reading vectors in the order of their bounds."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["upper"].isna()
        query = pdf[asked].iloc[0]
        q, own, dim = query["vec"], int(query["ids"][0]), int(query["dim"])
        rest = pdf[~asked].sort_values("upper", ascending=False)
        found: list[tuple[int, int]] = []
        for upper, vec, ids in zip(rest["upper"].tolist(), rest["vec"].tolist(), rest["ids"].tolist(), strict=True):
            if len(found) >= k and -found[k - 1][0] > upper:
                break
            score = product(q, vec, dim)
            found = sorted(found + [(-score, int(x)) for x in ids if x != own])[:k]
        scores = [-s for s, _ in found]
        return pd.DataFrame(
            {"q_row": query["q_row"], "query_id": own, "vec_id": [x for _, x in found], "score": [min(max(s, -_LONG), _LONG - 1) for s in scores], "beyond": [_order(s) for s in scores]},
            columns=["q_row", "query_id", "vec_id", "score", "beyond"],
        )

    return best


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of greatest integer inner product for each query row."""
    vectors = stored(distinct_vectors(integers(embeddings, id_col, vector_col, scale), k + 1).withColumn("row", F.monotonically_increasing_id()))
    asked = stored(integers(queries, id_col, vector_col, scale).distinct().withColumn("q_row", F.monotonically_increasing_id()))
    n_asked, size = asked.agg(F.count("*"), F.sum(F.col("dim") * F.lit(8).cast("long"))).first()
    if not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-size // QUERY_BYTES)
    dealt = asked.withColumn("qb", F.pmod(F.xxhash64("q_row"), F.lit(blocks)).cast("int"))
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    one_in = max(1, vectors.count() // FIRST)
    first = vectors.where(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0).select("row", "dim", "vec").mapInArrow(_approximations, _GRID).withColumn("qb", each_block)
    begun = stored(dealt.groupBy("dim", "qb").cogroup(first.groupBy("dim", "qb")).applyInPandas(_first_bounds(k), _QUERIES))
    grids = vectors.select("row", "dim", "vec").mapInArrow(_approximations, _GRID)
    grids = stored(grids) if blocks > 1 else grids
    near = None
    for b in range(blocks):  # of at most about QUERY_BYTES each
        part = grids.join(F.broadcast(begun.where(F.col("qb") == b)), "dim").mapInArrow(_scan(k), "q_row long, row long, upper double, reached double")
        near = stored(part) if near is None else near.unionByName(stored(part))
    # the best bound that any task reached; a query's candidates beyond CANDIDATES go to several groups
    per_query = stored(near.groupBy("q_row").agg(F.max("reached").alias("most"), F.ceil(F.count("*") / CANDIDATES).cast("int").alias("groups")))
    kept = near.join(checked_broadcast(per_query, n_asked), "q_row").where(F.col("upper") >= F.col("most")).select("q_row", "row", "upper", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int").alias("part"))
    read = spread_join(kept, vectors, "row", "q_row").select("q_row", "part", "dim", "upper", "vec", "ids")
    alone = F.lit(None).cast("double").alias("upper")
    heads = asked.join(per_query, "q_row").select("q_row", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "dim", alone, "vec", F.array("id").alias("ids"))
    found = read.unionByName(heads).groupBy("q_row", "part").applyInPandas(_certain(k), "q_row long, query_id long, vec_id long, score long, beyond string")
    place = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
