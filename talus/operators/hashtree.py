"""Ordered content digests and proofs that a later log extends an earlier one, by a hash tree.

A leaf is the SHA-256 of a row's canonical JSON, nulls written, so null, the empty
string and moved separators all differ. Leaves stand in the table's order. A node is the
hash of its two children; a last node without a sibling moves up as it is. So the
tree of n rows holds the roots of all its whole subtrees, and about log2(n) of them
prove that the first m of n rows are the m rows whose root is known.

Every ``STEP`` levels are one pass: nodes are dealt by blocks of 2^STEP neighbours, sorted
and folded, each block to its root. Only these levels are stored, a thousandth of the
leaves above the lowest one. A proof reads at most 2^STEP nodes for each of its digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators.ranks import placed
from talus.sources.store import staged

STEP = 10
EMPTY = hashlib.sha256(b"").hexdigest()


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.concat(F.lit("leaf|"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 256)


def node_digest(left: str, right: str) -> str:
    return hashlib.sha256(f"node|{left}|{right}".encode()).hexdigest()


def folded(digests: list[str]) -> str:
    """The root over neighbours."""
    while len(digests) > 1:
        rest = digests[-1:] if len(digests) % 2 else []
        digests = [node_digest(a, b) for a, b in zip(digests[::2], digests[1::2], strict=False)] + rest
    return digests[0]


def leaves(df: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """at (from 0), digest of every row in this order; rows that are equal in it stand in order of their digests."""
    columns = columns or df.columns
    rows = df.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], row_digest(columns).alias("digest"))
    return placed(rows, [*[f"o{i}" for i in range(len(order))], "digest"]).select((F.col("place") - 1).alias("at"), "digest")


@dataclass
class Tree:
    #: level (0, STEP, 2 * STEP, ...), at, digest.
    nodes: DataFrame
    n: int
    root: str

    def _subtree(self, low: int, high: int) -> str:
        """The root over leaves low to high: a whole subtree, or one that ends with the tree."""
        level = STEP * (((high - low - 1).bit_length() - 1) // STEP) if high - low > 1 else 0
        first, last = low >> level, (high - 1) >> level
        own = self.nodes.where((F.col("level") == level) & F.col("at").between(first, last)).orderBy("at").collect()
        if len(own) != last - first + 1:
            raise ValueError("the tree lacks nodes")
        return folded([r["digest"] for r in own])

    def consistency_proof(self, m: int) -> list[str]:
        """The digests that show the tree to extend its first m leaves."""
        if not 0 < m <= self.n:
            raise ValueError("a proof is for 1 to n leaves")
        ranges: list[tuple[int, int]] = []
        low, high, whole = 0, self.n, True  # whole: the first m leaves are the range's own tree so far
        while m != high - low:
            half = 1 << (high - low - 1).bit_length() - 1
            if m <= half:
                ranges.append((low + half, high))
                high = low + half
            else:
                ranges.append((low, low + half))
                low, m, whole = low + half, m - half, False
        if not whole:
            ranges.append((low, high))
        return [self._subtree(a, b) for a, b in reversed(ranges)]


def build(leaves_: DataFrame) -> Tree:
    """The tree over leaves (at from 0 without gaps, digest)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            out = []
            for at, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at >> STEP != block:
                    if held:
                        out.append((block, folded(held)))
                    block, held = at >> STEP, []
                held.append(digest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out])], ["at", "digest"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([folded(held)])], ["at", "digest"])

    level, now = 0, staged(leaves_.select(F.col("at").cast("long").alias("at"), "digest"))
    top = now.agg(F.count("*").alias("n"), F.max("at").alias("m"), F.count_distinct("at").alias("d")).first()
    n = top["n"]
    if n and not n == top["m"] + 1 == top["d"]:
        raise ValueError("places have gaps or repeats")
    nodes, size = now.withColumn("level", F.lit(0)), n
    while size > 1:
        level, size = level + STEP, -(-size // (1 << STEP))
        now = staged(now.repartition(F.shiftright("at", STEP)).sortWithinPartitions("at").mapInArrow(fold, "at long, digest string"))
        nodes = nodes.unionByName(now.withColumn("level", F.lit(level)))
    return Tree(nodes, n, now.first()["digest"] if n else EMPTY)


def extends(m: int, old: str, n: int, new: str, proof: list[str]) -> bool:
    """Whether the proof shows that the tree of n leaves with root ``new`` begins with the m leaves of root ``old``."""
    if not 0 < m <= n:
        return m == 0 and old == EMPTY and not proof
    if m == n:
        return old == new and not proof
    a, b, rest = m - 1, n - 1, list(proof)
    while a & 1:
        a, b = a >> 1, b >> 1
    if a:  # the first m leaves are no whole subtree: the proof begins with the last part of theirs
        if not rest:
            return False
        was = now = rest.pop(0)
    else:
        was = now = old
    for digest in rest:
        if not b:
            return False
        if a & 1 or a == b:
            was, now = node_digest(digest, was), node_digest(digest, now)
            while a and not a & 1:
                a, b = a >> 1, b >> 1
        else:
            now = node_digest(now, digest)
        a, b = a >> 1, b >> 1
    return was == old and now == new and not b


def content_digest(tables: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """SHA-256 over name, row count and root of each table (a table and its order): any change of content or order changes it."""
    built = {name: build(leaves(df, order)) for name, (df, order) in sorted(tables.items())}
    return hashlib.sha256("|".join(f"{name}:{t.n}:{t.root}" for name, t in built.items()).encode()).hexdigest()
