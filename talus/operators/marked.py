"""Any number of marked values looked for in text columns at once.

Few values, up to a slice of so many bytes, make one Aho-Corasick automaton. Of more, each
length with many values is looked for by fingerprint: every window of that many characters
has a rolling hash, a Bloom filter of the values' hashes is asked for it, and what it lets
through is joined with the values themselves, so that the result is exact. All such lengths
take one pass over the texts, whatever the number of values. Values of the other lengths
go into automata, slice by slice: their number is bounded by that of lengths. Texts never move.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.sources.store import staged

#: Bytes of values in one automaton: some 50 MB in a worker.
SLICE_BYTES = 1 << 20
#: Lengths whose values take more than this part of a slice are looked for by fingerprint.
FEW = 8
#: Bits of the filter for each value, and the logarithm of most bits in all (64 MB); beyond, it lets more through and loses nothing.
BITS, MOST_BITS = 32, 29
#: Windows of one step, and rows read at once.
STEP, ROWS = 1 << 16, 256

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_PROBES = tuple(np.uint64(x) for x in (1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, held) -> ahocorasick.Automaton:
    if name not in _built:
        _built.clear()
        automaton = ahocorasick.Automaton()
        for value in held.value:
            automaton.add_word(value, value)
        automaton.make_automaton()
        _built[name] = automaton
    return _built[name]


def text_columns(table: DataFrame) -> list[str]:
    return [f.name for f in table.schema.fields if f.dataType.simpleString() == "string"]


def hits(table: DataFrame, marked: DataFrame, columns: list[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """row, column, value: each marked value found in a row's text column, once.

    marked: value (null and empty ones are not looked for). row numbers the table's
    rows; rows without a hit have none here.
    """
    values, found = _found(table, marked, columns or text_columns(table), slice_bytes)
    return found if values is None else found.join(values, "value", "left_semi").select("row", "column", "value")


def _found(table: DataFrame, marked: DataFrame, columns: list[str], slice_bytes: int) -> tuple[DataFrame | None, DataFrame]:
    """The hits; or the values, and hits among which some are of no value."""
    values = staged(marked.where("length(value) > 0").select("value").distinct())
    sizes = values.groupBy(F.length("value").alias("length")).agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("size")).collect()  # one for each length
    many = {r["length"]: r["n"] for r in sizes if r["size"] * FEW > slice_bytes} if sum(r["size"] for r in sizes) > slice_bytes else {}
    rest = values.where(~F.length("value").isin(list(many))) if many else values
    n = max(0 if many else 1, -(-sum(r["size"] for r in sizes if r["length"] not in many) // slice_bytes))
    rows = table.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = staged(rows) if n + bool(many) > 1 else rows
    found = _candidates(rows, columns, _filter(values, many)) if many else None
    for s in range(n):
        own = [r["value"] for r in rest.where(F.pmod(F.xxhash64("value"), F.lit(n)) == s).collect()]  # about slice_bytes
        part = _searched(rows, columns, own)
        found = part if found is None else found.unionByName(part)
    return values if many else None, found


@dataclass
class _Filter:
    """A Bloom filter of the hashes of all values of these lengths."""

    lengths: list[int]
    bits: int
    held: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be a value's."""
        left = None
        for k in _PROBES:
            at = _places(hashes if left is None else hashes[left], k, self.bits)
            hit = np.flatnonzero(((self.held.take(at >> 3) >> (at & 7).astype(np.uint8)) & np.uint8(1)).view(bool))
            left = hit if left is None else left[hit]
        return left


def _places(hashes: np.ndarray, probe: np.uint64, bits: int) -> np.ndarray:
    return ((hashes * probe) >> np.uint64(64 - bits)).view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base, np.uint64))


def _kind(length: int) -> np.uint64:
    return np.uint64(length * _BASE % (1 << 64))


def _filter(values: DataFrame, many: dict[int, int]) -> _Filter:
    """Its bits are set in parts of 4 KB, which alone reach the driver."""
    bits = min(MOST_BITS, max(15, (sum(many.values()) * BITS - 1).bit_length()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[str]] = {}
            for v in batch.column(0).to_pylist():
                by.setdefault(len(v), []).append(v)
            for m, own in by.items():
                step = max(1, STEP // m)
                for i in range(0, len(own), step):
                    h = (_codes("".join(own[i : i + step])).reshape(-1, m) * _powers(_BASE, m)).sum(1, dtype=np.uint64) + _kind(m)
                    at = np.concatenate([_places(h, k, bits) for k in _PROBES])
                    yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["part", "at"])

    set_ = values.where(F.length("value").isin(list(many))).mapInArrow(task, "part long, at long").groupBy("part").agg(F.bitmap_construct_agg("at").alias("set")).toArrow()
    held = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for part, row in zip(set_.column("part").to_pylist(), set_.column("set"), strict=True):
        held[part] = np.frombuffer(row.as_buffer(), np.uint8)
    return _Filter(sorted(many), bits, held.reshape(-1))


def _windows(text: str, ends: np.ndarray, filter_: _Filter, powers: np.ndarray, inverse: np.ndarray, step: int) -> Iterator[tuple[int, str]]:
    """number of the text (they are joined to one, and end there), window: those that the filter lets through."""
    for a in range(0, len(text) - filter_.lengths[0] + 1, step):
        codes = _codes(text[a : a + step + filter_.lengths[-1] - 1])
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers[: len(codes)], out=sums[1:])
        for m in filter_.lengths:
            n = min(step, len(codes) - m + 1)
            if n <= 0:
                break
            at = a + filter_.has((sums[m : m + n] - sums[:n]) * inverse[:n] + _kind(m))
            own = np.searchsorted(ends, at, "right")
            inside = at + m <= ends[own]
            yield from ((t, text[i : i + m]) for t, i in zip(own[inside].tolist(), at[inside].tolist(), strict=True))


def _candidates(rows: DataFrame, columns: list[str], filter_: _Filter) -> DataFrame:
    """row, column, value: windows of the rows' texts that may be values, once each."""
    held = rows.sparkSession.sparkContext.broadcast(filter_)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = held.value
        step = max(STEP, filter_.lengths[-1])
        powers = _powers(_BASE, step + filter_.lengths[-1])
        inverse = np.concatenate([np.ones(1, np.uint64), _powers(_INVERSE, step - 1)])
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                at = batch.column(0).slice(a, ROWS).to_numpy()
                for i, column in enumerate(columns, 1):
                    texts = [t or "" for t in batch.column(i).slice(a, ROWS).to_pylist()]
                    found = sorted(set(_windows("".join(texts), np.cumsum([len(t) for t in texts]), filter_, powers, inverse, step)))
                    if found:
                        row = at[[t for t, _ in found]]
                        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array([column] * len(found)), pa.array([v for _, v in found])], ["row", "column", "value"])

    return rows.mapInArrow(task, "row long, column string, value string")


def _searched(rows: DataFrame, columns: list[str], values: list[str]) -> DataFrame:
    name, held = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(values)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _automaton(name, held) if held.value else None
        for batch in batches if search else ():
            at = batch.column(0).to_pylist()
            for i, column in enumerate(columns, 1):
                out = []
                for row, text in zip(at, batch.column(i), strict=True):
                    if text.is_valid:
                        out += [(row, v) for v in sorted({v for _, v in search.iter(text.as_py())})]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([column] * len(out)), pa.array([v for _, v in out])], ["row", "column", "value"])

    return rows.mapInArrow(task, "row long, column string, value string")


def rows_by_value(table: DataFrame, marked: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """value, n_rows: in how many rows of the table each value is found; values that are not are left out."""
    values, found = _found(table, marked, text_columns(table), slice_bytes)
    rows = found.select("row", "value").distinct() if len(text_columns(table)) > 1 else found
    counts = rows.groupBy("value").agg(F.count("*").alias("n_rows"))
    return counts if values is None else counts.join(values, "value", "left_semi")
