"""Benchmark passages in documents by Wu-Manber search over words.

A window is ten consecutive words of a benchmark item, or a whole item of fewer
words. Windows of one length form a set of test strings with tables of their own:
``shift`` holds, for each block of the last words looked at, how far the text can
be passed over without missing a window (a block or word that no window holds
skips most of a window); where it is 0, the block's bucket, keyed by block and the
window's first words, selects windows, and these are compared with the text word
by word. A document word inside any occurrence is hit.

The tables go to the tasks by a broadcast that is bounded in bytes whatever the
benchmark's size: its items are cut into pieces that overlap by a window less one
word, and the pieces are dealt to slices of at most about ``slice_bytes``. Documents
are searched slice by slice; with more than one, hit ranges and items found are
merged for each document. Documents are streamed batch by batch as whole texts.

Defined results: a null, empty or wordless text has no words and is not
contaminated; null or wordless items have no windows; an item without id marks
words, yet is neither counted nor listed; rows that share an item_id are one item;
repeated documents give a row each; an empty benchmark contaminates nothing;
further columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.shared import stored
from talus.llm.subwords import text_chunks

#: A-Z in lower case; every other ASCII character but letters and digits parts words.
_SPLIT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Words of one piece of a benchmark item.
PIECE_WORDS = 20_000

FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
PART = "row long, doc_id long, n_words long, ranges array<struct<a:long,b:long>>, items array<string>"
_TYPES = {
    "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
    "array<struct<a:long,b:long>>": pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])),
}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


@dataclass(frozen=True)
class LeakRules:
    window: int = 10
    #: Words of a block of the shift tables (of the whole window, if it is shorter).
    block: int = 3
    #: Bytes of benchmark text in one broadcast.
    slice_bytes: int = 2 << 20


@dataclass
class _Tables:
    """Shift and bucket tables of the windows of one length."""

    length: int
    block: int
    shift: dict[int, int] = field(default_factory=dict)
    #: (block code, first word, second word) -> [(window, its items)]
    buckets: dict[tuple[int, int, int], list[tuple[tuple[int, ...], set]]] = field(default_factory=dict)

    def add(self, window: tuple[int, ...], item, base: int) -> None:
        code = _code(window[self.length - self.block :], base)
        bucket = self.buckets.setdefault((code, window[0], window[-1] if self.length < 2 else window[1]), [])
        for known, items in bucket:
            if known == window:
                items.add(item)
                return
        bucket.append((window, {item}))
        for end in range(self.block, self.length + 1):
            block = _code(window[end - self.block : end], base)
            if self.shift.get(block, self.length) > self.length - end:
                self.shift[block] = self.length - end


def _code(block: tuple[int, ...], base: int) -> int:
    code = 0
    for word in reversed(block):
        code = code * base + word
    return code


class Searcher:
    """Finds the windows of pieces (item, words, whole) in lists of words."""

    def __init__(self, pieces: list[tuple[object, bytes]], rules: LeakRules):
        ids: dict[bytes, int] = {}
        coded = [(item, tuple(ids.setdefault(w, len(ids) + 1) for w in text.split())) for item, text in pieces]
        self._ids, self._base = ids, len(ids) + 1
        self._tables: dict[int, _Tables] = {}
        for item, words in coded:
            length = min(rules.window, len(words))
            if length:
                tables = self._tables.setdefault(length, _Tables(length, min(rules.block, length)))
                for i in range(len(words) - length + 1):
                    tables.add(words[i : i + length], item, self._base)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Ranges (from, to) of words in occurrences, in order and apart, and the items found."""
        ranges: list[tuple[int, int]] = []
        items: set = set()
        for tables in self._tables.values():
            self._scan(words, tables, ranges, items)
        return _merged(ranges), items

    def _scan(self, words: list[bytes], tables: _Tables, ranges: list[tuple[int, int]], items: set) -> None:
        length, width, base = tables.length, tables.block, self._base
        known, shift, buckets = self._ids.get, tables.shift.get, tables.buckets.get
        most, n, at = length - width + 1, len(words), length - 1
        while at < n:
            code, back = 0, 0
            while back < width and (word := known(words[at - back], 0)):
                code, back = code * base + word, back + 1
            if back < width:  # a word that no window holds: the next window begins behind it
                at += length - back
                continue
            step = shift(code, most)
            if step:
                at += step
                continue
            start = at - length + 1
            first = known(words[start], 0)
            second = known(words[at if length < 2 else start + 1], 0)
            bucket = buckets((code, first, second)) if first and second else None
            if bucket:
                here = tuple([known(w, 0) for w in words[start : at + 1]])
                for window, found in bucket:
                    if window == here:
                        items.update(found)
                        if ranges and ranges[-1][0] <= start <= ranges[-1][1]:
                            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], at + 1))
                        else:
                            ranges.append((start, at + 1))
                        break
            at += 1


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _row(doc_id, n_words: int, ranges: list[tuple[int, int]], items: set) -> tuple:
    hit = sum(b - a for a, b in ranges)
    named = sorted(str(i) for i in items if i is not None)
    return doc_id, n_words, hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), hit > 0


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def pieces_of(benchmark: DataFrame, rules: LeakRules) -> DataFrame:
    """item_id, words of every piece of the benchmark's items: its words joined by spaces."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                rows = []
                for item, text in zip(batch.column(0).slice(a, b - a).to_pylist(), texts, strict=True):
                    words = words_of(text or b"")
                    last = max(1, len(words) - rules.window + 1)  # where no window begins
                    rows += [(item, b" ".join(words[i : i + PIECE_WORDS + rules.window - 1])) for i in range(0, last if words else 0, PIECE_WORDS)]
                yield _batch(rows, "item_id string, words binary")

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(task, "item_id string, words binary").distinct()


def slices(benchmark: DataFrame, rules: LeakRules) -> list[DataFrame]:
    """Pieces in slices of about ``slice_bytes`` each."""
    pieces = stored(pieces_of(benchmark, rules).withColumn("bytes", F.octet_length("words").cast("long")))
    n = -(-(pieces.agg(F.sum("bytes")).first()[0] or 0) // rules.slice_bytes)
    part = F.pmod(F.xxhash64("words", "item_id"), F.lit(max(n, 1)))
    return [pieces.where(part == s).select("item_id", "words") for s in range(n)]


_searchers: dict[str, Searcher] = {}


def _searcher(name: str, held, rules: LeakRules) -> Searcher:
    """A slice's tables, built once in each Python worker; those of an earlier slice go."""
    if name not in _searchers:
        _searchers.clear()
        _searchers[name] = Searcher(held.value, rules)
    return _searchers[name]


def _searched(texts: DataFrame, pieces: DataFrame | None, rules: LeakRules, schema: str, output) -> DataFrame:
    """output(row, doc_id, n_words, ranges, items) -> a tuple of the schema, or None to leave the row out."""
    name, held = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast([tuple(r) for r in pieces.collect()] if pieces is not None else [])  # at most about slice_bytes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(name, held, rules)
        for batch in batches:
            for a, b, some in text_chunks(batch.column(2)):
                out = []
                for i, text in enumerate(some, a):
                    words = words_of(text or b"")
                    out.append(output(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(words), *search.find(words)))
                yield _batch([r for r in out if r is not None], schema)

    return texts.mapInArrow(task, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    parts = slices(benchmark, rules)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(parts) <= 1:
        return _searched(texts, parts[0] if parts else None, rules, FOUND, lambda row, doc_id, n, ranges, items: _row(doc_id, n, ranges, items))
    rows = stored(texts)
    every = stored(_searched(rows, parts[0], rules, PART, _part))  # every row, with its number of words
    for pieces in parts[1:]:
        every = every.unionByName(stored(_searched(rows, pieces, rules, PART, lambda *found: _part(*found) if found[3] else None)))

    def merge(group: pa.Table) -> pa.Table:
        ranges = [(r["a"], r["b"]) for some in group.column("ranges").to_pylist() for r in some]
        items = {i for some in group.column("items").to_pylist() for i in some}
        first = group.slice(0, 1).to_pylist()[0]
        return pa.Table.from_batches([_batch([_row(first["doc_id"], first["n_words"], _merged(ranges), items)], FOUND)])

    return every.groupBy("row").applyInArrow(merge, FOUND)


def _part(row: int, doc_id: int | None, n_words: int, ranges: list[tuple[int, int]], items: set) -> tuple:
    return row, doc_id, n_words, [{"a": a, "b": b} for a, b in ranges], [i for i in items if i is not None]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
one AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
gram AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
         FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc, (SELECT DISTINCT k FROM one) WHERE len(w) >= k)),
hit AS (SELECT r, i, gram.k, item_id FROM gram JOIN one ON gram.k = one.k AND gram.g = one.g),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN named USING (r)
"""
