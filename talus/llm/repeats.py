"""Periodic runs in texts by a vectorised scan of all lags over word ids.

A run is a stretch of consecutive words with smallest period q whose length is at
least ``max(12, 2 * q)`` and that no neighbouring word extends. For every lag
p up to half the words the array of word ids is compared with itself shifted by p.
A run of period p is a true stretch of at least ``need = max(p, 12 - p)`` places,
so it covers three places in a row out of every ``need // 3``: the scan compares
these first, and the places around agreeing ones are compared in full and coded by
run length. A stretch with a smaller period is found at that lag with the same ends,
so the smallest lag of each (start, length) is the period.

Texts are scanned many at a time, longest first, with ids that no two texts share,
so that a lag's comparison covers all texts long enough for it and no stretch leaves
its text. Texts of more than ``4 * lags`` bytes are dealt to tasks by ranges of lags;
their stretches are joined by (start, length) with partial minima. The runs of one
text, fewer than its words, meet in one row beside it.

Defined results: a null or blank text has no words, no runs and the digests of the
empty string; a null doc_id repeats nothing; repeated rows give a row each; texts are
taken whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.shared import stored
from talus.llm.subwords import text_chunks

RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@dataclass(frozen=True)
class RunRules:
    #: Least words of a run; it has two periods at least.
    least: int = 12
    #: Lags of one task's range; texts that may have more are dealt to several.
    lags: int = 16_384
    #: Bytes of texts scanned at a time, one text at least.
    chunk: int = 4_000_000


def planted(n: int, h: int) -> np.ndarray | None:
    """Places of the words that stand in for a text's n words: from word a on, period p is forced where h says so."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _stretch(ids: np.ndarray, at: int, p: int, m: int) -> tuple[int, int]:
    """The true stretch of lag p around place ``at``: from, to (places i with ids[i] == ids[i + p])."""
    end, size = at + 1, 64
    while end < m - p:
        differ = ids[end : min(end + size, m - p)] != ids[end + p : min(end + size, m - p) + p]
        k = int(differ.argmax()) if len(differ) else 0
        if len(differ) and differ[k]:
            end += k
            break
        end, size = end + len(differ), size * 4
    start, size = at, 64
    while start > 0:
        low = max(0, start - size)
        differ = ids[low:start] != ids[low + p : start + p]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, size = low, size * 4
    return start, end


def stretches(ids: np.ndarray, lengths: np.ndarray, least: int, low: int = 1, high: int | None = None) -> dict[tuple[int, int], int]:
    """(start, length) -> period of all runs in texts that lie one after another, longest first; ids of two texts differ.

    With bounds, only lags from low to high are compared, and the period is the smallest of these.
    """
    ends = np.cumsum(lengths)
    found: dict[tuple[int, int], int] = {}
    last = int(lengths[0]) // 2 if len(lengths) else 0
    for p in range(low, min(last, high or last) + 1):
        m = int(ends[np.searchsorted(-lengths, -2 * p, "right") - 1])  # words of the texts that have two periods
        need = max(p, least - p)
        step = max(1, need // 3)
        equal = ids[0 : m - p : step] == ids[p:m:step]
        hits = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:])
        done = 0
        for at in (hits * step).tolist():
            if at < done:
                continue
            start, done = _stretch(ids, at, p, m)
            if done - start >= need:
                found.setdefault((start, done - start + p), p)
    return found


def _coded(texts: list[tuple[bytes | None, int | None]]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of every text after planting, ids of the words, numbers of words. No two texts share an id."""
    words_of: list[list[bytes]] = []
    ids: list[int] = []
    base = 0
    lengths = np.zeros(len(texts), np.int64)
    parts = []
    for k, (text, h) in enumerate(texts):
        words = text.split() if text else []
        places = None if h is None else planted(len(words), h)
        if places is not None:
            words = [words[i] for i in places.tolist()]
        code: dict[bytes, int] = {}
        ids = [code.setdefault(w, len(code)) for w in words]
        parts.append(np.array(ids, np.int32) + base)
        base += len(code)
        lengths[k] = len(words)
        words_of.append(words)
    return words_of, np.concatenate(parts) if parts else np.zeros(0, np.int32), lengths


def _described(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """runs: start, length, period, in order of start and period."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    if runs:
        marks = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            marks[s + q] += 1
            marks[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]
    sha = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    return doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in RUNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def _whole(texts: DataFrame, rules: RunRules) -> DataFrame:
    """Texts whose lags are scanned in one task. texts: doc_id, h, text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in text_chunks(batch.column(2), rules.chunk):
                words, ids, lengths = _coded(list(zip(some, batch.column(1).slice(a, b - a).to_pylist(), strict=True)))
                order = np.argsort(-lengths, kind="stable")
                starts = np.cumsum(lengths) - lengths
                sorted_ids = np.concatenate([ids[starts[k] : starts[k] + lengths[k]] for k in order])
                placed = np.cumsum(lengths[order]) - lengths[order]
                runs: list[list] = [[] for _ in words]
                for (start, length), q in stretches(sorted_ids, lengths[order], rules.least).items():
                    k = int(np.searchsorted(placed, start, "right")) - 1  # texts without words come last
                    runs[order[k]].append((start - int(placed[k]), length, q))
                names = batch.column(0).slice(a, b - a).to_pylist()
                yield _batch([_described(d, w, sorted(r, key=lambda x: (x[0], x[2]))) for d, w, r in zip(names, words, runs, strict=True)])

    return texts.select("doc_id", "h", "text").mapInArrow(task, RUNS)


def _dealt(rows: DataFrame, rules: RunRules) -> DataFrame:
    """Long texts, scanned by ranges of lags. rows (stored): row, doc_id, h, text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, h, part = (batch.column(c)[i].as_py() for c in (0, 1, 3))
                _, ids, lengths = _coded([(batch.column(2)[i].as_py().encode(), h)])
                got = stretches(ids, lengths, rules.least, part * rules.lags + 1, (part + 1) * rules.lags) if lengths[0] else {}
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(got) if c == 0 else list(x), pa.int64()) for c, x in enumerate((row, [s for s, _ in got], [n for _, n in got], got.values()))], ["row", "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, h, text, runs = (batch.column(c)[i].as_py() for c in range(4))
                words, _, _ = _coded([(text.encode(), h)])
                yield _batch([_described(doc_id, words[0], sorted(((r["start"], r["length"], r["period"]) for r in runs or []), key=lambda x: (x[0], x[2])))])

    parts = F.ceil(F.octet_length("text") / (4 * rules.lags)).cast("int")  # two words take three bytes at least, so there are at most so many lags
    ranges = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("row", "h", "text", "part").repartition("row", "part")
    period = ranges.mapInArrow(scan, "row long, start long, length long, period long").groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    runs = period.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return rows.join(runs, "row", "left").select("doc_id", "h", "text", "runs").mapInArrow(finish, RUNS)


def periodic_runs(docs: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and digests of all runs and of the collapsed text, of every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("doc_id").cast("long").cast("string")).alias("h"), "text")
    long = F.coalesce(F.octet_length("text") > 4 * rules.lags, F.lit(False))
    rows = stored(texts.where(long).withColumn("row", F.monotonically_increasing_id()))
    return _whole(texts.where(~long), rules).unionByName(_dealt(rows, rules))


#: crc32 over the bytes of a string of ASCII characters.
_CRC = """xor(list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: Stretches of at least six equal words from six-word grams that a text has twice; their ends by gaps in their places.
ORACLE_SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
force AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS f, h // 10 AS g FROM doc),
place AS (SELECT r, doc_id, w, n, f, CASE WHEN f THEN g % n END AS a, CASE WHEN f THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM force),
word AS (SELECT r, i, w[CASE WHEN f AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS w FROM (SELECT *, unnest(range(n)) AS i FROM place)),
gram AS (SELECT r, i, hash(w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o) AS g FROM word WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY lead(w, 5) OVER o IS NOT NULL),
pair AS (SELECT x.r, x.i, y.i - x.i AS p FROM gram x JOIN gram y ON x.r = y.r AND x.g = y.g AND y.i > x.i),
island AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM pair),
stretch AS (SELECT r, p, min(i) AS s, max(i) - min(i) + 6 AS l FROM island GROUP BY r, p, k),
run AS (SELECT r, s, l + p AS len, min(p) AS q FROM stretch WHERE l >= p AND l + p >= 12 GROUP BY ALL),
best AS (SELECT r, count(*) AS n_runs, arg_min([s, len, q], (-len, s, q)) AS b, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b[1] AS BIGINT) AS start, CAST(b[2] AS BIGINT) AS length, CAST(b[3] AS BIGINT) AS period,
       CAST(1000 * b[2] // b[3] AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM place LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
