"""Text quality from overlapping heuristic labellers.

Nine labellers look at statistics of a whole text and vote good, bad or nothing.
Only the counts of vote patterns over all documents are needed (at most 3**9)
for expectation-maximisation, which estimates the share of good documents and,
for each labeller, how often its vote is good on good and on bad ones.
That gives each pattern's posterior. A linear scorer over hashed features
(trigrams of character kinds and letters, and steps of the statistics) is then
fitted to the posteriors on a bounded sample of rows (``sample_rows``), spread
by a hash over the whole table, and scores every document. ``labels`` are never
read; tests use them as held-out truth.

Defined results: a null, empty or blank text has score 0 and is rejected; a
table on which no labeller votes is kept as a whole; repeated rows have equal
scores; ties (a score of exactly ``keep``) stay; long texts are taken whole; an
empty table gives no rows; further columns are ignored, and in ``filtered``
kept.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.shingles import CACHE_WORDS, _cache
from talus.llm.shared import with_row
from talus.llm.subwords import in_chunks, text_chunks


@dataclass(frozen=True)
class QualityRules:
    #: Distinct texts that the scorer is fitted on, about; the largest of them, and bytes of all.
    sample_rows: int = 4000
    sample_text: int = 1 << 17
    sample_bytes: int = 1 << 26
    buckets: int = 1 << 14
    epochs: int = 12
    rate: float = 0.05
    #: Documents whose score is below this are rejected.
    keep: float = 0.5
    seed: int = 13


STATISTICS = ("words", "symbols", "capitals", "digits", "lone_symbols", "repeats", "distinct", "lines_again", "word_length", "short_words")

_UPPER, _LETTER, _DIGIT, _SPACE, _SYMBOL = range(5)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[128:] = _LETTER
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, STATISTICS), and the texts' bytes one after another with n + 1 offsets; each ends with a line feed."""
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    flat = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind = _KIND[flat]
    # capitals beyond A-Z that take two bytes: U+00C0 to U+00DE
    wide = np.zeros(len(flat), bool)
    wide[1:] = (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97)
    space = kind == _SPACE
    after_space = np.append(True, space[:-1])
    before_space = np.append(space[1:], True)
    start = ~space & after_space

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

    words, symbols, digits = count(start), count(kind == _SYMBOL), count(kind == _DIGIT)
    upper, lower = count(kind == _UPPER) + count(wide), count(kind == _LETTER)
    lone = count((kind == _SYMBOL) & after_space & before_space)
    short = np.zeros(len(flat), bool)
    begins, ends = np.flatnonzero(start), np.flatnonzero(~space & before_space)
    short[begins[ends - begins < 3]] = True
    some = np.maximum(words, 1)
    solid = np.maximum(np.diff(offsets) - count(space), 1)
    again, distinct, lines = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    for i, t in enumerate(texts):
        own = t.lower().split()
        h = np.fromiter(map(_cache.__getitem__, own), np.uint64, len(own))
        if len(h):
            again[i], distinct[i] = (h[1:] == h[:-1]).sum(), len(np.unique(h))
        full = [x for x in t.split(b"\n") if x.strip()]
        lines[i] = 1 - len(set(full)) / len(full) if full else 0
    # a few symbols or digits tell nothing of a short text
    symbols, digits = np.maximum(symbols - 3, 0), np.maximum(digits - 16, 0)
    out = np.stack([words, symbols / solid, upper / np.maximum(upper + lower, 1), digits / solid, lone / some, again / some, distinct / some, lines, solid / some, count(short) / some], 1)
    return out, flat, offsets


def votes(s: np.ndarray) -> np.ndarray:
    """(texts, labellers) of 1 good, -1 bad, 0 nothing."""
    c = dict(zip(STATISTICS, s.T, strict=True))

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0))

    many = c["words"] >= 20
    out = np.stack(
        [
            vote(c["symbols"] < 0.06, c["symbols"] > 0.1),
            vote(c["capitals"] < 0.1, c["capitals"] > 0.3),
            vote(c["digits"] < 0.05, c["digits"] > 0.3),
            vote(c["lone_symbols"] < 0.02, c["lone_symbols"] > 0.1),
            vote(c["repeats"] < 0.05, c["repeats"] > 0.15),
            vote(many & (c["distinct"] > 0.4), many & (c["distinct"] < np.where(c["words"] < 400, 0.3, 0.1))),
            vote((c["lines_again"] == 0) & (c["words"] > 60), c["lines_again"] > 0.3),
            vote((c["word_length"] > 3) & (c["word_length"] < 8), (c["word_length"] < 2.5) | (c["word_length"] > 12)),
            vote(many & (c["short_words"] > 0.1) & (c["short_words"] < 0.6), many & ((c["short_words"] < 0.02) | (c["short_words"] > 0.8))),
        ],
        1,
    ).astype(np.int8)
    out[c["words"] == 0] = -1
    return out


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """The share of good documents, and p(good vote | class, some vote) as (class bad/good, labeller), by expectation-maximisation.

    Nothing is learnt from a labeller that does not vote. To start with, a document
    with any bad vote is probably bad: each labeller sees the absence of one fault.
    """
    up, down = (patterns == 1).astype(np.float64), (patterns == -1).astype(np.float64)
    p = np.where(down.any(1), 0.1, 0.9)
    share, table = 0.5, np.full((2, patterns.shape[1]), 0.5)
    for _ in range(rounds):
        sides = np.stack([counts * (1 - p), counts * p])
        table = (sides @ up + 0.5) / (sides @ (up + down) + 1)
        share = (sides[1].sum() + 1) / (counts.sum() + 2)
        new = posterior(patterns, share, table)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """p(good | votes)."""
    table = np.clip(table, 1e-6, 1 - 1e-6)
    logs = (patterns == 1) @ np.log(table).T + (patterns == -1) @ np.log(1 - table).T
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1] + math.log(1 - share) - math.log(share), -30, 30)))


def hashed(s: np.ndarray, flat: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each byte's trigram, number of these of each text, and the (texts, statistics) buckets of the steps."""
    kind = _KIND[flat].astype(np.uint32)
    shape = np.where(kind == _UPPER, 1, np.where(kind == _DIGIT, 2, np.where(kind == _SPACE, 3, flat))).astype(np.uint32)
    x = np.zeros(len(flat), np.uint32)
    x[:-2] = shape[:-2] << 16 | shape[1:-1] << 8 | shape[2:]
    # what follows a text's line feed is no part of it: blanks stand for it
    last = offsets[1:] - 1
    x[last] = shape[last] << 16 | 0x0303
    last = last[np.diff(offsets) > 1]
    x[last - 1] = shape[last - 1] << 16 | shape[last] << 8 | 3
    bits = (buckets - 1).bit_length()
    grams = (x * np.uint32(2654435761)) >> np.uint32(32 - bits)
    steps = np.floor(np.log2(1 + np.maximum(s, 0) * np.where(np.array(STATISTICS) == "words", 1, 64))).astype(np.uint32)
    steps = ((steps + np.arange(len(STATISTICS), dtype=np.uint32) * 64 + 1) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return grams, np.diff(offsets), steps


def raw_scores(weights: np.ndarray, grams: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    means = np.add.reduceat(weights[grams], starts, dtype=np.float64) / sizes if len(sizes) else np.zeros(0)
    return weights[0] + 10 * means + weights[steps].sum(1)


def fit_scorer(texts: list[bytes], share: float, table: np.ndarray, rules: QualityRules) -> np.ndarray:
    """Weights of the hashed linear scorer, by logistic regression on the posteriors of the texts."""
    weights = np.zeros(rules.buckets, np.float32)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    targets: list[np.ndarray] = []
    for a, b in in_chunks(texts):
        s, flat, offsets = statistics(texts[a:b])
        grams, sizes, steps = hashed(s, flat, offsets, rules.buckets)
        targets.append(posterior(votes(s), share, table))
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(b - a):
            own, n = np.unique(grams[at[i] : at[i + 1]], return_counts=True)
            rows.append((np.concatenate([own, steps[i], [0]]), np.concatenate([10 * n / sizes[i], np.ones(steps.shape[1] + 1)]).astype(np.float32)))
    if not rows:
        return weights
    y = np.concatenate(targets)
    rng = np.random.default_rng(rules.seed)
    squares = np.full(rules.buckets, 1e-6, np.float32)
    for _ in range(rules.epochs):  # adaptive gradient steps
        for i in rng.permutation(len(rows)).tolist():
            at, value = rows[i]
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[at] @ value))))) - y[i]) * value
            np.add.at(squares, at, g * g)
            np.add.at(weights, at, -rules.rate * g / np.sqrt(squares[at]))
    return weights


def patterns_of(docs: DataFrame) -> DataFrame:
    """votes, n: counts of the vote patterns over all rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0)):
                got, n = np.unique(votes(statistics([t or b"" for t in texts])[0]), axis=0, return_counts=True)
                for v, k in zip(got, n.tolist(), strict=True):
                    total[v.tobytes()] = total.get(v.tobytes(), 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["votes", "n"])

    return docs.select("text").mapInArrow(task, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def labeller_model(docs: DataFrame) -> tuple[float, np.ndarray]:
    """Share of good documents and each labeller's vote table, from all rows."""
    got = patterns_of(docs).collect()  # at most 3**9 rows
    if not got:
        return 0.5, np.full((2, 9), 0.5)
    return accuracies(np.stack([np.frombuffer(r["votes"], np.int8) for r in got]), np.array([r["n"] for r in got], np.float64))


def trained(docs: DataFrame, rules: QualityRules = QualityRules()) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, vote tables, and the scorer's weights, which one task fits on the bounded sample.

    The sample are about ``sample_rows`` distinct texts, those of least hash, each once
    however often it occurs. Texts of more than ``sample_text`` bytes are not among
    them, and in order of hash it ends at ``sample_bytes``, so the task's size is bounded.
    """
    share, table = labeller_model(docs)
    key = F.xxhash64("text").bitwiseAND(F.lit(2**63 - 1))  # 63 bits
    n = docs.agg(F.approx_count_distinct(key)).first()[0]
    below = min(2**63 - 1, rules.sample_rows * 2**63 // max(1, n))
    some = docs.where((key <= F.lit(below)) & (F.octet_length("text") <= rules.sample_text)).select(key.alias("key"), "text")
    sample = some.groupBy("key").agg(F.min("text").alias("text"))  # repeats are merged in each task before the shuffle

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for _, text in sorted((k, t) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)):
            size += len(text)
            if size > rules.sample_bytes:
                break
            texts.append(text)
        to = io.BytesIO()
        np.save(to, fit_scorer(sorted(texts), share, table, rules))
        yield pa.RecordBatch.from_pydict({"weights": [to.getvalue()]}, schema=pa.schema([("weights", pa.binary())]))

    got = sample.repartition(1).mapInArrow(task, "weights binary").first()
    return share, table, np.load(io.BytesIO(got[0])) if got else np.zeros(rules.buckets, np.float32)


def _scored(rows: DataFrame, model: tuple[float, np.ndarray, np.ndarray], rules: QualityRules) -> DataFrame:
    """rows (any column ``row``, text) with weak_label, score and kept; the text goes."""
    share, table, weights = model

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column("text")):
                s, flat, offsets = statistics([t or b"" for t in texts])
                weak = posterior(votes(s), share, table)
                score = 1 / (1 + np.exp(-np.clip(raw_scores(weights, *hashed(s, flat, offsets, rules.buckets)), -30, 30)))
                score[s[:, 0] == 0] = 0.0
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(weak), pa.array(score), pa.array(score >= rules.keep)], ["row", "weak_label", "score", "kept"])

    schema = rows.select("row").schema.add("weak_label", "double").add("score", "double").add("kept", "boolean")
    return rows.select("row", "text").mapInArrow(task, schema)


ADDED = ("weak_label", "score", "kept")


def scored(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """weak_label (posterior of the labellers), score, kept of every row, and its columns; those of the same names are replaced."""
    own = docs.select(*[c for c in docs.columns if c.lower() not in ADDED])
    return _scored(with_row(own, text=F.col("text")), trained(docs, rules), rules).select("row.*", *ADDED)


def filtered(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs that are not rejected; docs' own columns as they are."""
    return _scored(with_row(docs, text=F.col("text")), trained(docs, rules), rules).where("kept").select("row.*")
