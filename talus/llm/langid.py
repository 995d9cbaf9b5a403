"""Language identification with error-correcting output codes.

Each language has a codeword of bits, at most ``most_bits`` dichotomies of the
languages that keep the words far apart. A bit's classifier is a binary naive
Bayes over hashed character trigrams: a trigram's weight is the log odds
between the languages with the bit and those without, and a text's margin is
the mean weight of its trigrams, divided by what the hardest language reaches.
Decoding adds up each language's exponential loss over the bits, weighted by
how far apart the bit's two sides lie, takes the language of least loss and
flags texts whose two best languages are close.

Trigram counts cover all rows to learn from: each task counts by language and a
tree of sums adds the tasks' tables, which are bounded by languages times
``buckets``. Predictions see the text alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and ambiguous; without any language learnt all are ``und``; rows without
language or id teach nothing; repeated rows count and are predicted each; long
texts are taken whole; an empty table gives no rows; further columns, of
whatever names, are ignored by ``identify`` and kept by ``identified``; ties go to the first language in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.shared import stored, with_row
from talus.llm.subwords import text_chunks


@dataclass(frozen=True)
class LanguageRules:
    #: A power of two.
    buckets: int = 1 << 15
    most_bits: int = 31
    smoothing: float = 0.5
    #: Texts whose score is below this are ambiguous.
    least_score: float = 0.02
    tree: int = 64


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[: ord("a")] = 32
_PLAIN[ord("z") + 1 : 128] = 32


def _trigrams(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-case UTF-8 texts one after another, and n + 1 offsets; all but letters are blanks."""
    offsets = np.cumsum([0, *(len(t) + 3 for t in texts)])
    b = _PLAIN[np.frombuffer(b"".join([b" " + t + b"  " for t in texts]), np.uint8)].astype(np.uint32)
    x = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    h = (x * np.uint32(2654435761)) >> np.uint32(32 - (buckets - 1).bit_length())
    h[(b[:-2] == 32) & (b[1:-1] == 32)] = buckets - 1  # runs of blanks tell nothing; this bucket's weight is 0
    return np.append(h, np.full(2, buckets - 1, np.uint32)), offsets


def language_counts(rows: DataFrame, rules: LanguageRules) -> dict[str, np.ndarray]:
    """Trigram counts of each language over all rows (text in lower case, lang)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, texts in text_chunks(batch.column(0)):
                for lang in set(langs[a:b]):
                    h, _ = _trigrams([t for t, x in zip(texts, langs[a:b], strict=True) if x == lang], rules.buckets)
                    tables[lang] = tables.get(lang, 0) + np.bincount(h, minlength=rules.buckets)
        place = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([place] * len(tables), pa.int64()), pa.array(list(tables), pa.string()), pa.array([t.astype("<i8").tobytes() for t in tables.values()], pa.binary())], ["place", "lang", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in pdf["counts"])
        return pd.DataFrame({"place": pdf["place"].iloc[:1], "lang": pdf["lang"].iloc[:1], "counts": [total.tobytes()]})

    schema = "place long, lang string, counts binary"
    parts = stored(rows.mapInArrow(task, schema))
    places = (parts.agg(F.max("place")).first()[0] or 0) + 2
    while places > 1:
        parts = parts.withColumn("place", F.floor(F.col("place") / rules.tree)).groupBy("lang", "place").applyInPandas(add, schema)
        places = -(-places // rules.tree)
    return {r["lang"]: np.frombuffer(r["counts"], "<i8") for r in parts.collect()}  # languages times buckets


def codewords(n: int, most_bits: int, seed: int = 3) -> np.ndarray:
    """(n, bits) of 1 and -1. Up to 5 languages all dichotomies, else the draw with the farthest words."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if (1 << (n - 1)) - 1 <= most_bits:
        each = np.arange(1, 1 << (n - 1))
        return np.where(each[None, :] >> np.arange(n)[:, None] & 1, 1, -1).astype(np.int8)
    rng = np.random.default_rng(seed)
    bits = max(most_bits, 2 * (n - 1).bit_length())
    best, far = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code[0, code.sum(0) == n] = -1
        code[0, code.sum(0) == -n] = 1
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        least = int((apart + bits * np.eye(n, dtype=int)).min())
        if least > far:
            best, far = code, least
    return best


class Decoder:
    """Bits' classifiers and their decoding, from trigram counts of each language."""

    def __init__(self, counts: dict[str, np.ndarray], rules: LanguageRules):
        self.languages = sorted(counts)
        table = np.stack([counts[x] for x in self.languages]).astype(np.float64)
        table[:, -1] = 0
        p = (table + rules.smoothing) / (table + rules.smoothing).sum(1, keepdims=True)
        self.code = codewords(len(self.languages), rules.most_bits)
        up = self.code > 0
        mean = lambda side: (side.T.astype(float) @ p) / np.maximum(1, side.sum(0))[:, None]
        weight = np.log(np.maximum(mean(up), 1e-12)) - np.log(np.maximum(mean(~up), 1e-12)) if len(self.languages) > 1 else np.zeros((1, table.shape[1]))
        weight[:, -1] = 0
        reach = (p @ weight.T) * self.code  # a language's own margin of each bit
        least = np.maximum(reach.min(0), 0.05)
        self.trust = least / least.sum()
        self.weight = np.ascontiguousarray((weight / least[:, None]).T.astype(np.float32))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and the score of each row of margins."""
        if len(self.languages) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins))
        loss = np.exp(-np.clip(margins[:, None, :] * self.code[None], -6, 6)) @ self.trust
        two = np.partition(loss, 1, axis=1)[:, :2]
        return loss.argmin(1), (two[:, 1] - two[:, 0]) / (two[:, 1] + two[:, 0])


def _predicted(rows: DataFrame, decoder: Decoder | None, rules: LanguageRules) -> DataFrame:
    """rows (any column ``row``, text) with lang_pred, score and ambiguous; the text goes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score = np.full(n, "und", object), np.zeros(n)
            for a, _, texts in text_chunks(batch.column("text")) if decoder else ():
                some = np.flatnonzero([t is not None for t in texts])
                if not len(some):
                    continue
                best, score[a + some] = decoder.decode(np.concatenate([_margins(decoder, part, rules) for part in _parts([texts[i] for i in some])]))
                lang[a + some] = np.array(decoder.languages, object)[best]
            found = [pa.array(lang, pa.string()), pa.array(score), pa.array((lang == "und") | (score < rules.least_score))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *found], ["row", "lang_pred", "score", "ambiguous"])

    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return rows.select("row", F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")).alias("text")).mapInArrow(task, schema)


def _parts(texts: list[bytes], size: int = 500_000) -> Iterator[list[bytes]]:
    """Lists of texts of about so many bytes, one text at least."""
    own: list[bytes] = []
    held = 0
    for t in texts:
        if own and held + len(t) > size:
            yield own
            own, held = [], 0
        own.append(t)
        held += len(t)
    if own:
        yield own


def _margins(decoder: Decoder, texts: list[bytes], rules: LanguageRules, piece: int = 1_000_000) -> np.ndarray:
    """The bits' margins of each text; a long text's trigrams are weighed piece by piece."""
    h, offsets = _trigrams(texts, rules.buckets)
    if len(texts) > 1:
        sums = np.add.reduceat(decoder.weight[h], offsets[:-1], axis=0)
    else:
        sums = sum(decoder.weight[h[i : i + piece]].sum(0, keepdims=True, dtype=np.float64) for i in range(0, len(h), piece))
    told = np.add.reduceat((h != rules.buckets - 1).astype(np.int64), offsets[:-1])
    return sums / np.maximum(1, told)[:, None]


def learnt(docs: DataFrame, learn: Column, rules: LanguageRules = LanguageRules()) -> Decoder | None:
    """A decoder from the rows to learn from; none if they name no language."""
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = language_counts(rows.select(F.lower("text").alias("text"), "lang"), rules)
    return Decoder(counts, rules) if counts else None


def identify(docs: DataFrame, learn: Column, held_out: Column, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row of docs."""
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")).alias("row")
    found = _predicted(docs.select(own, "text"), learnt(docs, learn, rules), rules)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "ambiguous")


def identified(docs: DataFrame, learn: Column, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """The rows of docs that have a language, without those whose language is ambiguous; docs' own columns as they are."""
    return _predicted(with_row(docs, text=F.col("text")), learnt(docs, learn, rules), rules).where("NOT ambiguous").select("row.*")
