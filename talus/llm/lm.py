"""Language-model scores of whole texts: a count model and a self-attention model.

Texts are lower-cased in A-Z and split into words at white space; every text
ends with one end token. The base score is that of a count model over words
with one added to each count. The model's score is the log10 probability of the
text as a sequence of words, each under a mixture of four distributions:

- the attention model of ``attention.py`` over the word's subword ids, whose
  windows run over the whole text, times the probability that the word ends
  after its last id and not before, times that of its spelling;
- the count model; the mass that it leaves to unseen words is spread over them by
  their ids' overall frequencies;
- the words of the text so far, as often as they stand there;
- with ``byte_share``, bytes that are all equally likely.

Each of the four sums to at most 1 over all words, so the score is a
probability. The weights of the count model and of the text's own words begin at
``count_share`` and ``copy_share`` in each text and follow what it has shown so far: of the
words before, the share that each explains (with ``prior`` words' worth of the
beginning). They are renewed after 8 words, then after twice as many each time up to
``renew``; as they depend on earlier words alone, the product over a text's words stays a
probability. Spelling tells words apart that the tokenizer does not (it lowers
and composes letters): each code point is the usual one but for ``variant``.

Steps: (1) Every text is coded in blocks of bounded size: a block's distinct
words, sorted by a 64-bit hash, with their ids, and the texts as numbers of
these words. Later steps read blocks alone. (2) Neighbours of all ids in the
texts to learn from are counted and group the ids. (3) Pairs (state of the id
before, id), classes that follow each id and words' ends are counted. (4) The
attention layer is trained: tasks run over their blocks, and what they learnt is
averaged. (5) Word counts of all blocks are summed by range of the hash, and each
block gets back the counts of its own words. (6) Blocks are scored. Tables of
tasks are summed by a tree. So all rows to learn from count in each step, and
none holds more than a block, a range of hashes or one table whose size the
vocabulary and the rules bound.

Defined results: a null or empty text holds the end alone; a row without id is
not held out and nothing is learnt from it; repeated rows are counted and
scored each; an empty table gives no rows; further columns are ignored; long
texts are scored whole, as each block takes at least one text. Two words with
equal 64-bit hashes share their count.
"""

from __future__ import annotations

import io
import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.attention import AttentionRules, Model, arrays, averaged, back_to_back, class_logs, grouped, train, training_windows, weighted, with_direct
from talus.llm.shared import stored
from talus.llm.subwords import encoder


@dataclass(frozen=True)
class LMRules:
    attention: AttentionRules = field(default_factory=AttentionRules)
    #: Shares of the count model and of the text's own words (at its beginning), and of the bytes in a word's probability.
    count_share: float = 0.45
    copy_share: float = 0.1
    byte_share: float = 1e-6
    #: Words for which the beginning share counts, and most words between renewals of the share. 0: it is never renewed.
    prior: float = 8.0
    renew: int = 64
    #: Probability that a code point is none of the lower-case, composed ones that ids stand for; one of 64 others.
    variant: float = 2.0**-10
    #: Bytes of text after which a block ends, and its distinct words after which it ends.
    block_bytes: int = 8_000_000
    block_words: int = 250_000
    #: Entries (word, block), about, whose counts are summed in one group.
    group_entries: int = 1_500_000
    #: Tables that one group of a tree of sums adds up, and the keys of one table.
    tree: int = 64
    table_keys: int = 1_000_000


END_TOKEN = "<|endoftext|>"
#: Cached words of a coding task: blocks share almost half of theirs, and two blocks' words have to fit.
CACHE_WORDS = 500_000


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _end_id(path: str) -> int:
    return encoder(path, CACHE_WORDS)._tokenizer.token_to_id(END_TOKEN)


def _vocabulary(path: str) -> int:
    return encoder(path, CACHE_WORDS)._tokenizer.get_vocab_size()


def _save(model: Model) -> bytes:
    to = io.BytesIO()
    np.savez(to, **arrays(model))
    return to.getvalue()


def _load(raw: bytes) -> Model:
    with np.load(io.BytesIO(raw)) as z:
        return Model(**{k: z[k] for k in z.files})


# ---- tables that are summed over all tasks

_TABLE = "place long, part int, keys binary, counts binary"


def _table_rows(table: np.ndarray, rules: LMRules) -> Iterator[pa.RecordBatch]:
    """A task's vector as rows, one for each range of keys that has any."""
    place = TaskContext.get().partitionId()
    for part, at in enumerate(range(0, len(table), rules.table_keys)):
        keys = at + np.flatnonzero(table[at : at + rules.table_keys])
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([part], pa.int32()), pa.array([_packed(keys)], pa.binary()), pa.array([_packed(table[keys].astype("<f8"))], pa.binary())], ["place", "part", "keys", "counts"])


def summed(tables: DataFrame, rules: LMRules) -> DataFrame:
    """The sums of all tasks' vectors, a row for each range of keys, by a tree."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, inverse = np.unique(np.concatenate([_unpacked(x, "<i8") for x in pdf["keys"]]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([_unpacked(x, "<f8") for x in pdf["counts"]]))
        return pd.DataFrame({"place": pdf["place"].iloc[:1], "part": pdf["part"].iloc[:1], "keys": [_packed(keys)], "counts": [_packed(counts)]})

    tables = stored(tables)
    tasks = (tables.agg(F.max("place")).first()[0] or 0) + 1
    while tasks > 1:
        tables = tables.withColumn("place", F.floor(F.col("place") / rules.tree)).groupBy("place", "part").applyInPandas(add, _TABLE)
        tasks = -(-tasks // rules.tree)
    return tables


def dense(tables: DataFrame, size: int) -> np.ndarray:
    """The summed vector on the driver; the rules and the vocabulary bound its size."""
    out = np.zeros(size)
    for r in tables.select("keys", "counts").collect():
        out[_unpacked(r["keys"], "<i8")] = _unpacked(r["counts"], "<f8")
    return out


# ---- coding


class _Numbers:
    """Words of texts as numbers in order of appearance: Arrow tells apart a range's words, then those of all ranges."""

    def __init__(self):
        self._known, self._new = pa.array([], pa.string()), []  # distinct words; of later ranges: own distinct words, numbers of these
        self._codes: list[np.ndarray] = []
        self._most = 0

    def add(self, texts: pa.Array) -> np.ndarray:
        """Take in the texts' words between ASCII white space, A-Z in lower case; words of each text."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten()
        some = pc.not_equal(words, "")  # white space at a text's ends leaves an empty one
        before = np.append(0, np.cumsum(np.asarray(some)))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        told = words.filter(some).dictionary_encode()
        self._new.append((told.dictionary, told.indices.to_numpy()))
        self._most += len(told.dictionary)
        return np.diff(before[ends], prepend=0).astype(np.int64)

    def _settle(self) -> None:
        told = pa.concat_arrays([self._known, *(words for words, _ in self._new)]).dictionary_encode()
        number, at = told.indices.to_numpy().astype(np.int64), len(self._known)
        for words, codes in self._new:
            self._codes.append(number[at : at + len(words)][codes])
            at += len(words)
        self._known, self._new, self._most = told.dictionary, [], len(told.dictionary)

    def as_many_as(self, n: int) -> bool:
        """Whether there are n distinct words; ranges are put together only where they could make so many."""
        if self._most >= n:
            self._settle()
        return self._most >= n

    def all(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, and all words as numbers of these."""
        self._settle()
        return self._known, np.concatenate([np.zeros(0, np.int64), *self._codes])


def _listed(words: pa.Array) -> list:
    """Words without white space as a list; as_py() of one string is faster than that of each word."""
    if not len(words):
        return []
    mark = "\n" if pa.types.is_string(words.type) else b"\n"
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(mark, words.type))[0].as_py().split(mark)


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of texts; all texts' words as numbers of these; words of each text."""
    index = _Numbers()
    lengths = index.add(texts)
    distinct, codes = index.all()
    return _listed(distinct), codes, lengths


def unusual(word: str) -> int:
    """Code points that are none of those that the word's ids stand for: capitals, marks to be composed, blanks, special tokens."""
    if word.isascii():
        return word.count("<|")
    if word == word.lower() and unicodedata.is_normalized("NFC", word) and word.split() == [word]:  # no blank in it
        return word.count("<|")
    return max(1, word.count("<|") + sum(1 for c in word if c != c.lower() or c.isspace() or unicodedata.combining(c)))


def all_unusual(words: pa.Array) -> np.ndarray:
    """``unusual`` of each word."""
    out = pc.count_substring(words, "<|").to_numpy().astype(np.int64)
    other = np.flatnonzero(~np.asarray(pc.string_is_ascii(words)))
    out[other] = [unusual(w) for w in _listed(words.take(pa.array(other)))]
    return out


def _expand(codes: np.ndarray, ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The ids of words given by number."""
    n = lens[codes]
    ends = np.cumsum(n)
    return ids[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


_BLOCK = "block long, n long, n_words long, hashes binary, counts binary, docs binary, codes binary, ids binary, lens binary, spelling binary"


def coded_blocks(docs: DataFrame, path: str, rules: LMRules) -> DataFrame:
    """One row for each block. docs: doc_id, text, held_out, learn."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        encode = encoder(path, CACHE_WORDS)
        kind = np.uint16 if _vocabulary(path) <= 65536 else np.uint32
        number = TaskContext.get().partitionId() << 32
        index, held, size = _Numbers(), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal index, held, size, number
            words, codes = index.all()
            raw = _listed(words.cast(pa.binary()))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(words))
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            ids, offsets = encode.encode_words(raw)
            lens = np.diff(offsets)
            sizes, points = (f(words).to_numpy().astype(np.int64) for f in (pc.binary_length, pc.utf8_length))
            odd = all_unusual(words)
            spelling = np.maximum(points - odd, 0) * math.log10(1 - 2 * rules.variant) + odd * math.log10(rules.variant / 64)
            doc, flags, lengths = (np.concatenate([h[i] for h in held]) for i in range(3))
            learn = np.bincount(codes[np.repeat(flags >= 4, lengths)], minlength=len(words))
            sorted_ids = _expand(order, ids, offsets[:-1], lens)
            columns = [hashes[order], learn[order], np.concatenate([doc, flags, lengths]), rank[codes], sorted_ids.astype(kind), np.concatenate([lens[order], sizes[order]]).astype(np.uint32), spelling[order].astype(np.float32)]
            row = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(doc)], pa.int64()), pa.array([len(words)], pa.int64()), *[pa.array([_packed(c)], pa.binary()) for c in columns]], [c.split(" ")[0] for c in _BLOCK.split(", ")]
            )
            number += 1
            index, held, size = _Numbers(), [], 0
            return row

        for batch in batches:
            doc, null = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            out, learns = (batch.column(c).fill_null(False).to_numpy(zero_copy_only=False) for c in ("held_out", "learn"))
            flags = out + 2 * null.astype(np.int64) + 4 * learns
            column = batch.column("text")
            bytes_of = pc.fill_null(pc.binary_length(column), 0).to_numpy()
            for a, b in text_ranges(bytes_of):
                held.append((doc[a:b], flags[a:b], index.add(column.slice(a, b - a))))
                size += int(bytes_of[a:b].sum())
                if size >= rules.block_bytes or index.as_many_as(rules.block_words):
                    yield flush()
        if held:
            yield flush()
        encode.forget()

    return docs.select("doc_id", "text", "held_out", "learn").mapInArrow(task, _BLOCK)


def text_ranges(sizes: np.ndarray, size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes, one text at least."""
    before = np.concatenate([[0], np.cumsum(sizes.astype(np.int64) + 1)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(before, before[a] + size, "right")) - 1)
        yield a, b
        a = b


class Block:
    """A coded block: texts (doc, flags, words in each) and words (ids, bytes, count) by number; the last word is the texts' end."""

    def __init__(self, r: dict, path: str):
        self._path = path
        k, docs, lens = r["n"], _unpacked(r["docs"], "<i8"), _unpacked(r["lens"], "<u4").astype(np.int64)
        n = len(lens) // 2
        self.doc, self.flags, self.lengths = docs[:k], docs[k : 2 * k], docs[2 * k :]
        self.codes, self.end = _unpacked(r["codes"], "<u4"), n
        self.ids = np.append(_unpacked(r["ids"], "<u2" if _vocabulary(path) <= 65536 else "<u4"), _end_id(path)).astype(np.int32)
        self.lens, self.sizes = np.append(lens[:n], 1), lens[n:]
        self.starts = np.cumsum(self.lens) - self.lens

    def closed(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Texts (their words as numbers, words in each) with the end after each."""
        return np.insert(codes, np.cumsum(lengths), self.end).astype(np.int64)

    def to_learn(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of the texts to learn from, each with its end, and how often each word occurs in these."""
        learn = self.flags >= 4
        words = self.closed(self.codes[np.repeat(learn, self.lengths)], self.lengths[learn])
        return words, np.bincount(words, minlength=len(self.lens))

    def expand(self, words: np.ndarray) -> np.ndarray:
        return _expand(words, self.ids, self.starts, self.lens)

    def pairs(self, words: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id before, the id, and how often, over all places: within words by the words' counts, between words one by one."""
        words = words[self.lens[words] > 0]
        last = np.append(self.end, words[:-1])[: len(words)]  # texts end with the end, so it comes before the first one
        ids, ends = self.ids, np.cumsum(self.lens)
        inner = np.ones(len(ids), bool)
        inner[self.starts[self.lens > 0]] = False
        inside = np.flatnonzero(inner)
        times = np.repeat(count, self.lens)[inside]
        some = times > 0
        inside, times = inside[some], times[some]
        return np.concatenate([ids[ends[last] - 1], ids[inside - 1]]), np.concatenate([ids[self.starts[words]], ids[inside]]), np.concatenate([np.ones(len(words), np.int64), times])

    def windows(self, words: np.ndarray, every: int, phase: float, width: int) -> np.ndarray:
        """ids (windows, width) of the training windows of the texts, the end before the first; at the stream's end they go on at its beginning."""
        words = np.append(self.end, words[self.lens[words] > 0])
        last = np.cumsum(self.lens[words])
        sizes = np.diff(last[words == self.end])
        if not len(sizes):
            return np.zeros((0, width), np.int32)
        at = training_windows(sizes, phase, every)
        first = np.searchsorted(last, at, "right")
        own = words[(first[:, None] + np.arange(width)) % len(words)]
        ids, total = self.expand(own.ravel()), self.lens[own].sum(1)
        return ids[(np.cumsum(total) - total + at - last[first] + self.lens[own[:, 0]])[:, None] + np.arange(width)]

    def tiled(self, words: np.ndarray, part: int, parts: int, width: int) -> np.ndarray:
        """ids (windows, width + 1) of every ``parts``-th window of the texts' ids, from window ``part``: width ids each and the one before.

        Over all parts each id comes after another in one window; the last window goes on at the stream's beginning.
        """
        ids = np.append(_end_id(self._path), self.expand(words))
        at = back_to_back(part, parts, len(ids) - 1, width)
        return np.lib.stride_tricks.sliding_window_view(np.append(ids, np.resize(ids, width)), width + 1)[at]


def over_blocks(blocks: DataFrame, path: str, rules: LMRules, table: Callable[[Iterator[tuple[int, Block]]], np.ndarray]) -> DataFrame:
    """The tables of all tasks: table gives a task's vector from its blocks, which it takes one at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows))
        yield from _table_rows(table((r["block"], Block(r, path)) for r in rows), rules)

    return blocks.select("block", "n", "docs", "codes", "ids", "lens").mapInArrow(task, _TABLE)


def id_counts(blocks: DataFrame, path: str, rules: LMRules) -> DataFrame:
    """Table of how often each id occurs, then of how often it ends a word."""
    v = _vocabulary(path)

    def table(own: Iterator[tuple[int, Block]]) -> np.ndarray:
        out = np.zeros(2 * v, np.int64)
        for _, b in own:
            _, count = b.to_learn()
            np.add.at(out, b.ids, np.repeat(count, b.lens))
            some = np.flatnonzero(b.lens[:-1])
            np.add.at(out, v + b.ids[b.starts[some] + b.lens[some] - 1], count[some])
        return out

    return over_blocks(blocks, path, rules, table)


def neighbours(blocks: DataFrame, path: str, count: np.ndarray, rules: LMRules) -> DataFrame:
    """Table over (id, side, frequent id): how often each frequent id stands before and after each id."""
    v, k = len(count), rules.attention.neighbours
    place = np.full(v, -1, np.int64)
    top = np.argsort(-count, kind="stable")[:k]
    place[top] = np.arange(len(top))

    def table(own: Iterator[tuple[int, Block]]) -> np.ndarray:
        out = np.zeros(v * 2 * k, np.int32)
        for _, b in own:
            before, ids, times = b.pairs(*b.to_learn())
            for side, x, of in ((0, before, ids), (k, ids, before)):
                at = place[x]
                some = np.flatnonzero(at >= 0)
                np.add.at(out, of[some].astype(np.int64) * 2 * k + side + at[some], times[some].astype(np.int32))
        return out

    return over_blocks(blocks, path, rules, table)


def grouped_ids(near: DataFrame, count: np.ndarray, rules: LMRules) -> Model:
    """The untrained model, its ids grouped in one task from the summed table."""
    width = 2 * rules.attention.neighbours

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(len(count) * width, np.float32)
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table[_unpacked(keys, "<i8")] = _unpacked(counts, "<f8")
        yield pa.RecordBatch.from_pydict({"model": [_save(grouped(count, table.reshape(len(count), width), rules.attention))]}, schema=pa.schema([("model", pa.binary())]))

    got = near.select("keys", "counts").repartition(1).mapInArrow(task, "model binary").first()
    return _load(got[0]) if got else grouped(count, np.zeros((len(count), width), np.float32), rules.attention)


def corpus_counts(blocks: DataFrame, path: str, model: Model, rules: LMRules) -> DataFrame:
    """Table of (state of the id before, id), then (row of the id before, class)."""
    a, v, raw = rules.attention, _vocabulary(path), _save(model)

    def table(own: Iterator[tuple[int, Block]]) -> np.ndarray:
        m = _load(raw)
        out = np.zeros(a.states * v + a.rows * a.classes, np.int64)
        state, row = m.state.astype(np.int64) * v, a.states * v + m.row.astype(np.int64) * a.classes
        for _, b in own:
            before, ids, times = b.pairs(*b.to_learn())
            np.add.at(out, state[before] + ids, times)
            np.add.at(out, row[before] + m.cls[ids], times)
        return out

    return over_blocks(blocks, path, rules, table)


def trained(blocks: DataFrame, path: str, model: Model, turn: int, rules: LMRules) -> Model:
    """The model after one round: every task trains a copy on the round's windows of its blocks, and the copies are averaged.

    The rounds share out the windows, which stand back to back, so over all rounds every id is trained on.
    """
    a, raw = rules.attention, _save(model)

    def table(own: Iterator[tuple[int, Block]]) -> np.ndarray:
        m = _load(raw)

        def batches() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for number, b in own:
                rng, words = np.random.default_rng([a.seed, turn, number]), b.to_learn()[0]
                if a.every:
                    ids = rng.permutation(b.windows(words, a.every, rng.random(), a.window + 1))
                else:
                    ids = rng.permutation(b.tiled(words, turn, a.rounds, a.window))
                for i in range(0, len(ids), a.batch):
                    some = ids[i : i + a.batch]
                    yield m.row[some[:, :-1]], m.cls[some[:, 1:]]

        return weighted(*train(m, batches(), a))

    size = 1 + a.rows + 3 * a.rows * a.dims + a.window + a.dims * a.classes
    total = dense(summed(over_blocks(blocks, path, rules, table), rules), size)
    return averaged(model, total) if total[0] else model


def word_counts(blocks: DataFrame, rules: LMRules) -> DataFrame:
    """block, part, counts (of the block's words in the part's range of hashes, in order), words and tokens (of the part: once each)."""
    parts = max(1, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // rules.group_entries))
    edges = (np.arange(1, parts, dtype=object) * (2**64) // parts).astype(np.uint64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "hashes", "counts")), strict=True):
                hashes, counts = _unpacked(a, "<u8"), _unpacked(b, "<i8")
                part = np.searchsorted(edges, hashes, "right")
                first = np.flatnonzero(np.diff(part, prepend=-1)).tolist()  # of the parts that the block has words of
                last = [*first[1:], len(part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[first], pa.int32()), pa.array([block] * len(first), pa.int64()), *[pa.array([x[i:j].tobytes() for i, j in zip(first, last, strict=False)], pa.binary()) for x in (hashes, counts)]],
                    ["part", "block", "hashes", "counts"],
                )

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["hashes"]])
        counts = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["counts"]])
        distinct, inverse = np.unique(hashes, return_inverse=True)
        sums = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype("<i8")
        back = sums[inverse]
        ends = np.cumsum([len(x) // 8 for x in pdf["hashes"]]).tolist()
        once = [1] + [0] * (len(pdf) - 1)
        return pd.DataFrame(
            {
                "block": pdf["block"], "part": pdf["part"], "counts": [_packed(back[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)],
                "words": [int((sums > 0).sum()) * x for x in once], "tokens": [int(sums.sum()) * x for x in once],
            }
        )

    by_part = blocks.select("block", "hashes", "counts").mapInArrow(dealt, "part int, block long, hashes binary, counts binary")
    return by_part.groupBy("part").applyInPandas(total, "block long, part int, counts binary, words long, tokens long")


class WordModel:
    """Probabilities of words: of their ids in context, of their ends, and of unseen ones."""

    def __init__(self, model: Model, counts: np.ndarray, ids: np.ndarray, end: int, rules: LMRules):
        """counts: the vector of corpus_counts; ids: that of id_counts."""
        a = rules.attention
        ids, last = ids[: len(ids) // 2], ids[len(ids) // 2 :]
        self.model, self._rules, self._v, self._end = model, rules, len(ids), end
        table = counts[: a.states * self._v].reshape(a.states, self._v)
        single = table.sum(0) + 0.05
        single /= np.bincount(model.cls, weights=single, minlength=a.classes)[model.cls]
        logs = np.empty(table.shape, np.float32)
        for state, seen in enumerate(table):
            sums = np.bincount(model.cls, weights=seen, minlength=a.classes)[model.cls]
            logs[state] = np.log10((seen + a.prior * single) / (sums + a.prior))
        self._logs = logs.ravel()
        stop = (last + 0.5) / (ids + 1.0)
        self._stop, self._more = (np.log10(np.clip(p, 1e-9, 1 - 1e-9)) for p in (stop, 1 - stop))
        self._alone = np.log10((ids + 0.05) / (ids.sum() + 0.05 * self._v))

    def pair_logs(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 p(id | its class, state of the id before)."""
        return self._logs[self.model.state[before].astype(np.int64) * self._v + ids]

    def id_logs(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 p(id | ids before it in its text)."""
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[starts[lengths > 0]] = self._end
        return class_logs(self.model, ids, starts, lengths, self._end, self._rules.attention) / math.log(10) + self.pair_logs(before, ids)

    def end_logs(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """log10 of the probability that words of these ids end after their last one and not before."""
        total = np.concatenate([[0.0], np.cumsum(self._more[ids])])
        last = np.cumsum(lens)
        inner = total[np.maximum(last - 1, 0)] - total[last - lens]
        return np.where(lens > 0, inner + np.append(self._stop[ids], 0.0)[np.minimum(np.maximum(last - 1, 0), len(ids))], 0.0)

    def unseen_logs(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """log10 of words' probabilities by their ids' overall frequencies and their ends; words without ids have none."""
        total = np.concatenate([[0.0], np.cumsum(self._alone[ids])])
        last = np.cumsum(lens)
        return np.where(lens > 0, total[last] - total[last - lens] + self.end_logs(ids, lens), -np.inf)


def copied(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of the words before each one in its text, the share that are the same; 0 for a text's first."""
    text = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(text))
    bits = len(text).bit_length()
    key = np.sort((words.astype(np.int64) << bits) | place)  # by word, then place: one text's stand together
    order, w = key & ((1 << bits) - 1), key >> bits
    t = text[order]
    first = np.maximum.accumulate(np.where(np.append(True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])) if len(order) else place, place, 0))
    same = np.empty(len(order))
    same[order] = place - first
    return same / np.maximum(1, place - starts[text])


def text_logs(models: list[np.ndarray], bytewise: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rules: LMRules) -> np.ndarray:
    """Logarithm of each text's probability from those of its words under attention, counts and copies, and bytes; texts hold a word at least."""
    out, order = np.zeros(len(starts)), np.argsort(-lengths, kind="stable")
    falling = -lengths[order]
    begin = np.array([1 - rules.count_share - rules.copy_share, rules.count_share, rules.copy_share])
    told, words = np.tile(rules.prior * begin, (len(starts), 1)), np.full(len(starts), rules.prior)
    at, size, most = 0, 8 if rules.renew else int(lengths.max(initial=0)), int(lengths.max(initial=0))
    while at < most:
        own = order[: np.searchsorted(falling, -at)]  # texts of more than so many words
        n = np.minimum(lengths[own] - at, size)
        first = np.cumsum(n) - n
        i = np.repeat(starts[own] + at - first, n) + np.arange(int(n.sum()))
        share = (1 - rules.byte_share) * told[own] / words[own, None]
        parts = [np.repeat(share[:, m], n) for m in range(len(models))]
        for part, p in zip(parts, models, strict=True):
            part *= p.take(i)
        whole = bytewise.take(i)
        whole *= rules.byte_share
        for part in parts:
            whole += part
        out[own] += np.add.reduceat(np.log(whole), first)
        for m, part in enumerate(parts):
            part /= whole
            told[own, m] += np.add.reduceat(part, first)
        words[own] += n
        at, size = at + size, min(2 * size, rules.renew or size)
    return out


def _scored(word_model: Callable[[], WordModel], path: str, n: int, v: int, ends: int, rules: LMRules):
    def block_rows(r: dict, model: WordModel) -> pa.RecordBatch:
        b, end, k = Block(r, path), _end_id(path), r["n"]
        own = [_unpacked(x["counts"], "<i8") for x in sorted(r["own"] or [], key=lambda x: x["part"])]
        count = np.concatenate([*own, [ends]]).astype(np.int64)
        single = (count + 1.0) / (n + v + 1.0)
        spelling = np.append(_unpacked(r["spelling"], "<f4"), math.log10(1 - 2 * rules.variant))
        stops = model.end_logs(b.ids, b.lens) + spelling
        counted = np.where(count > 0, single, single * 10.0 ** (model.unseen_logs(b.ids, b.lens) + spelling))
        counted[-1], stops[-1] = single[-1], spelling[-1]
        bytewise = np.append(257.0 ** -(b.sizes + 1.0), 0.0)
        log_single, seen = np.log10(single), (count > 0).astype(np.int64)
        base, score, known = np.zeros(k), np.zeros(k), np.zeros(k, np.int64)
        first = np.cumsum(b.lengths) - b.lengths
        at = 0
        while at < k:  # as many texts at a time as make some ten thousand words
            to = max(at + 1, int(np.searchsorted(first, first[at] + 50_000)))
            words = b.closed(b.codes[first[at] : first[to - 1] + b.lengths[to - 1]], b.lengths[at:to])
            text = np.cumsum(b.lengths[at:to] + 1) - b.lengths[at:to] - 1  # each one's first word
            ids, lens = b.expand(words), b.lens[words]
            sizes = np.add.reduceat(lens, text)
            logs = model.id_logs(ids, np.cumsum(sizes) - sizes, sizes)
            sums = np.add.reduceat(np.append(logs, 0.0), np.cumsum(lens) - lens, dtype=np.float64)
            sums = np.where(lens > 0, sums + stops[words], -np.inf)
            score[at:to] = text_logs([np.exp(sums * math.log(10)), counted[words], copied(words, text, b.lengths[at:to] + 1)], bytewise[words], text, b.lengths[at:to] + 1, rules) / math.log(10)
            base[at:to] = np.add.reduceat(log_single[words], text)
            known[at:to] = np.add.reduceat(seen[words], text)
            at = to
        return pa.RecordBatch.from_arrays(
            [pa.array(b.doc, mask=b.flags % 4 >= 2), pa.array(b.flags % 2 == 1), pa.array(b.lengths + 1), pa.array(known), pa.array(np.full(k, n)), pa.array(base), pa.array(score)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_model()
        for batch in batches:
            for i in range(batch.num_rows):
                yield block_rows(batch.slice(i, 1).to_pylist()[0], model)

    return task


def fitted(blocks: DataFrame, path: str, rules: LMRules) -> tuple[Model, np.ndarray, np.ndarray]:
    """The trained attention layer, the corpus's counts and those of ids, from the texts to learn from in all blocks."""
    a, v = rules.attention, _vocabulary(path)
    ids = dense(summed(id_counts(blocks, path, rules), rules), 2 * v)
    model = grouped_ids(summed(neighbours(blocks, path, ids[:v], rules), rules), ids[:v], rules)
    counts = dense(summed(corpus_counts(blocks, path, model, rules), rules), a.states * v + a.rows * a.classes)
    model = with_direct(model, counts[a.states * v :].reshape(a.rows, a.classes))
    for turn in range(a.rounds):
        model = trained(blocks, path, model, turn, rules)
    return model, counts, ids


def score(docs: DataFrame, path: str, learn: Column, held_out: Column, rules: LMRules = LMRules()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. learn: the rows to learn from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learn"))
    ends = rows.where("learn").count()
    blocks = stored(coded_blocks(rows, path, rules))
    model, corpus, ids = fitted(blocks, path, rules)
    counts = stored(word_counts(blocks, rules))
    v, n = counts.agg(F.sum("words"), F.sum("tokens")).first()
    own = counts.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("own"))  # of one block: bounded
    texts = blocks.select("block", "n", "docs", "codes", "ids", "lens", "spelling").join(own, "block", "left")
    keys = np.flatnonzero(corpus)
    raw, size, packed = _save(model), len(corpus), (_packed(keys), _packed(corpus[keys]))
    end = _end_id(path)

    def word_model() -> WordModel:
        table = np.zeros(size)
        table[_unpacked(packed[0], "<i8")] = _unpacked(packed[1], "<f8")
        return WordModel(_load(raw), table, ids, end, rules)

    task = _scored(word_model, path, (n or 0) + ends, (v or 0) + int(ends > 0), ends, rules)
    return texts.mapInArrow(task, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
