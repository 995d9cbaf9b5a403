"""Order-preserving packing of documents into sequences of bounded length.

Each task runs over its own documents in order, in segments of bounded length.
Within a segment, cuts may fall at a document's end (free), at a sentence's
end (a small penalty) or inside a sentence (a larger one). Dynamic programming
over these cut points minimises padding plus penalties:

    best[i] = min over j with at[i] - at[j] <= size of best[j] + size - (at[i] - at[j]) + penalty[i]

As best[j] + at[j] is all that depends on j, a monotone queue holds the
minimum of the sliding range and each cut point costs constant time. What is
left at the end of a segment falls into lengths that are powers of two, which
need no padding. Nothing is shuffled: a document's pieces come from the task
that reads it.

Defined results: a null or empty text holds the end id alone; repeated rows
are packed each on their own; null ids stay null; an empty table gives no
rows; further columns are ignored; a text longer than a segment spans several.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from talus.llm.subwords import encoder, text_chunks


#: Text encoded in one step; a longer text alone.
CHUNK_BYTES = 2_000_000
#: Cached pieces in one worker: packing holds little else, about 250 bytes a piece.
CACHE_PIECES = 600_000


@dataclass(frozen=True)
class PackingRules:
    size: int = 2048
    end_id: int = 1
    sentence_penalty: int = 4
    inside_penalty: int = 24
    #: Cut points inside sentences stand at most so many ids apart.
    stride: int = 32
    #: Ids of a segment, about.
    segment: int = 1_000_000
    #: Penalty for each short sequence at the end of a segment.
    short_penalty: int = 16


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_ids: np.ndarray, rules: PackingRules) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a window may end, and the penalty of each; the last is the segment's end."""
    sentence_ends = np.flatnonzero(np.isin(ids, sentence_ids)) + 1
    natural = np.union1d(sentence_ends, doc_ends)
    gaps = np.diff(natural, prepend=0)
    extra = (gaps - 1) // rules.stride
    total = int(extra.sum())
    k = np.arange(total) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    inside = np.repeat(natural - gaps, extra) + k * rules.stride
    at = np.union1d(natural, inside)
    penalty = np.full(len(at), rules.inside_penalty, np.int64)
    penalty[np.searchsorted(at, sentence_ends)] = rules.sentence_penalty
    penalty[np.searchsorted(at, doc_ends)] = 0
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, rules: PackingRules) -> list[int]:
    """Ends of the windows of least cost. at: cut points, rising, no gap above rules.size."""
    size, total = rules.size, int(at[-1])
    points = [0, *at.tolist()]
    costs = [0, *penalty.tolist()]
    best, came = [0] * len(points), [0] * len(points)
    queue: deque[int] = deque([0])
    for i in range(1, len(points)):
        here = points[i]
        while here - points[queue[0]] > size:
            queue.popleft()
        j = queue[0]
        came[i] = j
        best[i] = best[j] + points[j] - here + size + costs[i]
        key = best[i] + here
        while queue and best[queue[-1]] + points[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
    last, least = len(points) - 1, best[-1]
    for i in range(len(points) - 2, -1, -1):  # the rest after i falls into powers of two
        rest = total - points[i]
        if rest >= size:
            break
        if best[i] + rules.short_penalty * rest.bit_count() < least:
            last, least = i, best[i] + rules.short_penalty * rest.bit_count()
    ends, i = [], last
    while i:
        ends.append(points[i])
        i = came[i]
    ends.reverse()
    here, rest = points[last], total - points[last]
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            here += 1 << bit
            ends.append(here)
    return ends


def pack(docs: DataFrame, tokenizer_path: str, rules: PackingRules = PackingRules(), with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with ``with_ids`` the piece's ids, which are what a trainer reads.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def segment_rows(names_: list, ids: np.ndarray, offsets: np.ndarray, before: np.ndarray, totals: np.ndarray, sentence_ids: np.ndarray, first: int) -> tuple[dict, int]:
        """before: each document's ids in earlier segments."""
        doc_ends = offsets[1:]
        cuts = np.array(best_cuts(*cut_points(ids, doc_ends, sentence_ids, rules), rules), np.int64)
        starts = np.union1d(np.concatenate([[0], cuts[:-1]]), offsets[:-1])
        ends = np.append(starts[1:], len(ids))
        doc = np.searchsorted(offsets, starts, "right") - 1
        window = np.searchsorted(cuts, starts, "right")
        window_start = np.concatenate([[0], cuts])[window]
        raw = memoryview(ids.astype("<u4").tobytes())
        rows = {
            "doc_id": [names_[d] for d in doc.tolist()],
            "start": starts - offsets[doc] + before[doc],
            "length": ends - starts,
            "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
            "doc_tokens": totals[doc],
            "sequence_id": first + window,
            "offset": starts - window_start,
        }
        if with_ids:
            rows["ids"] = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return rows, first + len(cuts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, CACHE_PIECES)
        sentence_ids = sentence_end_ids(tokenizer_path)
        arrow = pa.schema([(n, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n in names])
        number = TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # documents' (doc_id, ids, ids before, ids in all)
        size = 0

        def flush():
            nonlocal number, held, size
            ids = np.concatenate([h[1] for h in held])
            offsets = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])])
            rows, number = segment_rows([h[0] for h in held], ids, offsets, np.array([h[2] for h in held], np.int64), np.array([h[3] for h in held], np.int64), sentence_ids, number)
            held, size = [], 0
            return pa.RecordBatch.from_pydict(rows, schema=arrow)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, texts in text_chunks(batch.column(1), CHUNK_BYTES):
                ids, offsets = encode.encode(texts)
                for k in range(a, b):
                    own = np.append(ids[offsets[k - a] : offsets[k - a + 1]], np.int32(rules.end_id))
                    for cut in range(0, len(own), rules.segment):
                        part = own[cut : cut + rules.segment]
                        held.append((doc_ids[k], part, cut, len(own)))
                        size += len(part)
                        if size >= rules.segment:
                            yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(task, schema)


def sentence_end_ids(path: str) -> np.ndarray:
    """Ids whose string ends in a full stop, a question mark or an exclamation mark at a word's end."""
    vocabulary = encoder(path, CACHE_PIECES)._tokenizer.get_vocab()
    return np.array(sorted(i for t, i in vocabulary.items() if t.removesuffix("</w>").endswith((".", "!", "?")) and t.endswith("</w>")), np.int32)
