"""Flat token files: writing them, and counting each document's tokens in them.

A flat file is little-endian unsigned ids of two or four bytes and nothing else;
a document ends with a separator id. ``write_flat`` tokenises documents and writes files
of bounded size, a document running on from one file to the next within its
task. ``document_lengths`` needs no index: each file is cut into blocks, a block
searches its separators in one vectorised comparison, and a prefix scan over
the blocks' sums (separators, ids before the first and after the last)
stitches documents that cross blocks or files. The scan has two levels, blocks
within a group of files and groups, so no task sees all blocks.

Defined results: a null or empty text is a document of no tokens (its separator
alone); an id equal to the separator inside a text would end a document, so
the separator lies beyond the vocabulary (a text that spells a special token is
counted like any other), and the writer refuses one that occurs; ids after the
last separator are a document that is not ended (``ended`` false); an empty
table or folder gives no rows; further columns are ignored; a very long text
runs over several files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus.llm.shared import stored, work_dir
from talus.llm.subwords import encoder, text_chunks


@dataclass(frozen=True)
class FlatRules:
    #: The separator: an id beyond the vocabulary, so that no text can produce it.
    separator: int = 65535
    #: Bytes of an id; two hold a vocabulary of up to 65,536.
    id_bytes: int = 2
    #: Ids of a file, and of a block in its scan.
    file_ids: int = 2_000_000
    block_ids: int = 250_000
    #: Files whose blocks are scanned in one group.
    group_files: int = 64

    @property
    def kind(self) -> str:
        return f"<u{self.id_bytes}"


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_flat(docs: DataFrame, tokenizer_path: str, folder: str, rules: FlatRules = FlatRules()) -> DataFrame:
    """Write docs as flat files to a shared folder; (file, place, doc_id) of each document's separator.

    A file's name tells its task and its number there and its ids depend on these
    alone, so a task that runs again writes the same file.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        where, path = _filesystem(folder)
        where.create_dir(path)
        context = TaskContext.get()
        held: list[np.ndarray] = []
        size = number = place = 0

        def put(ids: np.ndarray) -> None:
            nonlocal number
            name = f"{path}/tokens-{context.partitionId():06d}-{number:06d}"
            with where.open_output_stream(f"{name}.{context.taskAttemptId()}.part") as to:
                to.write(ids.astype(rules.kind).tobytes())
            where.move(f"{name}.{context.taskAttemptId()}.part", f"{name}.bin")
            number += 1

        for batch in batches:
            doc_ids = batch.column(0)
            for a, b, texts in text_chunks(batch.column(1), 2_000_000):
                ids, offsets = encode.encode(texts)
                if (ids == rules.separator).any():
                    raise ValueError("the separator occurs in a text")
                if len(ids) and int(ids.max()) >> 8 * rules.id_bytes:
                    raise ValueError("an id does not fit the files' width")
                held.append(np.insert(ids, offsets[1:], rules.separator))
                size += len(held[-1])
                yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()] * (b - a), pa.int64()), pa.array(range(place, place + b - a), pa.int64()), doc_ids.slice(a, b - a)], ["stream", "place", "doc_id"])
                place += b - a
                if size >= rules.file_ids:
                    ids = np.concatenate(held)
                    full = len(ids) // rules.file_ids * rules.file_ids
                    for at in range(0, full, rules.file_ids):
                        put(ids[at : at + rules.file_ids])
                    held, size = [ids[full:]], len(ids) - full
        if size:
            put(np.concatenate(held))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "stream long, place long, doc_id long")


def read_blocks(spark: SparkSession, folder: str, rules: FlatRules = FlatRules()) -> DataFrame:
    """file, block, n_ids, separators (their places in the block) of all flat files of a folder."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), rules.kind, len(content.as_buffer()) // rules.id_bytes)
                for block, at in enumerate(range(0, len(ids), rules.block_ids)):
                    own = ids[at : at + rules.block_ids]
                    yield pa.RecordBatch.from_pydict({"file": [os.path.basename(path)], "block": [block], "n_ids": [len(own)], "separators": [np.flatnonzero(own == rules.separator).astype(np.int64)]}, schema=schema)

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_ids", pa.int64()), ("separators", pa.list_(pa.int64()))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "content")
    return files.mapInArrow(task, "file string, block long, n_ids long, separators array<long>")


def document_lengths(blocks: DataFrame, rules: FlatRules = FlatRules()) -> DataFrame:
    """stream, place, n_tokens, start, ended of every document, in the order of the files' names.

    stream is the number in a file's name; start counts ids, separators too, from
    the stream's beginning.
    """
    parts = F.split("file", "[-.]")
    sums = blocks.select(
        parts[1].cast("long").alias("stream"),
        parts[2].cast("long").alias("number"),
        "block",
        "n_ids",
        "separators",
        F.size("separators").cast("long").alias("n"),
        F.when(F.size("separators") > 0, F.col("n_ids") - F.element_at("separators", -1) - 1).otherwise(F.col("n_ids")).alias("tail"),
    ).withColumn("batch", F.floor(F.col("number") / rules.group_files))
    sums = stored(sums)
    # level 1: within a group of files, what has been before each block since the group's beginning
    order = W.partitionBy("stream", "batch").orderBy("number", "block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    reset = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(earlier)
    within = sums.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("span", F.coalesce(reset, F.lit(0)))
    # the open document's ids: the tail of the last block with a separator, and all blocks after it
    last_tail = F.last(F.when(F.col("n") > 0, F.col("tail")), ignorenulls=True).over(earlier)
    last_end = F.last(F.when(F.col("n") > 0, F.col("ids_before") + F.col("n_ids")), ignorenulls=True).over(earlier)
    within = within.withColumn("open_ids", F.when(F.col("span") > 0, last_tail + F.col("ids_before") - last_end).otherwise(F.col("ids_before")))
    # level 2: over the groups of a stream
    tail_end = F.max(F.when(F.col("n") > 0, F.struct("number", "block", F.col("tail").alias("tail"), (F.col("ids_before") + F.col("n_ids")).alias("end"))))
    groups = within.groupBy("stream", "batch").agg(F.sum("n_ids").alias("g_ids"), F.sum("n").alias("g_docs"), tail_end.alias("t")).withColumn("g_tail", F.coalesce(F.col("t.tail") + F.col("g_ids") - F.col("t.end"), F.col("g_ids")))
    over = W.partitionBy("stream").orderBy("batch").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("i0", F.coalesce(F.sum("g_ids").over(over), F.lit(0))).withColumn("d0", F.coalesce(F.sum("g_docs").over(over), F.lit(0)))
    g_last = F.last(F.when(F.col("g_docs") > 0, F.struct("g_tail", (F.col("i0") + F.col("g_ids")).alias("end"))), ignorenulls=True).over(over)
    groups = groups.withColumn("l", g_last).select("stream", "batch", "i0", "d0", F.coalesce(F.col("l.g_tail") + F.col("i0") - F.col("l.end"), F.col("i0")).alias("o0"))
    carried = within.join(groups, ["stream", "batch"]).withColumn("open", F.col("open_ids") + F.when(F.col("span") > 0, 0).otherwise(F.col("o0")))
    begin = F.col("i0") + F.col("ids_before")
    ended = carried.where("n > 0").select(
        "stream",
        (F.col("d0") + F.col("docs_before")).alias("first"),
        begin.alias("begin"),
        "open",
        "separators",
        F.posexplode("separators").alias("i", "at"),
    )
    before = F.when(F.col("i") > 0, F.element_at("separators", F.greatest(F.col("i"), F.lit(1))))
    n_tokens = F.when(F.col("i") > 0, F.col("at") - before - 1).otherwise(F.col("at") + F.col("open"))
    out = ended.select("stream", (F.col("first") + F.col("i")).alias("place"), n_tokens.alias("n_tokens"), (F.col("begin") + F.col("at") - n_tokens).alias("start"), F.lit(True).alias("ended"))
    ends = carried.groupBy("stream").agg(F.max_by(F.struct((F.col("d0") + F.col("docs_before") + F.col("n")).alias("place"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("open") + F.col("n_ids")).alias("n_tokens"), (begin + F.col("n_ids")).alias("end")), F.struct("number", "block")).alias("e"))
    unended = ends.where("e.n_tokens > 0").select("stream", "e.place", "e.n_tokens", (F.col("e.end") - F.col("e.n_tokens")).alias("start"), F.lit(False).alias("ended"))
    return out.unionByName(unended)


def token_counts(docs: DataFrame, tokenizer_path: str, rules: FlatRules = FlatRules()) -> DataFrame:
    """doc_id, n_tokens, stream, place, start: docs written as flat files, and counted by the scan of these."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    written = stored(write_flat(docs, tokenizer_path, folder, rules))
    if not written.take(1):
        return spark.createDataFrame([], "doc_id long, n_tokens long, stream long, place long, start long")
    lengths = document_lengths(read_blocks(spark, folder, rules), rules)
    return lengths.join(written, ["stream", "place"]).select("doc_id", "n_tokens", "stream", "place", "start")
