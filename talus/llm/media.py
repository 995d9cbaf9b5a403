"""Media columns: texts stored as GIFs, and GIFs read as timed frames with colour histograms.

``stored_media`` writes each text's bytes, padded to a positive multiple of 64,
as the pixels of a GIF to a table in the shared work folder. ``features``
decodes stored media, composes the frames and gives one row for each medium;
``frames`` gives one row for each frame. Both work on any GIF.

Defined results: a null text is empty and has one row of zero pixels; repeated
rows and equal texts give equal values; very long texts have more frames; an
empty table gives no rows; further columns are ignored; broken media (a stream
or block that breaks off, an invalid code size, a canvas above
``gif.MOST_PIXELS``) have their error in the column ``error`` and no features;
``frames`` gives the frames before the fault.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import gif
from talus.llm.shared import stored
from talus.llm.subwords import text_chunks


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media; written and read back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                raw = [t or b"" for t in texts]
                media = [gif.encode_bytes(t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))) for t in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_bytes long, media binary"))


def _feature(frames: int, delay_cs: int, counts: np.ndarray) -> str:
    """Frames, seconds/100 shown, and the colour histogram in thousandths of the visible pixels, colours that occur."""
    share = counts * 1000 // max(1, int(counts.sum()))
    return f"{frames} frames {delay_cs} cs " + " ".join(f"{i:02d}:{n}" for i, n in enumerate(share.tolist()) if counts[i])


_BROKEN = (ValueError, IndexError, OverflowError)
_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, histogram array<long>, error string"


def features(media: DataFrame) -> DataFrame:
    """One row for each row of media (doc_id, n_bytes, media): what its decoded frames hold."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
         ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())]
    )

    def one(raw: bytes) -> dict:
        sha, tail, size, counts, n, delay = hashlib.sha256(), b"", 0, np.zeros(64, np.int64), 0, 0
        try:
            for frame in gif.decode(raw):
                own = gif.frame_bytes(frame)
                sha.update(own)
                tail, size = (tail + own)[-64:], size + len(own)
                counts += gif.histogram(frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width])
                n, delay = n + 1, delay + frame.delay_cs
        except _BROKEN as e:
            return {"error": str(e)}
        return {"payload_bytes": size, "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "feature": _feature(n, delay, counts), "n_frames": n, "histogram": counts.tolist()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows.append({"doc_id": doc, "n_bytes": n, "media_bytes": len(raw or b""), "media_sha256": hashlib.sha256(raw or b"").hexdigest()} | one(raw or b""))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(task, _FEATURES)


def frames(media: DataFrame) -> DataFrame:
    """One row for each shown frame: its place, time and the whole canvas's colour histogram and RGBA pixels."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("frame", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("disposal", pa.int32()),
         ("histogram", pa.list_(pa.int64())), ("rgba", pa.binary())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = 0
                try:
                    for i, f in enumerate(gif.decode(raw or b"")):
                        row = {"doc_id": doc, "frame": i, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "start_cs": start, "delay_cs": f.delay_cs, "disposal": f.disposal}
                        yield pa.RecordBatch.from_pylist([row | {"histogram": gif.histogram(f.canvas).tolist(), "rgba": f.canvas.tobytes()}], schema=schema)
                        start += f.delay_cs
                except _BROKEN:
                    continue  # features() names the error

    ddl = "doc_id long, frame int, left int, top int, width int, height int, start_cs long, delay_cs int, disposal int, histogram array<long>, rgba binary"
    return media.select("doc_id", "media").mapInArrow(task, ddl)
