"""Media columns: any bytes as progressive JPEG files, and files as RGB tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.progressive_jpeg import Image, encode
from chainframe.llm.text import slices, text_buffer

#: Payloads are filled up with bytes 255 to a positive multiple of this.
UNIT = 576
#: Text bytes of which tensors and files are in memory at once.
BATCH_BYTES = 1 << 20


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", BATCH_BYTES):
            data, offsets = text_buffer(part["text"])
            files = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                payload = np.full(max(1, -(-(b - a) // UNIT)) * UNIT, 255, np.uint8)
                payload[: b - a] = data[a:b]
                files.append(encode(payload))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(offsets)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up, as the coefficients of a progressive JPEG file.

    Null texts are empty and give one unit of filling. Equal texts give equal files.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _decoded(keep: list[str]):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", BATCH_BYTES):
                rows = []
                for blob in part["media"]:
                    if not blob.is_valid:
                        rows.append((None,) * 5)
                        continue
                    image = Image(blob.as_py())
                    rgb = image.rgb()
                    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64) / (image.height * image.width)
                    rows.append((image.height, image.width, rgb.tobytes(), mean.tolist(), image.payload() if image.comment.startswith(b"bytes ") else None))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.binary())
                made = [pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), part["media"], *made], [*keep, "media", "height", "width", "rgb", "mean_rgb", "payload"])

    return decoded


def decode_media(files: DataFrame) -> DataFrame:
    """Adds height, width, rgb (a row-major height x width x 3 byte tensor), mean_rgb and payload (stored bytes, else null) to a table with a `media` column of progressive JPEG files.

    A null file gives nulls. A file that isn't a whole progressive JPEG fails the job. Other columns stay; those of these names are replaced.
    """
    keep = [c for c in files.columns if c not in ("media", "height", "width", "rgb", "mean_rgb", "payload")]
    schema = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in keep)
    return files.select(*keep, "media").mapInArrow(_decoded(keep), schema + "media binary, height int, width int, rgb binary, mean_rgb array<double>, payload binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from files written and read back."""
    read = decode_media(store_bytes(docs))
    mean = [F.col("mean_rgb")[k] for k in range(3)]
    return read.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.format_string("%dx%d %.3f %.3f %.3f", "width", "height", *mean).alias("feature"))
