"""Media columns: payloads kept as progressive JPEG files, read back as coefficients and full-resolution RGB tensors.

A payload's bytes are the quantised coefficients of the image (the format's
lossless unit), 64 to a block: four blocks of brightness, then two of colour,
to a unit.  The payload's length stands in the file's comment.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common, jpeg

UNIT = 192
_SAMPLING = ((2, 2), (1, 1), (1, 1))


def payload(text: str | None) -> tuple[bytes, int]:
    """A whole text's UTF-8 bytes, filled up with spaces to a positive multiple of UNIT, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, ceil(len(raw) / UNIT)) * UNIT - len(raw)), len(raw)


def to_image(data: bytes) -> jpeg.Image:
    blocks = np.frombuffer(data, dtype=np.uint8).astype(np.int16).reshape(-1, 64) - 128
    units = ceil(len(blocks) / 6)
    cols = min(max(1, isqrt(units)), 4000)
    rows = ceil(units / cols)
    if rows > 4000:
        raise ValueError("the payload is larger than an image can be")
    full = np.zeros((rows * cols * 6, 64), dtype=np.int16)
    full[: len(blocks)] = blocks
    six = full.reshape(rows, cols, 6, 64)
    y = six[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows * 2, cols * 2, 64)
    return jpeg.Image(cols * 16, rows * 16, _SAMPLING, [y, six[:, :, 4], six[:, :, 5]], b"payload %d" % len(data))


def to_payload(image: jpeg.Image) -> bytes:
    """The payload in an image's coefficients."""
    y, cb, cr = image.coefficients
    rows, cols = cb.shape[:2]
    six = np.concatenate([y.reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, 64), cb[:, :, None], cr[:, :, None]], axis=2)
    n = int(image.comment.removeprefix(b"payload "))
    return (six.reshape(-1)[:n] + 128).astype(np.uint8).tobytes()


def encode(payloads: list[bytes]) -> list[bytes]:
    return jpeg.write([to_image(p) for p in payloads])


def features(rgb: np.ndarray) -> str:
    """Size, means and deviations of an RGB tensor, from whole sums."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(axis=0, dtype=np.int64).tolist()
    squares = np.einsum("ij,ij->j", flat, flat, dtype=np.int64, casting="unsafe").tolist()
    parts = [f"{t / n:.3f}±{max(0, s * n - t * t) ** 0.5 / n:.3f}" for t, s in zip(total, squares)]
    return f"{rgb.shape[1]}x{rgb.shape[0]} " + " ".join(parts)


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
DECODED = T.StructType([*ENCODED.fields, T.StructField("payload", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgb", T.BinaryType())])
DIGEST = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)
_BATCH = 2 << 20


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "text", _BATCH):
        got = [payload(t) for t in batch.column("text").to_pylist()]
        media = encode([p for p, _ in got])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n in got], pa.int64()), pa.array(media, pa.binary())], names=ENCODED.names)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "media", _BATCH):
        images = jpeg.read(batch.column("media").to_pylist())
        tensors = jpeg.rgb(images)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([to_payload(x) for x in images], pa.binary()), pa.array([t.shape[1] for t in tensors], pa.int32()), pa.array([t.shape[0] for t in tensors], pa.int32()), pa.array([t.tobytes() for t in tensors], pa.binary())],
            names=DECODED.names,
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for decoded in _decode(batches):
        out = []
        for doc, n, media, back, width, height, rgb in zip(*(c.to_pylist() for c in decoded.columns)):
            tensor = np.frombuffer(rgb, dtype=np.uint8).reshape(height, width, 3)
            out.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(tensor)))
        yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, row)) for row in out], schema=pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in DIGEST.fields]))


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: every whole text as a progressive JPEG file.

    Null and empty texts are one block of spaces; rows that repeat come back
    as often; an empty table gives no rows; other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode, ENCODED)


def decode_column(media: DataFrame) -> DataFrame:
    """The rows of encode_column() with the payload and the RGB tensor (width, height, rgb: rows of pixels) read back."""
    return media.mapInArrow(_decode, DECODED)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores all documents' payloads as progressive JPEG, reads the stored bytes back and describes them."""
    # the files' tables repeat, so the column is stored with a compression that finds them
    stored = common.cut(encode_column(common.table(spark, sf_dir, "documents")), "media", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "6"})
    return stored.mapInArrow(_digest, DIGEST)
