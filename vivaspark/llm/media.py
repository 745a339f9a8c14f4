"""Media columns: texts stored as pictures, read back, with their pixels' features.

Payloads are the UTF-8 bytes of a text, filled with bytes 255 up to a positive
multiple of UNIT. Rows are worked one at a time, so memory is that of the
largest text. Defined results: null counts as the empty text (UNIT bytes 255);
equal texts give equal values, repeated rows equal rows; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vivaspark.llm import jpeg
from vivaspark.llm.common import arrow_rows, table

UNIT = 576
MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
PIXELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])


def payload(text: str | None) -> tuple[int, bytes]:
    """Unpadded size, and the padded bytes."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (UNIT - len(data) if len(data) < UNIT else -len(data) % UNIT)


def feature(rgb: np.ndarray) -> str:
    """Mean of each channel, and the shares of black and of white samples."""
    flat = rgb.reshape(-1, 3)
    means = flat.mean(0, dtype=np.float64)
    n = flat.size
    return "{:.2f},{:.2f},{:.2f};{:.3f},{:.3f}".format(*means, np.count_nonzero(flat == 0) / n, np.count_nonzero(flat == 255) / n)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a progressive JPEG file."""

    def make():
        def rows(ids: list, texts: list) -> Iterator[tuple]:
            for i, t in zip(ids, texts):
                n, data = payload(t)
                yield i, n, jpeg.encode_payload(data)

        return rows

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), "text"), MEDIA, make, slice_rows=128)


def rgb_tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width and rgb: pixels at full resolution, three bytes each, of any stored file."""

    def make():
        def rows(ids: list, files: list) -> Iterator[tuple]:
            for i, data in zip(ids, files):
                rgb = jpeg.to_rgb(jpeg.decode(data))
                yield i, rgb.shape[0], rgb.shape[1], rgb.tobytes()

        return rows

    return arrow_rows(media.select("doc_id", "media"), PIXELS, make, slice_rows=32)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the payload read back from the stored files, and features of their pixels."""
    names = [("doc_id", T.LongType), ("n_bytes", T.LongType), ("payload_bytes", T.LongType), ("payload_sha256", T.StringType), ("tail_crc32", T.LongType), ("media_bytes", T.LongType), ("media_sha256", T.StringType), ("feature", T.StringType)]
    schema = T.StructType([T.StructField(n, t()) for n, t in names])

    def make():
        def rows(ids: list, sizes: list, files: list) -> Iterator[tuple]:
            for i, n, data in zip(ids, sizes, files):
                picture = jpeg.decode(data)
                back = jpeg.payload_of(picture)
                yield i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(jpeg.to_rgb(picture))

        return rows

    return arrow_rows(store(table(spark, sf_dir, "documents")), schema, make, slice_rows=128)
