"""Vector and mask decoding for tables written by other tools."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@F.pandas_udf(ArrayType(FloatType()))
def _floats(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for blobs, dims in parts:
        yield pd.Series([None if b is None or d is None else (np.frombuffer(b, "<f4", int(d)) if len(b) >= 4 * d else np.zeros(0, np.float32)) for b, d in zip(blobs, dims, strict=True)])


def decode_vector(blob: Column, dim: Column) -> Column:
    """Little-endian 32-bit floats; a blob that is too short gives an empty vector, further bytes are ignored."""
    return _floats(blob, dim)


@F.pandas_udf(BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """The opposite of decode_vector."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(BinaryType())
def encode_mask(masks: pd.Series) -> pd.Series:
    """Run lengths of a 0/1 byte mask as (value, run) byte pairs, runs of 255 at most."""

    def pack(mask: bytes | None) -> bytes | None:
        if mask is None:
            return None
        x = np.frombuffer(mask, np.uint8)
        if not len(x):
            return b""
        edge = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        runs = np.diff(np.append(edge, len(x)))
        pieces = -(-runs // 255)
        value = np.repeat(x[edge], pieces)
        length = np.full(len(value), 255)
        length[np.cumsum(pieces) - 1] = runs - 255 * (pieces - 1)
        return np.stack([value, length], axis=1).astype(np.uint8).tobytes()

    return masks.map(pack)


def mask_area(rle: Column) -> Column:
    """Set pixels of an encoded mask: odd bytes times even ones, without decoding it."""
    pairs = F.sequence(F.lit(0), F.floor(F.octet_length(rle) / 2).cast("int") - 1)
    byte = lambda i: F.conv(F.hex(F.substring(rle, i, F.lit(1))), 16, 10).cast("bigint")
    return F.when(F.octet_length(rle) < 2, F.lit(0).cast("bigint")).otherwise(F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, i: s + byte(2 * i + 1) * byte(2 * i + 2)))
