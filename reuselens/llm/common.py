"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from ..session import scratch_path

#: Most characters that one step of a Python kernel holds in memory at once.
STEP_CHARS = 2_000_000


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet (zstd) under
    ``spark.checkpoint.dir`` and read it back. Every executor sees the
    files, so a lost executor costs no recomputation, and later readers
    prune columns. An empty table keeps its schema."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_CHARS):
    """Cut an Arrow batch into slices of about ``most`` bytes of a string
    column, so that a kernel's arrays stay small however long texts are
    (one row is never cut)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total = np.cumsum(np.asarray(sizes, dtype=np.int64))
    at = 0
    while at < n:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every row; empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# --- words as arrays ------------------------------------------------------
# A word is a run of bytes other than space and 0x09-0x0D, which no byte of
# a longer UTF-8 sequence can be.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of a text's UTF-8 bytes."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for attr, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, dtype=np.uint64)
                x[0] = 1
                setattr(self, attr, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word. Words of up to 7 bytes are hashed by a
    bijection of length and bytes, all at once; longer ones by XXH64. Long
    texts go in runs of words."""
    out = np.empty(len(starts), dtype=np.uint64)
    size = ends - starts
    padded = np.concatenate((data, np.zeros(7, dtype=np.uint8)))
    seven = np.arange(7)
    shift = seven.astype(np.uint64) * np.uint64(8)
    for at in range(0, len(starts), 1 << 16):
        s, n = starts[at:at + (1 << 16)], size[at:at + (1 << 16)]
        raw = padded[s[:, None] + seven].astype(np.uint64) << shift
        raw[seven >= n[:, None]] = 0
        out[at:at + (1 << 16)] = mix64(raw.sum(axis=1, dtype=np.uint64) | (np.minimum(n, 8).astype(np.uint64) << np.uint64(56)))
    text = data.tobytes()
    for i in np.flatnonzero(size > 7).tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i]:ends[i]])
    return out


_WORD = Powers(0xC2B2AE3D27D4EB4F), Powers(0x9E3779B97F4A7C15)


def prefix_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that ``span_hashes`` takes differences of: two, of independent mixes and bases."""
    out = np.zeros((2, len(words) + 1), dtype=np.uint64)
    for k, of in enumerate((words, mix64(words ^ np.uint64(0xA24BAED4963EE407)))):
        up, _ = _WORD[k].get(len(words) + 1)
        np.cumsum(of * up[:len(words)], out=out[k, 1:])
    return out[0], out[1]


def span_hashes(prefix: tuple, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of words[start:end] for many spans at once, equal for equal
    word sequences wherever they stand. ``which``: the first or the second of
    two independent hashes."""
    p = prefix[which]
    _, down = _WORD[which].get(len(p))
    return mix64((p[ends] - p[starts]) * down[starts])
