"""Vector functions: cosine over dense ``array<float>`` embeddings, and the
default text embedder (feature-hashed bag of words) used when no model is
plugged in.

The default embedder is a feature-hashed bag of words: tokens and md5
buckets are native expressions; the cosine of the two bucket multisets is
an exact integer dot product over ``sqrt(|a|^2 |b|^2)`` (the same double in
every engine), computed batch-wise in NumPy. A real model plugs in
through ``embed_with_cache`` as an iterator pandas UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import hash_u32
from .text import NOT_W

HASH_BUCKETS = 1 << 18


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, NOT_W + "+"), lambda t: t != "")


def hashed_buckets(normalized: Column, buckets: int = HASH_BUCKETS) -> Column:
    """Feature-hashed word tokens: md5 bucket of every token (a multiset)."""
    return F.transform(tokens(normalized), lambda t: F.pmod(hash_u32(t), F.lit(buckets)).cast("int"))


def _flat(series: pd.Series, buckets: int):
    lens = series.map(lambda v: 0 if v is None else len(v)).to_numpy()
    rows = np.repeat(np.arange(len(series), dtype=np.int64), lens)
    vals = (np.concatenate([np.asarray(v, dtype=np.int64) for v in series if v is not None and len(v)])
            if lens.sum() else np.zeros(0, dtype=np.int64))
    keys, counts = np.unique(rows * buckets + vals, return_counts=True)
    return keys, counts.astype(np.float64)


def bow_cosine_batch(a: pd.Series, b: pd.Series, buckets: int = HASH_BUCKETS, clip: bool = True) -> pd.Series:
    """Cosine of the bucket-count vectors of each row, vectorised over the
    whole Arrow batch: (row, bucket) keys, np.unique counts, one
    intersect for the dot product. Exact integer dot and norms."""
    n = len(a)
    ka, ca = _flat(a, buckets)
    kb, cb = _flat(b, buckets)
    na = np.bincount(ka // buckets, weights=ca * ca, minlength=n)
    nb = np.bincount(kb // buckets, weights=cb * cb, minlength=n)
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    dot = np.bincount(common // buckets, weights=ca[ia] * cb[ib], minlength=n)
    den = np.sqrt(na * nb)
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = np.where(den > 0, dot / den, np.nan)
    if clip:
        cos = np.clip(cos, 0.0, 1.0)
    out = pd.Series(cos)
    return out.where(den > 0, None)


_BOW_COSINE = None


def bow_cosine(a: Column, b: Column) -> Column:
    """Arrow-batched cosine of two bucket-array columns (built lazily: a
    pandas UDF needs an active session)."""
    global _BOW_COSINE
    if _BOW_COSINE is None:
        _BOW_COSINE = F.pandas_udf(lambda x, y: bow_cosine_batch(x, y), "double")
    return _BOW_COSINE(a, b)


def bag_products(buckets: Column, others: list[list[int]], modulus: int = HASH_BUCKETS) -> Column:
    """``norm`` (squared) of a multiset of buckets and its ``dots`` with each of a few
    fixed multisets: what the cosine of its union with any of them needs. All are integers."""
    vocab = np.unique(np.concatenate([np.asarray(o, dtype=np.int64) for o in others]))
    times = np.zeros((len(vocab), len(others)))
    for i, o in enumerate(others):
        np.add.at(times, (np.searchsorted(vocab, np.asarray(o, dtype=np.int64)), i), 1.0)

    @F.pandas_udf("norm double, dots array<double>")
    def products(batch: pd.Series) -> pd.DataFrame:
        keys, counts = _flat(batch, modulus)
        row, bucket = keys // modulus, keys % modulus
        at = np.minimum(np.searchsorted(vocab, bucket), len(vocab) - 1)
        hit = vocab[at] == bucket
        held = np.bincount(row[hit] * len(vocab) + at[hit], weights=counts[hit], minlength=len(batch) * len(vocab))
        return pd.DataFrame({"norm": np.bincount(row, weights=counts * counts, minlength=len(batch)),
                             "dots": list(held.reshape(len(batch), len(vocab)) @ times)})
    return products(buckets)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def square(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))


def l2_norm(a: Column) -> Column:
    return F.sqrt(square(a))


def cosine(a: Column, b: Column, clip: bool = False) -> Column:
    """Dot / (|a| |b|), renormalising both sides; NULL for a zero
    vector or mismatched dimensions. ``clip=True`` is the offline form
    (clipped to [0, 1]), ``clip=False`` the online one."""
    den = F.sqrt(square(a) * square(b))  # one root: exact for vectors of counts
    cos = F.when((den > 0) & (F.size(a) == F.size(b)), dot(a, b) / den)
    return F.least(F.greatest(cos, F.lit(0.0)), F.lit(1.0)) if clip else cos


PACKED = np.dtype([("i", "<u4"), ("v", "<f8")])


def pack(embedding: Column) -> Column:
    """A vector as its length and its non-zero components with their places, in one binary value: what
    is shuffled then follows the components in use and not the dimensions. Nothing is rounded."""
    def run(batch: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            v = np.asarray(v, dtype=np.float64)
            at = np.flatnonzero(v)
            out = np.empty(len(at) + 1, dtype=PACKED)
            out["i"][0], out["v"][0], out["i"][1:], out["v"][1:] = len(v), 0.0, at, v[at]
            return out.tobytes()
        return batch.map(one)
    return F.pandas_udf(run, "binary")(embedding)


def _unpacked(batch: pd.Series):
    """Of packed vectors their lengths (-1: null), and row, place and value of each component."""
    n = batch.map(lambda v: 0 if v is None else len(v) // PACKED.itemsize).to_numpy(dtype=np.int64)
    all_ = np.frombuffer(b"".join(v for v in batch if v is not None), dtype=PACKED)
    head = np.zeros(len(all_), dtype=bool)
    head[(np.cumsum(n) - n)[n > 0]] = True
    size = np.full(len(batch), -1, dtype=np.int64)
    size[n > 0] = all_["i"][head]
    return size, np.repeat(np.arange(len(batch)), n)[~head], all_["i"][~head].astype(np.int64), all_["v"][~head]


def packed_cosine_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """``cosine(a, b, clip=True)`` of packed vectors, a batch at once: 0 where there is no cosine."""
    (size_a, row_a, i, x), (size_b, row_b, j, y) = _unpacked(a), _unpacked(b)
    n, width = len(a), max(size_a.max(initial=1), size_b.max(initial=1), 1)
    den = np.sqrt(np.bincount(row_a, x * x, n) * np.bincount(row_b, y * y, n))
    keys = row_b * width + j
    at = np.searchsorted(keys, row_a * width + i)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == (row_a * width + i)[hit]
    dot_ = np.bincount(row_a[hit], x[hit] * y[at[hit]], n)
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = dot_ / den
    cos = np.where((den == 0) | (size_a != size_b), 0.0, np.where(np.isnan(cos), 1.0, cos))  # NaN is above all numbers
    return pd.Series(np.clip(cos, 0.0, 1.0))


def packed_cosine(a: Column, b: Column) -> Column:
    """``cosine(a, b, clip=True)`` of packed vectors: lambdas over arrays are interpreted, element by element."""
    return F.pandas_udf(lambda x, y: packed_cosine_batch(x, y), "double")(a, b)


def unit(a: Column) -> Column:
    n = l2_norm(a)
    # the norm is a zip_with *argument* (evaluated once), never captured
    return F.when(n > 0, F.zip_with(a, F.array_repeat(n, F.size(a)), lambda v, m: v.cast("double") / m))


def hashed_embedder(dims: int):
    """An embedder (DataFrame[text] -> DataFrame[text, embedding]): token counts
    hashed to ``dims`` buckets (as ``hashed_buckets`` does; each distinct word of an
    Arrow batch is hashed once). Stands for a model."""
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import DataFrame

    def embed(batches):
        for batch in batches:
            words = batch.column("words")
            n = len(words)
            distinct = pc.dictionary_encode(words.flatten())
            bucket = np.array([int(hashlib.md5(w).hexdigest()[:8], 16) % dims
                               for w in distinct.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int64)
            row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
            counts = np.bincount(row * dims + bucket[distinct.indices.to_numpy(zero_copy_only=False)], minlength=n * dims)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(counts.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column("text"), vectors], ["text", "embedding"])

    def run(texts: DataFrame) -> DataFrame:
        return texts.select("text", tokens(F.col("text")).alias("words")).mapInArrow(embed, "text string, embedding array<double>")
    return run
