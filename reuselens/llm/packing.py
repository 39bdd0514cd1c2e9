"""Concatenate-and-cut packing: token ids of all documents form one long
stream, cut into windows of ``size`` tokens.

First pass: tokenise; every partition counts its own tokens, so a document
knows its offset within its partition. A prefix sum over the partitions'
totals (one row per partition) gives each partition its global offset. Second
pass: a document's global offset decides which windows it touches; documents
that cross a window's edge give one boundary record per window. No row is
shuffled."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import raw_texts, stage_table, steps

SIZE = 2048
END_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE ids of a ``tokenizers`` JSON file.

    The vocabulary and the split pattern come from that file; ``tiktoken``
    merges by its ranks (the merges of such a file are in the order of their
    ids), about three times as fast and with the same ids, which the tests
    hold against ``tokenizers`` itself. A text that the fast encoder refuses,
    or that holds an added token of the file (``<|endoftext|>``), which has an
    id of its own, goes through ``tokenizers``."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.added = {t["content"] for t in spec.get("added_tokens", [])}
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
        ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        try:
            if not any(t in text for t in self.added):
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
        except ValueError:  # its pattern's stack ends at very long runs of white space
            pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """First pass: ``(part, before, n, doc_id, ids)``, with the number of
    tokens of the same partition before the document, its own number, and its
    ids as little-endian bytes (two a token where all fit)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary)
        for batch in batches:
            for rows in steps(batch, "text"):
                out = []
                for text in raw_texts(rows.column(1)):
                    ids = np.append(enc.ids(text.decode("utf-8", "replace")), np.uint32(end_id))
                    wide = "<u4" if ids.max() > 0xFFFF else "<u2"
                    out.append((part, before, len(ids), ids.astype(wide).tobytes()))
                    before += len(ids)
                part_col, before_col, n_col, ids_col = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part_col, pa.int32()), pa.array(before_col, pa.int64()), pa.array(n_col, pa.int64()),
                     rows.column(0), pa.array(ids_col, pa.binary())], ["part", "before", "n", "doc_id", "ids"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"part int, before bigint, n bigint, doc_id {kind}, ids binary")


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece of a document in a sequence: ``doc_id, start``
    (tokens of the document before the piece), ``length, ids_crc32`` (of the
    ids as little-endian 32-bit numbers), ``doc_tokens``, ``sequence_id``,
    ``offset``, ``sequence_tokens`` (filled tokens of the sequence),
    ``padded_tokens`` (``size``, or the filled tokens where they are a power
    of two) and, if wanted, the ids.

    Every document, also one with a null or empty text, ends in ``end_id``,
    so none is lost; a null id is kept; repeated rows are packed repeatedly;
    a document longer than ``size`` spans several sequences; only the last
    sequence can be short. An empty table gives no rows."""
    tokens = stage_table(tokenised(docs, vocabulary or default_vocabulary(), end_id, id_col, text_col), "tokens")
    # one row per partition of the input, so the window and the join's small side are bounded by the number of tasks
    totals = tokens.groupBy("part").agg(F.sum("n").alias("_n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("base"),
                          F.sum("_n").over(Window.partitionBy()).alias("all_tokens"))
    placed = tokens.join(F.broadcast(bases), "part").select(
        "doc_id", "n", "ids", (F.col("base") + F.col("before")).alias("at"), "all_tokens")

    def cut(batches):
        for batch in batches:
            for rows in steps(batch, "ids"):
                out = []
                doc, n, ids, at, every = (c.to_pylist() for c in rows.columns)
                for d, k, raw, g, total in zip(doc, n, ids, at, every):
                    tok = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * k else "<u4").astype("<u4")
                    s = 0
                    while s < k:
                        seq, off = divmod(g + s, size)
                        m = min(k - s, size - off)
                        full = min(size, total - seq * size)
                        piece = tok[s:s + m].tobytes()
                        out.append((d, s, m, zlib.crc32(piece), k, seq, off, full,
                                    full if full & (full - 1) == 0 else size, tok[s:s + m] if with_ids else None))
                        s += m
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = (f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
           "offset bigint, sequence_tokens bigint, padded_tokens bigint, ids array<bigint>")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    names = schema.names
    packed = placed.mapInArrow(cut, ddl)
    return packed if with_ids else packed.drop("ids")
