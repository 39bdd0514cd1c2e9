"""Substring de-duplication by relative Lempel-Ziv parsing against indexed
reference blocks.

Every document is cut into blocks at content-defined anchors: the anchor of a
window of ``WINDOW`` words is the ``SEED``-word sequence of smallest hash in
it, so equal windows have equal anchors wherever they stand. The block of an
anchor is the stretch of all windows that chose it; the index maps the hash
of a block to the smallest doc_id that holds it. A document is parsed greedily
against the blocks of all documents: a block that an earlier document holds is
copied whole (all of its windows repeat), and neighbouring blocks join to
longer factors. At the edge of a factor a block differs although its anchor
is shared; there each window is looked up on its own. Only one holder of each
such block (the earliest) has to send its windows, as later holders copy the
whole block.

So a window counts as a repeat exactly if its words also start in a document
of smaller id. Words of up to 7 bytes are hashed one to one, longer ones by
XXH64; blocks and windows are compared by two independent 64-bit hashes of
their words, under the same 64-bit hash of their anchor.

All tables are keyed by hashes or documents, pre-aggregated before they are
shuffled and written before they are joined, so a passage that a third of all
documents share is a skewed join key that adaptive execution splits."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_hashes, raw_texts, span_hashes, stage_table, steps, word_bounds, word_hashes

WINDOW = 50
SEED = 8


def _bounds(text: bytes):
    data = np.frombuffer(text, dtype=np.uint8)
    return data, *word_bounds(data)


def blocks(text: bytes, window: int = WINDOW, seed: int = SEED):
    """Blocks of a text: first window, number of windows, anchor hash, two block hashes."""
    data, starts, ends = _bounds(text)
    n = len(starts)
    if n < window:
        return None
    prefix = prefix_hashes(word_hashes(data, starts, ends))
    at = np.arange(n - seed + 1)
    grams = span_hashes(prefix, at, at + seed)
    # smallest hash of each window, the leftmost of equals: top bits of the hash over the place
    best = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, m, reach = window - seed + 1, n - window + 1, 1
    while 2 * reach <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    best = np.minimum(best[:m], best[width - reach:width - reach + m])
    place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(first, m))
    last = first + count - 1 + window
    return first, count, grams[place[first]], span_hashes(prefix, first, last), span_hashes(prefix, first, last, 1)


def window_hashes(text: bytes, window: int, first: np.ndarray, count: np.ndarray):
    """Start and two hashes of every window of the given blocks."""
    data, starts, ends = _bounds(text)
    prefix = prefix_hashes(word_hashes(data, starts, ends))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return at, span_hashes(prefix, at, at + window), span_hashes(prefix, at, at + window, 1)


def _structs(column: pa.Array):
    """Offsets and the fields (as arrays) of a column of lists of structs."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.concatenate(([0], np.cumsum(size))), [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]


def block_table(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """``(doc_id, first, count, anchor, block, block2)`` of every block of ``docs(doc_id, text)``."""
    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                rows, found = [], []
                for i, text in enumerate(raw_texts(part.column(1))):
                    b = blocks(text, window, seed)
                    if b is not None:
                        rows.append(np.full(len(b[0]), i))
                        found.append(b)
                if not found:
                    continue
                first, count, anchor, block, block2 = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.concatenate(rows))), pa.array(first.astype(np.int32)),
                     pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)),
                     pa.array(block2.view(np.int64))], ["doc_id", "first", "count", "anchor", "block", "block2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("doc_id is not null").mapInArrow(
        run, f"doc_id {kind}, first int, count int, anchor bigint, block bigint, block2 bigint")


def edge_windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``(doc_id, first, anchor, hash, hash2)`` of every window of the ``wanted``
    blocks ``(doc_id, first, count, anchor)``."""
    per_doc = wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("first", "count", "anchor")).alias("b"))
    joined = docs.join(per_doc, docs["doc_id"] == per_doc["_id"]).select("doc_id", "text", "b")

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                offset, (first, count, anchor) = _structs(part.column(2))
                out = []
                for i, text in enumerate(raw_texts(part.column(1))):
                    s = slice(offset[i], offset[i + 1])
                    at, h, h2 = window_hashes(text, window, first[s].astype(np.int64), count[s].astype(np.int64))
                    out.append((np.full(len(at), i), at, np.repeat(anchor[s], count[s]), h, h2))
                row, at, a, h, h2 = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(a.astype(np.int64)),
                     pa.array(h.view(np.int64)), pa.array(h2.view(np.int64))], ["doc_id", "first", "anchor", "hash", "hash2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, first int, anchor bigint, hash bigint, hash2 bigint")


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``(doc_id, first, count)``: ``count`` windows from word ``first`` on
    whose words also start in a document of smaller id."""
    table = stage_table(block_table(docs, window, seed), "blocks")
    # The index: anchors of several documents, and the first holder of each of their blocks.
    shared = stage_table(
        table.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                                    *[f(c).alias(f"{n}_{c}") for c in ("block", "block2") for n, f in (("lo", F.min), ("hi", F.max))])
        .filter("lo < hi").select("anchor", F.expr("lo_block <> hi_block or lo_block2 <> hi_block2").alias("edge")), "shared")
    known = stage_table(table.join(shared, "anchor"), "known")
    holder = stage_table(known.groupBy("anchor", "block", "block2").agg(F.min("doc_id").alias("holder")), "holder")
    factors = stage_table(
        known.join(holder, ["anchor", "block", "block2"])
        .select("doc_id", "first", "count", "anchor", "edge", (F.col("doc_id") > F.col("holder")).alias("copied"))
        .filter("copied or edge"), "factors")
    edges = stage_table(edge_windows(docs, factors.filter("not copied"), window), "edges")
    again = stage_table(
        edges.groupBy("anchor", "hash", "hash2").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("hi"))
        .filter("holder < hi").select("anchor", "hash", "hash2", "holder"), "again")
    single = edges.join(again, ["anchor", "hash", "hash2"]).filter("doc_id > holder")
    return factors.filter("copied").select("doc_id", "first", "count").unionByName(
        single.select("doc_id", "first", F.lit(1).alias("count")))


def _removed(n: int, window: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words lies in one of the windows."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first.astype(np.int64) + count - 1 + window, -1)
    return np.cumsum(edge[:n]) > 0


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """``text`` without the removed words and the white space after each."""
    data, starts, _ = _bounds(text)
    flip = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    edges = np.append(starts, len(data))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(flip == 1), np.flatnonzero(flip == -1)):
        out.append(text[at:edges[a]])
        at = edges[b]
    out.append(text[at:])
    return b"".join(out)


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int) -> DataFrame:
    """``(row, spans)``: every row of ``docs`` as a struct, under names of its own."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    per_doc = repeated_spans(plain, window, seed).groupBy("doc_id").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    return whole.join(per_doc, whole["id"] == per_doc["doc_id"], "left").select("row", "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   seed: int = SEED, with_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` (of
    the kept words joined by one space) and ``kept_text`` (the text without
    the removed words; its other white space is unchanged).

    Null and empty texts have no words; a text of fewer than ``window`` words
    has no window and stays whole. A row with a null id is neither reference
    nor cut. Rows repeated under one id are one document, which is no earlier
    than itself; each comes back. An empty table gives no rows; other columns
    are not read."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = _with_spans(plain, "doc_id", "text", window, seed).select("row.doc_id", "row.text", "spans")

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                offset, (first, count) = _structs(part.column(2))
                out = []
                for i, text in enumerate(raw_texts(part.column(1))):
                    words = text.split()
                    gone = None
                    if offset[i] < offset[i + 1]:
                        s = slice(offset[i], offset[i + 1])
                        gone = _removed(len(words), window, first[s], count[s])
                    kept = words if gone is None else list(compress(words, ~gone))
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(),
                                None if not with_text else (text if gone is None else _cut(text, gone))))
                n, m, sha, kept_text = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(sha, pa.string()),
                     pa.array(kept_text, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    out = joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


def clean_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                seed: int = SEED) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text_col`` (a null text
    stays null, and a document of which nothing is left has an empty text)."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # of its own, whatever the columns are called
    plain = docs.toDF(*names)
    id_col, text_col = (names[docs.columns.index(c)] for c in (id_col, text_col))
    joined = _with_spans(plain, id_col, text_col, window, seed).select("row.*", "spans")
    out = plain.schema

    def run(batches):
        for batch in batches:
            for part in steps(batch, text_col):
                k = part.schema.get_field_index(text_col)
                offset, (first, count) = _structs(part.column(part.num_columns - 1))
                texts = part.column(k).cast(pa.binary()).to_pylist()
                for i, text in enumerate(texts):
                    if offset[i] < offset[i + 1] and text:
                        s = slice(offset[i], offset[i + 1])
                        n = len(word_bounds(np.frombuffer(text, dtype=np.uint8))[0])
                        texts[i] = _cut(text, _removed(n, window, first[s], count[s]))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                columns[k] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, out.fieldNames())

    return joined.mapInArrow(run, out).toDF(*docs.columns)
