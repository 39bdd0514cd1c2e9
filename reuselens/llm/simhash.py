"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by a
binary trie self-join.

The distinct fingerprints are the leaves of a binary trie (a sorted array is
that trie: a node is a range of equal leading bits). Pairs of nodes of one
depth are traversed together; a pair carries the number of bits in which its
two prefixes differ and is dropped once that exceeds the error budget of its
depth. Two rotations make the budgets small: if two fingerprints differ in at
most ``e`` bits, then either their first halves differ in at most ``e // 2``
bits or their second halves in at most ``(e - 1) // 2``, so the first
rotation allows the former in its first 32 levels and the second (halves
swapped) the latter; from level 32 on each allows ``e``. No pair is lost.

The top levels are cut into cells (pairs of trie nodes whose prefixes fit the
budget); each cell is one group of a shuffle and returns at most one edge per
fingerprint (a spanning forest of its links)."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, stage_table, steps
from .components import connected_components

SHINGLE_WORDS = 4      # contract of the near-duplicate stage
MAX_BITS = 4
SEED = 42
CELL_LEAVES = 50_000   # leaves that a top node is meant to hold
LEAST_TOP_BITS = 5
FRONTIER = 1 << 19     # node pairs held at once in a cell
LEAF_PAIRS = 64        # node pairs of at most so many leaf pairs are compared leaf by leaf
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of a UTF-8 text: A-Z lower-cased, words split at
    space and 0x09-0x0D, ``width``-word shingles (repeats included; all words
    if there are fewer) hashed by XXH64; a bit is 1 if it is set in over half
    of the hashes. No word: 0."""
    text = b" ".join(text.lower().split())
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 0x20)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(text)]))
    n = max(1, len(starts) - width + 1)
    ends = ends[min(width, len(ends)) - 1:]
    count = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        h = np.array([digest(text[s:e], SEED) for s, e in
                      zip(starts[at:min(n, at + _CHUNK)].tolist(), ends[at:at + _CHUNK].tolist())], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed
    64-bit number. Null and empty texts have no word: 0."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                fp = np.array([fingerprint(t, width) for t in raw_texts(part.column(1))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp bigint")


# --- the trie join of one cell ----------------------------------------------

def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a[i] and b[i]; label[i] is the smallest index of i's class."""
    while True:
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return label
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def trie_links(x: np.ndarray, y: np.ndarray | None, early: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (leaf, class) of the links between the sorted distinct
    values of ``x`` and ``y`` (``y`` None: within ``x``): at most ``most``
    differing bits, at most ``early`` of them in the first 32. A node pair
    whose leaves are all known to be of one class is not followed further."""
    same = y is None
    y = x if same else y
    leaves = x if same else np.concatenate((x, y))
    shift = 0 if same else len(x)
    label = np.arange(len(leaves))
    if not len(x) or not len(y):
        return leaves[:0], leaves[:0]
    run = np.arange(len(leaves))  # equal for neighbours of one class
    stack = [(0, *(np.array([v]) for v in (0, len(x), 0, len(y), 0)))]
    while stack:
        depth, xl, xh, yl, yh, d = stack.pop()
        if len(xl) > FRONTIER:
            half = len(xl) // 2
            stack.append((depth, xl[half:], xh[half:], yl[half:], yh[half:], d[half:]))
            stack.append((depth, xl[:half], xh[:half], yl[:half], yh[:half], d[:half]))
            continue
        one = ((run[xl] == run[xh - 1]) & (run[yl + shift] == run[yh - 1 + shift])
               & (label[xl] == label[yl + shift]))
        pairs = (xh - xl) * (yh - yl)
        small = ~one & (pairs <= LEAF_PAIRS)
        if small.any():
            a, b, wide, n = xl[small], yl[small], (yh - yl)[small], pairs[small]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(a, n) + at // np.repeat(wide, n), np.repeat(b, n) + at % np.repeat(wide, n)
            near = np.bitwise_count(x[i] ^ y[j]) <= most
            if same:
                near &= i < j
            if near.any():
                label = _unite(label, i[near], j[near] + shift)
                run = np.cumsum(np.concatenate(([0], label[1:] != label[:-1])))
        go = ~one & ~small
        if not go.any():
            continue
        xl, xh, yl, yh, d = xl[go], xh[go], yl[go], yh[go], d[go]
        high = np.uint64(((1 << 64) - (1 << (64 - depth))) & ((1 << 64) - 1))
        bit = np.uint64(1 << (63 - depth))
        xm = np.searchsorted(x, (x[xl] & high) | bit)
        ym = np.searchsorted(y, (y[yl] & high) | bit)
        own = (xl == yl) if same else np.zeros(len(xl), dtype=bool)
        parts = []
        for a, b, c, e, more, ok in ((xl, xm, ym, yh, 1, None), (xm, xh, yl, ym, 1, ~own),
                                     (xm, xh, ym, yh, 0, None), (xl, xm, yl, ym, 0, None)):
            ok = (b > a) & (e > c) & (d + more <= (early if depth < 32 else most)) & (True if ok is None else ok)
            parts.append((a[ok], b[ok], c[ok], e[ok], d[ok] + more))
        stack.append((depth + 1, *(np.concatenate(v) for v in zip(*parts))))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return leaves[moved], leaves[label[moved]]


def _masks(bits: int, most: int) -> list[int]:
    """Every number of ``bits`` bits of which at most ``most`` are set."""
    return [sum(1 << k for k in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def link_forest(nodes: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fp`` of
    ``nodes`` just as all pairs of at most ``most`` differing bits would."""
    n = nodes.count()
    bits = max(LEAST_TOP_BITS, math.ceil(math.log2(max(1, n) / CELL_LEAVES)) if n else 0)
    rows = None
    for turned, early in ((0, most // 2), (32, (most - 1) // 2)):
        if early < 0:
            continue
        key = F.col("fp") if not turned else F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
        part = nodes.select(key.alias("key"), F.shiftrightunsigned(key, 64 - bits).alias("top"),
                            F.explode(F.array(*[F.lit(m).cast("bigint") for m in _masks(bits, early)])).alias("mask"))
        other = F.col("top").bitwiseXOR(F.col("mask"))
        part = part.select(F.lit(turned).alias("turned"), F.least("top", other).alias("lo"),
                           F.greatest("top", other).alias("hi"), "key")
        rows = part if rows is None else rows.unionByName(part)

    def cell(key, table):
        turned, lo, hi = (k.as_py() for k in key)
        v = np.sort(table.column("key").to_numpy().view(np.uint64))
        early = most // 2 if not turned else (most - 1) // 2
        if lo == hi:
            a, b = trie_links(v, None, early, most)
        else:
            cut = int(np.searchsorted(v, np.uint64(hi << (64 - bits))))
            a, b = trie_links(v[:cut], v[cut:], early, most)
        if turned:
            a, b = ((z << np.uint64(32)) | (z >> np.uint64(32)) for z in (a, b))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy("turned", "lo", "hi").applyInArrow(cell, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits) and
    ``component_id``, the smallest doc_id that links of at most ``most``
    differing bits reach.

    Equal fingerprints meet once (a group of copies, however large, is one
    leaf). Null texts, empty texts and texts without words have fingerprint
    zero and link like others; rows with a null id get the class of their
    fingerprint and never name it (a class of null ids only has a null id).
    Repeated rows stay; an empty table gives no rows; other columns are not
    read."""
    fps = stage_table(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = stage_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash")
    roots = connected_components(link_forest(nodes, most))
    member = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = stage_table(member.join(named, "root").select("fp", "component_id"), "simhash")
    return fps.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group (rows
    with a null id stay: nothing names them)."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
