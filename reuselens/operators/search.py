"""Scoped exact cosine top-k search (J4/W1) and exact-key joins.

Top-k is computed without emitting all request x entry pairs as rows:
the work is cut into cells (scope, request block, entry block). Block
counts are chosen per scope from its size and the length of its vectors, so a
scope holding a third of all rows is spread over many cells instead of one task. Requests are
replicated once per entry block and entries once per request block; a
cell scores the requests of each of its scopes against that scope's entries
with NumPy matrix products over some requests at a time and emits only each request's local top-k. A final
``row_number() <= k`` (planned as a map-side WindowGroupLimit) merges at
most ``k x entry_blocks`` partial candidates per request.

``topk_of_keys`` is the same search for rows that name their vector by a key. It
searches one entry block of every scope after the other, so that what lies on disk
at once follows the rows and not rows x blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_u32
from ..session import intermediates, materialize

DEFAULT_BLOCK_ROWS = 1024
#: Vector components that a block of requests or entries may hold (16 MB of doubles). What is
#: shuffled is rows x blocks, so blocks are as large as a task's memory allows.
BLOCK_VALUES = 1 << 21
#: Similarities that a cell holds at once.
SCORED_AT_ONCE = 1 << 22
GROUPS = 64
MARGIN = 2e-12  # twice what rounding to 12 digits moves two similarities apart


def _blocks(count_col: str, block_rows):
    return F.greatest(F.lit(1), F.ceil(F.col(count_col) / block_rows)).cast("int")


def _nth_largest(sim: np.ndarray, k: int) -> np.ndarray:
    """Of each row a value that at least ``k`` entries reach (-inf if there are fewer), close to
    the ``k``-th largest: the ``k``-th largest of the maxima of groups of columns."""
    rows, n = sim.shape
    if n <= k:
        return np.full(rows, -np.inf)
    g = n // GROUPS
    if g <= 4 * k:
        return np.partition(sim, n - k, axis=1)[:, n - k]
    tops = sim[:, :GROUPS * g].reshape(rows, GROUPS, g).max(axis=1)
    return np.partition(tops, g - k, axis=1)[:, g - k]


def _top(left: pd.DataFrame, right: pd.DataFrame, k: int, use_time: bool):
    """Request ids, entry ids and similarities of each request's best ``k`` entries (ties by
    entry id). Requests are scored a part at a time, in time order, so that entries later
    than all of a part are not scored."""
    a = np.vstack([np.asarray(v, dtype=np.float64) for v in left["_v"]])
    b = np.vstack([np.asarray(v, dtype=np.float64) for v in right["_v"]])
    times = (left["_rt"].to_numpy(dtype=np.int64), right["_et"].to_numpy(dtype=np.int64)) if use_time else (None, None)
    return _best(a, b, left["_rid"].to_numpy(), right["_eid"].to_numpy(), *times, k)


def _best(a: np.ndarray, b: np.ndarray, rid: np.ndarray, eid: np.ndarray, rt: np.ndarray | None, et: np.ndarray | None, k: int):
    """``_top`` of matrices of request and entry vectors, with their ids and times (none: all entries are visible)."""
    use_time = rt is not None
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    from_, to = np.flatnonzero(na > 0), np.flatnonzero(nb > 0)
    if use_time:
        from_, to = from_[np.argsort(rt[from_], kind="stable")], to[np.argsort(et[to], kind="stable")]
        rt, et = rt[from_], et[to]
    a, na, rid, b, nb, eid = a[from_], na[from_], rid[from_], b[to], nb[to], eid[to]
    finite = np.isfinite(na).all() and np.isfinite(nb).all()
    out = [(rid[:0], eid[:0], np.zeros(0))]
    step = max(1, SCORED_AT_ONCE // max(1, len(b)))
    for i in range(0, len(a), step):
        j = min(i + step, len(a))
        n = np.searchsorted(et, rt[j - 1], side="left") if use_time else len(b)
        if not n:
            continue
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            sim = a[i:j] @ b[:n].T
            sim /= na[i:j, None]
            sim /= nb[None, :n]
        if not finite:
            sim[~np.isfinite(sim)] = -np.inf
        if use_time:
            first = np.searchsorted(et, rt[i], side="left")  # the entries before are visible to all of the part
            sim[:, first:][et[None, first:n] >= rt[i:j, None]] = -np.inf
        least = np.maximum(_nth_largest(sim, k) - MARGIN, np.finfo(float).min)
        row, col = np.nonzero(sim >= least[:, None])
        # cosine, rounded so that equal vectors tie exactly whatever BLAS kernel path
        found = np.round(sim[row, col], 12)
        order = np.lexsort((eid[col], -found, row))
        row, col, found = row[order], col[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        out.append((rid[i + row[rank < k]], eid[col[rank < k]], found[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _order_val(df: DataFrame, c: str | None):
    if c is None:
        return F.lit(None).cast("long")
    return F.unix_micros(F.col(c)) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c).cast("long")


def _packs(sizes: DataFrame, pack_rows) -> DataFrame:
    """One row: how many packs small scopes are dealt over."""
    return sizes.agg(F.sum("_nr").alias("_tr"), F.sum("_ne").alias("_te")).select(
        F.greatest(_blocks("_tr", pack_rows), _blocks("_te", pack_rows)).alias("_np"), F.lit(1).alias("_one"))


def topk_candidates(requests: DataFrame, entries: DataFrame, scope: list[str], k: int,
                    req_id: str = "request_id", entry_id: str = "entry_id", vec: str = "embedding",
                    req_time: str | None = None, entry_time: str | None = None,
                    block_rows: int | None = None) -> DataFrame:
    """Top ``k`` entries of the same scope per request by cosine (desc), ties
    by entry id. Blocks hold ``BLOCK_VALUES`` components, or ``block_rows`` rows. With ``req_time``/``entry_time`` an entry is visible only
    to requests strictly after it. Returns (req_id, entry_id, rank, sim);
    requests without any candidate have no rows."""
    # scope columns are re-aliased (fresh attribute ids) so a self-search
    # (requests and entries from one table) has no ambiguous columns
    r = requests.select(F.col(req_id).alias("_rid"), *[F.col(c).alias(c) for c in scope], F.col(vec).alias("_v"),
                        _order_val(requests, req_time).alias("_rt"))
    e = entries.select(F.col(entry_id).alias("_eid"), *[F.col(c).alias(c) for c in scope], F.col(vec).alias("_v"),
                       _order_val(entries, entry_time).alias("_et"))
    # a zero or missing vector has no similarity and is never a candidate
    r = r.filter(F.col("_v").isNotNull() & (F.size("_v") > 0))
    e = e.filter(F.col("_v").isNotNull() & (F.size("_v") > 0))
    # Per-scope sizes -> block counts (one row per scope; AQE broadcasts it
    # when small and shuffles it otherwise).
    sizes = (r.groupBy(*scope).agg(F.count(F.lit(1)).alias("_nr"))
             .join(e.groupBy(*scope).agg(F.count(F.lit(1)).alias("_ne"), F.max(F.size("_v")).alias("_dims")), scope))
    # Small scopes are packed together: there are as many packs as blocks of
    # ``DEFAULT_BLOCK_ROWS`` requests, or of entries if those are more, and a scope's
    # pack is a hash of its key. A large scope is additionally cut into
    # request x entry blocks.
    pack_rows = F.lit(block_rows or DEFAULT_BLOCK_ROWS)
    packs = _packs(sizes, pack_rows)
    rows = F.lit(block_rows) if block_rows else F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.col("_dims")))
    sizes = (sizes.withColumn("_one", F.lit(1)).join(F.broadcast(packs), "_one")
             .select(*scope, _blocks("_nr", rows).alias("_br"), _blocks("_ne", rows).alias("_be"),
                     F.pmod(F.xxhash64(*scope), F.col("_np")).cast("int").alias("_pack")))
    sk = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in scope])
    rb = (r.join(sizes, scope)
          .withColumn("_rb", F.pmod(hash_u32(F.col("_rid").cast("string")), F.col("_br")).cast("int"))
          .withColumn("_eb", F.explode(F.sequence(F.lit(0), F.col("_be") - 1)))
          .withColumn("_sk", sk).drop("_br", "_be", *scope))
    rb = rb.select(*[F.col(c).alias(c) for c in rb.columns])  # fresh ids: both sides come from `sizes`
    eb = (e.join(sizes, scope)
          .withColumn("_eb", F.pmod(hash_u32(F.col("_eid").cast("string")), F.col("_be")).cast("int"))
          .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_br") - 1)))
          .withColumn("_sk", sk).drop("_br", "_be", *scope))
    eb = eb.select(*[F.col(c).alias(c) for c in eb.columns])
    rid_t = r.schema["_rid"].dataType
    eid_t = e.schema["_eid"].dataType
    out_schema = T.StructType([T.StructField("_rid", rid_t), T.StructField("_eid", eid_t),
                               T.StructField("sim", T.DoubleType())])
    use_time = req_time is not None and entry_time is not None

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_rid": pd.Series([], dtype=object), "_eid": pd.Series([], dtype=object),
                                 "sim": pd.Series([], dtype=float)})
        out = []
        entries = {scope: part for scope, part in right.groupby("_sk", sort=False)}
        for scope, part in left.groupby("_sk", sort=False):  # only pairs within a scope are scored
            if scope in entries:
                out.append(_top(part, entries[scope], k, use_time))
        cols = list(zip(*out)) or [[np.array([], dtype=np.int64)]] * 2 + [[np.array([])]]
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("_rid", "_eid", "sim"), cols)})

    keys = ["_pack", "_rb", "_eb"]
    partial = (rb.groupBy(*keys).cogroup(eb.groupBy(*keys))
               .applyInPandas(cell, out_schema))
    w = Window.partitionBy("_rid").orderBy(F.col("sim").desc(), F.col("_eid"))
    top = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(F.col("_rid").alias(req_id), F.col("_eid").alias(entry_id), "rank", "sim")


def topk_of_keys(requests: DataFrame, entries: DataFrame, vectors: DataFrame, scope: list[str], k: int,
                 req_id: str = "request_id", entry_id: str = "entry_id", key: str = "vec_key", vec: str = "embedding",
                 req_time: str | None = None, entry_time: str | None = None, block_rows: int | None = None) -> DataFrame:
    """``topk_candidates`` of rows that name their vector by its ``key`` in ``vectors`` (a key is there once); ids
    are of one type on both sides.

    A cell gets narrow rows and each vector that they name once. A pass searches one entry block of every
    scope: its shuffles hold each request once and of the block about as many copies of entries as the scope has
    requests. They go, like the candidates of the pass before, when its own are merged and written."""
    spark = requests.sparkSession
    use_time = req_time is not None and entry_time is not None

    def narrow(df, id_, time):  # no time is before all others: such an entry is always visible, such a request sees none
        df = df.select(*[F.col(c).alias(c) for c in scope], F.col(id_).alias("_id"),
                       F.coalesce(_order_val(df, time), F.lit(-(1 << 63))).alias("_t"), F.col(key).alias("_vk"))
        return df.filter(F.col("_id").isNotNull() & F.col("_vk").isNotNull())

    r, e = narrow(requests, req_id, req_time), narrow(entries, entry_id, entry_time)
    v = vectors.select(F.col(key).alias("_vk"), F.col(vec).alias("_v")).filter(F.col("_v").isNotNull() & (F.size("_v") > 0))
    out_schema = T.StructType([T.StructField("_rid", r.schema["_id"].dataType), T.StructField("_eid", e.schema["_id"].dataType),
                               T.StructField("sim", T.DoubleType())])
    w = Window.partitionBy("_rid").orderBy(F.col("sim").desc(), F.col("_eid"))

    def ranked(found):
        top = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return top.select(F.col("_rid").alias(req_id), F.col("_eid").alias(entry_id), "rank", "sim")

    dims = v.agg(F.max(F.size("_v"))).first()[0]
    if not dims:
        return ranked(spark.createDataFrame([], out_schema))
    rows = F.lit(block_rows or max(1, BLOCK_VALUES // dims))
    sizes = (r.groupBy(*scope).agg(F.count(F.lit(1)).alias("_nr"))
             .join(e.groupBy(*scope).agg(F.count(F.lit(1)).alias("_ne")), scope))
    sizes = materialize(sizes.withColumn("_sc", F.monotonically_increasing_id()), "scopes")
    passes = sizes.agg(F.max(_blocks("_ne", rows))).first()[0]
    if not passes:
        return ranked(spark.createDataFrame([], out_schema))
    cut = (sizes.withColumn("_one", F.lit(1)).join(F.broadcast(_packs(sizes, F.lit(block_rows or DEFAULT_BLOCK_ROWS))), "_one")
           .select(*scope, "_sc", _blocks("_nr", rows).alias("_br"), _blocks("_ne", rows).alias("_be"),
                   F.pmod(F.xxhash64("_sc"), F.col("_np")).cast("int").alias("_pack")))
    cell_key, cols = ["_pack", "_rb"], ["_pack", "_rb", "_sc", "_entry", "_id", "_t", "_vk"]

    def cell(both: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        place = pd.Index(held["_vk"]).get_indexer(both["_vk"])
        both, place = both[place >= 0].reset_index(drop=True), place[place >= 0]
        vecs, ids = held["_v"].to_numpy(), both["_id"].to_numpy()
        entry, time = both["_entry"].to_numpy(dtype=bool), both["_t"].to_numpy()
        out = [(ids[:0], ids[:0], np.zeros(0))]
        for at in both.groupby("_sc", sort=False).indices.values():  # only pairs within a scope are scored
            i, j = at[~entry[at]], at[entry[at]]
            if not len(i) or not len(j):
                continue
            used, of = np.unique(place[at], return_inverse=True)
            m = np.vstack([np.asarray(x, dtype=np.float64) for x in vecs[used]])
            times = (time[i].astype(np.int64), time[j].astype(np.int64)) if use_time else (None, None)
            out.append(_best(m[of[~entry[at]]], m[of[entry[at]]], ids[i], ids[j], *times, k))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("_rid", "_eid", "sim"), zip(*out))})

    block = lambda c: F.pmod(hash_u32(F.col("_id").cast("string")), F.col(c)).cast("int")
    left = r.join(cut, scope).withColumn("_rb", block("_br")).withColumn("_entry", F.lit(False)).select(*cols, "_be")
    right = e.join(cut, scope).withColumn("_eb", block("_be")).withColumn("_entry", F.lit(True)).select(
        *[c for c in cols if c != "_rb"], "_br", "_eb")

    def one_pass(p: int) -> DataFrame:
        copies = right.filter(F.col("_eb") == p).withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_br") - 1)))
        both = left.filter(F.col("_be") > p).select(*cols).unionByName(copies.select(*cols))
        held = both.select(*cell_key, "_vk").distinct().join(v, "_vk")
        held = held.select(*[F.col(c).alias(c) for c in (*cell_key, "_vk", "_v")])  # fresh ids: both sides come from `both`
        return both.groupBy(*cell_key).cogroup(held.groupBy(*cell_key)).applyInPandas(cell, out_schema)

    if passes == 1:
        return ranked(one_pass(0))
    with intermediates(spark) as drop_but:
        left, right = materialize(left, "asked"), materialize(right, "held")
        best = materialize(ranked(one_pass(0)), "best")
        for p in range(1, passes):
            known = best.select(F.col(req_id).alias("_rid"), F.col(entry_id).alias("_eid"), "sim")
            best = materialize(ranked(known.unionByName(one_pass(p))), "best")
            drop_but(best, left, right)
        drop_but(best)
    return best


def first_writer(requests: DataFrame, key: list[str], id_col: str, time_col: str) -> DataFrame:
    """One entry per key, the earliest request (ties by id). A plain
    aggregate with map-side partial min_by: a hot key costs one row per task."""
    return (requests.groupBy(*key)
            .agg(F.min_by(F.col(id_col), F.struct(time_col, id_col)).alias("entry_id"),
                 F.min(time_col).alias("created_at")))


def exact_match(requests: DataFrame, entries: DataFrame, key: list[str], id_col: str = "request_id",
                time_col: str = "ts") -> DataFrame:
    """Left join on the exact key; a hit is an entry created strictly
    before the request (the entries side has one row per key, so a hot
    key cannot skew the join)."""
    j = requests.join(entries, key, "left")
    hit = F.col("entry_id").isNotNull() & (F.col("created_at") < F.col(time_col))
    return j.withColumn("exact_hit", F.coalesce(hit, F.lit(False))) \
        .withColumn("exact_entry_id", F.when(F.col("exact_hit"), F.col("entry_id"))) \
        .drop("entry_id", "created_at")
