"""Scoped exact top-k that skips pairs of blocks.

Unit vectors keep the triangle inequality of angles: a request and an entry are
at least as far apart as their angles to any third vector differ. Requests and
entries of a scope are cut into blocks by nearest pivot, then by time, so a block
has a narrow range of times and of angles to every pivot. A pair of blocks needs
no scoring if every entry is later than every request, or if the two ranges of
angles are so far apart that no entry can reach the similarity that each request
of the block has already found ``k`` times in its first block.

Blocks, not rows, are paired to decide this. What is left is scored as in
``search``: one matrix product per pair of blocks, local top-k, a merge by
``row_number() <= k``. The result is exact whatever the pivots are; they only
decide how much is skipped. On vectors without structure angles skip hardly
anything and the work stays quadratic, less what time skips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_key
from ..functions.vectors import l2_norm
from ..session import materialize
from . import ranking
from .search import _top

BLOCK_ROWS = 1024
PIVOTS = 8
#: Time slices a (scope, pivot) is cut into at most; beyond them blocks are split by a hash of the id.
TIME_SLICES = 1000
#: What rounding may add to an angle; far above the error of an arc cosine.
SLACK = 1e-7


def pivot_angles(pivots: list[list[float]]):
    """A UDF: a vector's angle to every pivot, 0 to one of another length."""
    by_dim: dict[int, tuple[list[int], np.ndarray]] = {}
    for d in {len(p) for p in pivots}:
        at = [i for i, p in enumerate(pivots) if len(p) == d]
        m = np.array([pivots[i] for i in at])
        by_dim[d] = (at, m / np.linalg.norm(m, axis=1)[:, None])
    n = len(pivots)

    @F.pandas_udf("array<double>")
    def angles(v: pd.Series) -> pd.Series:
        out = np.zeros((len(v), n))
        dims = v.map(len).to_numpy()
        for d, (at, unit) in by_dim.items():
            rows = np.flatnonzero(dims == d)
            if len(rows):
                a = np.vstack(v.iloc[rows].to_list()).astype(np.float64)
                cos = a @ unit.T / np.linalg.norm(a, axis=1)[:, None]
                out[np.ix_(rows, at)] = np.arccos(np.clip(cos, -1.0, 1.0))
        return pd.Series(list(out), index=v.index)
    return angles


def _order(df: DataFrame, c: str | None):
    if c is None:
        return F.lit(0).cast("long")
    return F.unix_micros(F.col(c)) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c).cast("long")


def _side(df: DataFrame, scope: list[str], id_col: str, vec: str, time: str | None) -> DataFrame:
    """Rows that can match: a whole scope, a time, a finite vector of some length."""
    d = df.select(F.col(id_col).alias("_id"), F.to_json(F.struct(*[F.col(c).alias(c) for c in scope], F.size(vec).alias("_dim"))).alias("_sk"),
                  F.col(vec).cast("array<double>").alias("_v"), _order(df, time).alias("_t"),
                  *[F.col(c).isNull().alias(f"_null{i}") for i, c in enumerate(scope)])
    norm = l2_norm(F.col("_v"))
    ok = (norm > 0) & (norm < F.lit(float("inf"))) & F.col("_t").isNotNull()
    for i in range(len(scope)):
        ok = ok & ~F.col(f"_null{i}")
    return d.filter(ok).select("_id", "_sk", "_v", "_t")


def _blocked(side: DataFrame, angles, block_rows: int) -> DataFrame:
    """The rows with their angles ``_a`` and block ``_b`` (of its scope ``_sk``)."""
    d = side.withColumn("_a", angles("_v")).withColumn("_p", F.array_position("_a", F.array_min("_a")))
    d = materialize(d, "angles")
    keys = ["_sk", "_p"]
    ranges = min(TIME_SLICES, ranking.slices(d, keys, block_rows))
    sizes = d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_nb"))
    d = ranking.with_range(d, keys, "_t", ranges).join(sizes, keys)
    cut = F.floor(F.col("_r") * F.least("_nb", F.lit(ranges)) / F.lit(ranges))
    split = F.pmod(F.xxhash64("_id"), F.ceil(F.col("_nb") / F.lit(ranges)))
    return materialize(d.withColumn("_b", F.concat_ws("/", "_p", cut, split)).select("_id", "_sk", "_b", "_v", "_t", "_a"), "blocks")


def _summary(blocked: DataFrame, side: str, n_pivots: int) -> DataFrame:
    """One row per block: rows, range of times, range of angles to every pivot."""
    angle = lambda f: F.array(*[f(F.element_at("_a", i + 1)) for i in range(n_pivots)])
    return blocked.groupBy("_sk", F.col("_b").alias(f"{side}b")).agg(
        F.count(F.lit(1)).alias(f"{side}n"), F.min("_t").alias(f"{side}t0"), F.max("_t").alias(f"{side}t1"),
        angle(F.min).alias(f"{side}lo"), angle(F.max).alias(f"{side}hi"))


def _score(r: DataFrame, e: DataFrame, pairs: DataFrame, k: int, block_rows: int, use_time: bool) -> DataFrame:
    """Local top-k (_rid, _eid, sim) of the given pairs of blocks; several
    small pairs share a task's group, no group holds many large ones."""
    work = pairs.agg(F.sum(F.col("rn") * F.col("en")).alias("pairs"), F.sum(F.col("rn") + F.col("en")).alias("rows")).first()
    packs = max(1, -(-(work["pairs"] or 0) // block_rows ** 2), -(-(work["rows"] or 0) // (8 * block_rows)))
    p = pairs.select("_sk", "rb", "eb", F.pmod(F.xxhash64("_sk", "rb", "eb"), F.lit(packs)).alias("_pack"))
    left = r.select("_sk", F.col("_b").alias("rb"), F.col("_id").alias("_rid"), "_v", F.col("_t").alias("_rt")).join(p, ["_sk", "rb"])
    right = e.select("_sk", F.col("_b").alias("eb"), F.col("_id").alias("_eid"), "_v", F.col("_t").alias("_et")).join(p, ["_sk", "eb"])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # fresh ids: both sides come from `p`
    schema = T.StructType([T.StructField("_rid", r.schema["_id"].dataType), T.StructField("_eid", e.schema["_id"].dataType),
                           T.StructField("sim", T.DoubleType())])
    pair = ["_sk", "rb", "eb"]

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        entries = dict(list(b.groupby(pair, sort=False))) if len(b) else {}
        out = [_top(part, entries[key].sort_values("_eid", kind="stable"), k, use_time)
               for key, part in (a.groupby(pair, sort=False) if len(a) else []) if key in entries]
        if not out:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(schema.fieldNames(), zip(*out))})
    return left.groupBy("_pack").cogroup(right.groupBy("_pack")).applyInPandas(cell, schema)


def pruned_topk(requests: DataFrame, entries: DataFrame, scope: list[str], k: int, req_id: str = "request_id",
                entry_id: str = "entry_id", vec: str = "embedding", req_time: str | None = None,
                entry_time: str | None = None, block_rows: int = BLOCK_ROWS, n_pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """``(candidates, work)``. Candidates are those of ``search.topk_candidates``:
    (req_id, entry_id, rank, sim). Rows with a null in the scope, a null time, or a
    vector that is null, empty, zero or not finite match nothing, as do vectors of
    different lengths; a repeated row is a candidate each time. ``work`` is one row that
    counts pairs of rows: ``pairs`` (same scope), ``later``, ``far`` (both skipped) and ``scored``."""
    use_time = req_time is not None and entry_time is not None
    r = _side(requests, scope, req_id, vec, req_time if use_time else None)
    e = _side(entries, scope, entry_id, vec, entry_time if use_time else None)
    some = e.orderBy(hash_key(0, F.col("_id")), "_id").limit(n_pivots).select("_v").collect()
    pivots = [x["_v"] for x in some] or [[1.0]]
    angles = pivot_angles(pivots)
    r, e = _blocked(r, angles, block_rows), _blocked(e, angles, block_rows)
    rs, es = _summary(r, "r", len(pivots)), _summary(e, "e", len(pivots))
    apart = F.array_max(F.concat(F.zip_with("rlo", "ehi", lambda x, y: x - y), F.zip_with("elo", "rhi", lambda x, y: x - y)))
    late = F.col("et0") >= F.col("rt1") if use_time else F.lit(False)
    whole = F.col("et1") < F.col("rt0") if use_time else F.lit(True)
    blocks = materialize(rs.join(es, "_sk").select(
        "_sk", "rb", "eb", "rn", "en", late.alias("late"), whole.alias("whole"), "et1",
        F.cos(F.greatest(apart - F.lit(SLACK), F.lit(0.0))).alias("reach")), "block_pairs")
    # the first block of a request block: wholly earlier if there is one, then the nearest, then the latest
    first = materialize(blocks.filter("not late").groupBy("_sk", "rb").agg(
        F.max_by(F.struct("eb", "rn", "en"), F.struct("whole", "reach", "et1", "eb")).alias("s"))
        .select("_sk", "rb", "s.*"), "first_blocks")
    near = materialize(_score(r, e, first, k, block_rows, use_time), "first_found")
    kth = near.groupBy("_rid").agg(F.count(F.lit(1)).alias("found"), F.min("sim").alias("kth")).filter(F.col("found") >= k)
    # what every request of a block has reached; null while one of them has found fewer than k
    reached = (r.select("_sk", F.col("_b").alias("rb"), F.col("_id").alias("_rid")).join(kth, "_rid", "left")
               .groupBy("_sk", "rb").agg(F.when(F.count("kth") == F.count(F.lit(1)), F.min("kth")).alias("reached")))
    judged = (blocks.join(reached, ["_sk", "rb"])
              .join(first.select("_sk", "rb", "eb", F.lit(True).alias("done")), ["_sk", "rb", "eb"], "left")
              .withColumn("far", ~F.col("late") & F.col("done").isNull()
                          & F.coalesce(F.col("reach") < F.col("reached") - F.lit(1e-9), F.lit(False))))
    judged = materialize(judged, "judged_pairs")
    rest = _score(r, e, judged.filter("not late and not far and done is null"), k, block_rows, use_time)
    w = Window.partitionBy("_rid").orderBy(F.col("sim").desc(), F.col("_eid"))
    top = near.unionByName(rest).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    n = F.col("rn") * F.col("en")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    work = judged.agg(total(F.lit(True)).alias("pairs"), total(F.col("late")).alias("later"), total(F.col("far")).alias("far"),
                      total(~F.col("late") & ~F.col("far")).alias("scored"))
    return top.select(F.col("_rid").alias(req_id), F.col("_eid").alias(entry_id), "rank", "sim"), work
