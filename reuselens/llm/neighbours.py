"""Approximate nearest neighbours by inner product on shifted space-filling
curves.

Vectors get one more component that makes their norms equal, so that the
largest inner product with a query is the smallest distance to the query's
direction. Principal components (fitted on a bounded sample) are dealt to
``CURVES`` Hilbert curves of ``DIMS`` dimensions, each shifted by an amount of
its own. All vectors and queries are range-partitioned by curve and key and
packed, in that order, into blocks. A query meets the vectors at most
``reach`` rows away on any curve; the nearest of each curve are merged and
reranked by the exact inner product of the original vectors.

``reach`` is fitted: for a bounded sample of queries the exact neighbours are
found by a pass over all vectors, and ``reach`` is the least distance along the
curves that holds ``RECALL`` of them. So recall follows the target on any data;
what follows the data is the work. Vectors without structure need windows of a
large part of the table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

K = 20
CURVES = 4
DIMS = 4
BITS = 15
RECALL = 0.96          # of the sampled queries' neighbours, that the fitted reach holds
SAMPLE_ROWS = 4096     # most vectors that the components are fitted on
SAMPLE_QUERIES = 256   # most queries that the reach is fitted on
BLOCK = 2048           # most vectors of a block
CELL_PACKS = 16        # most blocks of queries that one block is scored against in a task's group
MERGED_BLOCKS = 32     # rows of so many full blocks are a stretch, whose results are merged at once
_QUERIES = 256         # queries scored at once


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of every row of integer coordinates
    (``rows x dims``), by the transposition of Gray codes."""
    c = cells.T.astype(np.int64).copy()
    dims = len(c)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            inside = (c[i] & q) != 0
            swap = np.where(inside, 0, (c[0] ^ c[i]) & p)
            c[0] ^= np.where(inside, p, swap)
            c[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        c[i] ^= c[i - 1]
    turn = np.zeros_like(c[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(c[dims - 1] & q, q - 1, 0)
        q >>= 1
    c ^= turn
    out = np.zeros_like(c[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((c[i] >> b) & 1)
    return out


class Curves:
    """Projection and curves, from a sample of vectors and the largest norm of
    all. Vectors are multiplied by ``scale`` first, so that no square overflows."""

    def __init__(self, sample: np.ndarray, largest: float, curves: int = CURVES, dims: int = DIMS, seed: int = 7,
                 scale: float = 1.0):
        self.largest, self.scale = largest, scale
        x = self.lifted(sample)
        self.mean = x.mean(axis=0)
        _, vectors = np.linalg.eigh(np.atleast_2d(np.cov((x - self.mean).T, bias=True)))
        order = np.arange(curves * dims) % x.shape[1]
        self.axes = vectors[:, ::-1][:, order]
        y = (x - self.mean) @ self.axes
        self.low, self.width = y.min(axis=0), np.maximum(np.ptp(y, axis=0), 1e-12)
        self.shift = np.random.default_rng(seed).random(curves * dims) / 2
        self.curves, self.dims = curves, dims

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        return np.column_stack((x, np.sqrt(np.maximum(0, self.largest ** 2 - (x * x).sum(axis=1)))))

    def keys(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """``curves x rows`` keys of vectors, or of query directions."""
        if queries:
            x = _direction(x)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.column_stack((x * (self.largest / norm), np.zeros(len(x))))
        else:
            x = self.lifted(x)
        unit = ((x - self.mean) @ self.axes - self.low) / self.width / 2 + self.shift
        cells = (np.clip(unit, 0, 1 - 2 ** -40) * (1 << BITS)).astype(np.int64)
        return np.stack([hilbert(cells[:, j * self.dims:(j + 1) * self.dims], BITS) for j in range(self.curves)])


def _direction(q: np.ndarray) -> np.ndarray:
    """Vectors with components of 1 at most: a power of two does not change the order of their products."""
    return np.ldexp(q, -np.frexp(np.abs(q).max(axis=1, keepdims=True))[1])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _best(score: np.ndarray, ids: np.ndarray, k: int):
    """Per row of ``score`` the ``k`` best columns, ties to smaller ids: ids and scores, padded with -1."""
    rows, n = score.shape
    out_ids, out = np.full((rows, k), -1, dtype=np.int64), np.full((rows, k), -np.inf)
    floor = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(rows, -np.inf)
    for i in range(rows):
        at = np.flatnonzero(score[i] >= floor[i])
        at = at[np.lexsort((ids[at], -score[i, at]))][:k]
        out_ids[i, :len(at)], out[i, :len(at)] = ids[at], score[i, at]
    return out_ids, out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part: not null, of finite
    components, not zero, and as long as most are; ids not null, one row each."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    most = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.filter(F.size("v") == (most.n if most else 0))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
           recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per query (a row for which ``is_query``, over the id as ``vec_id``,
    holds) its ``k`` nearest others: ``query_id, rank, vec_id, score``, by
    descending inner product (in double precision, summed in order), ties by
    ``vec_id``; all others, if there are fewer.

    Vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part, nor do null ids. Equal vectors are
    one in the index, with their ``k + 1`` smallest ids, which is all that a
    result can name; of rows repeated under one id the vector first in order
    counts. An empty table gives no rows; other columns are not read."""
    rows = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    # one node for equal vectors; the row limit of the window is applied before its shuffle
    number = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = stage_table(rows.withColumn("r", number).filter(F.col("r") <= k + 1)
                        .groupBy("v").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")),
                        "nodes")
    asked = stage_table(rows.filter(is_query), "asked")
    answers = stage_table(asked.join(nodes.select("v", "node"), "v").select(F.col("vec_id").alias("query_id"), "node"), "answers")
    flagged = stage_table(nodes.join(answers.select("node").distinct().withColumn("asked", F.lit(True)), "node", "left")
                          .select("node", "v", F.coalesce("asked", F.lit(False)).alias("asked")), "flagged")
    found = _nearest_nodes(flagged, k + 1, recall, block)

    # ids of the nearest nodes, at most k + 1 for each asked node, then each query without itself
    exact = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = (found.join(nodes.select(F.col("node").alias("asked_node"), F.col("v").alias("qv")), "asked_node")
             .join(nodes, "node").select("asked_node", F.explode("ids").alias("vec_id"), exact.alias("score")))
    best = Window.partitionBy("asked_node").orderBy(F.desc("score"), "vec_id")
    named = stage_table(pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"), "named")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (answers.join(named, answers["node"] == named["asked_node"]).filter("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _nearest_nodes(nodes: DataFrame, k: int, recall: float, block: int) -> DataFrame:
    """``(asked_node, node)``: the nearest nodes found for each asked node."""
    spark = nodes.sparkSession
    empty = spark.createDataFrame([], "asked_node bigint, node bigint")
    top = nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    if top is None:
        return empty
    scale = float(np.ldexp(1.0, min(1000, -int(np.frexp(top)[1]))))
    largest = nodes.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * scale * (x * scale))))).first()[0]
    mix = F.xxhash64("node")
    sample = np.array([r.v for r in nodes.orderBy(mix).limit(SAMPLE_ROWS).collect()])
    curves = Curves(sample, largest, scale=scale)
    queries = nodes.filter("asked").orderBy(mix).limit(SAMPLE_QUERIES).collect()
    if not queries:
        return empty

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            asked = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            for query, at in ((False, np.arange(len(v))), (True, asked)):
                if len(at):
                    part = batch.take(pa.array(at))
                    for j, key in enumerate(curves.keys(v[at], query)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), j, np.int32)), pa.array(key), part.column(0),
                             pa.array(np.full(len(at), query)), part.column(1)], ["curve", "key", "node", "query", "v"])

    lines = nodes.mapInArrow(keyed, "curve int, key bigint, node bigint, query boolean, v array<double>")
    lines = (lines.repartitionByRange("curve", "key", "node", "query").withColumn("part", F.spark_partition_id())
             .sortWithinPartitions("curve", "key", "node", "query"))

    def packed(batches):
        """Blocks of neighbouring rows, with the queries that stand among them."""
        held: dict[str, list] = {"node": [], "v": [], "q": [], "qv": []}
        now, number = None, 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([len(held["node"])], pa.int64()), pa.array([len(held["q"])], pa.int64()),
                 *(pa.array([np.array(held[c], dtype=t).tobytes()], pa.binary())
                   for c, t in (("node", "<i8"), ("v", "<f8"), ("q", "<i8"), ("qv", "<f8")))],
                ["curve", "part", "number", "n", "nq", "node", "v", "q", "qv"])

        for batch in batches:
            curve, node, query, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 5))
            v = _matrix(batch.column(4)) if batch.num_rows else None
            for i in range(batch.num_rows):
                if now is not None and ((curve[i], part[i]) != now or max(len(held["node"]), len(held["q"])) >= block):
                    yield flush()
                    held = {c: [] for c in held}
                    number += 1
                now = (curve[i], part[i])
                a, b = ("q", "qv") if query[i] else ("node", "v")
                held[a].append(node[i])
                held[b].append(v[i])
        if now is not None:
            yield flush()

    blocks = stage_table(lines.mapInArrow(
        packed, "curve int, part int, number int, n bigint, nq bigint, node binary, v binary, q binary, qv binary"), "blocks")
    # a row per block: where its rows begin on their curve
    before = Window.partitionBy("curve").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    where = stage_table(blocks.select("curve", "part", "number", "n", "nq",
                                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "where")
    reach = _fit_reach(nodes, blocks, where, queries, k, recall)

    # queries of a block go to the blocks within reach of it: an equi-join of coarse steps, then the exact test
    step = reach + block
    left = where.filter("nq > 0").select(
        "curve", F.col("part").alias("q_part"), F.col("number").alias("q_number"), F.col("start").alias("q_start"),
        F.col("n").alias("q_n"), F.explode(F.sequence(
            F.floor((F.col("start") - reach - block) / step), F.floor((F.col("start") + F.col("n") + reach) / step))).alias("step"))
    right = where.filter("n > 0").select("curve", "part", "number", "start", "n", F.floor(F.col("start") / step).alias("step"))
    near = (left.join(right, ["curve", "step"])
            .filter(F.col("start") <= F.col("q_start") + F.col("q_n") + reach)
            .filter(F.col("start") + F.col("n") >= F.col("q_start") - reach)
            .select("curve", "part", "number", "q_part", "q_number",
                    F.floor(F.col("q_number") / CELL_PACKS).alias("cell"),
                    F.floor(F.col("start") / (MERGED_BLOCKS * block)).alias("stretch")))
    packs = near.join(blocks.select("curve", F.col("part").alias("q_part"), F.col("number").alias("q_number"), "q", "qv"),
                      ["curve", "q_part", "q_number"])
    # a cell holds one block and at most CELL_PACKS packs of queries
    spots = ["curve", "part", "number", "q_part", "cell"]
    cells = near.select("curve", "part", "number", *[F.col(c).alias(c) for c in ("q_part", "cell")]).distinct()
    copies = blocks.select("curve", "part", "number", "node", "v").join(cells, ["curve", "part", "number"])

    def score(left, right):
        out = []
        if left.num_rows and right.num_rows:
            ids = np.frombuffer(left.column("node")[0].as_py(), "<i8")
            v = np.frombuffer(left.column("v")[0].as_py(), "<f8").reshape(len(ids), -1)
            for row in right.to_pylist():
                q = np.frombuffer(row["q"], "<i8")
                qv = _direction(np.frombuffer(row["qv"], "<f8").reshape(len(q), -1))
                got = [_best(qv[i:i + _QUERIES] @ v.T, ids, k) for i in range(0, len(q), _QUERIES)]
                out.append((row["curve"], row["q_part"], row["q_number"], row["stretch"], row["q"],
                            np.concatenate([g[0] for g in got]).tobytes(), np.concatenate([g[1] for g in got]).tobytes()))
        columns = list(zip(*out)) or [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    names = ["curve", "q_part", "q_number", "stretch", "q", "ids", "scores"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    scored = (copies.groupBy(*spots).cogroup(packs.groupBy(*spots))
              .applyInArrow(score, "curve int, q_part int, q_number int, stretch bigint, q binary, ids binary, scores binary"))

    def merge(table):
        q = np.frombuffer(table.column("q")[0].as_py(), "<i8")
        ids = np.concatenate([np.frombuffer(x.as_py(), "<i8").reshape(len(q), -1) for x in table.column("ids")], axis=1)
        sc = np.concatenate([np.frombuffer(x.as_py(), "<f8").reshape(len(q), -1) for x in table.column("scores")], axis=1)
        order = np.lexsort((ids, -sc), axis=1)[:, :k]
        ids, sc = np.take_along_axis(ids, order, 1), np.take_along_axis(sc, order, 1)
        real = np.isfinite(sc)
        return pa.table({"asked_node": np.repeat(q, real.sum(axis=1)), "node": ids[real], "score": sc[real]})

    # only blocks of one stretch of a curve are merged at once; the window below merges the stretches
    merged = scored.groupBy("curve", "q_part", "q_number", "stretch").applyInArrow(merge, "asked_node bigint, node bigint, score double")
    best = Window.partitionBy("asked_node").orderBy(F.desc("score"), "node")
    return (merged.groupBy("asked_node", "node").agg(F.max("score").alias("score"))
            .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("asked_node", "node"))


def _fit_reach(nodes: DataFrame, blocks: DataFrame, where: DataFrame, queries: list, k: int, recall: float) -> int:
    """Least number of rows along the curves that holds ``recall`` of the
    sampled queries' exact neighbours (of the better curve for each)."""
    qid = np.array([r.node for r in queries])
    qv = _direction(np.array([r.v for r in queries]))

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                ids, score = _best(qv @ _matrix(batch.column(1)).T, batch.column(0).to_numpy(), k)
                real = ids >= 0
                real &= np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, real.sum(axis=1))), pa.array(ids[real]),
                                                  pa.array(score[real])], ["asked_node", "node", "score"])

    best = Window.partitionBy("asked_node").orderBy(F.desc("score"), "node")
    truth = (nodes.select("node", "v").mapInArrow(exact, "asked_node bigint, node bigint, score double")
             .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).collect())  # at most k a sampled query
    wanted = np.unique(np.array([r.node for r in truth], dtype=np.int64))
    asked = np.sort(qid)

    def places(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, q = np.frombuffer(row["node"], "<i8"), np.frombuffer(row["q"], "<i8")
                for kind, mine, among in ((0, ids, wanted), (1, q, asked)):
                    at = np.flatnonzero(np.isin(mine, among))
                    if len(at):
                        # a query's place among the rows of its block is not kept: the middle stands for it
                        spot = at if kind == 0 else np.full(len(at), len(ids) // 2)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), row["curve"], np.int32)), pa.array(spot + row["start"]),
                             pa.array(mine[at]), pa.array(np.full(len(at), kind, np.int32))], ["curve", "at", "node", "kind"])

    at = {(r.kind, r.node, r.curve): r.at for r in
          blocks.join(where.select("curve", "part", "number", "start"), ["curve", "part", "number"])
          .select("curve", "node", "q", "start").mapInArrow(places, "curve int, at bigint, node bigint, kind int").collect()}
    far = sorted(min(abs(at[0, r.node, j] - at[1, r.asked_node, j]) for j in range(CURVES)) for r in truth)
    return int(far[min(len(far) - 1, int(np.ceil(recall * len(far))))])
