import math

import numpy as np
from pyspark.sql import functions as F

from reuselens.llm import neighbours as nb


def dot(v, w):
    total = 0.0  # sum() of floats compensates for rounding
    for a, b in zip(v, w):
        total += a * b
    return total


def brute(rows, k=20):
    """Exact neighbours of every query, products summed in order."""
    seen = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            seen[i] = min(seen.get(i, v), v)
    sizes = [len(v) for v in seen.values()]
    most = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    seen = {i: v for i, v in seen.items() if len(v) == most}
    out = {}
    for q, v in seen.items():
        if q % 20 == 0:
            scored = sorted((-dot(v, w), i) for i, w in seen.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_hilbert_visits_every_cell_in_steps_of_one():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        place = nb.hilbert(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        walk = grid[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_recall_over_a_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    want, found = brute(rows), got(nb.search(vectors, F.col("vec_id") % 20 == 0, block=64))
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    exact = {(q, i): s for q in found for i, s in found[q]}
    by_id = dict(rows)
    assert all(s == dot(by_id[q], by_id[i]) for (q, i), s in exact.items())


def test_clusters_need_small_windows(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 10
    rows = [(i, (centres[i % 40] + rng.normal(size=8) * 0.1).tolist()) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, found = brute(rows), got(nb.search(vectors, F.col("vec_id") % 20 == 0, block=50))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(120)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 0.0]), (280, [float("nan"), 1.0, 1.0]),
             (300, [float("inf"), 1.0, 1.0]), (320, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (340, [100.0, 0.0, 0.0]),
             (340, [100.0, 0.0, 0.0]), (360, [5.0, 5.0, 5.0]), (360, [5.0, 5.0, 4.0])] + [(400 + i, [1.0, 1.0, 2.0]) for i in range(60)]
    vectors = spark.createDataFrame([(v, i, "x", 1) for i, v in rows], "embedding array<double>, vec_id long, v string, node int")
    found = got(nb.search(vectors, F.col("vec_id") % 20 == 0, recall=1.0, block=16))
    assert found == brute(rows)
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]
    assert got(nb.search(spark.createDataFrame(few, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)) == brute(few)
    assert nb.search(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_groups_are_bounded(spark, monkeypatch):
    """Results do not depend on how many blocks share a group, and no group gets more than it may."""
    from pyspark.sql import GroupedData
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1500, 8)))],
                                    "vec_id long, embedding array<double>").coalesce(1)

    def search():
        return sorted(map(tuple, nb.search(vectors, F.col("vec_id") % 5 == 0, block=32).collect()))

    want = search()
    most = 2
    monkeypatch.setattr(nb, "CELL_PACKS", most)
    monkeypatch.setattr(nb, "MERGED_BLOCKS", most)
    cogrouped, grouped = PandasCogroupedOps.applyInArrow, GroupedData.applyInArrow

    def few_packs(self, func, schema):
        def run(left, right):
            assert left.num_rows == 1 and right.num_rows <= most
            return func(left, right)
        return cogrouped(self, run, schema)

    def few_results(self, func, schema):
        def run(table):
            assert table.num_rows <= 16
            return func(table)
        return grouped(self, run, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", few_packs)
    monkeypatch.setattr(GroupedData, "applyInArrow", few_results)
    assert search() == want and len(want) > 1500


def test_large_and_tiny_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(100)]
    rows += [(100, [1e200, 0.0, 0.0, 0.0]), (101, [0.0, -1e200, 1e-200, 0.0]), (120, [1e-300, 2e-300, 0.0, 1e-300]), (140, [3e200, 1e200, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(nb.search(vectors, F.col("vec_id") % 20 == 0))
    want = brute(rows)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    by_id = dict(rows)
    assert all(s == dot(by_id[q], by_id[i]) for q in found for i, s in found[q])
