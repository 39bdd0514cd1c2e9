"""Pruned search: the rows of the plain search, and what it skips."""

import numpy as np
import pytest

from reuselens.operators.pruned_search import pruned_topk
from reuselens.operators.search import topk_candidates

SCHEMA = "id long, scope string, v array<double>, t long"


def rows(n, seed, clusters=6, spread=0.05):
    """Vectors around a few directions; one scope holds two thirds."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(clusters, 8))
    return [(i, "hot" if i % 3 else f"s{i % 7}", [float(x) for x in centres[int(rng.integers(clusters))] + spread * rng.normal(size=8)],
             int(rng.integers(0, 400))) for i in range(n)]


def found(df):
    return sorted((x.id, x["rank"], x.eid, round(x.sim, 9)) for x in df.collect())


def both(spark, reqs, ents, k=3, time=True, block=32):
    r = spark.createDataFrame(reqs, SCHEMA)
    e = spark.createDataFrame(ents, SCHEMA).withColumnRenamed("id", "eid").withColumnRenamed("t", "u")
    kw = dict(req_id="id", entry_id="eid", vec="v", req_time="t" if time else None, entry_time="u" if time else None)
    got, work = pruned_topk(r, e, ["scope"], k, block_rows=block, **kw)
    return got, work.first(), topk_candidates(r, e, ["scope"], k, block_rows=1024, **kw)


@pytest.mark.parametrize("time", [True, False])
def test_same_rows_and_pairs_skipped(spark, time):
    got, work, want = both(spark, rows(900, 2), rows(1200, 3), time=time)
    assert found(got) == found(want)
    assert work.pairs == work.later + work.far + work.scored
    assert work.far > work.pairs // 4 and (work.later > work.pairs // 10) == time


def test_without_structure_nothing_is_lost(spark):
    rng = np.random.default_rng(5)
    flat = [(i, "x", [float(v) for v in rng.normal(size=8)], i) for i in range(500)]
    got, work, want = both(spark, flat, flat, block=8)
    assert found(got) == found(want)
    assert work.pairs == 500 * 500 and work.later > work.pairs // 3


def test_odd_rows(spark):
    odd = [(1, "x", None, 1), (2, "x", [], 1), (3, "x", [0.0, 0.0], 1), (4, None, [1.0, 0.0], 1), (5, "x", [1.0, 0.0], None),
           (6, "x", [float("nan"), 1.0], 1), (7, "x", [1.0, 0.0], 1), (7, "x", [1.0, 0.0], 1), (8, "x", [2.0, 0.0], 1), (9, "x", [1.0, 0.0, 0.0], 1)]
    got, work, _ = both(spark, [(100, "x", [3.0, 0.0], 9), (101, "y", [1.0, 0.0], 9), (102, "x", None, 9)], odd, k=5)
    assert found(got) == [(100, 1, 7, 1.0), (100, 2, 7, 1.0), (100, 3, 8, 1.0)]
    assert work.scored == 3


def test_empty_tables(spark):
    for reqs, ents in ((rows(5, 1), []), ([], rows(5, 1)), ([], [])):
        got, work, _ = both(spark, reqs, ents)
        assert got.collect() == [] and work.pairs == 0
