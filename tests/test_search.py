import numpy as np
from pyspark.sql import functions as F

from reuselens.operators.search import topk_candidates


def brute(reqs, ents, k):
    out = {}
    for rid, scope, v, t in reqs:
        if any(v):
            scored = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), eid)
                            for eid, s, w, u in ents if s == scope and u < t and any(w))
            out |= {(rid, i + 1): (eid, -sim) for i, (sim, eid) in enumerate(scored[:k])}
    return out


def test_many_small_scopes_and_a_large_one(spark):
    """More entries than requests, scopes of any size: packs follow the larger side."""
    rng = np.random.default_rng(0)
    vec = lambda: [float(x) for x in rng.integers(-1, 2, 3)]  # noqa: E731  ties and zero vectors
    reqs = [(i, int(i % 60), vec(), int(rng.integers(0, 50))) for i in range(120)] + \
        [(1000 + i, 99, vec(), int(rng.integers(0, 50))) for i in range(70)]
    ents = [(i, int(i % 60), vec(), int(rng.integers(0, 50))) for i in range(1500)] + \
        [(5000 + i, 99, vec(), int(rng.integers(0, 50))) for i in range(300)] + [(9000, 77, vec(), 0)]
    r = spark.createDataFrame(reqs, "rid long, scope long, v array<double>, t long")
    e = spark.createDataFrame(ents, "eid long, scope long, v array<double>, u long")
    for block in (16, 1024):
        got = topk_candidates(r, e, ["scope"], 3, req_id="rid", entry_id="eid", vec="v", req_time="t", entry_time="u",
                              block_rows=block).collect()
        assert {(x.rid, x["rank"]): (x.eid, x.sim) for x in got} == brute(reqs, ents, 3)


def test_nothing_in_common(spark):
    r = spark.createDataFrame([(1, 1, [1.0])], "rid long, scope long, v array<double>")
    e = spark.createDataFrame([(1, 2, [1.0])], "eid long, scope long, v array<double>")
    assert topk_candidates(r, e, ["scope"], 3, req_id="rid", entry_id="eid", vec="v").collect() == []


def test_a_cell_holds_few_similarities_at_once():
    """Blocks are large, so a cell scores some requests at a time: 3000 x 20000 similarities are 480 MB."""
    import tracemalloc

    import pandas as pd

    from reuselens.operators.search import _top
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(3000, 4)), rng.integers(-3, 4, (20000, 4)).astype(float)
    t, u = rng.integers(0, 1000, 3000), rng.integers(0, 1000, 20000)
    left = pd.DataFrame({"_rid": np.arange(3000), "_v": list(a), "_rt": t})
    right = pd.DataFrame({"_eid": rng.permutation(20000), "_v": list(b), "_et": u})
    tracemalloc.start()
    rid, eid, sim = _top(left, right, 3, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    got = {}
    for r, e, s in zip(rid, eid, sim):
        got.setdefault(int(r), []).append((int(e), float(s)))
    ids = right["_eid"].to_numpy()
    ok = np.linalg.norm(b, axis=1) > 0
    for r in range(0, 3000, 100):
        seen = np.flatnonzero(ok & (u < t[r]))
        s = np.round(b[seen] @ a[r] / np.linalg.norm(a[r]) / np.linalg.norm(b[seen], axis=1), 12)
        best = np.lexsort((ids[seen], -s))[:3]
        assert got.get(r, []) == [(int(ids[seen[i]]), float(s[i])) for i in best]


def test_a_scope_of_many_rows_is_shuffled_once(spark):
    """2000 requests and entries of one scope fit one block, so no row is copied."""
    rng = np.random.default_rng(1)
    rows = [(i, 0, [float(x) for x in rng.normal(size=4)], i) for i in range(2000)]
    d = spark.createDataFrame(rows, "rid long, scope long, v array<double>, t long")
    e = d.toDF("eid", "scope", "v", "u")
    found = {b: sorted(tuple(x) for x in topk_candidates(d, e, ["scope"], 2, req_id="rid", entry_id="eid", vec="v", req_time="t",
                                                         entry_time="u", block_rows=b).collect()) for b in (None, 300)}
    assert found[None] == found[300] and len(found[None]) == 2 * 1999 - 1
    from reuselens.operators import search
    one = spark.createDataFrame([(2000,)], "n long")
    assert one.select(search._blocks("n", search.BLOCK_VALUES / 4)).first()[0] == 1


def test_search_by_key_in_passes(spark, monkeypatch):
    """A row names its vector by a key: blocks of entries are searched one after another, a pass shuffles no request twice,
    and a cell gets a vector once. Repeated ids, missing vectors and times and null scopes as in the plain search."""
    from reuselens.operators import search
    rng = np.random.default_rng(2)
    vecs = [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(40)] + [(40, None), (41, [])]
    held = dict(vecs)
    reqs = [(i, int(i % 20), int(rng.integers(0, 44)), int(rng.integers(0, 50))) for i in range(60)] + \
        [(100 + i // 2, 99, int(rng.integers(0, 40)), int(rng.integers(0, 50))) for i in range(90)] + [(500, None, 1, 60)]
    ents = [(i, int(i % 20), int(rng.integers(0, 44)), int(rng.integers(0, 50))) for i in range(100)] + \
        [(5000 + i, 99, int(rng.integers(0, 40)), int(rng.integers(0, 50))) for i in range(70)] + [(9000, None, 1, 0)]
    r = spark.createDataFrame(reqs, "rid long, scope long, key long, t long")
    e = spark.createDataFrame(ents, "eid long, scope long, key long, u long")
    v = spark.createDataFrame(vecs, "key long, v array<double>")
    wrote = []

    def watch(df, name):
        wrote.append(name)
        return real(df, name)
    real = search.materialize
    monkeypatch.setattr(search, "materialize", watch)
    names = dict(req_id="rid", entry_id="eid", vec="v", req_time="t", entry_time="u")
    want = sorted(tuple(x) for x in topk_candidates(r.join(v, "key"), e.join(v, "key"), ["scope"], 3, **names).collect())
    for block, passes in ((16, 5), (None, 0)):
        wrote.clear()
        got = search.topk_of_keys(r, e, v, ["scope"], 3, key="key", block_rows=block, **names)
        assert sorted(tuple(x) for x in got.collect()) == want and wrote.count("best") == passes
    once = [x for x in reqs if x[0] < 100 and held.get(x[2])]
    got = search.topk_of_keys(r.filter("rid < 100"), e, v, ["scope"], 3, key="key", **names).collect()
    assert {(x.rid, x["rank"]): (x.eid, x.sim) for x in got} == brute(
        [(i, s, held[k], t) for i, s, k, t in once], [(i, s, held[k], u) for i, s, k, u in ents if held.get(k)], 3)
    late = r.withColumn("t", F.when(F.col("rid") % 2 == 0, F.col("t")))
    got = search.topk_of_keys(late, e, v, ["scope"], 3, key="key", **names).collect()
    assert sorted(tuple(x) for x in got) == [x for x in want if x[0] % 2 == 0]
    always = e.withColumn("u", F.when(F.col("eid") % 2 == 0, F.col("u")))
    first = always.withColumn("u", F.coalesce("u", F.lit(-1)))
    want = topk_candidates(r.join(v, "key"), first.join(v, "key"), ["scope"], 3, **names)
    got = search.topk_of_keys(r, always, v, ["scope"], 3, key="key", **names)
    assert len({tuple(sorted(tuple(x) for x in d.collect())) for d in (got, want)}) == 1
    assert search.topk_of_keys(r, e.filter("false"), v, ["scope"], 3, key="key", **names).collect() == []
    assert search.topk_of_keys(r, e, v.filter("false"), ["scope"], 3, key="key", **names).collect() == []


def test_search_by_key_shuffles_a_vector_once_a_cell(spark):
    """1500 requests and entries of one scope that share 3 vectors of 500 doubles: each pass shuffles some kB and not 12 MB."""
    import os
    from reuselens.operators import search
    rows = spark.range(1500).selectExpr("id", "0 AS scope", "id % 3 AS key", "id AS t")
    v = spark.createDataFrame([(i, [float((i + j) % 7) for j in range(500)]) for i in range(3)], "key long, v array<double>")

    def shuffled():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f: os.path.getsize(f"{d}/{f}") for top in dirs for d, _, files in os.walk(top) for f in files if f.endswith(".data")}
    before = shuffled()
    found = search.topk_of_keys(rows.withColumnRenamed("id", "rid"), rows.selectExpr("id AS eid", "scope", "key", "t AS u"), v, ["scope"], 2,
                                req_id="rid", entry_id="eid", key="key", vec="v", req_time="t", entry_time="u")
    assert found.count() == 2 * 1499 - 1
    assert sum(n for f, n in shuffled().items() if f not in before) < 400_000
