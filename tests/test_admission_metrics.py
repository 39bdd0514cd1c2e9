"""Admission fold golden cases (tau = 0.95) and metric edge cases."""

import pytest
from pyspark.sql import functions as F

from reuselens.functions.constraints import extract_constraints
from reuselens.operators import admission, costs, metrics, ranking

A = "Answer in exactly 3 bullet points."
B = "Answer in exactly 10 bullet points."

# request id -> candidates (rank, sim, entry text); request text is always A
CASES = {
    1: [],
    2: [(1, 0.94, A)],
    3: [(1, 0.95, A)],
    4: [(1, 0.98, B), (2, 0.96, A)],
    5: [(1, 0.98, B), (2, 0.90, A)],
    6: [(1, 0.98, B), (2, 0.97, B), (3, 0.96, B)],
}
EXPECT = {
    1: ("MISS_NO_CANDIDATE", None, None, None),
    2: ("MISS_LOW_SIM", 0.94, None, 0),
    3: ("HIT_SEMANTIC", 0.95, True, 1),
    4: ("HIT_SEMANTIC", 0.96, True, 2),
    5: ("MISS_LOW_SIM", 0.90, None, 1),
    6: ("MISS_GATE", 0.98, False, 3),
}


def test_admission_golden(spark):
    reqs = spark.createDataFrame([(i, A) for i in CASES], "request_id long, t string") \
        .withColumn("constraints", extract_constraints(F.col("t")))
    rows = [(i, 100 * i + r, r, s, txt) for i, cs in CASES.items() for r, s, txt in cs]
    cands = spark.createDataFrame(rows, "request_id long, entry_id long, rank int, sim double, et string") \
        .withColumn("entry_constraints", extract_constraints(F.col("et")))
    out = {r.request_id: r for r in admission.admit(reqs, cands, 0.95).collect()}
    for i, (dec, sim, gp, checked) in EXPECT.items():
        r = out[i]
        assert r.decision == dec, i
        assert (r.similarity is None and sim is None) or abs(r.similarity - sim) < 1e-12, i
        assert r.gate_passed == gp, i
        if checked is not None:
            assert r.gate_checked == checked, i
        assert (r.trail is not None) == (dec == "MISS_GATE"), i
    assert out[4].candidate_id == 402
    assert len(out[6].trail) == 3


def _long(spark, y, s):
    return spark.createDataFrame([("g", "v", f"p{i}", a, b) for i, (a, b) in enumerate(zip(y, s))],
                                 "group_name string, variant string, pair_id string, y boolean, score double")


def test_auc_with_tie(spark):
    a = ranking.auc(_long(spark, [True, True, False, False], [0.9, 0.8, 0.8, 0.1]), ["group_name", "variant"])
    assert abs(a.first().auc - 0.875) < 1e-12


def test_auc_all_gated_is_half(spark):
    a = ranking.auc(_long(spark, [True, False, True, False], [-1.0] * 4), ["group_name", "variant"])
    assert abs(a.first().auc - 0.5) < 1e-12


def test_sweep_single_class_raises(spark):
    with pytest.raises(Exception):
        metrics.threshold_sweep(_long(spark, [True, True], [0.9, 0.8])).collect()


def test_sweep_inclusive_threshold(spark):
    s = metrics.threshold_sweep(_long(spark, [True, False], [0.95, 0.7]))
    r = {x.threshold: x for x in s.collect()}
    assert r[0.95].tp == 1 and r[0.955].tp == 0 and r[0.7].fp == 1 and r[0.705].fp == 0


def test_tau_star_tie_goes_to_lowest(spark):
    curve = spark.createDataFrame([(0.7, 0.5, 0.1), (0.8, 0.5, 0.1), (0.9, 0.1, 0.0)], "threshold double, tpr double, fpr double")
    cm = spark.createDataFrame([(1.0,)], "c_miss double")
    t = costs.tau_star(costs.cost_table(curve, cm, [0.001])).first()
    assert t.tau_star == 0.7


def test_bootstrap_equals_its_draws_and_the_usual_bootstrap(spark):
    import numpy as np
    from reuselens.operators import bootstrap as b
    rng = np.random.default_rng(3)
    y = rng.random(600) < 0.4
    score = np.where(rng.random(600) < 0.5, -1.0, np.round(rng.random(600) * 0.5 + 0.4 * y, 2))  # half of all tied
    long = _long(spark, y.tolist(), score.tolist())
    cells = sorted(b.score_weights(long, ["group_name", "variant"]).collect(), key=lambda r: r.score)
    p, n, num = (np.zeros(200) for _ in range(3))
    for c in cells:
        wp, wn = b.draws(c._h, c.pos, c.neg, 200, 0)
        num, p, n = num + wp * (n + wn / 2), p + wp, n + wn
    for size in (7, 10_000):
        got = sorted(b.auc_bootstrap(long, ["group_name", "variant"], 200, 0, size).collect(), key=lambda r: r.rep)
        assert np.allclose([r.auc for r in got], num / (p * n)) and [r.P for r in got] == p.tolist()
    ci = b.auc_bootstrap_ci(long, replicates=1000).first()

    def auc(i):
        pos, neg = score[i][y[i]], score[i][~y[i]]
        return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))

    usual = np.quantile([auc(rng.integers(0, 600, 600)) for _ in range(400)], [0.025, 0.975])
    assert abs(ci.ci_low - usual[0]) < 0.015 and abs(ci.ci_high - usual[1]) < 0.015 and ci.n_valid == 1000


def test_bootstrap_of_one_class_raises(spark):
    with pytest.raises(Exception, match="one class"):
        metrics.auc_bootstrap_ci(_long(spark, [True, True], [0.9, 0.8]), replicates=20).collect()
    with pytest.raises(Exception, match="one class"):
        metrics.roc_report(_long(spark, [False, False], [0.9, 0.8]), replicates=20).collect()


def test_families_without_pairs_count_as_zero(spark):
    from reuselens.sources import fixtures as fx
    scored = spark.createDataFrame([("P3", "numeric", 0.99)], "population string, family string, sim double")
    rows = {r.family: (r.n_pairs, r.false_hits, r.false_hit_rate) for r in metrics.false_hits_by_family(scored).collect()}
    assert rows.pop("numeric") == (1, 1, 1.0)
    assert rows == {f[0]: (0, 0, 0.0) for f in fx.FAMILIES if f[0] != "numeric"}
