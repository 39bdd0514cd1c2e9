"""Budget fold golden sequence (budget 100): start 95 -> charge 0 ok (95)
-> charge 10 rejected (95) -> charge 5 ok (100) -> reconcile +3 (103) ->
charge 0 rejected -> conditional refund -3 ok (100)."""

from pyspark.sql import functions as F

from reuselens.operators.ledger import MICRO, charge, reconcile


def u(x):
    return int(round(x * MICRO))


def test_golden_sequence():
    b, s = u(100), u(95)
    assert charge(s, 0, b) == u(95)
    assert charge(s, u(10), b) is None
    s = charge(s, u(5), b)
    assert s == u(100)
    s = reconcile(s, u(3))
    assert s == u(103)
    assert charge(s, 0, b) is None
    s = charge(s, u(-3), b)
    assert s == u(100)


def test_rounding_half_away_from_zero():
    assert charge(u(1), 50, u(100)) == u(1) + 100
    assert reconcile(0, -50) == -100


def test_segments_equal_the_row_by_row_fold(spark):
    import datetime as dt
    import random
    from decimal import Decimal

    from reuselens.operators.ledger import budget_ledger, fold_rows
    rng = random.Random(8)
    budgets = {0: "0.5", 1: "3.0", 2: "1000.0", 3: "0.0", 4: "1.2345"}
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        est = Decimal(rng.choice([1000, 10_000, 90_000, 12_345])) / MICRO
        real = Decimal(rng.choice([0, 500, 1250, 9_999, 150_000])) / MICRO  # may exceed the estimate
        rows.append((rng.choice([0, 0, 0, 1, 2, 3, 4]), i, start + dt.timedelta(seconds=rng.randint(0, 900)),
                     rng.random() < 0.6, rng.random() < 0.1, est, real))
    events = spark.createDataFrame(rows, "tenant_id long, request_id long, ts timestamp, is_miss boolean, "
                                         "upstream_error boolean, est_cost decimal(10,6), real_cost decimal(10,6)")
    limits = spark.createDataFrame([(t, Decimal(b)) for t, b in budgets.items()], "tenant_id long, budget_cents decimal(12,4)")
    want = {}
    for t, b in budgets.items():
        mine = sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[1]))
        it = fold_rows(((m, e, int(x * MICRO), int(y * MICRO), int(Decimal(b) * MICRO)) for _, _, _, m, e, x, y in mine), 0)
        want |= {r[1]: (o, Decimal(s) / MICRO, Decimal(c) / MICRO) for r, (o, s, c) in zip(mine, it)}
    assert {o for o, _, _ in want.values()} == {"ok", "budget_rejected_preflight", "budget_rejected_estimate",
                                                "upstream_error_refunded"}
    for rows_each in (10_000, 230, 17):
        got = budget_ledger(events, limits, segment_rows=rows_each).collect()
        assert {r.request_id: (r.outcome, r.spent_after, r.charged) for r in got} == want and len(got) == len(want)


def test_functions_compose():
    import random

    import numpy as np

    from reuselens.operators.ledger import apply, compose, segment_function
    rng = random.Random(3)
    for _ in range(200):
        reach = rng.choice([1, 20, 300])
        parts = [[(rng.randint(0, reach), rng.choice([0, 0, 1, rng.randint(0, reach + 5)])) for _ in range(rng.randint(0, 30))]
                 for _ in range(3)]
        f, g, h = (segment_function(p, reach) for p in parts)

        def fold(d):
            for est, step in sum(parts, []):
                d = d - step if d >= est else d
            return d

        both, other = compose(compose(f, g, reach), h, reach), compose(f, compose(g, h, reach), reach)
        for d in [-7, -1, *range(reach)]:
            assert apply(both, d) == apply(other, d) == fold(d)
        assert (np.diff(both[0]) > 0).all() and len(both[0]) <= reach + 1


def test_hovering_tenant_settles_in_logarithmic_rounds(spark, monkeypatch):
    import datetime as dt
    import random
    from decimal import Decimal

    from reuselens.operators import ledger as L
    rng = random.Random(12)
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, start + dt.timedelta(seconds=i), True, False, Decimal(rng.randint(1000, 60_000)) / MICRO,
             Decimal(rng.choice([0, 0, 100, 300])) / MICRO) for i in range(4000)]
    events = spark.createDataFrame(rows, "tenant_id long, request_id long, ts timestamp, is_miss boolean, "
                                         "upstream_error boolean, est_cost decimal(10,6), real_cost decimal(10,6)")
    limits = spark.createDataFrame([(1, Decimal("0.07"))], "tenant_id long, budget_cents decimal(12,4)")
    tables, write = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name: tables.append(name) or write(df, name))
    got = {r.request_id: (r.outcome, r.spent_after) for r in L.budget_ledger(events, limits, segment_rows=20).collect()}
    folded = L.fold_rows([(m, e, int(x * MICRO), int(y * MICRO), 70_000) for _, _, _, m, e, x, y in rows], 0)
    assert got == {r[1]: (o, Decimal(s) / MICRO) for r, (o, s, _) in zip(rows, folded)}
    assert {o for o, _ in got.values()} >= {"ok", "budget_rejected_estimate"}
    assert len(tables) <= 8 + 8  # 200 segments: 8 doublings and what there is anyhow


def test_the_balance_before_the_log_counts(spark):
    import datetime as dt
    from decimal import Decimal

    from reuselens.operators.ledger import budget_ledger
    rows = [(t, i, dt.datetime(2024, 1, 1, 0, i), True, False, Decimal("0.5"), Decimal("0.4")) for t in (1, 2, 3) for i in range(5)]
    events = spark.createDataFrame(rows, "tenant_id long, request_id long, ts timestamp, is_miss boolean, "
                                         "upstream_error boolean, est_cost decimal(10,6), real_cost decimal(10,6)")
    limits = spark.createDataFrame([(t, Decimal(2)) for t in (1, 2, 3)], "tenant_id long, budget_cents decimal(12,4)")
    before = spark.createDataFrame([(1, Decimal("1.2")), (2, Decimal("2.1"))], "tenant_id long, spent_after decimal(12,4)")
    for n in (100, 2):
        got = budget_ledger(events, limits, start=before, segment_rows=n)
        assert {r.tenant_id: float(r.s) for r in got.groupBy("tenant_id").agg(F.max("spent_after").alias("s")).collect()} == {
            1: 1.6, 2: 2.1, 3: 1.6} and got.filter("outcome = 'budget_rejected_preflight'").count() == 5
