"""The replay against serving the log one request after the other."""

import numpy as np
from pyspark.sql import functions as F

from reuselens.functions.constraints import DIMENSIONS
from reuselens.operators import decisions as D
from reuselens.operators.ledger import MICRO, fold_rows
from reuselens.sources import serving as S

SF = "/root/testdata/sf0.001"


def one_by_one(rows, budgets, tau=S.TAU, k=S.TOP_K):
    """Plain sequential service: exact key, top k of the scope, gate, budget, write on success."""
    exact, scopes, spent, out, ready = {}, {}, {}, {}, []
    for r in sorted(rows, key=lambda r: (r.ts, r.request_id)):
        # entries are visible strictly after their time
        for key, scope, ts, entry in [w for w in ready if w[2] < r.ts]:
            exact.setdefault(key, entry[0])
            scopes.setdefault(scope, []).append(entry)
        ready = [w for w in ready if w[2] >= r.ts]
        key = (r.tenant_id, r.prompt_hash, r.model, r.params_hash)
        scope = (r.tenant_id, r.model, r.params_hash, r.embedding_model)
        want = tuple(tuple(c) if isinstance(c := r.constraints[d], list) else c for d in DIMENSIONS)
        v = np.array(r.embedding, dtype=np.float64)
        entry = None
        if key in exact:
            decision, entry = "HIT_EXACT", exact[key]
        else:
            scored = sorted((-round(float(v @ e[1] / np.linalg.norm(v) / np.linalg.norm(e[1])), 12), e[0], e[2])
                            for e in scopes.get(scope, []))[:k]
            decision = "MISS_GATE" if scored else "MISS_NO_CANDIDATE"
            for sim, e, has in scored:
                if -sim < tau:
                    decision = "MISS_LOW_SIM"
                    break
                if has == want:
                    decision, entry = "HIT_SEMANTIC", e
                    break
        miss = decision in D.SEMANTIC_MISSES
        (outcome, now, _), = fold_rows([(miss, r.upstream_error, int(r.est_cost * MICRO), int(r.real_cost * MICRO),
                                         budgets[r.tenant_id])], spent.get(r.tenant_id, 0))
        spent[r.tenant_id] = now
        out[r.request_id] = (decision, entry, outcome)
        if miss and outcome == "ok" and not any(w[0] == key for w in ready):
            ready.append((key, scope, r.ts, (r.request_id, v, want)))
    return out


def test_replay_equals_serving_one_by_one(spark):
    rp = D.replay(spark, SF)
    rows = rp["decisions"].join(S.conv_embeddings(spark, SF), "conv_id").collect()
    budgets = {r.tenant_id: int(r.budget_cents * MICRO) for r in S.tenants(spark, SF).collect()}
    want = one_by_one(rows, budgets)
    outcome = {r.request_id: r.outcome for r in rp["ledger"].collect()}
    got = {r.request_id: (r.decision, r.candidate_id, outcome[r.request_id]) for r in rows}
    assert got == want
    assert {d for d, _, _ in got.values()} >= {"HIT_EXACT", "HIT_SEMANTIC", "MISS_LOW_SIM", "MISS_NO_CANDIDATE"}


def test_every_hit_names_an_entry_that_was_written(spark):
    from reuselens.plans.queries import QUERIES
    r = QUERIES["hits_without_writer"](spark, SF).first()
    assert r.n_hits > 0 and r.n_without_writer == 0
    log = QUERIES["decision_log"](spark, SF)
    errors = log.filter(F.col("decision") == "MISS_UPSTREAM_ERROR").select(F.col("request_id").alias("candidate_id"))
    assert log.join(errors, "candidate_id").count() == 0


def small_log(spark, rows):
    """Requests of one tenant: (request_id, second, key, angle, fails)."""
    import datetime as dt
    import math
    from decimal import Decimal
    from pyspark.sql import types as T
    from reuselens.functions import constraints as C
    data = [(r, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), 1, f"k{k}", "m", "p", "e",
             [math.cos(a), math.sin(a)], fails, Decimal("0.01"), Decimal("0.01"), 100) for r, s, k, a, fails in rows]
    frame = spark.createDataFrame(data, "request_id long, ts timestamp, tenant_id long, prompt_hash string, model string, "
                                        "params_hash string, embedding_model string, embedding array<double>, upstream_error boolean, "
                                        "est_cost decimal(10,6), real_cost decimal(10,6), est_prompt_tokens int")
    return frame.withColumn("constraints", C.extract_constraints(F.lit("x")))


def check_log(spark, rows, budget="1000", k=3):
    from decimal import Decimal
    reqs = small_log(spark, rows)
    tenants = spark.createDataFrame([(1, Decimal(budget))], "tenant_id long, budget_cents decimal(12,4)")
    rp = D.replay_log(reqs, tenants, k=k)
    want = one_by_one(reqs.collect(), {1: int(Decimal(budget) * MICRO)}, k=k)
    outcome = {r.request_id: r.outcome for r in rp["ledger"].collect()}
    got = {r.request_id: (r.decision, r.candidate_id, outcome[r.request_id]) for r in rp["decisions"].collect()}
    assert got == want
    return rp, got


def test_chain_of_dependent_writers_is_decided_link_by_link(spark):
    # each request is near to the one before it alone, so every second one writes
    rows = [(i, i, i, 0.3 * i, False) for i in range(6)]
    rp, got = check_log(spark, rows, k=1)
    assert [d for d, _, _ in got.values()].count("HIT_SEMANTIC") == 3
    assert rp["rounds"] >= 2 and rp["decided"] <= 3 * len(rows)


def test_vectors_are_joined_by_the_search_alone(spark, monkeypatch):
    """No table of the replay holds vectors but theirs, shuffle files go with each write, and only the state of the last round stays."""
    import os
    from reuselens.operators import decisions, ledger
    from reuselens.session import scratch_path
    wrote = []

    def watch(real):
        def run(df, name="mat"):
            table = real(df, name)
            wrote.append((name, table.columns, table.materialized_at))
            return table
        return run
    monkeypatch.setattr(decisions, "materialize", watch(decisions.materialize))
    monkeypatch.setattr(ledger, "materialize", watch(ledger.materialize))
    rp = D.replay(spark, SF)
    assert [n for n, cols, _ in wrote if "embedding" in cols] == ["vectors"]
    left = [n for n, _, path in wrote if os.path.exists(path)]
    assert sorted(left) == ["candidates", "decisions", "ledger", "requests", "vectors", "writers"]
    assert rp["decisions"].count() == rp["ledger"].count() == rp["requests"].count() > 0
    assert rp["entries"].count() and rp["candidates"].count() and scratch_path(spark, "") in wrote[0][2]
