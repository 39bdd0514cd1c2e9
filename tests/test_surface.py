"""Decisions over a grid from breakpoints = one fold per grid point."""

import random

from pyspark.sql import functions as F

from reuselens.functions.constraints import extract_constraints
from reuselens.operators.admission import admit, decision_surface

TAUS, KS = [0.0, 0.35, 0.5, 0.5000001, 1.1], [1, 2, 9]


def test_surface_equals_folds(spark):
    rng = random.Random(7)
    reqs = [(i, f"List {rng.randint(2, 4)} ideas.") for i in range(120)]
    cands = []
    for i, _ in reqs[:110]:  # the last ten have no candidates
        sims = sorted((rng.choice([0.2, 0.35, 0.5, 0.8, 1.0]) for _ in range(rng.randint(1, 5))), reverse=True)  # ties, grid values
        cands += [(i, 1000 + r, r, s, f"List {rng.randint(2, 4)} ideas.") for r, s in enumerate(sims, 1)]
    r = spark.createDataFrame(reqs, "request_id long, text string").withColumn("constraints", extract_constraints(F.col("text")))
    c = spark.createDataFrame(cands, "request_id long, entry_id long, rank int, sim double, text string") \
        .withColumn("entry_constraints", extract_constraints(F.col("text"))).drop("text")
    r = r.select("request_id", "constraints")
    got = {(x.tau, x.k, x.decision): x.n for x in decision_surface(r, c, TAUS, KS).collect()}
    want = {}
    for t in TAUS:
        for k in KS:
            for x in admit(r, c.filter(F.col("rank") <= k), t).groupBy("decision").count().collect():
                want[(t, k, x.decision)] = x["count"]
    assert got == want


def test_no_requests(spark):
    r = spark.createDataFrame([], "request_id long, text string").withColumn("constraints", extract_constraints(F.col("text")))
    c = spark.createDataFrame([], "request_id long, entry_id long, rank int, sim double, text string") \
        .withColumn("entry_constraints", extract_constraints(F.col("text"))).drop("text")
    assert decision_surface(r.select("request_id", "constraints"), c, TAUS, KS).collect() == []
