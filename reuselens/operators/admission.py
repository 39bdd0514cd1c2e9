"""Admission with fall-through (J5) and the gate trail.

Candidates are ranked 1..k by similarity. Scanning in rank order, the
first candidate that is either below the threshold (MISS_LOW_SIM, with
that candidate's similarity) or constraint-compatible (HIT_SEMANTIC)
decides. If none does, MISS_GATE with the rank-1 similarity and the trail
of every checked candidate; no candidates at all is MISS_NO_CANDIDATE.
One groupBy per request (at most k rows each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constraints import compatible, diff_dims, diff_text

DECISIONS = ["HIT_EXACT", "HIT_SEMANTIC", "MISS_LOW_SIM", "MISS_GATE", "MISS_NO_CANDIDATE",
             "MISS_BUDGET_EXCEEDED", "MISS_UPSTREAM_ERROR"]


def admit(requests: DataFrame, candidates: DataFrame, tau: float, req_id: str = "request_id",
          req_constraints: str = "constraints", entry_constraints: str = "entry_constraints") -> DataFrame:
    """``candidates``: (req_id, entry_id, rank, sim, entry_constraints);
    ``requests``: (req_id, constraints, ...). Returns one row per request:
    decision, candidate_id, similarity, gate_passed, gate_checked,
    trail (array of struct(rank, entry_id, similarity, diff_dims, diff), MISS_GATE only)."""
    c = (candidates.join(requests.select(req_id, req_constraints), req_id)
         .withColumn("ok", compatible(F.col(req_constraints), F.col(entry_constraints)))
         .withColumn("dims", diff_dims(F.col(req_constraints), F.col(entry_constraints)))
         .withColumn("diff", diff_text(F.col(req_constraints), F.col(entry_constraints)))
         .withColumn("low", F.col("sim") < F.lit(tau)))
    terminal = F.col("low") | F.col("ok")
    agg = c.groupBy(req_id).agg(
        F.min_by(F.struct("low", "entry_id", "sim", "rank"), F.when(terminal, F.col("rank"))).alias("t"),
        F.min_by(F.col("sim"), F.col("rank")).alias("top_sim"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.sort_array(F.collect_list(F.struct("rank", "entry_id", F.col("sim").alias("similarity"),
                                             F.array_join("dims", "|").alias("diff_dims"), "diff"))).alias("_trail"))
    d = requests.select(req_id).join(agg, req_id, "left")
    decision = (F.when(F.col("n_candidates").isNull(), F.lit("MISS_NO_CANDIDATE"))
                .when(F.col("t.rank").isNull(), F.lit("MISS_GATE"))
                .when(F.col("t.low"), F.lit("MISS_LOW_SIM"))
                .otherwise(F.lit("HIT_SEMANTIC")))
    return d.select(
        req_id, decision.alias("decision"),
        F.when(decision == "HIT_SEMANTIC", F.col("t.entry_id")).alias("candidate_id"),
        F.when(decision == "MISS_GATE", F.col("top_sim")).otherwise(F.col("t.sim")).alias("similarity"),
        F.when(decision == "HIT_SEMANTIC", F.lit(True)).when(decision == "MISS_GATE", F.lit(False))
         .alias("gate_passed"),
        F.coalesce(F.when(decision == "MISS_GATE", F.col("n_candidates"))
                   .when(decision == "HIT_SEMANTIC", F.col("t.rank"))
                   .when(decision == "MISS_LOW_SIM", F.col("t.rank") - 1), F.lit(0)).cast("int").alias("gate_checked"),
        F.when(decision == "MISS_GATE", F.col("_trail")).alias("trail"))


def decision_surface(requests: DataFrame, candidates: DataFrame, taus: list[float], ks: list[int], req_id: str = "request_id",
                     req_constraints: str = "constraints", entry_constraints: str = "entry_constraints") -> DataFrame:
    """(tau, k, decision, n) of ``admit`` for every threshold and depth of
    the grid, from one pass; decisions that no request gets have no row.

    Similarities fall with the rank, so a request's decision at depth k changes at
    one threshold only: the similarity of its first compatible candidate
    (HIT_SEMANTIC up to it), or of its last candidate if none is compatible
    (MISS_GATE up to it); above, it is MISS_LOW_SIM. Requests are counted by
    (k, decision, grid position of that breakpoint), and running sums over the grid
    give all counts. ``candidates`` hold at least ``max(ks)`` ranks where there are so many."""
    grid = sorted(set(taus))
    c = candidates.join(requests.select(req_id, req_constraints), req_id)
    per = c.groupBy(req_id).agg(
        F.min(F.when(compatible(F.col(req_constraints), F.col(entry_constraints)), F.col("rank"))).alias("first_ok"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "sim"))), lambda x: x["sim"]).alias("sims"))
    d = requests.select(req_id).join(per, req_id, "left").select(
        "first_ok", "sims", F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))])).alias("k"))
    hit = F.coalesce(F.col("first_ok") <= F.col("k"), F.lit(False))
    at = F.element_at("sims", F.when(hit, F.col("first_ok")).otherwise(F.least(F.col("k"), F.size("sims"))).cast("int"))
    upto = F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: t <= F.col("b")))
    cells = (d.select("k", F.when(F.col("sims").isNull(), "MISS_NO_CANDIDATE").when(hit, "HIT_SEMANTIC").otherwise("MISS_GATE")
                      .alias("decision"), F.when(F.col("sims").isNotNull(), at).alias("b"))
             .select("k", "decision", F.when(F.col("b").isNull(), F.lit(len(grid))).otherwise(upto).alias("upto"))
             .groupBy("k", "decision", "upto").agg(F.count(F.lit(1)).alias("n")))
    steps = F.array(F.struct(F.lit(0).alias("i"), F.col("decision").alias("decision"), F.col("n").alias("n")),
                    F.struct(F.col("upto").alias("i"), F.col("decision").alias("decision"), (-F.col("n")).alias("n")),
                    F.struct(F.col("upto").alias("i"), F.lit("MISS_LOW_SIM").alias("decision"), F.col("n").alias("n")))
    steps = (cells.select("k", F.explode(steps).alias("s")).groupBy("k", "s.decision", "s.i").agg(F.sum("s.n").alias("n")))
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("tau")) for i, t in enumerate(grid)])
    at_tau = steps.select("k", "decision").distinct().select("k", "decision", F.explode(every).alias("g")) \
        .select("k", "decision", "g.i", "g.tau").join(steps, ["k", "decision", "i"], "left")
    w = Window.partitionBy("k", "decision").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (at_tau.withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(w)).filter("n > 0")
            .select("tau", "k", "decision", F.col("n").cast("bigint").alias("n")))
