"""Per-tenant budget ledger.

Lifecycle per request (B3), in time order within a tenant: a zero-cost
pre-flight charge (rejects when spent > budget); hits stop there; a miss
charges its estimate, which only lands when ``spent + estimate <= budget``;
then either a refund of the estimate when the upstream call failed
(``strict_refund=True`` makes it conditional) or an unconditional reconcile
by real - estimate.

A rejected charge changes later decisions, so the balance is a fold. It is not
folded tenant by tenant: the log is range-partitioned by (tenant, time) into
segments of at most about ``SEGMENT_ROWS`` rows, and each segment is a function
from the balance before it to the balance after it.

* While the balance plus the highest (running sum + estimate) of a segment fits
  the budget, all charges land and the function adds the segment's total, so
  the balance before a segment is a prefix sum.
* The first segment in which a charge does not fit is folded row by row.
* From then on the balance lies within the largest estimate of the budget, or
  above it (it never falls), and a segment is a piecewise shift of the distance to
  the budget: where it begins on each piece, and by how much it falls. Such
  functions compose to such functions; a scan over the segments, doubling its
  reach each round, composes them in a number of rounds logarithmic in the
  segments. Then all segments know their start, and those in which a charge may
  land are folded, each on its own.

No task sees more of a tenant than one segment, or one row per segment.

Money is exact: costs are decimal(10,6) and balances decimal(12,4) (rounded
half away from zero after every update), both carried as integer micro-cents.
Balances and budgets are multiples of 100 micro-cents, so each update adds a
constant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

MICRO = 1_000_000


def round4(x: int) -> int:
    """Round micro-cents to a multiple of 100 (4 decimals), half away from zero."""
    s = -1 if x < 0 else 1
    return s * ((abs(x) + 50) // 100) * 100


def charge(spent: int, c: int, budget: int) -> int | None:
    """B1: conditional charge; None when it would exceed the budget."""
    return round4(spent + c) if spent + c <= budget else None


def reconcile(spent: int, delta: int) -> int:
    """B2: unconditional adjustment."""
    return round4(spent + delta)


def fold_rows(rows, spent: int, strict_refund: bool = False):
    """The fold itself: ``rows`` are (is_miss, upstream_error, est, real,
    budget) in time order; yields (outcome, spent_after, charged)."""
    for miss, err, est, real, budget in rows:
        charged, outcome = 0, "ok"
        if charge(spent, 0, budget) is None:
            outcome = "budget_rejected_preflight"
        elif miss:
            held = charge(spent, est, budget)
            if held is None:
                outcome = "budget_rejected_estimate"
            elif err:
                back = charge(held, -est, budget) if strict_refund else reconcile(held, -est)
                spent = held if back is None else back
                outcome = "upstream_error_refunded"
            else:
                spent = reconcile(held, real - est)
                charged = real
        yield outcome, spent, charged


FOLDED = "tenant_id bigint, request_id bigint, ts timestamp, seg int, outcome string, spent_u bigint, charged_u bigint, last boolean"
SEGMENT_ROWS = 50_000
UNIT = 100  # micro-cents: budgets and balances are multiples of it
_BELOW = -(1 << 60)


def segment_function(rows, reach: int):
    """A segment as a piecewise shift of the distance to the budget (in
    ``UNIT``s, below ``reach``): where the pieces begin and what each loses.
    ``rows`` are (estimate, step) of the misses in time order. A distance below
    0 is a balance above the budget, which nothing changes."""
    lo, cur = np.array([_BELOW, 0], dtype=np.int64), np.array([_BELOW, 0], dtype=np.int64)
    size = 64
    for estimate, step in rows:
        hi = np.append(lo[1:], reach) - lo + cur  # where a piece ends now
        cut = (cur < estimate) & (hi > estimate)
        if cut.any():
            at = np.flatnonzero(cut)
            lo, cur = np.insert(lo, at + 1, lo[at] + estimate - cur[at]), np.insert(cur, at + 1, estimate)
        cur = np.where(cur >= estimate, cur - step, cur)
        if len(lo) > size:
            lo, cur = _joined(lo, cur)
            size = max(64, 2 * len(lo))
    lo, cur = _joined(lo, cur)
    return lo, lo - cur


def _joined(lo, cur):
    shift = lo - cur
    keep = np.append(True, (shift[1:] != shift[:-1]) | (lo[1:] == 0))
    return lo[keep], cur[keep]


def compose(first, then, reach: int):
    """The function of two segments, one after the other, for distances below ``reach``."""
    (lo, shift), (lo2, shift2) = first, then
    ends = np.append(lo[1:], 1 << 60) - shift  # images of the pieces' ends
    a, b = np.searchsorted(lo2, lo - shift, side="right") - 1, np.searchsorted(lo2, ends, side="left") - 1
    b = np.maximum(a, b)
    count = b - a + 1
    of = np.repeat(np.arange(len(lo)), count)
    piece = a[of] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(lo[of], np.where(lo2[piece] <= _BELOW, _BELOW, lo2[piece] + shift[of]))
    total = shift[of] + shift2[piece]
    keep = np.append(True, (total[1:] != total[:-1]) | (begin[1:] == 0)) & (begin < reach)
    return begin[keep], total[keep]


def apply(function, distance: int) -> int:
    lo, shift = function
    return distance - int(shift[np.searchsorted(lo, distance, side="right") - 1])


FUNCTION = "tenant_id bigint, place int, reach bigint, lo array<bigint>, shift array<bigint>"


def _segment_functions(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[pdf.is_miss].sort_values(["ts", "request_id"])
    lo, shift = segment_function(zip((-(-pdf.est_u // UNIT)).tolist(), (pdf.step_u // UNIT).tolist()), int(pdf.reach.iloc[0]))
    return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in ("tenant_id", "place", "reach")}, "lo": [lo], "shift": [shift]})


def _after_both(pdfs):
    for pdf in pdfs:
        lo, shift = [], []
        for a, b, c, d, reach in zip(pdf.lo, pdf["shift"], pdf.lo0, pdf.shift0, pdf.reach):
            x, y = (a, b) if c is None else compose((c, d), (a, b), reach)
            lo.append(x)
            shift.append(y)
        yield pd.DataFrame({"tenant_id": pdf.tenant_id, "place": pdf.place, "reach": pdf.reach, "lo": lo, "shift": shift})


def _applied(pdfs):
    for pdf in pdfs:
        yield pd.DataFrame({"tenant_id": pdf.tenant_id, "place": pdf.place + 1,
                            "distance": [apply((a, b), int(d)) for a, b, d in zip(pdf.lo, pdf["shift"], pdf.distance)]})


def _fold_segment(strict_refund: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "request_id"])
        rows = zip(pdf.is_miss, pdf.upstream_error, *(map(int, pdf[c]) for c in ("est_u", "real_u", "budget_u")))
        got = list(fold_rows(rows, int(pdf.start_u.iloc[0]), strict_refund))
        outcome, spent, charged = zip(*got)
        last = [False] * len(got)
        last[-1] = True
        return pd.DataFrame({"tenant_id": pdf.tenant_id, "request_id": pdf.request_id, "ts": pdf.ts, "seg": pdf.seg, "outcome": outcome,
                             "spent_u": spent, "charged_u": charged, "last": last})
    return run


def budget_ledger(events: DataFrame, budgets: DataFrame, strict_refund: bool = False, start: DataFrame | None = None,
                  segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``events``: tenant_id, request_id, ts, is_miss, upstream_error,
    est_cost, real_cost (decimal cents); ``budgets``: tenant_id, budget_cents;
    ``start``: tenant_id, spent_after of what came before (0 if not there).
    Returns one row per event: outcome, spent_after, charged."""
    to_u = lambda c: (F.col(c) * F.lit(MICRO)).cast("long")
    to_hundred = lambda c: F.floor((c + 50) / 100) * 100
    b = budgets.select("tenant_id", to_u("budget_cents").alias("budget_u"))
    if start is not None:
        b = b.join(start.select("tenant_id", to_u("spent_after").alias("begin_u")), "tenant_id", "left")
    else:
        b = b.withColumn("begin_u", F.lit(0))
    e = (events.join(b, "tenant_id")
         .select(F.col("tenant_id").cast("long"), F.col("request_id").cast("long"), "ts",
                 "is_miss", "upstream_error", to_u("est_cost").alias("est_u"),
                 to_u("real_cost").alias("real_u"), "budget_u", F.coalesce("begin_u", F.lit(0)).cast("long").alias("begin_u")))
    landed = to_hundred(F.col("est_u")) + to_hundred(F.when(F.col("upstream_error"), F.lit(0)).otherwise(F.col("real_u"))
                                                     - F.col("est_u"))
    segments_wanted = max(1, -(-events.count() // segment_rows))
    e = (e.withColumn("step_u", F.when(F.col("is_miss"), landed).otherwise(F.lit(0)).cast("long"))
         .repartitionByRange(segments_wanted, "tenant_id", "ts", "request_id").withColumn("seg", F.spark_partition_id()))
    e = materialize(e, "ledger-log")
    w = Window.partitionBy("seg", "tenant_id").orderBy("ts", "request_id")
    e = e.withColumn("before_u", F.coalesce(F.sum("step_u").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    segments = e.groupBy("tenant_id", "seg").agg(
        F.sum("step_u").alias("total"), F.max(F.col("before_u") + F.when(F.col("is_miss"), F.col("est_u")).otherwise(0)).alias("high"),
        F.min(F.when(F.col("is_miss"), F.col("est_u"))).alias("low"), F.max(F.when(F.col("is_miss"), F.col("est_u"))).alias("most"),
        F.max("budget_u").alias("budget_u"), F.max("begin_u").alias("begin_u"))
    # one row per segment: its start if all charges before it landed, and the first in which one may not
    order = Window.partitionBy("tenant_id").orderBy("seg")
    fits = F.col("start_u") + F.col("high") <= F.col("budget_u")
    segments = (segments.withColumn("start_u", F.col("begin_u") + F.coalesce(
        F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("tight", F.sum((~fits).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("place", F.when(F.coalesce("tight", F.lit(0)) > 0, F.row_number().over(order)).when(~fits, F.lit(0)))
        .withColumn("reach", F.greatest(F.ceil(F.coalesce(F.max("most").over(Window.partitionBy("tenant_id")), F.lit(0)) / UNIT),
                                        F.lit(1)).cast("long")))
    first = F.min(F.when(F.col("place") > 0, F.col("place"))).over(Window.partitionBy("tenant_id"))
    segments = materialize(segments.withColumn("place", F.when(F.col("place") > 0, F.col("place") - first + 1)
                                               .otherwise(F.col("place")).cast("int")).drop("tight"), "ledger-segments")
    tight = segments.filter("place = 0")
    folded = materialize(e.join(tight.select("tenant_id", "seg", "start_u"), ["tenant_id", "seg"])
                         .groupBy("tenant_id", "seg").applyInPandas(_fold_segment(strict_refund), FOLDED), "ledger-folded")
    ends = folded.filter("last").select("tenant_id", F.col("spent_u").alias("end_u"))
    later = segments.filter("place > 0").join(ends, "tenant_id")
    later = materialize(later.withColumn("distance", F.floor((F.col("budget_u") - F.col("end_u")) / UNIT).cast("long")), "ledger-later")
    functions = materialize(
        e.join(later.filter("low is not null").select("tenant_id", "seg", "place", "reach"), ["tenant_id", "seg"])
        .filter("is_miss").groupBy("tenant_id", "place").applyInPandas(_segment_functions, FUNCTION)
        .unionByName(later.filter("low is null").select(  # a segment without misses changes nothing
            "tenant_id", "place", "reach", F.array(F.lit(_BELOW)).alias("lo"), F.array(F.lit(0).cast("long")).alias("shift"))), "ledger-functions")
    longest, span = functions.agg(F.max("place")).first()[0] or 0, 1
    while span < longest:
        earlier = functions.select("tenant_id", (F.col("place") + span).alias("place"), F.col("lo").alias("lo0"), F.col("shift").alias("shift0"))
        functions = materialize(functions.join(earlier, ["tenant_id", "place"], "left").mapInPandas(_after_both, FUNCTION), "ledger-functions")
        span *= 2
    behind = functions.join(ends, "tenant_id").join(segments.filter("place = 0").select("tenant_id", "budget_u"), "tenant_id").select(
        "tenant_id", "place", "lo", "shift", F.floor((F.col("budget_u") - F.col("end_u")) / UNIT).cast("long").alias("distance"))
    starts = behind.mapInPandas(_applied, "tenant_id bigint, place int, distance bigint")
    later = later.drop("distance", "start_u").join(
        starts.unionByName(later.filter("place = 1").select("tenant_id", "place", "distance")), ["tenant_id", "place"])
    later = later.withColumn("start_u", F.col("budget_u") - F.col("distance") * UNIT)
    none = (F.col("distance") < 0) | F.col("low").isNull() | (F.col("start_u") + F.col("low") > F.col("budget_u"))
    plan = materialize(later.select("tenant_id", "seg", "start_u", F.when(none, "none").otherwise("fold").alias("mode"))
                       .unionByName(segments.filter("place is null").select("tenant_id", "seg", "start_u", F.lit("all").alias("mode"))),
                       "ledger-plan")
    rest = materialize(e.join(plan.filter("mode = 'fold'").select("tenant_id", "seg", "start_u"), ["tenant_id", "seg"])
                       .groupBy("tenant_id", "seg").applyInPandas(_fold_segment(strict_refund), FOLDED), "ledger-folded")
    x = e.join(plan.filter("mode <> 'fold'"), ["tenant_id", "seg"])
    lands = F.col("mode") == "all"
    over = ~lands & (F.col("start_u") > F.col("budget_u"))
    outcome = (F.when(over, "budget_rejected_preflight").when(~F.col("is_miss"), "ok")
               .when(~lands, "budget_rejected_estimate").when(F.col("upstream_error"), "upstream_error_refunded").otherwise("ok"))
    spent = F.when(lands, F.col("start_u") + F.col("before_u") + F.col("step_u")).otherwise(F.col("start_u"))
    charged = F.when(lands & F.col("is_miss") & ~F.col("upstream_error"), F.col("real_u")).otherwise(F.lit(0))
    out = x.select("tenant_id", "request_id", "ts", outcome.alias("outcome"), spent.alias("spent_u"), charged.alias("charged_u"))
    out = out.unionByName(folded.select(*out.columns)).unionByName(rest.select(*out.columns))
    return out.select("tenant_id", "request_id", "ts", "outcome",
                      (F.col("spent_u") / F.lit(MICRO)).cast("decimal(12,4)").alias("spent_after"),
                      (F.col("charged_u") / F.lit(MICRO)).cast("decimal(10,6)").alias("charged"))
