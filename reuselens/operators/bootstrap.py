"""Bootstrap CI of AUC (A9) over score cells.

A Poisson bootstrap gives every pair a weight of Poisson(1) in each replicate.
AUC only needs the summed weight of the positives and of the negatives of each
distinct score, and a sum of ``c`` such weights is Poisson(c). So the weights
are drawn per (key, score, class): the work is distinct scores x replicates,
and a score that most pairs share (all that the gate rejects, for one) is one
cell. A draw is a function of a hash of key and score, the class and the
replicate, so it depends on neither row order nor partitioning and any engine
can repeat it: two uniforms from a multiplicative generator, then the inverse
Poisson distribution up to a mean of ``EXACT_UP_TO`` and the rounded normal
approximation (Box-Muller) above.

Cells are cut into slices of at most about ``SLICE_CELLS`` neighbouring scores;
a task returns per replicate its slice's positive mass, negative mass and
Mann-Whitney numerator. What slices add to each other comes from a window over
the slices of a key and replicate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_u32
from ..session import materialize
from . import ranking

SLICE_CELLS = 2048
#: Cells whose draws are held at once.
CHUNK_CELLS = 64
EXACT_UP_TO = 12
# ---------------------------------------------------------------------
# Fixed values of the generator (the SQL repeats them): modulus, steps for
# replicate, salt and seed, and the multipliers of its rounds.
# ---------------------------------------------------------------------
MODULUS = 2147483647
REP_STEP, SALT_STEP, SEED_STEP = 1013904223, 715827883, 362437
MULTIPLIERS = [48271, 69621, 39373]
# ---------------------------------------------------------------------


def poisson_cuts(mean: int) -> list[float]:
    """Uniforms from which on a Poisson draw is at least 1, 2, ..."""
    out, total, j = [], 0.0, 0
    while total < 1 - 1e-11:
        total += math.exp(-mean) * mean ** j / math.factorial(j)
        out.append(total)
        j += 1
    return out


_CUTS = [np.array(poisson_cuts(c)) for c in range(1, EXACT_UP_TO + 1)]


def _uniform(h: np.ndarray, reps: np.ndarray, salt: int, seed: int) -> np.ndarray:
    x = (h[:, None] + (reps + 1)[None, :] * REP_STEP + salt * SALT_STEP + seed * SEED_STEP) % MODULUS
    for m in MULTIPLIERS:
        x = (x * m) % MODULUS
        x ^= x >> 13
    return (x + 0.5) / 2147483648.0


def _weights(h: np.ndarray, mass: np.ndarray, reps: np.ndarray, salt: int, seed: int) -> np.ndarray:
    """Poisson(``mass``) of every cell and replicate."""
    out = np.zeros((len(h), len(reps)))
    some = np.flatnonzero(mass > 0)
    if not len(some):
        return out
    u = _uniform(h[some], reps, salt, seed)
    mass = mass[some]
    for c in range(1, EXACT_UP_TO + 1):
        at = mass == c
        if at.any():
            out[some[at]] = np.searchsorted(_CUTS[c - 1], u[at], side="right")
    many = mass > EXACT_UP_TO
    if many.any():
        z = np.sqrt(-2.0 * np.log(u[many])) * np.cos(2.0 * np.pi * _uniform(h[some[many]], reps, salt + 1, seed))
        c = mass[many][:, None]
        out[some[many]] = np.maximum(0.0, np.floor(c + np.sqrt(c) * z + 0.5))
    return out


def draws(h, pos, neg, replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the positives and negatives of one cell, or of an array of
    cells, in every replicate."""
    cells, reps = np.atleast_1d(np.asarray(h, dtype=np.int64)), np.arange(replicates, dtype=np.int64)
    w = tuple(_weights(cells, np.atleast_1d(np.asarray(m, dtype=np.float64)), reps, salt, seed) for m, salt in ((pos, 1), (neg, 3)))
    return w if np.ndim(h) else (w[0][0], w[1][0])


def score_weights(long: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """One row per (keys, score): pos, neg and the cell's hash ``_h``. A row counts ``weight`` times."""
    cells = ranking.score_cells(long, keys, "score", "y", weight)
    nano = F.round(F.col("score") * F.lit(1e9)).cast("bigint")
    return cells.withColumn("_h", hash_u32(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], nano.cast("string"))))


def auc_bootstrap(long: DataFrame, keys: list[str], replicates: int = 1000, seed: int = 0,
                  slice_cells: int = SLICE_CELLS, weight: str | None = None) -> DataFrame:
    """Per (keys, rep): P, N and AUC of the weighted sample (NULL AUC when a
    replicate lands on one class)."""
    cells = materialize(score_weights(long, keys, weight), "cells")
    base = ranking.with_range(cells, keys, "score", ranking.slices(cells, keys, slice_cells))
    key_fields = [f for f in base.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [T.StructField("_r", T.IntegerType()), T.StructField("rep", T.IntegerType()),
                                        T.StructField("P", T.DoubleType()), T.StructField("N", T.DoubleType()),
                                        T.StructField("num", T.DoubleType())])

    def slice_stats(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", kind="stable")
        p, n, num = (np.zeros(replicates) for _ in range(3))
        h, pos, neg = (pdf[c].to_numpy() for c in ("_h", "pos", "neg"))
        for i in range(0, len(pdf), CHUNK_CELLS):
            part = slice(i, i + CHUNK_CELLS)
            wp, wn = draws(h[part], pos[part], neg[part], replicates, seed)
            upto = np.cumsum(wn, axis=0)
            num += (wp * (n + upto - wn / 2.0)).sum(axis=0)
            p += wp.sum(axis=0)
            n += upto[-1]
        out = pd.DataFrame({"rep": np.arange(replicates, dtype=np.int32), "P": p, "N": n, "num": num})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out["_r"] = np.int32(pdf["_r"].iloc[0])
        return out[schema.fieldNames()]

    part = base.groupBy(*keys, "_r").applyInPandas(slice_stats, schema)
    w = Window.partitionBy(*keys, "rep").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_nb", F.coalesce(F.sum("N").over(w), F.lit(0.0)))
    per = part.groupBy(*keys, "rep").agg(F.sum("P").alias("P"), F.sum("N").alias("N"),
                                         F.sum(F.col("num") + F.col("P") * F.col("_nb")).alias("_num"))
    return per.withColumn("auc", F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_num") / (F.col("P") * F.col("N")))) \
        .drop("_num")


def auc_bootstrap_ci(long: DataFrame, keys=("group_name", "variant"), replicates: int = 1000,
                     seed: int = 0, weight: str | None = None) -> DataFrame:
    """2.5 % / 97.5 % percentiles (linear interpolation) of the valid
    replicate AUCs. A key of one class has none and raises (A6)."""
    keys = list(keys)
    per = materialize(auc_bootstrap(long, keys, replicates, seed, weight=weight), "replicates")
    ci = ranking.exact_percentiles(per.filter(F.col("auc").isNotNull()), keys, "auc", {"ci_low": 0.025, "ci_high": 0.975})
    valid = per.groupBy(*keys).agg(F.count("auc").alias("n_valid"))
    guard = F.when(F.col("n_valid") == 0, F.raise_error(F.lit(
        "auc_bootstrap_ci: a group of one class has no AUC; pair it with its counterpart")).cast("bigint"))
    return valid.join(ci, keys, "left").select(
        *keys, F.coalesce(guard, F.col("n_valid")).alias("n_valid"), F.round("ci_low", 6).alias("ci_low"),
        F.round("ci_high", 6).alias("ci_high"))
