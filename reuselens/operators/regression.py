"""Regression gate over a frozen evaluation set.

A snapshot holds pairs with their label, similarity, prompts and the gate's
verdict of the day, one sub-folder per version. A later run reads it by path,
extracts the constraints anew with the extractor under test and compares the
gated AUC with that of the snapshot. The interval of the difference comes from
a paired bootstrap: both scores of a pair have the same Poisson weight in a
replicate, drawn by inverse CDF from a hash of pair and replicate, which any
engine can repeat."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constraints import DIMENSIONS
from ..functions.hashing import hash_u32
from ..session import materialize
from . import gate, ranking

TOLERANCE = 0.02
REPLICATES = 200
#: 32-bit hashes from which on a Poisson(1) weight is at least 1, 2, ...
POISSON_CUTS = [math.floor(2 ** 32 * sum(math.exp(-1) / math.factorial(j) for j in range(k))) for k in range(1, 11)]


def freeze(scored: DataFrame, path: str, version: int) -> None:
    """Writes a version of the snapshot; one that is there already is an error."""
    scored.select("pair_id", "y", "sim", "prompt_a", "prompt_b", "compatible").write.mode("errorifexists").parquet(
        f"{path}/version={version}")


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the snapshot, the latest by default."""
    every = spark.read.parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return spark.read.parquet(f"{path}/version={version}")


def verdicts(frozen: DataFrame, extract=None) -> DataFrame:
    """The snapshot with the present verdict as ``now`` and the dimensions that
    differ. ``extract`` maps a prompt column to constraints (the library's own by default)."""
    pairs = frozen.withColumnRenamed("compatible", "was")
    if extract is not None:
        pairs = pairs.withColumn("ca", extract(F.col("prompt_a"))).withColumn("cb", extract(F.col("prompt_b")))
    return gate.with_pair_compatibility(pairs).select("pair_id", "y", "sim", "was", "diff_dims", F.col("compatible").alias("now"))


def regression_gate(judged: DataFrame, keys: list[str], tolerance: float = TOLERANCE, replicates: int = REPLICATES) -> DataFrame:
    """Per ``keys`` of ``judged`` (pair_id, y, sim, was, now): n, baseline and
    current AUC, the 95 % interval of their difference and whether the current
    one is at least the baseline less ``tolerance``. A set of one class raises."""
    score = lambda c: F.when(F.col(c), F.col("sim")).otherwise(F.lit(-1.0))
    both = materialize(judged.select(*keys, "pair_id", "y", F.explode(F.array(
        F.struct(F.lit("baseline").alias("run"), score("was").alias("score")),
        F.struct(F.lit("current").alias("run"), score("now").alias("score")))).alias("s"))
        .select(*keys, "pair_id", "y", "s.run", "s.score"), "regression")
    aside = lambda df, by: df.groupBy(*by).pivot("run", ["baseline", "current"]).agg(F.first("auc"))
    point = aside(ranking.auc(both, [*keys, "run"]), keys)
    u = hash_u32(F.concat(F.col("pair_id").cast("string"), F.lit(":"), F.col("rep").cast("string")))
    weight = sum((u >= cut).cast("int") for cut in POISSON_CUTS)
    drawn = both.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight)
    per = aside(ranking.auc(drawn, [*keys, "rep", "run"], weight="w"), [*keys, "rep"])
    per = materialize(per.withColumn("diff", F.col("current") - F.col("baseline")).filter("diff is not null"), "regression")
    ci = ranking.exact_percentiles(per, keys, "diff", {"ci_low": 0.025, "ci_high": 0.975})
    n = both.filter("run = 'current'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    guard = F.when(F.col("baseline").isNull(), F.raise_error(F.lit("regression_gate: a set of one class has no AUC")).cast("double"))
    return n.join(point, keys).join(ci, keys, "left").select(
        *keys, "n", F.coalesce(guard, F.round("baseline", 6)).alias("baseline_auc"), F.round("current", 6).alias("current_auc"),
        F.round("ci_low", 6).alias("diff_low"), F.round("ci_high", 6).alias("diff_high"), F.lit(tolerance).alias("tolerance"),
        (F.col("current") >= F.col("baseline") - F.lit(tolerance)).alias("passed"))


def without_each_dimension(judged: DataFrame) -> DataFrame:
    """The live extractor and, for each dimension, one that has lost it: how
    much of the AUC each of them holds up."""
    lost = F.array(F.struct(F.lit("live").alias("extractor"), F.lit("").alias("lost")),
                   *[F.struct(F.lit(f"without {d}").alias("extractor"), F.lit(d).alias("lost")) for d in DIMENSIONS])
    x = judged.select("*", F.explode(lost).alias("x"))
    kept = F.filter("diff_dims", lambda d: d != F.col("x.lost"))
    return x.select("x.extractor", "pair_id", "y", "sim", "was", (F.size(kept) == 0).alias("now"))
