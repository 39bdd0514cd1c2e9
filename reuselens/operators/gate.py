"""Constraint gate over pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constraints import DIMENSIONS, compatible, constraint_diff, diff_dims, extract_constraints
from ..sources import fixtures as fx


def with_pair_compatibility(pairs: DataFrame, a: str = "prompt_a", b: str = "prompt_b") -> DataFrame:
    """Constraints of both prompts (those that the pairs carry as ``ca``
    and ``cb``, else extracted), ``compatible`` (likewise), ``diff`` and ``diff_dims``.
    Pure projection: no shuffle."""
    if "ca" not in pairs.columns:
        pairs = pairs.withColumn("ca", extract_constraints(F.col(a))).withColumn("cb", extract_constraints(F.col(b)))
    if "compatible" not in pairs.columns:
        pairs = pairs.withColumn("compatible", compatible(F.col("ca"), F.col("cb")))
    return (pairs.withColumn("diff", constraint_diff(F.col("ca"), F.col("cb")))
            .withColumn("diff_dims", diff_dims(F.col("ca"), F.col("cb"))))


def family_detection(p3: DataFrame) -> DataFrame:
    """Share of pairs the gate flags (not compatible) per family,
    every declared family listed (NULL rate when a family has no rows)."""
    rates = (with_pair_compatibility(p3).groupBy("family")
             .agg(F.count(F.lit(1)).alias("n_pairs"),
                  F.count_if(~F.col("compatible")).alias("n_detected")))
    fams = p3.sparkSession.range(1).select(F.explode(fx.families_array()).alias("f")).select(
        "f.family", "f.split", "f.family_ord")
    return (fams.join(F.broadcast(rates), "family", "left")
            .select("family", "split", "family_ord",
                    F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
                    F.coalesce("n_detected", F.lit(0)).alias("n_detected"),
                    F.round(F.col("n_detected") / F.col("n_pairs"), 6).alias("detection_rate")))


def family_detection_split(detection: DataFrame) -> DataFrame:
    """In-design and held-out means *of family rates*, separately."""
    return (detection.groupBy("split")
            .agg(F.round(F.avg("detection_rate"), 6).alias("mean_detection_rate"),
                 F.count("detection_rate").alias("n_families")))


def rejections_by_dimension(compat_pairs: DataFrame) -> DataFrame:
    """For gate rejections, how often each dimension differs, per
    population (one pair can count for several dimensions). One pass over the pairs."""
    one = compat_pairs.filter(~F.col("compatible")).groupBy("population").agg(
        F.count(F.lit(1)).alias("n_rejected"),
        *[F.count_if(F.array_contains("diff_dims", d)).alias(f"_{d}") for d in DIMENSIONS])
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"_{d}").alias("n_rejections")) for d in DIMENSIONS])
    return (one.select("population", F.explode(dims).alias("d"), "n_rejected").filter("d.n_rejections > 0")
            .select("population", "d.dimension", "d.n_rejections", "n_rejected")
            .withColumn("share", F.round(F.col("n_rejections") / F.col("n_rejected"), 6)))
