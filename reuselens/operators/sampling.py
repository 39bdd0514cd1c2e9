"""Deterministic sampling: hash order instead of a seeded RNG, so the
result does not depend on partitioning or row order (W4-W6).

``pandas.sample(random_state=…)`` cannot be reproduced outside pandas;
the hash order is the deliberate replacement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key


def hash_sample(df: DataFrame, id_col: str, n: int, seed) -> DataFrame:
    """``n`` rows in md5(seed:id) order (ties by id). ``orderBy+limit``
    plans as TakeOrderedAndProject: each task keeps its own top ``n``."""
    return (df.withColumn("_h", hash_key(seed, F.col(id_col)))
            .orderBy("_h", id_col).limit(n).drop("_h"))


def sample_stratified(df: DataFrame, category_col: str, id_col: str, n: int, seed) -> DataFrame:
    """``n // C`` rows from each of the C categories (sorted), the
    remainder one each to the first categories, capped at category size.

    The per-category ``row_number() <= n`` filter has a literal bound, so
    Spark inserts a map-side WindowGroupLimit: no category, however hot,
    ships more than ``n`` rows per task to the final window.
    """
    cats = df.groupBy(category_col).agg(F.count(F.lit(1)).alias("_size"))
    w_all = Window.orderBy(category_col)
    # The category table has one row per category (a handful), so this
    # un-partitioned window is over a tiny input.
    quotas = (cats
              .withColumn("_i", F.row_number().over(w_all) - 1)
              .withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy()))
              .withColumn("_quota", F.floor(F.lit(n) / F.col("_c")).cast("int")
                          + F.when(F.col("_i") < F.lit(n) % F.col("_c"), 1).otherwise(0))
              .select(category_col, "_quota"))
    w = Window.partitionBy(category_col).orderBy(hash_key(seed, F.col(id_col)), F.col(id_col))
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return (ranked.join(quotas, category_col)
            .filter(F.col("_rn") <= F.col("_quota"))
            .drop("_rn", "_quota"))
