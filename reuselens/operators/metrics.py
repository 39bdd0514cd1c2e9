"""Evaluation metrics over labelled pairs.

Layout: ``scored_pairs`` (one row per pair: y, sim, compatible) is built
once; ``long_scores`` explodes it to one row per (group, variant, pair).
Groups are data: every row carries the ROC groups it belongs to, so the
three ROC-B breakdowns are one pass, not three unions (X1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import normalize_text
from ..functions.vectors import bow_cosine, hashed_buckets
from ..sources.fixtures import families
from . import gate, pairs, ranking

GATED_SENTINEL = -1.0
N_THRESHOLDS = 62  # tau_i = (700 + 5 i) / 1000, i = 0..61: 0.700 .. 1.000, and 1.005, which admits nothing


def tau(i: Column) -> Column:
    """Clean threshold grid: exact 0.95 and 1.0 (no arange drift)."""
    return (F.lit(700) + F.lit(5) * i).cast("double") / F.lit(1000.0)


def roc_groups(population: Column, split: Column) -> Column:
    """ROC A = P2_control vs P2; ROC B = P3_control vs P3 (all 8 families),
    with in-design-5 and held-out-3 breakdowns sharing the control."""
    return (F.when(population.isin("P2", "P2_control"), F.array(F.lit("roc_a")))
            .when(population == "P3_control",
                  F.array(F.lit("roc_b"), F.lit("roc_b_indesign5"), F.lit("roc_b_heldout3")))
            .when((population == "P3") & (split == "in_design"), F.array(F.lit("roc_b"), F.lit("roc_b_indesign5")))
            .when((population == "P3") & (split == "held_out"), F.array(F.lit("roc_b"), F.lit("roc_b_heldout3")))
            .otherwise(F.array().cast("array<string>")))


def with_similarity(df: DataFrame, a: str = "prompt_a", b: str = "prompt_b") -> DataFrame:
    """J7 with the default embedder: cosine of hashed bags of words of the
    normalised prompts, clipped to [0, 1] (offline form)."""
    return df.withColumn("sim", bow_cosine(hashed_buckets(normalize_text(F.col(a))),
                                           hashed_buckets(normalize_text(F.col(b)))))


def embedded_similarity(pairs_: DataFrame, cache: DataFrame, models: dict) -> DataFrame:
    """(pair_id, model, sim) through a read-through embedding cache
    (key, model, embedding). For each model only the distinct normalised
    prompts that the cache lacks are embedded; the vectors are joined back by
    text and compared by the dense cosine, clipped to [0, 1] (J7). On the way they are packed, as
    each is shuffled once to its text and once to each pair."""
    from ..functions.vectors import pack, packed_cosine
    from ..session import materialize
    from ..sources.sinks import embed_with_cache
    p = materialize(pairs_.select("pair_id", normalize_text(F.col("prompt_a")).alias("a"),
                                  normalize_text(F.col("prompt_b")).alias("b")), "prompts")
    texts = materialize(p.select(F.explode(F.array("a", "b")).alias("text")).distinct(), "texts")
    out = None
    for model, embedder in models.items():
        packed = lambda t, embedder=embedder: embedder(t).select("text", pack(F.col("embedding")).alias("embedding"))
        have = cache.filter(F.col("model") == model).withColumn("embedding", pack(F.col("embedding")))
        full, _ = embed_with_cache(texts, have, model, packed)
        e = materialize(full.select("text", "embedding"), "embedded")
        x = (p.join(e.select(F.col("text").alias("a"), F.col("embedding").alias("ea")), "a")
             .join(e.select(F.col("text").alias("b"), F.col("embedding").alias("eb")), "b")
             .select("pair_id", F.lit(model).alias("model"), packed_cosine(F.col("ea"), F.col("eb")).alias("sim")))
        out = x if out is None else out.unionByName(x)
    return out


SCORED_COLS = ["pair_id", "population", "family", "split", "workload_label", "y", "sim", "compatible", "prompt_a", "prompt_b"]


def scored_pairs(spark: SparkSession, sf_dir: str, whole: bool = True, kind: str | None = None) -> DataFrame:
    """Pairs with y, sim, compatible. The gate is model-independent and
    computed once per pair (V5). ``kind``: see ``pairs.eval_pairs``."""
    p = gate.with_pair_compatibility(pairs.eval_pairs(spark, sf_dir, whole, constraints=True, similarity=True, kind=kind))
    return p.withColumn("y", F.col("safe_to_reuse")).select(*SCORED_COLS)


def scored(pairs_: DataFrame) -> DataFrame:
    """The columns of ``scored_pairs`` for some pairs, from their own prompts."""
    return gate.with_pair_compatibility(with_similarity(pairs_)).withColumn("y", F.col("safe_to_reuse")).select(*SCORED_COLS)


TALLY = ["population", "split", "y", "sim", "compatible"]


def tallies(scored_: DataFrame) -> DataFrame:
    """How many pairs (``n``) have the same ``TALLY``, all that thresholds, curves and areas depend on: pairs are many,
    and their similarities, being roots of ratios of small integers, few."""
    return scored_.groupBy(*TALLY).agg(F.count(F.lit(1)).alias("n"))


def score_variants(scored: DataFrame) -> DataFrame:
    """cosine_only = sim; gated = sim if compatible else -1.0."""
    v = F.array(F.struct(F.lit("cosine_only").alias("variant"), F.col("sim").alias("score")),
                F.struct(F.lit("gated").alias("variant"),
                         F.when(F.col("compatible"), F.col("sim")).otherwise(F.lit(GATED_SENTINEL)).alias("score")))
    return scored.select("*", F.explode(v).alias("_v")).select("*", "_v.variant", "_v.score").drop("_v")


def long_scores(scored: DataFrame) -> DataFrame:
    g = score_variants(scored)
    return g.select("*", F.explode(roc_groups(F.col("population"), F.col("split"))).alias("group_name"))


def _bucket(score: Column) -> Column:
    """Index of the highest threshold with tau <= score, -1 if none."""
    k = F.least(F.greatest(F.floor((score * 1000 - 700) / 5), F.lit(-1)), F.lit(N_THRESHOLDS - 1)).cast("int")
    up = (k + 1 <= N_THRESHOLDS - 1) & (tau(k + 1) <= score)
    down = (k >= 0) & (tau(k) > score)
    return F.when(score.isNull(), F.lit(-1)).when(up, k + 1).when(down, k - 1).otherwise(k)


def threshold_sweep(long: DataFrame, keys=("group_name", "variant"), weight: str | None = None) -> DataFrame:
    """A5: tpr, fpr, hit_rate_on_eval_set at each tau (admit iff score >= tau). A row counts ``weight`` times.
    One pass: rows go to their highest admitted threshold bucket; suffix
    sums run over at most 63 rows per key. Single-class keys raise."""
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    cells = (long.withColumn("_b", _bucket(F.col("score")))
             .groupBy(*keys, "_b").agg(F.sum(F.when(F.col("y"), w).otherwise(0)).alias("pos"),
                                       F.sum(F.when(~F.col("y"), w).otherwise(0)).alias("neg")))
    totals = cells.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    grid = totals.select(*keys, "n_pos", "n_neg", F.explode(F.sequence(F.lit(0), F.lit(N_THRESHOLDS - 1))).alias("_b"))
    w = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = (grid.join(cells, [*keys, "_b"], "left")
         .withColumn("tp", F.sum(F.coalesce("pos", F.lit(0))).over(w))
         .withColumn("fp", F.sum(F.coalesce("neg", F.lit(0))).over(w)))
    guard = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0),
                   F.raise_error(F.lit("threshold_sweep: single-class group; pair it with its counterpart")))
    return s.select(
        *keys, F.round(tau(F.col("_b")), 3).alias("threshold"),
        F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
        F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"),
        F.coalesce(guard.cast("double"), F.round(F.col("tp") / F.col("n_pos"), 6)).alias("tpr"),
        F.round(F.col("fp") / F.col("n_neg"), 6).alias("fpr"),
        F.round((F.col("tp") + F.col("fp")) / (F.col("n_pos") + F.col("n_neg")), 6).alias("hit_rate_on_eval_set"))


def auc_table(long: DataFrame, keys=("group_name", "variant"), weight: str | None = None) -> DataFrame:
    keys = list(keys)
    a = ranking.auc(long, keys, weight=weight)
    return a.select(*keys, (F.col("P") + F.col("N")).cast("bigint").alias("n"),
                    F.col("P").cast("bigint").alias("n_pos"), F.col("N").cast("bigint").alias("n_neg"),
                    F.round("auc", 6).alias("auc"))


def auc_bootstrap_ci(long: DataFrame, keys=("group_name", "variant"), replicates: int = 1000,
                     seed: int = 0, weight: str | None = None) -> DataFrame:
    """A9, see ``operators.bootstrap``."""
    from .bootstrap import auc_bootstrap_ci as _ci
    return _ci(long, keys, replicates, seed, weight)


def roc_report(long: DataFrame, replicates: int = 1000, seed: int = 0, weight: str | None = None) -> DataFrame:
    """V1/V2: n, n_pos, n_neg, AUC and bootstrap CI per (group, variant)."""
    return auc_table(long, weight=weight).join(auc_bootstrap_ci(long, replicates=replicates, seed=seed, weight=weight),
                                               ["group_name", "variant"])


def roc_breakdown(aucs: DataFrame) -> DataFrame:
    """V3: pooled vs in-design vs held-out, one row per variant."""
    b = aucs.filter(F.col("group_name").startswith("roc_b"))
    return (b.groupBy("variant").pivot("group_name", ["roc_b", "roc_b_indesign5", "roc_b_heldout3"])
            .agg(F.first("auc"))
            .select("variant", F.col("roc_b").alias("auc_all8"), F.col("roc_b_indesign5").alias("auc_indesign5"),
                    F.col("roc_b_heldout3").alias("auc_heldout3")))


ADMISSION_TAUS = (0.90, 0.95, 0.99)


def admission_rate(scored: DataFrame, population: str = "P1", taus=ADMISSION_TAUS) -> DataFrame:
    """A10: share of a population admitted at each tau, mean and median sim."""
    p = scored.filter(F.col("population") == population)
    stats = p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 6).alias("mean_sim"),
                  *[F.avg((F.col("sim") >= F.lit(t)).cast("double")).alias(f"r{i}") for i, t in enumerate(taus)])
    med = ranking.exact_percentiles(p, [], "sim", {"median_sim": 0.5})
    one = stats.withColumn("_k", F.lit(0)).join(med.withColumn("_k", F.lit(0)), "_k", "left")
    arr = F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"r{i}").alias("rate")) for i, t in enumerate(taus)])
    return one.select("n", "mean_sim", F.round("median_sim", 6).alias("median_sim"), F.explode(arr).alias("x")) \
        .select(F.col("x.tau").alias("tau"), "n", F.round("x.rate", 6).alias("admission_rate"), "mean_sim", "median_sim")


def false_hits_by_family(scored: DataFrame, tau_: float = 0.95) -> DataFrame:
    """P3 pairs cosine alone admits at tau, per family (absent -> 0)."""
    p3 = scored.filter(F.col("population") == "P3")
    found = p3.groupBy("family").agg(F.count(F.lit(1)).alias("n_pairs"),
                                     F.count_if(F.col("sim") >= F.lit(tau_)).alias("false_hits"))
    return (families(scored.sparkSession).select("family").join(found, "family", "left")
            .select("family", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
                    F.coalesce("false_hits", F.lit(0)).alias("false_hits"))
            .withColumn("false_hit_rate", F.coalesce(F.round(F.try_divide("false_hits", "n_pairs"), 6), F.lit(0.0))))


def family_similarity(scored: DataFrame) -> DataFrame:
    """Mean and median sim per P3 family, next to the P3_control mean."""
    p3 = scored.filter(F.col("population") == "P3")
    means = p3.groupBy("family").agg(F.avg("sim").alias("mean_sim"), F.count(F.lit(1)).alias("n_pairs"))
    med = ranking.exact_percentiles(p3, ["family"], "sim", {"median_sim": 0.5})
    ctrl = (scored.filter(F.col("population") == "P3_control").agg(F.avg("sim").alias("control_mean"))
            .withColumn("_k", F.lit(0)))
    return (means.join(med, "family").withColumn("_k", F.lit(0)).join(F.broadcast(ctrl), "_k").drop("_k")
            .select("family", "n_pairs", F.round("mean_sim", 6).alias("mean_sim"),
                    F.round("median_sim", 6).alias("median_sim"), F.round("control_mean", 6).alias("control_mean")))
