"""Metrics of tallied scores, the frozen subset, and labels that are joined last."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from reuselens.operators import bootstrap, metrics, pairs, ranking
from reuselens.plans import queries as Q
from reuselens.sources import fixtures as fx


def _scored(spark):
    rows = [(f"p{i}", ("P3", "P3_control", "P2", "P2_control", "P1")[i % 5], "numeric", ("in_design", "held_out")[i % 3 == 0], None, i % 5 in (1, 3),
             None if i % 41 == 0 else (i * 7 % 23) / 22, i % 4 > 0, "a", "b") for i in range(600)]
    return spark.createDataFrame(rows, "pair_id string, population string, family string, split string, workload_label string, y boolean, "
                                       "sim double, compatible boolean, prompt_a string, prompt_b string")


@pytest.mark.parametrize("what", ["sweep", "auc", "roc", "weights"])
def test_tallied_scores_give_the_same(spark, what):
    keys = ["group_name", "variant"]
    of = {"sweep": lambda d, w: metrics.threshold_sweep(d, weight=w), "auc": lambda d, w: metrics.auc_table(d, weight=w),
          "roc": lambda d, w: ranking.roc_points(d, keys, weight=w), "weights": lambda d, w: bootstrap.score_weights(d, keys, w)}[what]
    s = _scored(spark)
    tallied = metrics.tallies(s)
    assert tallied.count() < s.count()
    want = of(metrics.long_scores(s), None)
    got = of(metrics.long_scores(tallied), "n").select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_metrics_write_no_table_of_all_pairs(spark, monkeypatch):
    built = []
    monkeypatch.setattr(Q, "built_once", lambda spark, name, sf, build: built.append(name) or metrics.tallies(_scored(spark)))
    for q in ("threshold_sweep", "auc", "roc_points", "tau"):
        Q._gated_curve(spark, "none") if q == "tau" else Q.QUERIES[q](spark, "none")
    assert set(built) == {"tallies-perturbed", "tallies-natural"}
    built.clear()
    Q._gated_curve(spark, "none")
    assert built == ["tallies-perturbed"]


def test_frozen_subset_sorts_few_pairs(spark):
    b = spark.range(3000).select(F.col("id").alias("base_id"), F.concat(F.lit("some text "), F.col("id")).alias("base"), F.lit("en").alias("category"))
    every = pairs.perturbed_pairs(b, 1).select(*pairs.PAIR_COLS)
    every = every.unionByName(every.limit(3).withColumn("population", F.lit("P2")))
    from reuselens.functions.hashing import hash_key
    rows = every.filter("population <> 'P2'").select("pair_id", "population", "family", hash_key(0, F.col("pair_id")).alias("h")).collect()
    want = set()
    for stratum in {("control" if r.population == "P3_control" else r.family) for r in rows}:
        mine = sorted((r.h, r.pair_id) for r in rows if ("control" if r.population == "P3_control" else r.family) == stratum)
        want |= {p for _, p in mine[:50 if stratum == "control" else 150 // 8]}
    chosen = Q.frozen_subset(every)
    got = [r.pair_id for r in chosen.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("_last") < plan.index("Generate")  # the hashes are cut off below the window


def test_labels_are_joined_last_and_keep_their_repeats(spark, tmp_path):
    sf = str(tmp_path)
    docs = [(i, f"A sentence of twenty characters {i % 2}. Something else that is long enough", ("en", "fr")[i // 4 % 2]) for i in [*range(12), 5]]
    labels = [(i, i % 3 > 0) for i in range(10)] + [(2, True), (5, False), (None, True)]
    spark.createDataFrame([*docs, (None, "A document that has no number at all", "en")], "doc_id long, text string, lang string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(q)) for i, q in labels], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    d = fx.labelled_natural_pairs(spark, sf, 1)
    want = Counter()
    for a, ta, la in docs:
        for b, tb, lb in docs:
            for n, (x, y) in enumerate(zip(ta.split(". "), tb.split(". "))):
                if b == a + 1 and la == lb:
                    for qa in [q for i, q in labels if i == a] or [None]:
                        for qb in [q for i, q in labels if i == b] or [None]:
                            want[a * fx.SENTENCES + n, b * fx.SENTENCES + n, x, y, int(x.lower() == y.lower() or bool(qa and qb))] += 1
    assert Counter(tuple(r) for r in d.select("base_a", "base_b", "text_a", "text_b", "label").collect()) == want
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Join LeftOuter") < plan.index("Join Inner")
