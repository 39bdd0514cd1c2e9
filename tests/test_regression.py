"""The regression gate on a stored snapshot."""

import uuid

import pytest
from pyspark.sql import functions as F

from reuselens.functions import constraints as C
from reuselens.operators import regression as R
from reuselens.session import scratch_path


def scored(spark):
    rows = []
    for i in range(60):
        n = 3 + i % 5
        safe = i % 2 == 0
        a, b = f"List {n} ideas about topic {i}.", f"List {n if safe else n + 1} ideas about topic {i}."
        rows.append((f"p{i}", safe, 0.9 + (i * 7 % 50) / 1000, a, b))
    df = spark.createDataFrame(rows, "pair_id string, y boolean, sim double, prompt_a string, prompt_b string")
    ca, cb = C.extract_constraints(F.col("prompt_a")), C.extract_constraints(F.col("prompt_b"))
    return df.withColumn("compatible", C.compatible(ca, cb))


def blind(prompt):
    """An extractor that no longer sees numbers."""
    return C.extract_constraints(F.regexp_replace(prompt, r"\d+", "n"))


def test_gate_passes_and_fails(spark):
    path = scratch_path(spark, f"test-frozen-{uuid.uuid4().hex}")
    R.freeze(scored(spark), path, 1)
    one = lambda extract=None: R.regression_gate(
        R.verdicts(R.snapshot(spark, path), extract).withColumn("k", F.lit("x")), ["k"]).first()
    same = one()
    assert same.passed and same.baseline_auc == same.current_auc == 1.0 and same.n == 60
    assert same.diff_low == same.diff_high == 0
    worse = one(blind)
    assert not worse.passed and worse.baseline_auc == 1.0 and worse.current_auc < 0.8
    assert worse.diff_low <= worse.current_auc - 1.0 <= worse.diff_high < 0


def test_versions(spark):
    path = scratch_path(spark, f"test-frozen-{uuid.uuid4().hex}")
    first = scored(spark)
    R.freeze(first, path, 1)
    with pytest.raises(Exception, match="(?i)exist"):
        R.freeze(first, path, 1)
    R.freeze(first.limit(10), path, 2)
    assert R.snapshot(spark, path).count() == 10 and R.snapshot(spark, path, 1).count() == 60


def test_a_set_of_one_class_raises(spark):
    judged = R.verdicts(scored(spark).filter("y")).withColumn("k", F.lit("x"))
    with pytest.raises(Exception, match="one class"):
        assert R.regression_gate(judged, ["k"]).collect()
