"""Intermediate tables."""

import os

import pytest

from reuselens import session


def test_shuffle_files_go_with_the_write(spark):
    """After a table is written nothing of its shuffles is left, and the setting is as before."""
    def shuffled():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_") and f.endswith(".data")}
    was = spark.conf.get(session.CLEANUP, None)
    df = spark.range(5000).selectExpr("id % 100 AS k", "id").groupBy("k").count()
    before = shuffled()
    df.write.format("noop").mode("overwrite").save()
    plain = shuffled()
    assert plain > before
    table = session.materialize(df)
    assert not shuffled() - plain and spark.conf.get(session.CLEANUP, None) == was
    assert table.count() == 100


def test_intermediates_keep_the_named_tables(spark):
    with session.intermediates(spark) as drop_but:
        a, b = (session.materialize(spark.range(n)) for n in (3, 4))
        c = session.materialize(b)
        drop_but(a, c)
        assert not os.path.exists(b.materialized_at) and (a.count(), c.count()) == (3, 4)
        with pytest.raises(Exception):
            b.count()
    d = session.materialize(a)
    drop_but()
    assert d.count() == 3
