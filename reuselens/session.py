"""Spark session helpers.

The library never hard-codes cluster paths. ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the running session (the shared folder the
cluster names) and only falls back to a private scratch folder when the
setting is absent, which is the local/test case.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "reuselens", extra: dict | None = None) -> SparkSession:
    """A session with the library's defaults. ``master`` and the number of
    shuffle partitions are only set if asked for; without them what
    spark-submit says holds (``local[8]`` and 8 partitions if that says nothing)."""
    master = master or os.environ.get("REUSELENS_MASTER")
    conf = dict(DEFAULT_CONF)
    if not master and not SparkConf().contains("spark.master"):
        master = "local[8]"
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            conf["spark.sql.shuffle.partitions"] = "8"
            conf["spark.driver.memory"] = os.environ.get("REUSELENS_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**conf, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster sets it. Only a local
    master (runs on one machine, tests) gets a scratch folder of its own,
    which goes when the process ends; on a cluster an unset folder is an
    error, as executors do not share the driver's disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="reuselens-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written table of this application."""
    return f"{checkpoint_dir(spark).rstrip('/')}/reuselens-{spark.sparkContext.applicationId}/{name}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this application wrote to the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "").rstrip("/"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _BUILT.clear()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application: they may
    not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="reuselens-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/reuselens.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(name)


#: Shuffle files of a write go as soon as its table is there; else they stay until the driver's
#: garbage collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A configuration value for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _write(df, path: str) -> None:
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.mode("overwrite").option("compression", COMPRESSION).parquet(path)


_BUILT: dict[tuple, str] = {}
COMPRESSION = "zstd"  # of written tables: they stay on the shared disk until the application ends


def built_once(spark: SparkSession, name: str, sf_dir: str, build):
    """A table that several queries read: built and written by the first that
    asks for it (per application and table folder), read by the others.
    ``release`` forgets it."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _BUILT:
        path = scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
        _write(build(), path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


def is_built(spark: SparkSession, name: str, sf_dir: str) -> bool:
    """Whether ``built_once`` has written the table already."""
    return (spark.sparkContext.applicationId, name, sf_dir) in _BUILT


def materialize(df, name: str = "mat"):
    """Cut lineage of a result that several later stages read: write it as
    a Parquet table in the shared checkpoint folder and read it back
    (survives executor loss; columnar, so later readers prune columns and
    push filters into the scan; never a machine-local folder)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
    _write(df, path)
    for paths in _WATCHED:
        paths.add(path)
    table = spark.read.parquet(path)
    table.materialized_at = path
    return table


_WATCHED: list[set[str]] = []


@contextmanager
def intermediates(spark: SparkSession):
    """Gives a function that deletes what ``materialize`` wrote since, but for the tables it is
    called with: an iteration keeps its state and not every earlier one."""
    paths: set[str] = set()

    def drop_but(*frames) -> None:
        for path in paths - {f.materialized_at for f in frames}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            paths.discard(path)
    _WATCHED.append(paths)
    try:
        yield drop_but
    finally:
        _WATCHED[:] = [p for p in _WATCHED if p is not paths]
