"""Session, shared scratch folder and written steps."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str | int = "*", app: str = "lintlake", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; on a cluster the submitter's session is reused."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, so that a local folder is shared."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only a local session without one gets a temporary folder, removed at exit."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="lintlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return shared


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lintlake-steps/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Write a DataFrame as parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes the plan once (an eager checkpoint of
    an unpersisted plan runs it twice) and the result keeps column pruning on later scans.  ``options`` are the writer's.
    """
    path = scratch(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.mode("overwrite").options(**options).parquet(path)
    for paths in _watched:
        paths.append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The settings ``spark.sql.`` + name (``__`` for a dot) hold for the jobs inside."""
    keys = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def released(spark: SparkSession):
    """Shuffle files of the jobs inside go when their job ends, not when the driver happens to collect its garbage."""
    return settings(spark, classic__shuffleDependency__fileCleanup__enabled="true")


_watched: list[list[str]] = []


@contextmanager
def steps() -> Iterator[list[str]]:
    """The paths of the steps that are written inside."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield paths
    finally:
        _watched.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove written steps; nothing that is read later may depend on them."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
