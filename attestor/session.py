"""Session helpers: a local session for tests and benches, and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = 8, shuffle_partitions: int = 8, app: str = "attestor") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset, a local session uses a folder beside its warehouse; a cluster must name one.
    """
    sc = spark.sparkContext
    current = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF) or sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        current = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_work(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`work_path` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A write in here deletes its shuffle files as it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_materialised(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for ``df``, which nothing reads any more."""
    drop_work(df.sparkSession, df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that grows with the input: both sides are sorted by key, none is sent through the driver.

    Left alone, Spark goes by the size of compressed files and hands a million short rows to every task.
    """
    return df.hint("merge")


def at_least_parallel(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores (one small file, say); other scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
