"""Stage tables in buckets by key: a resume or an upsert touches only the buckets it has rows for.

A bucket is a folder of the table (``bucket=n``, by a hash of the key), so Spark prunes what it need not read
and replaces single buckets in one commit (dynamic partition overwrite). Rows that stay are never moved between
buckets, and where the updates are few, Spark sends them to the tasks and the old rows are not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestor.session import work_path

BUCKET = "bucket"
#: Buckets of a new table: about one per gigabyte of it, and per task that is to write at once.
BUCKETS = 64


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """A new table; ``keys`` tell the bucket of a row. Rows without keys have one like others."""
    rows = df.withColumn(BUCKET, bucket_of(keys, buckets))
    rows.repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """The table's rows, of all buckets or of some."""
    rows = spark.read.parquet(path)
    return (rows if only is None else rows.filter(F.col(BUCKET).isin(list(only)))).drop(BUCKET)


def staying(old: DataFrame, updates: DataFrame, keys: Sequence[str], touched: Sequence[int]) -> DataFrame:
    """The rows of the ``touched`` buckets whose keys no update has; both tables have the bucket column."""
    same = F.col(f"o.{BUCKET}") == F.col(f"n.{BUCKET}")
    for k in keys:
        same &= F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    there = old.filter(F.col(BUCKET).isin(list(touched))).alias("o")
    return there.join(updates.select(BUCKET, *keys).alias("n"), same, "left_anti")


def upsert_buckets(updates: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    """Replace the rows of ``updates``' keys, one row per key, and add the new ones; gives the buckets that were written.

    ``buckets`` is that of :func:`write_buckets`. Rows of other keys keep their values, buckets without updates
    their files; new columns of ``updates`` are not taken. The commit replaces the touched buckets together.
    """
    spark = updates.sparkSession
    old = spark.read.parquet(path)
    # Written once: its size is known then, and Spark sends it to all tasks if that is small.
    own = work_path(spark, "updates")
    updates.withColumn(BUCKET, bucket_of(keys, buckets)).select(*old.columns).write.parquet(own)
    named = spark.read.schema(old.schema).parquet(own)
    touched = sorted(r[0] for r in named.select(BUCKET).distinct().collect())  # at most as many as there are buckets
    stay = staying(old, named, keys, touched)
    rows = stay.unionByName(named)
    rows.repartition(max(len(touched), 1), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


def not_yet(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Resume: the rows of ``df`` whose keys the table does not have."""
    done = df.sparkSession.read.parquet(path).select(*keys).distinct()
    return df.join(done, list(keys), "left_anti")
