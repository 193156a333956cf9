"""What the operators share: Arrow columns in and out of tasks, sorted groups, written steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.session import materialise, work_path

_NUMPY = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    fields = [part.split() for part in ddl.split(",")]
    return pa.schema([(name, _NUMPY[kind]) for name, kind in fields])


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A record batch from numpy arrays (64-bit hashes as signed longs), lists or Arrow arrays."""
    out = []
    for field, values in zip(schema, columns, strict=True):
        if isinstance(values, np.ndarray) and values.dtype == np.uint64:
            values = values.view(np.int64)
        if not isinstance(values, pa.Array):
            values = pa.array(values, type=field.type)
        out.append(values if values.type == field.type else values.cast(field.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    return df.mapInArrow(function, ddl)


def group_slices(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin in sorted columns, and their length at the end."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Re-cut a task's sorted batches so that no group of equal keys is divided.

    For groups of a known size bound only: one group is held in memory.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        if held:
            last, top = held[-1], held[-1].num_rows - 1
            same = all(last.column(k)[top] == b.column(k)[b.num_rows - 1] for k in keys)
            if same and all(b.column(k)[0] == b.column(k)[b.num_rows - 1] for k in keys):
                held.append(b)
                continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = int(group_slices(columns)[-2])
        if cut == 0 and held:
            top = held[-1].num_rows - 1
            if not all(held[-1].column(k)[top] == b.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def written(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder; lost executors do not lose it."""
    return materialise(df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same as :func:`written`, as a compressed table of its own in the shared folder."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of one key that a task of a join takes at most, about.
HEAVY = 512


def spread_join(rows: DataFrame, table_: DataFrame, keys: list[str], size: str, by: list[str], how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """``rows`` with the columns of ``table_``, which has one row per ``keys`` and, in ``size``, how many rows have them.

    Keys with more than ``heavy`` rows are dealt over as many tasks as that takes, by a hash of the columns ``by``;
    their row of ``table_`` goes to each. The list of such keys is a table of its own: at most one in
    ``heavy`` rows has a line there, and Spark sends it to all tasks only where it is small. ``size`` is left out.
    """
    deals = F.ceil(F.col(size) / heavy).cast("int")
    hot = stored(table_.where(F.col(size) > heavy).select(*keys, deals.alias("deals_")), "hot")
    deal = F.coalesce(F.pmod(F.xxhash64(*by), F.col("deals_")).cast("int"), F.lit(0))
    dealt = rows.join(hot, keys, "left").withColumn("deal_", deal).drop("deals_")
    lines = table_.withColumn("deal_", F.explode(F.sequence(F.lit(0), F.greatest(deals, F.lit(1)) - 1))).drop(size)
    return dealt.join(lines, [*keys, "deal_"], how).drop("deal_")


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; NULL counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n
