"""Operators over an order: running totals, latest row, exact medians, top rows.

A plain window puts a whole group in one task. Where a group may be as large as the table, the
operators here either aggregate with map-side combining, or split the order into ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from attestor.session import materialise, shuffled

PART = "_part"
#: A row's place in the order of its range.
ROW = "_row"


def split_by_range(df: DataFrame, keys: Sequence[str | Column], parts: int) -> DataFrame:
    """Sort ``df`` over ``parts`` range partitions and keep each row's range number and place in it.

    The result is written to the checkpoint folder, so a lost executor re-reads the same ranges.
    """
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return materialise(ranged.withColumns({PART: F.spark_partition_id(), ROW: F.monotonically_increasing_id()}))


#: Rows that one task of a whole sort holds, about.
SORTED_ROWS = 500_000


def in_order(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """``df`` sorted as a whole, by as many tasks as its rows ask for, so that none holds more the larger it is.

    Rows with equal keys go by their other columns and may be divided between tasks.
    """
    rest = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    parts = max(-(-df.count() // SORTED_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartitionByRange(parts, *keys, *rest).sortWithinPartitions(*keys, *rest)


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    )


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[str], totals: Mapping[str, Column], parts: int | None = None
) -> DataFrame:
    """Inclusive running sums within each group; ``order`` must end in a unique key.

    Groups of any size: rows are split into ranges of (group, order), summed per range, and each range adds
    what came before it. There are as many ranges as the session has shuffle partitions.
    """
    rows = df.withColumns({f"_add_{name}": value for name, value in totals.items()})
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = split_by_range(rows, [*group, *order], parts)

    sums = rows.groupBy(PART, *group).agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in totals])
    # Only a range's first group can continue an earlier one, and only its last can be continued.
    anchor = [F.col(g) for g in group] or [F.lit(0)]
    before = Window.partitionBy(*anchor).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        PART, *group, *[F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in totals],
        F.lag(F.lit(1)).over(Window.partitionBy(*anchor).orderBy(PART)).alias("_continued"),
    ).filter("_continued IS NOT NULL").drop("_continued")
    local = Window.partitionBy(PART, *group).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({n: F.sum(f"_add_{n}").over(local) for n in totals})
    joined = within.alias("r").join(carry.alias("c"), _same("r", "c", [PART, *group]), "left")
    added = {n: F.col(f"r.{n}") + F.coalesce(F.col(f"c._carry_{n}"), F.lit(0)) for n in totals}
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], *[v.alias(n) for n, v in added.items()])


_WHOLE = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
_NARROW = (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _packed(df: DataFrame, columns: Sequence[str]) -> Column | None:
    """One or two order columns as one number, which a task can keep without sorting; NULL comes first."""

    def number(name: str) -> Column:
        kind = df.schema[name].dataType
        value = F.col(name)
        if isinstance(kind, T.TimestampType):
            value = F.unix_micros(value)
        elif isinstance(kind, T.TimestampNTZType):
            # By its parts: a time without zone keeps its order in every session.
            seconds = F.hour(value) * 3600 + F.minute(value) * 60
            micros = (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("long")
            value = (F.unix_date(value.cast("date")).cast("long") * 86_400 + seconds) * 1_000_000 + micros
        elif isinstance(kind, T.DateType):
            value = F.unix_date(value)
        return value.cast("decimal(38,0)")

    def whole(value: int) -> Column:
        return F.lit(str(value)).cast("decimal(38,0)")

    kinds = [df.schema[c].dataType for c in columns]
    if len(columns) == 1 and isinstance(kinds[0], (*_WHOLE, *_NARROW)):
        return F.coalesce(number(columns[0]), whole(-(2**63) - 1))
    if len(columns) == 2 and isinstance(kinds[0], _NARROW) and isinstance(kinds[1], (*_WHOLE, *_NARROW)):
        # The first has at most 18 digits; the second, moved above 0, fewer than 2 * 10**19 values.
        first = F.coalesce(number(columns[0]), whole(-(10**18))) * whole(2 * 10**19)
        second = F.coalesce(number(columns[1]) + whole(2**63 + 1), whole(0))
        return (first + second).cast("decimal(38,0)")
    return None


def keep_latest(df: DataFrame, keys: Sequence[str], latest_by: Sequence[str]) -> DataFrame:
    """The row with the greatest ``latest_by`` per key; rows that tie are told apart by a hash of all columns.

    The greatest order is found first, as one number per key and task, and its row is joined back. An order
    that does not fit a number is combined with the row itself.
    """
    plain = [c for c, kind in df.dtypes if not kind.startswith("map")]
    tie = F.xxhash64(*plain)
    packed = _packed(df, latest_by)
    if packed is None:
        rest = [c for c in df.columns if c not in keys]
        picked = F.max_by(F.struct(*rest), F.struct(*latest_by, tie.alias("_tie"))).alias("_row")
        return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)
    rows = df.withColumn("_order", packed)
    best = rows.groupBy(*keys).agg(F.max("_order").alias("_order"))
    rows = rows.alias("r").join(shuffled(best.alias("b")), _same("r", "b", [*keys, "_order"])).select("r.*")
    first = Window.partitionBy(*keys, "_order").orderBy(F.desc("_tie"))
    rows = rows.withColumn("_tie", tie).withColumn("_no", F.row_number().over(first))
    return rows.filter("_no = 1").select(*df.columns)


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group, for small ``n``: every map task keeps at most ``n`` of them."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def grouped_median(df: DataFrame, group: Sequence[str], value: str, out: str = "median", parts: int | None = None) -> DataFrame:
    """Exact median per group: equal values are counted first, then the middle is found by running counts."""
    counts = materialise(
        df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counts, group, [value], {"_upto": F.col("_n")}, parts)
    if group:
        sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
        ranked = ranked.alias("r").join(sizes.alias("s"), _same("r", "s", group)).select("r.*", "s._size")
    else:
        ranked = ranked.withColumn("_size", F.lit(counts.agg(F.sum("_n")).first()[0] or 0))
    upto, size = F.col("_upto"), F.col("_size")
    low = F.min(F.when(upto >= F.floor((size + 1) / 2), F.col(value)))
    high = F.min(F.when(upto >= F.floor((size + 2) / 2), F.col(value)))
    return ranked.groupBy(*group).agg(((low + high) / 2).alias(out))


def histogram(
    df: DataFrame, value: str, bins: int, by: str | None = None, bounds: tuple[float, float] | None = None
) -> DataFrame:
    """Row counts per fixed-width bin (0-based, the top edge in the last bin); other text is dropped."""
    rows = df.withColumn("_v", F.col(value).cast("string").try_cast("double"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if bounds is None:
        low, high = rows.agg(F.min("_v"), F.max("_v")).first()
        if low is None:
            low, high = 0.0, 1.0
    else:
        low, high = bounds
    width = (high - low) / bins if high > low else 1.0
    bin_no = F.least(F.greatest(F.floor((F.col("_v") - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    keys = [bin_no.alias("bin")] + ([F.col(by)] if by else [])
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", *([by] if by else []), F.round(F.lit(low) + F.col("bin") * width, 6).alias("bin_start"), "n")
