"""Reproducible hash-ordered samples of a decision log (one row per ``pair_id``)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from attestor import presets, schemas
from attestor.functions.text import pair_nct, pair_pmid, stable_rank, text

RANK = "_stable_rank"
#: Hash digits by which rows are counted in one pass: 4096 counts.
BUCKET_DIGITS = 3
#: Keys of one bucket that are put in order on the driver; a larger bucket is counted by more digits first.
EDGE_KEYS = 4096


Edge = tuple[str, str]


def share_edges(df: DataFrame, group: Column, size_of: Callable[[int], int], key: str = "pair_id") -> dict[object, Edge | None]:
    """Per value of ``group`` the last (hash, key) of the first ``size_of(row count)`` rows in that order; NULL keys are no rows.

    Rows of all groups are counted per hash bucket in one pass, then within the bucket in which each sample
    ends, until that is small. Copies of a key stay together: the key at the edge counts with all its
    rows. For few groups, as strata are.
    """
    keyed = df.filter(F.col(key).isNotNull()).select(group.alias("_group"), F.col(key).cast("string").alias(key))
    keyed = keyed.filter(F.col("_group").isNotNull()).withColumn(RANK, stable_rank(key))
    edges: dict[object, Edge | None] = {}
    wanted: dict[object, int] = {}
    ending: dict[object, str] = {}  # the small buckets in which samples end

    def inside(prefixes: dict[object, str]) -> Column:
        hit = F.lit(False)
        for value, prefix in prefixes.items():
            hit |= (F.col("_group") == F.lit(value)) & F.col(RANK).startswith(prefix)
        return hit

    open_: dict[object, str] | None = None
    digits = BUCKET_DIGITS
    while open_ is None or open_:
        rows = keyed if open_ is None else keyed.filter(inside(open_))
        counted = rows.groupBy("_group", F.substring(RANK, 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        found: dict[object, dict[str, int]] = {}
        for row in counted:
            found.setdefault(row["_group"], {})[row["b"]] = row["n"]
        open_ = {}
        for value, counts in found.items():
            if value not in wanted:
                total = sum(counts.values())
                wanted[value] = min(size_of(total), total)
            if wanted[value] <= 0:
                edges[value] = None
                continue
            for name in sorted(counts):
                if counts[name] >= wanted[value]:
                    break
                wanted[value] -= counts[name]
            (ending if counts[name] <= EDGE_KEYS or digits >= 15 else open_)[value] = name
        digits += BUCKET_DIGITS
    if ending:
        last = keyed.filter(inside(ending)).groupBy("_group", RANK, key).agg(F.count(F.lit(1)).alias("n"))
        for row in sorted(last.collect(), key=lambda r: (r[RANK], r[key])):
            value = row["_group"]
            if value not in edges:
                if row["n"] >= wanted[value]:
                    edges[value] = (row[RANK], row[key])
                wanted[value] -= row["n"]
    return edges


def share_edge(df: DataFrame, size_of: Callable[[int], int], key: str = "pair_id") -> Edge | None:
    """:func:`share_edges` of all rows as one group."""
    return share_edges(df, F.lit(0), size_of, key).get(0)


def up_to(edge: Edge | None, key: str = "pair_id") -> Column:
    """Whether a row lies in the sample that ends at ``edge``: a test of the row alone."""
    if edge is None:
        return F.lit(False)
    rank, name = stable_rank(key), F.col(key).cast("string")
    return F.coalesce((rank < edge[0]) | ((rank == edge[0]) & (name <= edge[1])), F.lit(False))


def stable_sample(df: DataFrame, n: int, key: str = "pair_id") -> DataFrame:
    """The first ``n`` rows in (hash, key) order, as a set."""
    return df.filter(up_to(share_edge(df, lambda _: n, key), key))


def stable_share(df: DataFrame, size_of: Callable[[int], int], key: str = "pair_id") -> DataFrame:
    """Keys of the first ``size_of(row count)`` rows in (hash, key) order, for samples of any size."""
    return df.filter(up_to(share_edge(df, size_of, key), key)).select(key).distinct()


def in_spot_check(log: DataFrame, rate: float = presets.SPOT_CHECK_RATE) -> Column:
    """Whether a log row is in the deterministic share of automatically routed pairs that people check (rounded down)."""
    auto = F.col("routing").isin("auto_concordant", "auto_major_switch")
    edge = share_edge(log.filter(auto), lambda n: min(n, int(n * rate)) if rate > 0 else 0)
    return F.coalesce(auto, F.lit(False)) & up_to(edge)


def spot_check_pairs(log: DataFrame, rate: float = presets.SPOT_CHECK_RATE) -> DataFrame:
    """The pairs of the spot check."""
    return log.filter(in_spot_check(log, rate)).select("pair_id").distinct()


def second_rater_template(log: DataFrame, rate: float = presets.SPOT_CHECK_RATE) -> DataFrame:
    """A blinded second-review sheet for a share of the reviewed pairs (rounded up, at least one)."""
    reviewed = log.filter(F.col("human_reviewed").isin(*presets.REVIEWED_STATUSES))
    edge = share_edge(reviewed, lambda n: min(n, max(math.ceil(n * rate), 1)))
    return _sheet(reviewed.filter(up_to(edge)), schemas.SECOND_REVIEW_COLUMNS)


def stratified_sample(
    log: DataFrame, n: int = presets.GOLD_SAMPLE_SIZE, stratum: str = "routing", strata=presets.ROUTINGS, key: str = "pair_id"
) -> DataFrame:
    """At most ``n`` rows: an equal quota per stratum, filled up from the rest, all in hash order, as a set."""
    quota, chosen = max(n // len(strata), 1), F.lit(False)
    edges = share_edges(log.filter(F.col(stratum).isin(*strata)), F.col(stratum), lambda rows: min(rows, quota), key)
    for value, edge in edges.items():
        chosen = chosen | (F.coalesce(F.col(stratum) == value, F.lit(False)) & up_to(edge, key))
    taken = log.filter(chosen).count()
    if taken > n:
        chosen = chosen & up_to(share_edge(log.filter(chosen), lambda _: n, key), key)
    elif taken < n:
        chosen = chosen | up_to(share_edge(log.filter(~chosen), lambda rows: min(rows, n - taken), key), key)
    return log.filter(chosen)


def gold_template(log: DataFrame, n: int = presets.GOLD_SAMPLE_SIZE) -> DataFrame:
    """A blinded gold-standard sheet: identifiers and raw endpoint texts only."""
    candidates = log.filter(text("registered_endpoint") != "").select(
        "pair_id", "registered_endpoint", "published_endpoint", "routing"
    )
    return _sheet(stratified_sample(candidates, n), schemas.GOLD_COLUMNS)


def _sheet(rows: DataFrame, columns) -> DataFrame:
    filled = rows.select("pair_id", "registered_endpoint", "published_endpoint").withColumns(
        {"nct_id": pair_nct("pair_id"), "pmid": pair_pmid("pair_id")}
    )
    blanks = {c: F.lit("") for c in columns if c not in filled.columns}
    return filled.withColumns(blanks).select(*columns)


def composition(template: DataFrame, log: DataFrame) -> DataFrame:
    """Routing counts of the sampled pairs."""
    return (
        log.join(template.select("pair_id"), "pair_id", "left_semi")
        .groupBy("routing")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def annotated(template: DataFrame, label: str = "gold_switch_type") -> DataFrame:
    """How many rows of a sheet have been filled in."""
    return template.agg(F.count_if(text(label) != "").alias("completed"), F.count(F.lit(1)).alias("rows"))
