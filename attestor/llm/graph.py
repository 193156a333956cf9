"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.frames import parts, written

#: Edges of one task; small rounds are not spread over more tasks than they need.
TASK_EDGES = 250_000


def _lowest(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included; hubs are reduced before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _few(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, min(parts(df), -(-rows // TASK_EDGES))))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` with the smallest node id of each component, for every node that has a link.

    The component's smallest node points to itself. Links may repeat and go either way; a link with a
    NULL end or from a node to itself adds nothing. Every round's edges are written to the checkpoint
    folder; there are about as many rounds as the logarithm of the longest path.
    """
    ends = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    edges = edges.where(ends).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges)
    mark = _mark(edges)
    while mark[0]:
        edges = _few(edges, mark[0])
        around = _both_ways(edges)
        large = around.where("v > u").join(_lowest(around), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v")
        large = written(_few(large, mark[0]))
        lowest = _lowest(large)
        small = large.join(lowest, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = written(_few(small.unionByName(lowest.select("u", F.col("low").alias("v"))).where("u > v").distinct(), mark[0]))
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
