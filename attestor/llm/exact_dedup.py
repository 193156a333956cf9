"""Exact duplicates through recipes of content-defined chunks; the texts themselves are never shuffled.

Every whole text is cut where a rolling hash of its last ``WINDOW`` bytes says so, hence at the same
places wherever the same bytes occur. Each chunk has a 64-bit fingerprint, its length and a SHA-256
check. Chunks are deduplicated to identifiers: two chunks with one fingerprint share an identifier
only if length and check agree, else they get different variants of it. A text is then its ordered
list of identifiers, and texts are equal when their lists are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm import words as W
from attestor.llm.frames import HEAVY, arrow_schema, batch, spread_join, written

WINDOW = 48
#: A cut is made at one position in this many, on average.
CHUNK_BYTES = 2048
#: A chunk without a cut ends here.
LONGEST_CHUNK = 1 << 16

_U = np.uint64
_ROW = "row long, doc_id long, text_sha256 string"
_RECIPE = "row long, doc_id long, text_sha256 string, place int, print long, size long, proof binary"


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted ends of all chunks of the texts that lie one after the other in ``data``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        up, down = W._power_tables(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(W._BYTE[data] * up[:n], out=total[1:])
        ends = np.arange(WINDOW, n + 1)
        rolling = W.mix((total[ends] - total[ends - WINDOW]) * down[ends - WINDOW])
    inner = ends[(rolling & _U(CHUNK_BYTES - 1)) == 0]
    # A window must lie in one text.
    begin = offsets[np.searchsorted(offsets, inner, side="left") - 1]
    inner = inner[inner - begin >= WINDOW]
    stops = np.union1d(inner, offsets[1:])
    stops = stops[stops > 0]
    starts = np.concatenate(([0], stops))[:-1]
    long = np.flatnonzero(stops - starts > LONGEST_CHUNK)
    if len(long):
        more = [np.arange(starts[i] + LONGEST_CHUNK, stops[i], LONGEST_CHUNK) for i in long]
        stops = np.union1d(stops, np.concatenate(more))
    return stops


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_RECIPE)
    row = TaskContext.get().partitionId() << 36
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        for piece in W.slices(b.column("text")):
            data, offsets = W.LOWER[piece.data], piece.offsets
            stops = cuts(data, offsets)
            starts = np.concatenate(([0], stops))[:-1].astype(np.int64)
            with np.errstate(over="ignore"):
                up, down = W._power_tables(len(data) + 1)
                total = np.zeros(len(data) + 1, _U)
                np.cumsum(W._BYTE[data] * up[: len(data)], out=total[1:])
                prints = W.mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(_U))
            view = memoryview(data)
            proofs = [hashlib.sha256(view[x:y]).digest() for x, y in zip(starts.tolist(), stops.tolist(), strict=True)]
            first = np.searchsorted(starts, offsets[:-1], side="left")
            counts = np.searchsorted(starts, offsets[1:], side="left") - first
            counts[offsets[1:] == offsets[:-1]] = 0
            whole = [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            texts = len(whole)
            # An empty text is the recipe with no chunk: one row without a place.
            rows = np.maximum(counts, 1)
            of = np.repeat(np.arange(texts), rows)
            at = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
            full = np.repeat(counts > 0, rows)
            chunk = np.where(full, np.repeat(first, rows) + at, -1).tolist()
            yield batch(
                schema,
                [
                    row + of,
                    [ids[piece.row + i] for i in of],
                    [whole[i] for i in of],
                    pa.array(at.astype(np.int32), mask=~full),
                    pa.array([int(prints[c].astype(np.int64)) if c >= 0 else None for c in chunk], pa.int64()),
                    pa.array([int(stops[c] - starts[c]) if c >= 0 else None for c in chunk], pa.int64()),
                    [proofs[c] if c >= 0 else None for c in chunk],
                ],
            )
            row += texts


def identifiers(chunks: DataFrame) -> DataFrame:
    """``print, size, proof`` of every distinct chunk with its ``variant``: 0 unless fingerprints collide."""
    distinct = chunks.select("print", "size", "proof").distinct()
    clash = distinct.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    # Only colliding fingerprints are put in order; such a group holds the few chunks that collide.
    ordered = distinct.join(clash, "print", "left_semi").groupBy("print").agg(F.sort_array(F.collect_list(F.struct("size", "proof"))).alias("all"))
    return ordered.select("print", F.posexplode("all").alias("variant", "one")).select("print", "one.size", "one.proof", "variant")


def exact_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): the group of equal texts and who stays.

    Returns ``doc_id``, ``keep_id`` (largest ``doc_id`` of the group), ``group_size``, ``kept`` and
    ``text_sha256`` of the text with A-Z lower-cased. NULL counts as the empty text. Exactly one row of
    each group is kept: of several rows with the largest ``doc_id`` any one, and in a group without any
    ``doc_id`` one of its rows (``keep_id`` NULL). Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = written(rows.mapInArrow(_recipes, _RECIPE))
    named = chunks.join(identifiers(chunks), ["print", "size", "proof"], "left")
    step = F.struct("place", "print", F.coalesce("variant", F.lit(0)).alias("variant"))
    recipes = named.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), step))).alias("steps"))
    recipe = F.transform("steps", lambda s: F.struct(s["print"], s["variant"]))
    recipes = written(recipes.select("row", "doc_id", "text_sha256", recipe.alias("recipe")))
    groups = recipes.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max_by("row", "doc_id").alias("best"), F.max("row").alias("any_row")
    )
    # The rows of a large group are dealt over several tasks; each gets the group's line.
    groups = written(groups).withColumn("members", F.col("group_size"))
    found = spread_join(recipes, groups, ["recipe"], "members", ["row"], heavy=heavy)
    kept = F.col("row") == F.coalesce("best", "any_row")
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated equal rows one stays."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    print_ = F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower).cast("binary"), 256)
    stays = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("id_"), F.col("text_sha256").alias("print_"))
    rows = docs.withColumn("row_print_", print_)
    same = (F.col("row_print_") == F.col("print_")) & F.col("doc_id").cast("long").eqNullSafe(F.col("id_"))
    rows = rows.join(stays, same, "left_semi")
    # Rows that agree in id and text are the only ones left of their group.
    repeats = Window.partitionBy("row_print_", "doc_id").orderBy(F.lit(0))
    rows = rows.withColumn("repeat_", F.row_number().over(repeats)).where("repeat_ = 1")
    return rows.select(*[rows[c] for c in docs.columns])
