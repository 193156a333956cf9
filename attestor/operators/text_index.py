"""Repeated searches of the same texts through an index of trigrams.

The index is a table ``gram, ids`` of the three-letter pieces of every text, in folders by a hash of the gram; a
gram has a row for each stretch of texts that a task took together. A
pattern that cannot match without certain literal stretches needs only the lists of their trigrams: rows with all of
them are candidates, which the pattern itself then decides. Patterns without such a stretch, or with
signs that are not understood here, are searched for in all rows, so both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestor.functions.text import text
from attestor.session import at_least_parallel

BUCKETS = 64
#: Signs of the texts whose grams are listed together, about; one longer text is taken by itself.
STRETCH = 1 << 20
#: Letters that a search without case takes for plain ones although lower-casing does not. Fixed values.
_FOLD = ("ſİıK", "siik")
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789 -_,;:/'\"=<>%&#@!~")


def folded(value: Column) -> Column:
    return F.lower(F.translate(value, *_FOLD))


def _listed(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """The distinct trigrams of some texts, where the list of each begins, and all lists: numbers of texts."""
    rows = len(texts)
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    there = np.zeros(0x110000, bool)
    there[signs] = True
    alphabet = np.flatnonzero(there)
    size = len(alphabet)
    if size**3 * rows >= 1 << 63:  # one text always fits
        for part, at in ((texts[: rows // 2], 0), (texts[rows // 2 :], rows // 2)):
            for found, begins, lists in _listed(part):
                yield found, begins, lists + at
        return
    if len(signs) < 3:
        return
    lengths = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(rows), lengths)
    place = (np.cumsum(there) - 1)[signs]
    pieces = (place[:-2] * size + place[1:-1]) * size + place[2:]
    # No piece goes beyond its text.
    met = np.unique((pieces * rows + row[:-2])[row[:-2] == row[2:]])
    codes, lists = met // rows, met % rows
    begins = np.flatnonzero(np.diff(codes, prepend=-1))
    codes = codes[begins]
    three = np.stack((codes // size // size, codes // size % size, codes % size), axis=1)
    spelled = alphabet[three].astype("<u4").tobytes().decode("utf-32-le")
    yield [spelled[i : i + 3] for i in range(0, len(spelled), 3)], np.append(begins, len(lists)), lists


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = np.cumsum(b.column("size").to_numpy())
        at = 0
        while at < len(ends):
            full = (ends[at - 1] if at else 0) + STRETCH
            to = max(at + 1, int(np.searchsorted(ends, full, "right")))
            ids = b.column("id").slice(at, to - at)
            for found, begins, lists in _listed(b.column("body").slice(at, to - at).to_pylist()):
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), ids.take(pa.array(lists)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), lists], ["gram", "ids"])
            at = to


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(df: DataFrame, path: str, key: str, columns: Sequence[str]) -> None:
    """Index the text ``columns`` of ``df`` by its unique ``key``; a trigram never spans two columns."""
    rows = at_least_parallel(df.select(key, *columns))
    # A folder is written by more tasks where there is more to read.
    slices = -(-rows.rdd.getNumPartitions() // BUCKETS)
    every = rows.select(F.col(key).alias("id"), F.explode(F.array(*[folded(text(c)) for c in columns])).alias("body"))
    lists = every.withColumn("size", F.length("body")).mapInArrow(_postings, f"gram string, ids array<{df.schema[key].dataType.simpleString()}>")
    lists = lists.withColumns({"bucket": _bucket(F.col("gram")), "slice": F.pmod(F.xxhash64("gram", F.lit(1)), F.lit(slices))})
    lists = lists.repartition(BUCKETS * slices, "bucket", "slice").sortWithinPartitions("bucket", "gram").drop("slice")
    lists.write.mode("overwrite").partitionBy("bucket").parquet(path)


def needed(pattern: str) -> list[set[str]] | None:
    """Per alternative of a pattern the trigrams that each match of it holds; None if an alternative needs none."""
    alternatives, runs, run, at = [], [], "", 0
    pattern = pattern.lower()

    def ended() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while at <= len(pattern):
        sign = pattern[at] if at < len(pattern) else "|"
        if sign == "|":
            ended()
            found = {r[i : i + 3] for r in runs for i in range(len(r) - 2)}
            if not found:
                return None
            alternatives.append(found)
            runs = []
        elif sign in _PLAIN:
            run += sign
        elif sign in "?*":
            run = run[:-1]  # empty after a class, which has ended the run
            ended()
        elif sign == "+":
            ended()
        elif sign in ".^$":
            ended()
        elif sign == "[":
            close = pattern.find("]", at + 2)
            if close < 0 or "[" in pattern[at + 1 : close] or "\\" in pattern[at:close] or "&&" in pattern[at:close]:
                return None
            ended()
            at = close
        else:
            return None
        at += 1
    return alternatives


def search(spark: SparkSession, df: DataFrame, path: str, key: str, pattern: str, columns: Sequence[str]) -> DataFrame:
    """The rows of ``df`` with the pattern in any of ``columns``, whatever the case; ``path`` is their index."""
    pattern = pattern.strip().lower()
    if not pattern:
        return df
    hit = F.lit(False)
    for c in columns:
        hit |= text(c).rlike("(?iU)" + pattern)
    asked = needed(pattern)
    if asked is None:
        return df.filter(hit)
    lists = sorted(set().union(*asked))
    # The folders are known before the search, so no other list is read.
    of = spark.createDataFrame([(g,) for g in lists], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct()
    folders = sorted(r["b"] for r in of.collect())
    met = spark.read.parquet(path).filter(F.col("bucket").isin(folders) & F.col("gram").isin(lists))
    has = met.select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.collect_set("gram").alias("grams"))
    whole = F.lit(False)
    for alternative in asked:
        whole |= F.size(F.array_intersect("grams", F.array(*[F.lit(g) for g in sorted(alternative)]))) == len(alternative)
    return df.join(has.filter(whole).select(F.col("id").alias(key)), key, "left_semi").filter(hit)
