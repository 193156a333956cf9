"""Periodic runs of words by seeding and extending on diagonals.

A run of period ``q`` is a stretch whose words ``q`` apart are equal; on the diagonal of lag ``q`` it is
a match of its length less ``q`` words. A run of at least ``REPEATS`` periods matches at least three
periods long, so for all periods of ``[2**t, 2**(t + 1))`` there is a guaranteed overlap of ``3 * 2**t``
words (``LEAST - 1`` for period 1). The seeds of level ``t`` are the runs of words (k-grams) of that
size: as none is shorter than the period, two neighbouring occurrences of one inside a run are exactly
one smallest period apart. So each position needs only the next occurrence of its k-gram in the same
document, and only where that lag belongs to the level.

k-grams are numbered exactly, not hashed: a gram's number stands for the pair of numbers of the two
shorter grams that make it up. A gram that occurs once has no longer one that occurs twice, so each
level goes on with the positions the one before left. A seed is extended along its diagonal both ways;
the table of the furthest covered position per lag skips all other seeds of the same match.

Documents are independent, so nothing is shuffled; memory follows a slice of texts of about a megabyte,
or the longest single text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import words as W

#: A run has at least this many words, and at least this many periods.
LEAST = 6
REPEATS = 4

_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string()),
    ]
)


class Runs(NamedTuple):
    """Maximal runs in order of start, then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number per distinct pair of numbers."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].reshape(-1)


class _Grams(NamedTuple):
    """The places (in order) whose ``size`` words stand elsewhere too, and the number of these words."""

    size: int
    at: np.ndarray
    number: np.ndarray


def _repeated(size: int, at: np.ndarray, number: np.ndarray) -> _Grams:
    if not len(at):
        return _Grams(size, at, number)
    again = np.bincount(number)[number] > 1
    return _Grams(size, at[again], number[again])


def _longer(grams: _Grams, by: int) -> _Grams:
    """Grams that are ``by`` words longer, each from two that overlap or touch."""
    place = np.searchsorted(grams.at, grams.at + by)
    place[place == len(grams.at)] = 0
    both = grams.at[place] == grams.at + by if len(grams.at) else np.zeros(0, bool)
    return _repeated(grams.size + by, grams.at[both], _pairs(grams.number[both], grams.number[place[both]]))


def _seeds(grams: _Grams, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose gram comes next at a lag of ``[low, high)``, and these lags, by lag and place."""
    order = np.argsort(grams.number, kind="stable")
    at, number = grams.at[order], grams.number[order]
    lag = at[1:] - at[:-1]
    good = (number[1:] == number[:-1]) & (lag >= low) & (lag < high)
    at, lag = at[:-1][good], lag[good]
    order = np.lexsort((at, lag))
    return at[order], lag[order]


def _match(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How far words ``lag`` apart go on being equal from ``at``, to the right (1) or to the left (-1)."""
    far, width = 0, 64
    while True:
        a = at + far * step
        room = len(words) - lag - a if step > 0 else a + 1
        n = min(width, room)
        if n <= 0:
            return far
        rows = slice(a, a + n) if step > 0 else slice(a - n + 1, a + 1)
        equal = words[rows] == words[rows.start + lag : rows.stop + lag]
        if not equal.all():
            return far + int(np.argmin(equal if step > 0 else equal[::-1]))
        far += n
        width *= 4


def runs(words: np.ndarray) -> Runs:
    """All maximal runs of a sequence of words, numbered from 0.

    A separator that occurs nowhere else may stand between texts: no run crosses it.
    """
    three = _longer(_longer(_repeated(1, np.arange(len(words)), words), 1), 1)
    found: dict[tuple[int, int], int] = {}

    def extend(grams: _Grams, low: int, high: int) -> None:
        places, lags = _seeds(grams, low, high)
        bounds = np.flatnonzero(np.diff(lags, prepend=-1, append=-1))
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            lag, furthest, i = int(lags[x]), -1, x
            while i < y:
                at = int(places[i])
                begin, end = at - _match(words, at - 1, lag, -1), at + _match(words, at, lag, 1)
                furthest = max(furthest, end)
                length = end - begin + lag
                if length >= max(LEAST, REPEATS * lag):
                    found[begin, lag] = length
                i += max(1, int(np.searchsorted(places[i:y], furthest)))

    extend(_longer(three, 2), 1, 2)
    grams, low = _longer(three, 3), 2
    while len(grams.at):
        extend(grams, low, 2 * low)
        grams, low = _longer(grams, grams.size), 2 * low
    keys = sorted(found)
    start, period = (np.array([k[j] for k in keys], np.int64) for j in (0, 1))
    return Runs(start, np.array([found[k] for k in keys], np.int64), period)


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, and where texts begin.

    Every text has numbers of its own, so that nothing repeats from text to text, and ends with a separator.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    base = 0
    for text, a in zip(texts, first.tolist(), strict=True):
        known: dict[bytes, int] = {}
        for w in text:
            known.setdefault(w, base + len(known))
        out[a : a + len(text)] = [known[w] for w in text]
        base += len(known)
        out[a + len(text)] = base
        base += 1
    return out, first


def _dropped(found: Runs, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found.start + found.period, 1)
    np.add.at(edge, found.start + found.length, -1)
    return np.cumsum(edge[:-1]) > 0


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the check asks: in one text of ten, from some word on, a repeated piece of themselves."""
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * ((n - a) // p + 1))[: n - a]


def _find(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in W.slices(b.column("text")):
                bounds = piece.offsets.tolist()
                ids = b.column("doc_id").slice(piece.row, len(bounds) - 1).to_pylist()
                texts = [piece.data[x:y].tobytes().split() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                if plant:
                    texts = [planted(i, t) for i, t in zip(ids, texts, strict=True)]
                flat, first = numbered(texts)
                found = runs(flat)
                cut = np.searchsorted(found.start, np.append(first, len(flat)))
                out: dict[str, list] = {"doc_id": ids, "n_words": [len(t) for t in texts], "runs": [], "collapsed": []}
                for words, begin, x, y in zip(texts, first.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    mine = Runs(found.start[x:y] - begin, found.length[x:y], found.period[x:y])
                    out["runs"].append([dict(zip(Runs._fields, r, strict=True)) for r in zip(*(c.tolist() for c in mine), strict=True)])
                    if x < y:
                        words = [w for w, gone in zip(words, _dropped(mine, len(words)).tolist(), strict=True) if not gone]
                    out["collapsed"].append(b" ".join(words).decode())
                yield pa.RecordBatch.from_pydict(out, schema=_OUT)

    return run


def periodic_runs(docs: DataFrame, *, plant: bool = False) -> DataFrame:
    """The periodic runs of every whole text of ``docs`` (``doc_id``, ``text``), and the text without them.

    Returns ``doc_id``, ``n_words``, ``runs`` (``start, length, period`` in words, by start, then period) and
    ``collapsed``: the words outside of runs and the first period of each run, joined by one space. Words
    are runs of bytes other than ASCII white space. A run is a stretch of smallest period ``q``, at least
    ``max(LEAST, REPEATS * q)`` words long, that no neighbouring word extends. NULL, empty and blank texts
    have no words and no runs. One row per input row; repeated rows and rows without ``doc_id`` are rows like
    others. Other columns are ignored; an empty table gives an empty result. ``plant`` repeats a piece of
    one text in ten before (:func:`planted`).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(plant), "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Per row of :func:`periodic_runs`: the number of runs, the longest one, and digests of all and of the text."""
    runs_text = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    # The greatest of (length, -start, -period) is the longest, first, shortest-period run.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(runs_text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
