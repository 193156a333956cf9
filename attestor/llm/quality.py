"""A quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins by quantiles of the training sample. Shallow trees, each on one
feature's bins and boosted in turn over all features, add up to one lookup table per feature; then
trees on two features at a time, for the pairs that still explain most, add tables per pair. A text's
score is the sigmoid of the sum of its table entries, so scoring is one lookup per table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm import words as W
from attestor.llm.frames import arrow_schema, batch

#: Labelled texts the model is fitted on, about.
SAMPLE_TEXTS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.15
LEAVES = 3
#: Least weight of a leaf, and a pull of its value towards zero.
LEAST_LEAF = 10.0
RIDGE = 2.0
THRESHOLD = 0.3

FEATURES = (
    "words", "word_length", "long_words", "short_words", "capitals", "digits", "exclamations", "bars", "symbols", "stops", "other_marks",
    "lines", "high_bytes", "distinct_words", "top_word", "distinct_triples", "repeated_lines",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars.encode())] = 1
    return out


_KINDS = {
    "capitals": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "letters": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "digits": _table("0123456789"),
    "exclamations": _table("!?"),
    "bars": _table("|"),
    "symbols": _table("#$%&*@^~+=<>{}[]\\/_"),
    "stops": _table(".,;:"),
    "other_marks": _table("\"'()-`"),
    "lines": _table("\n"),
}
_KINDS["high_bytes"] = np.zeros(256, np.float32)
_KINDS["high_bytes"][128:] = 1
_BATCH_KINDS = tuple(_KINDS)


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's range."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(piece: W.Slice) -> np.ndarray:
    """The features of the texts of a slice, one row each; all zero for a text without words."""
    found = W.words(piece, lower=True)
    data, offsets = piece.data, piece.offsets
    counts = np.bincount(np.searchsorted(offsets, np.arange(len(data)), side="right").astype(np.int64) * 256 - 256 + data, minlength=256 * (len(offsets) - 1))
    counts = counts.reshape(-1, 256).astype(np.float64)
    kinds = {name: counts @ _KINDS[name] for name in _BATCH_KINDS}
    n = np.diff(found.first)
    some = np.maximum(n, 1)
    lengths = found.ends - found.starts
    triples = W.grams(found.hashes, 3)
    distinct, top, distinct3, lines = (np.zeros(len(n)) for _ in range(4))
    ends = np.flatnonzero(data == 10)
    for i, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
        if b == a:
            continue
        hashes = np.sort(found.hashes[a:b])
        runs = np.diff(np.concatenate(([0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1, [b - a])))
        distinct[i], top[i] = len(runs) / (b - a), runs.max() / (b - a)
        if b - a >= 3:
            hashes = np.sort(triples[a : b - 2])
            distinct3[i] = (1 + np.count_nonzero(hashes[1:] != hashes[:-1])) / (b - a - 2)
        else:
            distinct3[i] = 1.0
        breaks = ends[np.searchsorted(ends, offsets[i]) : np.searchsorted(ends, offsets[i + 1])]
        if len(breaks):
            cut = np.unique(np.searchsorted(found.starts[a:b], breaks))
            cut = np.concatenate(([0], cut[(cut > 0) & (cut < b - a)], [b - a]))
            whole = W.long_gram(found.hashes[a:b], cut[:-1], cut[1:])
            lines[i] = 1 - len(np.unique(whole)) / len(whole)
    out = np.column_stack(
        [
            np.log1p(n),
            _per_text(lengths, found.first) / some,
            _per_text(lengths > 12, found.first) / some,
            _per_text(lengths <= 3, found.first) / some,
            kinds["capitals"] / np.maximum(kinds["letters"], 1),
            *(kinds[k] / some for k in ("digits", "exclamations", "bars", "symbols", "stops", "other_marks", "lines", "high_bytes")),
            distinct, top, distinct3, lines,
        ]
    )
    out[n == 0] = 0
    return out


class Model(NamedTuple):
    start: float
    edges: list[np.ndarray]  # bin borders of each feature
    tables: list[np.ndarray]  # a value per bin
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]  # coarser borders, per feature
    pair_tables: list[np.ndarray]


def _borders(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, values[:, j], side="right") for j, e in enumerate(edges)]) if len(edges) else values


def _leaf(g, h):
    return g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A value per bin from gradient and weight per bin: the best cut, again and again, until there are ``leaves``."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            right_g, right_h = g[a:b].sum() - left_g, h[a:b].sum() - left_h
            gain = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(g[a:b].sum(), h[a:b].sum())
            gain[(left_h < LEAST_LEAF / 4) | (right_h < LEAST_LEAF / 4)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (k, a + at + 1))
        if best[1] is None:
            break
        k, cut = best[1]
        a, b = parts[k]
        parts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A value per cell of two features: the best cut of one, then of the other on each side. With its gain."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            value, gain = np.zeros_like(gg), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                side = shallow_tree(gg[rows].sum(axis=0), hh[rows].sum(axis=0), 2)
                value[rows] = side
                gain += (2 * side * gg[rows].sum(axis=0) - side**2 * (hh[rows].sum(axis=0) + RIDGE / len(side))).sum()
            if gain > best[0]:
                best = (gain, value.T if turned else value)
    return best


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(values: np.ndarray, labels: np.ndarray) -> Model:
    """Fit the model; without both labels it gives the labels' mean to every text (0.5 without any)."""
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    start = float(np.log(rate / (1 - rate)))
    edges = [_borders(values[:, j], BINS) for j in range(values.shape[1])]
    coarse = [_borders(values[:, j], PAIR_BINS) for j in range(values.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(start, edges, tables, [], coarse, [])
    if len(np.unique(labels)) < 2:
        return model
    bins, total = _binned(values, edges), np.full(len(labels), start)
    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            p = _sigmoid(total)
            step = RATE * shallow_tree(np.bincount(bins[:, j], labels - p, len(table)), np.bincount(bins[:, j], p * (1 - p), len(table)))
            table += step
            total += step[bins[:, j]]
    cells = _binned(values, coarse)
    p = _sigmoid(total)

    def grid(pair: tuple[int, int], weights: np.ndarray) -> np.ndarray:
        x, y = pair
        width = len(coarse[y]) + 1
        return np.bincount(cells[:, x] * width + cells[:, y], weights, (len(coarse[x]) + 1) * width).reshape(-1, width)

    gains = {pair: pair_tree(grid(pair, labels - p), grid(pair, p * (1 - p)))[0] for pair in combinations(range(values.shape[1]), 2)}
    model.pairs.extend(sorted(gains, key=lambda pair: (-gains[pair], pair))[:PAIRS])
    model.pair_tables.extend(np.zeros((len(coarse[x]) + 1, len(coarse[y]) + 1)) for x, y in model.pairs)
    for _ in range(PAIR_ROUNDS):
        for pair, table in zip(model.pairs, model.pair_tables, strict=True):
            p = _sigmoid(total)
            step = RATE * pair_tree(grid(pair, labels - p), grid(pair, p * (1 - p)))[1]
            table += step
            total += step[cells[:, pair[0]], cells[:, pair[1]]]
    return model


def score(values: np.ndarray, model: Model) -> np.ndarray:
    """Sums of table entries, through the sigmoid."""
    total = np.full(len(values), model.start)
    bins, cells = _binned(values, model.edges), _binned(values, model.pair_edges)
    for j, table in enumerate(model.tables):
        total += table[bins[:, j]]
    for (x, y), table in zip(model.pairs, model.pair_tables, strict=True):
        total += table[cells[:, x], cells[:, y]]
    return _sigmoid(total)


_MEASURED = "doc_id long, " + ", ".join(f"{name} double" for name in FEATURES)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_MEASURED)
    for b in batches:
        for piece in W.slices(b.column("text")):
            values = measure(piece)
            yield batch(schema, [b.column("doc_id").slice(piece.row, len(values)), *values.T])


def fit(labelled: DataFrame, label: str, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """A model of ``labelled`` (``doc_id``, ``text`` and a 0/1 column), from about ``sample_texts`` whole texts.

    The sample is drawn by a hash of ``doc_id``, so reruns agree; rows without a label are left out. The
    driver receives the sample's features, never its texts.
    """
    labelled = labelled.where(F.col(label).isNotNull())
    n = labelled.agg(F.count(F.lit(1))).first()[0]
    share = min(1.0, sample_texts / n) if n else 0.0
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = labelled.where(chosen).select(F.col(label).cast("long").alias("doc_id"), "text")
    rows = sample.mapInArrow(_measure, _MEASURED).toPandas().sort_values(list(FEATURES)).to_numpy(np.float64)
    return train(rows[:, 1:], rows[:, 0])


def _score(shared, threshold: float):
    schema = arrow_schema("doc_id long, held string, score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in W.slices(b.column("text")):
                scores = score(measure(piece), shared.value)
                part = [b.column(c).slice(piece.row, len(scores)) for c in ("doc_id", "held")]
                yield batch(schema, [*part, scores, (scores >= threshold).astype(np.int32)])

    return run


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD, carry: Column | None = None) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every whole text, and ``held``: what ``carry`` says of its row.

    NULL, empty and blank texts have all features zero and the score that gives. One row per input row,
    repeats and NULL ``doc_id`` included; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = (F.lit(None) if carry is None else carry).cast("string").alias("held")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held)
    return rows.mapInArrow(_score(shared, threshold), "doc_id long, held string, score double, predicted int")
