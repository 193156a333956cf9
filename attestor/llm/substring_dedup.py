"""Repeated word windows, gathered in paths around anchors.

Taken as a graph, every run of ``window`` words is an edge; what would be its nodes, runs of one word less, are never
rows here, as anchors take their place. Consecutive edges of a text that
share their anchor (the ``ANCHOR``-word run with the smallest hash inside the window, at the same place)
form a path: equal windows have equal anchors, so a repeated window is always found under the node of
its anchor. Only paths are shuffled, one row for some fourteen windows:

* a node met once has nothing repeated;
* a node that all its paths pass with the same words does not branch: every window of it is repeated;
* where paths branch, equal paths are reduced to one, and its source coordinates bring back the
  words, whose windows are then compared one by one under their node.

A path or window is known by a hash of its words next to that of its anchor. The two are built on independent
hashes of the words, so different words would have to agree in 128 bits to be confused. A row is named by a hash of its ``doc_id`` and all its words,
and a ``spot`` holds, in one number, a second such hash, the place of a window and how many follow it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import words as W
from attestor.llm.frames import HEAVY, arrow_schema, batch, group_slices, parts, spread_join, stored, whole_groups

WINDOW = 35
ANCHOR = 6

#: Paths of one node that a task compares by itself: some two megabytes of windows.
MANY_PATHS = 4096

_U = np.uint64
_EDGES = "node long, path long, name long, spot long"
_TEXTS = "doc_id long, name long, body binary"
#: A spot: 25 bits of the row's second hash, 32 of the word place, 6 of the number of windows.
_COUNT_BITS, _PLACE_BITS, _CHECK_BITS = 6, 32, 25
#: In place of the number: a single window of a path that occurs more than once.
_WITNESS = (1 << _COUNT_BITS) - 1


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its first smallest."""
    at = np.arange(len(values))
    size = 1

    def join(by: int) -> None:
        nonlocal values, at
        left = values[:-by] <= values[by:]
        values, at = np.where(left, values[:-by], values[by:]), np.where(left, at[:-by], at[by:])

    while size * 2 <= width:
        join(size)
        size *= 2
    if size < width:
        join(width - size)
    return at


def names(found: W.Words, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's id and words, so that copies of a text lie apart, and the check bits of a second one."""
    with np.errstate(over="ignore"):
        own = W.mix(ids.fill_null(0).to_numpy().astype(np.int64).view(_U) + _U(1))
        whole = W.whole_texts(found.hashes, found.first)
        return W.mix(whole + own), W.mix(whole ^ (own * _U(3))) >> _U(64 - _CHECK_BITS)


def spots(check: np.ndarray, place: np.ndarray, n) -> np.ndarray:
    return (check.astype(np.int64) << (_PLACE_BITS + _COUNT_BITS)) | (place.astype(np.int64) << _COUNT_BITS) | np.asarray(n, np.int64)


def read_spots(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check bits, word places and numbers of windows."""
    return spot >> (_PLACE_BITS + _COUNT_BITS), (spot >> _COUNT_BITS) & ((1 << _PLACE_BITS) - 1), spot & _WITNESS


def paths(found: W.Words, window: int = WINDOW):
    """Per path: its text, anchor hash, first window (word place in the slice) and number of windows."""
    total, lengths = len(found.hashes), np.diff(found.first)
    none = np.zeros(0, np.int64)
    if not len(lengths) or lengths.max() < window:
        return none, np.zeros(0, _U), none, none
    anchor = max(min(ANCHOR, window), window - _WITNESS + 2)
    grams = W.grams(found.hashes, anchor)
    at = sliding_argmin(grams, window - anchor + 1)  # fewer places than the witness number
    edge = np.zeros(total + 1, np.int64)
    long = np.flatnonzero(lengths >= window)
    np.add.at(edge, found.first[long], 1)
    np.add.at(edge, found.first[long] + lengths[long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]))
    at = at[starts]
    # A path has at most as many windows as places for its anchor in one. An anchor lies in one text, so a new text is a new anchor.
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n = np.diff(np.append(begin, len(starts)))
    first = starts[begin]
    return np.searchsorted(found.first, first, side="right") - 1, grams[at[begin]], first, n


def _edges(window: int):
    schema = arrow_schema(_EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in W.slices(b.column("text")):
                found = W.words(piece, second=True)
                text, node, first, n = paths(found, window)
                if len(text):
                    path = W.long_gram(found.second, first, first + n + window - 1)
                    name, check = names(found, b.column("doc_id").slice(piece.row, len(piece.offsets) - 1))
                    yield batch(schema, [node, path, name[text], spots(check[text], first - found.first[text], n)])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_TEXTS)
    press = zstandard.ZstdCompressor(level=5)
    for b in batches:
        for piece in W.slices(b.column("text")):
            bounds = piece.offsets.tolist()
            bodies = [press.compress(piece.data[x:y].tobytes()) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            ids = b.column("doc_id").slice(piece.row, len(bodies))
            yield batch(schema, [ids, names(W.words(piece), ids)[0], bodies])


def _unpacked(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body) if body else b""


def _words(ids: pa.Array, row: int, text: bytes) -> tuple[np.ndarray, int]:
    """Second word hashes of one text and its check bits."""
    found = W.words(W.Slice(0, np.frombuffer(text, np.uint8), np.array([0, len(text)])), second=True)
    return found.second, int(names(found, ids.slice(row, 1))[1][0])


_BUNDLES = "node long, name long, spot long, edges binary"


def _bundles(window: int, one_by_one: bool):
    """The windows of the paths asked for, from their texts: a bundle per path, or a row per window.

    A path that occurs again carries the witness number in its spot.
    """
    schema = arrow_schema(_EDGES if one_by_one else _BUNDLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                hashes, check = _words(b.column("doc_id"), row, _unpacked(b.column("body")[row].as_py()))
                asked = b.column("asked")[row].values
                node, spot, again = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("node", "spot", "again"))
                checks, first, n = read_spots(spot)
                mine = checks == check
                node, first, n, again = node[mine], first[mine], n[mine], again[mine]
                starts = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                edge = W.long_gram(hashes, starts, starts + window)
                name = b.column("name")[row].as_py()
                if one_by_one:
                    mark = spots(np.full(len(starts), check), starts, np.where(np.repeat(again, n), _WITNESS, 1))
                    yield batch(schema, [np.repeat(node, n), edge, np.full(len(starts), name, np.int64), mark])
                else:
                    mark = spots(np.full(len(first), check), first, np.where(again, _WITNESS, n))
                    bundles = [x.tobytes() for x in np.split(edge, np.cumsum(n)[:-1])] if len(n) else []
                    yield batch(schema, [node, np.full(len(first), name, np.int64), mark, bundles])

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that another path of the same node has too, from bundles in order of their nodes."""
    schema = arrow_schema("name long, spot long")
    for t in whole_groups(batches, ["node"]):
        t = t.combine_chunks()
        bundles = t.column("edges").to_pylist()
        n = np.array([len(x) // 8 for x in bundles], np.int64)
        edge = np.frombuffer(b"".join(bundles), np.int64)
        node = np.repeat(t.column("node").to_numpy(), n)
        check, place, mark = read_spots(t.column("spot").to_numpy())
        order = np.lexsort((edge, node))
        bounds = group_slices([node[order], edge[order]])
        weight = np.repeat(np.where(mark == _WITNESS, 2, 1), n)[order]
        met = np.empty(len(edge), bool)
        met[order] = np.repeat(np.add.reduceat(weight, bounds[:-1]) > 1, np.diff(bounds)) if len(edge) else False
        row = np.repeat(np.arange(len(n)), n)
        met &= mark[row] != _WITNESS  # those are known to be repeated
        at = np.flatnonzero(met)
        if not len(at):
            continue
        new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(row[at]) != 0)))
        begin, length = at[new], np.diff(np.append(np.flatnonzero(new), len(at)))
        rows = row[begin]
        inside = begin - (np.cumsum(n) - n)[rows]
        yield batch(schema, [t.column("name").to_numpy()[rows], spots(check[rows], place[rows] + inside, length)])


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for row in range(b.num_rows):
                text = _unpacked(b.column("body")[row].as_py())
                words = text.split()
                spans = b.column("spans")[row].values
                covered = np.zeros(len(words) + 1, np.int64)
                if spans is not None and len(spans):
                    check, place, n = read_spots(spans.to_numpy(zero_copy_only=False))
                    mine = check == _words(b.column("doc_id"), row, text)[1]
                    place, n = place[mine], n[mine]
                    np.add.at(covered, place, 1)
                    np.add.at(covered, place + n + window - 1, -1)
                stay = np.cumsum(covered[:-1]) == 0
                n_words.append(len(words))
                n_removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join(compress(words, stay.tolist())).decode())
                if len(kept) >= 512:
                    yield batch(schema, [b.column("doc_id").slice(row + 1 - len(kept), len(kept)), n_words, n_removed, kept])
                    n_words, n_removed, kept = [], [], []
            if kept:
                yield batch(schema, [b.column("doc_id").slice(b.num_rows - len(kept), len(kept)), n_words, n_removed, kept])

    return run


def repeated_spots(docs: DataFrame, texts: DataFrame, window: int = WINDOW, many: int = MANY_PATHS, heavy: int = HEAVY) -> DataFrame:
    """``name, spot`` of all windows that start elsewhere too. What one node or path has beyond ``heavy`` is dealt over tasks."""
    n = parts(docs)
    edges = docs.mapInArrow(_edges(window), _EDGES)
    nodes = edges.groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.min("path").alias("x"), F.max("path").alias("y")).where("met > 1")
    nodes = stored(nodes.select("node", "met", (F.col("x") != F.col("y")).alias("branches")), "nodes")
    edges = stored(spread_join(edges, nodes, ["node"], "met", ["name", "spot"], heavy=heavy), "edges")

    branching = edges.where("branches").drop("branches")
    by_path = branching.groupBy("node", "path").agg(F.count(F.lit(1)).alias("times"), F.min("name").alias("name"), F.min_by("spot", "name").alias("spot"))
    by_path = stored(by_path, "paths")
    again = spread_join(branching, by_path.where("times > 1").select("node", "path", "times"), ["node", "path"], "times", ["name", "spot"], heavy=heavy)

    crowds = by_path.groupBy("node").agg(F.count(F.lit(1)).alias("paths"))
    known = spread_join(by_path, crowds.withColumn("n", F.col("paths")), ["node"], "n", ["path"], heavy=heavy).select("name", "paths", F.struct("node", "spot", (F.col("times") > 1).alias("again")).alias("step"))

    def sources(condition: str) -> DataFrame:
        asked = known.where(condition).groupBy("name").agg(F.collect_list("step").alias("asked"))
        return texts.join(asked, "name").select("doc_id", "name", "body", "asked")

    bundles = sources(f"paths <= {many}").mapInArrow(_bundles(window, False), _BUNDLES)
    few = bundles.repartition(n, "node").sortWithinPartitions("node").mapInArrow(_common, "name long, spot long")
    # The windows of a crowded node are counted one by one, so that no task needs the node whole.
    crowded = sources(f"paths > {many}").mapInArrow(_bundles(window, True), _EDGES)
    witness = F.col("spot").bitwiseAND(_WITNESS) == _WITNESS
    common = crowded.groupBy("node", "path").agg(F.count(F.lit(1)).alias("met"), F.max(witness).alias("again")).where("met > 1 or again")
    common = stored(common.select("node", "path", "met"), "common")
    single = spread_join(crowded.where(~witness), common, ["node", "path"], "met", ["name", "spot"], heavy=heavy)
    row = ["name", "spot"]
    return edges.where(~F.col("branches")).select(*row).unionByName(again.select(*row)).unionByName(few).unionByName(single.select(*row))


def without_repeats(docs: DataFrame, window: int = WINDOW, many: int = MANY_PATHS, heavy: int = HEAVY) -> DataFrame:
    """Every text of ``docs`` (``doc_id``, ``text``) without the words of windows that occur elsewhere.

    Returns ``doc_id``, ``n_words``, ``n_removed`` and ``kept``: the words that stay, joined by one space. A
    window is ``window`` consecutive words, runs of bytes other than ASCII white space, unchanged; it
    counts as repeated if the same words start at any other place, in the same text too. Windows are
    judged on the whole input. NULL, empty and blank texts have no words; texts with fewer words keep
    them all. One row per input row; of repeated rows each loses what they share. Other columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The filter drops nothing; with it all uses of the texts have one plan and share one shuffle.
    texts = docs.mapInArrow(_pack, _TEXTS).where("name is not null").repartition(parts(docs), "name")
    by_text = repeated_spots(docs, texts, window, many, heavy).groupBy("name").agg(F.collect_list("spot").alias("spans"))
    rows = texts.join(by_text, "name", "left").select("doc_id", "body", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"))
    return rows.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept string")
