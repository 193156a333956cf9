"""MinHash near-duplicates by a multi-index Hamming join, links confirmed on whole shingle sets.

A text's b-bit signature has ``SYMBOLS`` minimum hashes of 16 bits, cut into chunks of ``WIDTH``
symbols. Two signatures that differ in at most ``2 * chunks - 1`` symbols have, by the pigeonhole
principle, a chunk with at most one differing symbol. So each chunk is indexed under every choice of
one symbol left out, and all pairs within that distance meet under a common key. Pairs at the
similarity limit differ in a quarter of the symbols on average, half of that distance.

Texts with equal sets are one class. Under a key, each class is first compared with the key's
smallest class only. The pairs within the radius make groups, the confirmed ones components; large
groups of near copies come together here. What is left are pairs of different components: those in
one group are compared by their whole sets, block by block, and those in different groups are found
under the keys once more. What a group or key holds is dealt over pairs of blocks, so no task needs
it whole, and only links leave a task.

Links are confirmed by the shingle sets of both whole texts, which travel compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import words as W
from attestor.llm.frames import HEAVY, arrow_schema, batch, group_slices, parts, spread_join, stored, whole_groups, written
from attestor.llm.graph import components

SHINGLE = 5
PERCENT = 75
SYMBOLS = 64
WIDTH = 4
CHUNKS = SYMBOLS // WIDTH
#: The signature distance up to which the key join finds every pair.
RADIUS = 2 * CHUNKS - 1
#: Signatures of one block of a key's members.
KEY_BLOCK = 4096
#: Members of one block of a key's members.
BLOCK = 512
#: Packed bytes of one block of texts, where those make more blocks.
BLOCK_BYTES = 4 << 20
#: Shingles of one matrix product.
MATRIX_COLUMNS = 4096

_FACTORS = W.constants(5, SYMBOLS)
_U = np.uint64


def shingle_sets(piece: W.Slice, size: int = SHINGLE) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles; a shorter text is one shingle as a whole."""
    found = W.words(piece, lower=True)
    runs = W.grams(found.hashes, size)
    sets = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            sets.append(W.mix(W.long_gram(found.hashes[a:b], np.array([0]), np.array([b - a])) + _U(b - a)))
        else:
            sets.append(runs[:0])
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    if len(shingles) < 400:
        low = (shingles[:, None] * _FACTORS).min(axis=0)
    else:
        low = np.fromiter(((shingles * a).min() for a in _FACTORS), _U, SYMBOLS)
    return (W.mix(low) >> _U(48)).astype(np.uint16)


_ENTRY = "key long, node long, slot int"
_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, sig binary"


def _sign(size: int):
    schema = arrow_schema(_SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in W.slices(b.column("text")):
                sets = shingle_sets(piece, size)
                n = np.array([len(s) for s in sets], np.int64)
                set_a = np.array([s.sum() if len(s) else 0 for s in sets], _U)
                set_b = np.array([np.bitwise_xor.reduce(W.mix(s)) if len(s) else 0 for s in sets], _U)
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                yield batch(schema, [b.column("doc_id").slice(piece.row, len(sets)), n, set_a, set_b, sig])

    return run


def signed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, set size, a 128-bit digest of the set, and the signature of each whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign(size), _SIGNED)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("doc_id long, body binary")
    press = zstandard.ZstdCompressor(level=5)
    for b in batches:
        for piece in W.slices(b.column("text")):
            bounds = piece.offsets.tolist()
            bodies = [press.compress(piece.data[x:y].tobytes()) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield batch(schema, [b.column("doc_id").slice(piece.row, len(bodies)), bodies])


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Per signature its index keys: each chunk, with each one of its symbols left out."""
    chunks = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(_U)
    out = np.empty((len(signatures), CHUNKS, WIDTH), _U)
    for left_out in range(WIDTH):
        kept = [j for j in range(WIDTH) if j != left_out]
        value = chunks[:, :, kept[0]]
        for j in kept[1:]:
            value = value << _U(16) | chunks[:, :, j]
        out[:, :, left_out] = value << _U(6) | (np.arange(CHUNKS, dtype=_U) * _U(WIDTH) + _U(left_out))
    return W.mix(out.reshape(len(signatures), -1))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_ENTRY)
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            keys = chunk_keys(_signatures(part.column("sig")))
            slots = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
            yield batch(schema, [keys.reshape(-1), np.repeat(part.column("node").to_numpy(), keys.shape[1]), slots])


def index(classes: DataFrame) -> DataFrame:
    """``key, node, slot``: the keys under which a signature is found, numbered by chunk and symbol left out."""
    return classes.select("node", "sig").mapInArrow(_index, _ENTRY)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("a long, b long")
    for b in batches:
        near = distances(_signatures(b.column("sig_a")), _signatures(b.column("sig_b"))) <= RADIUS
        yield batch(schema, [b.column(c).filter(pa.array(near)) for c in ("a", "b")])


def with_both(pairs: DataFrame, table: DataFrame, column: str, heavy: int = HEAVY) -> DataFrame:
    """Pairs ``a, b`` with a column of both nodes. ``table`` is dealt by node already, so only pairs move.

    The centre ``a`` of a large group is in many pairs. Those of one ``a`` beyond ``heavy`` are dealt by hash over
    several tasks, and the few rows of such centres go to each.
    """
    pairs = written(pairs)
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy)
    centres = stored(counts.select("a", F.ceil(F.col("n") / heavy).cast("int").alias("deals")), "centres")
    left = table.select(F.col("node").alias("a"), F.col(column).alias(f"{column}_a"))
    right = table.select(F.col("node").alias("b"), F.col(column).alias(f"{column}_b"))
    few = pairs.join(centres, "a", "left_anti").join(right, "b").join(left, "a")
    many = pairs.join(centres, "a").withColumn("deal", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int")).drop("deals").join(right, "b")
    lines = left.join(centres, "a").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    out = ["a", "b", f"{column}_a", f"{column}_b"]
    return few.select(*out).unionByName(many.join(lines, ["a", "deal"]).select(*out))


def within_radius(pairs: DataFrame, classes: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The pairs ``a, b`` whose signatures are within the radius."""
    return with_both(pairs, classes, "sig", heavy).mapInArrow(_near, "a long, b long")


def _unpacked(body: bytes, size: int) -> np.ndarray:
    """The shingle set of a packed text."""
    text = zstandard.ZstdDecompressor().decompress(body)
    return shingle_sets(W.Slice(0, np.frombuffer(text, np.uint8), np.array([0, len(text)])), size)[0]


def _confirm(size: int, percent: int):
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, np.zeros(0, _U)
        for batch_ in batches:
            yes = []
            for a, left, right in zip(batch_.column("a").to_pylist(), batch_.column("body_a"), batch_.column("body_b"), strict=True):
                if a != held:
                    held, of = a, _unpacked(left.as_py(), size)
                other = _unpacked(right.as_py(), size)
                both = len(np.intersect1d(of, other, assume_unique=True))
                yes.append(100 * both >= percent * (len(of) + len(other) - both))
            yield batch(schema, [batch_.column(c).filter(pa.array(yes, pa.bool_())) for c in ("a", "b")])

    return run


def confirm(pairs: DataFrame, bodies: DataFrame, size: int = SHINGLE, percent: int = PERCENT, heavy: int = HEAVY) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""
    return with_both(pairs, bodies, "body", heavy).mapInArrow(_confirm(size, percent), "a long, b long")


def first_slots(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The lowest slot whose key a signature shares with each of the others; a pair is taken only there."""
    same = (others == one).reshape(len(others), CHUNKS, WIDTH)
    agree = same.sum(axis=2)
    chunk = (agree >= WIDTH - 1).argmax(axis=1)
    rows = np.arange(len(others))
    left_out = np.where(agree[rows, chunk] == WIDTH, 0, (~same[rows, chunk]).argmax(axis=1))
    return chunk * WIDTH + left_out


def _cells(t: pa.Table, key: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each (key, low, high) in sorted order: first row, and the rows of its two blocks."""
    block, low, high = (t.column(c).to_numpy() for c in ("block", "low", "high"))
    bounds = group_slices([t.column(key).to_numpy(), low, high])
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if low[x] == high[x]:
            rows = others = np.arange(x, y)
        else:
            rows, others = x + np.flatnonzero(block[x:y] == low[x]), x + np.flatnonzero(block[x:y] == high[x])
        yield x, rows, others


def _dealt(members: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """Members of each key dealt over pairs of blocks; every two members meet in exactly one."""
    members = members.join(blocks, key).withColumn("block", F.pmod(F.hash("node", F.lit(3)), F.col("blocks")))
    rows = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    return rows.repartition(parts(rows), key, "low", "high").sortWithinPartitions(key, "low", "high")


def _within_groups(size: int, percent: int):
    """Confirmed links between components of one group, from the whole texts of two blocks of it.

    All shingle sets of the two blocks are compared at once, as products of 0/1 matrices over the
    shingles that occur twice. Of a text's links with one component, one is given.
    """
    schema = arrow_schema("a long, b long")

    def links(sets: list, component: np.ndarray, rows: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, int]]:
        order = rows if rows is others else np.concatenate((rows, others))
        lengths = np.array([len(sets[i]) for i in order])
        shingle, number, met = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(order)), lengths)
        common = np.flatnonzero(met > 1)
        place = np.full(len(shingle), -1)
        place[common] = np.arange(len(common))
        column = place[number]
        shared = np.zeros((len(rows), len(others)), np.float32)
        for at in range(0, len(common), MATRIX_COLUMNS):
            here = (column >= at) & (column < at + MATRIX_COLUMNS)
            matrix = np.zeros((len(order), min(MATRIX_COLUMNS, len(common) - at)), np.float32)
            matrix[of[here], column[here] - at] = 1
            left = matrix[: len(rows)]
            shared += left @ (left if rows is others else matrix[len(rows) :]).T
        n_rows, n_others = lengths[: len(rows), None], (lengths if rows is others else lengths[len(rows) :])[None, :]
        linked = 100 * shared >= percent * (n_rows + n_others - shared)
        linked &= component[rows][:, None] != component[others][None, :]
        for i in np.flatnonzero(linked.any(axis=1)).tolist():
            hits = others[linked[i]]
            for j in hits[np.unique(component[hits], return_index=True)[1]].tolist():
                yield int(rows[i]), j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["grp", "low", "high"]):
            t = t.combine_chunks()
            node, component = t.column("node").to_numpy(), t.column("component").to_numpy()
            sets = [_unpacked(body.as_py(), size) for body in t.column("body")]
            found = [(node[i], node[j]) for _, rows, others in _cells(t, "grp") if len(rows) and len(others) for i, j in links(sets, component, rows, others)]
            if found:
                pairs = np.array(found, np.int64)
                yield batch(schema, [pairs.min(axis=1), pairs.max(axis=1)])

    return run


def linked_within(groups: DataFrame, labels: DataFrame, bodies: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """Confirmed links between different components of a group (``node``, ``component`` is the group's name)."""
    named = groups.select("node", F.col("component").alias("grp")).join(labels, "node", "left")
    named = named.select("node", "grp", F.coalesce("component", "node").alias("component")).join(bodies, "node")
    sizes = named.groupBy("grp").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("bytes")
    )
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = _dealt(named, "grp", sizes.where("x < y").select("grp", blocks.alias("blocks")))
    return dealt.select("grp", "node", "component", "body", "block", "low", "high").mapInArrow(_within_groups(size, percent), "a long, b long")


def _between_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one key within the radius whose groups and components differ, each pair under its first key."""
    schema = arrow_schema("a long, b long")
    for t in whole_groups(batches, ["key", "low", "high"]):
        t = t.combine_chunks()
        node, component, group, slot = (t.column(c).to_numpy() for c in ("node", "component", "grp", "slot"))
        sigs = _signatures(t.column("sig"))
        found: list[tuple[int, int]] = []
        for x, rows, others in _cells(t, "key"):
            for i in rows.tolist():
                near = others[(group[others] != group[i]) & (component[others] != component[i])]
                if rows is others:
                    near = near[near > i]
                near = near[distances(sigs[near], sigs[i]) <= RADIUS]
                if len(near):
                    near = near[first_slots(sigs[i], sigs[near]) == slot[x]]
                found += [(node[i], node[j]) for j in near.tolist()]
        if found:
            pairs = np.array(found, np.int64)
            yield batch(schema, [pairs.min(axis=1), pairs.max(axis=1)])


def met_between(shared: DataFrame, classes: DataFrame, groups: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Pairs within the radius that share a key but neither group nor component."""
    of = groups.select("node", F.col("component").alias("grp"))
    named = shared.join(of, "node", "left").join(labels, "node", "left")
    named = named.select("key", "slot", "node", F.coalesce("grp", "node").alias("grp"), F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("key").agg(
        F.min("grp").alias("x"), F.max("grp").alias("y"), F.min("component").alias("v"), F.max("component").alias("w"), F.count(F.lit(1)).alias("n")
    )
    mixed = mixed.where("x < y and v < w").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = _dealt(named.join(classes, "node"), "key", mixed)
    return dealt.select("key", "slot", "node", "grp", "component", "sig", "block", "low", "high").mapInArrow(_between_groups, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, key_block: int = KEY_BLOCK, heavy: int = HEAVY
) -> DataFrame:
    """Near-duplicate components of ``docs`` (``doc_id``, ``text``), one row per row of the input.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (the smallest ``doc_id`` reachable by links)
    and ``kept`` (true on that document). Texts are linked when ``100 * shared >= percent * united``
    of their distinct ``size``-word shingles, A-Z lower-cased. NULL, empty and blank texts have no
    shingles and are linked with nothing. Rows with one ``doc_id`` are one document. A row without
    ``doc_id`` is linked with nothing: ``component_id`` NULL, ``kept`` true. Other columns are ignored;
    an empty table gives an empty result.
    """
    marks = written(signed(docs, size))
    linkable = marks.where("n_shingles > 0 and doc_id is not null")
    ids = linkable.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = written(ids)
    n = parts(docs)
    classes = linkable.join(nodes.select("node").distinct(), F.col("doc_id") == F.col("node")).select("node", "sig", "set_a", "set_b")
    classes = written(classes.dropDuplicates(["node", "set_a", "set_b"]).select("node", "sig").repartition(n, "node"))
    entries = index(classes)
    lowest = entries.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top").select("key", "a")
    shared = written(entries.join(lowest, "key").select("key", "node", "slot", "a"))
    stars = shared.where("node > a").select("a", F.col("node").alias("b")).distinct()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(_pack, "doc_id long, body binary")
    met = shared.select(F.col("node").alias("doc_id")).distinct().repartition(n, "doc_id")
    bodies = written(texts.repartition(n, "doc_id").join(met, "doc_id", "left_semi").withColumnRenamed("doc_id", "node"))

    near = written(within_radius(stars, classes, heavy))
    labels = components(confirm(near, bodies, size, percent, heavy))
    groups = components(near)
    inside = linked_within(groups, labels, bodies, size, percent, block)
    across = confirm(met_between(shared.drop("a"), classes, groups, labels, key_block), bodies, size, percent, heavy)
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = components(known.unionByName(inside).unionByName(across))

    # Texts without shingles or id stand alone; those of one set, or of one node, are dealt over tasks where they are many.
    digest = ["set_a", "set_b", "n_shingles"]
    own = marks.select("doc_id", *digest).withColumn("linkable", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    found = spread_join(own.where("linkable"), nodes, digest, "copies", ["doc_id"], "left", heavy)
    sizes = nodes.groupBy("node").agg(F.sum("copies").alias("copies")).join(labels, "node")
    found = spread_join(found, sizes, ["node"], "copies", ["doc_id"], "left", heavy)
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    found = found.unionByName(own.where("not linkable").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, of the document that stays of each component; rows without id stay."""
    stays = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("id_")).distinct()
    return docs.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col("id_")), "left_semi")
