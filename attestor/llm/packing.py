"""Token ids packed into rows of a fixed length by best-fit decreasing, as binary matrices.

A task packs its documents shard by shard, as they come from the scan, so nothing is shuffled and
memory follows ``SHARD_TOKENS`` and the longest document. Documents longer than a row are split into
pieces without losing a token. Pieces are placed longest first, each into the row with the least
room that still takes it; a segment tree over the possible amounts of room finds that row.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.bpe import _pieces

ROW_TOKENS = 2048
SHARD_TOKENS = 1 << 20


class RoomTree:
    """A segment tree over amounts of room: which amounts have a row, and the smallest that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the row with the least room of at least ``least``, and that room."""
        node = self.leaves + least
        counts = self.counts
        if not counts[node]:
            # Up to the first ancestor whose right neighbour holds a row, then down its left edge.
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not counts[node]:
                    node += 1
        room = node - self.leaves
        row = self.rows[room].pop()
        while node:
            counts[node] -= 1
            node >>= 1
        return room, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers: longest pieces first, ties in the given order."""
    tree, rows = RoomTree(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[piece])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > sizes[piece]:
            tree.add(room - sizes[piece], row)
    return rows


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_PACKED = pa.schema(
    [
        ("shard", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary()),
    ]
)
_PACKED_DDL = "shard bigint, row int, n_tokens int, doc_ids array<bigint>, parts array<int>, ends array<int>, ids binary, positions binary"


def pack_shard(shard: int, ids: list, parts: list[int], pieces: list[np.ndarray], length: int) -> pa.RecordBatch:
    out: list[list] = [[] for _ in _PACKED]
    for number, row in enumerate(best_fit([len(p) for p in pieces], length)):
        tokens, positions = np.zeros(length, "<u4"), np.zeros(length, "<u4")
        ends, at = [0], 0
        for i in row:
            tokens[at : at + len(pieces[i])] = pieces[i]
            positions[at : at + len(pieces[i])] = np.arange(len(pieces[i]))
            at += len(pieces[i])
            ends.append(at)
        values = (shard, number, at, [ids[i] for i in row], [parts[i] for i in row], ends, tokens.tobytes(), positions.tobytes())
        for column, value in zip(out, values, strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PACKED, strict=True)], schema=_PACKED)


def _pack(path: str, pattern: str, length: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(path, pattern)
        shard = TaskContext.get().partitionId() << 32
        ids, parts, pieces, size = [], [], [], 0
        for b in batches:
            for row, texts in _pieces(b.column("text")):
                for doc_id, text in zip(b.column("doc_id").slice(row, len(texts)).to_pylist(), texts, strict=True):
                    tokens = np.array(encode(text), "<u4")
                    for part, at in enumerate(range(0, len(tokens), length)):
                        ids.append(doc_id)
                        parts.append(part)
                        pieces.append(tokens[at : at + length])
                    size += len(tokens)
                    if size >= shard_tokens:
                        yield pack_shard(shard, ids, parts, pieces, length)
                        shard += 1
                        ids, parts, pieces, size = [], [], [], 0
        if pieces:
            yield pack_shard(shard, ids, parts, pieces, length)

    return run


def pack(docs: DataFrame, path: str, pattern: str, *, length: int = ROW_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every whole text's token ids, packed: one row per row of a shard's matrix.

    ``ids`` and ``positions`` are ``length`` little-endian unsigned 32-bit numbers: token ids, zero from
    ``n_tokens`` on, and places that begin anew with every segment. ``ends`` are the cumulative segment
    lengths, from 0; ``doc_ids`` and ``parts`` say which piece of which document a segment is. Texts without tokens
    (NULL, empty) take no room. Repeated rows and NULL ids are packed like others; other columns are
    ignored; an empty table gives an empty result. ``path`` names the rank file, at the same place on
    every executor, and ``pattern`` the splitting pattern that goes with it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(path, pattern, length, shard_tokens), _PACKED_DDL)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])
    for b in batches:
        out: list[list] = [[], [], []]
        for doc_ids, parts, ends, ids in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "parts", "ends", "ids")), strict=True):
            for doc_id, part, x, y in zip(doc_ids, parts, ends[:-1], ends[1:], strict=True):
                for column, value in zip(out, (doc_id, part, ids[4 * x : 4 * y]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def unpack(packed: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` and ``ids`` of every packed piece."""
    return packed.select("doc_ids", "parts", "ends", "ids").mapInArrow(_unpack, "doc_id long, part int, ids binary")
