"""Media columns: payloads as 8-bit grey images in archives, and a data source that reads them back.

``write_archives`` stores each payload as a PNG of 64 samples a row inside ZIP archives of a bounded
size. ``MediaArchives`` is a Spark data source for such folders: it plans byte ranges of each archive,
a task reads the archive's directory, takes the members whose headers begin in its range, fetches
neighbouring members in one read and streams them as Arrow batches. A member that arrives damaged or
not at all is fetched again by its own offset, so one bad read does not repeat the others.

Folders are named by URI, so any store that Arrow's filesystems reach will do. A path without scheme is taken
to be in the store that Spark takes it to be in. What has been written is noted beside the archives; a reader that
finds another number of archives or bytes (each machine's own disk, say) stops with an error.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from attestor.llm.frames import arrow_schema, batch, written

#: An archive is closed when it holds this many bytes of members.
ARCHIVE_BYTES = 32 << 20
#: A partition of the data source.
SPLIT_BYTES = 8 << 20
#: Neighbouring members are read together up to this size, and sent on in batches of it.
READ_BYTES = 1 << 20
TRIES = 4
ROW = 64
#: What was written in a folder: numbers of archives, members and bytes.
_NOTE = "_written.json"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LOCAL = struct.Struct("<4s5H3I2H")


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a URI (or local path), and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark's own readers and writers understand it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def padded(payload: bytes) -> bytes:
    """The payload with zero bytes up to a positive multiple of 64."""
    return payload + bytes(max(ROW, -(-len(payload) // ROW) * ROW) - len(payload))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey PNG, 64 samples wide; the same samples always give the same bytes."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each row begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, rows = 8, [], 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (ROW, 8, 0):
                raise ValueError("not an 8-bit grey image of 64 columns")
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def _write(folder: str, archive_bytes: int):
    schema = arrow_schema("archive string, members long, bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = store(folder)
        task, number = TaskContext.get().partitionId(), 0
        held, archive = io.BytesIO(), None

        def close() -> pa.RecordBatch:
            nonlocal held, archive, number
            members = len(archive.infolist())
            archive.close()
            # Written under a name of its own, then renamed: a lost or repeated attempt leaves no half archive.
            name = f"{base}/media-{task:07d}-{number:05d}.zip"
            own = f"{base}/_writing-{uuid.uuid4().hex}"
            with target.open_output_stream(own, compression=None) as out:
                out.write(held.getbuffer())
            target.move(own, name)
            number += 1
            done = batch(schema, [[name], [members], [held.tell()]])
            held, archive = io.BytesIO(), None
            return done

        row = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                payload = (text.as_py() or "").encode()
                if archive is None:
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                name = f"{row}.{'' if doc_id is None else doc_id}.{len(payload)}.png"
                archive.writestr(zipfile.ZipInfo(name), to_png(padded(payload)))
                row += 1
                if held.tell() >= archive_bytes:
                    yield close()
        if archive is not None:
            yield close()

    return run


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Store every whole text of ``docs`` (``doc_id``, ``text``) below ``folder``; gives the archives written.

    NULL counts as the empty text. Member names hold the row's number in its task, ``doc_id`` (blank if
    NULL) and the unpadded size. A task holds one archive in memory.
    """
    folder = qualified(docs.sparkSession, folder)
    target, base = store(folder)
    target.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = written(rows.mapInArrow(_write(folder, archive_bytes), "archive string, members long, bytes long"))
    total = done.agg(F.count(F.lit(1)).alias("archives"), F.coalesce(F.sum("members"), F.lit(0)).alias("members"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    with target.open_output_stream(f"{base}/{_NOTE}", compression=None) as out:
        out.write(json.dumps(total.first().asDict()).encode())
    return done


class ByteRange(InputPartition):
    """Members of one archive whose headers begin in ``[start, end)``."""

    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaReader(DataSourceReader):
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("position", pa.int64()), ("media", pa.binary())])

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[ByteRange]:
        target, base = store(self.folder)
        found = target.get_file_info(fs.FileSelector(base, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.path.endswith(".zip"))
        if any(f.path.endswith(f"/{_NOTE}") for f in found):
            with target.open_input_stream(f"{base}/{_NOTE}") as source:
                note = json.loads(source.read())
            if (len(files), sum(size for _, size in files)) != (note["archives"], note["bytes"]):
                raise OSError(f"{self.folder} has {len(files)} archives, not the {note['archives']} written with {note['bytes']} bytes: can all machines reach it?")
        return [ByteRange(path, at, at + self.split) for path, size in files for at in range(0, size, self.split)]

    def _again(self, source, info: zipfile.ZipInfo) -> bytes:
        """One member by its own offset, tried several times."""
        for attempt in range(self.tries):
            try:
                source.seek(info.header_offset)
                head = _LOCAL.unpack(source.read(_LOCAL.size))
                source.seek(info.header_offset + _LOCAL.size + head[-2] + head[-1])
                media = source.read(info.compress_size)
                if len(media) == info.file_size and zlib.crc32(media) == info.CRC:
                    return media
                problem: Exception = OSError("wrong checksum")
            except (OSError, struct.error) as error:
                problem = error
            time.sleep(0.05 * 2**attempt)
        raise OSError(f"member {info.filename} at {info.header_offset} of {self.folder} cannot be read") from problem

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder plans no range
            return
        target, _ = store(self.folder)
        with target.open_input_file(partition.archive) as source:
            with zipfile.ZipFile(source) as archive:
                directory = sorted(archive.infolist(), key=lambda i: i.header_offset)
            mine = [i for i in directory if partition.start <= i.header_offset < partition.end]
            at = 0
            while at < len(mine):
                begin, to = mine[at].header_offset, at + 1
                # A local header may carry more than the directory says; what falls short is read again.
                size = [len(i.filename.encode()) + _LOCAL.size + i.compress_size for i in mine[at : at + 1]][0]
                while to < len(mine) and mine[to].header_offset + mine[to].compress_size - begin <= READ_BYTES:
                    size = mine[to].header_offset + _LOCAL.size + len(mine[to].filename.encode()) + mine[to].compress_size - begin
                    to += 1
                group = mine[at:to]
                try:
                    source.seek(begin)
                    block = source.read(size)
                except OSError:
                    block = b""
                media = []
                for info in group:
                    place = info.header_offset - begin + _LOCAL.size + len(info.filename.encode())
                    body = block[place : place + info.compress_size]
                    sound = len(body) == info.file_size and zlib.crc32(body) == info.CRC
                    media.append(body if sound else self._again(source, info))
                names, offsets = [i.filename for i in group], [i.header_offset for i in group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.archive] * len(group)), pa.array(names), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], schema=self.schema
                )
                at = to


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``: archive, member, position, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, position bigint, media binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MediaReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("splitBytes", str(split_bytes)).load(qualified(spark, folder))


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def column_hash(samples: bytes) -> str:
    """64 bits in hex: which of the 64 columns have a mean above the image's."""
    sums = np.frombuffer(samples, np.uint8).reshape(-1, ROW).sum(axis=0, dtype=np.int64)
    return np.packbits(sums * ROW > sums.sum()).tobytes().hex()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_FEATURES)
    for b in batches:
        rows = []
        for member, media in zip(b.column("member").to_pylist(), b.column("media"), strict=True):
            media = media.as_py()
            _, doc_id, size, _ = member.split(".")
            samples = from_png(media)
            rows.append(
                (
                    int(doc_id) if doc_id else None, int(size), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]),
                    len(media), hashlib.sha256(media).hexdigest(), column_hash(samples),
                )
            )
        if rows:
            yield batch(schema, list(zip(*rows, strict=True)))


def features(media: DataFrame) -> DataFrame:
    """Sizes, digests and a column hash of stored payloads, from the bytes read back.

    One row per member: repeated texts and ids are members of their own with equal values. An empty
    folder gives an empty result.
    """
    return media.select("member", "media").mapInArrow(_features, _FEATURES)
