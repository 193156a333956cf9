"""Tokenization automaton, packing and media against libraries and brute force."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestor.llm import bpe, media, packing
from attestor.session import work_path

PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, n_tokens int"
TEXTS = ["", None, "  \n\t", "Hello  World", "it's I'LL we'Ve 'S", "É é ß Σας ΑΣ İ ﬁ", "日本語 한국어 𝔘😀 क़", "<|endoftext|>a<|startoftext|> b", "x\0y\x1f\x85z", "a" * 5000, "12³ ½ Ⅷ"]


@pytest.fixture(scope="module")
def machine():
    return bpe.TokenAutomaton(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text_are_the_library_s(machine, library, text):
    ids = machine.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert machine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_ids_of_letters_newer_than_the_tokenizer(machine, library):
    for first in (0x558, 0x1C89, 0xA7CB, 0xA7D2, 0xA7DC, 0x10D50, 0x16EA0, 0x323B0):
        text = f"a{chr(first)}b {chr(first + 1)}1"
        assert machine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_ids_of_long_words(machine, library):
    rng = random.Random(5)
    for alphabet in ("ab", "aeinrst", "the", "éè"):
        for length in (1, 2, 3, 50, 3000):
            word = "".join(rng.choice(alphabet) for _ in range(length))
            assert machine.encode(word) == library.encode(word, add_special_tokens=False).ids


def merged(word, merges):
    """BPE as defined: the best pair of the word, leftmost first, again and again."""
    parts = list(word[:-1]) + [word[-1] + "</w>"]
    ranks = {tuple(m): i for i, m in enumerate(merges)}
    while True:
        pairs = [(ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        best = min(pairs, default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_automaton_of_any_merges(tmp_path_factory, data):
    symbols = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    merges = []
    for _ in range(data.draw(st.integers(0, 12))):
        left = data.draw(st.sampled_from([s for s in symbols if not s.endswith("</w>")]))
        right = data.draw(st.sampled_from(symbols))
        if left + right not in symbols:
            symbols.append(left + right)
            merges.append([left, right])
    spec = {
        "added_tokens": [],
        "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": r"[\p{L}]+"}}]},
        "model": {"end_of_word_suffix": "</w>", "vocab": {s: i for i, s in enumerate(symbols)}, "merges": merges},
    }
    path = tmp_path_factory.mktemp("bpe") / "spec.json"
    path.write_text(json.dumps(spec))
    machine = bpe.TokenAutomaton(str(path))
    rng = random.Random(1)
    for _ in range(60):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        assert [machine.labels[i] for i in machine.encode_word(word)] == merged(word, merges)


def test_encode_and_decode_rows(spark, library):
    docs = spark.createDataFrame([(i if i else None, t, None, 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, 7)], DOCS)
    both = bpe.encode(docs, PATH, decoded=True)
    rows = {r.doc_id: r for r in both.collect()}
    back = {r.doc_id: r.text for r in bpe.decode(both, PATH).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        got = rows[i if i else None]
        assert (got.n_tokens, bytes(got.ids)) == (len(ids), np.array(ids, "<u4").tobytes())
        assert got.decoded == back[i if i else None] == library.decode(ids, skip_special_tokens=False)
    assert both.count() == len(TEXTS) + 1 and bpe.encode(docs.limit(0), PATH).count() == 0


def brute_best_fit(sizes, length):
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
        if fits:
            least = min(fits)[0]
            yield sizes[i], least
            k = next(k for r, k in fits if r == least)
        else:
            yield sizes[i], length
            rows.append([])
            room.append(length)
            k = len(rows) - 1
        room[k] -= sizes[i]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 40))
def test_best_fit_takes_the_least_room(sizes, length):
    rows = packing.best_fit(sizes, length)
    assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in row) <= length for row in rows)
    # Rows of equal room are interchangeable: compare the rooms that are left.
    room = []
    for size, least in brute_best_fit(sizes, length):
        if least != length or least in room:
            room.remove(least) if least in room else None
        room.append(least - size)
    assert sorted(length - sum(sizes[i] for i in row) for row in rows) == sorted(room)


@pytest.mark.parametrize("length, shard", [(8, 50), (2048, 1 << 20)])
def test_packing_loses_nothing(spark, length, shard):
    docs = spark.createDataFrame([(i if i else None, t, None, 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, 0)], DOCS)
    packed = packing.pack(docs, RANKS, public_tokenizers.PATTERN, length=length, shard_tokens=shard)
    encode = packing.rank_encoder(RANKS, public_tokenizers.PATTERN)
    for r in packed.collect():
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(positions) == length and r.ends[0] == 0 and r.ends[-1] == r.n_tokens <= length
        assert not ids[r.n_tokens :].any() and len(r.doc_ids) == len(r.parts) == len(r.ends) - 1
        for x, y in zip(r.ends[:-1], r.ends[1:], strict=True):
            assert positions[x:y].tolist() == list(range(y - x)) and y > x
    pieces = sorted((str(r.doc_id), r.part, bytes(r.ids)) for r in packing.unpack(packed).collect())
    want = []
    for i, text in [*((i if i else None, t) for i, t in enumerate(TEXTS)), (3, TEXTS[3])]:
        ids = np.array(encode(text or ""), "<u4")
        want += [(str(i), k, ids[at : at + length].tobytes()) for k, at in enumerate(range(0, len(ids), length))]
    assert pieces == sorted(want)
    assert packing.pack(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=500))
def test_png_round_trip(payload):
    samples = media.padded(payload)
    assert len(samples) % 64 == 0 and len(samples) >= 64 and samples[: len(payload)] == payload and not any(samples[len(payload) :])
    assert media.from_png(media.to_png(samples)) == samples


def test_media_read_back(spark):
    texts = [*TEXTS, "x" * 64, "y" * 65, "random " + "".join(chr(random.Random(1).randint(32, 1000)) for _ in range(30_000))]
    docs = spark.createDataFrame([(i if i else None, t, None, 0) for i, t in enumerate(texts)] + [(3, texts[3], None, 0)], DOCS).repartition(3)
    folder = work_path(spark, "media-test")
    made = media.write_archives(docs, folder, archive_bytes=20_000)
    assert made.count() >= 3 and made.selectExpr("sum(members)").first()[0] == len(texts) + 1
    for split in (500, 1 << 20):
        rows = media.features(media.read_archives(spark, folder, split)).collect()
        assert len(rows) == len(texts) + 1 and len({r.media_sha256 for r in rows if r.doc_id == 3}) == 1
        for r in rows:
            payload = (texts[r.doc_id or 0] or "").encode()
            samples = media.padded(payload)
            stored = media.to_png(samples)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]))
            assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.column_hash(samples))
    empty = work_path(spark, "media-empty")
    media.write_archives(docs.limit(0), empty)
    assert media.features(media.read_archives(spark, empty)).count() == 0


def test_members_are_tried_again_by_offset(tmp_path, monkeypatch):
    import io
    import zipfile

    held = io.BytesIO()
    bodies = {f"{i}.{i}.5.png": media.to_png(media.padded(bytes([65 + i]) * 500)) for i in range(6)}
    with zipfile.ZipFile(held, "w") as archive:
        for name, body in bodies.items():
            archive.writestr(zipfile.ZipInfo(name), body)
    (tmp_path / "media-0.zip").write_bytes(held.getvalue())
    reader = media.MediaReader({"path": str(tmp_path), "splitBytes": "1000000"})
    tried = []
    real = reader._again

    class Flaky:
        """Damages the first single read of a member."""

        def __init__(self, source):
            self.source, self.reads = source, 0

        def seek(self, at):
            return self.source.seek(at)

        def read(self, n=-1):
            self.reads += 1
            data = self.source.read(n)
            return b"\0" * len(data) if self.reads == 2 else data

    monkeypatch.setattr(reader, "_again", lambda source, info: (tried.append(info.filename), real(Flaky(source), info))[1])
    true_crc = zlib.crc32
    damaged = bodies["2.2.5.png"]
    seen = []

    def crc(data, *more):
        if bytes(data) == damaged and not seen:
            seen.append(1)
            return 0
        return true_crc(data, *more)

    monkeypatch.setattr(media.zlib, "crc32", crc)
    (part,) = reader.partitions()
    out = pa.Table.from_batches(list(reader.read(part)))
    assert dict(zip(out["member"].to_pylist(), out["media"].to_pylist(), strict=True)) == bodies
    assert tried == ["2.2.5.png"]


def plain_png(body):
    """The samples of an 8-bit grey PNG by the format's rules, with every kind of row filter."""
    import struct
    import zlib

    assert body[:8] == bytes([137]) + b"PNG\r\n\x1a\n"
    at, packed, kinds = 8, b"", []
    while at < len(body):
        size, kind = struct.unpack(">I4s", body[at : at + 8])
        data, (crc,) = body[at + 8 : at + 8 + size], struct.unpack(">I", body[at + 8 + size : at + 12 + size])
        assert crc == zlib.crc32(kind + data)
        kinds.append(kind)
        if kind == b"IHDR":
            width, height, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", data)
            assert (depth, colour, method, filters, interlace) == (8, 0, 0, 0, 0)
        packed += data if kind == b"IDAT" else b""
        at += 12 + size
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    lines, above, out = zlib.decompress(packed), [0] * width, b""
    assert len(lines) == height * (width + 1)
    for y in range(height):
        kind, row = lines[y * (width + 1)], list(lines[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            left, corner = (row[x - 1], above[x - 1]) if x else (0, 0)
            p = left + above[x] - corner
            paeth = min((left, above[x], corner), key=lambda v: abs(p - v))
            row[x] = (row[x] + (0, left, above[x], (left + above[x]) // 2, paeth)[kind]) % 256
        above, out = row, out + bytes(row)
    return out


def test_stored_images_are_png_for_any_reader(spark):
    texts = {1: "some text " * 30, 2: None, 3: "Ä" * 32, 4: "x" * 64}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'a' AS archive", "'m' AS member", "1 AS position", "'f' AS feature")
    folder = work_path(spark, "media-png")
    media.write_archives(docs, folder)
    got = {int(r.member.split(".")[1]): plain_png(bytes(r.media)) for r in media.read_archives(spark, folder).collect()}
    want = {i: (t or "").encode() for i, t in texts.items()}
    assert got == {i: t + bytes(max(64, -(-len(t) // 64) * 64) - len(t)) for i, t in want.items()}


def test_a_reader_that_misses_archives_stops(spark):
    import os

    folder = work_path(spark, "media-missing")
    docs = spark.createDataFrame([(i, f"text {i} " * 200) for i in range(40)], "doc_id long, text string")
    done = media.write_archives(docs, folder, archive_bytes=2_000).collect()
    assert len(done) > 2 and media.read_archives(spark, folder).count() == 40
    _, base = media.store(media.qualified(spark, folder))
    os.remove(f"{base}/{os.path.basename(done[0].archive)}")
    with pytest.raises(Exception, match="archives, not the"):
        media.read_archives(spark, folder).count()
