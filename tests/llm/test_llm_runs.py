"""Periodic runs against brute force over all starts and periods."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import periodic_runs as R
from attestor.llm.queries import op12_periodic_runs

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            if end > i and length >= max(6, 4 * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + d] for k in range(length - d)) for d in range(1, q)):
                    found.append((i, length, q))
            i = max(end, i + 1)
            while i + q < n and words[i] != words[i + q]:
                i += 1
    return sorted((s, length, q) for s, length, q in found)


def brute_row(doc_id, text, plant=True):
    words = _WORD.findall(text or "")
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    g = h // 10
    if plant and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def as_list(found):
    return [tuple(int(x) for x in r) for r in zip(found.start, found.length, found.period, strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 4), st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=9), st.integers(1, 7)), max_size=8))
def test_runs_of_sequences_as_brute_force(letters, parts):
    words = [x % letters for piece, times in parts for x in piece * times]
    texts = [[str(w).encode() for w in words]]
    assert sorted(as_list(R.runs(R.numbered(texts)[0]))) == brute_runs(words)


def test_a_period_in_which_every_short_gram_occurs_twice():
    """Two different cycles through the same pairs of letters: each pair stands twice in the period."""
    period = [0, 0, 1, 1, 0, 2, 2, 1, 2, 0, 1, 0, 0, 2, 1, 1, 2, 2, 0, 2]
    words = [7, *(period * 5)[:-3], 8]
    assert sorted(as_list(R.runs(np.unique(words, return_inverse=True)[1]))) == brute_runs(words)
    assert (1, 97, 20) in brute_runs(words)


def test_long_runs_and_many_seeds_take_no_quadratic_time():
    texts = [[b"a"] * 400_000, [b"a", b"b", b"c"] * 100_000, [str(i % 5000).encode() for i in range(200_000)], [str(i).encode() for i in range(200_000)]]
    flat, first = R.numbered(texts)
    got = as_list(R.runs(flat))
    assert got == [(0, 400_000, 1), (int(first[1]), 300_000, 3), (int(first[2]), 200_000, 5000)]


def rows():
    rng = np.random.default_rng(9)
    out = [(None, "x y " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (4, "a a a a a a"), (4, "a a a a a a"), (5, "é è " * 5), (6, "A a " * 4)]
    for i in range(10, 150):
        parts = [" ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(1, 12))) for _ in range(rng.integers(1, 6))]
        out.append((i, " ".join(" ".join([p] * int(rng.integers(1, 7))) for p in parts)))
    out.append((200, " ".join(f"w{x}" for x in rng.integers(0, 3, 4000))))
    return out


def key(row):
    return str(row)


def test_query_columns_as_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS start", "3 AS best")
    for plant in (True, False):
        got = R.digest(R.periodic_runs(docs, plant=plant)).collect()
        assert sorted(map(tuple, got), key=key) == sorted((brute_row(*r, plant) for r in rows()), key=key)
    assert R.digest(R.periodic_runs(docs.limit(0))).count() == 0


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000").collect()  # brute force is quadratic
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, sf).collect()}
    assert len(docs) > 100 and all(got[r.doc_id] == brute_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got.values()) >= 10
