"""Near duplicates, exact duplicates and repeated windows against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import exact_dedup, graph, near_dedup, substring_dedup
from attestor.llm import words as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size=5):
    words = _WORD.findall(lowered(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def words_of(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


def near_rows():
    rows = []
    base = words_of(80, 1)
    for k in range(40):  # a large group of near copies that do not all reach each other
        copy = list(base)
        for j in np.random.default_rng(100 + k).integers(0, 80, 2):
            copy[j] = f"x{k}_{j}"
        rows.append(" ".join(copy))
    rows += ["", None, "   \t\n", "one two", "ONE  two", "one two three four five", "one two three four five", "a b c", "a b c d"]
    rows += [" ".join(words_of(3000, 7)), " ".join(words_of(3000, 7)[:2700]), " ".join(words_of(3000, 7)[:2100])]
    rows += ["É é a b c d", "é É a b c d"]
    return [(i, t, "en", "s", 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_as_brute_force(spark, block):
    rows = near_rows()
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), block=block, key_block=block).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}
    assert got == brute_components({r[0]: r[1] for r in rows})


def test_near_duplicates_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components({r.doc_id: r.text for r in docs.collect()})


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f", None, None, None), (5, "a b c d e f", None, None, None), (5, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS node", "2 AS component", "'x' AS sig")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").na.fill(-1).collect())
    assert got == [(-1, 2, -1, True), (3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False)]
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 2
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_index_finds_all_pairs_within_the_radius():
    rng = np.random.default_rng(3)
    for wrong in (0, 1, near_dedup.RADIUS - 1, near_dedup.RADIUS):
        for _ in range(50):
            a = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
            b = a.copy()
            b[rng.choice(near_dedup.SYMBOLS, wrong, replace=False)] ^= 1
            keys = near_dedup.chunk_keys(np.array([a, b]))
            shared = np.flatnonzero(keys[0] == keys[1])
            assert len(shared)
            assert near_dedup.first_slots(a, b[None])[0] == shared[0]


def test_signature_distance_follows_similarity():
    rng = np.random.default_rng(4)
    common, own = rng.integers(0, 1 << 63, 600, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    a, b = np.concatenate((common, own[:100])), np.concatenate((common, own[100:]))  # 600 of 800
    assert near_dedup.distances(near_dedup.signature(a), near_dedup.signature(b)) <= near_dedup.RADIUS


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components_as_union_find(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def exact_rows():
    long = " ".join(words_of(60_000, 2, 5000))
    texts = ["Same text", "same TEXT", "same text ", "", None, "É", "é", long, long.upper(), long[:-1], "a" * 200_000, "A" * 200_000, "a" * 200_001, "ß"]
    return [(i, t, None, None, 0) for i, t in enumerate(texts)]


def test_exact_duplicates_as_brute_force(spark):
    rows = exact_rows()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lowered(t)].append(i)
    want = {i: (max(groups[lowered(t)]), len(groups[lowered(t)]), i == max(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t, *_ in rows}
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == want


def test_exact_duplicates_of_odd_rows(spark):
    rows = [(None, "a", None, None, 0), (None, "A", None, None, 0), (7, "b", None, None, 0), (7, "b", None, None, 0), (None, "b", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS row", "2 AS recipe")
    found = exact_dedup.exact_duplicates(docs).collect()
    assert sorted((r.text_sha256, r.kept) for r in found) == sorted(
        [(hashlib.sha256(b"a").hexdigest(), k) for k in (True, False)] + [(hashlib.sha256(b"b").hexdigest(), k) for k in (True, False, False)]
    )
    stays = exact_dedup.without_duplicates(docs)
    assert stays.columns == docs.columns and sorted((r.doc_id, lowered(r.text)) for r in stays.collect() if r.doc_id) == [(7, "b")] and stays.count() == 2
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_chunks_are_cut_by_content():
    rng = np.random.default_rng(6)
    body = rng.integers(97, 123, 100_000).astype(np.uint8)
    late = np.concatenate((rng.integers(97, 123, 333).astype(np.uint8), body))
    a = exact_dedup.cuts(body, np.array([0, len(body)]))
    b = exact_dedup.cuts(late, np.array([0, len(late)])) - 333
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert np.diff(np.concatenate(([0], a))).max() <= exact_dedup.LONGEST_CHUNK


def test_colliding_chunk_fingerprints_get_variants(spark):
    rows = [(1, 10, b"x"), (1, 10, b"x"), (1, 10, b"y"), (1, 11, b"x"), (2, 10, b"x")]
    found = exact_dedup.identifiers(spark.createDataFrame(rows, "print long, size long, proof binary")).collect()
    assert {(r.print, r.size, bytes(r.proof)): r.variant for r in found} == {(1, 10, b"x"): 0, (1, 10, b"y"): 1, (1, 11, b"x"): 2}


def brute_repeats(texts, window):
    split = {i: (t or "").encode().split() for i, t in texts.items()}
    counts = Counter(tuple(w[i : i + window]) for w in split.values() for i in range(len(w) - window + 1))
    out = {}
    for i, w in split.items():
        covered = [False] * len(w)
        for j in range(len(w) - window + 1):
            if counts[tuple(w[j : j + window])] > 1:
                covered[j : j + window] = [True] * window
        out[i] = (len(w), sum(covered), b" ".join(x for x, c in zip(w, covered, strict=True) if not c).decode())
    return out


@pytest.mark.parametrize("window, many", [(1, 256), (3, 2), (12, 3), (35, 256), (35, 1)])
def test_repeats_as_brute_force(spark, window, many):
    passage = words_of(90, 11)
    texts = [words_of(60, 20) + passage + words_of(50, 21), words_of(10, 22) + passage[:70] + words_of(50, 23), passage[20:] + passage, ["the"] * 100, ["a", "b"] * 60]
    texts += [words_of(200, 30 + k, 3) for k in range(4)] + [["x"], [], words_of(35, 50), words_of(35, 50), words_of(34, 51), words_of(34, 51)]
    texts = {i: " ".join(t) for i, t in enumerate(texts)} | {100: None, 101: "  A\tA\n" * 50, 102: "Ä " * 40}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS)
    found = substring_dedup.without_repeats(docs, window, many).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == brute_repeats(texts, window)


def test_repeats_of_odd_rows(spark):
    text = " ".join(words_of(50, 5))
    rows = [(None, text, None, None, 0), (1, "alone " + text[:20], None, None, 0), (2, text, None, None, 0), (2, text, None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS name", "2 AS place", "3 AS n", "4 AS node")
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(docs).collect()]
    assert sorted(found, key=str) == sorted([(None, 50, 50, ""), (1, 1 + len(text[:20].split()), 0, "alone " + " ".join(text[:20].split())), (2, 50, 50, ""), (2, 50, 50, "")], key=str)
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\r\x0b\x0c\x1c\xa0Éé\U0001f600", max_size=40), max_size=8), st.booleans(), st.integers(1, 64))
def test_words_as_bytes_split(texts, lower, limit):
    import pyarrow as pa

    out = []
    for piece in W.slices(pa.array(texts, pa.string()), limit):
        found = W.words(piece, lower)
        for a, b in zip(found.first[:-1], found.first[1:], strict=True):
            out.append([found.data[x:y].tobytes() for x, y in zip(found.starts[a:b], found.ends[a:b], strict=True)])
        assert len({h for h in found.hashes.tolist()}) == len({found.data[x:y].tobytes() for x, y in zip(found.starts, found.ends, strict=True)})
    assert out == [(t.encode().lower() if lower else t.encode()).split() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding_argmin(values, width):
    if len(values) >= width:
        got = substring_dedup.sliding_argmin(np.array(values, np.uint64), width).tolist()
        assert got == [min(range(i, i + width), key=lambda j: (values[j], j)) for i in range(len(values) - width + 1)]


def thue_morse(n):
    """A word of ``n`` letters and its complement, which polynomial hashes modulo a power of two confuse."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_follow_a_hash_are_told_apart(spark):
    one, two = thue_morse(1024)
    common = words_of(34, 3)
    texts = {1: " ".join([*common, one]), 2: " ".join([*common, two]), 3: " ".join(["x", "y", "z", "q", one]), 4: " ".join(["x", "y", "z", "q", two])}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS)
    assert {r.doc_id: r.n_removed for r in substring_dedup.without_repeats(docs).collect()} == dict.fromkeys(texts, 0)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs.where("doc_id > 2")).collect()}
    assert got == {3: (1, 3, True), 4: (1, 4, True)}


def test_long_rows_of_two_words_are_told_apart(spark):
    """The same pattern among whole words, in texts of one id."""
    one, two = (" ".join(t) for t in thue_morse(2048))
    docs = spark.createDataFrame([(1, one, None, None, 0), (1, two, None, None, 0)], DOCS)
    want = Counter()
    counts = Counter(tuple(t.split()[i : i + 35]) for t in (one, two) for i in range(2048 - 34))
    for t in (one, two):
        w, covered = t.split(), [False] * 2048
        for i in range(2048 - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                covered[i : i + 35] = [True] * 35
        want[" ".join(x for x, c in zip(w, covered, strict=True) if not c)] += 1
    assert Counter(r.kept for r in substring_dedup.without_repeats(docs).collect()) == want


def test_large_groups_are_dealt_over_tasks(spark):
    """Thousands of copies and near copies, with joins that deal out groups from 50 rows on."""
    base = words_of(60, 71)
    texts = {i: " ".join(base) for i in range(1500)}
    for i in range(1500, 1900):  # near copies, all of one group
        near = list(base)
        near[i % 60] = f"n{i}"
        texts[i] = " ".join(near)
    texts |= {i: " ".join(words_of(45, i)) for i in range(1900, 1960)} | {1960: "", 1961: ""}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, block=50, key_block=50, heavy=50).collect()}
    distinct = {t: min(i for i, x in texts.items() if x == t) for t in set(texts.values()) if t}
    of = brute_components({i: t for t, i in distinct.items()})
    assert got == {i: (of[distinct[t]][0], of[distinct[t]][1], of[distinct[t]][1] == i) if t else (0, i, True) for i, t in texts.items()}
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, heavy=50).collect()}
    sizes, keep = Counter(texts.values()), {t: max(i for i, x in texts.items() if x == t) for t in set(texts.values())}
    assert found == {i: (keep[t], sizes[t], keep[t] == i) for i, t in texts.items()}
    some = {i: t for i, t in texts.items() if i % 5 == 0}
    removed = substring_dedup.without_repeats(docs.where("doc_id % 5 = 0"), 12, 30, heavy=50).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in removed} == brute_repeats(some, 12)
