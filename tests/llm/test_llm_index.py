"""The positional index: exact and proximity matches against brute force."""

import hashlib
import re

import numpy as np
import pytest

from attestor.llm import positional_index as P
from attestor.llm.queries import op11_decontamination

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(items, window):
    of = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            of.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    return of


def brute(docs, items, window):
    of, out = windows(items, window), []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(p) for p in of}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in of:
                    hit.update(range(i, i + n))
                    names |= of[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(names), bool(hit)))
    return sorted(out, key=str)


def found(rows):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows), key=str)


def made(seed, n, vocabulary):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n))


ODD_DOCS = [
    (1, None), (2, ""), (3, " .,;\n"), (4, "One TWO, three-four"), (4, "one two three four"), (None, "x one two three four y"), (None, None),
    (5, "Été déjà vu, été déjà"), (6, "été déjà vu"), (7, made(1, 30000, 12)), (8, made(2, 60, 3)), (8, made(2, 60, 3)),
    (0, "x one two three four y"),
]
ODD_ITEMS = [(1, None), (2, ""), (3, "one two three four"), (3, "vu été"), (None, "two three four"), (9, "ONE. two three Four"), (10, "nowhere to be seen"), (11, made(2, 60, 3)), (11, made(2, 60, 3)), (12, "w1 w1 w1 w1")]


@pytest.mark.parametrize("window, lists", [(4, 2), (4, 1), (10, 2), (2, 3)])
def test_matches_as_brute_force(spark, window, lists):
    docs = spark.createDataFrame(ODD_DOCS, DOCS).selectExpr("*", "1 AS doc", "2 AS print", "'x' AS term", "3 AS pos", "4 AS phrase")
    items = spark.createDataFrame(ODD_ITEMS, ITEMS).selectExpr("*", "'y' AS item", "5 AS terms", "6 AS doc_id")
    got = P.contamination(docs, items, window=window, lists=lists)
    assert found(got.collect()) == brute(ODD_DOCS, ODD_ITEMS, window)


def test_frequent_words_and_copies(spark):
    """A third of all documents are one text of the two most frequent words, which the items consist of, too."""
    hot = "the of " * 30
    docs = [(i, hot if i % 3 == 0 else made(i, 40, 50) + " the of") for i in range(90)]
    items = [(1, "the of " * 8), (2, made(7, 40, 50)), (3, "of the of the the of the of the of the")]
    got = P.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert found(got.collect()) == brute(docs, items, P.WINDOW)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(ODD_DOCS, DOCS), spark.createDataFrame(ODD_ITEMS, ITEMS)
    assert P.contamination(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in P.contamination(docs, items.limit(0)).collect())


def test_index_holds_all_words_or_those_asked_for(spark):
    docs = spark.createDataFrame(ODD_DOCS, DOCS)
    assert P.index(docs).count() == sum(len(words(t)) for _, t in ODD_DOCS)
    few = P.index(docs, spark.createDataFrame([("two",), ("two",), ("vu",)], "term string"))
    assert sorted((r.term, r.doc, r.pos) for r in few.collect()) == [("two", 0, 2), ("two", 0, 2), ("two", 4, 1), ("two", 4, 1), ("vu", 5, 2), ("vu", 6, 2)]


def test_proximity_as_brute_force(spark):
    docs = [(i, made(50 + i, 120, 25)) for i in range(12)] + [(20, "a x b y c"), (21, "c b a"), (22, "a b x x x x c"), (23, None)]
    items = [(1, "a b c"), (2, "w1 w2 w3"), (3, "w4 w5 w4 w6"), (4, "w7")]
    for slop in (0, 2, 5):
        phrases, _ = P.phrases(spark.createDataFrame(items, ITEMS))
        text = {r.phrase: tuple(r.terms) for r in phrases.collect()}
        rows = P.proximity_matches(P.index(spark.createDataFrame(docs, DOCS)), phrases, slop).collect()
        got = sorted((r.doc, text[r.phrase], r.start, r.end) for r in rows)
        want = []
        for doc, t in docs:
            w = words(t)
            for phrase in text.values():
                for i in range(len(w)):
                    for end in range(i + 1, min(i + len(phrase) + slop, len(w)) + 1):
                        if w[i] in phrase and set(phrase) <= set(w[i:end]):
                            want.append((doc, phrase, i, end))
                            break
        assert got == sorted(want)


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = op11_decontamination(spark, sf).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, h, i, c in brute(docs, items, 10)]
    assert got == sorted(want, key=str)
