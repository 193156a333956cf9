"""Searches through the trigram index equal scans."""

import re

import pyarrow as pa
import pytest

from attestor.operators import review, text_index

TEXTS = [
    "Licence terms", "the license", "LICENſE of old", "copyright 2020", "no rights", "", None, "lic ence", "İstanbul trip", "istanbul", "ab", "abc" * 9000,
    "colour and color", "a.b", "x[y", "Kelvin Kelvin", "tail: licen", "cense",
]
PATTERNS = ["licen[cs]e|copyright", "license", "colou?r", "col+our", "istanbul", "kelvin", "ab", "a.b", "^the lic", "(license)", "x\\[y", "no .*rights", "licen|zzz", "zzz", " ", "abcabc", "terms$", "l[^x]cence", "and&&color"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams"))
    df = spark.createDataFrame([(i, t, f"note {i}") for i, t in enumerate(TEXTS)], "doc long, body string, note string").repartition(3).persist()
    text_index.write_index(df, path, "doc", ["body", "note"])
    return df, path


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_equals_the_scan(spark, indexed, pattern):
    df, path = indexed
    got = text_index.search(spark, df, path, "doc", pattern, ["body", "note"])
    want = review.filtered_log(df, search=pattern, search_in=["body", "note"])
    assert sorted(r.doc for r in got.collect()) == sorted(r.doc for r in want.collect())


def test_needed_trigrams():
    assert text_index.needed("licen[cs]e|copy") == [{"lic", "ice", "cen"}, {"cop", "opy"}]
    assert text_index.needed("colou?r") == [{"col", "olo"}]
    for none in ("ab", "a.b.c", "abc|", "(abc)", "ab\\d", "[abc]", "ab*c", "abc{2}"):
        assert text_index.needed(none) is None, none


def test_a_match_holds_what_its_pattern_needs():
    for pattern in PATTERNS:
        for asked in [text_index.needed(pattern)] if text_index.needed(pattern) else []:
            for t in filter(None, TEXTS):
                if re.search(pattern, t.lower()):
                    assert any(all(g in t.lower() for g in a) for a in asked)


def test_only_the_asked_folders_are_read(spark, indexed):
    df, path = indexed
    plan = text_index.search(spark, df, path, "doc", "license", ["body"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_lists_of_a_stretch_are_whole_and_together(spark, tmp_path, monkeypatch):
    texts = [*TEXTS, "\U0001f600\U0001f601\U0001f602\0 nul\0", None, "ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, body string").coalesce(1)
    text_index.write_index(df, str(tmp_path / "one"), "doc", ["body"])
    folded = dict(df.select("doc", text_index.folded(text_index.text("body"))).collect())
    want = {(t[i : i + 3], doc) for doc, t in folded.items() for i in range(len(t) - 2)}
    rows = spark.read.parquet(str(tmp_path / "one")).collect()
    assert {(r.gram, i) for r in rows for i in r.ids} == want == {(r.gram, i) for r in rows for i in sorted(set(r.ids))}
    assert len(rows) < len(want)


def test_stretches_of_any_size_give_the_same_lists(monkeypatch):
    texts = ["abcabc", "", "xabc", "ab", "c\U0001f600dabc"]
    want = {(t[i : i + 3], n) for n, t in enumerate(texts) for i in range(len(t) - 2)}
    for size in (1, 7, 100):
        monkeypatch.setattr(text_index, "STRETCH", size)
        b = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts), pa.array([len(t) for t in texts])], ["id", "body", "size"])
        assert {(g, i) for out in text_index._postings(iter([b])) for g, ids in zip(*map(pa.Array.to_pylist, out.columns)) for i in ids} == want
