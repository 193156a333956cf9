"""Scalar expressions and rule tables."""

import re

import pytest
from pyspark.sql import functions as F

from attestor import presets
from attestor.functions import rules, text as tx
from attestor.sources.registry import reference_pmid


def values(frame, expression, items):
    df = frame("no int, x string", list(enumerate(items))).select("no", expression.alias("y"))
    return [r["y"] for r in sorted(df.collect())]


def test_jaccard_counts_distinct_words_of_two_letters(frame):
    a = "KATHERINE: Trastuzumab Emtansine versus Trastuzumab in HER2-positive breast cancer"
    b = "Adjuvant trastuzumab emtansine for residual invasive HER2-positive breast cancer"
    df = frame("a string, b string", [(a, b), (a, ""), ("x y", "x y")])
    got = [r[0] for r in df.select(tx.jaccard(tx.title_tokens("a"), tx.title_tokens("b"))).collect()]
    assert got == [0.4615, 0.0, 0.0]


def test_split_candidates(frame):
    got = values(frame, tx.split_candidates("x"), ["A | B|none | ", "  ", "nan", "one  two", None, " | "])
    assert got == [["A", "B"], [], [], ["one two"], [], ["|"]]


def test_key_words_keep_unicode_letters(frame):
    words = " ".join(f"wort{i}" for i in range(20))
    got = values(frame, tx.title_key_words("x"), ["Über-raschung of a (new) drug", words])
    assert got[0] == ["Über", "raschung", "new", "drug"]
    assert got[1] == words.split()
    assert values(frame, tx.title_key_words("x", 12), [words])[0] == words.split()[:12]


def test_years_and_dates(frame):
    assert values(frame, tx.year_in("x"), ["Jun 2021", "2021-06", "12021", ""]) == ["2021", "2021", None, None]
    dates = values(frame, tx.iso_date("x").cast("string"), ["2021-06-03", "2021/06/03", "2021-06", "June", "2021-13-40", ""])
    assert dates == ["2021-06-03", "2021-06-03", None, None, None, None]


def test_truth_and_formats(frame):
    assert values(frame, tx.truthy("x"), ["True", " yes ", "1", "no", "", None]) == [True, True, True, False, False, False]
    assert values(frame, tx.fmt_num("x", 2), ["3.14159", "abc", "2.675", "1234.5"]) == ["3.14", "-", f"{2.675:.2f}", "1234.50"]
    assert values(frame, tx.safe_text("x"), [" a ", " "]) == ["a", "Not available."]
    got = frame("p int, n int", [(1, 8), (0, 0)]).select(tx.fmt_pct(F.col("p"), F.col("n"))).collect()
    assert [r[0] for r in got] == ["12.5%", "0.0%"]


def test_pair_keys(frame):
    df = frame("x string", [("NCT1_2_3",), ("NCT1",)]).select(tx.pair_nct("x").alias("a"), tx.pair_pmid("x").alias("b"))
    assert [tuple(r) for r in df.collect()] == [("NCT1", "2_3"), ("NCT1", "")]


def test_stable_rank_order(frame):
    got = values(frame, tx.stable_rank("x"), ["NCT001_111", "NCT003_333", "NCT002_222"])
    assert got == ["205ad60b784dd823", "4a5338e18473ba45", "fbf3eb97ef4291b2"]


def test_flatten_markup_keeps_comparisons(frame):
    got = values(frame, tx.flatten_markup("x"), ["A <i>b</i>\n c<sup>2</sup>", "p < 0.05 and q > 1", '<a href="x>y">t</a><br/>'])
    assert got == ["A b c2", "p < 0.05 and q > 1", "t"]


CLUSTERS = [
    ("pCR at surgery", "pathological_complete_response"),
    ("Invasive disease-free survival", "event_free_disease_free_survival"),
    ("OS", "overall_survival"),
    ("All cause mortality", "overall_survival"),
    ("Time to progression", "progression_free_survival"),
    ("Complete response rate and partial response", "objective_response_rate"),
    ("EORTC QLQ-C30", "patient_reported_outcomes"),
    ("Tumour volume", "other_endpoints"),
    ("  ", "missing_endpoint"),
    ("NaN", "missing_endpoint"),
    (None, "missing_endpoint"),
    ("Disease-free survival and overall survival", "event_free_disease_free_survival"),
]


def test_endpoint_clusters(frame):
    assert values(frame, rules.endpoint_cluster("x"), [c[0] for c in CLUSTERS]) == [c[1] for c in CLUSTERS]


POPULATIONS = [
    ("HER2-positive breast cancer", ["metastatic"], "", ("bc_confirmed", "her2_positive", "metastatic")),
    ("Triple-negative breast cancer", [], "neoadjuvant and adjuvant therapy", ("bc_confirmed", "tnbc", "neoadjuvant")),
    ("Luminal breast cancer", ["post-operative"], "HER2-negative", ("bc_confirmed", "hr_positive", "adjuvant")),
    ("HER2+ breast cancer", ["adjuvant"], "", ("bc_flagged", "unknown_subtype", "adjuvant")),
    ("Lung cancer", ["metastatic"], "tnbc", ("non_breast_excluded", "unknown_subtype", "unknown_setting")),
    ("Breast cancer, HER2 positive, HER2-low, ER-positive", ["Stage IV"], "", ("bc_confirmed", "hr_positive", "metastatic")),
    ("Breast cancer tnbc", [], "neo-adjuvant", ("bc_confirmed", "tnbc", "adjuvant")),
]


def test_population_rules(frame):
    rows = [(i, t, c, e) for i, (t, c, e, _) in enumerate(POPULATIONS)]
    df = rules.classify_population(frame("no int, t string, c array<string>, e string", rows), "t", F.col("c"), "e")
    got = [tuple(r)[4:] for r in sorted(df.collect(), key=lambda r: r["no"])]
    assert got == [p[3] for p in POPULATIONS]


def test_plus_sign_option(frame):
    df = frame("t string, c array<string>, e string", [("HER2+ breast cancer", ["adjuvant"], "")])
    got = rules.classify_population(df, "t", F.col("c"), "e", presets.POPULATION_PATTERNS_PLUS_SIGNS).first()
    assert got["bc_subtype"] == "her2_positive"


def test_reference_pmid(frame):
    schema = "r array<struct<type:string,pmid:string>>"
    rows = [
        ([("DERIVED", "5"), ("RESULT", "9"), ("RESULT", "1")],),
        ([("DERIVED", "50"), ("DERIVED", "7"), ("BACKGROUND", "1")],),
        ([("DERIVED", "7"), ("DERIVED", "x")],),
        ([("RESULT", "")],),
        (None,),
    ]
    got = [r[0] for r in frame(schema, rows).select(reference_pmid(F.col("r"))).collect()]
    assert got == ["9", "7", "x", "", ""]


@pytest.mark.parametrize("name", sorted(presets.POPULATION_PATTERNS))
def test_patterns_are_valid_in_both_dialects(name):
    re.compile(presets.POPULATION_PATTERNS[name])
