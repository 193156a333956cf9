"""Effect extraction, published endpoints and row validation."""

import math

import pytest
from pyspark.sql import functions as F

from attestor import presets, schemas
from attestor.functions import extract

TEXTS = [
    ("Deaths fell (hazard ratio 0.64; 95% CI 0.47-0.88) in arm B", ("hr_semicolon_ci", 0.64, 0.47, 0.88)),
    ("for relapse the HR, 1.21; 95% CI, 0.95 to 1.54", ("hr_semicolon_ci", 1.21, 0.95, 1.54)),
    ("we found HR 0.58 (95% CI 0.41-0.82) overall", ("hr_paren_ci", 0.58, 0.41, 0.82)),
    ("with a hazard ratio of 0.91 (0.79 to 1.05) after a year", ("hr_narrative_to", 0.91, 0.79, 1.05)),
    ("HR=1.33 [95%CI: 1.02, 1.74] per unit", ("hr_bracket_ci", 1.33, 1.02, 1.74)),
    ("adjusted HR 0.72, 95% CI 0.55–0.94", ("hr_comma_ci", 0.72, 0.55, 0.94)),
    ("toxicity: odds ratio 2.10 [95% CI 1.25, 3.53]", ("rr_or_fallback", 2.10, 1.25, 3.53)),
    ("HR 0,58 (95% CI 0,41-0,82) with decimal commas", ("hr_paren_ci", 0.58, 0.41, 0.82)),
    ("the same again: HR 0.58 (95% CI 0.41-0.82)", ("hr_paren_ci", 0.58, 0.41, 0.82)),
    ("arms did not differ", None),
    ("bounds above the estimate: HR 0.58 (95% CI 0.61-0.82)", None),
    ("too wide: HR 0.45 (95% CI 0.03-1.90)", None),
    ("too large: HR 14.0 (95% CI 11.0-18.0)", None),
    # An invalid first pattern leaves the later ones their chance.
    ("HR 0.72 (95% CI 0.94-0.55), corrected to HR 0.72, 95% CI 0.55-0.94", ("hr_comma_ci", 0.72, 0.55, 0.94)),
]


def linked(frame, texts):
    rows = [(f"NCT{i}", str(i), "High", t, f"2020-01-{i + 1:02d}") for i, t in enumerate(texts)]
    return frame("nct_id string, pmid string, linkage_confidence string, abstract_text string, registration_date string", rows)


def test_styles(frame):
    out = extract.extract_effects(linked(frame, [t for t, _ in TEXTS])).collect()
    got = {r["nct_id"]: r for r in out}
    for i, (_, want) in enumerate(TEXTS):
        r = got[f"NCT{i}"]
        if want is None:
            assert r["outcome"] == "failed" and r["reason"] == presets.EXTRACTION_REASONS["no_match"]
        else:
            assert (r["extraction_method"], r["hr"], r["hr_lci"], r["hr_uci"]) == want


def test_context_window(frame):
    text = "x" * 50 + " HR 0.58 (95% CI 0.41-0.82) " + "y" * 50 + " HR 0.66 (95% CI 0.50-0.87)"
    r = extract.extract_effects(linked(frame, [text])).first()
    assert r["source_text"] == "x" * 29 + " HR 0.58 (95% CI 0.41-0.82) " + "y" * 29


def test_gate_and_reasons(frame):
    rows = [
        ("NCT1", "", "High", "HR 0.58 (95% CI 0.41-0.82)", "2020-01-01"),
        ("NCT2", "2", "Medium", "  ", "2020-01-01"),
        ("NCT3", "3", "Low", "HR 0.58 (95% CI 0.41-0.82)", "2020-01-01"),
    ]
    df = frame("nct_id string, pmid string, linkage_confidence string, abstract_text string, registration_date string", rows)
    out = extract.extract_effects(df)
    got = {r["nct_id"]: (r["pair_id"], r["reason"]) for r in out.collect()}
    assert got == {
        "NCT1": ("NCT1_unlinked", presets.EXTRACTION_REASONS["no_pmid"]),
        "NCT2": ("NCT2_2", presets.EXTRACTION_REASONS["empty_abstract"]),
    }
    audit = extract.extraction_audit(out).collect()
    assert all(r["requires_manual_check"] and r["hr"] is None for r in audit)
    assert extract.effect_measures(out).count() == 0


def test_effect_fields(frame):
    f = extract.effect_fields(F.col("hr"), F.col("l"), F.col("u"))
    df = frame("hr double, l double, u double", [(0.75, 0.60, 0.94), (0.77, 0.59, 1.0)]).select(*[c.alias(n) for n, c in f.items()])
    a, b = [tuple(r) for r in df.collect()]
    assert a[0] == pytest.approx(math.log(0.75), abs=1e-6)
    assert a[1] == pytest.approx((math.log(0.94) - math.log(0.60)) / 3.92, abs=1e-6)
    assert b == (-0.261365, 0.1346, 0.01811716)


def test_sections_are_preferred(frame):
    df = frame("t string, s map<string,string>", [("whole", {"METHODS": "m", "FINDINGS": "f"}), ("whole", None)])
    got = [r[0] for r in df.select(extract.preferred_section(F.col("s"), F.col("t"), presets.EFFECT_SECTIONS)).collect()]
    assert got == ["f", "whole"]


def test_published_endpoint(frame):
    rows = [
        ("Whole text. The primary  end point was OS. More", {"RESULTS": "Nothing named here."}),
        ("Whole text. The primary  end point\twas OS. More", None),
        ("", {"RESULTS": "primary outcome: x"}),
        ("No phrase", {"RESULTS": ""}),
        ("primary composite outcome was death or stroke. End", {}),
    ]
    df = frame("t string, s map<string,string>", rows)
    got = [r["e"] for r in extract.published_endpoint(df, "t", "s", "e").collect()]
    assert got == ["Nothing named here.", "primary end point was OS", "", "No phrase", "primary composite outcome was death or stroke"]


def test_row_validation(frame):
    rows = [("nct01", "direct", "High"), ("123", "direct", "High"), ("NCT2", "guess", None)]
    df = schemas.normalise_trial_id(frame("nct_id string, linkage_method string, linkage_confidence string", rows))
    good, bad = schemas.split_valid(df, schemas.linkage_rules())
    assert [r["nct_id"] for r in good.collect()] == ["NCT01"]
    assert {r["nct_id"]: r["violations"] for r in bad.collect()} == {
        "123": ["nct_id_prefix"],
        "NCT2": ["linkage_method", "linkage_confidence"],
    }


def test_power_row_rules(frame):
    df = frame("enrollment int, assumed_hr double, assumed_event_rate double, alpha double, power double",
               [(10, 0.8, 0.15, 0.05, 0.8), (0, 0.8, 1.0, 0.05, 0.8)])
    got = [r["violations"] for r in schemas.validate(df, schemas.power_rules()).collect()]
    assert got == [[], ["enrollment", "assumed_event_rate"]]


def test_one_scan_for_the_beginning_changes_no_result(frame):
    """The cascade against each pattern over the whole text, for signs whose case or class is beyond ASCII too."""
    odd = ["relative riſK 1.5 (1.1 to 2.0)", "HAZARD RATıO OF 0.7 (0.5 to 0.9)", "hr 0.6 (95 % CI 0.4–0.8)", "oddſ ratio 2,5 [1,5-3,5]"]
    odd += ["or 12 then HR of 3; HR = 0.9 [0.8, 1.1]", "\U0001f600 or 5 İ HR 0.9 (0.8-1.1)", "HR 0.9 (1.8-1.1) RR 1.2 (1.1-1.3)", "the hr", "", "no or 1", "HR ١.٥ (1.1-2.0)"]
    texts = odd + [t for t, _ in TEXTS]
    df = frame("no long, t string", list(enumerate(texts)))
    every = extract.regex_cascade(df, "t", begins="").select("no", "effect")
    got = extract.regex_cascade(df, "t", begins=presets.EFFECT_BEGINS).select("no", "effect")
    assert sorted(got.collect()) == sorted(every.collect())
    assert [r.no for r in got.filter("effect IS NOT NULL").sort("no").collect()][:4] == [0, 1, 2, 3]
