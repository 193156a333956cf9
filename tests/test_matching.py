"""Similarity, routing, adjudication, incremental updates and cost."""

import pytest
from pyspark.sql import functions as F

from attestor import presets
from attestor.functions import vectors
from attestor.operators import matching


def test_routing_bounds(frame):
    df = frame("s double", [(0.90,), (0.89,), (0.50,), (0.49,)])
    got = [r[0] for r in df.select(matching.route(F.col("s"))).collect()]
    assert got == ["auto_concordant", "llm", "llm", "auto_major_switch"]
    assert df.sparkSession.range(1).select(matching.switch_index(F.lit(0.97))).first()[0] == pytest.approx(3.0)


def test_cosine_is_clamped(frame):
    df = frame("a array<float>, b array<float>", [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.6, 0.8], [0.8, 0.6])])
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.96], abs=1e-6)


LINKED = "nct_id string, pmid string, linkage_confidence string, primary_outcomes string, published_endpoint string"
ROWS = [
    ("NCT001", "111", "High", "CV death | HF admission", "HF  admission"),
    ("NCT002", "222", "Low", "skip", "skip"),
    ("NCT003", "", "High", "skip", "skip"),
    ("NCT004", "444", "Medium", "none", "x"),
    ("NCT005", "555", "Medium", "CV death", ""),
    ("NCT006", "None", "High", "a", "a"),
]


def test_only_trusted_links_are_compared(frame):
    got = matching.match_endpoints(frame(LINKED, ROWS)).orderBy("pair_id").collect()
    assert [r["pair_id"] for r in got] == ["NCT001_111", "NCT005_555"]
    assert got[0]["similarity_score"] == pytest.approx(1.0, abs=1e-3) and got[0]["routing"] == "auto_concordant"
    assert got[1]["similarity_score"] == 0.0 and got[1]["routing"] == "auto_major_switch"


def test_user_embedder_runs_in_batches(frame):
    calls = []

    def embed(texts):
        assert len(texts) <= 2
        return [[float(len(t)), 0.0] for t in texts]

    df = frame("text string", [("a",), ("bb",), ("ccc",)]).coalesce(1)
    out = vectors.embed_with(df, "text", embed, batch=2).collect()
    assert [(r["text"], list(r["embedding"])) for r in out] == [("a", [1.0, 0.0]), ("bb", [2.0, 0.0]), ("ccc", [3.0, 0.0])]
    assert calls == []


def test_updates_replace_and_resume(frame):
    linked = frame("nct_id string, pmid string, routing string", [("N1", "1", "old"), ("N2", "2", "old")])
    updates = frame("nct_id string, pmid string, pair_id string, similarity_score double, routing string", [("N1", "1", "N1_1", 0.7, "llm")])
    got = sorted((r["nct_id"], r["routing"]) for r in matching.attach_matches(linked, updates).collect())
    assert got == [("N1", "llm"), ("N2", None)]
    log = frame("pair_id string", [("N1_1",), (None,)])
    assert [r["nct_id"] for r in matching.unmatched_yet(linked, log).collect()] == ["N2"]


def test_upsert_prefers_new_rows(frame):
    old = frame("nct_id string, pmid string, v int", [("a", "1", 1), ("b", "1", 1)])
    new = frame("nct_id string, pmid string, v int", [("a", "1", 2), ("c", "1", 3)])
    got = sorted((r["nct_id"], r["v"]) for r in matching.upsert(old, new).collect())
    assert got == [("a", 2), ("b", 1), ("c", 3)]


GOOD = (
    '{"switch_type": "minor_modification", "direction": "timeframe_changed", "step_by_step_reasoning": '
    '"The follow-up window changed from twelve to nine months.", "confidence": "high", '
    '"comparability_for_pooling": true, "flag_for_human_review": false%s}'
)
ANSWERS = [
    ("ok", GOOD % ', "key_differences": ["window"]', True),
    ("no_list", GOOD % "", True),
    ("fenced", "```json\n" + GOOD % "" + "\n```", True),
    ("short", GOOD.replace("The follow-up window changed from twelve to nine months.", "Too short") % "", False),
    ("enum", GOOD.replace("timeframe_changed", "sideways") % "", False),
    ("missing", GOOD.replace('"confidence": "high", ', "") % "", False),
    ("text", "I cannot answer", False),
    ("null", None, False),
]


def test_answers(frame):
    df = frame("pair_id string, raw string", [(a, b) for a, b, _ in ANSWERS])
    got = {r["pair_id"]: r for r in matching.parse_adjudications(df).collect()}
    for name, _, valid in ANSWERS:
        assert got[name]["llm_valid"] is valid, name
    assert got["ok"]["key_differences"] == ["window"] and got["no_list"]["key_differences"] == []
    assert got["short"]["llm_switch_type"] is None and got["short"]["llm_flag"] is True
    assert got["ok"]["llm_flag"] is False


def test_requests_only_for_ambiguous_pairs(frame):
    schema = "pair_id string, routing string, registered_endpoint string, published_endpoint string, bc_subtype string, bc_setting string"
    df = frame(schema, [("a", "llm", " OS  at 5 y ", "none", "", "adjuvant"), ("b", "auto_concordant", "x", "y", "", "")])
    (r,) = matching.pair_requests(df).collect()
    assert r["pair_id"] == "a"
    assert r["request"].startswith("Compare two endpoints of one study (unknown_subtype; adjuvant).\n")
    assert "\nAs registered: OS at 5 y\nAs reported: \n" in r["request"]


@pytest.mark.parametrize("limit", [1000, 3])
def test_cost_ceiling(frame, limit):
    calls = frame("run string, seq int, p long, c long", [("a", i, 100_000, 10_000) for i in range(10)] + [("b", 0, 1000, 0)])
    cost = 100 * presets.COST_PER_1K_INPUT_USD + 10 * presets.COST_PER_1K_OUTPUT_USD
    costed = matching.running_cost(calls, ["run"], ["seq"], "p", "c", ceiling=3.5 * cost, parts=limit)
    got = {r["run"]: r for r in matching.cost_summary(costed, ["run"], ["seq"]).collect()}
    assert (got["a"]["stopped"], got["a"]["total_calls"]) == (True, 4)
    assert got["a"]["total_usd"] == pytest.approx(4 * cost)
    assert (got["b"]["stopped"], got["b"]["total_calls"]) == (False, 1)
