"""Sampling, agreement metrics and review queues on the three-row log."""

import pytest
from pyspark.sql import functions as F

from attestor import presets
from attestor.operators import agreement, review, sampling, summaries

LOG_SCHEMA = ", ".join(
    f"{c} string"
    for c in (
        "pair_id", "routing", "llm_switch_type", "llm_confidence", "llm_flag", "human_reviewed", "human_final_class",
        "human_poolable", "registered_endpoint", "published_endpoint",
    )
)
LOG = [
    ("NCT001_111", "auto_concordant", "", "", "", "yes", "concordant", "True", "All-cause mortality at 12 months", "All-cause mortality at 12 months"),
    ("NCT002_222", "llm", "moderate_switch", "low", "True", "yes", "moderate_switch", "False", "Composite CV death or HF admission", "CV death only at 12 months"),
    ("NCT003_333", "auto_major_switch", "", "", "", "spot_check", "major_switch", "False", "Renal composite", "Quality of life score"),
]
PAIRS = [r[0] for r in LOG]
CLASSES = ["concordant", "moderate_switch", "major_switch"]


@pytest.fixture
def log(frame):
    return frame(LOG_SCHEMA, LOG)


def test_perfect_calibration(frame, log):
    gold = frame("pair_id string, gold_switch_type string", list(zip(PAIRS, CLASSES)) + [("NCT009_1", "concordant"), ("NCT001_111", "")])
    m = agreement.calibration(log, gold).first()
    assert (m["n_gold_standard_pairs"], m["auc"], m["precision_moderate_or_above"]) == (3, 1.0, 1.0)
    assert (m["recall_moderate_or_above"], m["low_confidence_flag_rate"], m["recommended_actions"]) == (1.0, 1.0, [])


def test_poor_calibration_recommends_actions(frame, log):
    gold = frame("pair_id string, gold_switch_type string", list(zip(PAIRS, ["major_switch", "concordant", "concordant"])))
    metrics = agreement.calibration(log, gold)
    m = metrics.first()
    assert (m["auc"], m["precision_moderate_or_above"], m["recall_moderate_or_above"]) == (0.0, 0.0, 0.0)
    actions = [r["action"] for r in agreement.review_actions(metrics).orderBy("no").collect()]
    assert actions == [presets.ACTIONS[k] for k in ("auc", "precision", "recall")]


def test_one_class_has_no_auc(frame, log):
    gold = frame("pair_id string, gold_switch_type string", [(PAIRS[0], "concordant")])
    m = agreement.calibration(log, gold).first()
    assert m["auc"] is None and m["auc_target_met"] is True and m["low_confidence_flag_rate"] is None


def test_no_overlap_gives_no_row(frame, log):
    gold = frame("pair_id string, gold_switch_type string", [("x_1", "concordant")])
    assert agreement.calibration(log, gold).count() == 0


def test_kappa(frame, log):
    second = frame("pair_id string, second_switch_type string, second_poolable string", list(zip(PAIRS, CLASSES, ["True", "False", "False"])))
    m = agreement.inter_rater(log, second).first()
    assert tuple(m) == (3, 1.0, 100.0, 100.0)


def test_kappa_by_hand(frame):
    # 20 both yes, 5 a-only, 10 b-only, 15 both no: kappa 0.4
    rows = [("concordant", "concordant")] * 20 + [("concordant", "major_switch")] * 5 + [("major_switch", "concordant")] * 10 + [("major_switch", "major_switch")] * 15
    log = frame("pair_id string, human_final_class string, human_poolable string", [(f"p{i}", a, "True") for i, (a, _) in enumerate(rows)])
    second = frame("pair_id string, second_switch_type string, second_poolable string", [(f"p{i}", b, "no") for i, (_, b) in enumerate(rows)])
    m = agreement.inter_rater(log, second).first()
    assert (m["cohen_kappa"], m["classification_agreement_rate_pct"], m["poolable_agreement_rate_pct"]) == (0.4, 70.0, 0.0)


def test_gold_matrix(frame, log):
    gold = frame("pair_id string, gold_switch_type string", list(zip(PAIRS, CLASSES)))
    got = {r["ai_switch"]: r for r in agreement.gold_matrix(log, gold).collect()}
    assert got["moderate_switch"]["moderate_switch"] == 1 and got["moderate_switch"]["concordant"] == 0


def test_templates_are_blinded(log):
    gold = sampling.gold_template(log, 2)
    assert [r["pair_id"] for r in gold.collect()] == ["NCT001_111", "NCT003_333"]
    assert "gold_switch_type" in gold.columns and "llm_switch_type" not in gold.columns
    second = sampling.second_rater_template(log, 0.5)
    assert second.count() == 2 and "human_final_class" not in second.columns
    assert sampling.annotated(gold).first()["completed"] == 0


@pytest.mark.parametrize("n", [1, 2, 5, 8, 30, 100])
def test_stratified_sample_has_the_asked_size(frame, n):
    rows = [(f"p{i}", r) for i, r in enumerate(["llm"] * 30 + ["auto_concordant"] * 2 + ["other"] * 8)]
    got = sampling.stratified_sample(frame("pair_id string, routing string", rows), n)
    assert got.count() == got.select("pair_id").distinct().count() == min(n, 40)
    if n > 2:
        assert got.filter("routing = 'auto_concordant'").count() >= min(2, n // 3)


def test_stratified_sample_takes_the_head_of_each_stratum(frame):
    import hashlib

    rows = [(f"p{i}", r) for i, r in enumerate(["llm"] * 30 + ["auto_concordant"] * 2 + ["other"] * 8)]
    by_hash = sorted(rows, key=lambda r: (hashlib.sha256(r[0].encode()).hexdigest()[:16], r[0]))
    quota = {r[0] for s in ("llm", "auto_concordant") for r in [x for x in by_hash if x[1] == s][:4]}
    rest = [r[0] for r in by_hash if r[0] not in quota][: 12 - len(quota)]
    got = {r["pair_id"] for r in sampling.stratified_sample(frame("pair_id string, routing string", rows), 12).collect()}
    assert got == quota | set(rest)


def test_spot_check_samples_automatic_rows_only(log):
    assert {r[0] for r in sampling.spot_check_pairs(log, 1.0).collect()} == {"NCT001_111", "NCT003_333"}
    assert sampling.spot_check_pairs(log, 0.1).count() == 0


QUEUE = "pair_id string, routing string, llm_confidence string, llm_flag string, published_endpoint string, human_reviewed string, similarity_score string"


def test_pending_queue(frame):
    rows = [
        ("a", "auto_major_switch", "", "", "", "no", "0.2"),
        ("b", "llm", "", "", "x", "no", ""),
        ("c", "auto_concordant", "", "", "x", "no", "0.97"),
        ("d", "llm", "", "", "x", "yes", "0.6"),
        ("e", "auto_concordant", "LOW", "", "x", "no", "0.95"),
        ("f", "auto_concordant", "", "True", "x", "no", "0.91"),
    ]
    df = frame(QUEUE, rows)
    assert [r["pair_id"] for r in review.pending_queue(df, F.lit(False)).collect()] == ["a", "f", "e", "b"]
    queued = review.pending_queue(df, F.col("pair_id") == "c")
    assert [r["pair_id"] for r in queued.collect()] == ["a", "f", "e", "c", "b"]
    triggers = queued.withColumn("llm_comparability", F.lit("False")).select("pair_id", review.review_triggers(F.col("spot_check")).alias("t"))
    got = {r["pair_id"]: len(r["t"]) for r in triggers.collect()}
    assert got == {"a": 2, "b": 2, "c": 2, "e": 2, "f": 2}


EVENTS = "event_id long, ts timestamp, pair_id string, human_decision string, human_final_class string, human_poolable boolean, reviewer_initials string, override_reason string"


def events(frame):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    return frame(
        EVENTS,
        [
            (1, t(1), "NCT001_111", "confirm", "concordant", True, " fo ", ""),
            (2, t(2), "NCT001_111", "override", "major_switch", False, "fo", "Composite changed"),
            (3, t(3), "NCT001_111", "override", "concordant", True, "fo", " "),
            (4, t(4), "NCT002_222", "defer", "minor_modification", True, "ab", ""),
            (5, t(5), "NONEXISTENT", "confirm", "concordant", True, "ab", ""),
            (6, t(6), "NCT003_333", "confirm", "concordant", True, "", ""),
        ],
    )


def test_review_fold(frame):
    log = frame("pair_id string, routing string", [("NCT001_111", "llm"), ("NCT002_222", "llm"), ("NCT003_333", "llm")])
    got = {r["pair_id"]: r for r in review.fold_reviews(log, events(frame), ["ts", "event_id"]).collect()}
    r = got["NCT001_111"]
    assert (r["human_reviewed"], r["human_decision"], r["human_final_class"], r["human_poolable"], r["reviewer_initials"]) == (
        "yes", "override", "major_switch", "False", "FO")
    assert got["NCT002_222"]["human_reviewed"] == "no" and got["NCT002_222"]["human_final_class"] == "minor_modification"
    assert got["NCT003_333"]["human_reviewed"] == "no" and got["NCT003_333"]["human_decision"] == ""
    _, bad = review.checked_reviews(events(frame), log)
    assert {r["event_id"]: r["violations"] for r in bad.collect()} == {3: ["override_reason"], 5: ["unknown_pair"], 6: ["reviewer_initials"]}


def test_spot_check_status(frame):
    log = frame("pair_id string, routing string", [("NCT001_111", "auto_concordant"), ("NCT002_222", "llm"), ("NCT004_444", "llm")])
    latest = review.latest_reviews(events(frame).filter("event_id in (2, 4)"))
    got = {r["pair_id"]: r["human_reviewed"] for r in review.apply_reviews(log, latest, F.col("pair_id") != "").collect()}
    # A deferred or missing review is no spot check.
    assert got == {"NCT001_111": "spot_check", "NCT002_222": "no", "NCT004_444": "no"}


def test_link_review_fold(frame):
    linked = frame(
        "nct_id string, pmid string, linkage_method string, linkage_confidence string, abstract_text string, published_endpoint string, "
        "first_author string, pub_year string, journal string, linkage_notes string, linkage_flag string",
        [("N1", "", "manual", "Unlinked", "", "", "", "", "", "n", "FLAGGED_FOR_REVIEW"), ("N2", "2", "direct", "High", "t", "e", "A", "2020", "J", "n", "")],
    )
    reviews = frame(
        "ts int, nct_id string, pmid string, linkage_confidence string, reviewer_initials string, notes string",
        [(1, "N1", " 7 ", "High", "ab", "found it"), (2, "N1", "", "High", "ab", "no pmid"), (3, "N2", "x", "Unlinked", "ab", "")],
    )
    pubs = frame(
        "pmid string, abstract_text string, abstract_sections map<string,string>, authors array<string>, pub_year string, journal string",
        [("7", "The primary outcome was met. End", None, ["Doe", "Roe"], "2019", "J7")],
    )
    got = {r["nct_id"]: r for r in review.fold_link_reviews(linked, reviews, pubs, ["ts"]).collect()}
    assert (got["N1"]["pmid"], got["N1"]["linkage_method"], got["N1"]["linkage_flag"], got["N1"]["published_endpoint"]) == ("7", "manual", "", "primary outcome was met")
    assert (got["N2"]["pmid"], got["N2"]["linkage_method"]) == ("2", "direct")
    assert [r["linked_by"] for r in review.link_review_audit(reviews).collect()] == ["reviewer:AB"]


def test_filters_and_views(frame, log):
    assert [r["pair_id"] for r in review.filtered_log(log, {"routing": ["llm"]}).collect()] == ["NCT002_222"]
    assert review.filtered_log(log, {"routing": []}, search="MORTALITY|renal").count() == 2
    assert review.existing_columns(log, ["pair_id", "nope"]).columns == ["pair_id"]
    assert review.select_or_first(log, "pair_id", "NCT003_333", ["pair_id"]).first()["pair_id"] == "NCT003_333"
    assert review.select_or_first(log, "pair_id", "zzz", ["pair_id"]).first()["pair_id"] == "NCT001_111"


def test_orders(frame):
    links = frame("nct_id string, pmid string, linkage_confidence string, linkage_method string", [("N1", "1", "High", "direct"), ("N2", "", "Unlinked", "manual"), ("N3", "3", "Odd", "x"), ("N0", "4", "Low", "y")])
    assert [r["nct_id"] for r in review.linkage_log_view(links).collect()] == ["N2", "N0", "N1", "N3"]
    queue = review.linkage_queue(links.withColumn("linkage_flag", F.lit("")))
    assert [r["nct_id"] for r in queue.collect()] == ["N0", "N2"]
    assert summaries.links_of(links, "N2").first()["all_links"] == "PMID Not available (manual / Unlinked)"


def test_governance(frame, log):
    r = summaries.governance(log.withColumn("human_decision", F.lit("override"))).first()
    assert (r["total_pairs"], r["pct_llm"], r["human_review_rate_pct"], r["human_override_rate_pct"], r["confidence_low_pct"]) == (3, 33.3, 100.0, 100.0, 100.0)
    assert summaries.governance(log.withColumn("human_decision", F.lit("")).filter("false")).count() == 0
    band = summaries.override_band(log.withColumn("human_decision", F.lit("confirm"))).first()
    assert band["band"] == "low"
