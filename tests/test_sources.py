"""Scans and sinks, the streaming fold, and the whole study."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from attestor import presets, schemas
from attestor.operators import review
from attestor.plans import study
from attestor.sources import articles, registry, tables
from attestor.streaming import review_stream


def document(nct, **more):
    proto = {
        "identificationModule": {"nctId": nct, "briefTitle": "Brief", "officialTitle": more.get("title", "Triple-negative breast cancer")},
        "designModule": {"studyType": more.get("type", "INTERVENTIONAL"), "phases": more.get("phases", ["PHASE3"]), "enrollmentInfo": {"count": 100}},
        "outcomesModule": {"primaryOutcomes": [{"measure": "OS"}, {"timeFrame": "x"}]},
        "statusModule": {
            "overallStatus": "COMPLETED", "completionDateStruct": {"date": more.get("done", "2020-05")}, "studyFirstSubmitDate": "2015-01-01",
            "resultsFirstPostedDateStruct": {"date": "2021-01-01"} if more.get("results", True) else {},
        },
        "conditionsModule": {"conditions": more.get("conditions", ["Metastatic Breast Cancer"])},
        "eligibilityModule": {},
        "referencesModule": {"references": [{"type": "RESULT", "pmid": "5"}, {"type": "DERIVED", "pmid": "1"}]},
    }
    return {"protocolSection": proto, "hasResults": True}


def test_registry(spark, tmp_path):
    docs = [
        document("NCT1"), document("NCT2", type="OBSERVATIONAL"), document("NCT3", phases=["PHASE1"]), document("NCT4", done="2001-01-01"),
        document("NCT5", results=False), document("NCT6", conditions=["Melanoma"]), document("XYZ7"), document("NCT8", title=""), document("NCT0", done="soon"),
    ]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(d) for d in docs))
    got = {r["nct_id"]: r for r in registry.read_trials(spark, str(tmp_path), dt.date(2026, 1, 1)).collect()}
    assert set(got) == {"NCT1", "NCT8"}
    r = got["NCT1"]
    assert (r["primary_outcomes"], r["secondary_outcomes"], r["ctgov_pmid"], r["phase"], r["start_date"]) == ("OS | ", "", "5", "PHASE3", "")
    assert (r["population_class"], r["bc_subtype"], r["bc_setting"]) == ("bc_confirmed", "tnbc", "metastatic")
    assert got["NCT8"]["bc_subtype"] == "unknown_subtype"
    assert registry.read_trials(spark, str(tmp_path), dt.date(2026, 1, 1), max_records=1).collect()[0]["nct_id"] == "NCT1"


XML = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article>
<Journal><Title>The Journal</Title><JournalIssue><PubDate><MedlineDate>1999 Dec-2000 Jan</MedlineDate></PubDate></JournalIssue></Journal>
<ArticleTitle>A <i>b</i>  c &lt; d</ArticleTitle>
<Abstract><AbstractText Label="Results" NlmCategory="RESULTS">We did <i>this</i>, p &lt; 0.05 <b>that</b>.</AbstractText>
<AbstractText>plain &amp; short</AbstractText><AbstractText Label="EMPTY"> </AbstractText><AbstractText Label="results">last</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName></Author><Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>Roe</LastName></Author></AuthorList>
<DataBankList><DataBank><DataBankName>ClinicalTrials.gov</DataBankName><AccessionNumberList><AccessionNumber>NCT1</AccessionNumber></AccessionNumberList></DataBank></DataBankList>
<PublicationTypeList><PublicationType UI="D1">Review</PublicationType><PublicationType UI="D1">Review</PublicationType></PublicationTypeList>
</Article><MedlineJournalInfo><MedlineTA>J Abbr</MedlineTA></MedlineJournalInfo>
<MeshHeadingList><MeshHeading><DescriptorName UI="D2">Humans</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><Title>Full</Title><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal>
<ArticleTitle>Plain</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>13</PMID><Article><ArticleDate><Year>2003</Year></ArticleDate></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    out = articles.to_publications(articles.read_articles(spark, str(tmp_path)))
    assert out.columns == schemas.PUBLICATION_SCHEMA.fieldNames()
    got = {r["pmid"]: r for r in out.collect()}
    r = got["11"]
    assert (r["title"], r["pub_year"], r["journal"]) == ("A b c < d", "1999", "J Abbr")
    assert r["abstract_text"] == "RESULTS: We did this, p < 0.05 that.\nplain & short\nRESULTS: last"
    assert r["abstract_sections"] == {"RESULTS": "last"}
    assert (r["authors"], r["mesh_terms"], r["pub_types"], r["secondary_ids"]) == (["Doe", "Roe"], ["Humans"], ["Review"], ["NCT1"])
    r = got["12"]
    assert (r["abstract_text"], r["abstract_sections"], r["pub_year"], r["journal"], r["pub_types"]) == ("", {}, "2001", "Full", [])
    assert (got["13"]["title"], got["13"]["pub_year"]) == ("", "2003")


def test_text_tables(spark, frame, tmp_path):
    path = str(tmp_path / "log")
    assert tables.read_text_table(spark, path, ["a", "b"]).columns == ["a", "b"]
    df = frame("a string, n int, flag boolean", [('say "hi",\nthen go', 1, True), ("", None, None)])
    tables.write_text_table(df, path)
    back = tables.read_text_table(spark, path, ["a", "n", "flag", "extra"])
    assert {tuple(r) for r in back.collect()} == {('say "hi",\nthen go', "1", "true", ""), ("", "", "", "")}
    assert tables.export_logs({"x": df, "y": df}, str(tmp_path / "out"), F.col("n") == 1) == [str(tmp_path / "out/x"), str(tmp_path / "out/y")]
    assert tables.read_text_table(spark, str(tmp_path / "out/y"), ["a"]).count() == 1


def test_effects_and_appends(spark, frame, tmp_path):
    row = ("p", "n", "1", 0.8, 0.7, 0.9, -0.2, 0.06, 0.0036, "m", "s", "2020-01-01")
    df = spark.createDataFrame([row], schemas.EFFECT_SCHEMA)
    tables.write_effects(df, str(tmp_path / "lines"))
    assert [tuple(r) for r in tables.read_effects(spark, str(tmp_path / "lines")).collect()] == [row]
    (tmp_path / "array.json").write_text(json.dumps([dict(zip(schemas.EFFECT_SCHEMA.fieldNames(), row))] * 2, indent=2))
    assert tables.read_effects(spark, str(tmp_path / "array.json"), multi_line=True).count() == 2
    log = str(tmp_path / "audit")
    tables.append_log(df.select("pair_id"), log)
    tables.append_log(df.select("pair_id"), log)
    got = spark.read.parquet(log)
    assert got.count() == 2 and got.first()["pipeline_version"] == presets.VERSION_TAG and got.filter("created_at IS NULL").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from attestor.streaming.review_stream import EVENT_SCHEMA, current_state, latest_per_pair, read_events, run_fold

    def event(i, pair, minute, decision="confirm", who="ab"):
        return (pair, decision, "concordant", True, who, "", dt.datetime(2024, 1, 1, 0, minute), i)

    first = [event(1, "a", 5), event(2, "b", 1), event(3, "a", 3, "exclude")]
    late = [event(4, "b", 9, "defer"), event(5, "a", 4, "exclude"), event(6, "c", 1, "override"), event(7, "d", 1, who=" "), event(8, "e", 1)]
    folder, out, marks = (str(tmp_path / n) for n in ("events", "state", "marks"))
    for batch in (first, late):
        spark.createDataFrame(batch, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run_fold(read_events(spark, folder), out, marks)
    got = {r["pair_id"]: r["event_id"] for r in current_state(spark, out).collect()}
    batch = {r["pair_id"]: r["event_id"] for r in latest_per_pair(spark.read.parquet(folder)).collect()}
    assert got == batch == {"a": 1, "b": 4, "e": 8}


def test_stream_snapshots_keep_the_state(spark, tmp_path):
    from attestor.streaming.review_stream import EVENT_SCHEMA, current_state, latest_per_pair, read_events, run_fold

    folder, out, marks = (str(tmp_path / n) for n in ("events", "state", "marks"))
    for i in range(5):
        rows = [(p, "confirm", "concordant", True, "ab", "", dt.datetime(2024, 1, 1, 0, (i * 7 + j) % 30), 10 * i + j) for j, p in enumerate("abc")]
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run_fold(read_events(spark, folder), out, marks, compact_every=2)
    assert {r[0] for r in spark.read.parquet(f"{out}/snapshots").select("upto").distinct().collect()} == {1, 3}
    got = {r["pair_id"]: r["event_id"] for r in current_state(spark, out).collect()}
    assert got == {r["pair_id"]: r["event_id"] for r in latest_per_pair(spark.read.parquet(folder)).collect()}


def test_whole_study(spark, frame, tmp_path):
    from tests_support import PUB_SCHEMA, TRIAL_SCHEMA, publication

    text = "RESULTS: The primary outcome overall survival was met (HR 0.%d; 95%% CI, 0.50-0.95). End"
    pubs = [publication(str(100 + i), title=f"paper {i}", text=text % (60 + i), year="2020") for i in range(8)]
    trials = [
        (f"NCT{i:02d}", f"trial {i}", "", "2019", str(100 + i), "Overall survival" if i < 5 else "Objective response rate", str(200 + i), f"20{10 + i}-01-01", "tnbc", "adjuvant")
        for i in range(9)
    ]
    t = frame(TRIAL_SCHEMA + ", primary_outcomes string, enrollment string, registration_date string, bc_subtype string, bc_setting string", trials)

    def reviews(log):
        return log.select(
            "pair_id", F.lit("confirm").alias("human_decision"), F.lit("concordant").alias("human_final_class"), F.lit(True).alias("human_poolable"),
            F.lit("ab").alias("reviewer_initials"), F.lit("").alias("override_reason"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.lit(1).alias("event_id"),
        )

    out = study.run_study(t, frame(PUB_SCHEMA, pubs), reviews, str(tmp_path))
    assert out["linked"].count() == 9 and out["effects"].count() == 8
    assert [r["n_trials"] for r in out["sequential"].orderBy("n_trials").collect()] == list(range(1, 9))
    card = {r["endpoint_cluster"]: r for r in out["scorecard"].collect()}
    assert set(card) == {"overall_survival", "objective_response_rate"}
    assert card["overall_survival"]["trials_included"] == 5 and card["overall_survival"]["evidence_strength"] == "Strong"
    assert card["objective_response_rate"]["evidence_strength"] == "Moderate"
    assert out["power_audit"].filter("posterior_hr_at_registration IS NOT NULL").count() == 8
    again = spark.read.parquet(str(tmp_path / "scorecard"))
    assert again.count() == 2


def test_shared_posterior(spark, frame):
    from attestor.operators import pooling

    clusters = frame("endpoint_cluster string, pair_id string", [("a", "p1"), ("b", "p2")])
    log = frame("pair_id string, human_poolable string", [("p1", "True"), ("p2", "")])
    posterior = frame("pooled_hr double, tau_mean double", [(0.8, 0.1)])
    assert [tuple(r) for r in pooling.broadcast_posterior(clusters, log, posterior).collect()] == [("a", 0.8, 0.1)]


def test_validation_of_schemas(frame):
    df = frame("pair_id string, similarity_score double, ssi double, routing string, human_decision string, override_reason string",
               [("a", 0.97, 3.0, "llm", None, None), ("b", 0.97, 3.2, "llm", "override", ""), ("c", 1.2, -20.0, "x", "confirm", None)])
    got = {r["pair_id"]: r["violations"] for r in schemas.validate(df, schemas.decision_rules()).collect()}
    assert got == {"a": [], "b": ["ssi_consistency", "override_reason"], "c": ["score_range", "routing"]}


def test_review_rules_are_shared():
    assert review_stream.review_rules is review.review_rules


def test_a_batch_is_appended_once(spark, tmp_path):
    path, rows = str(tmp_path / "audit"), spark.createDataFrame([("a",), ("b",)], "x string")
    assert tables.append_once(rows, path, "run-1") and not tables.append_once(rows, path, "run-1")
    assert tables.append_once(rows.limit(1), path, "0002")
    rows.withColumns({"pipeline_version": F.lit("v"), "created_at": F.current_timestamp()}).write.parquet(f"{path}/rows/batch=b-lost")
    assert tables.read_appended(spark, path).count() == 3
    assert tables.append_once(rows, path, "lost") and tables.read_appended(spark, path).count() == 5
    with pytest.raises(ValueError, match="token"):
        tables.append_once(rows, path, "a/b")
