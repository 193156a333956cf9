"""Similarity search against brute force, the gate, and the linkage cascade."""

import random

import pytest
from pyspark.sql import functions as F

from attestor import presets
from attestor.operators import gating, linkage, similarity_join
from tests_support import PUB_SCHEMA, TRIAL_SCHEMA, publication

@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("threshold, rare_limit", [(0.5, 5), (0.5, 0), (0.7, 1000), (0.7, 12)])
def test_nearest_sets_equal_brute_force(spark, k, threshold, rare_limit):
    rng = random.Random(k * 10 + int(threshold * 10) + rare_limit)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(40)]

    def some():
        return tuple(sorted(set(rng.sample(common, rng.randint(0, 6)) + rng.sample(rare, rng.randint(1, 5)))))

    left, right = {some() for _ in range(150)}, {some() for _ in range(150)}
    left |= set(list(right)[:20])
    numbered = {s: i for i, s in enumerate(sorted(right))}
    want = {}
    for x in left:
        scored = []
        for y, i in numbered.items():
            score = round(len(set(x) & set(y)) / len(set(x) | set(y)) + 1e-12, 4)
            if score >= threshold:
                scored.append((-score, i))
        if scored:
            want[x] = [(i, -s) for s, i in sorted(scored)[:k]]
    wanted = spark.createDataFrame([(list(s),) for s in left], "tokens array<string>")
    offered = spark.createDataFrame([(list(s), i) for s, i in numbered.items()], "tokens array<string>, payload int")
    got = {}
    for r in similarity_join.nearest_sets(wanted, offered, threshold, k, rare_limit).orderBy("rank").collect():
        got.setdefault(tuple(r["tokens"]), []).append((r["payload"], r["score"]))
    assert got == want


def test_boilerplate_titles_meet_as_one_class(spark):
    """All titles share three words and differ in one: every pair scores 0.6, the first payload wins."""
    offered = spark.createDataFrame([(sorted(["study", "of", "drug", f"x{i}"]), 1000 + i) for i in range(400)], "tokens array<string>, payload int")
    wanted = spark.createDataFrame([(sorted(["study", "of", "drug", f"y{i}"]),) for i in range(400)], "tokens array<string>")
    got = similarity_join.nearest_sets(wanted, offered, 0.5, rare_limit=1).collect()
    assert len(got) == 400 and {(r["score"], r["payload"]) for r in got} == {(0.6, 1000)}


def titles(n, seed):
    """Half boilerplate around a few listed words, half words by Zipf's law; each with a word of its own."""
    rng = random.Random(seed)
    for i in range(n):
        if i % 2:
            words = ["randomized", "trial", "of", f"drug{rng.randrange(30)}", f"dose{rng.randrange(8)}", "in", f"arm{rng.randrange(6)}", "cancer"]
        else:
            words = [f"w{int(1 / (rng.random() + 1e-5))}" for _ in range(8)]
        yield sorted({*words, f"own{seed}_{i}"})


@pytest.mark.parametrize("k", [1, 5])
def test_pairs_met_grow_with_the_titles(spark, k):
    """Ten times the titles make about ten times the pairs, and no key holds many of them."""
    met = []
    for n in (300, 3000):
        offered = spark.createDataFrame([(t, i) for i, t in enumerate(titles(n, 1))], "tokens array<string>, payload int")
        wanted = spark.createDataFrame([(t,) for t in titles(n, 2)], "tokens array<string>")
        counts = similarity_join.token_counts(offered)
        left, right = (similarity_join.with_words(similarity_join.in_search_order(df, counts)) for df in (wanted, offered))
        sizes = [similarity_join.set_sizes(df) for df in (left, right)]
        by_rare = similarity_join.rare_meetings(left, right, 0.6)
        classes = [df.filter("size(words) > 0").select("words", "own").distinct() for df in (left, right)]
        by_class = similarity_join._meeting(*[similarity_join._combination_keys(c, s, 0.6) for c, s in zip(classes, sizes[::-1])])
        met.append(by_rare.count() + by_class.count())
        if n == 3000:
            largest = by_rare.groupBy("a.key").count().agg(F.max("count")).first()[0] or 0
            assert largest <= similarity_join.RARE_LIMIT * n / 100
    assert met[1] <= 25 * met[0]


def test_long_titles_of_frequent_words_as_brute_force(spark):
    """Titles of 18 to 30 words that are all frequent: no word is rare, and pairs may differ in many."""
    rng = random.Random(4)
    vocabulary = [f"w{i:02d}" for i in range(40)]
    base = [rng.sample(vocabulary, rng.randint(18, 30)) for _ in range(12)]

    def near():
        words = set(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            words.discard(rng.choice(vocabulary))
            words.add(rng.choice(vocabulary))
        return tuple(sorted(words))

    left, right = {near() for _ in range(90)}, sorted({near() for _ in range(120)})
    want = {}
    for x in left:
        scored = sorted((-round(len(set(x) & set(y)) / len(set(x) | set(y)) + 1e-12, 4), i) for i, y in enumerate(right))
        want[x] = [(i, -s) for s, i in scored if -s >= 0.5][:2]
    wanted = spark.createDataFrame([(list(s),) for s in left], "tokens array<string>")
    offered = spark.createDataFrame([(list(s), i) for i, s in enumerate(right)], "tokens array<string>, payload int")
    counts = similarity_join.token_counts(offered)
    ordered = similarity_join.with_words(similarity_join.in_search_order(offered, counts, 0))
    keys = similarity_join._combination_keys(ordered.select("words", "own"), similarity_join.set_sizes(ordered), 0.5)
    assert keys.agg(F.min("length")).first()[0] >= 2
    got = {}
    for r in similarity_join.nearest_sets(wanted, offered, 0.5, 2, rare_limit=0).orderBy("rank").collect():
        got.setdefault(tuple(r["tokens"]), []).append((r["payload"], r["score"]))
    assert got == {x: w for x, w in want.items() if w}


def test_repeated_publications_give_one_row_per_trial(frame):
    versions = [publication("100", title="submitted paper"), publication("100", title="submitted paper"), publication("100", title="other title")]
    pubs = frame(PUB_SCHEMA, versions)
    trials = frame(TRIAL_SCHEMA, [("NCT01", "any", "", "2020", "100")])
    assert linkage.link(trials, pubs).count() == 1
    numbered = pubs.withColumn("version", F.when(F.col("title") == "other title", 3).otherwise(1))
    assert linkage.unique_articles(numbered).first()["title"] == "other title"


def test_search_without_offers(spark):
    wanted = spark.createDataFrame([(["a", "b"],)], "tokens array<string>")
    offered = spark.createDataFrame([], "tokens array<string>, payload int")
    assert similarity_join.nearest_sets(wanted, offered, 0.5).count() == 0


GATE = [
    (publication("1"), "accept", "high", "primary_results", True),
    (publication("2", pub_types=["Review", "Letter"]), "reject", "high", "systematic_review", False),
    (publication("3", title="Study  protocol of X"), "uncertain", "low", "unknown", True),
    (publication("4", title="Study protocol of X", pub_types=[], text="patients will be enrolled"), "reject", "medium", "unknown", True),
    (publication("5", pub_types=["Review", "Clinical Trial"], text="hazard ratio"), "uncertain", "low", "unknown", True),
    (publication("6", pub_types=[], text=""), "uncertain", "low", "unknown", True),
    (publication("7", pub_types=["Biography"]), "reject", "high", "unknown", False),
    (publication("8", mesh_terms=["Research Design"]), "uncertain", "low", "unknown", True),
    (publication("9", pub_types=None, text=None), "uncertain", "low", "unknown", True),
]


def test_gate(frame):
    out = {r["pmid"]: r for r in gating.gate(frame(PUB_SCHEMA, [g[0] for g in GATE])).collect()}
    for row, verdict, confidence, kind, kept in GATE:
        r = out[row[0]]
        assert (r["verdict"], r["confidence"], r["article_type"], r["kept"]) == (verdict, confidence, kind, kept), row[0]
    assert "No answer from the arbiter" in out["3"]["reason"]
    assert out["4"]["signals"] == ["title:REJECT:Study protocol", "abstract:REJECT:protocol_future_tense_language_detected"]


def test_results_section_is_named(frame):
    r = gating.gate(frame(PUB_SCHEMA, [publication("1", abstract_sections={"RESULTS": "x"})])).first()
    assert r["accept_score"] == 4 and r["reason"].endswith("It has a results section.")


def test_arbiter(frame):
    raw = [
        ("3", '```json\n{"verdict": "ACCEPT", "article_type": "primary_results", "confidence": "high", "reason": "ok"}\n```'),
        ("5", '{"verdict": "reject", "confidence": "high", "step1_signals": "' + "s" * 300 + '"}'),
        ("6", "not json"),
        ("8", '{"verdict": "perhaps", "article_type": "poem"}'),
    ]
    verdicts = gating.parse_arbiter(frame("pmid string, raw string", raw))
    got = {r["pmid"]: r for r in verdicts.collect()}
    assert set(got) == {"3", "5", "8"}
    assert (got["3"]["verdict"], got["3"]["flag_for_review"]) == ("accept", False)
    assert (got["5"]["verdict"], got["5"]["flag_for_review"]) == ("reject", True)
    assert f"Step1: {'s' * 300} |" in got["5"]["reason"]
    assert (got["8"]["verdict"], got["8"]["article_type"], got["8"]["confidence"]) == ("uncertain", "unknown", "low")
    merged = {r["pmid"]: r for r in gating.gate(frame(PUB_SCHEMA, [g[0] for g in GATE]), verdicts).collect()}
    assert (merged["3"]["tier"], merged["3"]["verdict"]) == ("llm", "accept")
    assert merged["5"]["kept"] is False
    assert merged["6"]["tier"] == "heuristic" and merged["1"]["tier"] == "heuristic"


def test_arbiter_requests(frame):
    rows = [publication("1"), publication("6", pub_types=[], text="")]
    got = gating.arbiter_requests(gating.heuristic_gate(frame(PUB_SCHEMA, rows))).collect()
    assert [r["pmid"] for r in got] == ["6"]
    assert presets.NO_ABSTRACT in got[0]["request"] and "{" not in got[0]["request"]


TITLE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
MEDIUM = "alpha beta gamma delta epsilon zeta one two three four"  # 6 of 14 words: 0.4286
CLOSE = "alpha beta gamma delta epsilon zeta eta one two three"  # 7 of 13 words: 0.5385


@pytest.fixture
def study(frame):
    pubs = [
        publication("100", title="submitted paper"),
        publication("101", title="by id", secondary_ids=["NCT02"]),
        publication("102", title="two ids a", secondary_ids=["NCT03"]),
        publication("103", title="two ids b", secondary_ids=["NCT03"]),
        publication("105", title=TITLE.replace("kappa", "lambda")),
        publication("104", title=TITLE.replace("kappa", "lambda")),
        publication("106", title="red orange yellow green blue indigo violet", year="2020"),
        publication("107", title="rejected words only here now", pub_types=["Editorial"]),
        publication("108", title=MEDIUM, pub_types=["Editorial"]),
    ]
    trials = [
        ("NCT01", "whatever title", "", "2020-01", "100"),
        ("NCT02", "some thing", "", "2020", ""),
        ("NCT03", "quite different words there", "", "", ""),
        ("NCT04", TITLE, "", "2020", "999"),
        ("NCT05", "red orange yellow green blue black white", "", "Jun 2018", ""),
        ("NCT06", "", "red orange yellow green blue black white", "2010-06", ""),
        ("NCT07", "", "", "2020", ""),
        ("NCT08", "rejected words only here now", "", "2020", "107"),
        ("NCT09", "nothing in common", "", "2020", ""),
        ("NCT10", "12 34", "", "2020", ""),
    ]
    return frame(TRIAL_SCHEMA, trials), frame(PUB_SCHEMA, pubs)


def test_cascade(study):
    trials, pubs = study
    out = linkage.link(trials, pubs).collect()
    got = {r["nct_id"]: (r["pmid"], r["linkage_method"], r["linkage_confidence"]) for r in out}
    assert got == {
        "NCT01": ("100", "direct", "High"),
        "NCT02": ("101", "direct", "High"),
        "NCT03": ("", "manual", "Unlinked"),
        "NCT04": ("104", "fuzzy", "High"),
        "NCT05": ("106", "author_date", "Medium"),
        "NCT06": ("106", "author_date", "Low"),
        "NCT07": ("", "manual", "Unlinked"),
        "NCT08": ("", "manual", "Unlinked"),
        "NCT09": ("", "manual", "Unlinked"),
        "NCT10": ("", "manual", "Unlinked"),
    }
    assert len(out) == trials.count()
    flags = {r["nct_id"]: r["linkage_flag"] for r in out}
    assert flags["NCT06"] == presets.FLAG_TEXT and flags["NCT05"] == ""
    notes = {r["nct_id"]: r["linkage_notes"] for r in out}
    assert notes["NCT05"].startswith("Title similarity 0.556, published ")
    assert "no title to search" in notes["NCT07"]
    assert linkage.linkage_audit(linkage.link(trials, pubs)).filter("pmid IS NULL").count() == 5


def test_title_candidates_rank_distinct_titles(study):
    trials, pubs = study
    kept = gating.gate(pubs).filter("kept")
    named = trials.withColumn("title", F.coalesce(F.nullif("official_title", F.lit("")), F.col("brief_title")))
    got = [(r["nct_id"], r["rank"], r["pmid"]) for r in linkage.title_candidates(named, kept).collect()]
    assert ("NCT04", 1, "104") in got and ("NCT05", 1, "106") in got


def test_author_year(study):
    _, pubs = study
    wanted = pubs.sparkSession.createDataFrame([("Doe", "2020"), ("Doe", "2020"), ("Roe", "2020")], "first_author string, pub_year string")
    assert linkage.author_year_matches(pubs, wanted).count() == pubs.count()


def test_growing_tables_are_not_sent_whole(study):
    trials, pubs = study
    plan = linkage.staged_ids(trials, linkage.judge(pubs))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("common", [0, 3])
def test_counts_of_common_tokens_come_another_way(spark, monkeypatch, common):
    rng = random.Random(5)
    sets = sorted({tuple(sorted(rng.sample([f"w{i}" for i in range(12)], 5))) for _ in range(60)})
    df = spark.createDataFrame([(list(s),) for s in sets], "tokens array<string>")
    counts = similarity_join.token_counts(df)
    monkeypatch.setattr(similarity_join, "COMMON_TOKENS", common)
    got = {tuple(r.tokens): r.ordered for r in similarity_join.in_search_order(df, counts).collect()}
    df_of = {r.token: r.df for r in counts.collect()}
    assert got == {s: sorted(s, key=lambda t: (df_of[t], t)) for s in sets}
