"""Every operator as a query over the star-schema test tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor import presets, schemas
from attestor.functions import extract, rules, text as tx, vectors
from attestor.operators import (
    agreement, gating, linkage, matching, ordered, pooling, power, relink, review, sampling, scorecard, summaries, text_index,
)
from attestor.plans.inputs import derived, table
from attestor.session import materialise, work_path
from attestor.sources import articles as xml, registry, stage_tables, tables
from attestor.streaming import review_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__.rstrip("_")] = f  # a trailing underscore avoids a module's name
    return f


def _rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) for n in names})


# ------------------------------------------------------------------ similarity and routing


def _neighbour_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the next one."""
    e = table(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"), "label")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    pairs = a.join(b, "vec_id").withColumn(
        "pair_id", tx.pair_key(F.format_string("NCT%08d", "vec_id"), F.col("vec_id") + 1)
    )
    return pairs.withColumn("similarity_score", F.round(vectors.cosine(F.col("a"), F.col("b")), 4))


@query
def pair_similarity_routing(spark, sf):
    pairs = _neighbour_pairs(spark, sf)
    score = F.col("similarity_score")
    return pairs.select("pair_id", "similarity_score", matching.switch_index(score).alias("ssi"), matching.route(score).alias("routing"))


@query
def best_candidate_similarity(spark, sf):
    """Registered texts list two vectors' names; the published text is the label's first vector."""
    e = table(spark, sf, "embeddings")
    name = F.concat(F.lit("vector "), F.col("vec_id"))
    first = e.groupBy("label").agg(F.min("vec_id").alias("head"))
    rows = e.join(first, "label").select(
        F.concat(F.lit("V"), F.col("vec_id")).alias("pair_id"),
        F.concat(name, F.lit(" | vector "), F.col("vec_id") + 1).alias("registered"),
        F.when(F.col("vec_id") == F.col("head"), "").otherwise(F.concat(F.lit(" vector  "), F.col("head"))).alias("published"),
    )
    texts = matching.candidate_pairs(rows, ["pair_id"], "registered", "published")
    known = e.select(name.alias("text"), "embedding")
    scored = matching.best_scores(rows, ["pair_id"], texts, known)
    return scored.select("pair_id", "similarity_score", matching.route(F.col("similarity_score")).alias("routing"))


@query
def routing_governance(spark, sf):
    return summaries.governance(derived(spark, sf, "log"))


@query
def routing_share(spark, sf):
    return summaries.routing_share(derived(spark, sf, "log"))


@query
def confidence_share(spark, sf):
    return summaries.shares(derived(spark, sf, "log"), "llm_confidence")


@query
def override_band(spark, sf):
    return summaries.override_band(derived(spark, sf, "log"))


@query
def score_histogram(spark, sf):
    log = derived(spark, sf, "log")
    outcome = F.coalesce(F.nullif("human_final_class", F.lit("")), F.lit("not yet reviewed"))
    return ordered.histogram(log.withColumn("outcome", outcome), "similarity_score", presets.SCORE_BINS, "outcome")


# ------------------------------------------------------------------ samples


@query
def stable_sample(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("pair_id"), "lang")
    return sampling.stable_sample(docs, presets.GOLD_SAMPLE_SIZE)


@query
def stratified_sample(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("pair_id"), "lang", "source")
    return sampling.stratified_sample(docs, 30, "lang", ("en", "fr", "de", "es"))


@query
def gold_template(spark, sf):
    return sampling.gold_template(derived(spark, sf, "log"))


@query
def gold_composition(spark, sf):
    log = derived(spark, sf, "log")
    return sampling.composition(sampling.gold_template(log), log)


@query
def gold_annotated(spark, sf):
    return sampling.annotated(derived(spark, sf, "gold"))


@query
def spot_check(spark, sf):
    return sampling.spot_check_pairs(derived(spark, sf, "log"))


@query
def second_rater(spark, sf):
    return sampling.second_rater_template(derived(spark, sf, "log"))


# ------------------------------------------------------------------ agreement


@query
def calibration_metrics(spark, sf):
    log = derived(spark, sf, "log")
    out = agreement.calibration(log, derived(spark, sf, "gold"))
    return out.withColumn("recommended_actions", F.array_join("recommended_actions", " "))


@query
def review_actions(spark, sf):
    return agreement.review_actions(agreement.calibration(derived(spark, sf, "log"), derived(spark, sf, "gold")))


@query
def inter_rater_kappa(spark, sf):
    return agreement.inter_rater(derived(spark, sf, "log"), derived(spark, sf, "gold"))


@query
def gold_matrix(spark, sf):
    return agreement.gold_matrix(derived(spark, sf, "log"), derived(spark, sf, "gold"))


@query
def class_heatmap(spark, sf):
    return summaries.class_heatmap(derived(spark, sf, "log"))


@query
def class_crosstab(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return agreement.crosstab(joined, F.col("lang"), F.concat("quality", F.lit("_"), "toxic"), ("0_0", "0_1", "1_0", "1_1"), "lang_code")


@query
def default_class(spark, sf):
    return derived(spark, sf, "log").select(
        "pair_id", agreement.default_class().alias("shown_class"), agreement.default_poolable().alias("shown_poolable"),
        agreement.ai_class().alias("ai_switch_type"),
    )


# ------------------------------------------------------------------ linkage


def _publications(spark: SparkSession, sf: str) -> DataFrame:
    empty_list = F.array().cast("array<string>")
    return derived(spark, sf, "link_pubs").withColumns(
        {"mesh_terms": empty_list, "abstract_sections": F.lit(None).cast("map<string,string>")}
    )


def _article_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every publication, and for every second one an earlier version or (for every sixth) a correction."""
    pubs = _publications(spark, sf).withColumn("version", F.lit(1))
    number = F.col("pmid").cast("bigint")
    again = pubs.filter(number % 2 == 0).withColumns(
        {
            "title": F.concat(F.when(number % 6 == 0, "Corrected: ").otherwise("Preprint: "), F.col("title")),
            "version": F.when(number % 6 == 0, 2).otherwise(0),
        }
    )
    return pubs.unionByName(again)


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    # Older versions of publications must neither multiply trials nor win.
    pubs = _article_versions(spark, sf).filter("version < 2")
    return linkage.link(derived(spark, sf, "link_trials"), pubs)


@query
def article_versions(spark, sf):
    return linkage.unique_articles(_article_versions(spark, sf)).select("pmid", "title", "version")


@query
def token_jaccard(spark, sf):
    t = derived(spark, sf, "link_trials").select(F.substring("nct_id", 4, 8).cast("bigint").alias("k"), "nct_id", "official_title")
    p = derived(spark, sf, "link_pubs").select((F.col("pmid").cast("bigint") - 20000000).alias("k"), "title")
    score = tx.jaccard(tx.title_tokens("official_title"), tx.title_tokens("title"))
    return t.join(p, "k").select("nct_id", score.alias("score"))


@query
def title_key_words(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "source", F.lit("of"), "lang", F.lit("titles:"), "n_chars").alias("t"))
    words = derived(spark, sf, "link_trials").select(F.substring("nct_id", 4, 8).cast("bigint").alias("doc_id"), F.col("official_title").alias("t"))
    both = docs.withColumn("kind", F.lit("document")).unionByName(words.withColumn("kind", F.lit("trial")))
    return both.select("kind", "doc_id", F.array_join(tx.title_key_words("t"), " ").alias("key_words"))


@query
def linkage_cascade(spark, sf):
    out = _linked(spark, sf)
    return out.select("nct_id", "pmid", "linkage_method", "linkage_confidence", "published_endpoint", "first_author", "pub_year", "journal", "linkage_flag", "title_score")


@query
def linkage_updates(spark, sf):
    """The cascade in two runs: the second brings one trial in ten, one article in ten, and the final text of one in eight."""
    trials, pubs = derived(spark, sf, "link_trials"), _article_versions(spark, sf).filter("version < 2")
    number, trial = F.col("pmid").try_cast("bigint"), F.substring("nct_id", 4, 8).try_cast("bigint")
    late, preprint = number % 10 == 3, (number % 8 == 0)
    early = pubs.filter(~late & F.when(preprint, F.col("version") == 0).otherwise(F.col("version") == 1))
    known = relink.first_linkage(trials.filter(trial % 10 != 4), early)
    now, _ = relink.relink(known, trials.filter(trial % 10 == 4), pubs.filter((late | preprint) & (F.col("version") == 1)))
    return now.linked.select("nct_id", "pmid", "linkage_method", "linkage_confidence", "published_endpoint", "first_author", "pub_year", "journal", "linkage_flag", "title_score")


@query
def linkage_notes(spark, sf):
    return linkage.linkage_audit(_linked(spark, sf)).select("nct_id", "pmid", "linkage_method", "linkage_confidence", "linked_by", "notes")


@query
def title_candidates(spark, sf):
    kept = gating.gate(_publications(spark, sf)).filter("kept").select("pmid", "title")
    trials = derived(spark, sf, "link_trials").select("nct_id", tx.first_text("official_title", "brief_title").alias("title"))
    return linkage.title_candidates(trials, materialise(kept))


@query
def unique_id_matches(spark, sf):
    return linkage.unique_id_matches(derived(spark, sf, "link_pubs"))


@query
def author_year_search(spark, sf):
    pubs = derived(spark, sf, "link_pubs")
    wanted = pubs.groupBy(F.col("authors")[0].alias("first_author")).agg(F.max("pub_year").alias("pub_year"))
    return linkage.author_year_matches(pubs, wanted)


@query
def linkage_confidence_summary(spark, sf):
    return summaries.linkage_summary(derived(spark, sf, "linkage_log"))


def _flagged_log(spark: SparkSession, sf: str) -> DataFrame:
    """The linkage log, some of its certain links flagged by hand."""
    by_hand = (F.col("linkage_method") == "fuzzy") & F.col("pmid").endswith("7")
    return derived(spark, sf, "linkage_log").withColumn("linkage_flag", F.when(by_hand, "check").otherwise(""))


@query
def linkage_kpis(spark, sf):
    return summaries.linkage_kpis(_flagged_log(spark, sf))


@query
def formatted_scores(spark, sf):
    """Numbers as the report shows them: a score with four decimals, and the share of a group that was reviewed."""
    log = derived(spark, sf, "log")
    done = F.count_if(F.col("human_reviewed") != "no")
    shares = log.groupBy("routing").agg(tx.fmt_pct(done, F.count(F.lit(1))).alias("reviewed"), tx.fmt_pct(done, F.lit(0)).alias("of_none"))
    shown = F.when(F.col("human_reviewed") == "no", "none").otherwise(F.col("similarity_score").cast("string"))
    return log.select("pair_id", "routing", tx.fmt_num(shown, 3).alias("score")).join(shares, "routing")


@query
def linkage_queue(spark, sf):
    return review.linkage_queue(_flagged_log(spark, sf)).select(
        "nct_id", "pmid", "linkage_confidence", "linkage_method"
    )


@query
def links_of(spark, sf):
    """All links of the first and the last trial of the log, each as one text."""
    log = derived(spark, sf, "linkage_log")
    ends = log.agg(F.min("nct_id"), F.max("nct_id")).first()
    return summaries.links_of(log, ends[0]).unionByName(summaries.links_of(log, ends[1]))


@query
def audit_append_once(spark, sf):
    """The linkage log appended in two batches, one of them twice, beside a batch whose writer failed."""
    path, log = work_path(spark, "audit-once"), derived(spark, sf, "linkage_log")
    for part, rows in (("manual", log.filter("linkage_method = 'manual'")), ("rest", log.filter("linkage_method <> 'manual'"))):
        tables.append_once(rows, path, part)
    tables.append_once(log.filter("linkage_method <> 'manual'"), path, "rest")
    tables.stamped(log, "created_at").write.parquet(f"{path}/rows/batch=b-failed")
    return tables.read_appended(spark, path).groupBy("pipeline_version", "linkage_method", "linkage_confidence").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("created_at").isNull()).alias("unstamped"), F.max("nct_id").alias("last_nct")
    )


@query
def audit_append(spark, sf):
    """The linkage log appended to an audit log in two batches, then read whole."""
    path, log = work_path(spark, "audit"), derived(spark, sf, "linkage_log")
    tables.append_log(log.filter("linkage_method = 'manual'"), path)
    tables.append_log(log.filter("linkage_method <> 'manual'"), path)
    rows = spark.read.parquet(path)
    return rows.groupBy("pipeline_version", "linkage_method", "linkage_confidence").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("created_at").isNull()).alias("unstamped"), F.max("nct_id").alias("last_nct")
    )


@query
def log_export(spark, sf):
    """Two logs exported as text tables, filtered, and read back."""
    logs = {"linkage": derived(spark, sf, "linkage_log"), "calls": derived(spark, sf, "calls").withColumn("nct_id", F.lit("NCT1"))}
    paths = tables.export_logs(logs, work_path(spark, "export"), F.col("nct_id") != "NCT00000001")
    back = tables.read_text_table(spark, paths[0], ["nct_id", "pmid", "linkage_confidence"])
    calls = tables.read_text_table(spark, paths[1], ["user_id", "prompt_tokens"])
    return back.groupBy(F.lit("linkage").alias("log"), F.col("linkage_confidence").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.max("pmid").alias("last")
    ).unionByName(calls.groupBy(F.lit("calls").alias("log"), F.col("nct_id").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("prompt_tokens").alias("last")))


@query
def first_trials(spark, sf):
    return registry.first_trials(derived(spark, sf, "link_trials"), 25).select("nct_id", "official_title", "completion_date")


@query
def row_rules(spark, sf):
    """Linkage and power rows with spelling and range problems, and the rules they break."""
    links = derived(spark, sf, "linkage_log").withColumns(
        {
            "nct_id": F.when(F.col("pmid").endswith("1"), F.concat(F.lit("  "), F.lower("nct_id"))).when(F.col("pmid").endswith("2"), F.concat(F.lit("X"), F.col("nct_id"))).otherwise(F.col("nct_id")),
            "linkage_method": F.when(F.col("pmid").endswith("3"), "guess").otherwise(F.col("linkage_method")),
            "linkage_confidence": F.when(F.col("pmid").endswith("4"), F.lit(None)).otherwise(F.col("linkage_confidence")),
        }
    )
    checked = schemas.validate(schemas.normalise_trial_id(links), schemas.linkage_rules())
    trials = derived(spark, sf, "power_trials").select(
        "nct_id", F.col("enrollment").try_cast("double").alias("enrollment"), F.lit(0.8).alias("assumed_hr"),
        F.coalesce("event_rate", F.lit(1.5)).alias("assumed_event_rate"), F.lit(0.05).alias("alpha"),
        F.when(F.col("registration_date").contains("/"), 1.0).otherwise(0.8).alias("power"),
    )
    tested = schemas.validate(trials, schemas.power_rules())

    def counted(df: DataFrame, kind: str) -> DataFrame:
        found = df.groupBy(F.array_join("violations", ",").alias("violations"))
        return found.agg(F.count(F.lit(1)).alias("n"), F.min("nct_id").alias("first_nct")).select(F.lit(kind).alias("kind"), "violations", "n", "first_nct")

    return counted(checked, "linkage").unionByName(counted(tested, "power"))


@query
def linkage_log_view(spark, sf):
    return review.linkage_log_view(derived(spark, sf, "linkage_log"))


@query
def linkage_counts(spark, sf):
    return summaries.category_counts(derived(spark, sf, "linkage_log"), "linkage_confidence", "linkage_method")


@query
def link_review_fold(spark, sf):
    """Manual link decisions from events, applied to the linkage rows of orders."""
    linked = derived(spark, sf, "linkage_log").groupBy("nct_id").agg(
        F.max("pmid").alias("pmid"), F.min("linkage_method").alias("linkage_method"),
        F.min("linkage_confidence").alias("linkage_confidence"),
    ).withColumns({c: F.lit("") for c in ("linkage_notes", "linkage_flag", "published_endpoint", "journal")})
    return review.fold_link_reviews(linked, _link_events(spark, sf), _publications(spark, sf), ["ts", "event_id"])


def _link_events(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"view": "Unlinked", "click": "High", "signup": "Medium", "error": "Low"}
    confidence = F.lit("none")
    for event, value in kinds.items():
        confidence = F.when(F.col("event_type") == event, value).otherwise(confidence)
    return table(spark, sf, "events").select(
        "event_id", "ts", F.format_string("NCT%08d", "user_id").alias("nct_id"), confidence.alias("linkage_confidence"),
        F.when(F.col("value") < 40, "").otherwise((F.col("user_id") + 20000000).cast("string")).alias("pmid"),
        F.lit("xy").alias("reviewer_initials"), F.concat(F.lit("checked "), F.col("event_type")).alias("notes"),
    )


@query
def link_resolution(spark, sf):
    """Manual link decisions from events: the resolved trials of orders are matched anew, all others keep their results."""
    linked = derived(spark, sf, "linkage_log").groupBy("nct_id").agg(
        F.max("pmid").alias("pmid"), F.min("linkage_method").alias("linkage_method"),
        F.min("linkage_confidence").alias("linkage_confidence"),
    ).withColumns({c: F.lit("") for c in ("linkage_notes", "linkage_flag", "published_endpoint", "journal")})
    linked = linked.withColumn("primary_outcomes", F.lit("Primary outcome was reached"))
    old = linked.select("nct_id", "pmid", F.lit("old").alias("pair_id"), F.lit(0.123).alias("similarity_score"), F.lit("kept").alias("routing"))
    return review.resolve_links(linked, _link_events(spark, sf), _publications(spark, sf), old).matches


@query
def link_audit(spark, sf):
    return review.link_review_audit(_link_events(spark, sf))


# ------------------------------------------------------------------ article gate


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    a = derived(spark, sf, "articles")
    return a.withColumns(
        {
            "abstract_sections": F.when(F.col("section_label") != "", F.create_map("section_label", "section_text")),
            "authors": F.array(F.lit("Doe")),
            "secondary_ids": F.array().cast("array<string>"),
        }
    )


def _gate_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "pmid", "article_type", "verdict", "confidence", "tier", "flag_for_review", "reject_score", "accept_score",
        "reason", F.array_join("signals", "; ").alias("signals"), "kept",
    )


@query
def article_gate(spark, sf):
    return _gate_columns(gating.gate(_articles(spark, sf)))


@query
def article_gate_merged(spark, sf):
    verdicts = gating.parse_arbiter(derived(spark, sf, "verdict_answers"))
    return _gate_columns(gating.gate(_articles(spark, sf), verdicts)).drop("signals")


@query
def arbiter_verdicts(spark, sf):
    out = gating.parse_arbiter(derived(spark, sf, "verdict_answers"))
    return out.withColumn("signals", F.array_join("signals", "; "))


@query
def arbiter_requests(spark, sf):
    return gating.arbiter_requests(gating.heuristic_gate(_articles(spark, sf)))


# ------------------------------------------------------------------ text rules


@query
def population_classify(spark, sf):
    p = derived(spark, sf, "population")
    return rules.classify_population(p, "title", F.col("conditions"), "eligibility").select(
        "nct_id", "population_class", "bc_subtype", "bc_setting"
    )


def _population(spark: SparkSession, sf: str) -> DataFrame:
    p = derived(spark, sf, "population")
    return rules.classify_population(p, "title", F.col("conditions"), "eligibility")


@query
def population_counts(spark, sf):
    return summaries.category_counts(registry.retained(_population(spark, sf)), "population_class", "bc_subtype", "bc_setting")


@query
def population_summary(spark, sf):
    return summaries.population_summary(_population(spark, sf))


@query
def endpoint_cluster(spark, sf):
    return scorecard.cluster_pairs(derived(spark, sf, "log"), "registered_endpoint")


@query
def cluster_sizes(spark, sf):
    return scorecard.cluster_lists(scorecard.cluster_pairs(derived(spark, sf, "log"), "registered_endpoint"))


@query
def published_endpoint(spark, sf):
    return extract.published_endpoint(_articles(spark, sf), "abstract_text", "abstract_sections").select("pmid", "published_endpoint")


@query
def flat_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.flatten_markup("html").alias("flat_text"))


@query
def text_filter(spark, sf):
    log = derived(spark, sf, "log")
    return review.filtered_log(
        log, {"routing": ["llm"], "llm_confidence": ["low", "medium"]}, search="Survival (at|\\(PFS)|order 1"
    ).select("pair_id", "llm_confidence")


@query
def document_search(spark, sf):
    docs = table(spark, sf, "documents")
    return review.filtered_log(docs, {"lang": ["en", "de", "fr", "es"]}, search="licen[cs]e|copyright", search_in=["text"]).select("doc_id", "lang")


@query
def document_search_indexed(spark, sf):
    """The same search through a trigram index of all whole documents, and one that needs a scan."""
    docs, path = table(spark, sf, "documents"), work_path(spark, "grams")
    text_index.write_index(docs, path, "doc_id", ["text"])
    known = docs.filter(F.col("lang").isin("en", "de", "fr", "es"))
    found = [text_index.search(spark, known, path, "doc_id", p, ["text"]).select("doc_id", "lang", F.lit(p).alias("pattern")) for p in ("licen[cs]e|copyright", "v[0-9]")]
    return found[0].unionByName(found[1])


# ------------------------------------------------------------------ effect extraction


@query
def hr_extract(spark, sf):
    return extract.effect_measures(extract.extract_effects(derived(spark, sf, "linked_lines")))


@query
def hr_extract_audit(spark, sf):
    return extract.extraction_audit(extract.extract_effects(derived(spark, sf, "linked_lines")))


@query
def hr_extract_summary(spark, sf):
    return summaries.extraction_summary(extract.extract_effects(derived(spark, sf, "linked_lines")))


@query
def hr_extract_sections(spark, sf):
    """Effects from labelled results sections, and from the whole abstract where there is none."""
    lines = derived(spark, sf, "linked_lines")
    labelled = F.substring("registration_date", 10, 1).cast("int") % 2 == 0
    filled = F.trim("abstract_text") != ""
    rows = lines.withColumns(
        {
            "sections": F.when(labelled & filled, F.create_map(F.lit("METHODS"), F.lit("HR 0.70 (95% CI 0.60-0.80)"), F.lit("RESULTS"), F.col("abstract_text"))),
            "abstract_text": F.when(filled, "Earlier work: HR 0.90 (95% CI 0.80-1.10).").otherwise(F.col("abstract_text")),
        }
    )
    found = extract.extract_effects(rows, "sections")
    return found.select("pair_id", "hr", "hr_lci", "hr_uci", "log_hr", "se_log_hr", "extraction_method", "outcome")


def _with_fields(raw: DataFrame) -> DataFrame:
    return raw.withColumns(extract.effect_fields(F.col("hr"), F.col("hr_lci"), F.col("hr_uci")))


def _order_effects(spark: SparkSession, sf: str) -> DataFrame:
    e = derived(spark, sf, "order_effects")
    e = e.filter(extract.interval_problem(F.col("hr"), F.col("hr_lci"), F.col("hr_uci")).isNull())
    return _with_fields(e).filter("se_log_hr > 0 AND variance > 0")


def _supplier_effects(spark: SparkSession, sf: str) -> DataFrame:
    return _with_fields(derived(spark, sf, "supplier_effects")).filter("se_log_hr > 0")


@query
def effect_sizes(spark, sf):
    return _order_effects(spark, sf).select("pair_id", "hr", "hr_lci", "hr_uci", "log_hr", "se_log_hr", "variance")


@query
def effect_validation(spark, sf):
    """Plausibility reasons of all measured effects, and the row rules they break."""
    e = derived(spark, sf, "order_effects")
    e = _with_fields(e).withColumn("variance", F.col("variance") + F.when(F.col("hr") > 3, 0.001).otherwise(0.0))
    kind = F.when(F.col("hr_lci").isNull(), "missing").when(~((F.col("hr_lci") < F.col("hr")) & (F.col("hr") < F.col("hr_uci"))), "order").when(
        extract.interval_problem(F.col("hr"), F.col("hr_lci"), F.col("hr_uci")).isNotNull(), "range"
    )
    checked = schemas.validate(e, schemas.effect_rules())
    return checked.select("pair_id", F.coalesce(kind, F.lit("")).alias("problem"), F.array_join("violations", ",").alias("violations"))


@query
def decision_validation(spark, sf):
    log = derived(spark, sf, "log").withColumn("ssi", F.col("ssi") + F.when(F.col("o_orderkey") % 6 == 0, 0.5).otherwise(0.0))
    log = log.withColumn("override_reason", F.when(F.col("o_custkey") % 2 == 0, F.col("override_reason")).otherwise(""))
    checked = schemas.validate(log, schemas.decision_rules())
    return checked.select("pair_id", F.array_join("violations", ",").alias("violations"))


# ------------------------------------------------------------------ pooling and power


@query
def pool_full(spark, sf):
    return _rounded(pooling.pool(_supplier_effects(spark, sf), ["endpoint_cluster"]), 5)


@query
def pool_overall(spark, sf):
    return _rounded(pooling.pool(_supplier_effects(spark, sf)), 5)


@query
def pool_sequential(spark, sf):
    return _rounded(pooling.pool_prefixes(_supplier_effects(spark, sf)), 5).drop("pair_id")


@query
def pool_sequential_grouped(spark, sf):
    out = pooling.pool_prefixes(_supplier_effects(spark, sf), ["endpoint_cluster"], interval=False)
    return _rounded(out.select("endpoint_cluster", "nct_id", "n_trials", "mu_mean", "tau_mean", "tau_sd"), 5)


@query
def posterior_hdi(spark, sf):
    """The 95 % highest-density interval of the pooled log ratio per cluster."""
    pooled = pooling.pool(_supplier_effects(spark, sf), ["endpoint_cluster"])
    ends = {"mu_lower": F.ln("pooled_hr_cri_lower"), "mu_upper": F.ln("pooled_hr_cri_upper")}
    return _rounded(pooled.select("endpoint_cluster", *[v.alias(n) for n, v in ends.items()]), 5)


@query
def refresh_matches(spark, sf):
    """Matches of all orders, compared again for the trials that user events mention."""
    linked = derived(spark, sf, "endpoint_texts")
    old = linked.select("nct_id", "pmid", tx.pair_key("nct_id", "pmid").alias("pair_id"), F.lit(0.123).alias("similarity_score"), F.lit("kept").alias("routing"))
    changed = table(spark, sf, "events").select(F.concat(F.lit("NCT"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("nct_id"))
    out = matching.refresh_matches(linked, changed, old)
    return out.select("nct_id", "pmid", "pair_id", "similarity_score", "routing")


@query
def pool_clusters(spark, sf):
    effects = _order_effects(spark, sf).join(_poolable_clusters(spark, sf), "pair_id")
    return _rounded(pooling.pool(effects, ["endpoint_cluster"]), 5)


def _poolable_clusters(spark: SparkSession, sf: str) -> DataFrame:
    log = derived(spark, sf, "log").filter(F.lower("human_poolable") == "true")
    return scorecard.cluster_pairs(log, "registered_endpoint")


@query
def poolable_semi(spark, sf):
    return pooling.poolable_effects(_order_effects(spark, sf), derived(spark, sf, "log"), ["confirm", "override"]).select("pair_id", "log_hr", "se_log_hr")


@query
def variance_median(spark, sf):
    variances = scorecard.cluster_pairs(derived(spark, sf, "log"), "registered_endpoint").join(
        _order_effects(spark, sf).select("pair_id", "variance"), "pair_id"
    )
    return _rounded(ordered.grouped_median(variances, ["endpoint_cluster"], "variance", "sigma2"), 8)


def _power(spark: SparkSession, sf: str) -> DataFrame:
    prefixes = pooling.pool_prefixes(_supplier_effects(spark, sf), interval=False)
    return power.power_audit(derived(spark, sf, "power_trials"), prefixes)


@query
def power_back_calc(spark, sf):
    t = derived(spark, sf, "power_trials").withColumn("n", F.col("enrollment").try_cast("double").cast("bigint"))
    rate = F.coalesce("event_rate", F.lit(presets.EVENT_RATE))
    return t.filter("n > 0").select("nct_id", power.implied_ratio(F.col("n"), rate).alias("assumed_hr"))


@query
def power_audit_asof(spark, sf):
    return _rounded(_power(spark, sf).drop("alpha", "power", "inputs_source", "optimism_bias"), 5, "posterior_hr_at_registration")


@query
def power_kpis(spark, sf):
    return power.power_kpis(_power(spark, sf))


@query
def power_excluded(spark, sf):
    return power.excluded_trials(_power(spark, sf))


@query
def power_scatter(spark, sf):
    return _rounded(power.scatter_bounds(power.scatter_pairs(_power(spark, sf))), 4)


@query
def bias_histogram(spark, sf):
    return ordered.histogram(_power(spark, sf), "optimism_bias", presets.BIAS_BINS, bounds=(-2.0, 1.0))


# ------------------------------------------------------------------ review


@query
def review_fold(spark, sf):
    out = review.fold_reviews(derived(spark, sf, "review_log"), derived(spark, sf, "review_events"), ["ts", "event_id"])
    return out.select("pair_id", "routing", *schemas.HUMAN_COLUMNS).drop("review_timestamp")


@query
def review_rejects(spark, sf):
    _, bad = review.checked_reviews(derived(spark, sf, "review_events"), derived(spark, sf, "review_log"))
    return bad.select("event_id", "pair_id", F.array_join("violations", ",").alias("violations"))


@query
def review_fold_stream(spark, sf):
    """The review fold over the event table read as a file stream."""
    raw = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events = raw.select(
        "event_id", "ts", F.concat(F.lit("NCT"), F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lit("_1")).alias("pair_id"),
        F.when(F.col("event_type") == "view", "defer").when(F.col("event_type") == "signup", "exclude")
        .when(F.col("event_type") == "error", "override").otherwise("confirm").alias("human_decision"),
        F.get(F.array(*[F.lit(t) for t in (*presets.SWITCH_TYPES, "concordant")]), (F.floor("value") % 5).cast("int")).alias("human_final_class"),
        (F.col("value") > 60).alias("human_poolable"),
        F.when((F.col("event_type") == "view") & (F.col("value") < 10), " ").otherwise(" ab").alias("reviewer_initials"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 20), "Composite changed").otherwise("").alias("override_reason"),
    )
    out, marks = work_path(spark, "review-state"), work_path(spark, "review-marks")
    review_stream.run_fold(events, out, marks)
    state = review_stream.current_state(spark, out)
    return state.select("pair_id", "event_id", "human_decision", "human_final_class", "human_poolable", "override_reason")


@query
def pending_queue(spark, sf):
    return review.pending_queue(derived(spark, sf, "log")).select("pair_id", "similarity_score", "routing", "spot_check")


@query
def review_triggers(spark, sf):
    log = derived(spark, sf, "log")
    queue = review.pending_queue(log)
    return queue.select("pair_id", F.array_join(review.review_triggers(F.col("spot_check")), " ").alias("triggers"))


@query
def recent_reviews(spark, sf):
    return review.recent_reviews(derived(spark, sf, "log")).select("pair_id", "review_timestamp", "human_decision")


@query
def reviewed_by(spark, sf):
    return summaries.distinct_values(derived(spark, sf, "log"), "reviewer_initials")


@query
def log_view(spark, sf):
    wanted = [
        "pair_id", "routing", "similarity_score", "llm_switch_type", "llm_confidence", "human_decision",
        "human_final_class", "human_poolable", "reviewer_initials", "review_timestamp", "not_there",
    ]
    return review.existing_columns(derived(spark, sf, "log"), wanted)


@query
def select_or_first(spark, sf):
    """A chosen row of the log, and the first one where the choice is not there."""
    log = derived(spark, sf, "log").select("pair_id", "routing", "similarity_score")
    last = log.agg(F.max("pair_id")).first()[0]
    hit, miss = (review.select_or_first(log, "pair_id", key, ["pair_id"]) for key in (last, "not there"))
    return hit.withColumn("choice", F.lit("last")).unionByName(miss.withColumn("choice", F.lit("missing")))


@query
def overview_kpis(spark, sf):
    log = derived(spark, sf, "log")
    return summaries.overview(log, review.in_queue(sampling.in_spot_check(log)))


@query
def review_kpis(spark, sf):
    return summaries.review_kpis(derived(spark, sf, "log"))


@query
def provenance(spark, sf):
    return summaries.provenance(derived(spark, sf, "log"), derived(spark, sf, "linkage_log"))


@query
def linkage_entries(spark, sf):
    return summaries.linkage_entries(derived(spark, sf, "linkage_log"))


@query
def trial_meta(spark, sf):
    """Facts for the pairs of all orders, from linked trials where they exist, else the registry."""
    trials = derived(spark, sf, "link_trials")
    linked = trials.filter("ctgov_pmid <> ''").withColumns({"pmid": F.col("ctgov_pmid"), "linkage_confidence": F.lit("High"), "linkage_method": F.lit("direct"), "journal": F.lit("J")})
    keys = table(spark, sf, "orders").select(
        F.format_string("NCT%08d", "o_custkey").alias("nct_id"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise((F.col("o_custkey") + 20000000).cast("string")).alias("pmid"),
    )
    return summaries.trial_meta(keys, linked, trials).select("nct_id", "asked_pmid", "title", "pmid", "enrollment", "completion_date", "linkage_confidence", "from_linked")


# ------------------------------------------------------------------ incremental


def _matched_orders(spark: SparkSession, sf: str) -> DataFrame:
    log = derived(spark, sf, "log")
    return log.select(tx.pair_nct("pair_id").alias("nct_id"), tx.pair_pmid("pair_id").alias("pmid"), "pair_id", "similarity_score", "routing", "o_orderkey", "o_custkey")


@query
def resume_anti(spark, sf):
    done = derived(spark, sf, "review_log").select("pair_id")
    todo = derived(spark, sf, "link_trials").select("nct_id", "official_title")
    return matching.unmatched_yet(todo, done)


@query
def upsert_in_buckets(spark, sf):
    """The last line of each order into the table of old results, in two batches that rewrite only the buckets they touch."""
    path = work_path(spark, "buckets")
    old = _matched_orders(spark, sf).select("nct_id", F.lit("old").alias("routing"), F.lit(0).alias("line"), F.lit(0.0).alias("score"))
    stage_tables.write_buckets(old, path, ["nct_id"], 16)
    line = F.struct("l_linenumber", "l_quantity")
    new = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(line).alias("last")).select(
        F.format_string("NCT%08d", "l_orderkey").alias("nct_id"), F.lit("new").alias("routing"),
        F.col("last.l_linenumber").alias("line"), F.col("last.l_quantity").alias("score"), "l_orderkey",
    )
    for odd in (0, 1):
        stage_tables.upsert_buckets(new.filter(F.col("l_orderkey") % 2 == odd).drop("l_orderkey"), path, ["nct_id"], 16)
    return stage_tables.read_buckets(spark, path)


@query
def upsert_keep_last(spark, sf):
    """Old results from orders, new ones per line item; the last line of an order wins."""
    old = _matched_orders(spark, sf).select("nct_id", F.lit("old").alias("routing"), F.lit(0).alias("line"), F.lit(0.0).alias("score"))
    new = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("score")).select(
        F.format_string("NCT%08d", "l_orderkey").alias("nct_id"), F.lit("new").alias("routing"), F.col("l_linenumber").alias("line"), "score"
    )
    return matching.upsert(old, new, ["nct_id"], "line")


@query
def left_updates(spark, sf):
    orders = _matched_orders(spark, sf)
    updates = orders.filter(F.col("routing") != "auto_major_switch").select("nct_id", "pmid", "pair_id", "similarity_score", "routing")
    linked = orders.select("nct_id", "pmid", F.lit("stale").alias("routing"), "o_custkey")
    return matching.attach_matches(linked, updates)


@query
def running_cost_ceiling(spark, sf):
    out = matching.running_cost(derived(spark, sf, "calls"), ["user_id"], ["ts", "event_id"], "prompt_tokens", "completion_tokens", ceiling=1.0)
    return _rounded(out.select("user_id", "event_id", "cost_usd", "total_usd", "total_calls", "over_ceiling"), 8)


@query
def cost_summary(spark, sf):
    out = matching.running_cost(derived(spark, sf, "calls"), ["user_id"], ["ts", "event_id"], "prompt_tokens", "completion_tokens", ceiling=1.0)
    return matching.cost_summary(out, ["user_id"], ["ts", "event_id"], digits=8)


# ------------------------------------------------------------------ requests, answers, embeddings


@query
def prompt_requests(spark, sf):
    log = derived(spark, sf, "log").withColumns({"bc_subtype": F.when(F.col("o_custkey") % 2 == 0, "tnbc").otherwise(""), "bc_setting": F.lit("adjuvant")})
    return matching.pair_requests(log)


@query
def response_parse(spark, sf):
    out = matching.parse_adjudications(derived(spark, sf, "answers"))
    return out.withColumn("key_differences", F.array_join("key_differences", "; "))


@query
def embed_hook(spark, sf):
    """Unit vectors for all distinct document texts with the dense embedder: length and norm."""
    texts = table(spark, sf, "documents").select("text").distinct()
    v = vectors.hashed_embedding(texts, "text")
    return v.select(F.md5("text").alias("text_key"), F.size("embedding").alias("dims"), F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))


@query
def user_embedder(spark, sf):
    """A user's own function over all distinct texts, in batches: length, number of e, and first code point."""
    texts = table(spark, sf, "documents").select("text").distinct()
    vectors_ = vectors.embed_with(texts, "text", lambda batch: [[len(t), t.count("e"), ord(t[0]) if t else 0] for t in batch])
    return vectors_.select(F.md5("text").alias("text_key"), *[F.get("embedding", F.lit(i)).cast("bigint").alias(f"v{i}") for i in range(3)])


@query
def match_endpoints(spark, sf):
    """Endpoint texts of all orders compared by the offline embedder (word counts)."""
    linked = derived(spark, sf, "endpoint_texts")
    return matching.match_endpoints(linked).select("pair_id", "similarity_score", "ssi", "routing")


# ------------------------------------------------------------------ sources


def _study_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Registry documents from parts: nested as the registry delivers them."""
    p = derived(spark, sf, "population").join(derived(spark, sf, "link_trials").select("nct_id", "completion_date", "ctgov_pmid", "enrollment"), "nct_id")

    def s(**fields):
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    refs = F.filter(
        F.array(
            s(type=F.lit("DERIVED"), pmid=F.lit("300")), s(type=F.lit("DERIVED"), pmid=F.lit("x1")),
            F.when(F.col("ctgov_pmid") != "", s(type=F.lit("RESULT"), pmid=F.col("ctgov_pmid"))),
        ),
        lambda r: r.isNotNull(),
    )
    date = F.when(F.col("completion_date") == "2015-06", "2015-06-30").otherwise(F.col("completion_date"))
    no = F.substring("nct_id", 4, 8).cast("bigint")
    return p.select(
        s(
            identificationModule=s(nctId=F.col("nct_id"), officialTitle=F.col("title")),
            designModule=s(studyType=F.when(no % 11 == 0, "OBSERVATIONAL").otherwise("INTERVENTIONAL"), phases=F.when(no % 7 == 0, F.array(F.lit("PHASE1"))).otherwise(F.array(F.lit("PHASE2"), F.lit("PHASE3"))), enrollmentInfo=s(count=F.col("enrollment").cast("bigint"))),
            outcomesModule=s(primaryOutcomes=F.array(s(measure=F.lit("Overall survival")), s(measure=F.col("primary_outcomes")))),
            statusModule=s(
                overallStatus=F.when(no % 13 == 0, "RECRUITING").otherwise("COMPLETED"), completionDateStruct=s(date=date),
                studyFirstSubmitDate=F.lit("2010-01-01"), resultsFirstPostedDateStruct=s(date=F.when(no % 17 != 0, "2018-01-01")),
            ),
            conditionsModule=s(conditions=F.concat("conditions", F.array(F.when(no % 19 == 0, "Asthma").otherwise("Breast Cancer")))),
            eligibilityModule=s(eligibilityCriteria=F.col("eligibility")),
            referencesModule=s(references=refs),
        ).alias("protocolSection")
    )


@query
def registry_json(spark, sf):
    """Study documents derived from parts are written as JSON, scanned, filtered and flattened."""
    path = work_path(spark, "studies")
    _study_documents(spark, sf).write.json(path)
    return registry.read_trials(spark, path, today=dt.date(2026, 1, 1)).select(
        "nct_id", "official_title", "phase", "enrollment", "primary_outcomes", "completion_date", "ctgov_pmid",
        "population_class", "bc_subtype", "bc_setting",
    )


def _article_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Article elements from documents: whole texts as abstract parts."""
    a = derived(spark, sf, "articles").join(
        table(spark, sf, "documents").select(F.concat(F.lit("1"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("pmid"), "lang"), "pmid"
    )

    def s(**fields):
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    value = lambda c: s(_VALUE=c)
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    return a.select(
        s(
            PMID=value(F.col("pmid")),
            Article=s(
                ArticleTitle=F.col("title"),
                Abstract=s(AbstractText=F.array(s(_Label=F.lit("Background"), _VALUE=F.lit("Why.")), s(_Label=F.col("section_label"), _VALUE=clean(F.col("abstract_text"))))),
                AuthorList=s(Author=F.array(s(LastName=F.lit("Doe")), s(LastName=F.lit(" ")), s(LastName=F.col("lang")))),
                Journal=s(Title=F.col("journal"), JournalIssue=s(PubDate=s(Year=F.when(F.col("lang") == "en", F.col("pub_year")), MedlineDate=F.concat("pub_year", F.lit(" Jan-Feb"))))),
                PublicationTypeList=s(PublicationType=F.transform(F.array_append("pub_types", F.get("pub_types", 0)), value)),
            ),
            MeshHeadingList=s(MeshHeading=F.transform("mesh_terms", lambda m: s(DescriptorName=value(m)))),
        ).alias("MedlineCitation")
    )


@query
def article_xml(spark, sf):
    """Article documents derived from documents are written as XML, scanned and projected."""
    path = work_path(spark, "articles")
    _article_documents(spark, sf).write.format("xml").option("rootTag", "PubmedArticleSet").option("rowTag", xml.ROW_TAG).option("attributePrefix", "_").option("valueTag", "_VALUE").save(path)
    out = xml.to_publications(xml.read_articles(spark, path))
    return out.select(
        "pmid", "title", F.length("abstract_text").alias("abstract_chars"), F.md5("abstract_text").alias("abstract_md5"),
        F.array_join(F.array_sort(F.map_keys("abstract_sections")), ",").alias("section_labels"),
        F.array_join("authors", ",").alias("authors"), "pub_year", "journal",
        F.array_join("mesh_terms", ",").alias("mesh_terms"), F.array_join("pub_types", ",").alias("pub_types"),
    )


@query
def csv_all_string(spark, sf):
    """Whole documents through the all-string CSV log form and back, one column missing."""
    path = work_path(spark, "log-csv")
    docs = table(spark, sf, "documents").select(F.col("doc_id"), "text", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    tables.write_text_table(docs, path)
    back = tables.read_text_table(spark, path, ["doc_id", "text", "lang", "notes"])
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "notes")


@query
def effect_array_json(spark, sf):
    """Effect measures as one file with one JSON array, read back in splits."""
    path = work_path(spark, "effect-array")
    tables.write_effect_array(extract.effect_measures(extract.extract_effects(derived(spark, sf, "linked_lines"))), path)
    return tables.read_effects(spark, path, multi_line=True).groupBy("extraction_method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("log_hr"), 4).alias("log_hr"), F.min("registration_date").alias("first_date")
    )


@query
def csv_one_file(spark, sf):
    """Conversation turns, whose texts have line feeds, as a single CSV file that is read in splits."""
    path = work_path(spark, "one-csv")
    tables.write_text_table(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").coalesce(1), path)
    back = tables.read_text_table(spark, path, ["conv_id", "turn", "role", "text"])
    lines = F.size(F.split("text", "\n")).alias("lines")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), lines)


@query
def effect_json(spark, sf):
    path = work_path(spark, "effects")
    tables.write_effects(extract.effect_measures(extract.extract_effects(derived(spark, sf, "linked_lines"))), path)
    return tables.read_effects(spark, path).groupBy("extraction_method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("log_hr"), 4).alias("log_hr"), F.min("registration_date").alias("first_date")
    )


# ------------------------------------------------------------------ scorecard


@query
def scorecard_(spark, sf):
    """The flagship: clusters, log metrics, per-cluster pooling, median variance, bias, strength."""
    log = derived(spark, sf, "log")
    rows = materialise(scorecard.with_cluster(log).select(*scorecard.LOG_COLUMNS))
    effects = materialise(_order_effects(spark, sf).select("pair_id", "log_hr", "se_log_hr"))
    approved = pooling.poolable_effects(rows.select("pair_id", "endpoint_cluster").join(effects, "pair_id"), rows)
    pooled = pooling.pool(approved, ["endpoint_cluster"])
    card = scorecard.build_scorecard(rows, derived(spark, sf, "linkage_log"), pooled, effects, _power(spark, sf))
    return _rounded(card, 5, "pooled_hr", "pooled_hr_cri_lower", "pooled_hr_cri_upper", "between_trial_tau")


@query
def scorecard_parity(spark, sf):
    """Without pooling, and with agreement counted over all rows."""
    log = derived(spark, sf, "log")
    card = scorecard.build_scorecard(scorecard.with_cluster(log), derived(spark, sf, "linkage_log"), parity=True)
    return card.select(*schemas.SCORECARD_COLUMNS[:8], "evidence_strength")


@query
def shared_posterior(spark, sf):
    """The full-data posterior handed to every cluster that has an approved pair."""
    log = derived(spark, sf, "log")
    clusters = scorecard.cluster_pairs(log, "registered_endpoint")
    return _rounded(pooling.broadcast_posterior(clusters, log, pooling.pool(_supplier_effects(spark, sf))), 5)
