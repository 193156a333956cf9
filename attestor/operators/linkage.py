"""Record linkage: registered trials to publications, as one set-at-a-time cascade.

Stages, first success wins: the reference the investigators submitted; the only article that
carries the trial's identifier; the most similar title (high band); the same in the medium band,
confirmed or not by the years. Every publication passes the article gate before it can be linked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attestor import presets
from attestor.functions.extract import published_endpoint
from attestor.functions.text import first_text, fixed, text, title_tokens, year_in, years_agree
from attestor.operators.gating import gate
from attestor.operators.ordered import keep_latest
from attestor.operators.similarity_join import distinct_sets, nearest_sets
from attestor.schemas import LINK_COLUMNS as LINK_FIELDS
from attestor.session import materialise, shuffled


def unique_articles(publications: DataFrame, order: Sequence[str] = ("version",)) -> DataFrame:
    """One row per identifier: the latest version, where the table has one; rows that tie go by a hash of their columns.

    Baseline and update files repeat identifiers; a join on them must not multiply trials.
    """
    known = [c for c in order if c in publications.columns]
    rows = publications if known else publications.withColumn("_version", F.lit(0))
    return keep_latest(rows, ["pmid"], known or ["_version"]).select(*publications.columns)


def submitted_matches(trials: DataFrame, kept: DataFrame) -> DataFrame:
    """Trials whose submitted reference exists and passed the gate: ``(nct_id, pmid)``."""
    asked = trials.filter(F.trim(text("ctgov_pmid")) != "").select("nct_id", F.trim("ctgov_pmid").alias("pmid"))
    return asked.join(shuffled(kept.select("pmid")), "pmid", "left_semi").select("nct_id", "pmid")


def unique_id_matches(publications: DataFrame) -> DataFrame:
    """Trial ids carried by exactly one publication, whether or not that one passed the gate."""
    carried = publications.select("pmid", F.explode("secondary_ids").alias("nct_id"))
    hits = carried.groupBy("nct_id").agg(F.min("pmid").alias("pmid"), F.max("pmid").alias("_last"))
    return hits.filter(F.col("pmid") == F.col("_last")).select("nct_id", "pmid")


def pmid_order(pmid: Column) -> Column:
    return F.struct(F.coalesce(pmid.try_cast("bigint"), F.lit(2**62)).alias("no"), pmid.alias("pmid"))


def title_matches(trials: DataFrame, kept: DataFrame, threshold: float = presets.JACCARD_MEDIUM) -> DataFrame:
    """The best title match per trial token set: ``(tokens, pmid, score)`` with score >= threshold.

    Equal scores go to the smallest identifier. All publications are considered; identical titles
    are compared once.
    """
    wanted = distinct_sets(trials.select(title_tokens("title").alias("t")), "t")
    best = nearest_sets(wanted, offered_titles(kept), threshold)
    return best.select("tokens", F.col("payload.pmid").alias("pmid"), "score")


def offered_titles(kept: DataFrame) -> DataFrame:
    """Distinct title token sets, each with its first publication in identifier order."""
    titled = kept.select("pmid", F.array_sort(title_tokens("title")).alias("tokens")).filter(F.size("tokens") > 0)
    return titled.groupBy("tokens").agg(F.min(pmid_order(F.col("pmid"))).alias("payload"))


def title_candidates(
    trials: DataFrame, kept: DataFrame, k: int = presets.SEARCH_RESULTS, threshold: float = presets.JACCARD_MEDIUM
) -> DataFrame:
    """Top-``k`` report: the most similar distinct titles per trial, with their first publication."""
    wanted = trials.select("nct_id", F.array_sort(title_tokens("title")).alias("tokens"))
    best = nearest_sets(distinct_sets(wanted, "tokens"), offered_titles(kept), threshold, k)
    return wanted.join(shuffled(best), "tokens").select("nct_id", "rank", F.col("payload.pmid").alias("pmid"), "score")


def author_year_matches(publications: DataFrame, wanted: DataFrame) -> DataFrame:
    """Publications by first author and year for ``wanted(first_author, pub_year)`` rows."""
    first = publications.select("pmid", F.try_element_at("authors", F.lit(1)).alias("first_author"), "pub_year")
    keyed = wanted.select("first_author", "pub_year").distinct()
    return first.join(keyed, ["first_author", "pub_year"]).select("first_author", "pub_year", "pmid")


JUDGED = ("pmid", "title", "secondary_ids", "kept", "gate_note")


def judge(publications: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The gate's narrow result per publication: it reads every abstract, so it is written once."""
    return gate(publications, verdicts).select(*JUDGED)


def staged_ids(trials: DataFrame, judged: DataFrame) -> DataFrame:
    """Trials with ``title``, the results of the id stages, and the ``_tokens`` to search for.

    Trials that need no title search (and later those without any link) get a key of their own in ``_tokens``,
    so that they spread over the join's tasks instead of meeting in the one for NULL.
    """
    kept = judged.filter("kept")
    base = trials.withColumn("title", first_text("official_title", "brief_title"))
    s0 = submitted_matches(base, kept).withColumnRenamed("pmid", "_pmid0").distinct()
    s1 = unique_id_matches(judged).join(shuffled(kept.select("pmid")), "pmid", "left_semi").withColumnRenamed("pmid", "_pmid1")
    staged = base.join(shuffled(s0), "nct_id", "left").join(shuffled(s1), "nct_id", "left")
    tokens = F.array_sort(title_tokens("title"))
    searched = F.col("_pmid0").isNull() & F.col("_pmid1").isNull() & (F.col("title") != "") & (F.size(tokens) > 0)
    return staged.withColumn("_searched", searched).withColumn("_tokens", F.when(searched, tokens).otherwise(F.array(_own_key())))


def _own_key() -> Column:
    return F.concat(F.lit("#"), F.col("nct_id"))


def link(trials: DataFrame, publications: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Trials with their link columns, one row per trial.

    Only ids and scores go through the matching joins; the articles' texts are joined at the end.
    """
    # Written once: the gate reads it, and the texts of linked articles come from it.
    publications = materialise(unique_articles(publications))
    judged = materialise(judge(publications, verdicts))
    staged = staged_ids(trials, judged)
    s2 = title_matches(staged.filter("_searched").select("title"), judged.filter("kept")).select(
        F.col("tokens").alias("_tokens"), F.col("pmid").alias("_pmid2"), F.col("score").alias("title_score")
    )
    return described(staged.join(shuffled(s2), "_tokens", "left"), publications, judged, trials.columns)


def described(staged: DataFrame, publications: DataFrame, judged: DataFrame, trial_columns: Sequence[str]) -> DataFrame:
    """Link columns from the results of all stages, with the linked articles' texts."""
    kept, own_key = judged.filter("kept"), _own_key()
    articles = publications.select(
        F.col("pmid").alias("_key"), F.col("title").alias("_article_title"), "abstract_text", "abstract_sections",
        F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("")).alias("first_author"),
        "pub_year", "journal",
    ).join(shuffled(kept.select(F.col("pmid").alias("_key"), "gate_note")), "_key")
    picked = (
        staged.drop(*[c for c in LINK_FIELDS if c in trial_columns])
        .withColumn("pmid", F.coalesce("_pmid0", "_pmid1", "_pmid2"))
        .withColumn("_key", F.coalesce("pmid", own_key))
    )
    linked = picked.join(shuffled(articles), "_key", "left")

    expected = year_in("completion_date")
    high = F.col("title_score") >= presets.JACCARD_HIGH
    direct = F.col("_pmid0").isNotNull() | F.col("_pmid1").isNotNull()
    by_title = F.col("_pmid2").isNotNull()
    years_ok = years_agree(F.col("pub_year"), expected)
    method = F.when(direct, "direct").when(by_title & high, "fuzzy").when(by_title, "author_date").otherwise("manual")
    confidence = (
        F.when(direct | (by_title & high), "High")
        .when(by_title & years_ok, "Medium")
        .when(by_title, "Low")
        .otherwise("Unlinked")
    )
    score = fixed(F.col("title_score"), 3)
    note = F.col("gate_note")
    notes = (
        F.when(
            F.col("_pmid0").isNotNull(),
            F.concat(F.lit("Submitted with the results: PMID "), F.col("_pmid0"), F.lit(". "), note),
        )
        .when(
            F.col("_pmid1").isNotNull(),
            F.concat(F.lit("Only article that carries the trial's id (PMID "), F.col("_pmid1"), F.lit("). "), note),
        )
        .when(
            by_title & high,
            F.concat(
                F.lit("Title similarity "), score, F.lit(f" reaches {presets.JACCARD_HIGH}. Article: "),
                F.col("_article_title"), F.lit(". "), note,
            ),
        )
        .when(
            by_title & years_ok,
            F.concat(
                F.lit("Title similarity "), score, F.lit(", published "), text("pub_year"),
                F.lit(" against completion "), text(expected), F.lit(", first author '"), text("first_author"),
                F.lit("'. Article: "), F.col("_article_title"), F.lit(". "), note,
            ),
        )
        .when(
            by_title,
            F.concat(
                F.lit("Years disagree: published '"), text("pub_year"), F.lit("', completed '"), text(expected),
                F.lit("' (from '"), text("completion_date"), F.lit("'). Title similarity "), score,
                F.lit(". To be checked. "), note,
            ),
        )
        .when(F.col("title") == "", "The trial has no title to search for.")
        .otherwise(f"No article title reaches a similarity of {presets.JACCARD_MEDIUM}.")
    )
    linked = linked.withColumns(
        {"linkage_method": method, "linkage_confidence": confidence, "linkage_notes": notes}
    )
    linked = published_endpoint(linked, "abstract_text", "abstract_sections")
    flag = F.when(F.col("linkage_confidence").isin("Low", "Unlinked"), presets.FLAG_TEXT).otherwise("")
    return linked.select(
        *[c for c in trial_columns if c not in LINK_FIELDS],
        text("pmid").alias("pmid"),
        "linkage_method", "linkage_confidence",
        text("abstract_text").alias("abstract_text"),
        "published_endpoint",
        text("first_author").alias("first_author"),
        text("pub_year").alias("pub_year"),
        text("journal").alias("journal"),
        "linkage_notes",
        flag.alias("linkage_flag"),
        "title_score",
    )


def linkage_audit(linked: DataFrame, linked_by: str = presets.VERSION_TAG) -> DataFrame:
    """One audit row per linkage decision."""
    return linked.select(
        "nct_id", F.nullif("pmid", F.lit("")).alias("pmid"), "linkage_method", "linkage_confidence",
        F.lit(linked_by).alias("linked_by"), F.col("linkage_notes").alias("notes"),
    )
