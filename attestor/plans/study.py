"""The whole study: link, match, extract, pool, audit and score, one written stage after another."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from attestor.functions.extract import effect_measures, extract_effects
from attestor.functions.vectors import word_vectors
from attestor.operators import linkage, matching, pooling, power, review, scorecard
from attestor.sources.tables import write_stage


def run_study(
    trials: DataFrame,
    publications: DataFrame,
    reviews: Callable[[DataFrame], DataFrame],
    folder: str,
    embedder: Callable[[DataFrame, str], DataFrame] = word_vectors,
    verdicts: DataFrame | None = None,
    adjudications: DataFrame | None = None,
    shared_posterior: bool = False,
    order: Sequence[str] = review.EVENT_ORDER,
) -> dict[str, DataFrame]:
    """All stages as written tables, by name.

    ``reviews`` maps the decision log to the review events known for it (people answer between two
    runs); ``adjudications`` has the parsed answers for ambiguous pairs. A rerun of a later stage
    reads the earlier ones from ``folder``.
    """
    spark = trials.sparkSession

    def stage(name: str, df: DataFrame) -> DataFrame:
        return write_stage(df, f"{folder.rstrip('/')}/{name}")

    linked = stage("linked", linkage.link(trials, publications, verdicts))
    linkage_log = stage("linkage_log", linkage.linkage_audit(linked))

    matched = stage("matched", matching.match_endpoints(linked, embedder=embedder))
    answers = adjudications
    if answers is None:
        none = spark.createDataFrame([], "pair_id string, raw string")
        answers = matching.parse_adjudications(none)
    decisions = stage("decisions", matching.decision_entries(matched, answers, "none"))
    log = stage("log", review.fold_reviews(decisions, reviews(decisions), order))

    effects = stage("effects", effect_measures(extract_effects(linked, "abstract_sections" if "abstract_sections" in linked.columns else None)))
    approved = stage("poolable", pooling.poolable_effects(effects, log))
    clusters = stage("clusters", scorecard.cluster_pairs(log, "registered_endpoint"))
    prefixes = stage("sequential", pooling.pool_prefixes(approved))
    audit = stage("power_audit", power.power_audit(trials, prefixes))

    if shared_posterior:
        pooled = pooling.broadcast_posterior(clusters, log, pooling.pool(approved))
    else:
        pooled = pooling.pool(approved.join(clusters, "pair_id"), ["endpoint_cluster"])
    card = scorecard.build_scorecard(scorecard.with_cluster(log), linkage_log, stage("pooled", pooled), effects, audit)
    return {
        "linked": linked, "linkage_log": linkage_log, "matched": matched, "log": log, "effects": effects,
        "sequential": prefixes, "power_audit": audit, "scorecard": stage("scorecard", card),
    }
