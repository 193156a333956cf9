"""Human review: folding append-only review events into the log, queues and views.

The log itself is never updated in place. Decisions are one table, review events another, and the
current state is the latest valid event per pair joined to the decision rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from attestor import presets, schemas
from attestor.functions.extract import published_endpoint
from attestor.functions.text import matching_texts, number, text, truthy
from attestor.functions.vectors import word_vectors
from attestor.operators import matching
from attestor.operators.ordered import in_order, keep_latest
from attestor.operators.sampling import in_spot_check


def review_rules() -> dict[str, Column]:
    """What a review event must satisfy, apart from naming a known pair."""
    return {
        "human_decision": schemas.one_of("human_decision", presets.HUMAN_DECISIONS),
        "human_final_class": schemas.one_of("human_final_class", presets.SWITCH_TYPES),
        "reviewer_initials": F.trim(text("reviewer_initials")) != "",
        "override_reason": (F.col("human_decision") != "override") | (F.trim(text("override_reason")) != ""),
    }


def checked_reviews(events: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid events, rejects with violations)``; an unknown pair is a violation too."""
    good, bad = schemas.split_valid(events, review_rules())
    known = log.select("pair_id").distinct()
    unknown = good.join(known, "pair_id", "left_anti").withColumn("violations", F.array(F.lit("unknown_pair")))
    return good.join(known, "pair_id", "left_semi"), bad.unionByName(unknown)


#: Later events win; events of the same time go by their number.
EVENT_ORDER = ("ts", "event_id")


def latest_reviews(events: DataFrame, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """The human columns per pair, from its latest event; a deferred review leaves the pair unreviewed."""
    return review_columns(keep_latest(events, ["pair_id"], order))


def review_columns(last: DataFrame) -> DataFrame:
    """Latest events (one per pair) as human columns."""
    return last.select(
        "pair_id",
        F.when(F.col("human_decision") == "defer", "no").otherwise("yes").alias("human_reviewed"),
        "human_decision",
        "human_final_class",
        F.when(F.col("human_poolable"), "True").otherwise("False").alias("human_poolable"),
        F.trim(text("override_reason")).alias("override_reason"),
        F.upper(F.trim("reviewer_initials")).alias("reviewer_initials"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("review_timestamp"),
    )


def apply_reviews(log: DataFrame, reviews: DataFrame, spot: Column | None = None) -> DataFrame:
    """The log with its human columns replaced where a review exists; nothing else changes.

    A reviewed row for which ``spot`` holds is marked as a spot check.
    """
    new = reviews.withColumnsRenamed({c: f"_new_{c}" for c in schemas.HUMAN_COLUMNS})
    joined = (log if spot is None else log.withColumn("_spot", spot)).join(new, "pair_id", "left")
    seen = F.col("_new_human_reviewed").isNotNull()
    defaults = {"human_reviewed": F.lit("no")}
    out = {}
    for c in schemas.HUMAN_COLUMNS:
        old = F.col(c) if c in log.columns else defaults.get(c, F.lit(""))
        value = F.col(f"_new_{c}")
        if c == "human_reviewed" and spot is not None:
            value = F.when(F.col("_spot") & (value == "yes"), "spot_check").otherwise(value)
        out[c] = F.when(seen, value).otherwise(old)
    return joined.withColumns(out).drop("_spot", *[f"_new_{c}" for c in schemas.HUMAN_COLUMNS])


def fold_reviews(log: DataFrame, events: DataFrame, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """Current log state: valid events, latest per pair, applied to the decision rows.

    Events are reduced to one row per pair before anything is joined; events of unknown pairs find
    no row in the log (:func:`checked_reviews` lists them). Reviewed rows of the spot-check sample are
    marked as such.
    """
    valid, _ = schemas.split_valid(events, review_rules())
    return apply_reviews(log, latest_reviews(valid, order), in_spot_check(log))


def needs_review(spot: Column) -> Column:
    return (
        (F.col("routing") == "llm")
        | (F.lower(text("llm_confidence")) == "low")
        | truthy("llm_flag")
        | (text("published_endpoint") == "")
        | spot
    )


def in_queue(spot: Column) -> Column:
    """Whether a row waits for a person; ``spot`` tells the rows of the spot check."""
    return F.coalesce(needs_review(spot), F.lit(False)) & ~text("human_reviewed").isin(*presets.REVIEWED_STATUSES)


def pending_queue(log: DataFrame, spot: Column | None = None) -> DataFrame:
    """Unresolved rows that need a person, lowest score first, missing scores last.

    Where the spot check ends is found once; then every row is tested by itself.
    """
    spot = in_spot_check(log) if spot is None else spot
    queue = log.withColumn("spot_check", spot).filter(in_queue(F.col("spot_check")))
    return queue.orderBy(number("similarity_score").asc_nulls_last(), "pair_id")


def review_triggers(spot: Column = None) -> Column:
    """Why a row is in the queue, as a list of texts."""
    t = presets.REVIEW_TRIGGERS
    return matching_texts(
        [
            (F.col("routing") == "llm", t["ambiguous"]),
            (F.lower(text("llm_confidence")) == "low", t["low_confidence"]),
            (truthy("llm_flag"), t["flagged"]),
            (F.lower(text("llm_comparability")) == "false", t["not_comparable"]),
            (F.trim(text("published_endpoint")) == "", t["no_published"]),
            (F.lit(False) if spot is None else spot, t["spot_check"]),
        ]
    )


def reviewed_rows(log: DataFrame) -> DataFrame:
    return log.filter(F.col("human_reviewed").isin(*presets.REVIEWED_STATUSES))


def recent_reviews(log: DataFrame, n: int | None = 8) -> DataFrame:
    """Reviewed rows, newest first, unreadable timestamps last; ``n`` is the report's length."""
    ordered = reviewed_rows(log).orderBy(
        F.try_to_timestamp("review_timestamp").desc_nulls_last(), "pair_id"
    )
    return ordered if n is None else ordered.limit(n)


def link_review_rules() -> dict[str, Column]:
    conf = F.col("linkage_confidence")
    return {
        "reviewer_initials": F.trim(text("reviewer_initials")) != "",
        "linkage_confidence": schemas.one_of("linkage_confidence", presets.LINKAGE_CONFIDENCES),
        "pmid": (conf == "Unlinked") | (F.trim(text("pmid")) != ""),
        "notes": F.trim(text("notes")) != "",
    }


def fold_link_reviews(linked: DataFrame, reviews: DataFrame, publications: DataFrame, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """Linked trials after manual link decisions: the latest valid one per trial replaces the link."""
    good, _ = schemas.split_valid(reviews, link_review_rules())
    last = keep_latest(good, ["nct_id"], order).select(
        "nct_id",
        F.when(F.col("linkage_confidence") == "Unlinked", "").otherwise(F.trim("pmid")).alias("_pmid"),
        F.col("linkage_confidence").alias("_conf"),
        F.trim("notes").alias("_notes"),
    )
    articles = published_endpoint(publications, "abstract_text", "abstract_sections").select(
        F.col("pmid").alias("_article"),
        F.col("abstract_text").alias("_abstract_text"),
        F.col("published_endpoint").alias("_published_endpoint"),
        F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("")).alias("_first_author"),
        F.col("pub_year").alias("_pub_year"),
        F.col("journal").alias("_journal"),
    )
    # The few resolved trials pick their articles; the linked table is joined once.
    resolved = last.withColumn("_article", F.when(F.col("_pmid") != "", F.col("_pmid")).otherwise(F.col("nct_id")))
    resolved = resolved.join(articles, "_article", "left").drop("_article")
    joined = linked.join(resolved, "nct_id", "left")
    seen = F.col("_conf").isNotNull()

    def put(name: str, value: Column) -> Column:
        return F.when(seen, value).otherwise(F.col(name))

    flag = F.when(F.col("_conf").isin("High", "Medium"), "").otherwise(presets.FLAG_TEXT)
    values = {
        "pmid": F.col("_pmid"),
        "linkage_method": F.lit("manual"),
        "linkage_confidence": F.col("_conf"),
        "linkage_notes": F.col("_notes"),
        "linkage_flag": flag,
        **{c: text(f"_{c}") for c in ("abstract_text", "published_endpoint", "first_author", "pub_year", "journal")},
    }
    return joined.withColumns({n: put(n, v) for n, v in values.items() if n in linked.columns}).select(*linked.columns)


def link_review_audit(reviews: DataFrame) -> DataFrame:
    """Audit rows for the valid manual link decisions."""
    good, _ = schemas.split_valid(reviews, link_review_rules())
    return good.select(
        "nct_id",
        F.when(F.col("linkage_confidence") != "Unlinked", F.trim("pmid")).alias("pmid"),
        F.lit("manual").alias("linkage_method"),
        "linkage_confidence",
        F.concat(F.lit("reviewer:"), F.upper(F.trim("reviewer_initials"))).alias("linked_by"),
        F.trim("notes").alias("notes"),
    )


class Resolution(NamedTuple):
    """What manual link decisions lead to."""

    linked: DataFrame
    audit: DataFrame
    matches: DataFrame


def resolve_links(
    linked: DataFrame,
    reviews: DataFrame,
    publications: DataFrame,
    matches: DataFrame,
    order: Sequence[str] = EVENT_ORDER,
    embedder: Callable[[DataFrame, str], DataFrame] = word_vectors,
) -> Resolution:
    """Manual link decisions as one flow: the links they give, their audit rows, and the resolved trials matched anew.

    ``matches`` are the match results so far (``nct_id, pmid`` and the match columns). Results of a
    resolved trial's earlier link go; those of other trials stay.
    """
    good, _ = schemas.split_valid(reviews, link_review_rules())
    resolved = good.select("nct_id").distinct()
    folded = fold_link_reviews(linked, reviews, publications, order)
    todo = folded.join(resolved, "nct_id", "left_semi")
    columns = ["nct_id", "pmid", *matching.MATCH_COLUMNS]
    kept = matches.select(*columns).join(resolved, "nct_id", "left_anti")
    again = matching.match_endpoints(todo, embedder=embedder).select(*columns)
    return Resolution(folded, link_review_audit(reviews), kept.unionByName(again))


def linkage_queue(linked: DataFrame) -> DataFrame:
    """Links a person has to resolve, by confidence and trial."""
    open_link = F.col("linkage_confidence").isin("Low", "Unlinked") | (text("linkage_flag") != "")
    return linked.filter(open_link).orderBy("linkage_confidence", "nct_id")


def by_custom_order(df: DataFrame, column: str, ranks: Mapping[str, int], *then: str, unknown: int = 99) -> DataFrame:
    """Sort by a listed order of values; unlisted values come last."""
    rank: Column | None = None
    for value, position in ranks.items():
        hit = F.col(column) == value
        rank = F.when(hit, position) if rank is None else rank.when(hit, position)
    return in_order(df, [rank.otherwise(unknown), *then])


def linkage_log_view(log: DataFrame) -> DataFrame:
    """The whole linkage log, problems first, with the columns that exist."""
    names = {"linkage_confidence": "confidence", "linkage_method": "method"}
    wanted = ["nct_id", "pmid", "linkage_confidence", "linkage_method", "linked_by", "timestamp", "notes"]
    shown = log.select(*[F.col(c).alias(names.get(c, c)) for c in wanted if c in log.columns])
    return by_custom_order(shown, "confidence", presets.CONFIDENCE_SORT, "nct_id")


def existing_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def select_or_first(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The row with the given key, else the first row in order."""
    hit = df.filter(F.col(key) == value).withColumn("_turn", F.lit(0))
    first = df.orderBy(*order).limit(1).withColumn("_turn", F.lit(1))
    return hit.limit(1).unionByName(first).orderBy("_turn").limit(1).drop("_turn")


def filtered_log(
    log: DataFrame,
    lists: Mapping[str, Sequence[str]] | None = None,
    search: str = "",
    search_in: Sequence[str] = ("pair_id", "registered_endpoint", "published_endpoint", "llm_reasoning", "reviewer_initials"),
) -> DataFrame:
    """Optional value lists (all must hold) and a case-insensitive pattern in any text column."""
    for column, values in (lists or {}).items():
        if values:
            log = log.filter(F.col(column).isin(*values))
    pattern = search.strip().lower()
    if pattern:
        hits = [text(c).rlike("(?iU)" + pattern) for c in search_in if c in log.columns]
        log = log.filter(reduce(lambda a, b: a | b, hits))
    return log
