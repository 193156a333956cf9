"""Governance summaries, KPIs, lookups and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor import presets
from attestor.functions.text import (
    blank_to_null, first_text, fmt_num, labels, pair_nct, pair_pmid, percent, safe_text, text, truthy,
)
from attestor.operators.ordered import keep_latest

LOW_LINKS = ("Low", "Unlinked")


def category_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Value counts of several columns in long form: ``(field, value, n)``, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def linkage_summary(log: DataFrame) -> DataFrame:
    """One row: counts per confidence and method, and how many need review."""
    conf, method = F.col("linkage_confidence"), F.col("linkage_method")
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(conf == c).alias(c.lower()) for c in presets.LINKAGE_CONFIDENCES],
        F.count_if(conf.isin(*LOW_LINKS)).alias("flagged_for_review"),
        *[F.count_if(method == m).alias(f"method_{m}") for m in presets.LINKAGE_METHODS],
    )


def linkage_kpis(linked: DataFrame) -> DataFrame:
    conf = F.col("linkage_confidence")
    return linked.agg(
        F.count(F.lit(1)).alias("linked_trials"),
        F.count_if(conf == "High").alias("high_confidence"),
        F.count_if(conf == "Medium").alias("medium_confidence"),
        F.count_if(conf.isin(*LOW_LINKS) | (text("linkage_flag") != "")).alias("flagged"),
    )


def population_summary(trials: DataFrame) -> DataFrame:
    """One row: trials kept, flagged, and with a registered endpoint."""
    kept = ~F.col("population_class").isin(*presets.EXCLUDED_POPULATIONS)
    return trials.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(kept).alias("retained"),
        F.count_if(F.col("population_class") == "bc_flagged").alias("flagged"),
        F.count_if(kept & (text("primary_outcomes") != "")).alias("with_registered_endpoint"),
    )


def shares(df: DataFrame, column: str, by: Column | None = None) -> DataFrame:
    """Counts and percentages per value of a coded column; blanks are left out of both."""
    value = (F.col(column) if by is None else by).alias("value")
    counts = df.filter(text(column) != "").groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per code
    return counts.select("value", "n", F.round(F.col("n") / F.sum("n").over(everything) * 100, 1).alias("pct"))


def routing_share(log: DataFrame) -> DataFrame:
    """Routing counts under their readable names."""
    return shares(log, "routing", labels("routing", presets.ROUTING_LABELS))


def governance(log: DataFrame) -> DataFrame:
    """One row of governance metrics; an empty log gives no row."""
    reviewed = F.col("human_reviewed").isin(*presets.REVIEWED_STATUSES)
    override = reviewed & (F.col("human_decision") == "override")
    has_conf = text("llm_confidence") != ""
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("total_pairs"),
        *[percent(F.count_if(F.col("routing") == r), n).alias(f"pct_{r}") for r in presets.ROUTINGS],
        percent(F.count_if(F.col("routing") == "llm"), n).alias("llm_call_rate_pct"),
        *[
            percent(F.count_if(F.col("llm_confidence") == c), F.count_if(has_conf)).alias(f"confidence_{c}_pct")
            for c in presets.ADJUDICATION_CONFIDENCES
        ],
        percent(F.count_if(reviewed), n).alias("human_review_rate_pct"),
        percent(F.count_if(override), F.count_if(reviewed)).alias("human_override_rate_pct"),
    ).filter("total_pairs > 0")


def override_band(log: DataFrame) -> DataFrame:
    """Is the override rate of reviewed rows high, very low, or within range?"""
    reviewed = F.col("human_reviewed").isin(*presets.REVIEWED_STATUSES)
    counts = log.agg(
        F.count_if(reviewed).alias("reviewed"),
        F.count_if(reviewed & (F.col("human_decision") == "override")).alias("overrides"),
    )
    rate = F.col("overrides") / F.greatest("reviewed", F.lit(1))
    band = (
        F.when(rate > presets.OVERRIDE_RATE_HIGH, "high")
        .when((rate < presets.OVERRIDE_RATE_LOW) & (F.col("reviewed") > 0), "low")
        .otherwise("normal")
    )
    return counts.select("reviewed", "overrides", F.round(rate, 4).alias("override_rate"), band.alias("band"))


def overview(log: DataFrame, queued: Column) -> DataFrame:
    """One row of headline counts; ``queued`` tells the rows that wait for review."""
    rows = log.withColumn("_queued", F.coalesce(queued, F.lit(False)))
    queued = F.col("_queued")
    reviewed = F.col("human_reviewed").isin(*presets.REVIEWED_STATUSES)
    counts = rows.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(queued).alias("review_queue"),
        F.count_if(reviewed).alias("reviewed"),
        F.count_if(truthy("human_poolable")).alias("poolable"),
        *[F.count_if(F.col("routing") == r).alias(f"routed_{r}") for r in presets.ROUTINGS],
        F.count_if(text("published_endpoint") == "").alias("no_published_endpoint"),
        F.count_if(queued & (text("published_endpoint") == "")).alias("queued_without_endpoint"),
    )
    auto = F.greatest(F.col("pairs") - F.col("review_queue") - F.col("reviewed"), F.lit(0))
    return counts.withColumn("auto_classified", auto)


def review_kpis(log: DataFrame) -> DataFrame:
    """One row: share reviewed, confirmed switches, agreement, poolable pairs."""
    reviewed = F.col("human_reviewed").isin(*presets.REVIEWED_STATUSES)
    human = text("human_final_class")
    total, n = F.count(F.lit(1)), F.count_if(reviewed)
    return log.agg(
        total.alias("pairs"),
        percent(n, total).alias("reviewed_pct"),
        percent(F.count_if(reviewed & human.isin(*presets.SWITCHED)), n).alias("confirmed_switch_pct"),
        percent(F.count_if(reviewed & (text("llm_switch_type") == human)), n).alias("agreement_pct"),
        F.count_if(truthy("human_poolable")).alias("poolable"),
    )


def class_heatmap(log: DataFrame) -> DataFrame:
    """Routing by human class, reviewed rows only, one column per class."""
    rows = log.filter(text("human_final_class") != "")
    return rows.groupBy(labels("routing", presets.ROUTING_LABELS).alias("routing_label")).agg(
        *[F.count_if(F.col("human_final_class") == c).alias(c) for c in presets.SWITCH_TYPES]
    )


def extraction_summary(outcomes: DataFrame) -> DataFrame:
    """One row: processed, extracted, failed, and extracted by a fallback pattern."""
    ok = F.col("outcome") == "extracted"
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(ok).alias("extracted"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & F.col("extraction_method").isin(*presets.MANUAL_CHECK_METHODS)).alias("manual_check"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-blank values."""
    return df.select(blank_to_null(column).alias(column)).dropna().distinct().orderBy(column)


def trial_meta(keys: DataFrame, linked: DataFrame, trials: DataFrame) -> DataFrame:
    """Trial facts per ``(nct_id, pmid)``: from the linked table if it has them, else the registry.

    A blank ``pmid`` matches any link of the trial. Each side is reduced to one row per key before
    it is joined.
    """
    shown = ["phase", "enrollment", "completion_date", "results_first_posted_date"]

    def facts(df: DataFrame, extra: Sequence[str]) -> Column:
        have = [c for c in [*shown, *extra] if c in df.columns]
        return F.struct(first_text("official_title", "brief_title").alias("title"), text("pmid_").alias("pmid"), *[F.trim(text(c)).alias(c) for c in have])

    extra = ["linkage_confidence", "linkage_method", "journal"]

    def one(df: DataFrame, by: Sequence[str], extra: Sequence[str], name: str) -> DataFrame:
        """One row of facts per key; of several the one with the greatest hash, so reruns agree."""
        rows = df.select(*by, facts(df, extra).alias(name)).withColumn("_hash", F.xxhash64(name))
        return keep_latest(rows, by, ["_hash"]).drop("_hash")

    l = linked.withColumn("pmid_", F.trim(text("pmid")))
    exact = one(l, ["nct_id", "pmid_"], extra, "_exact")
    anyone = one(l, ["nct_id"], extra, "_any")
    base = one(trials.withColumn("pmid_", F.trim(text("ctgov_pmid"))), ["nct_id"], [], "_base")
    rows = keys.select("nct_id", F.trim(text("pmid")).alias("pmid_")).distinct()
    rows = rows.join(exact, ["nct_id", "pmid_"], "left").join(anyone, "nct_id", "left").join(base, "nct_id", "left")
    best = F.when(F.col("pmid_") == "", F.col("_any")).otherwise(F.col("_exact"))
    rows = rows.withColumn("_m", best)
    m, b = F.col("_m"), F.col("_base")
    linked_has, base_has = set(linked.columns), set(trials.columns)

    def pick(name: str) -> Column:
        options = ([m[name]] if name in linked_has else []) + ([F.when(m.isNull(), b[name])] if name in base_has else [])
        return F.coalesce(*options) if options else F.lit(None).cast("string")

    return rows.select(
        "nct_id",
        F.col("pmid_").alias("asked_pmid"),
        F.coalesce(m["title"], b["title"]).alias("title"),
        F.coalesce(m["pmid"], F.nullif("pmid_", F.lit("")), b["pmid"], F.lit("")).alias("pmid"),
        *[pick(c).alias(c) for c in shown],
        *[m[c].alias(c) for c in extra if c in linked_has],
        m.isNotNull().alias("from_linked"),
    )


def linkage_entries(linkage_log: DataFrame) -> DataFrame:
    """All links of every trial in long form: ``(nct_id, entry, times)``."""
    entry = F.concat(
        F.lit("PMID "), safe_text("pmid", "Not available"), F.lit(" ("), safe_text("linkage_method", "Unknown"),
        F.lit(" / "), safe_text("linkage_confidence", "Unknown"), F.lit(")"),
    )
    return linkage_log.groupBy("nct_id", entry.alias("entry")).agg(F.count(F.lit(1)).alias("times"))


def linkage_lists(linkage_log: DataFrame) -> DataFrame:
    """Per trial: the number of links, and all of them in one text, each distinct one once."""
    entries = linkage_entries(linkage_log)
    return entries.groupBy("nct_id").agg(
        F.sum("times").alias("links"), F.array_join(F.array_sort(F.collect_list("entry")), " | ").alias("all_links")
    )


def linkage_digest(linkage_log: DataFrame) -> DataFrame:
    """Links per trial: their number and, in one text, how often each method and confidence occurs.

    The text has at most one part per method and confidence, however many links a trial has.
    """
    kind = F.concat(safe_text("linkage_method", "Unknown"), F.lit(" / "), safe_text("linkage_confidence", "Unknown"))
    counted = linkage_log.groupBy("nct_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("times"))
    part = F.concat("kind", F.lit(" x"), F.col("times"))
    return counted.groupBy("nct_id").agg(
        F.sum("times").alias("links"), F.array_join(F.array_sort(F.collect_list(part)), " | ").alias("link_kinds")
    )


def links_of(linkage_log: DataFrame, nct_id: str) -> DataFrame:
    """The links of one chosen trial as one text."""
    entries = linkage_entries(linkage_log.filter(F.col("nct_id") == nct_id))
    return entries.groupBy("nct_id").agg(F.array_join(F.array_sort(F.collect_list("entry")), " | ").alias("all_links"))


def provenance(log: DataFrame, linkage_log: DataFrame) -> DataFrame:
    """Every decision made about each pair, in display form."""
    rows = log.withColumn("nct_id", pair_nct("pair_id")).join(linkage_lists(linkage_log), "nct_id", "left")

    def label(name: str, fallback: str) -> Column:
        return F.when(F.col(name).isin(*presets.SWITCH_TYPES), labels(name, presets.SWITCH_LABELS)).otherwise(fallback)

    return rows.select(
        "pair_id",
        "nct_id",
        F.coalesce(F.nullif(pair_pmid("pair_id"), F.lit("")), F.lit("Not linked")).alias("pair_pmid"),
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("all_links", F.lit("No linkage entry.")).alias("all_links"),
        safe_text("registered_endpoint").alias("registered_endpoint"),
        safe_text("published_endpoint", "None extracted").alias("published_endpoint"),
        fmt_num("similarity_score", 4).alias("similarity_score"),
        labels("routing", presets.ROUTING_LABELS).alias("routing"),
        label("llm_switch_type", "Not classified").alias("ai_classification"),
        safe_text("llm_confidence", "Not called").alias("ai_confidence"),
        safe_text("human_decision", "Not reviewed").alias("human_decision"),
        label("human_final_class", "Pending review").alias("human_class"),
        F.when(truthy("human_poolable"), "Yes").otherwise("No").alias("poolable"),
        safe_text("reviewer_initials", "Not yet reviewed").alias("reviewer"),
        safe_text("override_reason", "No override").alias("override_reason"),
        safe_text("review_timestamp", "Not yet reviewed").alias("review_timestamp"),
    )
