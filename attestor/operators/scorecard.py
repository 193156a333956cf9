"""The grouped scorecard: one row per endpoint cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attestor import presets, schemas
from attestor.functions.rules import endpoint_cluster
from attestor.functions.text import number, pair_nct, percent, text
from attestor.operators.ordered import grouped_median, keep_latest


def cluster_pairs(pairs: DataFrame, registered: str = "primary_outcomes", key: str = "pair_id") -> DataFrame:
    """``(endpoint_cluster, pair_id)``: every pair in exactly one cluster."""
    return pairs.select(endpoint_cluster(registered).alias("endpoint_cluster"), F.trim(text(key)).alias("pair_id"))


def cluster_lists(clusters: DataFrame) -> DataFrame:
    """Cluster sizes and their share of all pairs, largest first."""
    sizes = clusters.groupBy("endpoint_cluster").agg(F.count(F.lit(1)).alias("n_pairs"))
    return sizes.orderBy(F.desc("n_pairs"), "endpoint_cluster")


def evidence_strength(pooled: Column, lower: Column, upper: Column, n: Column, switch_rate: Column) -> Column:
    """Gap, Weak, Moderate or Strong; only an interval below 1 counts as excluding no effect."""
    clear = F.coalesce(lower.isNotNull() & (upper < 1.0), F.lit(False))
    return (
        F.when((n == 0) | pooled.isNull(), "Gap")
        .when((n >= 5) & clear & (switch_rate < 20), "Strong")
        .when((n >= 3) & clear, "Moderate")
        .when(n >= 2, "Weak")
        .otherwise("Gap")
    )


def with_cluster(log: DataFrame, registered: str = "registered_endpoint") -> DataFrame:
    """The log with each row's cluster."""
    return log.withColumn("endpoint_cluster", endpoint_cluster(registered))


def latest_bias(power_log: DataFrame, order: Sequence[str] = ("audit_timestamp",)) -> DataFrame:
    """The last numeric optimism bias per trial of an append-only power log.

    Rows of a trial that tie in ``order``, or all of them where the log has none of its columns, are told
    apart by a hash of their values: a trial counts once.
    """
    rows = power_log.withColumn("bias", number("optimism_bias")).filter("bias IS NOT NULL")
    known = [c for c in order if c in power_log.columns]
    return keep_latest(rows.select("nct_id", "bias", *known), ["nct_id"], known or ["nct_id"]).select("nct_id", "bias")


def log_metrics(clustered: DataFrame, parity: bool = False) -> DataFrame:
    """Counts and rates per cluster from the decision log, in one aggregation."""
    poolable = F.lower(text("human_poolable"))
    reviewed = F.col("human_reviewed").isin(*presets.REVIEWED_STATUSES)
    override = reviewed & (F.col("human_decision") == "override")
    ai, human = text("llm_switch_type"), text("human_final_class")
    # Two blanks are no agreement; the parity form counts them and divides by all rows.
    rated = F.lit(True) if parity else (ai != "") & (human != "")
    return clustered.groupBy("endpoint_cluster").agg(
        F.count_if(poolable == "true").alias("trials_included"),
        F.count_if(poolable == "false").alias("trials_excluded"),
        F.coalesce(percent(F.count_if(override), F.count_if(reviewed)), F.lit(0.0)).alias("human_override_rate_pct"),
        F.coalesce(F.round(F.avg(number("ssi")), 2), F.lit(0.0)).alias("mean_ssi"),
        percent(F.count_if(human.isin(*presets.SWITCHED)), F.count(F.lit(1))).alias("human_confirmed_switch_rate_pct"),
        percent(F.count_if(rated & (ai == human)), F.count_if(rated)).alias("ai_human_agreement_rate_pct"),
    )


#: What the scorecard reads of the log.
LOG_COLUMNS = (
    "endpoint_cluster", "pair_id", "human_poolable", "human_reviewed", "human_decision", "ssi", "llm_switch_type", "human_final_class",
)


def build_scorecard(
    log: DataFrame,
    linkage_log: DataFrame,
    pooled: DataFrame | None = None,
    effects: DataFrame | None = None,
    power_log: DataFrame | None = None,
    parity: bool = False,
) -> DataFrame:
    """One row per cluster of ``log``, which has an ``endpoint_cluster`` (see :func:`with_cluster`).

    The log is read several times: pass the written columns ``LOG_COLUMNS``, or a written table.
    ``pooled`` has one posterior row per cluster (a per-cluster fit, or the shared one of
    :func:`attestor.operators.pooling.broadcast_posterior`).
    """
    card = log_metrics(log, parity)

    trials = log.select("endpoint_cluster", pair_nct(F.trim("pair_id")).alias("nct_id")).distinct()
    unlinked = (
        linkage_log.filter(F.col("linkage_confidence") == "Unlinked")
        .groupBy("nct_id").agg(F.count(F.lit(1)).alias("_rows"))
        .join(trials, "nct_id")
        .groupBy("endpoint_cluster").agg(F.sum("_rows").alias("trials_unlinked"))
    )
    card = card.join(unlinked, "endpoint_cluster", "left")

    none = F.lit(None).cast("double")
    if pooled is None:
        card = card.withColumns({c: none for c in ("pooled_hr", "pooled_hr_cri_lower", "pooled_hr_cri_upper", "tau_mean")})
    else:
        fit = pooled.select("endpoint_cluster", "pooled_hr", "pooled_hr_cri_lower", "pooled_hr_cri_upper", "tau_mean")
        card = card.join(fit, "endpoint_cluster", "left")

    if effects is None:
        card = card.withColumn("_sigma2", none)
    else:
        known = effects.filter(F.col("se_log_hr") > 0).select(
            "pair_id", F.round(F.col("se_log_hr") * F.col("se_log_hr"), 8).alias("_var")
        )
        pairs = log.select("endpoint_cluster", F.trim("pair_id").alias("pair_id"))
        variances = pairs.join(known, "pair_id").select("endpoint_cluster", "_var")
        card = card.join(grouped_median(variances, ["endpoint_cluster"], "_var", "_sigma2"), "endpoint_cluster", "left")

    if power_log is None:
        card = card.withColumn("mean_optimism_bias", none)
    else:
        bias = trials.join(latest_bias(power_log), "nct_id").groupBy("endpoint_cluster").agg(
            F.round(F.avg("bias"), 3).alias("mean_optimism_bias")
        )
        card = card.join(bias, "endpoint_cluster", "left")

    tau2, sigma2 = F.col("tau_mean") * F.col("tau_mean"), F.col("_sigma2")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("trials_included", "trials_excluded", "trials_unlinked")}
    rates = {
        c: F.coalesce(c, F.lit(0.0))
        for c in ("human_override_rate_pct", "mean_ssi", "human_confirmed_switch_rate_pct", "ai_human_agreement_rate_pct")
    }
    card = card.withColumns({**counts, **rates})
    card = card.withColumns(
        {
            "between_trial_tau": F.col("tau_mean"),
            "i_squared_pct": F.when(sigma2 > 0, F.round(tau2 / (tau2 + sigma2) * 100, 1)),
            "evidence_strength": evidence_strength(
                F.col("pooled_hr"), F.col("pooled_hr_cri_lower"), F.col("pooled_hr_cri_upper"),
                F.col("trials_included"), F.col("human_confirmed_switch_rate_pct"),
            ),
        }
    )
    return card.select(*schemas.SCORECARD_COLUMNS)
