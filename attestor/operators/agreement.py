"""Agreement between classifiers, reviewers and the gold standard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attestor import presets
from attestor.functions.text import blank_to_null, matching_texts, text, truthy


def ai_class(unrouted: str = "") -> Column:
    """The adjudicated class, else the one implied by automatic routing, else ``unrouted``."""
    return F.coalesce(
        blank_to_null("llm_switch_type"),
        F.when(F.trim("routing") == "auto_concordant", "concordant").when(F.trim("routing") == "auto_major_switch", "major_switch"),
        F.lit(unrouted),
    )


def default_class() -> Column:
    """Human class, else adjudicated class, else by routing."""
    by_route = F.when(F.col("routing") == "auto_concordant", "concordant").otherwise("major_switch")
    return F.coalesce(blank_to_null("human_final_class"), blank_to_null("llm_switch_type"), by_route)


def default_poolable() -> Column:
    return F.when(blank_to_null("human_poolable").isNotNull(), truthy("human_poolable")).otherwise(truthy("llm_comparability"))


def with_labels(log: DataFrame, labelled: DataFrame, label: str, *more: str) -> DataFrame:
    """Inner join of the log with completed labels (other values count as not filled in)."""
    done = labelled.withColumn(label, F.trim(text(label))).filter(F.col(label).isin(*presets.SWITCH_TYPES))
    return log.join(done.select("pair_id", label, *more), "pair_id")


def calibration(log: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: AUC, precision, recall, flag rate, agreement, targets met and recommended actions.

    Scores are binary, so the area under the curve is the mean of sensitivity and specificity.
    """
    rows = with_labels(log, gold, "gold_switch_type").withColumn("ai", ai_class())
    rows = rows.filter(F.col("ai").isin(*presets.SWITCH_TYPES))
    g, a = F.col("gold_switch_type"), F.col("ai")
    gold_switch, ai_switch = g != "concordant", a != "concordant"
    gold_mod, ai_mod = g.isin(*presets.MODERATE_OR_ABOVE), a.isin(*presets.MODERATE_OR_ABOVE)
    low = F.lower(text("llm_confidence")) == "low"
    handled = truthy("llm_flag") | F.lower(text("human_reviewed")).isin(*presets.REVIEWED_STATUSES)
    c = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gold_switch).alias("pos"),
        F.count_if(gold_switch & ai_switch).alias("tp"),
        F.count_if(~gold_switch & ~ai_switch).alias("tn"),
        F.count_if(gold_mod).alias("mod"),
        F.count_if(ai_mod).alias("ai_mod"),
        F.count_if(gold_mod & ai_mod).alias("both_mod"),
        F.count_if(low).alias("low"),
        F.count_if(low & handled).alias("low_handled"),
        F.count_if(g == a).alias("same"),
    )
    neg = F.col("n") - F.col("pos")
    auc = F.when(
        (F.col("pos") > 0) & (neg > 0), (F.try_divide("tp", "pos") + F.try_divide(F.col("tn"), neg)) / 2
    )
    c = c.withColumns(
        {
            "_auc": auc,
            "_precision": F.coalesce(F.try_divide("both_mod", "ai_mod"), F.lit(0.0)),
            "_recall": F.coalesce(F.try_divide("both_mod", "mod"), F.lit(0.0)),
            "_low_rate": F.try_divide("low_handled", "low"),
        }
    )
    short = {
        "auc": F.coalesce(F.col("_auc") < presets.TARGET_AUC, F.lit(False)),
        "precision": F.col("_precision") < presets.TARGET_PRECISION,
        "recall": F.col("_recall") < presets.TARGET_RECALL,
        "low_confidence": F.coalesce(F.col("_low_rate") < presets.TARGET_LOW_CONFIDENCE_FLAGGED, F.lit(False)),
    }
    return c.filter("n > 0").select(
        F.col("n").alias("n_gold_standard_pairs"),
        F.round("_auc", 3).alias("auc"),
        F.round("_precision", 3).alias("precision_moderate_or_above"),
        F.round("_recall", 3).alias("recall_moderate_or_above"),
        F.round("_low_rate", 3).alias("low_confidence_flag_rate"),
        F.round(F.col("same") / F.col("n") * 100, 1).alias("ai_human_agreement_rate_pct"),
        *[(~missed).alias(f"{name}_target_met") for name, missed in short.items()],
        matching_texts([(missed, presets.ACTIONS[name]) for name, missed in short.items()]).alias("recommended_actions"),
    )


def review_actions(metrics: DataFrame) -> DataFrame:
    """The recommended actions of a calibration row, one per row."""
    return metrics.select(F.posexplode("recommended_actions").alias("no", "action")).filter(F.trim("action") != "")


def inter_rater(log: DataFrame, second: DataFrame) -> DataFrame:
    """One row: Cohen's kappa, class agreement and poolable agreement of two reviewers."""
    rows = with_labels(log, second, "second_switch_type", "second_poolable")
    rows = rows.filter(F.col("human_final_class").isin(*presets.SWITCH_TYPES))
    # The pair table has at most one row per two classes, whatever the log's size.
    cells = rows.groupBy(
        F.col("human_final_class").alias("a"), F.col("second_switch_type").alias("b")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(truthy("human_poolable") == truthy("second_poolable")).alias("pool_same"),
    )
    sides = [F.sum(F.when(F.col(side) == t, F.col("n")).otherwise(0)).alias(f"{side}_{t}") for t in presets.SWITCH_TYPES for side in "ab"]
    one = cells.agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"),
        F.sum("pool_same").alias("pool_same"),
        *sides,
    ).filter("n > 0")
    observed = F.col("same") / F.col("n")
    chance = sum((F.col(f"a_{t}") * F.col(f"b_{t}") for t in presets.SWITCH_TYPES), F.lit(0)) / (F.col("n") * F.col("n"))
    return one.select(
        F.col("n").alias("n_inter_rater_pairs"),
        F.round(F.when(chance < 1, (observed - chance) / (1 - chance)), 3).alias("cohen_kappa"),
        F.round(observed * 100, 1).alias("classification_agreement_rate_pct"),
        F.round(F.col("pool_same") / F.col("n") * 100, 1).alias("poolable_agreement_rate_pct"),
    )


def crosstab(df: DataFrame, row: Column, column: Column, values: Sequence[str], row_name: str) -> DataFrame:
    """A contingency table with one column per listed value; absent combinations are 0."""
    return df.groupBy(row.alias(row_name)).agg(*[F.count_if(column == v).alias(v) for v in values])


def gold_matrix(log: DataFrame, gold: DataFrame) -> DataFrame:
    rows = log.join(gold.select("pair_id", "gold_switch_type"), "pair_id").withColumn("_ai", ai_class())
    return crosstab(rows.filter(F.col("_ai") != ""), F.col("_ai"), F.col("gold_switch_type"), presets.SWITCH_TYPES, "ai_switch")
