"""Table schemas and row validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from attestor import presets


def strings(*names: str) -> T.StructType:
    """An all-string schema, the form every CSV log is read in."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TRIAL_COLUMNS = (
    "nct_id", "official_title", "brief_title", "phase", "start_date", "completion_date", "enrollment",
    "primary_outcomes", "secondary_outcomes", "registration_date", "results_first_posted_date",
    "ctgov_pmid", "population_class", "bc_subtype", "bc_setting",
)
LINK_COLUMNS = (
    "pmid", "linkage_method", "linkage_confidence", "abstract_text", "published_endpoint",
    "first_author", "pub_year", "journal", "linkage_notes", "linkage_flag",
)
HUMAN_COLUMNS = (
    "human_reviewed", "human_decision", "human_final_class", "human_poolable", "override_reason",
    "reviewer_initials", "review_timestamp",
)
GOLD_COLUMNS = (
    "pair_id", "nct_id", "pmid", "registered_endpoint", "published_endpoint", "gold_switch_type",
    "gold_direction", "notes",
)
SECOND_REVIEW_COLUMNS = (
    "pair_id", "nct_id", "pmid", "registered_endpoint", "published_endpoint",
    "second_reviewer_initials", "second_switch_type", "second_poolable", "notes",
)
SCORECARD_COLUMNS = (
    "endpoint_cluster", "trials_included", "trials_excluded", "trials_unlinked",
    "human_override_rate_pct", "mean_ssi", "human_confirmed_switch_rate_pct",
    "ai_human_agreement_rate_pct", "pooled_hr", "pooled_hr_cri_lower", "pooled_hr_cri_upper",
    "between_trial_tau", "i_squared_pct", "mean_optimism_bias", "evidence_strength",
)

EFFECT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("pair_id", "nct_id", "pmid")]
    + [
        T.StructField(n, T.DoubleType())
        for n in ("hr", "hr_lci", "hr_uci", "log_hr", "se_log_hr", "variance")
    ]
    + [T.StructField(n, T.StringType()) for n in ("extraction_method", "source_reference", "registration_date")]
)

ADJUDICATION_SCHEMA = T.StructType(
    [
        T.StructField("switch_type", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("step_by_step_reasoning", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("comparability_for_pooling", T.BooleanType()),
        T.StructField("flag_for_human_review", T.BooleanType()),
        T.StructField("key_differences", T.ArrayType(T.StringType())),
    ]
)
ARBITER_SCHEMA = strings(
    "step1_signals", "step2_reasoning", "article_type", "verdict", "confidence", "reason"
)

PUBLICATION_SCHEMA = T.StructType(
    [
        T.StructField("pmid", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract_text", T.StringType()),
        T.StructField("abstract_sections", T.MapType(T.StringType(), T.StringType())),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("pub_year", T.StringType()),
        T.StructField("journal", T.StringType()),
        T.StructField("mesh_terms", T.ArrayType(T.StringType())),
        T.StructField("pub_types", T.ArrayType(T.StringType())),
        T.StructField("secondary_ids", T.ArrayType(T.StringType())),
    ]
)


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks (a NULL test counts as broken)."""
    return df.withColumn(
        "violations",
        F.filter(
            F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
            lambda v: v.isNotNull(),
        ),
    )


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(valid rows, rejects with their violations)``."""
    checked = validate(df, rules)
    return (
        checked.filter(F.size("violations") == 0).drop("violations"),
        checked.filter(F.size("violations") > 0),
    )


def one_of(name: str, allowed: Sequence[str], optional: bool = False) -> Column:
    inside = F.col(name).isin(*allowed)
    return (F.col(name).isNull() | inside) if optional else inside


def normalise_trial_id(df: DataFrame, column: str = "nct_id") -> DataFrame:
    return df.withColumn(column, F.upper(F.trim(F.col(column))))


def linkage_rules() -> dict[str, Column]:
    return {
        "nct_id_prefix": F.col("nct_id").startswith("NCT"),
        "linkage_method": one_of("linkage_method", presets.LINKAGE_METHODS),
        "linkage_confidence": one_of("linkage_confidence", presets.LINKAGE_CONFIDENCES),
    }


def decision_rules() -> dict[str, Column]:
    """Typed decision rows: score range, index within 0.01 of the score, override needs a reason."""
    expected = F.round((1.0 - F.col("similarity_score")) * 100, 4)
    return {
        "score_range": F.col("similarity_score").between(0.0, 1.0),
        "ssi_consistency": F.abs(F.col("ssi") - expected) <= 0.01,
        "routing": one_of("routing", presets.ROUTINGS),
        "override_reason": ~F.coalesce(F.col("human_decision") == "override", F.lit(False))
        | (F.coalesce(F.col("override_reason"), F.lit("")) != ""),
    }


def effect_rules() -> dict[str, Column]:
    """Positive values and log fields within tolerance of the ratio they were derived from."""
    se = F.round((F.ln("hr_uci") - F.ln("hr_lci")) / (2 * presets.Z_95), 6)
    positive = {f"{n}_positive": F.col(n) > 0 for n in ("hr", "hr_lci", "hr_uci", "se_log_hr", "variance")}
    return {
        **positive,
        "log_hr": F.abs(F.col("log_hr") - F.round(F.ln("hr"), 6)) <= 0.001,
        "se_log_hr": F.abs(F.col("se_log_hr") - se) <= 0.001,
        "variance_value": F.abs(F.col("variance") - F.round(se * se, 8)) <= 0.0001,
    }


def power_rules() -> dict[str, Column]:
    def inside(name: str) -> Column:
        return (F.col(name) > 0) & (F.col(name) < 1)

    return {
        "enrollment": F.col("enrollment") > 0,
        "assumed_hr": F.col("assumed_hr") > 0,
        "assumed_event_rate": inside("assumed_event_rate"),
        "alpha": inside("alpha"),
        "power": inside("power"),
    }
