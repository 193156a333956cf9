"""Ordered rule tables turned into Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from attestor import presets
from attestor.functions.once import add_once
from attestor.functions.text import text

# Case-insensitive with Unicode classes, so that non-breaking spaces and accented letters count as
# space and letter, as they do in the rule tables' source language.
FLAGS = "(?iU)"


def has_pattern(value: Column, pattern: str) -> Column:
    return value.rlike(FLAGS + pattern)


def has_any(value: Column, patterns: Sequence[str]) -> Column:
    """One regular expression per rule: the alternatives share a single pass over the text."""
    return has_pattern(value, "|".join(f"(?:{p})" for p in patterns))


def first_rule(value: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The label of the first rule with a matching pattern."""
    out: Column | None = None
    for label, patterns in rules:
        hit = has_any(value, patterns)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def endpoint_cluster(
    registered,
    rules: Sequence[tuple[str, Sequence[str]]] = presets.CLUSTER_RULES,
    missing: str = presets.CLUSTER_MISSING,
    other: str = presets.CLUSTER_OTHER,
) -> Column:
    """Every text falls in exactly one cluster; blanks have a cluster of their own."""
    c = F.lower(F.trim(text(registered)))
    return F.when(c.isin("", "none", "nan"), F.lit(missing)).otherwise(first_rule(c, rules, other))


def population_flags(value: Column, patterns: Mapping[str, str]) -> Column:
    """All pattern flags of one text as a struct."""
    return F.struct(*[has_pattern(value, p).alias(name) for name, p in patterns.items()])


def population_text(title, conditions: Column, eligibility) -> Column:
    """Title, conditions and eligibility as one text; an empty condition list adds nothing."""
    parts = F.concat(
        F.array(text(title)),
        F.coalesce(conditions, F.array().cast("array<string>")),
        F.array(text(eligibility)),
    )
    return F.array_join(parts, " ", "")


def population(flags: Column) -> Column:
    """Subtype, setting and class from :func:`population_flags`.

    Pass the flags as a column of their own, so that each pattern is evaluated once per row.
    """
    f = flags
    neo, adj, met = f["neoadjuvant"], f["adjuvant"], f["metastatic"]
    subtype = (
        F.when(~f["breast"], "unknown_subtype")
        .when(f["tnbc"], "tnbc")
        .when(f["her2_pos"] & ~f["her2_neg"], "her2_positive")
        .when(f["hr_pos"] & (f["her2_neg"] | ~f["her2_pos"]), "hr_positive")
        .otherwise("unknown_subtype")
    )
    # Metastatic outranks both others, and neoadjuvant outranks adjuvant: that leaves one case each.
    setting = (
        F.when(~f["breast"], "unknown_setting")
        .when(met, "metastatic")
        .when(neo, "neoadjuvant")
        .when(adj, "adjuvant")
        .otherwise("unknown_setting")
    )
    label = (
        F.when(~f["breast"], "non_breast_excluded")
        .when((subtype == "unknown_subtype") | (setting == "unknown_setting"), "bc_flagged")
        .otherwise("bc_confirmed")
    )
    return F.struct(
        label.alias("population_class"), subtype.alias("bc_subtype"), setting.alias("bc_setting")
    )


def classify_population(
    df, title, conditions: Column, eligibility, patterns: Mapping[str, str] = presets.POPULATION_PATTERNS
):
    """Add ``population_class``, ``bc_subtype`` and ``bc_setting`` to a trials frame."""
    return (
        add_once(df, {"_flags": population_flags(population_text(title, conditions, eligibility), patterns)})
        .withColumn("_population", population(F.col("_flags")))
        .select("*", "_population.*")
        .drop("_flags", "_population")
    )
