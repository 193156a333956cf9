"""Power audit: the effect a sample size assumes against the evidence at registration."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor import presets
from attestor.functions.once import add_once
from attestor.functions.text import iso_date, number, text


def implied_ratio(enrollment: Column, event_rate: Column, alpha: float = presets.ALPHA, power: float = presets.POWER) -> Column:
    """The ratio a log-rank test of this size could detect (balanced arms); NULL without events."""
    z = abs(NormalDist().inv_cdf(1 - alpha / 2)) + abs(NormalDist().inv_cdf(1 - power))
    events = enrollment * event_rate
    return F.when(events > 0, F.round(F.exp(F.lit(-2.0 * z) / F.sqrt(events)), 4))


def posterior_asof(dates: DataFrame, posteriors: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """For each distinct date: the last posterior dated strictly before it.

    ``dates(group.., date)``; ``posteriors(group.., date, n_trials, mu_mean)``. Both sides are first
    reduced to one row per group and calendar day, so a window holds at most two rows per day of
    the calendar, and a day that many trials share is looked up once.
    """
    asked = dates.select(*group, "date").filter("date IS NOT NULL").distinct()
    daily = posteriors.filter("date IS NOT NULL").groupBy(*group, "date").agg(F.max_by("mu_mean", "n_trials").alias("mu"))
    timeline = asked.withColumns({"_kind": F.lit(0), "mu": F.lit(None).cast("double")}).unionByName(
        daily.withColumn("_kind", F.lit(1))
    )
    # On equal dates the question comes before the answer: strictly earlier posteriors only.
    w = (
        Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)])
        .orderBy("date", "_kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = timeline.withColumn("posterior_hr", F.last("mu", ignorenulls=True).over(w))
    return seen.filter("_kind = 0").select(*group, "date", "posterior_hr")


def power_audit(
    trials: DataFrame,
    posteriors: DataFrame,
    group: Sequence[str] = (),
    event_rate: float = presets.EVENT_RATE,
    alpha: float = presets.ALPHA,
    power: float = presets.POWER,
    inputs_source: str = "registry",
) -> DataFrame:
    """One audit row per trial; ``posteriors`` is the prefix table with its registration dates."""
    size = number("enrollment")
    whole = F.when(F.abs(size) < 9e18, size.try_cast("bigint"))
    bad = F.col("_n").isNull() | (F.col("_n") <= 0)
    rate = F.coalesce(number("event_rate"), F.lit(event_rate)) if "event_rate" in trials.columns else F.lit(event_rate)
    rows = add_once(trials, {"_n": whole, "assumed_event_rate": rate, "date": iso_date("registration_date")})
    rows = rows.withColumn("_bad", bad).withColumn("_hr", F.when(~F.col("_bad"), implied_ratio(F.col("_n"), F.col("assumed_event_rate"), alpha, power)))
    answers = posterior_asof(rows, posteriors.withColumn("date", iso_date("registration_date")), group)
    keys = [*group, "date"]
    if group:
        # Trials without a date stay out of the shuffle, where they would share one task.
        dated = rows.filter("date IS NOT NULL").join(answers, keys, "left")
        joined = dated.unionByName(rows.filter("date IS NULL"), allowMissingColumns=True)
    else:
        joined = rows.join(F.broadcast(answers), keys, "left")  # at most one row per calendar day
    reason = F.when(F.col("_bad"), presets.BAD_ENROLLMENT).when(
        F.col("_hr").isNull(), F.lit("back_calculation_failed: no expected events")
    )
    posterior = F.when(F.col("_hr").isNotNull(), F.col("posterior_hr"))
    return joined.select(
        *group,
        "nct_id",
        F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).alias("enrollment"),
        F.coalesce("_hr", F.lit(1.0)).alias("assumed_hr"),
        "assumed_event_rate",
        F.lit(alpha).alias("alpha"),
        F.lit(power).alias("power"),
        posterior.alias("posterior_hr_at_registration"),
        F.round(F.col("_hr") - posterior, 4).alias("optimism_bias"),
        reason.alias("excluded_reason"),
        F.lit(inputs_source).alias("inputs_source"),
    )


def power_kpis(audit: DataFrame) -> DataFrame:
    """Audited, included, excluded, mean bias, and how many differ clearly in either direction."""
    bias = number("optimism_bias")
    excluded = text("excluded_reason") != ""
    return audit.agg(
        F.count(F.lit(1)).alias("audited"),
        F.count_if(~excluded).alias("included"),
        F.count_if(excluded).alias("excluded"),
        F.round(F.avg(bias), 3).alias("mean_bias"),
        F.count_if(bias < presets.BIAS_ALERT).alias("below_evidence"),
        F.count_if(bias > -presets.BIAS_ALERT).alias("above_evidence"),
    )


def excluded_trials(audit: DataFrame) -> DataFrame:
    return audit.filter(text("excluded_reason") != "").select("nct_id", F.col("excluded_reason").alias("reason"))


def scatter_pairs(audit: DataFrame) -> DataFrame:
    """Trials with both ratios known."""
    pairs = audit.select(
        "nct_id",
        number("posterior_hr_at_registration").alias("posterior_hr_at_registration"),
        number("assumed_hr").alias("assumed_hr"),
    )
    return pairs.dropna(subset=["posterior_hr_at_registration", "assumed_hr"])


def scatter_bounds(pairs: DataFrame) -> DataFrame:
    """Axis limits: 5 % below the smallest and above the largest of both ratios."""
    a, b = "posterior_hr_at_registration", "assumed_hr"
    return pairs.agg(
        (F.least(F.min(a), F.min(b)) * 0.95).alias("axis_min"),
        (F.greatest(F.max(a), F.max(b)) * 1.05).alias("axis_max"),
    )
