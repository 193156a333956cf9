"""Registry studies: nested JSON documents to one flat row per trial."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from attestor import presets
from attestor.functions.rules import classify_population
from attestor.functions.text import text
from attestor.schemas import TRIAL_COLUMNS

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_DATE = _struct(date=_S)
_OUTCOMES = T.ArrayType(_struct(measure=_S))
# Only the elements that are read; the scan skips everything else in a document.
STUDY_SCHEMA = _struct(
    protocolSection=_struct(
        identificationModule=_struct(nctId=_S, officialTitle=_S, briefTitle=_S),
        designModule=_struct(
            studyType=_S, phases=T.ArrayType(_S), enrollmentInfo=_struct(count=T.LongType())
        ),
        outcomesModule=_struct(primaryOutcomes=_OUTCOMES, secondaryOutcomes=_OUTCOMES),
        statusModule=_struct(
            overallStatus=_S,
            startDateStruct=_DATE,
            completionDateStruct=_DATE,
            studyFirstSubmitDate=_S,
            resultsFirstPostedDateStruct=_DATE,
        ),
        conditionsModule=_struct(conditions=T.ArrayType(_S)),
        eligibilityModule=_struct(eligibilityCriteria=_S),
        referencesModule=_struct(references=T.ArrayType(_struct(type=_S, pmid=_S))),
    )
)


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    """Landed study documents, one JSON object per line."""
    return spark.read.schema(STUDY_SCHEMA).json(path)


def source_filters(
    today: dt.date | None = None,
    conditions=presets.REGISTRY_CONDITIONS,
    phases=presets.REGISTRY_PHASES,
    require_results: bool = True,
) -> Column:
    """The registry query as one predicate: condition, phase, type, status, completion, results."""
    p = "protocolSection."
    end = today or dt.date.today()
    try:
        start = end.replace(year=end.year - presets.REGISTRY_YEARS_BACK)
    except ValueError:  # 29 February
        start = end.replace(year=end.year - presets.REGISTRY_YEARS_BACK, day=28)
    completed = F.coalesce(
        F.try_to_date(F.col(p + "statusModule.completionDateStruct.date"), "yyyy-MM-dd"),
        F.try_to_date(F.col(p + "statusModule.completionDateStruct.date"), "yyyy-MM"),
    )
    wanted = [c.lower() for c in conditions]
    listed = F.exists(
        F.col(p + "conditionsModule.conditions"),
        lambda c: F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: F.contains(F.lower(c), w)),
    )
    test = (
        F.coalesce(listed, F.lit(False))
        & F.coalesce(F.arrays_overlap(p + "designModule.phases", F.array(*[F.lit(x) for x in phases])), F.lit(False))
        & (F.col(p + "designModule.studyType") == presets.REGISTRY_STUDY_TYPE)
        & (F.col(p + "statusModule.overallStatus") == presets.REGISTRY_STATUS)
        & completed.between(F.lit(start), F.lit(end))
    )
    if require_results:
        test = test & F.col(p + "statusModule.resultsFirstPostedDateStruct.date").isNotNull()
    return test


def reference_pmid(references: Column) -> Column:
    """First RESULT reference in order, else the numerically smallest DERIVED one, else ``""``."""
    def of(kind: str) -> Column:
        hits = F.filter(references, lambda r: (r["type"] == kind) & (F.coalesce(r["pmid"], F.lit("")) != ""))
        return F.transform(hits, lambda r: r["pmid"])

    derived = F.transform(
        of("DERIVED"),
        lambda p: F.struct(F.when(p.rlike(r"^\d+$"), p.try_cast("decimal(38,0)")).otherwise(0).alias("n"), p.alias("p")),
    )
    smallest = F.get(F.array_sort(derived), 0)["p"]
    return F.coalesce(F.get(of("RESULT"), 0), smallest, F.lit(""))


def _measures(outcomes: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(outcomes, lambda o: F.coalesce(o["measure"], F.lit(""))), " | "), F.lit(""))


def flatten_studies(studies: DataFrame, patterns=presets.POPULATION_PATTERNS) -> DataFrame:
    """One row per trial, classified by population; ids that do not start with ``NCT`` are dropped."""
    p = studies.filter(F.col("protocolSection.identificationModule.nctId").startswith("NCT")).select("protocolSection.*")
    flat = p.select(
        F.col("identificationModule.nctId").alias("nct_id"),
        text("identificationModule.officialTitle").alias("official_title"),
        text("identificationModule.briefTitle").alias("brief_title"),
        F.coalesce(F.array_join("designModule.phases", ", "), F.lit("")).alias("phase"),
        text("statusModule.startDateStruct.date").alias("start_date"),
        text("statusModule.completionDateStruct.date").alias("completion_date"),
        F.col("designModule.enrollmentInfo.count").alias("enrollment"),
        _measures(F.col("outcomesModule.primaryOutcomes")).alias("primary_outcomes"),
        _measures(F.col("outcomesModule.secondaryOutcomes")).alias("secondary_outcomes"),
        text("statusModule.studyFirstSubmitDate").alias("registration_date"),
        text("statusModule.resultsFirstPostedDateStruct.date").alias("results_first_posted_date"),
        reference_pmid(F.col("referencesModule.references")).alias("ctgov_pmid"),
        F.col("conditionsModule.conditions").alias("_conditions"),
        F.col("eligibilityModule.eligibilityCriteria").alias("_eligibility"),
    )
    title = F.coalesce(F.nullif("official_title", F.lit("")), F.col("brief_title"))
    return classify_population(flat, title, F.col("_conditions"), "_eligibility", patterns).select(*TRIAL_COLUMNS)


def retained(trials: DataFrame, excluded=presets.EXCLUDED_POPULATIONS) -> DataFrame:
    return trials.filter(~F.col("population_class").isin(*excluded))


def first_trials(trials: DataFrame, n: int) -> DataFrame:
    """The first ``n`` trials by id (the reader's optional row cap, made deterministic)."""
    return trials.orderBy("nct_id").limit(n)


def read_trials(spark: SparkSession, path: str, today: dt.date | None = None, max_records: int | None = None) -> DataFrame:
    """Scan, filter, flatten, classify and keep the trials of the target population."""
    flat = flatten_studies(read_studies(spark, path).filter(source_filters(today)))
    kept = retained(flat)
    return kept if max_records is None else first_trials(kept, max_records)
