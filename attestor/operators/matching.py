"""Registered vs. published endpoints: similarity, routing, adjudication, incremental updates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from attestor import presets, schemas
from attestor.functions.text import fill_template, normalise, pair_key, split_candidates, text
from attestor.functions.vectors import cosine, sparse_cosine, word_vectors
from attestor.operators.gating import strip_fences
from attestor.operators.ordered import keep_latest, running_totals
from attestor.session import materialise

MATCH_COLUMNS = ("pair_id", "similarity_score", "routing")


def route(
    score: Column, concordant: float = presets.SIMILARITY_CONCORDANT, ambiguous: float = presets.SIMILARITY_AMBIGUOUS
) -> Column:
    return (
        F.when(score >= concordant, "auto_concordant").when(score >= ambiguous, "llm").otherwise("auto_major_switch")
    )


def switch_index(score: Column) -> Column:
    return F.round((1.0 - score) * 100, 4)


def matchable(linked: DataFrame, endpoint: str = "primary_outcomes") -> DataFrame:
    """Rows that may be compared: a publication, a trusted link, a registered endpoint."""
    pmid = text("pmid")
    return linked.filter(
        ~pmid.isin("", "None") & F.col("linkage_confidence").isin("High", "Medium") & (normalise(endpoint) != "")
    )


def candidate_pairs(pairs: DataFrame, key: Sequence[str], registered: str, published: str) -> DataFrame:
    """One row per (pair, registered candidate) with both texts normalised."""
    return pairs.select(
        *key, F.explode(split_candidates(registered)).alias("candidate"), normalise(published).alias("published")
    ).filter(F.col("published") != "")


def distinct_texts(candidates: DataFrame) -> DataFrame:
    """The texts that need a vector, each once."""
    return candidates.select(F.explode(F.array("candidate", "published")).alias("text")).distinct()


def best_scores(pairs: DataFrame, key: Sequence[str], candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """The best candidate's similarity per pair; 0 where either side is empty.

    ``vectors(text, embedding)`` has one row per text, the vector as an array or, where most of it is
    zero, as a map. Vectors meet once per distinct pair of
    texts, however often that pair of texts occurs; only scores travel back to the pairs.
    """
    v = vectors.select("text", "embedding")
    similarity = sparse_cosine if isinstance(v.schema["embedding"].dataType, T.MapType) else cosine
    texts = candidates.select("candidate", "published").distinct()
    scored = (
        texts.join(v.withColumnsRenamed({"text": "candidate", "embedding": "_a"}), "candidate")
        .join(v.withColumnsRenamed({"text": "published", "embedding": "_b"}), "published")
        .select("candidate", "published", similarity(F.col("_a"), F.col("_b")).alias("score"))
    )
    best = candidates.join(scored, ["candidate", "published"]).groupBy(*key).agg(F.max("score").alias("_best"))
    return pairs.join(best, list(key), "left").withColumn(
        "similarity_score", F.round(F.coalesce("_best", F.lit(0.0)), 4)
    ).drop("_best")


def match_endpoints(
    linked: DataFrame,
    endpoint: str = "primary_outcomes",
    embedder: Callable[[DataFrame, str], DataFrame] = word_vectors,
) -> DataFrame:
    """Matchable pairs with ``pair_id``, ``similarity_score``, ``ssi`` and ``routing``."""
    rows = matchable(linked, endpoint).withColumn("pair_id", pair_key(F.trim("nct_id"), F.trim("pmid")))
    texts = candidate_pairs(rows, ["pair_id"], endpoint, "published_endpoint")
    # Both sides of a comparison read the vectors; the embedder must run once per text.
    known = materialise(embedder(distinct_texts(texts), "text").select("text", "embedding"))
    scored = best_scores(rows, ["pair_id"], texts, known)
    score = F.col("similarity_score")
    return scored.withColumns({"ssi": switch_index(score), "routing": route(score)})


def attach_matches(linked: DataFrame, updates: DataFrame) -> DataFrame:
    """Left join of match results on (nct_id, pmid); earlier match columns are replaced."""
    return linked.drop(*MATCH_COLUMNS).join(updates.select("nct_id", "pmid", *MATCH_COLUMNS), ["nct_id", "pmid"], "left")


def refresh_matches(
    linked: DataFrame,
    changed: DataFrame,
    existing: DataFrame,
    embedder: Callable[[DataFrame, str], DataFrame] = word_vectors,
) -> DataFrame:
    """Compare only the trials of ``changed(nct_id)`` again; all other results stay as they are."""
    columns = ["nct_id", "pmid", *MATCH_COLUMNS]
    todo = linked.join(changed.select("nct_id").distinct(), "nct_id", "left_semi")
    updates = upsert(existing.select(columns), match_endpoints(todo, embedder=embedder).select(columns))
    return attach_matches(linked, updates)


def unmatched_yet(linked: DataFrame, log: DataFrame) -> DataFrame:
    """Resume: trials whose id is not in the decision log yet."""
    done = log.select(F.split("pair_id", "_")[0].alias("nct_id")).filter("nct_id IS NOT NULL").distinct()
    return linked.join(done, "nct_id", "left_anti")


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str] = ("nct_id", "pmid"), tie: str | None = None) -> DataFrame:
    """Old and new rows, the last one per key: new beats old, then the greater ``tie`` column.

    Without ``tie`` the updates must have one row per key; rows that tie all the same are told apart by a
    hash of their columns, so reruns agree.
    """
    both = existing.withColumn("_source", F.lit(0)).unionByName(
        updates.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    return keep_latest(both, keys, ["_source", tie] if tie else ["_source"]).drop("_source")


def pair_requests(pairs: DataFrame) -> DataFrame:
    """One adjudication request per ambiguous pair."""
    return pairs.filter(F.col("routing") == "llm").select(
        "pair_id",
        fill_template(
            presets.PAIR_REQUEST,
            bc_subtype=F.coalesce(F.nullif("bc_subtype", F.lit("")), F.lit("unknown_subtype")),
            bc_setting=F.coalesce(F.nullif("bc_setting", F.lit("")), F.lit("unknown_setting")),
            registered=normalise("registered_endpoint"),
            published=normalise("published_endpoint"),
        ).alias("request"),
    )


def parse_adjudications(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """``raw`` JSON answers to typed columns; an answer that breaks any rule becomes NULL and flagged."""
    rows = responses.withColumn("_body", strip_fences(F.col(raw)))
    rows = rows.withColumn("_p", F.from_json("_body", schemas.ADJUDICATION_SCHEMA))
    p = F.col("_p")
    valid = (
        p["switch_type"].isin(*presets.SWITCH_TYPES)
        & p["direction"].isin(*presets.SWITCH_DIRECTIONS)
        & p["confidence"].isin(*presets.ADJUDICATION_CONFIDENCES)
        & (F.length(p["step_by_step_reasoning"]) >= 20)
        & p["comparability_for_pooling"].isNotNull()
        & p["flag_for_human_review"].isNotNull()
    )
    ok = F.coalesce(F.try_parse_json("_body").isNotNull() & valid, F.lit(False))
    rows = rows.withColumn("llm_valid", ok)
    good = F.col("llm_valid")
    return rows.select(
        *[c for c in responses.columns if c != raw],
        "llm_valid",
        F.when(good, p["switch_type"]).alias("llm_switch_type"),
        F.when(good, p["direction"]).alias("llm_direction"),
        F.when(good, p["step_by_step_reasoning"]).alias("llm_reasoning"),
        F.when(good, p["confidence"]).alias("llm_confidence"),
        F.when(good, p["comparability_for_pooling"]).alias("llm_comparability"),
        F.when(good, p["flag_for_human_review"]).otherwise(True).alias("llm_flag"),
        F.when(good, F.coalesce(p["key_differences"], F.array().cast("array<string>"))).alias("key_differences"),
    )


def decision_entries(matched: DataFrame, adjudications: DataFrame, model: str) -> DataFrame:
    """New decision-log rows: layer-1 columns plus the adjudication of ambiguous pairs."""
    base = matched.select(
        "pair_id", F.col("primary_outcomes").alias("registered_endpoint"), "published_endpoint",
        "similarity_score", "ssi", "routing", "bc_subtype", "bc_setting",
    )
    joined = base.join(adjudications.withColumnRenamed("llm_flag", "_flag"), "pair_id", "left")
    asked = F.col("routing") == "llm"
    answers = {
        n: F.when(asked, F.col(n))
        for n in ("llm_switch_type", "llm_reasoning", "llm_confidence", "llm_comparability", "llm_direction", "key_differences")
    }
    return joined.withColumns(
        {
            **answers,
            "llm_model": F.when(asked, F.lit(model)),
            # No answer at all counts like an invalid one.
            "llm_flag": F.when(asked, F.coalesce("_flag", F.lit(True))),
            "human_reviewed": F.lit("no"),
        }
    ).drop("_flag", "llm_valid")


def call_cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return (
        prompt_tokens / 1000 * presets.COST_PER_1K_INPUT_USD
        + completion_tokens / 1000 * presets.COST_PER_1K_OUTPUT_USD
    )


def running_cost(
    calls: DataFrame, run: Sequence[str], order: Sequence[str], prompt: str, completion: str,
    ceiling: float = presets.COST_CEILING_USD, **limits,
) -> DataFrame:
    """Each call with its running cost and call number, and whether the total exceeds the ceiling."""
    priced = calls.withColumn("cost_usd", call_cost(F.col(prompt), F.col(completion)))
    totals = running_totals(
        priced, run, order, {"total_usd": F.col("cost_usd"), "total_calls": F.lit(1)}, **limits
    )
    return totals.withColumn("over_ceiling", F.col("total_usd") > ceiling)


def cost_summary(costed: DataFrame, run: Sequence[str], order: Sequence[str], digits: int = 6) -> DataFrame:
    """Per run: calls and cost up to and including the first call over the ceiling."""
    over = F.col("over_ceiling")
    stop = F.min(F.when(over, F.struct(*order, "total_calls", "total_usd"))).alias("_stop")
    last = F.max(F.struct("total_calls", "total_usd")).alias("_last")
    s, t = F.col("_stop"), F.col("_last")
    return costed.groupBy(*run).agg(stop, last).select(
        *run,
        s.isNotNull().alias("stopped"),
        F.coalesce(s["total_calls"], t["total_calls"]).alias("total_calls"),
        F.round(F.coalesce(s["total_usd"], t["total_usd"]), digits).alias("total_usd"),
    )
