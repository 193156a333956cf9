"""Registered queries of the pipeline operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import (
    bpe, conversation_repair, exact_dedup, language, media, mixing, near_dedup, packing, periodic_runs, positional_index, quality,
    substring_dedup, templates,
)
from attestor.llm.frames import crc_mod, table
from attestor.session import work_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    found = language.predict(docs.drop("lang", "source"), language.fit(docs.where(~held)), held)
    return found.select("doc_id", F.col("held").cast("boolean").alias("held_out"), "lang_pred", "score")


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE, decoded=True)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    digests = (F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "positions"))
    return packed.select("shard", "row", "n_tokens", "doc_ids", "parts", "ends", *digests)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "media")
    media.write_archives(table(spark, sf_dir, "documents"), folder)
    return media.features(media.read_archives(spark, folder))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 5) == 0
    model = quality.fit(docs.join(labels.where(~held).select("doc_id", "quality"), "doc_id"), "quality")
    found = quality.predict(docs, model, carry=held)
    return found.select("doc_id", F.col("held").cast("boolean").alias("held_out"), "score", "predicted")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_minhash_near_dedup, op2_language_id, op3_page_text, op4_bpe, op5_token_packing, op6_substring_dedup, op7_exact_dedup, op8_media,
        op9_source_mix, op10_quality, op11_decontamination, op12_periodic_runs, op13_conversation_repair,
    )
}

_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS shingle FROM d
        ), n AS (SELECT doc_id, count(shingle) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id), both_ AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
        ), reach AS (
            SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
        )
        SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) AS component_id,
               n.doc_id <= coalesce(min(reach.b), n.doc_id) AS kept
        FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
    """,
    "op6_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), v AS (
            SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest([array_to_string(w[i:i + 34], ' ') FOR i IN range(1, len(w) - 33)]) AS passage
            FROM d WHERE len(w) >= 35
        ), again AS (SELECT doc_id, i FROM v WHERE passage IN (SELECT passage FROM v GROUP BY passage HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM again),
        g AS (SELECT doc_id, count(*) AS n, list(i) AS places FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed,
               sha256(array_to_string([x FOR x, j IN w IF places IS NULL OR NOT list_contains(places, j)], ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
              FROM documents) WINDOW same AS (PARTITION BY t)
    """,
    "op9_source_mix": mixing.SQL,
    "op11_decontamination": positional_index.SQL,
}
