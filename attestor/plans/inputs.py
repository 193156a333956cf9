"""Operator inputs derived from the star-schema test tables.

The test tables hold no clinical data, so each operator's input is a projection of a whole table.
The projections are plain SQL that every engine reads alike; ``{table}`` names a source table. List
columns are written as texts with ``|`` between the items (``*_list``) and split afterwards.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor.session import at_least_parallel

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables whose rows go on to costly text or grid work.
BUSY = ("orders", "lineitem", "documents", "part")

# Letters for digits turn a number into a word.
WORD = "translate(cast({0} as string), '0123456789', 'abcdefghij')"

SQL: dict[str, str] = {}

# Decision-log rows from orders; blank text means missing, as in the CSV logs.
SQL["log"] = """
SELECT *,
  CASE WHEN human_reviewed = 'no' THEN '' WHEN o_orderkey % 3 = 0 THEN
      CASE WHEN llm_switch_type <> '' THEN llm_switch_type WHEN routing = 'auto_concordant' THEN 'concordant' ELSE 'major_switch' END
    WHEN o_orderkey % 4 = 0 THEN 'concordant' WHEN o_orderkey % 4 = 1 THEN 'minor_modification'
    WHEN o_orderkey % 4 = 2 THEN 'moderate_switch' ELSE 'major_switch' END AS human_final_class,
  CASE WHEN human_reviewed = 'no' THEN '' WHEN o_custkey % 3 = 0 THEN 'False' ELSE 'True' END AS human_poolable,
  CASE WHEN human_reviewed = 'no' THEN '' WHEN o_orderkey % 5 = 0 THEN 'override' WHEN o_orderkey % 7 = 0 THEN 'exclude' ELSE 'confirm' END AS human_decision,
  CASE WHEN human_reviewed <> 'no' AND o_orderkey % 5 = 0 THEN 'Different time frame' ELSE '' END AS override_reason,
  CASE WHEN human_reviewed = 'no' THEN '' WHEN o_custkey % 4 = 0 THEN 'AB' WHEN o_custkey % 4 = 1 THEN 'CD' ELSE 'EF' END AS reviewer_initials,
  CASE WHEN human_reviewed = 'no' THEN '' WHEN o_orderkey % 29 = 0 THEN 'unknown' ELSE cast(cast(o_orderdate as date) as string) || ' 00:00:00' END AS review_timestamp
FROM (
  SELECT *,
    CASE WHEN routing <> 'llm' THEN '' WHEN o_custkey % 5 = 0 THEN 'concordant' WHEN o_custkey % 5 = 1 THEN 'minor_modification'
      WHEN o_custkey % 5 = 2 THEN 'moderate_switch' WHEN o_custkey % 5 = 3 THEN 'major_switch' ELSE '' END AS llm_switch_type,
    CASE WHEN routing <> 'llm' OR o_custkey % 5 = 4 THEN '' WHEN o_custkey % 3 = 0 THEN 'high' WHEN o_custkey % 3 = 1 THEN 'medium' ELSE 'low' END AS llm_confidence,
    CASE WHEN routing <> 'llm' THEN '' WHEN o_custkey % 5 = 4 OR o_orderkey % 7 = 0 THEN 'True' ELSE 'False' END AS llm_flag,
    CASE WHEN routing <> 'llm' OR o_custkey % 5 = 4 THEN '' WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS llm_comparability,
    CASE WHEN routing <> 'llm' OR o_custkey % 5 = 4 THEN '' ELSE 'Compared the wording of both texts for order ' || cast(o_orderkey as string) END AS llm_reasoning,
    round((1.0 - similarity_score) * 100, 4) AS ssi
  FROM (
    SELECT o_orderkey, o_custkey, o_orderdate, pair_id, registered_endpoint, published_endpoint, human_reviewed, similarity_score,
      CASE WHEN similarity_score >= 0.9 THEN 'auto_concordant' WHEN similarity_score >= 0.5 THEN 'llm' ELSE 'auto_major_switch' END AS routing
    FROM (
      SELECT o_orderkey, o_custkey, o_orderdate,
        'NCT' || lpad(cast(o_orderkey as string), 8, '0') || '_' || cast(20000000 + o_custkey as string) AS pair_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Overall survival at 60 months' WHEN '2-HIGH' THEN 'Progression-free survival (PFS)'
          WHEN '3-MEDIUM' THEN 'Pathological complete response | Disease-free survival' WHEN '5-LOW' THEN 'Quality of life (EORTC QLQ-C30)'
          ELSE CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'Tumour volume change' ELSE 'None' END END AS registered_endpoint,
        CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'The primary end point was met in arm ' || o_orderstatus END AS published_endpoint,
        CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'P' THEN 'spot_check' ELSE 'no' END AS human_reviewed,
        round(o_totalprice - floor(o_totalprice), 4) AS similarity_score
      FROM {orders}
    ) AS base
  ) AS routed
) AS adjudicated
"""

# Linked pairs with registered and published endpoint texts that overlap in part.
SQL["endpoint_texts"] = """
SELECT 'NCT' || lpad(cast(o_orderkey as string), 8, '0') AS nct_id, cast(20000000 + o_custkey as string) AS pmid,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Low' WHEN o_orderkey % 2 = 0 THEN 'High' ELSE 'Medium' END AS linkage_confidence,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Overall survival at five years | Safety' WHEN '2-HIGH' THEN 'Progression-free survival'
    WHEN '3-MEDIUM' THEN 'Pathological complete response | Overall  survival' WHEN '5-LOW' THEN 'Quality of life' ELSE ' ' END AS primary_outcomes,
  CASE o_custkey % 5 WHEN 0 THEN 'Overall survival' WHEN 1 THEN 'progression-free survival in arm ' || o_orderstatus
    WHEN 2 THEN 'Quality of life and overall survival' WHEN 3 THEN 'none' ELSE 'complete response, complete remission' END AS published_endpoint
FROM {orders}
"""

# Gold and second-reviewer labels on the orders whose key is a labelled document's.
SQL["gold"] = """
SELECT 'NCT' || lpad(cast(o_orderkey as string), 8, '0') || '_' || cast(20000000 + o_custkey as string) AS pair_id,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'concordant' WHEN quality = 1 THEN ' minor_modification '
    WHEN toxic = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'moderate_switch' ELSE '' END ELSE 'major_switch' END AS gold_switch_type,
  CASE WHEN quality = 1 AND doc_id % 4 <> 0 THEN 'concordant' WHEN quality = 1 THEN 'minor_modification'
    WHEN doc_id % 2 = 0 THEN 'moderate_switch' ELSE 'major_switch' END AS second_switch_type,
  CASE WHEN toxic = 0 THEN 'Yes' ELSE 'no' END AS second_poolable
FROM {labels} JOIN {orders} ON o_orderkey = doc_id
"""

# Registered trials for the power audit, with the spelling problems real registries have.
SQL["power_trials"] = """
SELECT 'NCT' || lpad(cast(o_orderkey as string), 8, '0') AS nct_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'abc' WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN '0'
    ELSE cast(cast(floor(o_totalprice / 100) as bigint) as string) || CASE WHEN o_orderkey % 5 = 0 THEN '.0' ELSE '' END END AS enrollment,
  CASE WHEN o_orderkey % 19 = 0 THEN substr(cast(cast(o_orderdate as date) as string), 1, 7)
    WHEN o_custkey % 23 = 0 THEN replace(cast(cast(o_orderdate as date) as string), '-', '/')
    ELSE cast(cast(o_orderdate as date) as string) END AS registration_date,
  CASE WHEN o_custkey % 6 = 0 THEN 0.2 ELSE NULL END AS event_rate
FROM {orders}
"""

# Effect sizes measured from line prices: per order and per supplier. A unit with one line has no error; the
# operators reject it.
_EFFECTS = """
SELECT {key} AS unit, count(*) AS n, avg(ln(l_extendedprice / (l_quantity * 1500))) AS y,
  stddev_samp(ln(l_extendedprice / (l_quantity * 1500))) / sqrt(count(*)) AS s,
  cast(min(cast(l_shipdate as date)) as string) AS registration_date
FROM {{lineitem}} GROUP BY {key}
"""
SQL["order_effects"] = """
SELECT 'NCT' || lpad(cast(o_orderkey as string), 8, '0') || '_' || cast(20000000 + o_custkey as string) AS pair_id,
  'NCT' || lpad(cast(o_orderkey as string), 8, '0') AS nct_id, e.registration_date,
  round(exp(e.y), 4) AS hr, round(exp(e.y - 1.96 * e.s), 4) AS hr_lci, round(exp(e.y + 1.96 * e.s), 4) AS hr_uci
FROM (""" + _EFFECTS.format(key="l_orderkey") + """) AS e JOIN {orders} ON o_orderkey = e.unit
"""
SQL["supplier_effects"] = """
SELECT 'NCT' || lpad(cast(s_suppkey as string), 8, '0') || '_1' AS pair_id,
  'NCT' || lpad(cast(s_suppkey as string), 8, '0') AS nct_id, r_name AS endpoint_cluster, e.registration_date,
  round(exp(e.y), 4) AS hr, round(exp(e.y - 1.96 * e.s), 4) AS hr_lci, round(exp(e.y + 1.96 * e.s), 4) AS hr_uci
FROM (""" + _EFFECTS.format(key="l_suppkey") + """) AS e JOIN {supplier} ON s_suppkey = e.unit
  JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey
"""

# Linkage audit rows: every order once, some orders again.
SQL["linkage_log"] = """
SELECT 'NCT' || lpad(cast(l_orderkey as string), 8, '0') AS nct_id,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN '' ELSE cast(30000000 + l_partkey as string) END AS pmid,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'manual' WHEN l_returnflag = 'A' THEN 'direct'
    WHEN l_returnflag = 'R' THEN 'fuzzy' ELSE 'author_date' END AS linkage_method,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'Unlinked' WHEN l_returnflag = 'A' OR l_quantity > 25 THEN 'High'
    WHEN l_returnflag = 'R' THEN 'Medium' ELSE 'Low' END AS linkage_confidence
FROM {lineitem}
"""

# Registry and publications for the linkage cascade: one of each per part.
_KEY = WORD.format("p_partkey") + " || 'ine'"
_BRAND = WORD.format("p_brand")
SQL["link_trials"] = f"""
SELECT 'NCT' || lpad(cast(p_partkey as string), 8, '0') AS nct_id,
  CASE WHEN p_size % 16 = 0 THEN '' ELSE 'Randomized trial of ' || p_name || ' ' || {_KEY} || ' versus ' || lower(p_type) || ' in ' || {_BRAND} || ' breast cancer' END AS official_title,
  CASE WHEN p_size % 16 = 0 AND p_partkey % 2 = 0 THEN p_name || ' ' || {_KEY} || ' in ' || {_BRAND} ELSE '' END AS brief_title,
  CASE WHEN p_size % 3 = 0 THEN '2015-06' WHEN p_size % 3 = 1 THEN 'Jun 2012' ELSE 'unknown' END AS completion_date,
  CASE WHEN p_size <= 6 THEN cast(20000000 + p_partkey as string) WHEN p_size = 7 THEN '99999999' ELSE '' END AS ctgov_pmid,
  'Overall survival | ' || p_name AS primary_outcomes,
  cast(p_size * 20 as string) AS enrollment, 'PHASE3' AS phase, '' AS results_first_posted_date,
  '20' || lpad(cast(p_partkey % 22 as string), 2, '0') || '-01-15' AS registration_date
FROM {{part}}
"""
SQL["link_pubs"] = f"""
SELECT cast(20000000 + p_partkey as string) AS pmid,
  CASE WHEN p_size <= 15 THEN 'Randomized trial of ' || p_name || ' ' || {_KEY} || ' versus ' || lower(p_type) || ' in ' || {_BRAND} || ' breast cancer'
    WHEN p_size <= 25 THEN p_name || ' ' || {_KEY} || ' versus ' || lower(p_type) || ' in ' || {_BRAND} || ' disease: final results'
    WHEN p_size <= 35 THEN 'Efficacy of ' || {_KEY} || ' for ' || {_BRAND} || ' patients'
    ELSE 'Notes on ' || p_name || ' manufacturing' END AS title,
  CASE WHEN p_size % 10 = 3 THEN 'Editorial' WHEN p_size % 10 = 4 THEN 'Journal Article'
    WHEN p_size % 10 = 5 THEN 'Review|Randomized Controlled Trial' ELSE 'Randomized Controlled Trial|Multicenter Study' END AS pub_types_list,
  'NCT' || lpad(cast(CASE WHEN p_size % 7 = 0 THEN p_partkey WHEN p_size % 7 = 1 THEN p_partkey - p_partkey % 3 ELSE -1 END as string), 8, '0') AS secondary_ids_list,
  'The primary outcome was reached in ' || cast(p_size as string) || ' months. ' || p_name AS abstract_text,
  'Author' || {_BRAND} AS authors_list,
  cast(2005 + p_partkey % 15 as string) AS pub_year,
  'J ' || p_type AS journal
FROM {{part}}
"""

# Articles from documents: whole texts, with type tags and phrases added by language and source.
SQL["articles"] = """
SELECT cast(10000000 + doc_id as string) AS pmid,
  CASE source WHEN 'src0' THEN 'Study protocol of a cohort' WHEN 'src1' THEN 'Editorial on practice'
    WHEN 'src2' THEN 'A systematic  review of outcomes' ELSE 'Outcomes of treatment ' || source END AS title,
  CASE WHEN source = 'src3' THEN 'Study Protocol' WHEN source = 'src4' THEN 'Letter|Comment'
    WHEN source = 'src5' THEN 'Meta-Analysis|Review' WHEN lang = 'en' THEN 'Randomized Controlled Trial|Multicenter Study'
    WHEN lang = 'fr' THEN 'Review|Clinical Trial' ELSE 'Journal Article' END AS pub_types_list,
  CASE source WHEN 'src6' THEN 'Humans|Research Design' WHEN 'src8' THEN 'Meta-Analysis as Topic' ELSE 'Humans' END AS mesh_terms_list,
  CASE WHEN source = 'src7' THEN '' WHEN n_chars % 3 = 0 THEN text || ' Patients were randomly assigned to two arms.'
    WHEN n_chars % 3 = 1 THEN text || ' This protocol describes the methods.' ELSE text END AS abstract_text,
  CASE lang WHEN 'en' THEN 'RESULTS' WHEN 'de' THEN 'FINDINGS' WHEN 'fr' THEN 'METHODS' ELSE '' END AS section_label,
  CASE WHEN n_chars % 4 = 0 THEN text || ' The primary end point was survival at ' || cast(n_chars as string) || ' months. More follows.'
    WHEN n_chars % 4 = 1 THEN 'Primary   outcome: response in ' || lang || '. ' || text ELSE text END AS section_text,
  'J ' || lang AS journal, cast(2000 + doc_id % 25 as string) AS pub_year
FROM {documents}
"""

# Population texts from parts.
SQL["population"] = """
SELECT 'NCT' || lpad(cast(p_partkey as string), 8, '0') AS nct_id,
  'Trial of ' || p_name || CASE p_type WHEN 'STANDARD' THEN ' in HER2-positive breast cancer' WHEN 'ECONOMY' THEN ' in triple-negative breast cancer'
    WHEN 'MEDIUM' THEN ' in hormone receptor-positive breast cancer' WHEN 'PROMO' THEN ' in lung cancer'
    WHEN 'SMALL' THEN ' in HER2-low luminal breast disease' ELSE ' in breast cancer' END AS title,
  CASE p_size % 4 WHEN 0 THEN 'Metastatic cancer' WHEN 1 THEN 'Adjuvant therapy|Surgery' WHEN 2 THEN 'Stage IV|recurrent' ELSE '' END AS conditions_list,
  CASE p_partkey % 5 WHEN 0 THEN 'Neoadjuvant chemotherapy planned' WHEN 1 THEN 'Enrolled after  surgery' WHEN 2 THEN 'ER-positive disease'
    WHEN 3 THEN 'HER2 - er positive' ELSE '' END AS eligibility,
  CASE WHEN p_size % 6 = 0 THEN '' ELSE 'Overall survival' END AS primary_outcomes
FROM {part}
"""

# Abstract sentences with effect sizes, one per line item, in every style and in broken ones.
_HR = "'0.' || lpad(cast(cast(l_quantity as bigint) + 40 as string), 2, '0')"
_LO = "'0.' || lpad(cast(cast(l_quantity as bigint) % 20 + 15 as string), 2, '0')"
_HI = "'1.' || lpad(cast(cast(l_quantity as bigint) + 10 as string), 2, '0')"
SQL["linked_lines"] = f"""
SELECT 'NCT' || lpad(cast(l_orderkey as string), 8, '0') AS nct_id,
  CASE WHEN l_tax = 0.08 THEN '' ELSE cast(l_partkey * 10 + l_linenumber as string) END AS pmid,
  CASE WHEN l_returnflag = 'N' AND l_quantity > 40 THEN 'Low' WHEN l_linestatus = 'O' THEN 'High' ELSE 'Medium' END AS linkage_confidence,
  cast(cast(l_shipdate as date) as string) AS registration_date,
  CASE WHEN l_discount = 0.1 THEN '  ' ELSE 'Background: part ' || cast(l_partkey as string) || ' was studied. Findings were as follows: ' || CASE l_linenumber
    WHEN 1 THEN 'HR ' || {_HR} || ' (95% CI ' || {_LO} || '-' || {_HI} || ')'
    WHEN 2 THEN 'hazard ratio, ' || replace({_HR}, '.', ',') || '; 95% CI, ' || {_LO} || ' to ' || {_HI}
    WHEN 3 THEN 'a hazard  ratio of ' || {_HR} || ' (' || {_LO} || ' to ' || {_HI} || ')'
    WHEN 4 THEN 'HR=' || {_HR} || ' [95%CI: ' || {_LO} || ', ' || {_HI} || ']'
    WHEN 5 THEN 'HR ' || {_HR} || ', 95% CI ' || {_LO} || '-' || {_HI}
    WHEN 6 THEN 'odds ratio ' || {_HR} || ' [95% CI ' || {_LO} || ', ' || {_HI} || ']'
    ELSE CASE l_returnflag WHEN 'A' THEN 'HR ' || {_HR} || ' (95% CI ' || {_HI} || '-' || {_LO} || '), later HR ' || {_HR} || ', 95% CI ' || {_LO} || '-' || {_HI}
      WHEN 'R' THEN 'HR 0.50 (95% CI 0.02-' || {_HI} || ')' ELSE 'no difference between arms' END END
    || '. Conclusion: see text. ' || l_returnflag END AS abstract_text
FROM {{lineitem}}
"""

# Review events from user events, and the log they refer to.
SQL["review_events"] = """
SELECT event_id, ts, 'NCT' || lpad(cast(user_id as string), 8, '0') || '_1' AS pair_id,
  CASE event_type WHEN 'click' THEN 'confirm' WHEN 'view' THEN 'defer' WHEN 'signup' THEN 'exclude' WHEN 'error' THEN 'override' ELSE 'confirm' END AS human_decision,
  CASE cast(floor(value) as bigint) % 5 WHEN 0 THEN 'concordant' WHEN 1 THEN 'minor_modification' WHEN 2 THEN 'moderate_switch' WHEN 3 THEN 'major_switch' ELSE 'concordant' END AS human_final_class,
  value > 60 AS human_poolable,
  CASE WHEN event_type = 'view' AND value < 10 THEN ' ' ELSE ' ab' END AS reviewer_initials,
  CASE WHEN event_type = 'error' AND value > 20 THEN 'Composite changed' ELSE '' END AS override_reason
FROM {events}
"""
SQL["review_log"] = """
SELECT 'NCT' || lpad(cast(s_suppkey as string), 8, '0') || '_1' AS pair_id,
  'Overall survival' AS registered_endpoint, CASE WHEN s_nationkey % 7 = 0 THEN '' ELSE 'Survival' END AS published_endpoint,
  round(s_acctbal - floor(s_acctbal), 4) AS similarity_score,
  CASE WHEN round(s_acctbal - floor(s_acctbal), 4) >= 0.9 THEN 'auto_concordant' WHEN round(s_acctbal - floor(s_acctbal), 4) >= 0.5 THEN 'llm' ELSE 'auto_major_switch' END AS routing,
  '' AS llm_confidence, '' AS llm_flag
FROM {supplier}
"""
SQL["calls"] = """
SELECT user_id, event_id, ts, cast(floor(value * 1000) as bigint) AS prompt_tokens, cast(floor(value * 100) as bigint) AS completion_tokens FROM {events}
"""

# Model answers from conversation turns: proper JSON, fenced JSON, invalid values, plain text.
_BS = "chr(92)"
_ESC = (
    f"replace(replace(replace(replace(replace(text, {_BS}, {_BS} || {_BS}), '\"', {_BS} || '\"'), chr(10), {_BS} || 'n'),"
    f" chr(9), {_BS} || 't'), chr(13), {_BS} || 'r')"
)
SQL["answers"] = f"""
SELECT cast(conv_id as string) || '_' || cast(turn as string) AS pair_id,
  CASE WHEN conv_id % 9 = 0 THEN text ELSE CASE WHEN turn % 2 = 0 THEN '```json' || chr(10) ELSE '' END
    || '{{{{"switch_type": "' || CASE conv_id % 6 WHEN 0 THEN 'concordant' WHEN 1 THEN 'minor_modification' WHEN 2 THEN 'moderate_switch' WHEN 3 THEN 'major_switch' WHEN 4 THEN 'concordant' ELSE 'unclear' END
    || '", "direction": "' || CASE turn % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'timeframe_changed' ELSE 'endpoint_replaced' END
    || '", "step_by_step_reasoning": "' || CASE WHEN conv_id % 8 = 3 THEN 'Too short' ELSE {_ESC} END
    || '", "confidence": "' || CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END
    || '", "comparability_for_pooling": ' || CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END
    || ', "flag_for_human_review": ' || CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END
    || CASE WHEN turn % 4 = 0 THEN ', "key_differences": ["time frame", "population"]' ELSE '' END
    || '}}}}' || CASE WHEN turn % 2 = 0 THEN chr(10) || '```' ELSE '' END END AS raw
FROM {{conversations}}
"""
# Arbiter verdicts for some of the articles.
SQL["verdict_answers"] = """
SELECT cast(10000000 + conv_id as string) AS pmid,
  '{{"verdict": "' || CASE conv_id % 4 WHEN 0 THEN 'Accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'maybe' ELSE 'uncertain' END
    || '", "article_type": "' || CASE conv_id % 3 WHEN 0 THEN 'primary_results' WHEN 1 THEN 'protocol' ELSE 'other' END
    || '", "confidence": "' || CASE conv_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END
    || '", "reason": "Checked.", "step1_signals": "' || min(role) || '", "step2_reasoning": "turns ' || cast(count(*) as string) || '"}}' AS raw
FROM {conversations} GROUP BY conv_id
"""

LISTS = ("pub_types", "secondary_ids", "authors", "mesh_terms", "conditions")


def source(name: str) -> str:
    """The projection's SQL with plain table names, for engines that have the tables as views."""
    sql = SQL[name]
    for table in TABLES:
        sql = sql.replace("{" + table + "}", table)
    return sql.replace("{{", "{").replace("}}", "}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame; ``x_list`` columns become arrays ``x``."""
    sql = SQL[name]
    used = {t: table(spark, sf_dir, t) for t in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql) if t in TABLES}
    used = {t: at_least_parallel(df) if t in BUSY else df for t, df in used.items()}
    df = spark.sql(sql, **used)
    for column in LISTS:
        if f"{column}_list" in df.columns:
            items = F.filter(F.split(F.col(f"{column}_list"), r"\|"), lambda x: x != "")
            df = df.withColumn(column, items).drop(f"{column}_list")
    return df
