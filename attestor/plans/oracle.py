"""DuckDB SQL with the same result as each query, on the same tables.

The SQL is written for checking, not for scale: it states each operator's definition directly
(all pairs, correlated lookups, full grids) where the Spark operators avoid that work.
"""

from __future__ import annotations

from attestor import presets
from attestor.plans.inputs import source

ORACLE: dict[str, str] = {}


def _with(body: str, *inputs: str, **ctes: str) -> str:
    """``body`` after the named inputs and further common table expressions."""
    parts = [f"{name} AS ({source(name)})" for name in inputs] + [f"{n} AS ({sql})" for n, sql in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _rx(pattern: str, ignore_case: bool = True) -> str:
    return "'" + ("(?i)" if ignore_case else "") + pattern.replace("'", "''") + "'"


def _pct(part: str, total: str, digits: int = 1) -> str:
    return f"round({part} / greatest({total}, 1)::DOUBLE * 100, {digits})"


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


ROUTE = "CASE WHEN {0} >= 0.9 THEN 'auto_concordant' WHEN {0} >= 0.5 THEN 'llm' ELSE 'auto_major_switch' END"
REVIEWED = "human_reviewed IN ('yes', 'spot_check')"
SWITCHED = "human_final_class IN ('minor_modification', 'moderate_switch', 'major_switch')"
RANK = "substr(sha256({0}), 1, 16)"
NCT = "'NCT' || lpad(({0})::VARCHAR, 8, '0')"

# ------------------------------------------------------------------ similarity and routing
_DOT = "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]))), 4)"
ORACLE["pair_similarity_routing"] = f"""
SELECT {NCT.format('vec_id')} || '_' || (vec_id + 1)::VARCHAR AS pair_id, score AS similarity_score,
  round((1.0::DOUBLE - score) * 100, 4) AS ssi, {ROUTE.format('score')} AS routing
FROM (SELECT a.vec_id, {_DOT.format('a.embedding', 'b.embedding')} AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
"""
ORACLE["best_candidate_similarity"] = f"""
WITH heads AS (SELECT label, min(vec_id) AS head FROM embeddings GROUP BY label),
scored AS (
  SELECT e.vec_id, max({_DOT.format('c.embedding', 'h.embedding')}) AS score
  FROM embeddings e JOIN heads USING (label) JOIN embeddings h ON h.vec_id = heads.head
    JOIN embeddings c ON c.vec_id IN (e.vec_id, e.vec_id + 1)
  WHERE e.vec_id <> heads.head GROUP BY e.vec_id)
SELECT 'V' || e.vec_id::VARCHAR AS pair_id, coalesce(score, 0.0::DOUBLE) AS similarity_score, {ROUTE.format('coalesce(score, 0.0)')} AS routing
FROM embeddings e LEFT JOIN scored USING (vec_id)
"""
ORACLE["routing_governance"] = _with(
    "SELECT count(*) AS total_pairs, "
    + ", ".join(f"""{_pct(_n(f"routing = '{r}'"), 'count(*)')} AS pct_{r}""" for r in presets.ROUTINGS)
    + f""", {_pct(_n("routing = 'llm'"), 'count(*)')} AS llm_call_rate_pct, """
    + ", ".join(
        f"""{_pct(_n(f"llm_confidence = '{c}'"), _n("llm_confidence <> ''"))} AS confidence_{c}_pct"""
        for c in presets.ADJUDICATION_CONFIDENCES
    )
    + f""", {_pct(_n(REVIEWED), 'count(*)')} AS human_review_rate_pct,
    {_pct(_n(REVIEWED + " AND human_decision = 'override'"), _n(REVIEWED))} AS human_override_rate_pct FROM log""",
    "log",
)
_ROUTE_LABEL = "CASE routing WHEN 'auto_concordant' THEN 'Auto concordant' WHEN 'llm' THEN 'LLM adjudication' WHEN 'auto_major_switch' THEN 'Auto major switch' ELSE routing END"
ORACLE["routing_share"] = _with(
    f"SELECT {_ROUTE_LABEL} AS value, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM log) * 100, 1) AS pct FROM log GROUP BY ALL",
    "log",
)
ORACLE["confidence_share"] = _with(
    """SELECT llm_confidence AS value, count(*) AS n,
  round(count(*)::DOUBLE / (SELECT count(*) FROM log WHERE llm_confidence <> '') * 100, 1) AS pct
FROM log WHERE llm_confidence <> '' GROUP BY ALL""",
    "log",
)
ORACLE["override_band"] = _with(
    """SELECT reviewed, overrides, round(overrides / greatest(reviewed, 1)::DOUBLE, 4) AS override_rate,
  CASE WHEN overrides / greatest(reviewed, 1)::DOUBLE > 0.3 THEN 'high' WHEN overrides / greatest(reviewed, 1)::DOUBLE < 0.05 AND reviewed > 0 THEN 'low' ELSE 'normal' END AS band
FROM c""",
    "log",
    c=f"SELECT {_n(REVIEWED)} AS reviewed, {_n(REVIEWED + chr(32) + 'AND human_decision = ' + chr(39) + 'override' + chr(39))} AS overrides FROM log",
)
ORACLE["score_histogram"] = _with(
    """SELECT least(floor((similarity_score - low) / width), 34)::INTEGER AS bin,
  CASE WHEN human_final_class = '' THEN 'not yet reviewed' ELSE human_final_class END AS outcome,
  round(low + least(floor((similarity_score - low) / width), 34) * width, 6) AS bin_start, count(*) AS n
FROM log, b GROUP BY ALL""",
    "log",
    b="SELECT min(similarity_score) AS low, (max(similarity_score) - min(similarity_score)) / 35::DOUBLE AS width FROM log",
)

# ------------------------------------------------------------------ samples
ORACLE["stable_sample"] = f"SELECT doc_id::VARCHAR AS pair_id, lang FROM documents ORDER BY {RANK.format('doc_id::VARCHAR')}, pair_id LIMIT 20"


def _stratified(rows: str, stratum: str, strata, n: int, columns: str) -> str:
    quota = max(n // len(strata), 1)
    return f"""
SELECT {columns} FROM (
  SELECT *, CASE WHEN {stratum} IN ({_quoted(strata)}) AND row_number() OVER (PARTITION BY {stratum} ORDER BY {RANK.format('pair_id')}, pair_id) <= {quota} THEN 0 ELSE 1 END AS turn
  FROM ({rows})) ORDER BY turn, {RANK.format('pair_id')}, pair_id LIMIT {n}"""


ORACLE["stratified_sample"] = _stratified(
    "SELECT doc_id::VARCHAR AS pair_id, lang, source FROM documents", "lang", ("en", "fr", "de", "es"), 30, "pair_id, lang, source"
)
_SHEET = "pair_id, split_part(pair_id, '_', 1) AS nct_id, split_part(pair_id, '_', 2) AS pmid, registered_endpoint, published_endpoint"
_GOLD = _stratified("SELECT * FROM log WHERE registered_endpoint <> ''", "routing", presets.ROUTINGS, 20, "*")
ORACLE["gold_template"] = _with(f"SELECT {_SHEET}, '' AS gold_switch_type, '' AS gold_direction, '' AS notes FROM ({_GOLD})", "log")
ORACLE["gold_composition"] = _with(f"SELECT routing, count(*) AS n FROM ({_GOLD}) GROUP BY routing", "log")
ORACLE["gold_annotated"] = _with("SELECT count(*) FILTER (WHERE gold_switch_type <> '') AS completed, count(*) AS rows FROM gold", "gold")
_SPOT = f"""
SELECT pair_id FROM (SELECT pair_id, row_number() OVER (ORDER BY {RANK.format('pair_id')}, pair_id) AS no, count(*) OVER () AS total
  FROM log WHERE routing IN ('auto_concordant', 'auto_major_switch')) WHERE no <= floor(total * 0.1::DOUBLE)"""
ORACLE["spot_check"] = _with(_SPOT, "log")
ORACLE["second_rater"] = _with(
    f"""SELECT {_SHEET}, '' AS second_reviewer_initials, '' AS second_switch_type, '' AS second_poolable, '' AS notes
FROM (SELECT *, row_number() OVER (ORDER BY {RANK.format('pair_id')}, pair_id) AS no, count(*) OVER () AS total FROM log WHERE {REVIEWED})
WHERE no <= greatest(ceil(total * 0.1::DOUBLE), 1)""",
    "log",
)

# ------------------------------------------------------------------ agreement
_AI = """CASE WHEN llm_switch_type <> '' THEN llm_switch_type WHEN routing = 'auto_concordant' THEN 'concordant'
  WHEN routing = 'auto_major_switch' THEN 'major_switch' ELSE '' END"""
_TYPES = _quoted(presets.SWITCH_TYPES)
_CAL = f"""
SELECT *, CASE WHEN pos > 0 AND n > pos THEN (tp / pos::DOUBLE + tn / (n - pos)::DOUBLE) / 2 END AS auc0,
  CASE WHEN aimod > 0 THEN both_mod / aimod::DOUBLE ELSE 0.0::DOUBLE END AS pre, CASE WHEN mod > 0 THEN both_mod / mod::DOUBLE ELSE 0.0::DOUBLE END AS rec,
  CASE WHEN low > 0 THEN handled / low::DOUBLE END AS lowrate
FROM (
  SELECT count(*) AS n, {_n("g <> 'concordant'")} AS pos, {_n("g <> 'concordant' AND a <> 'concordant'")} AS tp,
    {_n("g = 'concordant' AND a = 'concordant'")} AS tn, {_n("g IN ('moderate_switch', 'major_switch')")} AS mod,
    {_n("a IN ('moderate_switch', 'major_switch')")} AS aimod,
    {_n("a IN ('moderate_switch', 'major_switch') AND g IN ('moderate_switch', 'major_switch')")} AS both_mod,
    {_n("llm_confidence = 'low'")} AS low, {_n(f"llm_confidence = 'low' AND (llm_flag = 'True' OR {REVIEWED})")} AS handled, {_n("g = a")} AS same
  FROM (SELECT log.*, trim(gold_switch_type) AS g, {_AI} AS a FROM log JOIN gold USING (pair_id))
  WHERE g IN ({_TYPES}) AND a IN ({_TYPES}))
"""
_ACTIONS = [
    ("coalesce(auc0 < 0.8, false)", presets.ACTIONS["auc"]),
    ("pre < 0.75", presets.ACTIONS["precision"]),
    ("rec < 0.8", presets.ACTIONS["recall"]),
    ("coalesce(lowrate < 0.8, false)", presets.ACTIONS["low_confidence"]),
]
_ACTION_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _ACTIONS) + "], lambda x: x IS NOT NULL)"
ORACLE["calibration_metrics"] = _with(
    f"""SELECT n AS n_gold_standard_pairs, round(auc0, 3) AS auc, round(pre, 3) AS precision_moderate_or_above,
  round(rec, 3) AS recall_moderate_or_above, round(lowrate, 3) AS low_confidence_flag_rate,
  round(same / n::DOUBLE * 100, 1) AS ai_human_agreement_rate_pct, coalesce(auc0 >= 0.8, true) AS auc_target_met,
  pre >= 0.75 AS precision_target_met, rec >= 0.8 AS recall_target_met, coalesce(lowrate >= 0.8, true) AS low_confidence_target_met,
  array_to_string({_ACTION_LIST}, ' ') AS recommended_actions FROM cal""",
    "log", "gold", cal=_CAL,
)
ORACLE["review_actions"] = _with(
    f"SELECT (i - 1)::INTEGER AS no, acts[i] AS action FROM (SELECT {_ACTION_LIST} AS acts FROM cal), range(1, 5) r(i) WHERE i <= len(acts)",
    "log", "gold", cal=_CAL,
)
ORACLE["inter_rater_kappa"] = _with(
    """SELECT n AS n_inter_rater_pairs, round(CASE WHEN pe < 1 THEN (same / n::DOUBLE - pe) / (1 - pe) END, 3) AS cohen_kappa,
  round(same / n::DOUBLE * 100, 1) AS classification_agreement_rate_pct, round(pool / n::DOUBLE * 100, 1) AS poolable_agreement_rate_pct
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS same, count(*) FILTER (WHERE pa = pb) AS pool FROM r),
  (SELECT sum(ca * cb)::DOUBLE / (SELECT count(*) * count(*) FROM r)::DOUBLE AS pe
   FROM (SELECT a, count(*) AS ca FROM r GROUP BY a) JOIN (SELECT b, count(*) AS cb FROM r GROUP BY b) ON a = b)""",
    "log", "gold",
    r=f"""SELECT human_final_class AS a, trim(second_switch_type) AS b, human_poolable = 'True' AS pa, lower(second_poolable) = 'yes' AS pb
FROM log JOIN gold USING (pair_id) WHERE human_final_class IN ({_TYPES}) AND trim(second_switch_type) IN ({_TYPES})""",
)
_CLASS_COLUMNS = ", ".join(f"""{_n(f"c = '{t}'")} AS {t}""" for t in presets.SWITCH_TYPES)
ORACLE["gold_matrix"] = _with(
    f"SELECT ai_switch, {_CLASS_COLUMNS} FROM (SELECT {_AI} AS ai_switch, gold_switch_type AS c FROM log JOIN gold USING (pair_id)) WHERE ai_switch <> '' GROUP BY ai_switch",
    "log", "gold",
)
ORACLE["class_heatmap"] = _with(
    f"SELECT {_ROUTE_LABEL} AS routing_label, {_CLASS_COLUMNS} FROM (SELECT *, human_final_class AS c FROM log WHERE human_final_class <> '') GROUP BY ALL",
    "log",
)
ORACLE["class_crosstab"] = (
    "SELECT lang AS lang_code, "
    + ", ".join(f"""{_n(f"quality = {q} AND toxic = {t}")} AS "{q}_{t}" """ for q in (0, 1) for t in (0, 1))
    + " FROM labels JOIN documents USING (doc_id) GROUP BY lang"
)
ORACLE["default_class"] = _with(
    f"""SELECT pair_id, CASE WHEN human_final_class <> '' THEN human_final_class WHEN llm_switch_type <> '' THEN llm_switch_type
    WHEN routing = 'auto_concordant' THEN 'concordant' ELSE 'major_switch' END AS shown_class,
  CASE WHEN human_poolable <> '' THEN human_poolable = 'True' ELSE llm_comparability = 'True' END AS shown_poolable, {_AI} AS ai_switch_type FROM log""",
    "log",
)

# ------------------------------------------------------------------ linkage
_TOKENS = "list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[a-zA-Z]+'), lambda w: length(w) > 1), lambda w: lower(w)))"
_JACCARD = """CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE
  ELSE round(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE, 4) END"""
ORACLE["token_jaccard"] = _with(
    f"SELECT nct_id, {_JACCARD.format(a='ta', b='tb')} AS score FROM (SELECT nct_id, {_TOKENS.format('official_title')} AS ta, {_TOKENS.format('title')} AS tb FROM link_trials JOIN link_pubs ON nct_id = 'NCT' || lpad((pmid::BIGINT - 20000000)::VARCHAR, 8, '0'))",
    "link_trials", "link_pubs",
)
_KEYWORDS = "array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace({0}, '[^\\w\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) > 2), ' ')"
ORACLE["title_key_words"] = _with(
    f"""SELECT 'document' AS kind, doc_id, {_KEYWORDS.format("(source || ' of ' || lang || ' titles: ' || n_chars::VARCHAR)")} AS key_words FROM documents
UNION ALL SELECT 'trial', substr(nct_id, 4)::BIGINT, {_KEYWORDS.format('official_title')} FROM link_trials""",
    "link_trials",
)

# The gate on the linkage publications: types, titles and abstracts only (no sections, no subjects).
_RESULTS_RX, _PROTOCOL_RX, _TITLE_RX = _rx(presets.RESULTS_LANGUAGE), _rx(presets.PROTOCOL_LANGUAGE), _rx(presets.REJECT_TITLE)


def _gated(rows: str, mesh: str, sections: str) -> str:
    """Gate columns over ``rows(pmid, title, abstract_text, pub_types_list, ..)``."""
    base = f"""
SELECT *, list_sort(list_intersect(types, [{_quoted(presets.REJECT_PUB_TYPES)}])) AS bad, list_sort(list_intersect(types, [{_quoted(presets.ACCEPT_PUB_TYPES)}])) AS good,
  list_sort(list_intersect({mesh}, [{_quoted(presets.REJECT_MESH)}])) AS badmesh, {sections} AS secs,
  regexp_extract(title, {_TITLE_RX}, 0) AS badtitle, abstract_text = '' AS noabs,
  regexp_matches(abstract_text, {_RESULTS_RX}) AS res, regexp_matches(abstract_text, {_PROTOCOL_RX}) AS pro
FROM (SELECT *, string_split(pub_types_list, '|') AS types FROM ({rows}))"""
    scored = f"""
SELECT *, (len(bad) * 3 + CASE WHEN badtitle <> '' THEN 3 ELSE 0 END + len(badmesh) * 2 + CASE WHEN pro THEN 3 ELSE 0 END + CASE WHEN noabs THEN 1 ELSE 0 END)::INTEGER AS reject_score,
  (len(good) * 2 + CASE WHEN len(secs) > 0 THEN 2 ELSE 0 END + CASE WHEN res THEN 2 ELSE 0 END)::INTEGER AS accept_score,
  list_concat(list_concat(list_transform(bad, lambda t: 'pub_type:REJECT:' || t), list_transform(good, lambda t: 'pub_type:ACCEPT:' || t)),
    list_concat(list_concat(CASE WHEN badtitle <> '' THEN ['title:REJECT:' || badtitle] ELSE [] END, list_transform(badmesh, lambda t: 'mesh:REJECT:' || t)),
      list_filter([CASE WHEN len(secs) > 0 THEN 'abstract_section:ACCEPT:' || array_to_string(secs, ', ') END,
        CASE WHEN res THEN 'abstract:ACCEPT:primary_outcome_language_detected' END, CASE WHEN pro THEN 'abstract:REJECT:protocol_future_tense_language_detected' END,
        CASE WHEN noabs THEN 'abstract:UNCERTAIN:no_abstract_text' END], lambda x: x IS NOT NULL))) AS sig
FROM ({base})"""
    cased = f"""
SELECT *, CASE WHEN len(bad) > 0 AND len(good) = 0 THEN 'reject' WHEN len(good) > 0 AND len(bad) = 0 AND badtitle = '' AND len(badmesh) = 0 THEN 'accept'
  WHEN reject_score >= accept_score + 3 THEN 'lean' ELSE 'open' END AS kase FROM ({scored})"""
    return f"""
SELECT *, CASE kase WHEN 'reject' THEN 'reject' WHEN 'lean' THEN 'reject' WHEN 'accept' THEN 'accept' ELSE 'uncertain' END AS verdict,
  CASE kase WHEN 'lean' THEN 'medium' WHEN 'open' THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN kase = 'accept' THEN 'primary_results' WHEN kase <> 'reject' THEN 'unknown'
    WHEN list_has_any(bad, ['Study Protocol', 'Clinical Study Design']) THEN 'protocol'
    WHEN list_has_any(bad, ['Meta-Analysis', 'Systematic Review', 'Review']) THEN 'systematic_review'
    WHEN list_has_any(bad, ['Editorial', 'Letter', 'Comment', 'News']) THEN 'editorial_letter' ELSE 'unknown' END AS article_type,
  kase IN ('lean', 'open') AS flag_for_review,
  CASE kase WHEN 'reject' THEN 'Rejected by publication type: ' || array_to_string(bad, ', ') || '.'
    WHEN 'accept' THEN 'Accepted by publication type: ' || array_to_string(good, ', ') || '.' || CASE WHEN len(secs) > 0 THEN ' It has a results section.' ELSE '' END
    WHEN 'lean' THEN 'Rejected by weight of signals (reject_score=' || reject_score || ', accept_score=' || accept_score || '). Signals: ' || array_to_string(sig, '; ') || '.'
    ELSE 'Signals do not decide (reject_score=' || reject_score || ', accept_score=' || accept_score || '). Passed on to the arbiter.' END AS why
FROM ({cased})"""


_NO_ARBITER = "' No answer from the arbiter: left to a person.'"
_LINK_GATE = _gated("SELECT * FROM link_pubs", "[]::VARCHAR[]", "[]::VARCHAR[]")
_NOTE = f"""'[Article gate: ' || upper(verdict) || ' | type=' || article_type || ' | conf=' || confidence || ' | tier=heuristic] ' || why || CASE WHEN kase = 'open' THEN {_NO_ARBITER} ELSE '' END"""
_LINK_CTES = {
    "kept": f"SELECT pmid, title, {_TOKENS.format('title')} AS tok, {_NOTE} AS note FROM ({_LINK_GATE}) WHERE NOT (verdict = 'reject' AND confidence = 'high')",
    "t": "SELECT *, CASE WHEN official_title <> '' THEN official_title ELSE brief_title END AS ttl FROM link_trials",
    "s0": "SELECT nct_id, t.ctgov_pmid AS pmid0 FROM t JOIN kept ON kept.pmid = t.ctgov_pmid",
    "s1": """SELECT u.nct_id, u.pmid1 FROM (SELECT secondary_ids_list AS nct_id, min(pmid) AS pmid1 FROM link_pubs GROUP BY 1 HAVING count(DISTINCT pmid) = 1) u
JOIN kept ON kept.pmid = u.pmid1""",
    "tt": f"SELECT nct_id, {_TOKENS.format('ttl')} AS tok FROM t",
    # All pairs that share a word.
    "tw": "SELECT nct_id, len(tok) AS na, unnest(tok) AS w FROM tt",
    "kw": "SELECT pmid, len(tok) AS nb, unnest(tok) AS w FROM kept",
    "sim": "SELECT nct_id, pmid, round(count(*) / (any_value(na) + any_value(nb) - count(*))::DOUBLE, 4) AS score FROM tw JOIN kw USING (w) GROUP BY nct_id, pmid",
    "s2": "SELECT nct_id, arg_min(pmid, pmid::BIGINT) AS pmid2, any_value(score) AS score FROM (SELECT *, max(score) OVER (PARTITION BY nct_id) AS top FROM sim WHERE score >= 0.5) WHERE score = top GROUP BY nct_id",
    "picked": """SELECT t.*, pmid0, pmid1, CASE WHEN pmid0 IS NULL AND pmid1 IS NULL THEN pmid2 END AS pmid2, CASE WHEN pmid0 IS NULL AND pmid1 IS NULL THEN score END AS score
FROM t LEFT JOIN s0 USING (nct_id) LEFT JOIN s1 USING (nct_id) LEFT JOIN s2 USING (nct_id)""",
    "joined": """SELECT picked.*, p.pmid, p.title AS article_title, p.abstract_text, p.authors_list, p.pub_year, p.journal, k.note,
  nullif(regexp_extract(completion_date, '(?:19|20)\\d{2}', 0), '') AS expected
FROM picked LEFT JOIN link_pubs p ON p.pmid = coalesce(pmid0, pmid1, pmid2) LEFT JOIN kept k ON k.pmid = p.pmid""",
    "linked": """SELECT *, coalesce(pmid0, pmid1) IS NOT NULL AS direct, pmid2 IS NOT NULL AND score >= 0.7 AS high,
  coalesce(abs(pub_year::INTEGER - expected::INTEGER) <= 2, false) AS yok FROM joined""",
}
_METHOD = "CASE WHEN direct THEN 'direct' WHEN high THEN 'fuzzy' WHEN pmid2 IS NOT NULL THEN 'author_date' ELSE 'manual' END"
_CONF = "CASE WHEN direct OR high THEN 'High' WHEN pmid2 IS NOT NULL AND yok THEN 'Medium' WHEN pmid2 IS NOT NULL THEN 'Low' ELSE 'Unlinked' END"
ORACLE["linkage_cascade"] = _with(
    f"""SELECT nct_id, coalesce(pmid, '') AS pmid, {_METHOD} AS linkage_method, {_CONF} AS linkage_confidence,
  coalesce(regexp_extract(abstract_text, '(?i)(primary\\s+end\\s*point|primary\\s+outcome)[^\\.\\n]*', 0), '') AS published_endpoint,
  coalesce(authors_list, '') AS first_author, coalesce(pub_year, '') AS pub_year, coalesce(journal, '') AS journal,
  CASE WHEN {_CONF} IN ('Low', 'Unlinked') THEN 'FLAGGED_FOR_REVIEW' ELSE '' END AS linkage_flag, score AS title_score FROM linked""",
    "link_trials", "link_pubs", **_LINK_CTES,
)
ORACLE["linkage_updates"] = ORACLE["linkage_cascade"]
ORACLE["linkage_notes"] = _with(
    f"""SELECT nct_id, pmid, {_METHOD} AS linkage_method, {_CONF} AS linkage_confidence, 'attestor-2' AS linked_by,
  CASE WHEN pmid0 IS NOT NULL THEN 'Submitted with the results: PMID ' || pmid0 || '. ' || note
    WHEN pmid1 IS NOT NULL THEN 'Only article that carries the trial''s id (PMID ' || pmid1 || '). ' || note
    WHEN high THEN 'Title similarity ' || printf('%.3f', score) || ' reaches 0.7. Article: ' || article_title || '. ' || note
    WHEN pmid2 IS NOT NULL AND yok THEN 'Title similarity ' || printf('%.3f', score) || ', published ' || pub_year || ' against completion ' || expected
      || ', first author ''' || authors_list || '''. Article: ' || article_title || '. ' || note
    WHEN pmid2 IS NOT NULL THEN 'Years disagree: published ''' || pub_year || ''', completed ''' || coalesce(expected, '') || ''' (from ''' || completion_date || '''). Title similarity '
      || printf('%.3f', score) || '. To be checked. ' || note
    WHEN ttl = '' THEN 'The trial has no title to search for.'
    ELSE 'No article title reaches a similarity of 0.5.' END AS notes FROM linked""",
    "link_trials", "link_pubs", **_LINK_CTES,
)
ORACLE["title_candidates"] = _with(
    """SELECT nct_id, rank::INTEGER AS rank, pmid, score FROM (
  SELECT *, row_number() OVER (PARTITION BY nct_id ORDER BY score DESC, pmid::BIGINT) AS rank FROM (
    SELECT nct_id, score, arg_min(pmid, pmid::BIGINT) AS pmid FROM (
      SELECT nct_id, sim.pmid, score, list_sort(kept.tok) AS tok FROM sim JOIN kept ON kept.pmid = sim.pmid WHERE score >= 0.5) GROUP BY nct_id, tok, score))
WHERE rank <= 5""",
    "link_trials", "link_pubs", **{k: _LINK_CTES[k] for k in ("kept", "t", "tt", "tw", "kw", "sim")},
)
ORACLE["unique_id_matches"] = _with(
    "SELECT secondary_ids_list AS nct_id, min(pmid) AS pmid FROM link_pubs GROUP BY 1 HAVING count(DISTINCT pmid) = 1", "link_pubs"
)
ORACLE["author_year_search"] = _with(
    "SELECT authors_list AS first_author, pub_year, pmid FROM (SELECT *, max(pub_year) OVER (PARTITION BY authors_list) AS last FROM link_pubs) WHERE pub_year = last",
    "link_pubs",
)
_LOW = "linkage_confidence IN ('Low', 'Unlinked')"
ORACLE["linkage_confidence_summary"] = _with(
    "SELECT count(*) AS total, "
    + ", ".join(f"""{_n(f"linkage_confidence = '{c}'")} AS {c.lower()}""" for c in presets.LINKAGE_CONFIDENCES)
    + f", {_n(_LOW)} AS flagged_for_review, "
    + ", ".join(f"""{_n(f"linkage_method = '{m}'")} AS method_{m}""" for m in presets.LINKAGE_METHODS)
    + " FROM linkage_log",
    "linkage_log",
)
_OPEN = f"({_LOW} OR (linkage_method = 'fuzzy' AND pmid LIKE '%7'))"
ORACLE["linkage_kpis"] = _with(
    f"""SELECT count(*) AS linked_trials, {_n("linkage_confidence = 'High'")} AS high_confidence, {_n("linkage_confidence = 'Medium'")} AS medium_confidence, {_n(_OPEN)} AS flagged FROM linkage_log""",
    "linkage_log",
)
ORACLE["linkage_queue"] = _with(f"SELECT nct_id, pmid, linkage_confidence, linkage_method FROM linkage_log WHERE {_OPEN}", "linkage_log")
ORACLE["linkage_log_view"] = _with("SELECT nct_id, pmid, linkage_confidence AS confidence, linkage_method AS method FROM linkage_log", "linkage_log")
ORACLE["linkage_counts"] = _with(
    """SELECT 'linkage_confidence' AS field, linkage_confidence AS value, count(*) AS n FROM linkage_log GROUP BY ALL
UNION ALL SELECT 'linkage_method', linkage_method, count(*) FROM linkage_log GROUP BY ALL""",
    "linkage_log",
)
_LINK_EVENTS = """SELECT *, 'NCT' || lpad(user_id::VARCHAR, 8, '0') AS nct_id, CASE event_type WHEN 'view' THEN 'Unlinked' WHEN 'click' THEN 'High' WHEN 'signup' THEN 'Medium' WHEN 'error' THEN 'Low' ELSE 'none' END AS conf,
  CASE WHEN value < 40 THEN '' ELSE (user_id + 20000000)::VARCHAR END AS pmid FROM events"""
ORACLE["link_review_fold"] = _with(
    """SELECT l.nct_id, CASE WHEN r.nct_id IS NULL THEN l.pmid WHEN conf = 'Unlinked' THEN '' ELSE r.pmid END AS pmid,
  CASE WHEN r.nct_id IS NULL THEN l.linkage_method ELSE 'manual' END AS linkage_method, coalesce(conf, l.linkage_confidence) AS linkage_confidence,
  CASE WHEN r.nct_id IS NULL THEN '' ELSE 'checked ' || event_type END AS linkage_notes,
  CASE WHEN conf IN ('Low', 'Unlinked') THEN 'FLAGGED_FOR_REVIEW' ELSE '' END AS linkage_flag,
  CASE WHEN p.pmid IS NULL THEN '' ELSE regexp_extract(p.abstract_text, '(?i)primary\\s+outcome[^\\.\\n]*', 0) END AS published_endpoint,
  coalesce(p.journal, '') AS journal
FROM l LEFT JOIN r ON r.nct_id = l.nct_id LEFT JOIN link_pubs p ON p.pmid = r.pmid AND conf <> 'Unlinked'""",
    "linkage_log", "link_pubs",
    l="SELECT nct_id, max(pmid) AS pmid, min(linkage_method) AS linkage_method, min(linkage_confidence) AS linkage_confidence FROM linkage_log GROUP BY nct_id",
    e=_LINK_EVENTS,
    r="SELECT * FROM e WHERE conf <> 'none' AND (conf = 'Unlinked' OR pmid <> '') QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY ts DESC, event_id DESC) = 1",
)

# ------------------------------------------------------------------ article gate
_ARTICLE_GATE = _gated(
    "SELECT * FROM articles", "string_split(mesh_terms_list, '|')",
    "CASE WHEN section_label IN ('RESULTS', 'FINDINGS') THEN [section_label] ELSE [] END",
)
ORACLE["article_gate"] = _with(
    f"""SELECT pmid, article_type, verdict, confidence, 'heuristic' AS tier, flag_for_review, reject_score, accept_score,
  why || CASE WHEN kase = 'open' THEN {_NO_ARBITER} ELSE '' END AS reason, array_to_string(sig, '; ') AS signals, NOT (verdict = 'reject' AND confidence = 'high') AS kept FROM g""",
    "articles", g=_ARTICLE_GATE,
)
_ARBITER = """SELECT pmid, CASE WHEN k IN ('primary_results', 'protocol') THEN k ELSE 'unknown' END AS article_type,
  CASE WHEN v IN ('accept', 'reject', 'uncertain') THEN v ELSE 'uncertain' END AS verdict, c AS confidence,
  '[LLM] ' || r || ' | Step1: ' || s1 || ' | Step2: ' || s2 AS reason, 'llm_step1:' || s1 || '; llm_step2:' || s2 AS signals
FROM (SELECT pmid, lower(raw::JSON->>'verdict') AS v, lower(raw::JSON->>'article_type') AS k, lower(raw::JSON->>'confidence') AS c,
  raw::JSON->>'reason' AS r, raw::JSON->>'step1_signals' AS s1, raw::JSON->>'step2_reasoning' AS s2 FROM verdict_answers)"""
_ARBITER_FLAG = "CASE WHEN verdict = 'reject' AND confidence IN ('high', 'medium') THEN true ELSE verdict = 'uncertain' OR confidence = 'low' END"
ORACLE["arbiter_verdicts"] = _with(
    f"SELECT pmid, article_type, verdict, confidence, {_ARBITER_FLAG} AS flag_for_review, reason, signals FROM v", "verdict_answers", v=_ARBITER
)
ORACLE["article_gate_merged"] = _with(
    f"""SELECT g.pmid, CASE WHEN m THEN v.article_type ELSE g.article_type END AS article_type, CASE WHEN m THEN v.verdict ELSE g.verdict END AS verdict,
  CASE WHEN m THEN v.confidence ELSE g.confidence END AS confidence, CASE WHEN m THEN 'llm' ELSE 'heuristic' END AS tier,
  CASE WHEN m THEN v.flag ELSE g.flag_for_review END AS flag_for_review, reject_score, accept_score,
  CASE WHEN m THEN v.reason WHEN kase = 'open' THEN why || {_NO_ARBITER} ELSE why END AS reason,
  NOT (CASE WHEN m THEN v.verdict = 'reject' AND v.confidence = 'high' ELSE g.verdict = 'reject' AND g.confidence = 'high' END) AS kept
FROM (SELECT g.*, kase = 'open' AND g.pmid IN (SELECT pmid FROM v) AS m FROM g) g LEFT JOIN (SELECT *, {_ARBITER_FLAG} AS flag FROM v) v ON v.pmid = g.pmid""",
    "articles", "verdict_answers", g=_ARTICLE_GATE, v=_ARBITER,
)
ORACLE["arbiter_requests"] = _with(
    """SELECT pmid, 'Does this article report the main results of a trial? Answer in JSON.' || chr(10) || title || chr(10)
  || 'In: ' || journal || ', ' || pub_year || '; indexed as: ' || array_to_string(list_sort(types), ', ') || chr(10)
  || 'Summary: ' || CASE WHEN abstract_text = '' THEN '(no abstract available)' ELSE abstract_text END || chr(10) AS request FROM g WHERE kase = 'open'""",
    "articles", g=_ARTICLE_GATE,
)

# ------------------------------------------------------------------ text rules
_FLAGS = ", ".join(f"regexp_matches(words, {_rx(p)}) AS f_{n}" for n, p in presets.POPULATION_PATTERNS.items())
_POP = f"""
SELECT *, CASE WHEN NOT f_breast THEN 'non_breast_excluded' WHEN bc_subtype = 'unknown_subtype' OR bc_setting = 'unknown_setting' THEN 'bc_flagged' ELSE 'bc_confirmed' END AS population_class
FROM (
  SELECT *, CASE WHEN NOT f_breast THEN 'unknown_subtype' WHEN f_tnbc THEN 'tnbc' WHEN f_her2_pos AND NOT f_her2_neg THEN 'her2_positive'
      WHEN f_hr_pos AND (f_her2_neg OR NOT f_her2_pos) THEN 'hr_positive' ELSE 'unknown_subtype' END AS bc_subtype,
    CASE WHEN NOT f_breast THEN 'unknown_setting' WHEN f_neoadjuvant AND NOT f_adjuvant AND NOT f_metastatic THEN 'neoadjuvant'
      WHEN f_adjuvant AND NOT f_neoadjuvant AND NOT f_metastatic THEN 'adjuvant' WHEN f_metastatic THEN 'metastatic'
      WHEN f_neoadjuvant AND f_adjuvant THEN 'neoadjuvant' ELSE 'unknown_setting' END AS bc_setting
  FROM (SELECT *, {_FLAGS} FROM (SELECT *, {{words}} AS words FROM population)))
"""
_POP_WORDS = "title || ' ' || CASE WHEN conditions_list = '' THEN '' ELSE replace(conditions_list, '|', ' ') || ' ' END || eligibility"
_POPULATION = _POP.replace("{words}", _POP_WORDS)
ORACLE["population_classify"] = _with("SELECT nct_id, population_class, bc_subtype, bc_setting FROM p", "population", p=_POPULATION)
ORACLE["population_counts"] = _with(
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM p WHERE population_class <> 'non_breast_excluded' GROUP BY ALL"
        for c in ("population_class", "bc_subtype", "bc_setting")
    ),
    "population", p=_POPULATION,
)
_RETAINED = "population_class <> 'non_breast_excluded'"
ORACLE["population_summary"] = _with(
    f"""SELECT count(*) AS fetched, {_n(_RETAINED)} AS retained, {_n("population_class = 'bc_flagged'")} AS flagged,
  {_n(_RETAINED + " AND primary_outcomes <> ''")} AS with_registered_endpoint FROM p""",
    "population", p=_POPULATION,
)
_CLUSTER = (
    "CASE WHEN lower(trim(registered_endpoint)) IN ('', 'none', 'nan') THEN 'missing_endpoint' "
    + " ".join(
        f"WHEN regexp_matches(lower(registered_endpoint), {_rx('|'.join(ps))}) THEN '{name}'" for name, ps in presets.CLUSTER_RULES
    )
    + " ELSE 'other_endpoints' END"
)
ORACLE["endpoint_cluster"] = _with(f"SELECT {_CLUSTER} AS endpoint_cluster, pair_id FROM log", "log")
ORACLE["cluster_sizes"] = _with(f"SELECT {_CLUSTER} AS endpoint_cluster, count(*) AS n_pairs FROM log GROUP BY ALL", "log")
_HITS = ", ".join(
    f"nullif(trim(regexp_replace(regexp_extract(space, {_rx(p)}, 0), '\\s+', ' ', 'g')), '')" for p in presets.ENDPOINT_PATTERNS
)
ORACLE["published_endpoint"] = _with(
    f"""SELECT pmid, coalesce({_HITS}, space) AS published_endpoint FROM (
  SELECT pmid, CASE WHEN abstract_text = '' THEN '' WHEN section_label IN ('RESULTS', 'FINDINGS') AND section_text <> '' THEN section_text ELSE abstract_text END AS space FROM articles)""",
    "articles",
)
ORACLE["flat_markup"] = r"""
SELECT page_id, trim(regexp_replace(regexp_replace(html,
  '</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|''[^'']*''))*\s*/?>|<!--(?s:.*?)-->|<[!?][^<>]*>', '', 'g'), '\s+', ' ', 'g')) AS flat_text FROM pages
"""
_SEARCH = " OR ".join(
    f"regexp_matches({c}, '(?i)survival (at|\\(pfs)|order 1')" for c in ("pair_id", "registered_endpoint", "published_endpoint", "llm_reasoning", "reviewer_initials")
)
ORACLE["text_filter"] = _with(
    f"SELECT pair_id, llm_confidence FROM log WHERE routing = 'llm' AND llm_confidence IN ('low', 'medium') AND ({_SEARCH})", "log"
)
ORACLE["document_search"] = "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de', 'fr', 'es') AND regexp_matches(text, '(?i)licen[cs]e|copyright')"
ORACLE["document_search_indexed"] = """SELECT doc_id, lang, pattern FROM documents, (VALUES ('licen[cs]e|copyright'), ('v[0-9]')) AS p (pattern)
WHERE lang IN ('en', 'de', 'fr', 'es') AND regexp_matches(text, '(?i)' || pattern)"""

# ------------------------------------------------------------------ effect extraction
_TRY = []
for _i, (_method, _p) in enumerate(presets.EFFECT_PATTERNS):
    _g = [f"try_cast(replace(regexp_extract(words, {_rx(_p)}, {k}), ',', '.') AS DOUBLE)" for k in (1, 2, 3)]
    _TRY.append(
        f"CASE WHEN {_g[1]} < {_g[0]} AND {_g[0]} < {_g[2]} AND {_g[1]} > 0 AND {_g[0]} BETWEEN 0.05 AND 10 AND {_g[2]} / {_g[1]} <= 20 "
        f"THEN {{'method': '{_method}', 'hr': {_g[0]}, 'lci': {_g[1]}, 'uci': {_g[2]}, 'snip': regexp_extract(words, {_rx(_p)}, 0)}} END"
    )
_EXTRACT = f"""
SELECT nct_id, pmid, nct_id || '_' || CASE WHEN pmid = '' THEN 'unlinked' ELSE pmid END AS pair_id, registration_date, words, e.method, e.hr, e.lci, e.uci,
  round(ln(e.hr), 6) AS log_hr, round((ln(e.uci) - ln(e.lci)) / 3.92::DOUBLE, 6) AS se,
  trim(substr(words, greatest(strpos(words, e.snip) - 30, 1), strpos(words, e.snip) - greatest(strpos(words, e.snip) - 30, 1) + length(e.snip) + 30)) AS ctx,
  CASE WHEN pmid = '' THEN '{presets.EXTRACTION_REASONS['no_pmid']}' WHEN trim(abstract_text) = '' THEN '{presets.EXTRACTION_REASONS['empty_abstract']}'
    WHEN e IS NULL THEN '{presets.EXTRACTION_REASONS['no_match']}' END AS reason
FROM (SELECT *, coalesce({', '.join(_TRY)}) AS e FROM (SELECT *, CASE WHEN pmid <> '' AND trim(abstract_text) <> '' THEN trim(abstract_text) END AS words
  FROM linked_lines WHERE linkage_confidence IN ('High', 'Medium')))
"""
ORACLE["hr_extract"] = _with(
    """SELECT pair_id, nct_id, pmid, hr, lci AS hr_lci, uci AS hr_uci, log_hr, se AS se_log_hr, round(se * se, 8) AS variance, method AS extraction_method,
  'PMID:' || pmid || ' — ' || ctx AS source_reference, registration_date FROM x WHERE reason IS NULL""",
    "linked_lines", x=_EXTRACT,
)
ORACLE["hr_extract_audit"] = _with(
    """SELECT nct_id, pmid, pair_id, hr, lci AS hr_lci, uci AS hr_uci, log_hr, se AS se_log_hr, coalesce(method, 'failed') AS extraction_method, ctx AS source_text,
  reason IS NOT NULL OR method = 'rr_or_fallback' AS requires_manual_check, coalesce(reason, '') AS exclusion_reason, registration_date FROM x""",
    "linked_lines", x=_EXTRACT,
)
ORACLE["hr_extract_summary"] = _with(
    f"""SELECT count(*) AS processed, {_n("reason IS NULL")} AS extracted, {_n("reason IS NOT NULL")} AS failed, {_n("method = 'rr_or_fallback'")} AS manual_check FROM x""",
    "linked_lines", x=_EXTRACT,
)
ORACLE["effect_json"] = _with(
    "SELECT method AS extraction_method, count(*) AS n, round(sum(log_hr), 4) AS log_hr, min(registration_date) AS first_date FROM x WHERE reason IS NULL GROUP BY method",
    "linked_lines", x=_EXTRACT,
)
ORACLE["effect_array_json"] = ORACLE["effect_json"]
ORACLE["csv_one_file"] = """SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, coalesce(role, '') AS role, md5(coalesce(text, '')) AS text_md5,
  len(string_split(coalesce(text, ''), chr(10)))::INT AS lines FROM conversations"""


def _fields(name: str) -> str:
    return f"""SELECT *, round(ln(hr), 6) AS log_hr, round((ln(hr_uci) - ln(hr_lci)) / 3.92::DOUBLE, 6) AS se_log_hr,
  round(round((ln(hr_uci) - ln(hr_lci)) / 3.92::DOUBLE, 6) * round((ln(hr_uci) - ln(hr_lci)) / 3.92::DOUBLE, 6), 8) AS variance FROM {name}"""


_FINE = "hr_lci < hr AND hr < hr_uci AND hr_lci > 0 AND hr BETWEEN 0.05 AND 10 AND hr_uci / hr_lci <= 20"
_ORDER_EFFECTS = f"SELECT * FROM ({_fields('order_effects')}) WHERE {_FINE} AND se_log_hr > 0 AND variance > 0"
_SUPPLIER_EFFECTS = f"SELECT * FROM ({_fields('supplier_effects')}) WHERE se_log_hr > 0"
ORACLE["effect_sizes"] = _with("SELECT pair_id, hr, hr_lci, hr_uci, log_hr, se_log_hr, variance FROM e", "order_effects", e=_ORDER_EFFECTS)
ORACLE["effect_validation"] = _with(
    f"""SELECT pair_id, CASE WHEN hr_lci IS NULL THEN 'missing' WHEN NOT (hr_lci < hr AND hr < hr_uci) THEN 'order' WHEN NOT ({_FINE}) THEN 'range' ELSE '' END AS problem,
  concat_ws(',', CASE WHEN NOT hr > 0 THEN 'hr_positive' END, CASE WHEN NOT coalesce(hr_lci > 0, false) THEN 'hr_lci_positive' END, CASE WHEN NOT coalesce(hr_uci > 0, false) THEN 'hr_uci_positive' END,
    CASE WHEN NOT coalesce(se_log_hr > 0, false) THEN 'se_log_hr_positive' END, CASE WHEN NOT coalesce(variance + CASE WHEN hr > 3 THEN 0.001 ELSE 0 END > 0, false) THEN 'variance_positive' END,
    CASE WHEN se_log_hr IS NULL THEN 'se_log_hr' END, CASE WHEN hr > 3 OR variance IS NULL THEN 'variance_value' END) AS violations FROM ({_fields('order_effects')})""",
    "order_effects",
)
ORACLE["decision_validation"] = _with(
    """SELECT pair_id, concat_ws(',', CASE WHEN o_orderkey % 6 = 0 THEN 'ssi_consistency' END,
  CASE WHEN human_decision = 'override' AND (o_custkey % 2 <> 0 OR override_reason = '') THEN 'override_reason' END) AS violations FROM log""",
    "log",
)

# ------------------------------------------------------------------ pooling and power


def _pool_ctes(effects: str, groups: str, prefix: bool = False, interval: bool = True) -> dict[str, str]:
    """Grid posterior over ``effects(unit columns, log_hr, se_log_hr)`` per ``groups``.

    With ``prefix`` the sums run over the first rows by date, and a posterior belongs to each row.
    """
    g = f"{groups}, " if groups else ""
    key = f"{g}pair_id" if prefix else groups
    k = f"{key}, " if key else ""
    # Midpoints of v with tau = 3 v^3: finer than the engine's nodes, and without an edge at 0.
    v = "((r.j + 0.5::DOUBLE) / 1600)"
    cells = f"""SELECT e.*, r.j, 3 * power({v}, 3) AS tau,
  1.0::DOUBLE / (se_log_hr * se_log_hr + 9 * power({v}, 6)) AS w FROM ({effects}) e, range(0, 1600) r(j)"""
    if prefix:
        over = f"OVER (PARTITION BY {g}j ORDER BY registration_date, pair_id ROWS UNBOUNDED PRECEDING)"
        sums = f"""SELECT {k}j, tau, count(*) {over} AS n, sum(w) {over} AS sw, sum(w * log_hr) {over} AS swy, sum(w * log_hr * log_hr) {over} AS swyy, sum(ln(w)) {over} AS slw FROM cells"""
    else:
        sums = f"SELECT {k}j, tau, count(*) AS n, sum(w) AS sw, sum(w * log_hr) AS swy, sum(w * log_hr * log_hr) AS swyy, sum(ln(w)) AS slw FROM cells GROUP BY {k}j, tau"
    part = f"PARTITION BY {key}" if key else ""
    by = f"GROUP BY {key}" if key else ""
    out = {
        "cells": cells,
        "sums": sums,
        "post": "SELECT *, swy / prec AS m FROM (SELECT *, 4.0::DOUBLE + sw AS prec FROM sums)",
        "weighed": "SELECT *, 0.5 * slw - 0.5 * ln(prec) - 0.5 * (swyy - prec * m * m) - tau * tau / 0.5::DOUBLE + 2 * ln(j + 0.5::DOUBLE) AS lp FROM post",
        "raised": f"SELECT *, exp(lp - max(lp) OVER ({part})) AS ex FROM weighed",
        "probs": f"SELECT *, ex / sum(ex) OVER ({part}) AS p FROM raised",
        "moments": f"""SELECT {k}max(n) AS n_trials, sum(p * m) AS mu, sum(p * tau) AS tau_mean,
  sqrt(greatest(sum(p * (1 / prec + m * m)) - sum(p * m) * sum(p * m), 1e-300)) AS mu_sd,
  sqrt(greatest(sum(p * tau * tau) - sum(p * tau) * sum(p * tau), 0)) AS tau_sd FROM probs {by}""",
    }
    if interval:
        join = f"JOIN moments USING ({key})" if key else ", moments"
        out |= {
            "grid": f"""SELECT {k}k, any_value(mu) AS mu, any_value(mu_sd) * (10.0::DOUBLE / 400) AS step,
  sum(p * sqrt(prec / (2 * pi())) * exp(-0.5 * prec * power(mu + (k + 0.5::DOUBLE - 200) * (mu_sd * (10.0::DOUBLE / 400)) - m, 2))) AS dens
FROM probs {join}, range(0, 400) r(k) GROUP BY {k}k""",
            "ranked": f"""SELECT *, coalesce(sum(dens) OVER ({part} ORDER BY dens DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(dens) OVER ({part}) AS before FROM grid""",
            "hdi": f"SELECT {k}min(mu + (k - 200) * step) AS lo, max(mu + (k - 199) * step) AS hi FROM ranked WHERE before < 0.95 {by}",
        }
    return out


_POOLED = """n_trials, round(exp(mu), 5) AS pooled_hr, round(exp(lo), 5) AS pooled_hr_cri_lower, round(exp(hi), 5) AS pooled_hr_cri_upper,
  round(tau_mean, 5) AS tau_mean, round(tau_sd, 5) AS tau_sd"""
ORACLE["pool_full"] = _with(
    f"SELECT endpoint_cluster, {_POOLED} FROM moments JOIN hdi USING (endpoint_cluster)", "supplier_effects",
    **_pool_ctes(_SUPPLIER_EFFECTS, "endpoint_cluster"),
)
ORACLE["posterior_hdi"] = _with(
    "SELECT endpoint_cluster, round(lo, 5) AS mu_lower, round(hi, 5) AS mu_upper FROM hdi", "supplier_effects",
    **_pool_ctes(_SUPPLIER_EFFECTS, "endpoint_cluster"),
)
ORACLE["pool_overall"] = _with(f"SELECT {_POOLED} FROM moments, hdi", "supplier_effects", **_pool_ctes(_SUPPLIER_EFFECTS, ""))
ORACLE["pool_sequential"] = _with(
    """SELECT nct_id, registration_date, n_trials, round(exp(mu), 5) AS mu_mean, round(exp(lo), 5) AS mu_hdi_lower, round(exp(hi), 5) AS mu_hdi_upper,
  round(tau_mean, 5) AS tau_mean, round(tau_sd, 5) AS tau_sd FROM moments JOIN hdi USING (pair_id) JOIN supplier_effects USING (pair_id)""",
    "supplier_effects", **_pool_ctes(_SUPPLIER_EFFECTS, "", prefix=True),
)
ORACLE["pool_sequential_grouped"] = _with(
    """SELECT m.endpoint_cluster, s.nct_id, n_trials, round(exp(mu), 5) AS mu_mean, round(tau_mean, 5) AS tau_mean, round(tau_sd, 5) AS tau_sd
FROM moments m JOIN supplier_effects s USING (pair_id)""",
    "supplier_effects", **_pool_ctes(_SUPPLIER_EFFECTS, "endpoint_cluster", prefix=True, interval=False),
)
_APPROVED = f"SELECT e.*, {_CLUSTER} AS endpoint_cluster FROM ({_ORDER_EFFECTS}) e JOIN log USING (pair_id) WHERE human_poolable = 'True'"
ORACLE["pool_clusters"] = _with(
    f"SELECT endpoint_cluster, {_POOLED} FROM moments JOIN hdi USING (endpoint_cluster)", "log", "order_effects",
    **_pool_ctes(_APPROVED, "endpoint_cluster"),
)
ORACLE["poolable_semi"] = _with(
    "SELECT pair_id, e.log_hr, e.se_log_hr FROM e JOIN log USING (pair_id) WHERE human_poolable = 'True' AND human_decision IN ('confirm', 'override')",
    "log", "order_effects", e=_ORDER_EFFECTS,
)
_VARIANCES = f"SELECT {_CLUSTER} AS endpoint_cluster, e.variance FROM ({_ORDER_EFFECTS}) e JOIN log USING (pair_id)"
ORACLE["variance_median"] = _with(
    f"SELECT endpoint_cluster, round(median(variance), 8) AS sigma2 FROM ({_VARIANCES}) GROUP BY ALL", "log", "order_effects"
)
_Z = "2.8015852166"  # z(0.975) + z(0.8), to more digits than the 4-decimal result needs
_SIZE = "trunc(try_cast(enrollment AS DOUBLE))::BIGINT"
_RATE = "coalesce(event_rate, 0.15)::DOUBLE"
_IMPLIED = f"round(exp(-2.0::DOUBLE * {_Z}::DOUBLE / sqrt({_SIZE} * {_RATE})), 4)"
ORACLE["power_back_calc"] = _with(f"SELECT nct_id, {_IMPLIED} AS assumed_hr FROM power_trials WHERE {_SIZE} > 0", "power_trials")
_POWER_CTES = {
    **_pool_ctes(_SUPPLIER_EFFECTS, "", prefix=True, interval=False),
    "seq": "SELECT n_trials AS n, exp(mu) AS hr, registration_date::DATE AS d FROM moments JOIN supplier_effects USING (pair_id)",
    "days": """SELECT day, (SELECT max_by(hr, n) FROM seq WHERE d < day) AS posterior FROM (SELECT DISTINCT
  try_cast(CASE WHEN length(registration_date) = 10 THEN replace(registration_date, '/', '-') END AS DATE) AS day FROM power_trials) WHERE day IS NOT NULL""",
    "audit": f"""SELECT nct_id, greatest(coalesce({_SIZE}, 0), 1) AS enrollment, coalesce(CASE WHEN {_SIZE} > 0 THEN {_IMPLIED} END, 1.0::DOUBLE) AS assumed_hr, {_RATE} AS assumed_event_rate,
  CASE WHEN {_SIZE} > 0 THEN posterior END AS posterior_hr_at_registration, CASE WHEN {_SIZE} > 0 THEN round({_IMPLIED} - posterior, 4) END AS optimism_bias,
  CASE WHEN coalesce({_SIZE}, 0) <= 0 THEN 'missing_or_invalid_enrollment' END AS excluded_reason
FROM power_trials LEFT JOIN days ON length(registration_date) = 10 AND day = try_cast(replace(registration_date, '/', '-') AS DATE)""",
}
ORACLE["power_audit_asof"] = _with(
    "SELECT nct_id, enrollment, assumed_hr, assumed_event_rate, round(posterior_hr_at_registration, 5) AS posterior_hr_at_registration, excluded_reason FROM audit",
    "power_trials", "supplier_effects", **_POWER_CTES,
)
ORACLE["power_kpis"] = _with(
    f"""SELECT count(*) AS audited, {_n("excluded_reason IS NULL")} AS included, {_n("excluded_reason IS NOT NULL")} AS excluded, round(avg(optimism_bias), 3) AS mean_bias,
  {_n("optimism_bias < -0.05")} AS below_evidence, {_n("optimism_bias > 0.05")} AS above_evidence FROM audit""",
    "power_trials", "supplier_effects", **_POWER_CTES,
)
ORACLE["power_excluded"] = _with(
    "SELECT nct_id, excluded_reason AS reason FROM audit WHERE excluded_reason IS NOT NULL", "power_trials", "supplier_effects", **_POWER_CTES
)
ORACLE["power_scatter"] = _with(
    """SELECT round(least(min(posterior_hr_at_registration), min(assumed_hr)) * 0.95::DOUBLE, 4) AS axis_min,
  round(greatest(max(posterior_hr_at_registration), max(assumed_hr)) * 1.05::DOUBLE, 4) AS axis_max FROM audit WHERE posterior_hr_at_registration IS NOT NULL""",
    "power_trials", "supplier_effects", **_POWER_CTES,
)
ORACLE["bias_histogram"] = _with(
    """SELECT b::INTEGER AS bin, round(-2.0::DOUBLE + b * 0.15::DOUBLE, 6) AS bin_start, count(*) AS n
FROM (SELECT least(greatest(floor((optimism_bias + 2.0::DOUBLE) / (3.0::DOUBLE / 20)), 0), 19) AS b FROM audit WHERE optimism_bias IS NOT NULL) GROUP BY b""",
    "power_trials", "supplier_effects", **_POWER_CTES,
)

# ------------------------------------------------------------------ review
_VALID = "human_decision IS NOT NULL AND trim(reviewer_initials) <> '' AND (human_decision <> 'override' OR trim(override_reason) <> '')"
_LAST = f"SELECT * FROM review_events WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ts DESC, event_id DESC) = 1"
ORACLE["review_fold"] = _with(
    """SELECT l.pair_id, routing, CASE WHEN e.pair_id IS NULL OR e.human_decision = 'defer' THEN 'no'
    WHEN l.pair_id IN (SELECT pair_id FROM spot) THEN 'spot_check' ELSE 'yes' END AS human_reviewed,
  coalesce(e.human_decision, '') AS human_decision, coalesce(e.human_final_class, '') AS human_final_class,
  CASE WHEN e.pair_id IS NULL THEN '' WHEN e.human_poolable THEN 'True' ELSE 'False' END AS human_poolable, coalesce(trim(e.override_reason), '') AS override_reason,
  coalesce(upper(trim(e.reviewer_initials)), '') AS reviewer_initials
FROM review_log l LEFT JOIN e ON e.pair_id = l.pair_id""",
    "review_log", "review_events", e=_LAST, spot=_SPOT.replace("FROM log", "FROM review_log"),
)
ORACLE["review_rejects"] = _with(
    f"""SELECT event_id, pair_id, CASE WHEN NOT ({_VALID}) THEN concat_ws(',', CASE WHEN trim(reviewer_initials) = '' THEN 'reviewer_initials' END,
    CASE WHEN human_decision = 'override' AND trim(override_reason) = '' THEN 'override_reason' END) ELSE 'unknown_pair' END AS violations
FROM review_events WHERE NOT ({_VALID}) OR pair_id NOT IN (SELECT pair_id FROM review_log)""",
    "review_log", "review_events",
)
ORACLE["review_fold_stream"] = _with(
    "SELECT pair_id, event_id, human_decision, human_final_class, human_poolable, override_reason FROM e", "review_events", e=_LAST
)
_PENDING = f"""
SELECT log.*, log.pair_id IN (SELECT pair_id FROM spot) AS spot_check FROM log WHERE human_reviewed = 'no'
  AND (routing = 'llm' OR llm_confidence = 'low' OR llm_flag = 'True' OR published_endpoint = '' OR log.pair_id IN (SELECT pair_id FROM spot))
"""
ORACLE["pending_queue"] = _with("SELECT pair_id, similarity_score, routing, spot_check FROM q", "log", spot=_SPOT, q=_PENDING)
_T = {k: v.replace("'", "''") for k, v in presets.REVIEW_TRIGGERS.items()}
ORACLE["review_triggers"] = _with(
    f"""SELECT pair_id, concat_ws(' ', CASE WHEN routing = 'llm' THEN '{_T['ambiguous']}' END, CASE WHEN llm_confidence = 'low' THEN '{_T['low_confidence']}' END,
  CASE WHEN llm_flag = 'True' THEN '{_T['flagged']}' END, CASE WHEN llm_comparability = 'False' THEN '{_T['not_comparable']}' END,
  CASE WHEN published_endpoint = '' THEN '{_T['no_published']}' END, CASE WHEN spot_check THEN '{_T['spot_check']}' END) AS triggers FROM q""",
    "log", spot=_SPOT, q=_PENDING,
)
ORACLE["recent_reviews"] = _with(
    f"SELECT pair_id, review_timestamp, human_decision FROM log WHERE {REVIEWED} ORDER BY try_cast(review_timestamp AS TIMESTAMP) DESC NULLS LAST, pair_id LIMIT 8", "log"
)
ORACLE["reviewed_by"] = _with("SELECT DISTINCT reviewer_initials FROM log WHERE reviewer_initials <> ''", "log")
ORACLE["log_view"] = _with(
    "SELECT pair_id, routing, similarity_score, llm_switch_type, llm_confidence, human_decision, human_final_class, human_poolable, reviewer_initials, review_timestamp FROM log",
    "log",
)
ORACLE["overview_kpis"] = _with(
    f"""SELECT *, greatest(pairs - review_queue - reviewed, 0) AS auto_classified FROM (
  SELECT count(*) AS pairs, (SELECT count(*) FROM q) AS review_queue, {_n(REVIEWED)} AS reviewed, {_n("human_poolable = 'True'")} AS poolable,
    {', '.join(f'''{_n(f"routing = '{r}'")} AS routed_{r}''' for r in presets.ROUTINGS)}, {_n("published_endpoint = ''")} AS no_published_endpoint,
    (SELECT count(*) FROM q WHERE published_endpoint = '') AS queued_without_endpoint FROM log)""",
    "log", spot=_SPOT, q=_PENDING,
)
ORACLE["review_kpis"] = _with(
    f"""SELECT count(*) AS pairs, {_pct(_n(REVIEWED), 'count(*)')} AS reviewed_pct, {_pct(_n(REVIEWED + ' AND ' + SWITCHED), _n(REVIEWED))} AS confirmed_switch_pct,
  {_pct(_n(REVIEWED + ' AND llm_switch_type = human_final_class'), _n(REVIEWED))} AS agreement_pct, {_n("human_poolable = 'True'")} AS poolable FROM log""",
    "log",
)


def _label(column: str, fallback: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in presets.SWITCH_LABELS.items()) + f" ELSE '{fallback}' END"


def _or(column: str, fallback: str) -> str:
    return f"CASE WHEN trim({column}) = '' THEN '{fallback}' ELSE trim({column}) END"


_LINK_ENTRIES = f"""SELECT nct_id AS nct, 'PMID ' || {_or('pmid', 'Not available')} || ' (' || linkage_method || ' / ' || linkage_confidence || ')' AS entry, count(*) AS n
FROM linkage_log GROUP BY ALL"""
ORACLE["linkage_entries"] = _with(
    f"SELECT nct_id, 'PMID ' || {_or('pmid', 'Not available')} || ' (' || linkage_method || ' / ' || linkage_confidence || ')' AS entry, count(*) AS times FROM linkage_log GROUP BY ALL",
    "linkage_log",
)
ORACLE["provenance"] = _with(
    f"""SELECT pair_id, split_part(pair_id, '_', 1) AS nct_id, split_part(pair_id, '_', 2) AS pair_pmid, coalesce(links, 0)::BIGINT AS links, coalesce(all_links, 'No linkage entry.') AS all_links,
  {_or('registered_endpoint', 'Not available.')} AS registered_endpoint, {_or('published_endpoint', 'None extracted')} AS published_endpoint,
  printf('%.4f', similarity_score) AS similarity_score, {_ROUTE_LABEL} AS routing, {_label('llm_switch_type', 'Not classified')} AS ai_classification,
  {_or('llm_confidence', 'Not called')} AS ai_confidence, {_or('human_decision', 'Not reviewed')} AS human_decision, {_label('human_final_class', 'Pending review')} AS human_class,
  CASE WHEN human_poolable = 'True' THEN 'Yes' ELSE 'No' END AS poolable, {_or('reviewer_initials', 'Not yet reviewed')} AS reviewer, {_or('override_reason', 'No override')} AS override_reason,
  {_or('review_timestamp', 'Not yet reviewed')} AS review_timestamp
FROM log LEFT JOIN d ON d.nct = split_part(pair_id, '_', 1)""",
    "log", "linkage_log",
    d=f"SELECT nct, sum(n) AS links, string_agg(entry, ' | ' ORDER BY entry) AS all_links FROM ({_LINK_ENTRIES}) GROUP BY nct",
)
ORACLE["links_of"] = _with(
    f"""SELECT nct AS nct_id, string_agg(entry, ' | ' ORDER BY entry) AS all_links FROM ({_LINK_ENTRIES})
WHERE nct IN (SELECT min(nct_id) FROM linkage_log UNION SELECT max(nct_id) FROM linkage_log) GROUP BY nct""",
    "linkage_log",
)
ORACLE["audit_append"] = _with(
    f"""SELECT '{presets.VERSION_TAG}' AS pipeline_version, linkage_method, linkage_confidence, count(*) AS n, 0::BIGINT AS unstamped, max(nct_id) AS last_nct
FROM linkage_log GROUP BY ALL""",
    "linkage_log",
)
ORACLE["audit_append_once"] = ORACLE["audit_append"]
ORACLE["formatted_scores"] = _with(
    """SELECT pair_id, routing, CASE WHEN human_reviewed = 'no' THEN '-' ELSE printf('%.3f', similarity_score) END AS score, reviewed, '0.0%' AS of_none
FROM log JOIN (SELECT routing, printf('%.1f%%', 100.0 * count(*) FILTER (WHERE human_reviewed <> 'no') / count(*)) AS reviewed FROM log GROUP BY routing) USING (routing)""",
    "log",
)
ORACLE["log_export"] = _with(
    """SELECT 'linkage' AS log, linkage_confidence AS kind, count(*) AS n, max(pmid) AS last FROM linkage_log WHERE nct_id <> 'NCT00000001' GROUP BY ALL
UNION ALL SELECT 'calls', 'NCT1', count(*), max(prompt_tokens::VARCHAR) FROM calls""",
    "linkage_log", "calls",
)
ORACLE["first_trials"] = _with("SELECT nct_id, official_title, completion_date FROM link_trials ORDER BY nct_id LIMIT 25", "link_trials")
ORACLE["row_rules"] = _with(
    """SELECT 'linkage' AS kind, violations, count(*) AS n, min(nct) AS first_nct FROM (SELECT
    CASE WHEN pmid LIKE '%2' THEN 'X' || nct_id ELSE nct_id END AS nct,
    CASE WHEN pmid LIKE '%2' THEN 'nct_id_prefix' WHEN pmid LIKE '%3' THEN 'linkage_method' WHEN pmid LIKE '%4' THEN 'linkage_confidence' ELSE '' END AS violations
  FROM linkage_log) GROUP BY ALL
UNION ALL SELECT 'power', violations, count(*), min(nct_id) FROM (SELECT nct_id,
    concat_ws(',', CASE WHEN NOT coalesce(try_cast(enrollment AS DOUBLE) > 0, false) THEN 'enrollment' END, CASE WHEN event_rate IS NULL THEN 'assumed_event_rate' END,
      CASE WHEN contains(registration_date, '/') THEN 'power' END) AS violations FROM power_trials) GROUP BY ALL""",
    "linkage_log", "power_trials",
)
ORACLE["select_or_first"] = _with(
    """SELECT pair_id, routing, similarity_score, 'last' AS choice FROM log WHERE pair_id = (SELECT max(pair_id) FROM log)
UNION ALL SELECT pair_id, routing, similarity_score, 'missing' FROM log WHERE pair_id = (SELECT min(pair_id) FROM log)""",
    "log",
)
ORACLE["article_versions"] = _with(
    """SELECT pmid, CASE WHEN pmid::BIGINT % 6 = 0 THEN 'Corrected: ' ELSE '' END || title AS title, CASE WHEN pmid::BIGINT % 6 = 0 THEN 2 ELSE 1 END AS version FROM link_pubs""",
    "link_pubs",
)
ORACLE["user_embedder"] = "SELECT DISTINCT md5(text) AS text_key, length(text) AS v0, length(text) - length(replace(text, 'e', '')) AS v1, unicode(text)::BIGINT AS v2 FROM documents"
_LABELLED = "substr(registration_date, 10, 1)::INTEGER % 2 = 0"
ORACLE["hr_extract_sections"] = _with(
    f"""SELECT pair_id, hr, lci AS hr_lci, uci AS hr_uci, log_hr, se AS se_log_hr, coalesce(method, 'failed') AS extraction_method,
    CASE WHEN reason IS NULL THEN 'extracted' ELSE 'failed' END AS outcome FROM x WHERE {_LABELLED} OR words IS NULL
UNION ALL SELECT pair_id, 0.9::DOUBLE, 0.8::DOUBLE, 1.1::DOUBLE, round(ln(0.9::DOUBLE), 6), round((ln(1.1::DOUBLE) - ln(0.8::DOUBLE)) / 3.92::DOUBLE, 6), 'hr_paren_ci', 'extracted'
  FROM x WHERE NOT ({_LABELLED}) AND words IS NOT NULL""",
    "linked_lines", x=_EXTRACT,
)
ORACLE["link_audit"] = _with(
    """SELECT nct_id, CASE WHEN conf <> 'Unlinked' THEN pmid END AS pmid, 'manual' AS linkage_method, conf AS linkage_confidence, 'reviewer:XY' AS linked_by, 'checked ' || event_type AS notes
FROM e WHERE conf <> 'none' AND (conf = 'Unlinked' OR pmid <> '')""",
    e=_LINK_EVENTS,
)
# The words "primary outcome was reached" against the sentence with "in", a number and "months" after it.
ORACLE["link_resolution"] = _with(
    """SELECT l.nct_id, l.pmid, 'old' AS pair_id, 0.123::DOUBLE AS similarity_score, 'kept' AS routing FROM l WHERE nct_id NOT IN (SELECT nct_id FROM r)
UNION ALL SELECT l.nct_id, r.pmid, l.nct_id || '_' || r.pmid, CASE WHEN p.pmid IS NULL THEN 0.0::DOUBLE ELSE round(4 / (2 * sqrt(7)), 4) END,
  CASE WHEN p.pmid IS NULL THEN 'auto_major_switch' ELSE 'llm' END
FROM l JOIN r ON r.nct_id = l.nct_id LEFT JOIN link_pubs p ON p.pmid = r.pmid WHERE conf IN ('High', 'Medium')""",
    "linkage_log", "link_pubs",
    l="SELECT nct_id, max(pmid) AS pmid FROM linkage_log GROUP BY nct_id", e=_LINK_EVENTS,
    r="SELECT * FROM e WHERE conf <> 'none' AND (conf = 'Unlinked' OR pmid <> '') QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY ts DESC, event_id DESC) = 1",
)
ORACLE["trial_meta"] = _with(
    """SELECT k.nct_id, k.pmid AS asked_pmid, t.ttl AS title, CASE WHEN has THEN t.ctgov_pmid WHEN k.pmid <> '' THEN k.pmid ELSE coalesce(t.ctgov_pmid, '') END AS pmid,
  t.enrollment, t.completion_date, CASE WHEN has THEN 'High' END AS linkage_confidence, has AS from_linked
FROM (SELECT k.*, EXISTS (SELECT 1 FROM link_trials l WHERE l.nct_id = k.nct_id AND l.ctgov_pmid <> '' AND (k.pmid = '' OR l.ctgov_pmid = k.pmid)) AS has FROM k) k
LEFT JOIN (SELECT *, CASE WHEN official_title <> '' THEN official_title ELSE brief_title END AS ttl FROM link_trials) t ON t.nct_id = k.nct_id""",
    "link_trials",
    k=f"SELECT DISTINCT {NCT.format('o_custkey')} AS nct_id, CASE WHEN o_orderstatus = 'F' THEN '' ELSE (o_custkey + 20000000)::VARCHAR END AS pmid FROM orders",
)

# ------------------------------------------------------------------ incremental
ORACLE["resume_anti"] = _with(
    "SELECT nct_id, official_title FROM link_trials WHERE nct_id NOT IN (SELECT split_part(pair_id, '_', 1) FROM review_log)", "link_trials", "review_log"
)
ORACLE["upsert_keep_last"] = f"""
WITH new AS (SELECT l_orderkey, l_linenumber AS line, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
last AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY line DESC) = 1)
SELECT {NCT.format('o_orderkey')} AS nct_id, CASE WHEN line IS NULL THEN 'old' ELSE 'new' END AS routing, coalesce(line, 0) AS line, coalesce(score, 0.0) AS score
FROM orders LEFT JOIN last ON l_orderkey = o_orderkey
"""
ORACLE["upsert_in_buckets"] = ORACLE["upsert_keep_last"]
ORACLE["left_updates"] = _with(
    """SELECT split_part(pair_id, '_', 1) AS nct_id, split_part(pair_id, '_', 2) AS pmid, o_custkey, CASE WHEN u THEN pair_id END AS pair_id,
  CASE WHEN u THEN similarity_score END AS similarity_score, CASE WHEN u THEN routing END AS routing FROM (SELECT *, routing <> 'auto_major_switch' AS u FROM log)""",
    "log",
)
_COSTED = """SELECT *, sum(cost) OVER w AS total, count(*) OVER w AS no FROM (
  SELECT *, prompt_tokens / 1000::DOUBLE * 0.00015::DOUBLE + completion_tokens / 1000::DOUBLE * 0.0006::DOUBLE AS cost FROM calls)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
ORACLE["running_cost_ceiling"] = _with(
    "SELECT user_id, event_id, round(cost, 8) AS cost_usd, round(total, 8) AS total_usd, no AS total_calls, total > 1.0 AS over_ceiling FROM c", "calls", c=_COSTED
)
ORACLE["cost_summary"] = _with(
    """SELECT user_id, count(*) FILTER (WHERE total > 1.0) > 0 AS stopped, coalesce(min(no) FILTER (WHERE total > 1.0), max(no)) AS total_calls,
  round(coalesce(arg_min(total, no) FILTER (WHERE total > 1.0), max(total)), 8) AS total_usd FROM c GROUP BY user_id""",
    "calls", c=_COSTED,
)

# ------------------------------------------------------------------ requests, answers, embeddings
ORACLE["prompt_requests"] = _with(
    """SELECT pair_id, 'Compare two endpoints of one study (' || CASE WHEN o_custkey % 2 = 0 THEN 'tnbc' ELSE 'unknown_subtype' END || '; adjuvant).' || chr(10)
  || 'As registered: ' || CASE WHEN registered_endpoint = 'None' THEN '' ELSE registered_endpoint END || chr(10) || 'As reported: ' || published_endpoint || chr(10)
  || 'Say which kind of change, if any, lies between them.' || chr(10) AS request
FROM log WHERE routing = 'llm'""",
    "log",
)
_FENCED = "regexp_replace(regexp_replace(trim(raw), '^```[a-z]*\\s*', ''), '\\s*```$', '')"
ORACLE["response_parse"] = _with(
    f"""SELECT pair_id, ok AS llm_valid, CASE WHEN ok THEN j->>'switch_type' END AS llm_switch_type, CASE WHEN ok THEN j->>'direction' END AS llm_direction,
  CASE WHEN ok THEN j->>'step_by_step_reasoning' END AS llm_reasoning, CASE WHEN ok THEN j->>'confidence' END AS llm_confidence,
  CASE WHEN ok THEN (j->>'comparability_for_pooling')::BOOLEAN END AS llm_comparability, CASE WHEN ok THEN (j->>'flag_for_human_review')::BOOLEAN ELSE true END AS llm_flag,
  CASE WHEN ok THEN CASE WHEN (j->'key_differences') IS NULL THEN '' ELSE array_to_string((j->'key_differences')::VARCHAR[], '; ') END END AS key_differences
FROM (SELECT *, coalesce((j->>'switch_type') IN ({_TYPES}) AND (j->>'direction') IN ({_quoted(presets.SWITCH_DIRECTIONS)}) AND length((j->>'step_by_step_reasoning')) >= 20, false) AS ok
  FROM (SELECT pair_id, CASE WHEN json_valid({_FENCED}) THEN ({_FENCED})::JSON END AS j FROM answers))""",
    "answers",
)
_SPLIT = "list_filter(regexp_split_to_array(lower({0}), '[^\\w]+'), lambda w: w <> '')"
_MATCHES = dict(
    p="SELECT nct_id || '_' || pmid AS pair_id, primary_outcomes, CASE WHEN published_endpoint = 'none' THEN '' ELSE published_endpoint END AS published FROM endpoint_texts WHERE linkage_confidence <> 'Low' AND trim(primary_outcomes) <> ''",
    cand="SELECT pair_id, published, regexp_replace(trim(unnest(string_split(primary_outcomes, '|'))), '\\s+', ' ', 'g') AS candidate FROM p WHERE published <> ''",
    words=f"SELECT txt, w, count(*) AS c FROM (SELECT txt, unnest({_SPLIT.format('txt')}) AS w FROM (SELECT candidate AS txt FROM cand UNION SELECT published FROM cand)) GROUP BY ALL",
    norm="SELECT txt, sqrt(sum(c * c)) AS len FROM words GROUP BY txt",
    cos="""SELECT candidate, published, sum(coalesce(a.c * b.c, 0)) / any_value(na.len * nb.len) AS cosine FROM (SELECT DISTINCT candidate, published FROM cand)
JOIN norm na ON na.txt = candidate JOIN norm nb ON nb.txt = published LEFT JOIN words a ON a.txt = candidate LEFT JOIN words b ON b.txt = published AND b.w = a.w GROUP BY ALL""",
)
_MATCHED = f"""SELECT p.pair_id, coalesce(score, 0.0::DOUBLE) AS similarity_score, round((1.0::DOUBLE - coalesce(score, 0.0::DOUBLE)) * 100, 4) AS ssi, {ROUTE.format('coalesce(score, 0.0)')} AS routing
FROM p LEFT JOIN (SELECT pair_id, round(max(cosine), 4) AS score FROM cand JOIN cos USING (candidate, published) GROUP BY pair_id) b USING (pair_id)"""
ORACLE["match_endpoints"] = _with(_MATCHED, "endpoint_texts", **_MATCHES)
ORACLE["refresh_matches"] = _with(
    """SELECT e.nct_id, e.pmid, e.nct_id || '_' || e.pmid AS pair_id, CASE WHEN hit THEN m.similarity_score ELSE 0.123::DOUBLE END AS similarity_score,
  CASE WHEN hit THEN m.routing ELSE 'kept' END AS routing
FROM (SELECT *, nct_id IN (SELECT 'NCT' || lpad(user_id::VARCHAR, 8, '0') FROM events) AND linkage_confidence <> 'Low' AND trim(primary_outcomes) <> '' AS hit FROM endpoint_texts) e
LEFT JOIN m ON m.pair_id = e.nct_id || '_' || e.pmid""",
    "endpoint_texts", **_MATCHES, m=_MATCHED,
)
ORACLE["embed_hook"] = r"SELECT DISTINCT md5(text) AS text_key, 512 AS dims, CASE WHEN regexp_matches(text, '[\pL\pN\pM_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents"

# ------------------------------------------------------------------ sources
_STUDY = _POP.replace("{words}", "title || ' ' || CASE WHEN conditions_list = '' THEN '' ELSE replace(conditions_list, '|', ' ') || ' ' END || 'Breast Cancer ' || eligibility")
ORACLE["registry_json"] = _with(
    """SELECT p.nct_id, title AS official_title, 'PHASE2, PHASE3' AS phase, t.enrollment::BIGINT AS enrollment, 'Overall survival | ' || p.primary_outcomes AS primary_outcomes,
  '2015-06-30' AS completion_date, CASE WHEN ctgov_pmid = '' THEN 'x1' ELSE ctgov_pmid END AS ctgov_pmid, population_class, bc_subtype, bc_setting
FROM p JOIN link_trials t ON t.nct_id = p.nct_id WHERE completion_date = '2015-06' AND population_class <> 'non_breast_excluded'
  AND len(list_filter([7, 11, 13, 17, 19], lambda d: substr(p.nct_id, 4)::BIGINT % d = 0)) = 0""",
    "population", "link_trials", p=_STUDY,
)
_FLAT = "trim(regexp_replace(regexp_replace(abstract_text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '\\s+', ' ', 'g'))"
ORACLE["article_xml"] = _with(
    """SELECT pmid, title, length(body) AS abstract_chars, md5(body) AS abstract_md5, section_labels, authors, pub_year, journal, mesh_terms, pub_types FROM (
  SELECT pmid, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, 'BACKGROUND: Why.' || CASE WHEN flat = '' THEN '' WHEN section_label = '' THEN chr(10) || flat ELSE chr(10) || section_label || ': ' || flat END AS body,
    CASE WHEN flat = '' OR section_label = '' THEN 'BACKGROUND' ELSE 'BACKGROUND,' || section_label END AS section_labels, 'Doe,' || lang AS authors, pub_year, journal,
    replace(mesh_terms_list, '|', ',') AS mesh_terms, replace(pub_types_list, '|', ',') AS pub_types FROM a)""",
    "articles", a=f"SELECT articles.*, d.lang, {_FLAT} AS flat FROM articles JOIN documents d ON (10000000 + d.doc_id)::VARCHAR = pmid",
)
ORACLE["csv_all_string"] = "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5, CASE WHEN lang = 'en' THEN '' ELSE lang END AS lang, '' AS notes FROM documents"

# ------------------------------------------------------------------ scorecard


def _card(rated: str, agreement_total: str) -> str:
    return f"""SELECT {_CLUSTER} AS endpoint_cluster, {_n("human_poolable = 'True'")} AS trials_included, {_n("human_poolable = 'False'")} AS trials_excluded,
  {_pct(_n(REVIEWED + " AND human_decision = 'override'"), _n(REVIEWED))} AS human_override_rate_pct, round(avg(ssi), 2) AS mean_ssi,
  {_pct(_n(SWITCHED), 'count(*)')} AS human_confirmed_switch_rate_pct, {_pct(_n(rated), agreement_total)} AS ai_human_agreement_rate_pct FROM log GROUP BY ALL"""


_UNLINKED = f"""SELECT endpoint_cluster, count(*) AS trials_unlinked FROM (SELECT DISTINCT {_CLUSTER} AS endpoint_cluster, split_part(pair_id, '_', 1) AS nct_id FROM log)
JOIN linkage_log USING (nct_id) WHERE linkage_confidence = 'Unlinked' GROUP BY ALL"""
_BOTH = "llm_switch_type <> '' AND human_final_class <> ''"
_SCORE_CTES = _pool_ctes(_APPROVED, "endpoint_cluster")
# The power audit needs its own prefix posteriors beside the pooled ones: rename the first set.
_SEQ_CTES = {
    f"q_{n}": sql for n, sql in _pool_ctes(_SUPPLIER_EFFECTS, "", prefix=True, interval=False).items()
}
for _name in list(_SEQ_CTES):
    for _other in ("cells", "sums", "post", "weighed", "raised", "probs"):
        _SEQ_CTES[_name] = _SEQ_CTES[_name].replace(f"FROM {_other}", f"FROM q_{_other}")
_SEQ = {**_SEQ_CTES, "seq": _POWER_CTES["seq"].replace("FROM moments", "FROM q_moments"), "days": _POWER_CTES["days"], "audit": _POWER_CTES["audit"]}
ORACLE["scorecard"] = _with(
    """SELECT c.endpoint_cluster, trials_included, trials_excluded, coalesce(trials_unlinked, 0) AS trials_unlinked, human_override_rate_pct, mean_ssi, human_confirmed_switch_rate_pct, ai_human_agreement_rate_pct,
  round(exp(mu), 5) AS pooled_hr, round(exp(lo), 5) AS pooled_hr_cri_lower, round(exp(hi), 5) AS pooled_hr_cri_upper, round(tau_mean, 5) AS between_trial_tau,
  CASE WHEN sigma2 > 0 THEN round(tau_mean * tau_mean / (tau_mean * tau_mean + sigma2) * 100, 1) END AS i_squared_pct, mean_optimism_bias,
  CASE WHEN trials_included = 0 OR mu IS NULL THEN 'Gap' WHEN trials_included >= 5 AND exp(hi) < 1 AND human_confirmed_switch_rate_pct < 20 THEN 'Strong'
    WHEN trials_included >= 3 AND exp(hi) < 1 THEN 'Moderate' WHEN trials_included >= 2 THEN 'Weak' ELSE 'Gap' END AS evidence_strength
FROM c LEFT JOIN un USING (endpoint_cluster) LEFT JOIN moments USING (endpoint_cluster) LEFT JOIN hdi USING (endpoint_cluster) LEFT JOIN med USING (endpoint_cluster) LEFT JOIN bias USING (endpoint_cluster)""",
    "log", "order_effects", "linkage_log", "power_trials", "supplier_effects",
    c=_card(_BOTH + " AND llm_switch_type = human_final_class", _n(_BOTH)), un=_UNLINKED, **_SCORE_CTES,
    med=f"SELECT endpoint_cluster, median(variance) AS sigma2 FROM ({_VARIANCES}) GROUP BY ALL", **_SEQ,
    bias=f"SELECT endpoint_cluster, round(avg(optimism_bias), 3) AS mean_optimism_bias FROM (SELECT DISTINCT {_CLUSTER} AS endpoint_cluster, split_part(pair_id, '_', 1) AS nct_id FROM log) JOIN audit USING (nct_id) GROUP BY ALL",
)
ORACLE["scorecard_parity"] = _with(
    "SELECT c.endpoint_cluster, trials_included, trials_excluded, coalesce(trials_unlinked, 0) AS trials_unlinked, human_override_rate_pct, mean_ssi, human_confirmed_switch_rate_pct, ai_human_agreement_rate_pct, 'Gap' AS evidence_strength FROM c LEFT JOIN un USING (endpoint_cluster)",
    "log", "linkage_log", c=_card("llm_switch_type = human_final_class", "count(*)"), un=_UNLINKED,
)
ORACLE["shared_posterior"] = _with(
    f"SELECT endpoint_cluster, {_POOLED} FROM (SELECT DISTINCT {_CLUSTER} AS endpoint_cluster FROM log WHERE human_poolable = 'True'), moments, hdi",
    "log", "supplier_effects", **_pool_ctes(_SUPPLIER_EFFECTS, ""),
)
