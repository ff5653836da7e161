"""The same results in plain SQL over the given tables, as an independent check.

Common subqueries are named ``c_…``; ``sql`` puts the ones a query mentions in front of it.
"""

from __future__ import annotations

import re

from quarry.functions import constants as K

CYR = K.CYRILLIC
NUMBER = rf"(\d+(?:[.,]\d+)?)\s*([a-z{CYR}/%]+)?"
AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm(x: str) -> str:
    """Normalised text; RE2 has no look-behind, so overlapping patterns are replaced twice."""
    x = f"lower(translate(replace({clean(x)}, '№', ' n '), 'ёЁ—–−×«»', 'ее---x\"\"'))"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\d),(\d)', '\1.\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\d)\s*[xх]\s*(\d)', '\1 x \2', 'g')"
    x = rf"regexp_replace({x}, '(\d)([a-z{CYR}%]*[a-z{CYR}])($|[^a-z{CYR}0-9_])', '\1 \2\3', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def clean(x: str) -> str:
    spaces = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{0085}\x{2028}\x{2029}\x{1680}\x{205F}]+"
    bare = rf"regexp_replace(coalesce({x}, ''), '[\x{{FEFF}}\x{{200B}}]', '', 'g')"
    return f"trim(trim(trim(regexp_replace({bare}, '{spaces}', ' ', 'g'), ' '), '\"'), ' ')"


def raw_tokens(x: str) -> str:
    found = f"regexp_extract_all({x}, '[a-z{CYR}0-9]+(?:[./,-][a-z{CYR}0-9]+)*')"
    return (
        f"list_filter(flatten(list_transform({found}, lambda t: CASE WHEN regexp_matches(t, '[-/.,]') "
        f"THEN list_concat([t], regexp_split_to_array(t, '[-/.,]+')) ELSE [t] END)), "
        f"lambda t: t <> '' AND t NOT IN ({quoted(K.STOPWORDS)}))"
    )


def in_order(x: str) -> str:
    """Distinct elements of a list in the order of their first places."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def unit_like(t: str) -> str:
    return f"({t} IN ({quoted(K.UNITS)}) OR regexp_extract({t}, '{NUMBER}', 2) <> '')"


def mixed(t: str) -> str:
    return rf"(regexp_matches({t}, '[a-z{CYR}]') AND regexp_matches({t}, '\d'))"


def inferred(t: str) -> str:
    return (
        f"CASE WHEN {unit_like(t)} THEN 'unit' WHEN {mixed(t)} THEN 'model' "
        f"WHEN {t} IN ({quoted(K.KNOWN_BRANDS)}) THEN 'brand' "
        rf"WHEN regexp_matches({t}, '\d') THEN 'model' ELSE 'token' END"
    )


def stem(t: str) -> str:
    ends = "|".join(K.SUFFIXES)
    return (
        f"CASE WHEN length({t}) > 4 AND regexp_matches({t}, '[{CYR}]') AND NOT {mixed(t)} "
        rf"THEN regexp_replace({t}, '^(.{{3,}}?)(?:{ends})$', '\1') ELSE {t} END"
    )


def lemma(t: str, kind: str) -> str:
    return (
        f"CASE WHEN {kind} NOT IN ('brand', 'model', 'unit') AND {t} NOT IN ({quoted(K.UNITS)}) "
        f"AND regexp_matches({t}, '^[а-я]+$') THEN {stem(t)} ELSE {t} END"
    )


def layout(t: str) -> str:
    latin, cyr = f"regexp_matches({t}, '[a-z]')", f"regexp_matches({t}, '[{CYR}]')"
    en, ru = K.LATIN_KEYS.replace("'", "''"), K.CYRILLIC_KEYS
    return (
        f"CASE WHEN {latin} AND NOT {cyr} THEN translate({t}, '{en}', '{ru}') "
        f"WHEN {cyr} AND NOT {latin} THEN translate({t}, '{ru}', '{en}') END"
    )


def seeds() -> str:
    pairs = set(K.SEED_SYNONYMS.items())
    for canonical, members in K.SEED_GROUPS.items():
        pairs |= {(canonical, canonical)} | {(alias, canonical) for alias in members}
    rows = ", ".join(f"('{a}', '{c}')" for a, c in sorted(pairs))
    return f"SELECT * FROM (VALUES {rows}) AS s(alias, canonical)"


def weight(date: str, cost: str) -> str:
    return f"(1.0 + {recency(date)} + {cost_weight(cost)})"


def recency(date: str) -> str:
    return (
        f"(CASE WHEN {date} IS NULL OR {date} > {AS_OF} THEN 0.0::DOUBLE ELSE 1.5::DOUBLE - "
        f"least(floor((epoch({AS_OF}) - epoch({date})) / 86400), 3650)::DOUBLE / 3650 END)"
    )


def cost_weight(cost: str) -> str:
    return f"(CASE WHEN {cost} > 0 THEN least(0.6::DOUBLE, log10({cost} + 10) / 6) ELSE 0.0::DOUBLE END)"


EVENT_WEIGHT = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in K.EVENT_WEIGHTS.items()
) + " ELSE 0.0::DOUBLE END"

C: dict[str, str] = {}

C["c_raw_products"] = """
SELECT p_partkey::VARCHAR AS ste_id,
       p_name || ' ' || upper(left(p_type, 2)) || '-' || p_partkey || ' ' || p_size || 'mm' AS title,
       p_type AS category,
       'Brand:' || p_brand || ';Size:' || p_size || ' mm;Price:'
         || p_retailprice::DECIMAL(12, 2)::VARCHAR AS attributes_raw
FROM part"""
C["c_named_products"] = f"""
SELECT ste_id, {clean('title')} AS title_raw, {clean('category')} AS category_raw,
       {clean('attributes_raw')} AS attributes_raw,
       {norm('title')} AS title_norm, {norm('category')} AS category_norm
FROM c_raw_products"""
C["c_token_products"] = f"""
SELECT *, {raw_tokens('title_norm')} AS found FROM c_named_products"""
C["c_products"] = f"""
SELECT * EXCLUDE (found, title_tokens, word), title_tokens, upper(left(word, 1)) || substr(word, 2) AS brand_guess,
       upper(list_filter(title_tokens, lambda t: {mixed('t')})[1]) AS model_guess
FROM (SELECT *, list_filter(title_tokens[1:6], lambda t: regexp_matches(t, '^[a-z]{{3,}}$'))[1] AS word
      FROM (SELECT *, {in_order('found')} AS title_tokens FROM c_token_products))"""
C["c_chunks"] = """
SELECT ste_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS chunk
FROM (SELECT ste_id, list_filter(regexp_split_to_array(attributes_raw, '[;|]+'),
             lambda x: contains(x, ':')) AS l FROM c_named_products)"""
C["c_attributes"] = f"""
SELECT *, {norm('name_raw')} AS name_norm, {norm('value_raw')} AS value_norm,
       TRY_CAST(regexp_extract({norm('value_raw')}, '{NUMBER}', 1) AS DOUBLE) AS numeric_value,
       nullif(regexp_extract({norm('value_raw')}, '{NUMBER}', 2), '') AS unit
FROM (SELECT ste_id, pos, {clean("split_part(chunk, ':', 1)")} AS name_raw,
             {clean("substr(chunk, strpos(chunk, ':') + 1)")} AS value_raw FROM c_chunks)"""
C["c_lines"] = """
SELECT p_name AS purchase_name, l_orderkey::VARCHAR AS contract_id, l_partkey::VARCHAR AS ste_id,
       l_orderkey || ':' || l_partkey AS contract_key, o_orderdate AS contract_date,
       l_extendedprice AS cost, o_custkey::VARCHAR AS customer_inn, c_name AS customer_name,
       c_mktsegment, cr.r_name AS customer_region, l_suppkey::VARCHAR AS supplier_inn,
       s_name AS supplier_name, sr.r_name AS supplier_region, p_size,
       l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_suppkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
JOIN part ON l_partkey = p_partkey"""
C["c_contracts"] = f"""
SELECT contract_key, contract_id, ste_id, purchase_name AS purchase_name_raw,
       {norm('purchase_name')} AS purchase_name_norm, contract_date, cost, customer_inn,
       customer_name, customer_region, supplier_inn, supplier_name, supplier_region,
       {weight('contract_date', 'cost')} AS w
FROM c_lines QUALIFY row_number() OVER (PARTITION BY contract_key
  ORDER BY l_linenumber DESC, l_shipdate DESC, l_extendedprice DESC, l_quantity DESC, l_suppkey DESC) = 1"""
C["c_listed"] = "SELECT * FROM c_products WHERE category_norm <> 'promo'"
C["c_product_w"] = """
SELECT customer_inn, ste_id, sum(w) AS weight FROM c_contracts GROUP BY ALL"""
C["c_category_w"] = """
SELECT customer_inn, category_norm, sum(w) AS weight
FROM c_contracts JOIN c_products USING (ste_id) GROUP BY ALL"""
C["c_name_tokens"] = f"""
SELECT purchase_name_norm, {in_order('found')} AS tokens FROM (
  SELECT DISTINCT purchase_name_norm, {raw_tokens('purchase_name_norm')} AS found FROM c_contracts)"""
C["c_token_w"] = """
SELECT customer_inn, token, sum(w) AS weight FROM (
  SELECT customer_inn, unnest(tokens) AS token, w FROM c_contracts JOIN c_name_tokens USING (purchase_name_norm)
  UNION ALL
  SELECT customer_inn, unnest(title_tokens), w * 0.8::DOUBLE FROM c_contracts JOIN c_products USING (ste_id))
GROUP BY ALL"""
C["c_counts"] = f"""
SELECT customer_inn, min(customer_name) AS customer_name, count(*) AS purchase_count,
       count(p.ste_id) AS matched_purchase_count, sum(coalesce(cost, 0)) AS total_spend,
       max(CASE WHEN {recency('contract_date')} > 0 THEN contract_date END) AS last_purchase_at
FROM c_contracts c LEFT JOIN c_listed p USING (ste_id) GROUP BY customer_inn"""
C["c_token_top"] = """
SELECT customer_inn, token, round(weight, 4) AS weight,
       row_number() OVER (PARTITION BY customer_inn ORDER BY round(weight, 4) DESC, token) AS rank
FROM c_token_w QUALIFY rank <= 30"""
C["c_events"] = """
SELECT event_id, 's' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
       user_id::VARCHAR AS customer_inn,
       CASE e.event_type WHEN 'view' THEN 'result_opened' WHEN 'click' THEN 'result_saved'
         WHEN 'purchase' THEN 'marked_relevant' WHEN 'error' THEN 'marked_irrelevant'
         WHEN 'signup' THEN 'result_bounced' ELSE 'search_submitted' END AS event_type,
       json_extract_string(props, '$.k') AS ste_id, ts AS created_at, category_norm
FROM events e LEFT JOIN c_products ON ste_id = json_extract_string(props, '$.k')"""
C["c_newest"] = f"""
SELECT *, {EVENT_WEIGHT} AS w FROM c_events
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, event_id DESC) <= 250"""
C["c_session_products"] = """
SELECT session_id, ste_id, sum(w) AS weight FROM c_newest WHERE ste_id IS NOT NULL GROUP BY ALL"""
C["c_session_categories"] = """
SELECT session_id, category_norm, sum(w) * 0.6::DOUBLE AS weight FROM c_newest
WHERE category_norm IS NOT NULL GROUP BY ALL"""
C["c_popularity"] = "SELECT ste_id, count(*) AS popularity FROM c_contracts GROUP BY ALL"

# Vocabulary.
C["c_seeds"] = seeds()
C["c_fields"] = f"""
SELECT 0 AS phase, ste_id AS row_key, 0 AS field, 1 AS n, 1 AS bit, NULL::VARCHAR AS forced,
       title_norm AS txt FROM c_products
UNION ALL SELECT 0, ste_id, 1, 1, 2, 'category', category_norm FROM c_products
UNION ALL SELECT 0, ste_id, 2, 1, 4, 'brand', lower(brand_guess) FROM c_products WHERE brand_guess IS NOT NULL
UNION ALL SELECT 0, ste_id, 3, 1, 8, 'model', lower(model_guess) FROM c_products WHERE model_guess IS NOT NULL
UNION ALL SELECT 0, ste_id, pos * 2 + 2, 1, 16, 'attribute', name_norm FROM c_attributes
UNION ALL SELECT 0, ste_id, pos * 2 + 3, 1, 32, NULL, value_norm FROM c_attributes
UNION ALL SELECT 1, purchase_name_norm, 0, count(*), 64, NULL, purchase_name_norm
  FROM c_contracts GROUP BY purchase_name_norm
UNION ALL SELECT 2, alias || chr(9) || canonical, 0, 1, 128, {inferred('canonical')}, alias FROM c_seeds
UNION ALL SELECT 2, alias || chr(9) || canonical, 1, 1, 128, {inferred('canonical')}, canonical FROM c_seeds"""
C["c_places"] = f"""
SELECT phase, row_key, field, n, bit, forced, unnest({in_order('found')}) AS term
FROM (SELECT *, {raw_tokens('txt')} AS found FROM c_fields)"""
C["c_dictionary"] = f"""
SELECT term, {lemma('term', "coalesce(first_forced, 'token')")} AS lemma, doc_freq::BIGINT AS doc_freq,
       coalesce(last_forced, {inferred('term')}) AS term_type, source_mask::INTEGER AS source_mask
FROM (
  SELECT term, sum(n) AS doc_freq, bit_or(bit) AS source_mask,
         max(CASE WHEN up = 1 THEN forced END) AS first_forced,
         max(CASE WHEN down = 1 THEN forced END) AS last_forced
  FROM (SELECT *,
          row_number() OVER (PARTITION BY term ORDER BY phase, row_key, field) AS up,
          row_number() OVER (PARTITION BY term ORDER BY forced IS NULL, phase DESC, row_key DESC, field DESC) AS down
        FROM c_places) GROUP BY term)"""
C["c_lemma_groups"] = """
SELECT lemma, term, term_type,
       row_number() OVER (PARTITION BY lemma ORDER BY doc_freq DESC, term) AS rank,
       first_value(term) OVER (PARTITION BY lemma ORDER BY doc_freq DESC, term) AS canonical,
       first_value(term_type) OVER (PARTITION BY lemma ORDER BY doc_freq DESC, term) AS canonical_type
FROM c_dictionary"""
C["c_candidates"] = """
SELECT alias, canonical, max(score) AS score, arg_max(source, score) AS source, 'global' AS scope FROM (
  SELECT alias, canonical, 1.0::DOUBLE AS score, 'seed' AS source FROM c_seeds
  UNION ALL
  SELECT term, canonical,
         CASE WHEN canonical_type IN ('token', 'category', 'attribute') THEN 0.94 ELSE 0.90 END, 'lemma_group'
  FROM c_lemma_groups WHERE rank BETWEEN 2 AND 8 AND (term_type = canonical_type OR canonical_type = 'token'))
WHERE alias <> canonical GROUP BY alias, canonical"""
C["c_rules"] = """
SELECT alias, canonical, 'global' AS scope, max(confidence) AS confidence,
       arg_max(source, confidence) AS source, 'active' AS status FROM (
  SELECT alias, canonical, 1.0::DOUBLE AS confidence, 'seed' AS source FROM c_seeds
  UNION ALL
  SELECT s.alias, s.canonical, s.score, s.source FROM c_candidates s
  LEFT JOIN c_dictionary a ON a.term = s.alias LEFT JOIN c_dictionary b ON b.term = s.canonical
  WHERE s.score >= 0.92 AND (coalesce(a.term_type, 'token') = coalesce(b.term_type, 'token')
    OR coalesce(a.term_type, 'token') = 'token' OR coalesce(b.term_type, 'token') = 'token'))
GROUP BY alias, canonical"""
C["c_canonical"] = "SELECT alias, max(canonical) AS canonical FROM c_rules GROUP BY alias"
C["c_aliases"] = """
SELECT canonical, alias,
       row_number() OVER (PARTITION BY canonical ORDER BY source <> 'seed', alias) AS pos
FROM c_rules WHERE alias <> canonical"""
C["c_all_text"] = f"""
SELECT ste_id, {raw_tokens('txt')} AS found FROM (
  SELECT p.ste_id, concat_ws(' ', title_norm, category_norm, lower(brand_guess), lower(model_guess),
           string_agg(name_norm || ' ' || value_norm, ' ' ORDER BY pos)) AS txt
  FROM c_products p LEFT JOIN c_attributes a USING (ste_id)
  GROUP BY p.ste_id, title_norm, category_norm, brand_guess, model_guess)"""
C["c_words"] = f"""
SELECT ste_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM (
  SELECT ste_id, list_concat(t, list_transform(t, lambda w: {stem('w')})) AS words
  FROM (SELECT ste_id, {in_order('found')} AS t FROM c_all_text))"""
C["c_forms"] = """
SELECT ste_id, pos, 0 AS place, coalesce(canonical, word) AS form
FROM c_words LEFT JOIN c_canonical ON alias = word
UNION ALL
SELECT ste_id, w.pos, a.pos, a.alias
FROM c_words w LEFT JOIN c_canonical k ON k.alias = word
JOIN c_aliases a ON a.canonical = coalesce(k.canonical, word)"""
C["c_search_text"] = """
SELECT ste_id, string_agg(form, ' ' ORDER BY pos, place) AS search_text FROM (
  SELECT ste_id, form, pos, place FROM c_forms
  QUALIFY row_number() OVER (PARTITION BY ste_id, form ORDER BY pos, place) = 1)
GROUP BY ste_id"""

# Index.
C["c_terms_long"] = f"""
SELECT ste_id, unnest(l) AS term, len(l) AS doc_len
FROM (SELECT ste_id, regexp_extract_all(search_text, '[a-z{CYR}0-9]+') AS l FROM c_search_text)"""
C["c_postings"] = """
SELECT term, ste_id, doc_len, count(*) AS tf FROM c_terms_long GROUP BY ALL"""
C["c_df"] = "SELECT term, count(*) AS df FROM c_postings GROUP BY term"
C["c_stats"] = """
SELECT count(*)::DOUBLE AS n, avg(doc_len) AS avg_len FROM (SELECT DISTINCT ste_id, doc_len FROM c_postings)"""

# Query log and its understanding.
_en, _ru = K.LATIN_KEYS.replace("'", "''"), K.CYRILLIC_KEYS
C["c_queries"] = f"""
SELECT customer_inn AS query_id, customer_inn, 's' || customer_inn || '-20240101' AS session_id,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN left(purchase_name, 2) || substr(purchase_name, 4)
         WHEN 'BUILDING' THEN translate(purchase_name, '{_en}', '{_ru}')
         WHEN 'FURNITURE' THEN left(purchase_name, 1) || substr(purchase_name, 3, 1)
              || substr(purchase_name, 2, 1) || substr(purchase_name, 4)
         WHEN 'HOUSEHOLD' THEN purchase_name || ' deluxe' ELSE purchase_name END
         || ' ' || p_size AS query, ste_id AS expected
FROM c_lines QUALIFY row_number() OVER (PARTITION BY customer_inn
  ORDER BY contract_date DESC, cost DESC, contract_id DESC, ste_id DESC) = 1"""
C["c_query_tokens"] = f"""
SELECT query_id, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS token FROM (
  SELECT query_id, {in_order('found')} AS tokens FROM (
    SELECT query_id, {raw_tokens(norm('query'))} AS found FROM c_queries))"""
C["c_token_types"] = rf"""
SELECT token, token_type, in_dictionary,
       (length(token) < 4 OR token_type IN ('model', 'unit') OR {unit_like('token')} OR {mixed('token')}) AS protected
FROM (SELECT token, d.term IS NOT NULL AS in_dictionary,
             coalesce(d.term_type, CASE WHEN {unit_like('token')} THEN 'unit'
               WHEN regexp_matches(token, '\d') THEN 'model' ELSE 'token' END) AS token_type
      FROM (SELECT DISTINCT token FROM c_query_tokens) LEFT JOIN c_dictionary d ON d.term = token)"""
C["c_layout"] = f"""
SELECT token, d.term AS variant,
       CASE WHEN regexp_matches(token, '[a-z]') THEN 'en_to_ru' ELSE 'ru_to_en' END AS keyboard
FROM c_token_types JOIN c_dictionary d ON d.term = {layout('token')} AND d.term <> token"""
C["c_near"] = """
SELECT token, token_type AS wanted_type, term, doc_freq, term_type,
       damerau_levenshtein(token, term)::INTEGER AS distance
FROM c_token_types t LEFT JOIN c_layout l USING (token) JOIN c_dictionary d
  ON abs(length(token) - length(term)) <= 2 AND damerau_levenshtein(token, term) <= 2
WHERE NOT protected AND NOT in_dictionary AND l.variant IS NULL"""
C["c_suggestions"] = """
SELECT token, term, distance, doc_freq, term_type, round(
    0.42 * greatest(0, 1 - distance / length(token)) + 0.20 * least(1, ln(1 + doc_freq) / 4.5)
    + 0.18 * CASE WHEN wanted_type = 'token' OR wanted_type = term_type THEN 1 ELSE 0.75 END
    + 0.10 * CASE WHEN left(token, 2) = left(term, 2) THEN 1 WHEN left(token, 1) = left(term, 1) THEN 0.82 ELSE 0.2 END
    + 0.05 * CASE WHEN right(token, 2) = right(term, 2) THEN 1 WHEN right(token, 1) = right(term, 1) THEN 0.8 ELSE 0.35 END
    + 0.05 * (1 - abs(length(token) - length(term)) / greatest(length(token), length(term))), 4)::DOUBLE AS score
FROM c_near
QUALIFY row_number() OVER (PARTITION BY token ORDER BY distance, doc_freq DESC, term) = 1"""
C["c_resolved"] = f"""
SELECT r.*, {lemma('resolved', "coalesce(d.term_type, token_type)")} AS lemma
FROM (
  SELECT *, CASE WHEN mode = 'strong' THEN term ELSE coalesce(variant, token) END AS resolved FROM (
    SELECT t.*, variant, keyboard, term, score, distance,
      CASE WHEN term IS NULL THEN 'exact'
        WHEN left(token, 1) <> left(term, 1) OR abs(length(token) - length(term)) > 2 THEN 'exact'
        WHEN score >= CASE WHEN distance <= 1 OR s.term_type = 'brand' THEN 0.75 ELSE 0.82 END
          AND NOT (length(token) >= 6 AND distance > 1 AND left(token, 2) <> left(term, 2)) THEN 'strong'
        WHEN score >= 0.68 THEN 'soft' ELSE 'exact' END AS mode
    FROM c_token_types t LEFT JOIN c_layout USING (token) LEFT JOIN c_suggestions s USING (token))) r
LEFT JOIN c_dictionary d ON d.term = resolved"""
C["c_searched"] = """
SELECT token, 1 AS place, term AS word FROM c_resolved WHERE mode = 'soft'
UNION ALL SELECT token, 2, lemma FROM c_resolved WHERE lemma <> resolved
UNION ALL SELECT token, 3, resolved FROM c_resolved
UNION ALL SELECT token, 4, token FROM c_resolved WHERE mode = 'soft'"""
C["c_expanded"] = """
SELECT token, place, word, 0 AS nth, coalesce(canonical, word) AS form
FROM c_searched LEFT JOIN c_canonical ON alias = word
UNION ALL
SELECT token, place, word, a.pos, a.alias
FROM c_searched LEFT JOIN c_canonical k ON k.alias = word
JOIN c_aliases a ON a.canonical = coalesce(k.canonical, word) AND a.pos <= 4"""
C["c_retrieval"] = f"""
SELECT query_id, {in_order('found')} AS retrieval FROM (
  SELECT query_id, {raw_tokens("string_agg(form, ' ' ORDER BY pos, place, nth)")} AS found
  FROM c_query_tokens JOIN c_expanded USING (token) GROUP BY query_id)"""
C["c_corrected"] = rf"""
SELECT query_id, string_agg(resolved, ' ' ORDER BY pos) AS corrected_query,
       list_distinct(list_concat(
         list(TRY_CAST(nullif(regexp_extract(token, '{NUMBER}', 1), '') AS DOUBLE)),
         list(TRY_CAST(nullif(regexp_extract(resolved, '{NUMBER}', 1), '') AS DOUBLE)))) AS numbers
FROM c_query_tokens JOIN c_resolved USING (token) GROUP BY query_id"""

# Retrieval and score.
C["c_query_terms"] = f"""
SELECT query_id, unnest(terms[1:8]) AS term, len(terms[1:8]) AS n_terms FROM (
  SELECT query_id, {in_order('l')} AS terms FROM (
    SELECT query_id, regexp_extract_all(array_to_string(retrieval, ' '), '[a-z{CYR}0-9]+') AS l FROM c_retrieval))"""
C["c_hits"] = """
SELECT query_id, ste_id, n_terms, count(*) AS n_found, round(-sum(
    CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS bm25
FROM c_query_terms JOIN c_df USING (term) JOIN c_postings USING (term) CROSS JOIN c_stats
GROUP BY query_id, ste_id, n_terms"""
C["c_levelled"] = """
SELECT query_id, ste_id, bm25, level, count(*) OVER (PARTITION BY query_id) AS hit_count FROM (
  SELECT *, CASE WHEN n_found = n_terms THEN 1 ELSE 2 END AS level,
         min(CASE WHEN n_found = n_terms THEN 1 ELSE 2 END) OVER (PARTITION BY query_id) AS best
  FROM c_hits) WHERE level = best"""
C["c_pool"] = """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, ste_id) AS hit_rank
FROM c_levelled QUALIFY hit_rank <= 1500"""
C["c_attr_lists"] = """
SELECT ste_id, list({'n': name_norm, 'v': value_norm, 'x': numeric_value, 'p': name_raw || '::' || value_raw} ORDER BY pos) AS attrs
FROM (SELECT * FROM c_attributes QUALIFY row_number() OVER (
  PARTITION BY ste_id, name_norm, value_norm, numeric_value ORDER BY pos) = 1)
GROUP BY ste_id"""
C["c_matched"] = """
SELECT u.query_id, customer_inn, session_id, ste_id, title_raw, category_raw, category_norm, brand_guess,
       attrs, bm25, level, hit_count, retrieval, title_norm, search_text,
       CASE WHEN corrected_query <> '' AND contains(title_norm, corrected_query) THEN 1 ELSE 0 END AS phrase,
       len(list_filter(retrieval, lambda q: list_contains(title_tokens, q))) AS title_hits,
       CASE WHEN len(list_filter(retrieval, lambda q: contains(category_norm, q))) > 0 THEN 1 ELSE 0 END AS category,
       len(list_filter(attrs, lambda a: len(list_filter(retrieval, lambda q: contains(a.n, q) OR contains(a.v, q))) > 0)) AS attr_hits,
       len(list_filter(numbers, lambda x: len(list_filter(attrs, lambda a: abs(a.x - x) <= 0.01)) > 0)) AS number_hits
FROM c_pool u JOIN c_queries USING (query_id) JOIN c_retrieval USING (query_id) JOIN c_corrected USING (query_id)
JOIN c_products USING (ste_id) JOIN c_search_text USING (ste_id) LEFT JOIN c_attr_lists USING (ste_id)"""
C["c_baseline"] = """
SELECT *, 2 / (1 + abs(bm25)) + 1.2 * phrase + least(0.9, 0.18 * title_hits) + 0.6 * category
       + least(1.2, 0.25 * attr_hits) + least(1.0, 0.5 * number_hits) AS base,
       least(1.0, 0.2 + 0.16 * title_hits + 0.12 * attr_hits + 0.18 * number_hits + 0.18 * phrase + 0.12 * category)::DOUBLE AS gate
FROM c_matched"""
C["c_ranked_base"] = """
SELECT *, round(base, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY round(base, 6) DESC, title_raw, ste_id) AS rank
FROM c_baseline WHERE round(base, 6) > 0"""
C["c_profile_hits"] = """
SELECT query_id, b.ste_id, sum(least(0.16, 0.015 * weight)) AS token_sum
FROM (SELECT query_id, ste_id, customer_inn, search_text, title_norm, category_norm, unnest(retrieval) AS token FROM c_matched) b
JOIN c_token_top USING (customer_inn, token)
WHERE contains(search_text, token) OR contains(title_norm, token) OR contains(category_norm, token)
GROUP BY query_id, b.ste_id"""
C["c_personal"] = """
SELECT b.*, base
   + CASE WHEN coalesce(pw.weight, 0) > 0 THEN least(0.75, 0.28 * ln(1 + pw.weight)) * gate ELSE 0 END
   + CASE WHEN coalesce(cw.weight, 0) > 0 THEN least(0.55, 0.14 * ln(1 + cw.weight)) * greatest(0.45, gate) ELSE 0 END
   + least(0.45, coalesce(token_sum, 0)) * greatest(0.55, gate)
   + coalesce(sp.weight, 0) + coalesce(sc.weight, 0) AS total
FROM c_baseline b
LEFT JOIN c_product_w pw ON pw.customer_inn = b.customer_inn AND pw.ste_id = b.ste_id
LEFT JOIN c_category_w cw ON cw.customer_inn = b.customer_inn AND cw.category_norm = b.category_norm
LEFT JOIN c_session_products sp ON sp.session_id = b.session_id AND sp.ste_id = b.ste_id
LEFT JOIN c_session_categories sc ON sc.session_id = b.session_id AND sc.category_norm = b.category_norm
LEFT JOIN c_profile_hits ph ON ph.query_id = b.query_id AND ph.ste_id = b.ste_id"""
C["c_ranked_personal"] = """
SELECT *, round(total, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, title_raw, ste_id) AS rank
FROM c_personal WHERE round(total, 6) > 0"""

# Feed.
C["c_history"] = """
SELECT customer_inn, ste_id, weight AS history_weight, 0.0::DOUBLE AS category_weight, 0 AS popularity
FROM c_product_w JOIN c_products USING (ste_id)
QUALIFY row_number() OVER (PARTITION BY customer_inn ORDER BY round(weight, 6) DESC, ste_id) <= 180"""
C["c_six"] = """
SELECT customer_inn, category_norm, weight FROM c_category_w
QUALIFY row_number() OVER (PARTITION BY customer_inn ORDER BY round(weight, 6) DESC, category_norm) <= 6"""
C["c_category_tops"] = """
SELECT ste_id, category_norm, coalesce(popularity, 0) AS popularity
FROM c_products LEFT JOIN c_popularity USING (ste_id)
QUALIFY row_number() OVER (PARTITION BY category_norm ORDER BY coalesce(popularity, 0) DESC, ste_id) <= 360"""
C["c_related"] = """
SELECT customer_inn, ste_id, 0.0::DOUBLE AS history_weight, weight AS category_weight, popularity
FROM c_six JOIN c_category_tops USING (category_norm)
QUALIFY row_number() OVER (PARTITION BY customer_inn ORDER BY popularity DESC, ste_id) <= 360"""
C["c_popular"] = """
SELECT ste_id, popularity FROM c_popularity JOIN c_products USING (ste_id)
ORDER BY popularity DESC, ste_id LIMIT 180"""
C["c_askers"] = """
SELECT DISTINCT customer_inn FROM c_contracts UNION ALL SELECT '__new_customer__'"""
C["c_own"] = """
SELECT customer_inn, ste_id, max(history_weight) AS history_weight, max(category_weight) AS category_weight,
       max(popularity) AS popularity
FROM (SELECT * FROM c_history UNION ALL SELECT * FROM c_related) GROUP BY ALL"""
C["c_extra"] = """
SELECT customer_inn, ste_id, 0.0::DOUBLE AS history_weight, 0.0::DOUBLE AS category_weight, popularity
FROM c_askers ANTI JOIN (SELECT customer_inn FROM c_own GROUP BY customer_inn HAVING count(*) >= 180) USING (customer_inn)
CROSS JOIN c_popular"""
C["c_feed_merged"] = """
SELECT customer_inn, ste_id, max(history_weight) AS history_weight, max(category_weight) AS category_weight,
       max(popularity) AS popularity
FROM (SELECT * FROM c_own UNION ALL SELECT * FROM c_extra) GROUP BY ALL"""
C["c_feed"] = """
SELECT *, round((('0x' || left(sha256(CASE WHEN customer_inn = '__new_customer__' THEN 'global' ELSE customer_inn END
            || '::' || category_norm || '::' || ste_id), 8))::BIGINT / 4294967295::DOUBLE)
          * CASE WHEN history_weight > 0 THEN 0.04::DOUBLE ELSE 0.18::DOUBLE END, 4) AS exploration
FROM (
  SELECT m.*, title_raw, category_norm, 0.42::DOUBLE * ln(1 + popularity) + 0.28::DOUBLE * ln(1 + category_weight)
       + 0.22::DOUBLE * ln(1 + history_weight)
       + CASE WHEN history_weight <= 0 AND category_weight > 0 THEN 0.12 ELSE 0 END AS proxy
  FROM c_feed_merged m JOIN c_products USING (ste_id))
QUALIFY row_number() OVER (PARTITION BY customer_inn
  ORDER BY round(proxy, 9) DESC, popularity DESC, title_raw, ste_id) <= 720"""
C["c_feed_tokens"] = """
SELECT f.customer_inn, f.ste_id, sum(least(0.12, 0.012 * weight)) AS token_sum
FROM c_feed f JOIN c_search_text USING (ste_id)
JOIN c_token_top t ON t.customer_inn = f.customer_inn AND t.rank <= 12 AND contains(search_text, t.token)
GROUP BY f.customer_inn, f.ste_id"""
C["c_feed_scored"] = """
SELECT f.*, round(0.2 + least(1.15, 0.34 * ln(1 + history_weight)) + least(0.95, 0.2 * ln(1 + category_weight))
     + least(1.05, 0.16 * ln(1 + popularity)) + exploration + least(0.55, coalesce(token_sum, 0))
     + coalesce(sp.weight, 0) + coalesce(sc.weight, 0), 6) AS score,
     CASE WHEN history_weight > 0 THEN 'history' WHEN category_weight > 0 THEN 'category' ELSE 'popular' END AS bucket
FROM c_feed f LEFT JOIN c_feed_tokens USING (customer_inn, ste_id)
LEFT JOIN c_session_products sp ON sp.session_id = 's' || f.customer_inn || '-20240101' AND sp.ste_id = f.ste_id
LEFT JOIN c_session_categories sc ON sc.session_id = 's' || f.customer_inn || '-20240101' AND sc.category_norm = f.category_norm"""
C["c_feed_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY customer_inn ORDER BY score DESC, title_raw, ste_id) AS plain_rank,
       row_number() OVER (PARTITION BY customer_inn, bucket ORDER BY score DESC, title_raw, ste_id) - 1 AS place
FROM c_feed_scored WHERE score > 0"""
C["c_feed_final"] = """
SELECT *, row_number() OVER (PARTITION BY customer_inn ORDER BY
    CASE WHEN customer_inn = '__new_customer__' THEN plain_rank WHEN bucket = 'history' THEN place // 2 ELSE place END,
    CASE WHEN customer_inn = '__new_customer__' THEN 0 WHEN bucket = 'history' THEN 2 * (place % 2)
         WHEN bucket = 'category' THEN 1 ELSE 3 END) AS rank
FROM c_feed_ranked"""

MATERIALIZED = {
    "c_products", "c_contracts", "c_dictionary", "c_rules", "c_search_text", "c_postings",
    "c_resolved", "c_token_types", "c_hits", "c_pool", "c_matched", "c_token_w", "c_events", "c_feed",
    "c_query_tokens", "c_queries", "c_suggestions", "c_attributes", "c_retrieval", "c_own",
}


def sql(select: str) -> str:
    """``select`` with the common subqueries it needs, in order of definition."""
    needed: set[str] = set()
    pending = set(re.findall(r"\bc_\w+", select)) & C.keys()
    while pending:
        name = pending.pop()
        needed.add(name)
        pending |= (set(re.findall(r"\bc_\w+", C[name])) & C.keys()) - needed
    if not needed:
        return select
    order = [name for name in C if name in needed]
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({C[name]})" for name in order
    ]
    return "WITH " + ",\n".join(parts) + "\n" + select
