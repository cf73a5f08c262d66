"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from cloudloom.llm import quality

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def quality_rules() -> str:
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    tests = []
    for _, top, bottom, least, most, words in quality.RULES:
        value = f"({top}::DOUBLE / greatest({bottom}, 1))"
        bounds = [f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None)
        tests.append(f"(n_words < {words} OR ({' AND '.join(bounds)}))")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {' AND '.join(tests)} AS kept
FROM m"""


LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, pos, parts[pos] AS line
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))),
able AS (SELECT * FROM lines WHERE len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 3),
known AS (SELECT line, min((doc_id, pos)) AS first FROM able GROUP BY line HAVING count(DISTINCT site) >= 5),
gone AS (SELECT DISTINCT doc_id, pos FROM able JOIN known USING (line) WHERE (doc_id, pos) <> first),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) FILTER (gone.pos IS NULL) AS rest, count(gone.pos) AS n_gone
         FROM lines LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(n_gone, 0)::BIGINT AS n_removed,
       CASE WHEN text IS NOT NULL THEN length(coalesce(rest, ''))::BIGINT END AS kept_chars, CASE WHEN text IS NOT NULL THEN md5(coalesce(rest, '')) END AS kept_md5
FROM documents LEFT JOIN kept USING (doc_id)"""


CHAT_FORMAT = r"""
WITH calls AS (
  SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
results AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS content FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, c.turn IS NOT NULL AS called, r.turn IS NOT NULL AS answered, text, content,
         text IS NOT NULL AND length(text) >= 1 AND (c.turn % 4 = 0 OR length(text) <= 120) AS valid
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn),
texts AS (
  SELECT *, '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"query":' || to_json(text)::VARCHAR || ',' END || '"turn":' || turn || '},"id":"call-' || turn || '","name":"'
    || CASE WHEN turn % 4 = 0 THEN 'search' ELSE 'lookup' END || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"valid":' || valid || '}' AS call
  FROM linked)
SELECT conv_id, count(*) FILTER (called) AS n_calls, count(*) FILTER (called AND answered) AS n_linked, count(*) FILTER (NOT called) AS n_orphans,
       count(*) FILTER (called AND NOT valid) AS n_invalid, coalesce(string_agg('call-' || turn, ',' ORDER BY turn) FILTER (called), '') AS call_order,
       md5('{"calls":[' || coalesce(string_agg(call, ',' ORDER BY turn) FILTER (called), '') || '],"orphans":['
           || coalesce(string_agg('"call-' || turn || '"', ',' ORDER BY 'call-' || turn) FILTER (NOT called), '') || ']}') AS json_md5
FROM texts GROUP BY conv_id"""
