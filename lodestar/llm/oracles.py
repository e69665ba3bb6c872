"""The results of those operators that SQL can express, for a database that reads the same tables."""

from __future__ import annotations

from .quality import DELTA, GRID, MAX_REPEAT_PERCENT, MIN_WORDS, PATH, RISK, STRATA, WINDOW, least_labels

WARC = """
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> best THEN best END AS refers_to
FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS best
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages) AS p) AS q"""

_ESCAPE = r"""regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|)', '\1\2\\\3', 'g')"""
#: Roles as in the tables: system, user, assistant.
CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), ''))
         AS loss_sha256,
       CAST(sum(length({_ESCAPE}) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 ELSE 6 END) AS BIGINT)
         AS formatted_chars
FROM t GROUP BY conv_id"""

_RATES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
}
_LEVEL = DELTA / (len(STRATA) + 1)
_STEPS = ", ".join(f"({i + 1}, {', '.join(f'CAST({c!r} AS DOUBLE)' for c in step)})" for i, step in enumerate(PATH))
_RULES = ", ".join(f"c_{rule}" for rule in GRID)
_REJECTED = " OR ".join(f"{rule} > c_{rule}" for rule in GRID)
_STRATA = ", ".join(f"'{s}'" for s in STRATA)
QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         CASE WHEN lang IN ({_STRATA}) THEN lang ELSE 'other' END AS stratum FROM documents),
w AS (
  SELECT r, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM d),
g AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w) AS x),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) AS x WHERE n > 1),
c AS (
  SELECT r, CAST(sum(least({WINDOW}, n)) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW}) AS n FROM s) AS x GROUP BY r),
m AS (
  SELECT d.r, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w ON d.r = w.r LEFT JOIN c ON d.r = c.r),
b AS (
  SELECT m.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         {", ".join(f"{x} AS {k}" for k, x in _RATES.items())} FROM m),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT b.* FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
steps AS (SELECT * FROM (VALUES {_STEPS}) AS v(step, {_RULES})),
sizes AS (SELECT stratum, count(*) AS n FROM held GROUP BY stratum),
strata AS (SELECT stratum, CASE WHEN n >= {least_labels(RISK, DELTA)} THEN stratum ELSE 'together' END AS grp FROM sizes),
counts AS (
  SELECT grp, step, count(*) AS n, count(*) FILTER (WHERE {_REJECTED}) AS k
  FROM held JOIN strata ON held.stratum = strata.stratum, steps GROUP BY grp, step),
failed AS (
  SELECT grp, min(CASE WHEN k < n * {RISK!r} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1)
         - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK!r}) + (n - i) * ln(1 - {RISK!r})))) <= {_LEVEL!r}
         THEN {len(PATH) + 1} ELSE step END) AS f FROM counts GROUP BY grp),
chosen AS (
  SELECT strata.stratum, {_RULES} FROM strata JOIN failed ON strata.grp = failed.grp JOIN steps ON step = f - 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM chosen WHERE chosen.stratum = b.stratum AND ({_REJECTED})) AS kept
FROM b"""
