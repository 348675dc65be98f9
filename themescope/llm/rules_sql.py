"""The quality rules as DuckDB SQL, by plainer means (window counts, a direct binomial sum)."""

from __future__ import annotations

from themescope.llm.rules import ALPHA, DELTA, RULES

_SPACE = r"[\x20\x09-\x0D]+"
_SIGNALS = "\n    UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r} AS v FROM s" for r in RULES)
_CUTS = ", ".join(f"('{r}', {k}, {float(c)!r})" for r, cs in RULES.items() for k, c in enumerate(sorted(cs, reverse=True)))
_STEPS = max(map(len, RULES.values()))


def _count(text: str, characters: str) -> str:
    return f"length({text}) - length(translate({text}, '{characters}', ''))"


SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(0, len(w) - 4)) AS i,
         unnest(list_transform(range(0, len(w) - 4), lambda k: w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] || ' ' || w[k + 4] || ' ' || w[k + 5])) AS five
  FROM t WHERE len(w) >= 5),
h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT t.doc_id, stratum, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
         ({_count('t', '#*$%&|<>')})::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         {_count('t', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')} AS capitals
  FROM t LEFT JOIN r USING (doc_id)),
s AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_share, n_repeat_words / greatest(n_words, 1) AS repeat_share,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_share, capitals / greatest(word_chars, 1) AS capital_share,
         word_chars / greatest(n_words, 1) AS word_length, -word_chars / greatest(n_words, 1) AS word_shortness
  FROM c),
v AS ({_SIGNALS}),
cuts(rule, k, cutoff) AS (VALUES {_CUTS}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
firsts AS (
  SELECT doc_id, stratum, rule, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 3 = 0 AS picks,
         count(*) FILTER (v <= cutoff) AS f
  FROM v JOIN good USING (doc_id) JOIN cuts USING (rule) GROUP BY doc_id, stratum, rule),
tried AS (
  SELECT stratum, rule, k, count(*) AS n, count(*) FILTER (f <= k) AS x
  FROM firsts JOIN cuts USING (rule) WHERE picks GROUP BY stratum, rule, k),
worth AS (SELECT stratum, rule, coalesce(max(k) FILTER (x <= {ALPHA / len(RULES)!r} * n), -1) AS t FROM tried GROUP BY stratum, rule),
stepped AS (
  SELECT doc_id, stratum, coalesce(min(f) FILTER (f <= t), {_STEPS}) AS step
  FROM firsts JOIN worth USING (stratum, rule) WHERE NOT picks GROUP BY doc_id, stratum),
each AS (
  SELECT stratum, s AS step, count(*) AS n, count(*) FILTER (step <= s) AS x
  FROM stepped CROSS JOIN (SELECT unnest(range(0, {_STEPS})) AS s) GROUP BY stratum, s),
tail AS (
  SELECT stratum, step, n, x, sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0)
           + i * ln({ALPHA!r}) + (n - i) * ln(1 - {ALPHA!r}))) AS p
  FROM (SELECT *, unnest(range(0, x + 1)) AS i FROM each) GROUP BY stratum, step, n, x),
last AS (
  SELECT stratum, max(step) AS step FROM tail
  WHERE x < n * {ALPHA!r} AND p <= {DELTA!r} / (SELECT count(DISTINCT stratum) FROM each) GROUP BY stratum),
cut AS (
  SELECT stratum, rule, cutoff FROM last JOIN worth USING (stratum) JOIN cuts USING (rule)
  WHERE t >= 0 AND k = least(step, t)),
bad AS (SELECT DISTINCT doc_id FROM v JOIN cut USING (stratum, rule) WHERE v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND bad.doc_id IS NULL AS kept
FROM s LEFT JOIN bad USING (doc_id)
"""
