"""DuckDB statements of those operators that SQL can express."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"
_SPACE = rf"{_WS}+"
_WORD = r"[^\x20\x09-\x0D]+"
#: The phrases of the rule that is checked.
_PHRASES = (
    r"all rights reserved|©|copyright \(c\)|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|"
    r"enable javascript|javascript is (disabled|required)|lorem ipsum|click here|read more$|sign up (now|for)|subscribe (now|to our)|"
    r"powered by|^licensed under|^released under the|is licensed under the|^share (this|on)|"
    r"alle rechte vorbehalten|datenschutzerklärung|^impressum$|cookies akzeptieren|tous droits réservés|politique de confidentialité|accepter (tous )?les cookies|"
    r"todos los derechos reservados|política de privacidad|aceptar (todas las )?cookies"
)

OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l
  FROM d
), starts AS (
  SELECT rid, unnest(generate_series(1, len(w) - 7)) AS i, w FROM w WHERE len(w) >= 8
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i:i+7]) AS n FROM starts
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat
  FROM windows, (SELECT unnest(generate_series(0, 7)) AS j) WHERE n > 1 GROUP BY rid
), judged AS (
  SELECT rid, x, length(regexp_replace(x, '{_SPACE}', '', 'g')) AS bare,
         length(regexp_replace(x, '[^#*$%&|<>{{}}\\^~=_]+', '', 'g')) AS sym,
         regexp_extract_all(x, '{_WORD}') AS tok, regexp_matches(x, '[.!?;:,…。！？؟।]') AS ends,
         regexp_matches(lower(x), '{_PHRASES}') AS boiler
  FROM (SELECT rid, unnest(l) AS x FROM w)
), kept_chars AS (
  SELECT rid, sum(bare) AS kept FROM judged
  WHERE NOT (sym * 100 > bare * 10
    OR (len(list_filter(tok, lambda k: regexp_matches(k, '^[|>/»›•·]+$'))) >= 3
        AND len(list_filter(tok, lambda k: regexp_matches(k, '^[|>/»›•·]+$'))) * 100 >= len(tok) * 25)
    OR (len(tok) >= 12 AND NOT ends) OR boiler)
  GROUP BY rid
), base AS (
  SELECT w.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(kept, 0) AS kept
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN kept_chars USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
        AND kept * 100 >= word_chars * 50) AS kept
FROM base
"""

OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), lines AS (
  SELECT rid, host, t, x, i, regexp_replace(x, '^{_SPACE}|{_SPACE}$', '', 'g') AS bare
  FROM (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)
), totals AS (
  SELECT host, count(DISTINCT t) AS pages FROM d GROUP BY host
), boiler AS (
  SELECT l.host, bare FROM lines l JOIN totals USING (host) WHERE bare <> ''
  GROUP BY l.host, bare, pages HAVING count(DISTINCT t) > 1 AND count(DISTINCT t) > pages * 0.06
), marked AS (
  SELECT l.*, b.bare IS NOT NULL AS gone FROM lines l LEFT JOIN boiler b ON l.host = b.host AND l.bare = b.bare
)
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped
FROM marked JOIN d USING (rid) GROUP BY rid, doc_id
"""

ORACLE = {
    "op5_site_line_frequency": OP5,
    "op9_line_first_cleaning": OP9,
}
