"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP2 = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS r
  FROM documents
), win AS (
  SELECT r, i, list_slice(w, i, i + 4) AS g
  FROM words, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r
), m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN cov USING (r)
), f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         (n_symbols > 0.1 * n_words OR n_dup_lines > 0.1 * n_words) AS own_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum((base_failed OR own_failed)::INT) AS k FROM f GROUP BY source
), p AS (
  SELECT avg(k / n) AS m, coalesce(var_samp(k / n), 0) AS v FROM h
), q AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 1 END AS s FROM p
), d AS (
  SELECT source, (k + m * s) / (n + s) AS rate FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(rate, 9) AS host_rate, (NOT base_failed AND NOT own_failed AND NOT rate > 0.8) AS kept
FROM f JOIN d ON f.source IS NOT DISTINCT FROM d.source
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles(table: str, key: str) -> str:
    """(r, key, g): the distinct shingles of each row of a table."""
    return rf"""
  SELECT DISTINCT r, {key}, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS g
  FROM (
    SELECT row_number() OVER () AS r, {key},
           list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\x20\x09-\x0D]+'),
                       lambda x: x <> '') AS w
    FROM {table}
  ), LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i)
  WHERE len(w) > 0
"""


_OP5 = f"""
WITH d AS ({_shingles("documents", "doc_id")}), b AS ({_shingles("benchmark", "item_id")}),
n AS (SELECT r, count(*) AS n FROM b GROUP BY r)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found
FROM d JOIN b USING (g) JOIN n ON n.r = b.r
GROUP BY d.r, b.r, doc_id, item_id
HAVING 100 * count(*) >= 75 * any_value(n)
"""

_OP8 = f"""
WITH RECURSIVE s AS ({_shingles("documents", "doc_id")}),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
link AS (
  SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r
  JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r
  GROUP BY a.r, b.r HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))
),
reach AS (
  SELECT r AS a, r AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
),
docs AS (SELECT row_number() OVER () AS r, doc_id FROM documents)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(o.doc_id), d.doc_id) AS component_id
FROM docs d LEFT JOIN n ON n.r = d.r LEFT JOIN reach ON reach.a = d.r LEFT JOIN docs o ON o.r = reach.b
GROUP BY d.r, d.doc_id
"""

_WORDS = r"""
SELECT source, lang, 'words@1' AS tokenizer_version, count(*)::BIGINT AS n_docs,
       sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')))::BIGINT AS n_tokens
FROM documents GROUP BY source, lang
"""

_OP6 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), r AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id DESC) AS nth, max(page_id) OVER (PARTITION BY body) AS top FROM p
)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth = 1 THEN NULL ELSE top END AS refers_to
FROM r
"""

#: Checked in the tests alone: a column of numbers and nulls comes as other types from the two engines' frames.
TESTED = {"op6_warc": _OP6}

ORACLES = {"token_counts_words": _WORDS, "op2_quality_rules": _OP2, "op5_decontaminate": _OP5, "op8_jaccard_join": _OP8}
