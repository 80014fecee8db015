"""The text queries that SQL can express, as statements over the test tables."""

from __future__ import annotations

from .url_filter import BLOCKED_WORDS

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

TOP_K = """
WITH parts AS (
  SELECT vec_id, pos, CAST(floor(256 * CAST(embedding[pos] AS DOUBLE)) AS BIGINT) AS x, len(embedding) AS dim
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS e
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts AS q JOIN parts AS c ON q.pos = c.pos AND q.dim = c.dim AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) AS r
WHERE rank <= 5
"""

MIXING = """
WITH sizes AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
sums AS (SELECT sum(sqrt(n_rows)) AS all_raw, sum(n_rows) AS all_rows FROM sizes),
rates AS (
  SELECT source, round(sqrt(n_rows) / all_raw * all_rows / n_rows, 9) AS rate FROM sizes, sums
),
parts AS (
  SELECT source, CAST(ceil(rate / 8.0) AS INT) AS parts, rate / greatest(ceil(rate / 8.0), 1) AS mean FROM rates
),
terms AS (
  SELECT source, k, CASE WHEN mean = 0 THEN (k = 0)::INT ELSE exp(k * ln(mean) - mean - lgamma(k + 1)) END AS p
  FROM parts, generate_series(0, 50) AS s(k)
),
steps AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM terms),
cdf AS (SELECT source, list(below ORDER BY below) AS below FROM steps GROUP BY source),
draws AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.row_no, c.below,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || CAST(j AS VARCHAR)), 1, 12)
              AS BIGINT) / 281474976710656.0 AS u
  FROM (SELECT *, row_number() OVER () AS row_no FROM documents) AS d
  JOIN parts AS p ON d.source IS NOT DISTINCT FROM p.source
  JOIN cdf AS c ON d.source IS NOT DISTINCT FROM c.source, generate_series(1, p.parts) AS g(j)
),
counts AS (
  SELECT row_no, any_value(doc_id) AS doc_id, any_value(text) AS text, any_value(lang) AS lang,
         any_value(source) AS source, any_value(n_chars) AS n_chars,
         sum(len(list_filter(below, lambda b: u >= b))) AS n
  FROM draws GROUP BY row_no
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy
FROM counts, generate_series(1, CAST(n AS BIGINT)) AS g(copy)
"""

PHRASES = """
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
worded AS (
  SELECT lang, w FROM (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
  ) AS p WHERE len(w) > 0
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM worded, generate_series(1, 5) AS s(size)) AS g
),
freq AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, h.f AS l, t.f AS r, n,
         (1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f) AS score
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM candidates) AS c
  JOIN totals USING (lang)
  JOIN freq AS h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:k], ' ')
  JOIN freq AS t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1:c.size], ' ')
),
inner_parts AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, m, unnest(generate_series(1, size - m + 1)) AS i
        FROM candidates, generate_series(2, 4) AS s(m) WHERE m < size) AS p
),
covered AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidates AS c
  JOIN inner_parts AS p ON p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.a >= 100 * c.a
),
least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM least ANTI JOIN covered USING (lang, phrase)) AS x
WHERE rank <= 2000
"""

_ABC, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _url_filter() -> str:
    blocked = ", ".join(f"('^{word}^', '{word}')" for word in BLOCKED_WORDS)
    return f"""
WITH rules(rule, host, path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
),
blocked(pattern, word) AS (VALUES {blocked}),
cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parsed AS (
  SELECT page_id, translate(url, {_ABC}, {_LOW}) AS lower,
         translate(regexp_extract(rest, '^[^/?#]*'), {_ABC}, {_LOW}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
ruled AS (
  SELECT p.*, (SELECT max({{'n': length(rule), 'rule': rule, 'verdict': r.verdict}}) FROM rules AS r
               WHERE ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.path)) AS best,
         (SELECT max({{'n': length(pattern), 'pattern': pattern}}) FROM blocked
          WHERE regexp_matches(p.lower, '(^|[^a-z0-9])' || word || '([^a-z0-9]|$)')) AS worst
  FROM parsed AS p
)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN worst IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN best IS NULL THEN worst.pattern END AS pattern
FROM ruled
"""


FILTER_AUDIT = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
worded AS (
  SELECT t.*, first, list_filter(string_split_regex(t.text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM texts AS t JOIN firsts AS f ON f.text = t.text
),
marked AS (
  SELECT doc_id, part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [
           len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
           100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
           regexp_matches(text, '[#$%&*|]'), coalesce(first < doc_id, false)][i]) AS fails
  FROM worded
),
judged AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
groups AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM marked LEFT JOIN judged USING (doc_id) GROUP BY part, fails
),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS own,
         string_split(filter_order[1:step - 1], '') AS before
  FROM orders, generate_series(1, 5) AS s(step)
),
audited AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS kept,
         coalesce(sum(n) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS removed,
         coalesce(sum(n) FILTER (list_contains(fails, own) AND list_has_any(fails, before)), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = [own]), 0) AS unique_fails,
         coalesce(sum(good) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS toxic_lost
  FROM groups, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM audited
"""


def statements() -> dict[str, str]:
    return {
        "op4_exact_dedup": EXACT_DEDUP, "op7_topk": TOP_K, "op10_mixing": MIXING, "op11_phrases": PHRASES,
        "op12_url_filter": _url_filter(), "op13_filter_audit": FILTER_AUDIT,
    }
