"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quillon.llm import mixing

OP7 = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS total, count(*) AS k FROM n),
r AS (SELECT source, 1.0::DOUBLE / k * total / n AS rate FROM n, t),
p AS (SELECT source, rate, greatest(1, ceil(rate / {mixing.PART})::INT) AS parts FROM r),
terms AS (
  SELECT source, parts, rate / parts AS mean, unnest(range(0, {mixing.TERMS + 1})) AS k FROM p),
probs AS (
  SELECT source, parts, k,
         exp(-mean + k * ln(mean) - coalesce(list_sum([ln(i) FOR i IN range(1, k + 1)]), 0)) AS p FROM terms),
cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM probs),
draws AS (
  SELECT d.doc_id, d.source, j,
         ('0x' || substr(md5('17|' || d.doc_id || '|' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN p ON d.source = p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j)),
copies AS (
  SELECT w.doc_id, w.source, count(c.k) AS n
  FROM draws w JOIN cdf c ON c.source = w.source AND c.c <= w.u GROUP BY w.doc_id, w.source),
each AS (SELECT doc_id, source, unnest(range(1, n + 1))::BIGINT AS copy FROM copies)
SELECT doc_id, e.source, text, lang, n_chars, copy, md5('17-order|' || doc_id || '|' || copy) AS shuffle_key
FROM each e JOIN documents USING (doc_id)
"""

OP10 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e'))
           + length(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n')) + 14 AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto, (role = 'assistant' OR i = n) AS ends FROM o)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (ends))::BIGINT AS formatted_chars,
       count(*) FILTER (ends) AS n_examples
FROM c GROUP BY conv_id
"""

OP1 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
ig AS (
  SELECT DISTINCT item_id, k, array_to_string(w[j : j + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM ig),
dg AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[j : j + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, ks WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM dg JOIN ig USING (k, g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1, "op7_mix_sources": OP7, "op10_chat_format": OP10}
