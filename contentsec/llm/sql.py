"""The operators' SQL for DuckDB, over the views of the synthetic tables."""

from __future__ import annotations

from contentsec.llm import license_scan as scan
from contentsec.llm import mixing

_LOWER = f"translate(coalesce(text, ''), '{scan.UPPER}', '{scan.LOWER}')"

OP3 = f"""
WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(x) AS text_sha256
FROM t WINDOW same AS (PARTITION BY x)
"""

OP8 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS size,
         md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END AS w,
         source_size * {mixing.MAX_EPOCHS} AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.SHARE} AS budget FROM per
), rising AS (
  SELECT *, sum(w) OVER () AS w_all, coalesce(sum(cap) OVER up, 0) AS cap_before, coalesce(sum(w) OVER up, 0) AS w_before FROM weighed
  WINDOW up AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (budget - CAST(cap_before AS DOUBLE)) / CAST(w_all - w_before AS DOUBLE) AS own FROM rising
), level AS (
  SELECT arg_min(own, w_before) AS common FROM levels WHERE CAST(cap AS DOUBLE) / w > own
), targets AS (
  SELECT source, source_size, coalesce(least(common * w, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM levels, level
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM targets
), alike AS (
  SELECT source, doc_id, h, size, count(*) AS n FROM sized GROUP BY ALL
), taken AS (
  SELECT a.*, whole, source_size, target, greatest(0, least(size * n, quota - whole * source_size
         - coalesce(sum(size * n) OVER (PARTITION BY a.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS given
  FROM alike a JOIN plan p ON a.source IS NOT DISTINCT FROM p.source
)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, t.source_size, t.target, CAST(t.whole * s.size + t.given // t.n AS BIGINT) AS taken
FROM sized s JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.doc_id IS NOT DISTINCT FROM t.doc_id AND s.size = t.size
"""

_GRAMS = ", ".join(f"({t}, '{label}', '{kind}', {grams}, {place}, '{a}', '{b}', '{c}')" for t, label, kind, grams, place, a, b, c in scan.template_grams())

OP9 = f"""
WITH known(template, label, kind, grams, place, x, y, z) AS (VALUES {_GRAMS}),
lists AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{scan.WORD}') AS w FROM documents
), words AS (
  SELECT r, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM lists
), grams AS (
  SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), votes AS (
  SELECT r, template, label, kind, grams, i - place AS diagonal, place, i AS spot FROM grams JOIN known ON a = x AND b = y AND c = z
), lines AS (
  SELECT r, template, kind, diagonal, count(*) AS n FROM votes GROUP BY ALL
), steps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > CASE kind WHEN 'long' THEN {scan.DRIFT} ELSE 0 END THEN 1
            WHEN lag(diagonal) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM lines WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)
), chains AS (
  SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS chain FROM steps
), runs AS (
  SELECT r, template, diagonal, n, chain, (diagonal - min(diagonal) OVER (PARTITION BY r, template, chain)) // {scan.WIDE} AS part FROM chains
), places AS (
  SELECT r, template, label, kind, grams, chain, part, place, diagonal, spot,
         row_number() OVER (PARTITION BY r, template, chain, part, place ORDER BY n DESC, diagonal, spot) AS strength FROM votes JOIN runs USING (r, template, diagonal)
), strongest AS (
  SELECT *, spot > coalesce(max(spot) OVER (PARTITION BY r, template, chain, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS rises FROM places WHERE strength = 1
), starts AS (
  SELECT r, template, chain, part, min(diagonal) AS start FROM places GROUP BY ALL
), spans AS (
  SELECT r, template, label, kind, start, CAST(count(*) FILTER (rises) AS DOUBLE) / grams AS share FROM strongest JOIN starts USING (r, template, chain, part) GROUP BY r, template, label, kind, grams, chain, part, start
), good AS (
  SELECT *, CASE kind WHEN 'long' THEN share >= {scan.SHARE} ELSE share >= 1 END AS ok FROM spans
), per AS (
  SELECT r, count(*) FILTER (ok AND kind = 'base') AS n_base, min(start) FILTER (ok AND kind = 'base') AS first_word, max(start) FILTER (ok AND kind = 'base') AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok AND kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS labels, max(share) AS score
  FROM good GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM lists LEFT JOIN per USING (r)
"""
