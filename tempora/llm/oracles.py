"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS ticket FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM d GROUP BY source
), w AS (
  SELECT *, (ARRAY[3.0, 1.0, 2.0])[((source_rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s
), h AS (
  SELECT *, most / weight AS height, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w
), l AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY height, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY height, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM h
), t AS (
  SELECT *, least(most, weight * coalesce((SELECT arg_min(step, (height, source_rank)) FROM l WHERE step <= height), (SELECT max(height) FROM l))) AS target FROM l
), q AS (
  SELECT d.*, t.source_rank, t.source_size, t.weight, t.target, t.budget,
    row_number() OVER (PARTITION BY t.source_rank ORDER BY ticket, doc_id, size) AS place,
    sum(size) OVER (PARTITION BY t.source_rank ORDER BY ticket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, (turn * source_size + served)::DOUBLE / weight AS finish FROM q, (VALUES (0), (1)) AS v(turn)
), x AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, turn, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM e
)
SELECT doc_id, size, source_size, target, (size * count(*) FILTER (WHERE total <= budget))::BIGINT AS taken
FROM x GROUP BY doc_id, size, source_size, target, source_rank, place
"""

# The cutoffs of tempora.llm.quality.RULES and its levels, once more in SQL.
QUALITY = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM t WHERE len(w) > 2
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
  ) GROUP BY r
), m AS (
  SELECT t.r, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_capitals
  FROM t LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), v AS (
  SELECT b.*, rule, CASE WHEN whole > 0 THEN part / whole ELSE 0 END AS value FROM b, LATERAL (VALUES
    ('symbols', n_symbols::DOUBLE, n_words), ('capitals', n_capitals::DOUBLE, word_chars), ('repeats', n_repeat_words::DOUBLE, n_words), ('lines', n_dup_lines::DOUBLE, n_lines)
  ) AS x(rule, part, whole)
), c AS (
  SELECT * FROM (VALUES
    ('symbols', [2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1]), ('capitals', [0.9, 0.8, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2]),
    ('repeats', [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]), ('lines', [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15])
  ) AS y(rule, cuts), range(1, 9) AS z(turn)
), good AS (
  SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1
), k AS (
  SELECT lang, c.rule, turn, cuts[turn]::DOUBLE AS cutoff, count(*) AS n, count(*) FILTER (WHERE value > cuts[turn]) AS k
  FROM v JOIN c ON v.rule = c.rule WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL
), s AS (
  SELECT *, k < n * 0.01 AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.01) + (n - j) * ln(0.99))))
    <= 0.05 / (4 * (SELECT count(DISTINCT coalesce(lang, '') || (lang IS NULL)) FROM k)) AS safe FROM k
), a AS (
  SELECT *, bool_and(safe) OVER (PARTITION BY lang, rule ORDER BY turn) AS reached FROM s
), cut AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM a WHERE reached GROUP BY ALL
), bad AS (
  SELECT r, array_to_string(list(v.rule ORDER BY list_position(['symbols', 'capitals', 'repeats', 'lines'], v.rule)), ',') AS rejected_by
  FROM v JOIN cut ON v.lang IS NOT DISTINCT FROM cut.lang AND v.rule = cut.rule AND value > cutoff GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept,
  n_lines, n_capitals, coalesce(rejected_by, '') AS rejected_by
FROM b LEFT JOIN bad USING (r)
"""

NEAR = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS g FROM t
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

HARD = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x)::DOUBLE) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLE = {"op2_quality_risk_controlled": QUALITY, "op4_mix_weighted_fair_queueing": MIX, "op7_near_duplicates_minhash": NEAR, "op13_hard_negatives_one_bit": HARD}
