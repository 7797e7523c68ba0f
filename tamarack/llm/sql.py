"""SQL that says the same as the registered queries, where SQL can."""

from __future__ import annotations

from tamarack.llm.quality import RiskControl

LINE_DEDUP = r"""
WITH d AS (SELECT coalesce(doc_id, -9223372036854775808) AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT k, doc_id, string_split(t, chr(10)) AS a FROM d),
l AS (SELECT k, doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM s),
e AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(k) AS last FROM e WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT k) >= 3),
j AS (SELECT e.*, f.last IS NOT NULL AND e.k < f.last AS gone FROM e LEFT JOIN f ON e.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id, k
"""


def quality_sql(control: RiskControl) -> str:
    """Statistics, exact binomial tests along the paths and verdicts, restated with windows and the log-gamma function."""
    steps = ", ".join(
        f"('{p.name}', {i}, '{r}', CAST({c!r} AS DOUBLE), CAST({p.alpha!r} AS DOUBLE), CAST({p.level!r} AS DOUBLE))"
        for p in control.paths() for i, step in enumerate(p.steps) for r, c in step.items())
    strata = ", ".join(f"'{s}'" for s in control.strata)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM d),
w AS (SELECT doc_id, lang, s, CASE WHEN s = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(s, '[\x20\x09-\x0D]+') END AS words,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS lines FROM b),
p AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM w),
g AS (SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY doc_id),
st AS (SELECT w.doc_id, w.lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
              length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS n_symbols,
              length(s) - length(regexp_replace(s, '\p{{Lu}}+', '', 'g')) AS n_upper,
              len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
       FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
x AS (SELECT *, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS stratum,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base,
             CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_share,
             CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
             CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share,
             CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars ELSE 0 END AS upper_share FROM st),
f AS (SELECT doc_id, stratum, base, rule, share FROM (SELECT doc_id, stratum, base, symbol_share, dup_line_share, repeat_share, upper_share FROM x)
      UNPIVOT (share FOR rule IN (symbol_share, dup_line_share, repeat_share, upper_share))),
step(path, i, rule, cutoff, alpha, level) AS (VALUES {steps}),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
g2 AS (SELECT x.stratum, count(*) AS n FROM x JOIN good ON x.doc_id = good.doc_id GROUP BY x.stratum),
lost AS (SELECT f.stratum, path, i, count(DISTINCT f.doc_id) AS k FROM f JOIN good ON f.doc_id = good.doc_id JOIN step ON f.rule = step.rule AND f.share > step.cutoff
         WHERE NOT f.base GROUP BY ALL),
c AS (SELECT g2.stratum, s.path, s.i, s.alpha, s.level, g2.n, coalesce(lost.k, 0) AS k FROM g2 CROSS JOIN (SELECT DISTINCT path, i, alpha, level FROM step) s
      LEFT JOIN lost ON lost.stratum = g2.stratum AND lost.path = s.path AND lost.i = s.i),
ok AS (SELECT *, k <= n * alpha AND list_sum(list_transform(range(k + 1), lambda j: exp(
            lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(alpha) + (n - j) * ln(1 - alpha)))) <= level AS passes FROM c),
far AS (SELECT stratum, path, coalesce(min(i) FILTER (NOT passes), max(i) + 1) AS reached FROM ok GROUP BY ALL),
o AS (SELECT stratum, bool_or(path = 'all' AND reached > 0) AS together FROM far GROUP BY stratum),
cut AS (SELECT far.stratum, step.rule, step.cutoff FROM far JOIN o ON o.stratum = far.stratum JOIN step ON step.path = far.path AND step.i = far.reached - 1
        WHERE (far.path = 'all') = o.together),
bad AS (SELECT DISTINCT f.doc_id FROM f JOIN cut ON f.stratum = cut.stratum AND f.rule = cut.rule WHERE f.share > cut.cutoff)
SELECT x.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, NOT base AND bad.doc_id IS NULL AS kept
FROM x LEFT JOIN bad ON x.doc_id = bad.doc_id
"""

# Pairs share at least one shingle, so the similarity join is an equality join on shingles.
_COMPONENTS = r"""
WITH RECURSIVE b AS (SELECT doc_id, translate(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
w AS (SELECT doc_id, CASE WHEN s = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(s, '[\x20\x09-\x0D]+') END AS words FROM b),
g AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT i.a, i.b FROM i JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * common >= %d * (p.n + q.n - common)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a AND r.root < e.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
"""
NEAR_DUPLICATES = _COMPONENTS % 80 + "SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"
NGRAM_JOIN = _COMPONENTS % 85 + "SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id"

FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM d),
w AS (SELECT *, CASE WHEN s = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(s, '[\x20\x09-\x0D]+') END AS words FROM b),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, doc_id, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (l.good) AS good, count(*) FILTER (l.toxic) AS toxic
      FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
x(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM x p, x q, x r, x s, x t
      WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before
      FROM o, generate_series(1, 5) AS g(step)),
a AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, k GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""

HARD_NEGATIVES = r"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a_id, a.label = x.label AS same, x.vec_id, CAST(list_dot_product(a.q, x.q) AS BIGINT) AS score
      FROM v a JOIN v x ON a.vec_id <> x.vec_id AND len(a.q) = len(x.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (SELECT p.a_id, p.vec_id AS p_id, p.score AS p_score, s.vec_id AS n_id, s.score AS n_score,
             row_number() OVER (PARTITION BY p.a_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS r
      FROM p JOIN s ON p.a_id = s.a_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.r <= 5)
SELECT a_id AS anchor_id, p_id AS positive_id, CAST(r AS INTEGER) AS rank, n_id AS negative_id, p_score AS positive_score, n_score AS negative_score
FROM n WHERE r <= 3
"""
