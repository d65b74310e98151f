"""The collocation query in SQL."""

ORACLE = r"""
WITH p AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, 1 AS s, unnest(w) AS x FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, s, x, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE s = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, s, x, f AS a, string_split(x, ' ') AS w FROM f WHERE s > 1 AND f >= 10),
k AS MATERIALIZED (SELECT lang, x, a, 1 AS k, w[1] AS lx, CASE WHEN s = 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS rx FROM c
  UNION ALL SELECT lang, x, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE s = 3),
q AS MATERIALIZED (SELECT k.lang, k.x, k.a, k.k, l.f AS l, r.f AS r,
    (1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN f AS l ON l.lang = k.lang AND l.x = k.lx JOIN f AS r ON r.lang = k.lang AND r.x = k.rx),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, x ORDER BY score, k) AS o FROM q),
t AS (SELECT lang, w[1] || ' ' || w[2] AS x, a FROM c WHERE s = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE s = 3),
m AS (SELECT lang, x, max(a) AS a FROM t GROUP BY lang, x),
d AS MATERIALIZED (SELECT c.lang, c.x FROM c JOIN m ON m.lang = c.lang AND m.x = c.x WHERE c.s = 2 AND 100 * m.a >= 50 * c.a),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.x) AS rank
  FROM b LEFT JOIN d ON d.lang = b.lang AND d.x = b.x WHERE o = 1 AND d.x IS NULL)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, x AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""
