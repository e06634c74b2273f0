"""DuckDB SQL of those queries that SQL can express on whole tables."""

from __future__ import annotations

_CURRENT = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY collected_at DESC NULLS LAST, row_id DESC) AS k
 FROM github_repos WHERE name IS NOT NULL) WHERE k = 1)"""
_FOLD = "trim(lower({}), ' ' || chr(9) || chr(160))"
_TAGS = f"""{_CURRENT},
 raw AS (SELECT 'github_repos' AS src, row_id AS id, unnest(topics) AS v FROM cur UNION ALL SELECT 'repos', repo_id, unnest(tech_stack) FROM repos),
 tag AS (SELECT DISTINCT src, id, {_FOLD.format("v")} AS item FROM raw WHERE {_FOLD.format("v")} <> '')"""
_PAIRS = f"""{_TAGS},
 n AS (SELECT src, count(DISTINCT id) AS n FROM tag GROUP BY 1),
 one AS (SELECT src, item, count(*) AS c FROM tag GROUP BY 1, 2),
 two AS (SELECT a.src, a.item AS item_a, b.item AS item_b, count(*) AS c FROM tag a JOIN tag b ON a.src = b.src AND a.id = b.id AND a.item < b.item GROUP BY 1, 2, 3),
 scored AS (SELECT two.*, x.c AS ca, y.c AS cb, n.n FROM two JOIN one x ON x.src = two.src AND x.item = item_a JOIN one y ON y.src = two.src AND y.item = item_b JOIN n ON n.src = two.src)"""
_TERMS = f"""{_TAGS},
 w AS (SELECT 'github_repos' AS src, row_id AS id, regexp_extract_all(lower(description), '[a-z0-9]+') AS ws FROM cur WHERE trim(description, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> ''),
 t AS (SELECT src, id, term, count(*) AS tf FROM (SELECT src, id, unnest(ws) AS term FROM w) GROUP BY 1, 2, 3 UNION ALL SELECT src, id, item, 1 FROM tag WHERE src = 'repos'),
 size AS (SELECT src, id, sum(tf) AS size FROM t GROUP BY 1, 2),
 n AS (SELECT 'github_repos' AS src, count(*) AS n FROM w UNION ALL SELECT src, count(DISTINCT id) FROM t WHERE src = 'repos' GROUP BY 1),
 total AS (SELECT src, sum(tf) AS total FROM t GROUP BY 1),
 d AS (SELECT src, term, count(*) AS df, sum(tf) AS cf FROM t GROUP BY 1, 2),
 s AS (SELECT t.src, t.id, t.term, t.tf::BIGINT AS tf, df, cf::BIGINT AS cf, n, tf * ln(n / df) AS tfidf, size::DOUBLE AS size, total::DOUBLE AS total
  FROM t JOIN d USING (src, term) JOIN n USING (src) JOIN size USING (src, id) JOIN total USING (src))"""
_PART = "CASE WHEN {0} > 0 THEN ({0}) * ln(({0}) / ({1})) ELSE 0.0 END"
_LLR = "2 * (" + " + ".join(
    _PART.format(a, b)
    for a, b in (
        ("tf::DOUBLE", "size * cf / total"),
        ("size - tf", "size * (total - cf) / total"),
        ("cf::DOUBLE - tf", "(total - size) * cf / total"),
        ("total - size - cf + tf", "(total - size) * (total - cf) / total"),
    )
) + ")"
_COUNTS = f"""{_CURRENT},
 raw AS (SELECT 'topics' AS field, row_id AS id, unnest(topics) AS v FROM cur UNION ALL SELECT 'language', row_id, language FROM cur),
 f AS (SELECT field, id, {_FOLD.format("v")} AS value FROM raw WHERE {_FOLD.format("v")} <> ''),
 n AS (SELECT field, count(DISTINCT id) AS n FROM f GROUP BY 1),
 c AS (SELECT field, value, count(*) AS occurrences, count(DISTINCT id) AS records FROM f GROUP BY 1, 2),
 m AS (SELECT c.*, n AS n_records, CASE WHEN records <= 2 THEN 'rare' WHEN 10 * records >= n THEN 'common' ELSE '' END AS mark FROM c JOIN n USING (field))"""
_SETS = f"""{_TAGS},
 s AS (SELECT src, id, list(item) AS items FROM tag GROUP BY 1, 2 HAVING count(*) >= 4),
 u AS (SELECT s.src, s.id, len(items) AS n, tag.item FROM s JOIN tag USING (src, id)),
 i AS (SELECT a.src, a.id AS id_a, b.id AS id_b, a.n + b.n AS n, count(*) AS k FROM u a JOIN u b ON a.src = b.src AND a.item = b.item AND a.id < b.id GROUP BY 1, 2, 3, 4)"""

_SHINGLES = f"""{_CURRENT},
 t AS (SELECT 'readme' AS field, row_id AS id, readme AS text FROM cur UNION ALL SELECT 'description', row_id, description FROM cur),
 w AS (SELECT field, id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t WHERE text IS NOT NULL),
 g AS (SELECT DISTINCT field, id, unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS g FROM w WHERE len(w) >= 3),
 k AS (SELECT field, id, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 6),
 s AS (SELECT g.field, g.id, n, hash(g) AS g FROM g JOIN k USING (field, id)),
 p AS (SELECT a.field, a.id AS row_id_a, b.id AS row_id_b, a.n + b.n AS n, count(*) AS c FROM s a JOIN s b ON a.field = b.field AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3, 4)"""
_PLAIN = "replace(replace(replace(replace(replace(replace(replace(lower({}), ' ', ''), chr(9), ''), chr(160), ''), '_', ''), '-', ''), '.', ''), '/', '')"
_CANONICAL = f"""raw AS (SELECT 'github_repos' AS src, row_id AS id, unnest(list_distinct(topics)) AS value FROM github_repos UNION ALL SELECT 'repos', repo_id, unnest(list_distinct(tech_stack)) FROM repos),
 q AS (SELECT DISTINCT src, id, value, {_PLAIN.format("value")} AS p FROM raw WHERE trim(value, ' ' || chr(9) || chr(160)) <> '' AND value NOT IN (SELECT canonical FROM tech_vocab)),
 v AS (SELECT canonical, {_PLAIN.format("canonical")} AS p FROM tech_vocab),
 a AS (SELECT {_PLAIN.format("alias")} AS p, canonical FROM tech_alias),
 d AS (SELECT u.p, v.canonical, levenshtein(u.p, v.p) AS d FROM (SELECT DISTINCT p FROM q) u JOIN v ON levenshtein(u.p, v.p) <= least(2, len(v.p) // 4)),
 m AS (SELECT p, min(d) AS d FROM d GROUP BY 1),
 b AS (SELECT p, CASE count(*) WHEN 1 THEN min(canonical) ELSE '' END AS canonical FROM d JOIN m USING (p, d) GROUP BY 1)"""
_TOKENS = "len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r\\f\\v]+'))"
_GRAMS = """dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
 iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
 dg AS (SELECT doc_id, unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, len(w) - 8)]) AS g FROM dw WHERE len(w) >= 10),
 ig AS (SELECT item_id, unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, len(w) - 8)]) AS g FROM iw WHERE len(w) >= 10)"""


def sql() -> dict[str, str]:
    return {
        "p1_pairs": f"WITH {_PAIRS} SELECT src, item_a, item_b, c AS n_both, ca AS n_a, cb AS n_b, n AS n_baskets, round(c::DOUBLE * n / (ca::DOUBLE * cb), 6) AS lift FROM scored WHERE c >= 2",
        "p1_all_pairs": f"WITH {_PAIRS} SELECT src, item_a, item_b, c AS n_both, ca AS n_a, cb AS n_b, n AS n_baskets, round(c::DOUBLE * n / (ca::DOUBLE * cb), 6) AS lift FROM scored",
        "p1_found": f"WITH {_PAIRS} SELECT src, item_a, item_b FROM scored WHERE c >= greatest(4, ceil(n * 4 / 1000)) AND c * n >= 3 * ca * cb",
        "p2_scores": f"WITH {_TERMS} SELECT src, id, term, tf, df, cf, round(CASE WHEN tf * total >= size * cf THEN 1 ELSE -1 END * {_LLR}, 4) + 0.0 AS llr, round(tfidf, 4) AS tfidf FROM s",
        "p2_found": f"WITH {_TERMS} SELECT src, id, term FROM s WHERE df >= 2 AND tfidf >= CASE src WHEN 'repos' THEN 0.7 ELSE 1.25 END * ln(n) - 1e-9",
        "p5_frequencies": f"WITH {_COUNTS} SELECT field, value, occurrences, records, n_records, mark FROM m",
        "p5_found": f"WITH {_COUNTS} SELECT field, value, mark FROM m WHERE mark <> ''",
        "p6_found": f"WITH {_SETS} SELECT src, id_a, id_b FROM i WHERE k * 5 >= (n - k) * 3",
        "p3_found": f"WITH {_SHINGLES} SELECT field, row_id_a, row_id_b FROM p WHERE 2 * c >= n - c",
        "p7_found": f"WITH {_CANONICAL} SELECT src, id, value, coalesce(a.canonical, b.canonical, '') AS canonical FROM q LEFT JOIN a ON a.p = q.p LEFT JOIN b ON b.p = q.p",
        "p8_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 1024",
        "p8_totals": f"SELECT doc_id, {_TOKENS} AS tokens, ({_TOKENS} + 1023) // 1024 AS pieces FROM documents WHERE {_TOKENS} > 0",
        "p9_found": f"WITH {_GRAMS} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    }
