"""DuckDB SQL of the engine's queries, where SQL can express them."""

from __future__ import annotations

from itertools import combinations

from stacklore.functions.scalars import SPACE
from stacklore.functions.vocabulary import ALIASES, STOPWORDS, category_rows

_STEPS = (80, 60)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: White space for RE2: the same characters, written its way.
_RE_SPACE = SPACE.replace("\\u200A", "\\x{200A}").replace("\\u1680", "\\x{1680}").replace("\\u2000", "\\x{2000}").replace("\\u2028", "\\x{2028}").replace("\\u2029", "\\x{2029}").replace("\\u202F", "\\x{202F}").replace("\\u205F", "\\x{205F}").replace("\\u3000", "\\x{3000}")
_TX = """tx AS (SELECT id, list_sort(list_distinct(items)) AS items FROM (SELECT repo_id AS id, list_filter(tech_stack, lambda x: x IS NOT NULL) AS items FROM repos) WHERE len(items) > 0),
 item AS (SELECT id, unnest(items) AS item FROM tx),
 counts AS (SELECT item, count(*) AS count FROM item GROUP BY 1),
 total AS (SELECT count(*) AS n FROM tx)"""
_EDGES = f"""{_TX},
 edges AS (SELECT a.item AS source, b.item AS target, count(*) AS weight, min(a.id) AS first_id FROM item a JOIN item b ON a.id = b.id AND a.item < b.item GROUP BY 1, 2),
 both_ways AS (SELECT source, target, weight::DOUBLE AS weight FROM edges UNION ALL SELECT target, source, weight FROM edges),
 degree AS (SELECT source AS id, sum(weight) AS degree FROM both_ways GROUP BY 1)"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_RE_SPACE}]+|[{_RE_SPACE}]+$', '', 'g')"


def _clean(x: str) -> str:
    out = f"coalesce({x}, '')"
    for pattern in (r"```[\s\S]*?```", "<[^>]+>", f"https?://[^{_RE_SPACE}]+", f"[^a-zA-Z0-9{_RE_SPACE}+\\-#.]", f"[{_RE_SPACE}]+"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"lower(trim({out}))"


_ALIAS = "MAP {" + ", ".join(f"{_text(a)}: {_text(b)}" for a, b in ALIASES.items()) + "}"


def _topics(x: str) -> str:
    value = f"regexp_replace(replace({_strip('lower(t)')}, '_', '-'), '[{_RE_SPACE}]+', '-', 'g')"
    named = f"list_transform(list_filter(coalesce({x}, []::VARCHAR[]), lambda t: t IS NOT NULL), lambda t: coalesce({_ALIAS}[{value}], {value}))"
    stop = "[" + ", ".join(map(_text, STOPWORDS)) + "]"
    return f"list_sort(list_distinct(list_filter({named}, lambda v: length(v) > 2 AND NOT list_contains({stop}, v))))"


_LANGUAGE = f"coalesce(nullif({_strip('language')}, ''), 'Unknown')"
_BUCKET = "CASE WHEN {0} >= 50000 THEN 'mega' WHEN {0} >= 10000 THEN 'high' WHEN {0} >= 1000 THEN 'mid' ELSE 'rising' END"
_ERA = "CASE WHEN {0} >= 2022 THEN '2022+' WHEN {0} >= 2018 THEN '2018-2021' ELSE 'Pre-2018' END"
_YEAR = "coalesce(try_cast(trim(substr({0}, 1, 4)) AS INTEGER), {1})"
_PREPROCESS = f"""WITH one AS (SELECT * FROM (SELECT * REPLACE ({_strip("name")} AS name) FROM github_repos) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY row_id) = 1),
 c AS (SELECT row_id, name, coalesce(stars, 0) AS stars, coalesce(forks, 0) AS forks, coalesce(watchers, 0) AS watchers, coalesce(open_issues, 0) AS open_issues,
  {_LANGUAGE} AS language, {_topics("topics")} AS topics, {_YEAR.format("created_at", 2020)} AS created_year, coalesce(nullif(license, ''), 'Unknown') AS license,
  coalesce(nullif(html_url, ''), 'https://github.com/' || name) AS html_url, coalesce(nullif(data_origin, ''), 'unknown') AS data_origin,
  {_clean("description")} AS clean_desc, {_clean("readme")} AS clean_readme FROM one),
 d AS (SELECT *, CASE WHEN language = 'Unknown' THEN topics ELSE list_append(topics, lower(language)) END AS tags FROM c)
SELECT row_id, name, stars, forks, watchers, open_issues, language, created_year, {_ERA.format("created_year")} AS era, {_BUCKET.format("stars")} AS popularity, license, html_url, data_origin, clean_desc,
 concat_ws(' ', nullif(clean_desc, ''), nullif(clean_readme, ''), nullif(array_to_string(tags, ' '), ''), lower(language)) AS combined_text,
 array_to_string(topics, ', ') AS topics, array_to_string(list_sort(list_distinct(tags)), ', ') AS tech_stack FROM d"""


def _itemsets(support: float, size: int) -> str:
    """CTEs set1 .. setN of frequent itemsets; each level joins the one before with later items."""
    parts = [f"{_TX}, least AS (SELECT greatest(2, ceil({support} * n)) AS least, n FROM total)"]
    parts.append("set1 AS (SELECT [item] AS items, 1 AS size, count FROM counts, least WHERE count >= least)")
    parts.append("freq AS (SELECT item.* FROM item JOIN (SELECT items[1] AS item FROM set1) USING (item))")
    parts.append("own1 AS (SELECT id, [item] AS items, item AS last FROM freq)")
    for k in range(2, size + 1):
        parts.append(f"own{k} AS (SELECT o.id, list_append(o.items, f.item) AS items, f.item AS last FROM own{k - 1} o JOIN freq f ON o.id = f.id AND f.item > o.last)")
        parts.append(f"set{k} AS (SELECT items, {k} AS size, count(*) AS count FROM own{k} GROUP BY 1 HAVING count(*) >= (SELECT least FROM least))")
    parts.append("sets AS (" + " UNION ALL ".join(f"SELECT items, size, count FROM set{k}" for k in range(1, size + 1)) + ")")
    return ",\n ".join(parts)


def _rule_ctes(support: float = 0.012, confidence: float = 0.25, lift: float = 1.1, size: int = 3) -> str:
    splits = []
    for k in range(2, size + 1):
        for m in range(1, k):
            for c in combinations(range(1, k + 1), m):
                rest = [i for i in range(1, k + 1) if i not in c]
                splits.append(f"SELECT [{', '.join(f'items[{i}]' for i in c)}] AS a, [{', '.join(f'items[{i}]' for i in rest)}] AS b, count FROM set{k}")
    return f"""{_itemsets(support, size)},
 split AS ({" UNION ALL ".join(splits)}),
 measured AS (SELECT a AS antecedent, b AS consequent, s.count AS support_count, x.count AS antecedent_count, y.count AS consequent_count, n, s.count::DOUBLE / x.count AS conf, s.count::DOUBLE / x.count / (y.count::DOUBLE / n) AS raw_lift
  FROM split s JOIN sets x ON x.items = a JOIN sets y ON y.items = b, least),
 rules AS (SELECT antecedent, consequent, round(support_count::DOUBLE / n, 5) AS support, support_count, round(conf, 5) AS confidence, round(raw_lift, 5) AS lift,
  round(CASE WHEN conf < 1 THEN (1 - consequent_count::DOUBLE / n) / (1 - conf) ELSE 999.0 END, 5) AS conviction,
  round(support_count::DOUBLE / n - antecedent_count::DOUBLE / n * (consequent_count::DOUBLE / n), 5) AS leverage, antecedent_count, consequent_count
  FROM measured WHERE conf >= {confidence} AND raw_lift >= {lift}),
 tiered AS (SELECT *, CASE WHEN lift >= 10 AND confidence >= 0.8 AND support_count >= 2 THEN 'strong stack signal' WHEN lift >= 3 AND confidence >= 0.5 THEN 'useful recommendation' ELSE 'exploratory' END AS tier FROM rules)"""


_SIDES = "array_to_string(antecedent, ', ') AS antecedent, array_to_string(consequent, ', ') AS consequent"


#: The similarity graph of records by name, under the names that the iterations below use.
_RECORDS = """t AS (SELECT name, tech_stack, row_number() OVER (ORDER BY stars DESC NULLS LAST, name) AS p FROM repos QUALIFY p <= 2500),
 counts AS (SELECT name AS item FROM t), i AS (SELECT DISTINCT name, p, unnest(tech_stack) AS item FROM t), k AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY item ORDER BY p) <= 250),
 edges AS MATERIALIZED (SELECT a.name AS source, b.name AS target, count(*) AS weight FROM k a JOIN k b ON a.item = b.item AND a.p < b.p GROUP BY a.name, b.name, a.p, b.p ORDER BY weight DESC, a.p, b.p LIMIT 5000),
 both_ways AS MATERIALIZED (SELECT source, target, weight::DOUBLE AS weight FROM edges UNION ALL SELECT target, source, weight FROM edges),
 degree AS (SELECT source AS id, sum(weight) AS degree FROM both_ways GROUP BY 1)"""

#: The same of all records, all items and all pairs.
_ALL_RECORDS = """counts AS (SELECT DISTINCT name AS item FROM repos WHERE name IS NOT NULL), i AS MATERIALIZED (SELECT DISTINCT name, unnest(tech_stack) AS item FROM repos),
 both_ways AS MATERIALIZED (SELECT a.name AS source, b.name AS target, count(*)::DOUBLE AS weight FROM i a JOIN i b ON a.item = b.item AND a.name <> b.name GROUP BY 1, 2),
 degree AS (SELECT source AS id, sum(weight) AS degree FROM both_ways GROUP BY 1)"""


def _pagerank(steps: int, edges: str = _EDGES) -> str:
    ctes = [f"{edges}, n AS (SELECT count(*)::DOUBLE AS n FROM counts)"]
    ctes.append("shares AS MATERIALIZED (SELECT source, target, weight / degree AS share FROM both_ways JOIN degree ON id = source)")
    ctes.append("r0 AS MATERIALIZED (SELECT item AS id, degree IS NULL AS dangling, 1.0 / n AS rank FROM counts LEFT JOIN degree ON id = item, n)")
    for i in range(1, steps + 1):
        ctes.append(f"""v{i} AS (SELECT r.id, r.dangling, 0.15 / n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE dangling) / n + 0.85 * coalesce(f, 0) AS v FROM r{i - 1} r
 LEFT JOIN (SELECT target AS id, sum(rank * share) AS f FROM shares JOIN r{i - 1} ON id = source GROUP BY 1) USING (id), n)""")
        ctes.append(f"r{i} AS MATERIALIZED (SELECT id, dangling, v / (SELECT sum(v) FROM v{i}) AS rank FROM v{i})")
    return "WITH " + ",\n ".join(ctes) + f" SELECT id, round(rank, 8) AS pagerank FROM r{steps}"


def _hits(steps: int, edges: str = _EDGES) -> str:
    ctes = [edges, "h0 AS MATERIALIZED (SELECT item AS id, 1.0::DOUBLE AS v FROM counts)"]

    def pull(new: str, old: str) -> str:
        return f"""s{new} AS MATERIALIZED (SELECT item AS id, coalesce(s, 0) AS s FROM counts LEFT JOIN (SELECT target, sum(v * weight) AS s FROM both_ways JOIN {old} ON id = source GROUP BY 1) ON target = item),
 {new} AS MATERIALIZED (SELECT id, s / coalesce(nullif((SELECT sqrt(sum(s * s)) FROM s{new}), 0), 1) AS v FROM s{new})"""

    for i in range(1, steps + 1):
        ctes += [pull(f"a{i}", f"h{i - 1}"), pull(f"h{i}", f"a{i}")]
    return "WITH " + ",\n ".join(ctes) + f" SELECT h.id, round(h.v, 7) AS hub, round(a.v, 7) AS authority FROM h{steps} h JOIN a{steps} a USING (id)"


_DESCRIBED = "SELECT '{0}' AS field, count({0}) AS count, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, round(min({0}), 4)::DOUBLE AS min, round(quantile_cont({0}, 0.25), 4) AS q25, round(quantile_cont({0}, 0.5), 4) AS q50, round(quantile_cont({0}, 0.75), 4) AS q75, round(max({0}), 4)::DOUBLE AS max FROM repos"
_SEARCH = "lower(concat_ws(' ', name, language, bert_category, popularity, nullif(array_to_string(topics, ' '), ''), nullif(array_to_string(tech_stack, ' '), ''), description))"
_RAW_COLUMNS = "row_id name owner stars forks watchers open_issues size_kb language topics description readme homepage created_at updated_at pushed_at license html_url default_branch archived owner_type data_origin collected_at".split()
_VECTORS = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_KNN = f"""WITH {_VECTORS}, s AS (SELECT q.id, d.id AS neighbour, list_cosine_similarity(q.v, d.v) AS s FROM e q JOIN e d ON q.id <> d.id WHERE {{0}})
SELECT id, place::INTEGER AS place, neighbour, round(greatest(s, 0), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, neighbour) AS place FROM s) WHERE place <= 8"""
_CLASSES = f"""{_VECTORS}, m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e) GROUP BY 1, 2),
 l AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1),
 s AS (SELECT e.id, l.label, list_dot_product(e.v, l.v) / sqrt(list_dot_product(l.v, l.v)) AS score FROM e, l),
 c AS (SELECT id, first(label::VARCHAR ORDER BY score DESC, label) AS category, list(score ORDER BY score DESC) AS all_scores FROM s GROUP BY 1)"""
_STOP = "'a', 'and', 'for', 'in', 'of', 'on', 'that', 'the', 'to', 'with'"
_TFIDF = f"""w AS (SELECT repo_id AS id, list_filter(regexp_extract_all(lower(coalesce(description, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM repos),
 g AS (SELECT id, unnest(w) AS term FROM w UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2),
 tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 12000),
 raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM repos)) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term)),
 weights AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"""
_ALL_TFIDF = _TFIDF.replace(" ORDER BY total DESC, term LIMIT 12000", "")


def sql() -> dict[str, str]:
    keywords = ", ".join(f"({i}, {_text(k)})" for i, _, k in category_rows())
    normal = f"regexp_replace(replace({_strip('lower(item)')}, '_', '-'), '[{_RE_SPACE}]+', '-', 'g')"
    fields = ["bert_category", "language", "era", "popularity", "data_origin", "cluster_id", "license"]
    steps = _STEPS
    return {
        "cooccurrence_edges": f"WITH {_EDGES} SELECT source, target, weight, first_id FROM edges",
        "node_degree": f"WITH {_EDGES} SELECT id, degree::BIGINT AS degree_weight FROM degree",
        "item_support": f"WITH {_TX} SELECT item, count, round(count::DOUBLE / n, 8) AS support FROM counts, total",
        "average_length": f"WITH {_TX} SELECT round(avg(len(items)), 6) AS average_length FROM tx",
        "top_edges": f"WITH {_EDGES} SELECT source, target, weight FROM edges ORDER BY weight DESC, first_id, source, target LIMIT 1500",
        "strongest_relations": f"WITH {_EDGES} SELECT source, target, weight, source || ' + ' || target AS relation FROM edges ORDER BY weight DESC, first_id, source, target LIMIT 25",
        "basket_similarity_graph": """WITH t AS (SELECT repo_id AS id, tech_stack, row_number() OVER (ORDER BY stars DESC NULLS LAST, repo_id) AS p FROM repos QUALIFY p <= 2500),
 i AS (SELECT DISTINCT id, p, unnest(tech_stack) AS item FROM t), k AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY item ORDER BY p) <= 250)
SELECT a.id AS source, b.id AS target, count(*) AS weight FROM k a JOIN k b ON a.item = b.item AND a.p < b.p GROUP BY a.id, b.id, a.p, b.p ORDER BY weight DESC, a.p, b.p LIMIT 5000""",
        "clean_documents": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
        "clean_readmes": f"SELECT row_id, {_clean('readme')} AS clean FROM github_repos",
        "normalize_topics": f"SELECT row_id, array_to_string({_topics('topics')}, ', ') AS topics FROM github_repos",
        "preprocess": _PREPROCESS,
        "dedup_first": "SELECT name, row_id, owner FROM github_repos WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY row_id) = 1",
        "dedup_last": "SELECT row_id, name, owner FROM github_repos WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY row_id DESC) = 1",
        "upsert": """SELECT name, seq, html_url FROM (SELECT name, repo_id AS seq, html_url, 0 AS new FROM repos UNION ALL SELECT name, row_id, html_url, 1 FROM github_repos)
WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY new DESC, seq DESC) = 1""",
        "export_projection": """SELECT name, stars, forks, watchers, open_issues, language, substr(coalesce(description, ''), 1, 260) AS description, created_year, era, popularity, bert_category, bert_confidence, semantic_score,
 cluster_id, pca_x, pca_y, license, html_url, data_origin, array_to_string(topics[1:10], ', ') AS topics, array_to_string(tech_stack[1:12], ', ') AS tech_stack FROM repos""",
        "scalar_functions": f"""SELECT repo_id, floor(bert_confidence * 100 + 0.5)::BIGINT || '%' AS confidence,
 array_to_string(list_transform(regexp_extract_all(lower(name), '\\p{{L}}+|\\P{{L}}+'), lambda p: upper(p[1]) || p[2:]), '') AS title,
 replace(replace(replace(replace(replace(coalesce(description, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped,
 CASE WHEN semantic_score IS NOT NULL THEN least(greatest(semantic_score, 0.25), 0.75) END AS clipped, CASE WHEN forks IS NOT NULL THEN round(least(greatest(sqrt(forks::DOUBLE) * 1.4, 4.0), 18.0), 6) END AS radius,
 {_SEARCH} AS search, {_BUCKET.format("stars")} AS bucket, {_ERA.format("created_year")} AS period FROM repos""",
        "date_parts": f"SELECT row_id, {_YEAR.format('created_at', 2020)} AS created, {_YEAR.format('pushed_at', 0)} AS pushed, coalesce(nullif(stars, 0), nullif(watchers, 0), 0) AS stars FROM github_repos",
        "freq_tables": " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS value, count(*) AS count FROM repos GROUP BY 2" for f in fields),
        "top_languages": "SELECT language AS value, count(*) AS count FROM repos GROUP BY 1 ORDER BY count DESC, min(repo_id) LIMIT 25",
        "top_licenses": "SELECT license AS value, count(*) AS count FROM repos GROUP BY 1 ORDER BY count DESC, min(repo_id) LIMIT 12",
        "summary_stats": " UNION ALL ".join(f"SELECT '{c}' AS field, sum({c})::BIGINT AS total, round(avg({c}), 2) AS mean, round(median({c}), 2) AS median, max({c}) AS max FROM repos" for c in ("stars", "forks")),
        "mean_confidence": "SELECT round(avg(bert_confidence), 4) AS mean FROM repos",
        "trend_counts": """WITH top AS (SELECT id FROM graph_nodes ORDER BY pagerank DESC, count DESC, id LIMIT 12), i AS (SELECT created_year AS year, unnest(list_distinct(tech_stack)) AS item FROM repos)
SELECT item, year, count(*) AS count FROM i WHERE item IN (SELECT id FROM top) GROUP BY 1, 2""",
        "trend_pivot": """WITH i AS (SELECT created_year AS year, unnest(list_distinct(tech_stack)) AS item FROM repos)
SELECT year, count(*) FILTER (item = 'python') AS python, count(*) FILTER (item = 'rust') AS rust, count(*) FILTER (item = 'data-pipeline') AS data_pipeline FROM i WHERE item IN ('python', 'rust', 'data-pipeline') GROUP BY 1""",
        "confidence_histogram": """SELECT b::INTEGER AS bucket, count(r.b2) AS count FROM range(10) t(b) LEFT JOIN (SELECT least(greatest(floor(bert_confidence * 10), 0), 9) AS b2 FROM repos WHERE bert_confidence IS NOT NULL) r ON b2 = b GROUP BY 1""",
        "width_histogram": """WITH b AS (SELECT min(stars)::DOUBLE AS low, quantile_cont(stars, 0.99) AS high FROM repos),
 p AS (SELECT least(floor((least(stars, high) - low) / (high - low) * 20), 19)::INTEGER AS bin FROM repos, b WHERE stars IS NOT NULL)
SELECT t.i::INTEGER AS bin, round(low + t.i * (high - low) / 20, 4) AS low, round(low + (t.i + 1) * (high - low) / 20, 4) AS high, count(p.bin) AS count FROM range(20) t(i) CROSS JOIN b LEFT JOIN p ON p.bin = t.i GROUP BY t.i, b.low, b.high""",
        "describe_exact": " UNION ALL ".join(_DESCRIBED.format(c) for c in ("stars", "forks", "bert_confidence")),
        "quantile_99": "SELECT round(quantile_cont(stars, 0.99), 4) AS quantile FROM repos",
        "missing_ratio": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(({c} IS NULL)::INTEGER), 8) AS ratio FROM github_repos" for c in _RAW_COLUMNS) + ") ORDER BY ratio DESC, field LIMIT 12",
        "crosstab": """WITH t AS (SELECT language, count(*) AS n FROM repos WHERE language IS NOT NULL GROUP BY 1 ORDER BY n DESC, language LIMIT 10), r AS (SELECT DISTINCT bert_category FROM repos WHERE bert_category IS NOT NULL)
SELECT r.bert_category AS row, t.language AS "column", count(x.repo_id) AS count FROM r CROSS JOIN t LEFT JOIN repos x ON x.bert_category = r.bert_category AND x.language = t.language GROUP BY 1, 2""",
        "community_summary": "SELECT community, tribe, count(*) AS members, sum(count)::BIGINT AS total, max(pagerank) AS best FROM graph_nodes GROUP BY 1, 2",
        "community_leader": "SELECT community, id FROM graph_nodes QUALIFY row_number() OVER (PARTITION BY community ORDER BY pagerank DESC, id) = 1",
        "most_common_category": "SELECT bert_category AS value, count(*) AS count FROM repos WHERE bert_category IS NOT NULL GROUP BY 1 ORDER BY count DESC, value LIMIT 1",
        "quality_metrics": """SELECT unnest(['rows', 'duplicate_names', 'negative_stars', 'negative_forks', 'confidence_out_of_range', 'empty_stacks', 'blank_texts', 'unique_languages']) AS metric,
 unnest([count(*), count(name) - count(DISTINCT name), count(*) FILTER (stars < 0), count(*) FILTER (forks < 0), count(*) FILTER (bert_confidence < 0 OR bert_confidence > 1),
 count(*) FILTER (coalesce(len(tech_stack), 0) = 0), count(*) FILTER (trim(coalesce(description, '')) = ''), count(DISTINCT language)]) AS value FROM repos""",
        "kpis": """SELECT 'total_repos' AS metric, count(*) AS value FROM repos UNION ALL SELECT 'total_categories', count(DISTINCT bert_category) FROM repos UNION ALL SELECT 'total_technologies', count(*) FROM graph_nodes
 UNION ALL SELECT 'total_communities', count(DISTINCT community) FROM graph_nodes UNION ALL SELECT 'total_edges', 1500 UNION ALL SELECT 'total_rules', 238""",
        "explorer_page": f"""WITH f AS (SELECT repo_id, name, stars, row_number() OVER (ORDER BY stars DESC NULLS LAST, name) AS r, count(*) OVER () AS n FROM repos WHERE language = 'Python' AND contains({_SEARCH}, 'data'))
SELECT repo_id, name, stars FROM f WHERE (r - 1) // 60 = greatest(least(2, ceil(n / 60)), 1) - 1""",
        "systematic_sample": """SELECT repo_id, pca_x, pca_y, cluster_id FROM (SELECT *, row_number() OVER (ORDER BY repo_id) - 1 AS r, count(*) OVER () AS n FROM repos) WHERE r % greatest(1, ceil(n / 420))::BIGINT = 0""",
        "top_repositories": "SELECT name, stars, forks, language, bert_category AS category, html_url AS url FROM repos ORDER BY stars DESC NULLS LAST, forks DESC NULLS LAST, name LIMIT 25",
        "recommendations": """WITH s AS (SELECT name, neighbour, min(neighbour_no) AS neighbour_no, max(score) AS score FROM similarities WHERE neighbour_no <= 8 GROUP BY 1, 2)
SELECT s.name, neighbour_no, neighbour, score, language, bert_category, stars, description, html_url FROM s LEFT JOIN repos r ON r.name = s.neighbour""",
        "neighbour_lists": """WITH s AS (SELECT name, neighbour, min(neighbour_no) AS no FROM similarities GROUP BY 1, 2) SELECT name, string_agg(neighbour, ', ' ORDER BY no, neighbour) AS neighbours FROM s GROUP BY 1""",
        "value_extent": "SELECT 'pca_x' AS field, min(pca_x) AS low, max(pca_x) AS high FROM repos UNION ALL SELECT 'pca_y', min(pca_y), max(pca_y) FROM repos",
        "frequent_itemsets": f"WITH {_itemsets(0.012, 3)} SELECT array_to_string(items, ', ') AS items, size, count, n FROM sets, least",
        "itemset_summary": f"""WITH {_itemsets(0.012, 3)} SELECT 'frequent_' || k || '_itemsets' AS name, count(size) AS value FROM range(1, 4) t(k) LEFT JOIN sets ON size = k GROUP BY k UNION ALL SELECT 'min_support_count', least::BIGINT FROM least""",
        "association_rules": f"WITH {_rule_ctes()} SELECT {_SIDES}, support, support_count, confidence, lift, conviction, leverage, antecedent_count, consequent_count FROM rules",
        "strict_rules": f"WITH {_rule_ctes(0.004, 0.25, 3.0, 4)} SELECT {_SIDES}, support_count, confidence, lift FROM rules",
        "rule_tiers": f"WITH {_rule_ctes()} SELECT tier AS value, count(*) AS count FROM tiered GROUP BY 1",
        "best_rules": f"""WITH {_rule_ctes()}, p AS (SELECT *, CASE tier WHEN 'strong stack signal' THEN 0 WHEN 'useful recommendation' THEN 1 ELSE 2 END AS p FROM tiered)
SELECT {_SIDES}, support_count, confidence, lift, tier FROM p WHERE p = (SELECT min(p) FROM p) ORDER BY support_count DESC, lift DESC, confidence DESC, p.antecedent, p.consequent LIMIT 15""",
        "recommend_stack": f"""WITH {_rule_ctes(0.006)} SELECT array_to_string(antecedent, ' + ') AS given, array_to_string(consequent, ' + ') AS recommend, support_count, confidence, lift
FROM rules WHERE list_contains(antecedent, 'data-pipeline') ORDER BY lift DESC, confidence DESC, antecedent, consequent LIMIT 10""",
        "fpgrowth_itemsets": f"""WITH {_itemsets(0.02, 6)} SELECT array_to_string(items, ', ') AS items, size, count, round(count::DOUBLE / n, 8) AS support FROM sets, least ORDER BY count DESC, size, sets.items LIMIT 15""",
        "pagerank": _pagerank(steps[0]),
        "hits": _hits(steps[1]),
        "rank_leaders": f"SELECT id, round(pagerank, 7) AS pagerank, count FROM ({_pagerank(steps[0])}) JOIN (SELECT item AS id, count(DISTINCT repo_id) AS count FROM (SELECT repo_id, unnest(tech_stack) AS item FROM repos) GROUP BY 1) USING (id) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20",
        "repository_influence": f"SELECT * FROM ({_pagerank(60, _RECORDS)}) JOIN ({_hits(40, _RECORDS)}) USING (id)",
        "repository_influence_all": f"SELECT * FROM ({_pagerank(60, _ALL_RECORDS)}) JOIN ({_hits(40, _ALL_RECORDS)}) USING (id)",
        "keyword_communities": f"""WITH {_TX}, k(p, k) AS (VALUES {keywords}), v AS (SELECT item, {normal} AS n0 FROM counts), m AS (SELECT item, coalesce({_ALIAS}[n0], n0) AS n FROM v)
SELECT item AS id, coalesce(min(p), 13) AS community FROM m LEFT JOIN k ON contains(n, k) OR contains(k, n) GROUP BY 1""",
        "induced_subgraph": f"""WITH {_EDGES}, t AS (SELECT id FROM graph_nodes ORDER BY pagerank DESC, count DESC, id LIMIT 40)
SELECT source, target, weight FROM edges WHERE source IN (SELECT id FROM t) AND target IN (SELECT id FROM t) ORDER BY weight DESC, source, target LIMIT 320""",
        "label_selection": """WITH t AS (SELECT min(pagerank) AS bound FROM (SELECT pagerank FROM graph_nodes ORDER BY pagerank DESC, count DESC, id LIMIT 36)) SELECT id, pagerank, count FROM graph_nodes, t WHERE pagerank >= bound OR count > 300""",
        "knn_cosine": _KNN.format("q.id % 100 = 0"),
        "knn_all": _KNN.format("true"),
        "zero_shot_labels": f"""WITH {_CLASSES} SELECT id, category AS bert_category, round(0.55 + least(greatest(all_scores[1] - all_scores[2], 0), 1) * 0.45, 4) AS bert_confidence, round(all_scores[1], 4) AS semantic_score FROM c""",
        "label_accuracy": f"WITH {_CLASSES} SELECT round(avg((category = label::VARCHAR)::INTEGER), 6) AS accuracy, count(*) AS n FROM c JOIN e USING (id)",
        "confusion_matrix": f"WITH {_CLASSES} SELECT label::VARCHAR AS expected, category AS predicted, count(*) AS count FROM c JOIN e USING (id) GROUP BY 1, 2",
        "tfidf_weights": f"WITH {_TFIDF} SELECT id, term, round(weight, 5) AS weight FROM weights",
        "tfidf_top_terms": f"WITH {_TFIDF}, p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS place FROM weights) SELECT id, place::INTEGER AS place, term, round(weight, 5) AS weight FROM p WHERE place <= 5",
        "tfidf_weights_all": f"WITH {_ALL_TFIDF} SELECT id, term, round(weight, 5) AS weight FROM weights",
        "tfidf_top_terms_all": f"WITH {_ALL_TFIDF}, p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS place FROM weights) SELECT id, place::INTEGER AS place, term, round(weight, 5) AS weight FROM p WHERE place <= 5",
        "validation_checks": f"""WITH {_rule_ctes()}, r AS (SELECT count(*) AS repos, count(*) FILTER (data_origin = 'github_api') AS collected, count(DISTINCT bert_category) AS k FROM repos),
 f AS (SELECT count(*) FILTER (coalesce(len(tech_stack), 0) = 0) AS bare FROM (SELECT tech_stack FROM repos ORDER BY stars DESC NULLS LAST, name LIMIT 200)),
 e AS (SELECT count(*) AS edges FROM (SELECT DISTINCT a.item, b.item FROM item a JOIN item b ON a.id = b.id AND a.item < b.item LIMIT 1500)),
 checks AS (SELECT 'Data Collection & Understanding' AS item, collected > 0 AND (SELECT count(*) FROM github_repos) = repos AS ok, 2 AS max_score FROM r
 UNION ALL SELECT 'Data Preprocessing', bare = 0, 2 FROM f UNION ALL SELECT 'Association Rule Mining', count(*) >= 100, 2 FROM rules
 UNION ALL SELECT 'Link Analysis (PageRank/HITS)', edges >= 100 AND (SELECT count(*) FROM graph_nodes) >= 20, 2 FROM e UNION ALL SELECT 'Visualization', false, 1 UNION ALL SELECT 'Report & Presentation', true, 1
 UNION ALL SELECT 'BERT / Semantic Analysis', k >= 5 AND (SELECT count(DISTINCT name) FROM similarities) = repos, 5 FROM r)
SELECT item, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN ok THEN max_score ELSE 0 END AS score, max_score FROM checks""",
        "insights": f"""WITH {_rule_ctes()}, n AS (SELECT id, count FROM graph_nodes ORDER BY pagerank DESC, count DESC, id LIMIT 1), b AS (SELECT * FROM rules ORDER BY lift DESC, confidence DESC, support_count DESC, antecedent, consequent LIMIT 1),
 m AS (SELECT bert_category, count(*) AS c FROM repos WHERE bert_category IS NOT NULL GROUP BY 1 ORDER BY c DESC, 1 LIMIT 1)
SELECT 1 AS place, id || ' is the most central technology by PageRank, appearing in ' || count || ' repositories.' AS text FROM n
 UNION ALL SELECT 2, 'The strongest association rule is ' || array_to_string(antecedent, ' + ') || ' -> ' || array_to_string(consequent, ' + ') || ' with lift ' || lift || ' and confidence ' || confidence || '.' FROM b
 UNION ALL SELECT 3, bert_category || ' is the largest semantic category with ' || c || ' repositories.' FROM m""",
    }
