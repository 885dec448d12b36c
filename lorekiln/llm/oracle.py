"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

_SHARES = r"""w AS (SELECT chunk_id AS id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM chunks WHERE content IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY ALL)"""

_P1 = f"WITH {_SHARES} SELECT a AS chunk_a, b AS chunk_b FROM b JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.7 - 1e-12"

_P1_GROUPS = f"""WITH RECURSIVE {_SHARES},
p AS MATERIALIZED (SELECT a, b, c = x.n AND c = y.n AS same FROM b JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.7 - 1e-12),
k AS MATERIALIZED (SELECT chunk_id AS id, least(chunk_id, coalesce(min(a), chunk_id)) AS class_id FROM chunks LEFT JOIN p ON b = chunk_id AND same GROUP BY chunk_id),
l AS (SELECT DISTINCT x.class_id AS u, y.class_id AS v FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b WHERE x.class_id <> y.class_id),
t AS MATERIALIZED (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT u AS node, u AS root FROM t UNION SELECT t.v, r.root FROM r JOIN t ON t.u = r.node),
g AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
d AS (SELECT u, count(*) AS n FROM t GROUP BY 1)
SELECT id AS chunk_id, class_id, coalesce(g.root, class_id) AS group_id, coalesce(d.n, 0) AS n_links FROM k LEFT JOIN g ON g.node = class_id LEFT JOIN d ON d.u = class_id"""

_USABLE = "e AS MATERIALIZED (SELECT chunk_id AS id, ord, CAST(embedding AS DOUBLE[]) AS v FROM chunks WHERE len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0)"

_P2 = f"""WITH {_USABLE},
s AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS c FROM e x, e y WHERE x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.9),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM s)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE r <= 5"""

_P2_SEARCH = f"""WITH {_USABLE},
s AS (SELECT x.id AS chunk_id, y.id AS neighbour, list_cosine_similarity(x.v, y.v) AS c FROM e x, e y WHERE x.id <> y.id AND x.ord % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(c, 12) DESC, neighbour) AS rank FROM s)
SELECT chunk_id, rank, neighbour, round(least(c, 1), 6) AS cosine FROM r WHERE rank <= 5"""

_P2_NEAREST = f"""WITH {_USABLE},
s AS (SELECT x.id AS chunk_id, y.id AS neighbour, list_cosine_similarity(x.v, y.v) AS c FROM e x, e y WHERE x.id <> y.id),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(c, 12) DESC, neighbour) AS rank FROM s)
SELECT chunk_id, rank, neighbour, round(least(c, 1), 6) AS cosine FROM r WHERE rank <= 5"""

_P4 = r"""WITH c AS (
  SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(content, '!\[([^\n\r]*?)\]\(data:image/[^;]+;base64,[^)]+\)', '![\1]', 'gi'),
    '<img\s+[^>]*src=["'']data:image/[^;]+;base64,[^"'']+["''][^>]*>', '[image]', 'gi'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS t FROM chunks WHERE content IS NOT NULL)
SELECT chunk_id, CASE WHEN list_aggregate(list_transform(string_split_regex(t, '\n[ \t\r\n]*\n'), lambda b: length(regexp_replace(b, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'))), 'max') <= 2800 THEN 'blocks' ELSE 'inside' END AS kind
FROM c WHERE length(t) > 2800"""

_P6 = r"""w AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, item_id, regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[\p{L}\p{N}]+') FROM eval_items WHERE text IS NOT NULL),
g AS MATERIALIZED (SELECT side, id, i, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12)),
m AS (SELECT DISTINCT d.id AS doc_id, t.id AS item_id, d.i FROM (SELECT * FROM g WHERE side = 0) d JOIN (SELECT * FROM g WHERE side = 1) t ON d.g = t.g)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_groups": _P1_GROUPS,
        "p2_found": _P2,
        "p2_search": _P2_SEARCH,
        "p2_nearest": _P2_NEAREST,
        "p4_found": _P4,
        "p6_found": f"WITH {_P6} SELECT DISTINCT doc_id, item_id FROM m",
        "p7_invariants": "SELECT recipe, CAST(0 AS BIGINT) AS over_repeats, CAST(0 AS BIGINT) AS unlisted, CAST(0 AS BIGINT) AS twice, count(DISTINCT lower(trim(source))) AS sources FROM mix_targets GROUP BY 1",
        "p6_removed": f"""WITH {_P6}, c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 12)) AS p FROM m), r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT doc_id, n AS removed_words, n > 0.5 * len(w) AS dropped FROM r JOIN w ON side = 0 AND id = doc_id""",
        "p6_items": f"WITH {_P6}, c AS (SELECT DISTINCT doc_id, item_id, i + unnest(range(0, 12)) AS p FROM m) SELECT item_id, count(DISTINCT doc_id) AS n_documents, count(*) AS n_words FROM c GROUP BY 1",
    }
