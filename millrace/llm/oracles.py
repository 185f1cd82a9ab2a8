"""SQL that gives the rows of the corpus queries plainly, where SQL can."""

_LINES = """
WITH urls AS (SELECT row_key, max(url) AS u FROM pt_crawl WHERE url IS NOT NULL GROUP BY row_key),
docs AS (
  SELECT DISTINCT p.row_key, p.text, nullif(regexp_replace(lower(regexp_extract(coalesce(p.url, urls.u), '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)), '^www\\.', ''), '') AS site
  FROM pt_processed p LEFT JOIN urls ON p.url IS NULL AND p.row_key = urls.row_key
  WHERE p.text IS NOT NULL AND p.row_key IS NOT NULL),
cut AS (SELECT row_key, site, string_split(text, chr(10)) AS ls FROM docs WHERE site IS NOT NULL),
lines AS (SELECT row_key, site, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM cut),
keyed AS (SELECT row_key, site, line_no, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) AS k FROM lines WHERE length(regexp_replace(line, '[^\\p{L}]+', '', 'g')) >= 4)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """WITH t AS (SELECT DISTINCT row_key, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS c FROM pt_processed WHERE row_key IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT row_key, substr(c, CAST(i AS INTEGER), 9) AS s FROM (SELECT row_key, c, unnest(range(1, length(c) - 7)) AS i FROM t WHERE length(c) >= 9)),
n AS (SELECT row_key, count(*) AS n FROM g GROUP BY row_key),
b AS (SELECT x.row_key AS a, y.row_key AS b, count(*) AS m FROM g x JOIN g y ON x.s = y.s AND x.row_key < y.row_key GROUP BY 1, 2)
SELECT b.a AS row_key_a, b.b AS row_key_b FROM b JOIN n p ON b.a = p.row_key JOIN n q ON b.b = q.row_key WHERE b.m > 0.5 * (p.n + q.n - b.m)""",
        "p7_found": """WITH iw AS (SELECT item_id, regexp_extract_all(lower(replace(strip_accents(text), 'ß', 'ss')), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(lower(replace(strip_accents(text), 'ß', 'ss')), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iw WHERE len(w) >= 10)),
dg AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM dw WHERE len(w) >= 10))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON dg.g = ig.g""",
        "p6_found": _LINES
        + """, often AS (SELECT site, k FROM keyed GROUP BY site, k HAVING count(DISTINCT row_key) >= 5)
SELECT DISTINCT keyed.row_key, CAST(keyed.line_no AS INTEGER) AS line_no FROM keyed JOIN often ON keyed.site = often.site AND keyed.k = often.k""",
    }
