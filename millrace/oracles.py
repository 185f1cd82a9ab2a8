"""SQL that says plainly what each query returns, for DuckDB over the same tables."""

from __future__ import annotations

_CUT = r"""'^[^.,!?:;"''(){}\[\]-]*'"""
# The code of a byte by the definition: n is 255 for byte 0, the byte itself below 128, one less from there; letter n mod 26, then one of ten letters by n div 26.
_BYTE = "CAST(concat('0x', substr(sha1({0}), 2 * CAST(i AS INTEGER) + 1, 2)) AS INTEGER)"
_NUMBER = "(CASE WHEN {0} = 0 THEN 255 WHEN {0} < 128 THEN {0} ELSE {0} - 1 END)"


def _hash(x: str) -> str:
    n = _NUMBER.format(_BYTE.format(x))
    return f"list_aggregate(list_transform(range(0, 20), lambda i: chr(97 + {n} % 26) || substr('acegikmoqs', 1 + {n} // 26, 1)), 'string_agg', '')"


def _tokens(table: str, doc: str, text: str) -> str:
    return rf"""pieces AS (SELECT {doc} AS doc, string_split(trim(regexp_replace({text}, '\s+', ' ', 'g')), ' ') AS ps FROM {table} WHERE {text} IS NOT NULL AND {doc} IS NOT NULL),
raw AS (SELECT doc, unnest(ps) AS w, unnest(range(len(ps))) AS pos FROM pieces),
tok AS (SELECT doc, CAST(pos AS INTEGER) AS pos, lower(regexp_extract(w, {_CUT}, 0)) AS word FROM raw WHERE regexp_extract(w, {_CUT}, 0) <> '')"""


_TOK = "WITH " + _tokens("documents", "doc_id", "text")
_PAGES = "pages AS (SELECT row_key, max(text) AS text FROM pt_processed WHERE text IS NOT NULL GROUP BY row_key)"
_SERVED = "WITH " + _PAGES + ", " + _tokens("pages", "row_key", "text")
_INDEX = ", idx AS (SELECT word, doc, count(*) AS tf, list_sort(list(pos)) AS positions, 0.4::DOUBLE + 0.6::DOUBLE * count(*) / max(count(*)) OVER (PARTITION BY doc) AS doc_tf FROM tok GROUP BY word, doc)"
_RANKS = ", ranks AS (SELECT url_hash, max(rank) AS rank FROM pt_pgrk WHERE rank IS NOT NULL AND url_hash IS NOT NULL GROUP BY url_hash)"
_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_CELLS = "WITH cells AS (SELECT CAST(user_id AS VARCHAR) AS row_key, event_type AS col, CAST(event_id AS VARCHAR) AS value, event_id AS version FROM events)"
_LATEST = "SELECT row_key, col, arg_max(value, version) AS value, max(version) AS version FROM {} GROUP BY row_key, col"
_PAIRS = "WITH a AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS value FROM events WHERE event_type = 'purchase'), b AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS value FROM events WHERE event_type = 'error')"
_EDGES = "WITH edges AS (SELECT DISTINCT row_key AS src, col AS dst FROM pt_outgoing WHERE row_key IS NOT NULL AND col IS NOT NULL), nodes AS (SELECT DISTINCT row_key FROM pt_crawl WHERE row_key IS NOT NULL)"
_DOMAIN = r"(SELECT {0})"


def _normal(link: str, base: str, source: str, keep: str) -> str:
    """CTEs that turn (keep, link, base) of ``source`` into the table ``norm`` with the normalised link."""
    return rf""", n1 AS (SELECT {keep}, regexp_replace(trim(regexp_replace({link}, '#.*$', '')), '\\+$', '') AS r, lower(regexp_extract({base}, '^([A-Za-z]+)://', 1)) AS bp, regexp_extract({base}, '^[A-Za-z]+://([^/?#]*)', 1) AS ba,
 regexp_replace(regexp_extract({base}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS bf FROM {source} WHERE {link} IS NOT NULL AND {base} IS NOT NULL),
n2 AS (SELECT *, CASE WHEN bf = '' THEN '/' ELSE bf END AS folder, replace(r, ' ', '%20') AS s FROM n1 WHERE r <> '' AND NOT regexp_matches(r, '[<>"''{{}}|^\[\]\\]') AND NOT regexp_matches(lower(r), '^(mailto|javascript|tel|data|ftp):')),
n3 AS (SELECT *, CASE WHEN regexp_matches(s, '^[A-Za-z]+://') THEN s WHEN starts_with(s, '//') THEN bp || ':' || s WHEN starts_with(s, '/') THEN bp || '://' || ba || s
 WHEN starts_with(s, '../') THEN bp || '://' || ba || regexp_replace(folder, '[^/]+/$', '') || substr(s, 4) ELSE bp || '://' || ba || folder || s END AS u FROM n2),
n4 AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS sc, regexp_extract(u, '^[A-Za-z]+://([^/:?#]*)', 1) AS h, regexp_extract(u, '^[A-Za-z]+://[^/:?#]*:([0-9]+)', 1) AS po, regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]*(.*)$', 1), '/{{2,}}', '/', 'g') AS rest FROM n3),
norm AS (SELECT *, sc || '://' || h || ':' || CASE WHEN po <> '' THEN po WHEN sc = 'https' THEN '443' ELSE '80' END || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS full_link FROM n4 WHERE sc IN ('http', 'https') AND regexp_matches(h, '^[A-Za-z0-9.-]+$'))"""


_HOST = "coalesce(nullif(regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), '^www\\.', ''), ''), 'Unknown')"
_TOP = "regexp_extract(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)', 1), '([^.]*\\.)?[^.]*$', 0)"
_CRAWLABLE = "(regexp_matches({0}, '^https?://') AND NOT regexp_matches(lower({0}), '\\.(jpg|jpeg|gif|png|txt)$'))"
_UNWANTED = "(length({0}) > 200 OR regexp_matches(lower({0}), '^https?://(www\\.)?nbcnews\\.com(:[0-9]+)?/select.*') OR regexp_matches(lower({0}), '.*(ad|track|utm|promo|sponsored).*') OR regexp_matches(lower({0}), '.*(/ads/|/sponsored/).*') OR contains(lower({0}), 'mailto:') OR contains(lower({0}), 'javascript:') OR contains(lower({0}), 'tel:'))"
_LISTED = "WITH listed AS (SELECT row_key, url, unnest(string_split(links, chr(10))) AS raw FROM pt_processed WHERE links IS NOT NULL AND url IS NOT NULL)" + _normal("raw", "url", "listed", "row_key, url")
_LETTERS = "trim(regexp_replace(regexp_replace(lower({0}), '<[^>]*>', ' ', 'g'), '[^a-z]+', ' ', 'g'))"
_PAGE_WORDS = r"""list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '[.,:;!?''’"()\-\r\n\t]', ' ', 'g')), ' +'), lambda w: w <> '')"""


def _meta(attribute: str, name: str) -> str:
    return f"""regexp_extract(page, '(?i)<meta\\s+{attribute}="{name}"\\s+content="([^"]*)"', 1)"""


def _icon(rel: str) -> str:
    return f"""nullif(regexp_extract(page, '(?i)<link\\s+rel="{rel}"\\s+href="([^"]*)"', 1), '')"""


def _rank_rounds(n: int, extra: str = "", weight: str = "0.85 / d.degree", edge_filter: str = "", base: str = "0.15") -> str:
    out = _EDGES + f""", degree AS (SELECT src, count(*) AS degree FROM edges GROUP BY src){extra},
w AS (SELECT e.src, e.dst, {weight} AS w FROM edges e JOIN degree d ON e.src = d.src JOIN nodes a ON e.src = a.row_key JOIN nodes b ON e.dst = b.row_key{edge_filter}),
r0 AS (SELECT row_key, 1.0::DOUBLE AS rank FROM nodes)"""
    for k in range(1, n + 1):
        out += f""",
r{k} AS (SELECT r.row_key, {base.format(k - 1)} + coalesce(i.s, 0) AS rank, r.rank AS prev FROM r{k - 1} r LEFT JOIN (SELECT w.dst, sum(p.rank * w.w) AS s FROM w JOIN r{k - 1} p ON w.src = p.row_key GROUP BY w.dst) i ON i.dst = r.row_key)"""
    return out


_TITLE_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', {0}, {1})), '[^a-z0-9]+'), lambda w: w <> ''))"


_DIVERSE = f"""d1 AS (SELECT c.doc, c.rank, m.u AS url, {_TOP.format('m.u')} AS domain, regexp_extract(m.u, '^[^?#]*', 0) AS root FROM all_cand c JOIN heads ON c.doc = heads.doc WHERE m.u IS NOT NULL),
d2 AS (SELECT *, row_number() OVER (PARTITION BY domain, root ORDER BY rank DESC, url) AS n FROM d1), d3 AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rank DESC, url) AS k FROM d2 WHERE n = 1),
cand AS (SELECT doc, rank FROM d3 WHERE k <= 2 ORDER BY rank DESC, url LIMIT 30)"""


#: The first pair of places of two words, in order, that is within {0} of each other, else the closest pair.
_NEAR = """SELECT doc, arg_min({{'p': p, 'q': q}}, (CASE WHEN abs(p - q) <= {0} THEN 0 ELSE abs(p - q) END, least(p, q), abs(p - q))) AS b FROM (SELECT a.doc, unnest(a.positions[1:19]) AS p, b.positions[1:19] AS bp FROM idx a JOIN idx b ON a.doc = b.doc
 WHERE a.word = 'library' AND b.word = 'harbour') x, LATERAL (SELECT unnest(x.bp) AS q) y WHERE abs(p - q) <= 20 GROUP BY doc"""
_PHRASE = "0.7 / (abs(b.p - b.q) + 2) + 0.3 / (1 + CASE WHEN b.p > b.q THEN 1 ELSE 0 END)"


def _snippet(text: str, best: str, length: int) -> str:
    """SQL for the words around the first of the places ``best``."""
    words = rf"regexp_split_to_array(regexp_replace({text}, '^\s+|\s+$', '', 'g'), '\s+')"
    start = f"CASE WHEN len({best}) > 0 THEN greatest(0, {best}[1] - {length // 2}) ELSE 0 END"
    return f"list_aggregate(list_transform({words}[{start} + 1:{start} + {length}], lambda w: CASE WHEN list_contains({best}, list_position({words}, w) - 1) THEN '<b>' || w || '</b>' ELSE w END), 'string_agg', ' ')"


def _score(phrase: bool, weights: tuple[float, ...], diverse: bool = False, candidates: int = 200, twice: bool = False, offset: int = 0) -> str:
    """A page of ten results."""
    total = sum(weights)
    names = ("phrase", "rank", "tfidf", "title") if phrase else ("rank", "tfidf", "title")
    w = dict(zip(names, weights))
    terms = " + ".join(f"({w[k]}::DOUBLE / {total}) * (1 / (1 + exp(-{'title_score' if k == 'title' else k})))" for k in names)
    shown = ", ".join(f"round({c}, 6) AS {c}" for c in ("score", "tfidf", "rank", "title_score", "phrase"))
    best = "CASE WHEN b IS NULL THEN [] ELSE [b.p, b.q] END"
    return (
        _SERVED
        + _INDEX
        + _RANKS
        + f""", hits AS (SELECT doc FROM idx WHERE word IN ('library', 'harbour') GROUP BY doc HAVING count(*) = (SELECT count(DISTINCT word) FROM idx WHERE word IN ('library', 'harbour'))),
heads AS (SELECT row_key AS doc, max({{'t': title, 'd': description, 'u': url}}) AS m FROM pt_processed GROUP BY row_key),
all_cand AS (SELECT h.doc, coalesce(r.rank, 0) AS rank FROM hits h LEFT JOIN ranks r ON h.doc = r.url_hash), {_DIVERSE if diverse else f"cand AS (SELECT * FROM all_cand ORDER BY rank DESC, doc LIMIT {candidates})"},
q AS (SELECT word, log10((SELECT count(DISTINCT doc) FROM tok)::DOUBLE / count(DISTINCT doc)) * CASE WHEN word = 'library' THEN {2 if twice else 1} ELSE 1 END AS q FROM idx WHERE word IN ('library', 'harbour') GROUP BY word),
tf AS (SELECT doc, sum(q.q * idx.doc_tf) AS tfidf FROM idx JOIN q ON idx.word = q.word GROUP BY doc),
near AS ({_NEAR.format(12)}), phr AS (SELECT doc, {'b' if phrase else 'NULL::STRUCT(p INTEGER, q INTEGER) AS b'}, {_PHRASE if phrase else '0.0::DOUBLE'} AS phrase FROM near),
parts AS (SELECT cand.doc, cand.rank, tf.tfidf, phr.b, coalesce(phr.phrase, 0)::DOUBLE AS phrase, heads.m.t AS title, heads.m.u AS url, {_TITLE_WORDS.format("coalesce(heads.m.t, '')", "coalesce(heads.m.d, '')")} AS tw FROM cand JOIN tf ON cand.doc = tf.doc LEFT JOIN heads ON cand.doc = heads.doc LEFT JOIN phr ON phr.doc = cand.doc),
titled AS (SELECT *, (CASE WHEN len(tw) = 0 THEN 0 ELSE len(list_intersect(tw, ['library', 'harbour'])) / len(tw) END)::DOUBLE AS title_score FROM parts),
scored AS (SELECT *, {terms} AS score FROM titled), top AS (SELECT * FROM scored ORDER BY score DESC, doc LIMIT 10 OFFSET {offset}),
told AS (SELECT top.*, coalesce(pages.text, '') AS text, {best} AS best FROM top LEFT JOIN pages ON top.doc = pages.row_key)
SELECT doc, {shown}, title, url, {_snippet("text", "best", 60)} AS snippet FROM told"""
    )


def oracle_sql() -> dict[str, str]:
    o = {}
    lang = "lower(substr(lang, 1, 2)) = '{}'"
    bag = "SELECT unnest(" + _WORDS.format("text") + ") AS value FROM documents WHERE text IS NOT NULL"
    o["bag_from_table"] = "SELECT title AS value FROM pt_processed WHERE title IS NOT NULL"
    o["bag_flatmap_tokens"] = bag
    o["bag_distinct"] = f"SELECT DISTINCT value FROM ({bag})"
    o["bag_union"] = f"{bag} AND {lang.format('fr')} UNION ALL {bag} AND {lang.format('es')}"
    o["bag_intersection"] = f"({bag} AND {lang.format('en')}) INTERSECT ({bag} AND {lang.format('de')})"
    o["bag_filter_contains"] = "SELECT text AS value FROM pt_processed WHERE contains(text, 'harbour')"
    o["bag_take"] = f"SELECT least(25, count(*)) AS n FROM ({bag})"
    o["bag_sample"] = "SELECT true AS as_asked"
    o["bag_flatmap_to_pair"] = "WITH w AS (SELECT unnest(" + _WORDS.format("text") + ") AS value FROM eval_items WHERE text IS NOT NULL) SELECT value AS key, CAST(length(value) AS VARCHAR) AS value FROM w UNION ALL SELECT substr(value, 1, 1), value FROM w"
    o["pair_flatmap_to_pair"] = "SELECT unnest(" + _WORDS.format("title") + ") AS key, row_key AS value FROM pt_processed WHERE title IS NOT NULL"
    o["bag_filter_even"] = "SELECT CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey % 2 = 0"
    o["bag_count"] = f"SELECT count(*) AS n FROM ({bag})"
    o["bag_map_partitions"] = "SELECT CAST(o_orderkey + 5 AS VARCHAR) AS value FROM orders"
    o["bag_groupby_first"] = f"SELECT substr(value, 1, 1) AS key, string_agg(value, ',' ORDER BY value) AS value FROM (SELECT DISTINCT value FROM ({bag})) GROUP BY 1"
    o["bag_fold_sum"] = "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem"
    o["pair_map_to_pair"] = "SELECT substr(p_name, 1, 1) AS key, p_name AS value FROM part"
    o["pair_foldbykey_sum"] = "SELECT event_type AS key, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events GROUP BY event_type"
    o["pair_foldbykey_ordered"] = "SELECT CAST(s_nationkey AS VARCHAR) AS key, string_agg('-' || s_name, '' ORDER BY s_name) AS value FROM supplier GROUP BY 1"
    o["pair_wordcount"] = f"SELECT value AS word, count(*) AS n FROM ({bag}) GROUP BY value"
    o["pair_groupby_values"] = _PAIRS + " SELECT key, string_agg(value, ',' ORDER BY value) AS value FROM a GROUP BY key"
    o["pair_join"] = "SELECT CAST(n_nationkey AS VARCHAR) AS key, c_name || ',' || n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey"
    o["pair_join_many"] = _PAIRS + " SELECT a.key, a.value || ',' || b.value AS value FROM a JOIN b ON a.key = b.key"
    o["pair_cogroup"] = _PAIRS + """, x AS (SELECT key, string_agg(value, ',' ORDER BY value) AS v FROM a GROUP BY key), y AS (SELECT key, string_agg(value, ',' ORDER BY value) AS v FROM b GROUP BY key)
SELECT coalesce(x.key, y.key) AS key, '[' || coalesce(x.v, '') || '],[' || coalesce(y.v, '') || ']' AS value FROM x FULL JOIN y ON x.key = y.key"""
    o["pair_intersection"] = "SELECT row_key AS key, col AS value FROM pt_outgoing INTERSECT SELECT col AS key, row_key AS value FROM pt_outgoing"
    o["pair_flatmap"] = "SELECT unnest(" + _WORDS.format("title") + ") AS value FROM pt_processed WHERE url IS NOT NULL AND title IS NOT NULL"
    o["kv_get_latest"] = _CELLS + " " + _LATEST.format("cells")
    o["kv_get_version"] = _CELLS + " " + _LATEST.format("(SELECT * FROM cells WHERE row_key = '7' AND version <= 5000)")
    o["kv_scan_range"] = _CELLS + " " + _LATEST.format("(SELECT * FROM cells WHERE row_key >= '20' AND row_key < '45')")
    o["kv_count"] = _CELLS + " SELECT count(DISTINCT row_key) AS n_rows FROM cells"
    o["kv_put"] = _CELLS + """, w AS (SELECT CAST(n_nationkey AS VARCHAR) AS row_key, 'nation' AS col, n_name AS value, coalesce((SELECT max(version) FROM cells c WHERE c.row_key = CAST(n_nationkey AS VARCHAR)), 0) + 1 AS version FROM nation),
u AS (SELECT * FROM cells UNION ALL SELECT * FROM w) """ + _LATEST.format("u")
    nations = "SELECT CAST(n_nationkey AS VARCHAR) AS row_key, 'nation' AS col, n_name AS value, coalesce((SELECT max(version) FROM cells c WHERE c.row_key = CAST(n_nationkey AS VARCHAR)), 0) + 1 AS version FROM nation"
    o["kv_put_where"] = _CELLS + f", held AS (SELECT max({{'c': col, 'v': value}}) AS m FROM ({_LATEST.format('cells')}) WHERE row_key = '7'), w AS (SELECT * FROM ({nations}) WHERE row_key IN (SELECT row_key FROM ({_LATEST.format('cells')}) JOIN held ON col = held.m.c AND value = held.m.v)), u AS (SELECT * FROM cells UNION ALL SELECT * FROM w) " + _LATEST.format("u")
    o["kv_put_rows"] = _CELLS + f", w AS ({nations}), u AS (SELECT * FROM cells WHERE row_key NOT IN (SELECT row_key FROM w) UNION ALL SELECT * FROM w) " + _LATEST.format("u")
    o["kv_get_cell"] = _CELLS + " SELECT arg_max(value, version) AS value FROM cells WHERE row_key = '7' AND col = 'click' GROUP BY row_key"
    o["kv_view_page"] = _CELLS + f""", l AS ({_LATEST.format('cells')}), ks AS (SELECT DISTINCT row_key FROM l WHERE row_key >= '3' ORDER BY row_key LIMIT 11),
nk AS (SELECT CASE WHEN count(*) = 11 THEN max(row_key) END AS next_key FROM ks)
SELECT l.row_key, string_agg(col || '=' || substr(value, 1, 1024), ';' ORDER BY col) AS cells, any_value(next_key) AS next_key FROM l, nk WHERE l.row_key IN (SELECT row_key FROM ks ORDER BY row_key LIMIT 10) GROUP BY l.row_key"""
    o["kv_diff"] = _CELLS + f""", a AS ({_LATEST.format('cells')}), b AS ({_LATEST.format("(SELECT * FROM cells WHERE col <> 'error' OR version % 2 = 0)")}),
x AS (SELECT row_key, string_agg(col || ':' || value, '|' ORDER BY col) AS s FROM a GROUP BY row_key), y AS (SELECT row_key, string_agg(col || ':' || value, '|' ORDER BY col) AS s FROM b GROUP BY row_key)
SELECT coalesce(x.row_key, y.row_key) AS row_key, CASE WHEN y.s IS NULL THEN 'left' WHEN x.s IS NULL THEN 'right' ELSE 'both' END AS side FROM x FULL JOIN y ON x.row_key = y.row_key WHERE x.s IS DISTINCT FROM y.s"""
    o["kv_sample_prefix3"] = "SELECT row_key FROM (SELECT row_key, row_number() OVER (PARTITION BY substr(row_key, 1, 3) ORDER BY row_key) AS n FROM (SELECT DISTINCT row_key FROM pt_crawl)) WHERE n <= 3"
    o["text_clean"] = rf"""SELECT row_key, title, trim(regexp_replace(regexp_replace(title, '[^\x00-\x7F]', ' ', 'g'), '\s+', ' ', 'g')) AS words, trim(regexp_replace(title, '[^\x00-\x7F]', '', 'g')) AS word, regexp_extract(title, {_CUT}, 0) AS head,
nullif(regexp_extract(title, '[0-9]+', 0), '') AS number, trim(regexp_replace(regexp_replace(title, '[^\p{{L}}\p{{N}}\s'']', ' ', 'g'), '\s+', ' ', 'g')) AS safe FROM (SELECT DISTINCT row_key, title FROM pt_processed WHERE title IS NOT NULL)"""
    o["text_title_case"] = "SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ') AS name FROM part"
    o["text_strip_html"] = f"SELECT row_key, {_LETTERS.format('page')} AS letters, coalesce(list_aggregate({_PAGE_WORDS.format('page')}, 'string_agg', ' '), '') AS words FROM (SELECT DISTINCT row_key, page FROM pt_crawl WHERE page IS NOT NULL)"
    o["text_metadata"] = f"""SELECT row_key, coalesce(nullif({_meta('property', 'og:title')}, ''), nullif(trim(regexp_extract(page, '(?i)<title>([^<]*)</title>', 1)), ''), nullif({_meta('name', 'description')}, ''), '') AS title,
lower(replace({_meta('property', 'og:description')}, chr(10), ' ')) AS description, coalesce({_icon('apple-touch-icon')}, {_icon('shortcut icon')}, {_icon('icon')}, url || '/favicon.ico') AS icon,
nullif(lower(regexp_extract(page, '(?i)<html[^>]*\\slang="([^"]*)"', 1)), '') AS language, {_meta('name', 'keywords')} AS keywords FROM (SELECT DISTINCT row_key, url, page FROM pt_crawl WHERE page IS NOT NULL)"""
    # The elements and patterns of the crawler's cleaning, in its order.
    hidden = "meta head noscript iframe embed object applet link base area map param track wbr".split()
    body = "page"
    for pattern, by in (
        ("(?s)<script.*?>.*?</script>", " "), ("(?s)<style.*?>.*?</style>", " "), ('on\\w+\\s*=\\s*"[^"]*"', " "), ("on\\w+\\s*=\\s*''[^'']*''", " "), ("(?s)<!--.*?-->", " "), ("(?s)<footer.*?>.*?</footer>", " "),
        ("(?s)" + "|".join(f"<{x}[^>]*>.*?</{x}>" for x in hidden), " "), (f"<({'|'.join(hidden)})[^>]*>", " "), ("(?i)<(div|p|h[1-6]|br)[^>]*>", "\n"), ("<[^>]*>", " "), ("[ \\t\\n\\x0B\\f\\r]+", " "),
        ("(?i)\\b(privacy policy|terms of service|about us)\\b", " "), ("[.,:;!?''’\"()\\-\\r\\n\\t]", " "), ("[^\\p{L}\\s]", " "),
    ):
        body = f"trim(regexp_replace({body}, '{pattern}', '{by}', 'g'))"
    blocks = "regexp_extract_all(page, '(?s)" + "|".join(f"<{x}.*?>.*?</{x}>" for x in ("p", "h1", "h2", "h3", "h4", "h5", "h6")) + "')"
    inner = f"coalesce(list_aggregate(list_transform({blocks}, lambda b: regexp_replace(regexp_replace(b, '(?s)^<.*?>', ''), '</(p|h[1-6])>$', '')), 'string_agg', ' '), '')"
    paragraphs = f"trim(regexp_replace(regexp_replace({inner}, '[^\\p{{L}}\\x0B\\f]', ' ', 'g'), ' +', ' ', 'g'))"
    o["text_body_letters"] = f"SELECT row_key, lower({body}) AS body, lower({paragraphs}) AS paragraphs FROM (SELECT DISTINCT row_key, page FROM pt_crawl WHERE page IS NOT NULL)"
    o["text_english_pages"] = """SELECT DISTINCT row_key FROM pt_crawl WHERE page IS NOT NULL AND regexp_matches(lower(regexp_extract(page, '(?i)<html[^>]*\\slang="([^"]*)"', 1)), '^en($|-)')"""
    images = """SELECT DISTINCT row_key, regexp_extract(tag, 'src\\s*=\\s*"([^"]*)"', 1) AS src, lower(regexp_extract(tag, 'alt\\s*=\\s*"([^"]*)"', 1)) AS alt FROM (SELECT row_key, unnest(regexp_extract_all(page, '(?i)(<img\\s[^>]*>)', 1)) AS tag FROM pt_crawl WHERE page IS NOT NULL) WHERE regexp_extract(tag, 'src\\s*=\\s*"([^"]*)"', 1) <> ''"""
    o["text_images"] = images
    triples = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    o["text_valid_words"] = f"SELECT DISTINCT value FROM ({bag}) WHERE length(value) > 2 AND regexp_matches(value, '^[A-Za-z]+$') AND NOT regexp_matches(value, '{triples}')"
    o["text_images_html"] = f"SELECT row_key, string_agg('<img src=\"' || src || '\">', '' ORDER BY src) AS html FROM (SELECT DISTINCT row_key, src FROM ({images})) GROUP BY row_key"
    place = "regexp_matches(text, '(^|[^A-Za-z]){0}($|[^A-Za-z])')"
    o["text_places"] = "SELECT row_key, places FROM (SELECT row_key, concat_ws(',', " + ", ".join(f"CASE WHEN {place.format(x)} THEN '{x}' END" for x in ("Library", "Museum", "Storage")) + ") AS places FROM (SELECT DISTINCT row_key, text FROM pt_processed WHERE text IS NOT NULL)) WHERE places <> ''"
    kinds = "CASE " + " ".join(f"WHEN contains(contenttype, '{a}') THEN '{b}'" for a, b in (("pdf", "PDF"), ("word", "DOC"), ("excel", "XLSX"), ("powerpoint", "PPT"), ("zip", "ZIP"), ("text/plain", "TXT"), ("xml", "XML"), ("json", "JSON"), ("csv", "CSV"), ("rtf", "RTF"))) + " END"
    o["text_file_titles"] = f"SELECT url, contenttype, {kinds} AS type, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.\\w+$', '') || coalesce(' ' || {kinds}, '') || ' from ' || coalesce(nullif(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), 'www.', ''), ''), 'unknown domain') AS name FROM (SELECT DISTINCT url, contenttype FROM pt_crawl)"
    o["text_scores"] = "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS sig, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)), 6) AS scaled FROM customer"
    o["url_hash"] = f"SELECT url, {_hash('url')} AS hash FROM (SELECT DISTINCT url FROM pt_crawl)"
    part = "nullif(regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/:?#]*)(?::([0-9]+))?(/.*)?$', {}), '')"
    o["url_parts"] = f"SELECT url, {_HOST.format('url')} AS host, {_TOP.format('url')} AS domain, regexp_extract(url, '^[^?#]*', 0) AS root, {part.format(1)} AS protocol, CAST({part.format(3)} AS INTEGER) AS port, {part.format(4)} AS path, {_CRAWLABLE.format('url')} AS crawlable, {_UNWANTED.format('url')} AS unwanted FROM (SELECT DISTINCT url FROM pt_crawl)"
    anchors = """WITH anchors AS (SELECT row_key, url, unnest(regexp_extract_all(page, '(?i)<a\\s+[^>]*href\\s*=\\s*[''"]?([^''"\\s>]+)[''"\\s>]', 1)) AS raw FROM pt_crawl WHERE page IS NOT NULL AND url IS NOT NULL)"""
    o["url_normalize_links"] = anchors + _normal("raw", "url", "anchors", "row_key, url") + " SELECT DISTINCT row_key, url, full_link AS link FROM norm"
    o["url_listed_links"] = _LISTED + f" SELECT DISTINCT row_key, url, full_link AS link FROM norm WHERE NOT {_UNWANTED.format('full_link')}"
    o["url_site_counts"] = f"SELECT {_TOP.format('url')} AS domain, count(DISTINCT row_key) AS pages FROM pt_crawl WHERE url IS NOT NULL GROUP BY 1"
    depth = "len(list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> ''))"
    o["url_depth"] = f"SELECT url, round(1 / (1 + exp(-0.5::DOUBLE * ({depth} - 8))), 6) AS share FROM (SELECT DISTINCT url FROM pt_crawl)"
    black = "NOT regexp_matches({0}, '^.*pelucott.*$') AND NOT regexp_matches({0}, '^https://www\\..*\\.test.*$')"
    o["url_blacklist"] = f"SELECT url FROM (SELECT DISTINCT url FROM pt_crawl) WHERE {black.format('url')}"
    ending = "regexp_extract(lower(url), '^[a-z]+://([^/:?#]*)', 1)"
    o["url_drop_shares"] = f"SELECT url, (CASE WHEN regexp_matches({ending}, '(edu|org|com|net)$') THEN 0.1 WHEN regexp_matches({ending}, '(gov|tv|io)$') THEN 0.3 ELSE 0.8 END)::DOUBLE AS share, len(ps) > 5 AND len(list_filter(ps, lambda x: regexp_matches(x, '^[a-zA-Z0-9]{{10,}}$'))) > 0 AS random FROM (SELECT DISTINCT url, string_split(regexp_extract(url, '^[A-Za-z]+://(.*)$', 1), '/') AS ps FROM pt_crawl)"
    robots = """WITH files AS (SELECT DISTINCT {0} AS key, robots FROM pt_hosts WHERE robots IS NOT NULL AND {0} IS NOT NULL), cut AS (SELECT key, robots, string_split(robots, chr(10)) AS ls FROM files),
rows AS (SELECT key, robots, split_part(unnest(ls), '#', 1) AS line, unnest(range(len(ls))) AS i FROM cut),
said AS (SELECT key, robots, i, lower(trim(split_part(line, ':', 1))) AS name, CASE WHEN contains(line, ':') THEN trim(substr(line, position(':' IN line) + 1)) ELSE '' END AS value FROM rows),
kept AS (SELECT *, name = 'user-agent' AS agent FROM said WHERE name IN ('user-agent', 'allow', 'disallow', 'crawl-delay')),
starts AS (SELECT *, agent AND NOT coalesce(lag(agent) OVER (PARTITION BY key, robots ORDER BY i), false) AS opens FROM kept),
grouped AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY key, robots ORDER BY i) AS g FROM starts),
rules AS (SELECT r.key, lower(a.value) AS agent, r.name AS action, r.value FROM grouped r JOIN grouped a ON r.key = a.key AND r.robots = a.robots AND r.g = a.g AND a.agent AND NOT r.agent WHERE r.value <> '')"""
    o["url_robots_rules"] = robots.format("row_key") + " SELECT key, agent, action, value FROM rules"
    o["url_robots_allowed"] = robots.format("host") + """, urls AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS key, nullif(regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/:?#]*)(?::([0-9]+))?(/.*)?$', 4), '') AS path FROM (SELECT DISTINCT url FROM pt_crawl)),
best AS (SELECT u.url, max(CASE WHEN action = 'allow' THEN length(value) END) AS a, max(CASE WHEN action = 'disallow' THEN length(value) END) AS d FROM urls u JOIN rules r ON u.key = r.key AND r.agent = '*' AND r.action IN ('allow', 'disallow') AND starts_with(u.path, r.value) GROUP BY u.url)
SELECT url FROM urls WHERE url NOT IN (SELECT url FROM best WHERE d IS NOT NULL AND (a IS NULL OR a < d))"""
    p = _TOK + ", post AS (SELECT word, doc, count(*) AS freq, min(pos) AS first_pos, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM tok GROUP BY word, doc)"
    o["idx_positions"] = p + " SELECT word, doc, positions FROM post"
    o["idx_posting_lists"] = p + """, listed AS (SELECT word, CAST(doc AS VARCHAR) AS doc, freq AS n, positions AS ps FROM post)
SELECT word, string_agg(doc || ':' || ps, ',' ORDER BY n DESC, split_part(ps, ' ', 1), doc) AS postings FROM listed GROUP BY word"""
    o["idx_posting_parts"] = p + " SELECT word, CAST(greatest(1, ceil(count(*) / 100)) AS INTEGER) AS parts, count(*) AS docs FROM post GROUP BY word"
    o["idx_word_documents"] = _TOK + " SELECT word, 0::INTEGER AS part, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc) AS list FROM tok GROUP BY word"
    o["idx_page_words"] = f"WITH p AS (SELECT row_key, {_PAGE_WORDS.format('page')} AS ws FROM (SELECT DISTINCT row_key, page FROM pt_crawl WHERE page IS NOT NULL)), x AS (SELECT row_key AS doc, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM p) SELECT word, doc, count(*) AS freq, CAST(min(pos) AS INTEGER) AS first_pos FROM x GROUP BY word, doc"
    o["idx_freq_first"] = p + " SELECT word, doc, freq, first_pos FROM post"
    o["idx_augmented_tf"] = _TOK + _INDEX + " SELECT word, doc, tf, round(doc_tf, 6) AS doc_tf, list_aggregate(list_transform(positions[1:19], lambda x: CAST(x AS VARCHAR)), 'string_agg', ' ') AS positions FROM idx"
    o["idx_served"] = _SERVED + _INDEX + " SELECT word, doc, tf, round(doc_tf, 6) AS doc_tf FROM idx"
    o["idx_df_idf"] = _TOK + " SELECT word, count(DISTINCT doc) AS df, round(log10((SELECT count(DISTINCT doc) FROM tok)::DOUBLE / count(DISTINCT doc)), 6) AS idf FROM tok GROUP BY word"
    o["idx_doclist"] = _TOK + " SELECT word, count(DISTINCT doc) AS docs, count(*) AS occurrences FROM tok GROUP BY word"
    o["idx_lemmatized"] = _TOK + """, known AS (SELECT word FROM tok GROUP BY word HAVING count(DISTINCT doc) >= 2), l AS (SELECT doc, CASE word WHEN 'libraries' THEN 'library' WHEN 'records' THEN 'record' ELSE word END AS word FROM tok WHERE word IN (SELECT word FROM known))
SELECT word, count(DISTINCT doc) AS docs, count(*) AS occurrences FROM l WHERE word NOT IN ('the', 'of', 'and', 'a') GROUP BY word"""
    img = rf"WITH img AS (SELECT DISTINCT p_partkey AS doc, '/i/' || CAST(p_partkey % 50 AS VARCHAR) || '.png' AS src, regexp_extract(w, {_CUT}, 0) AS word FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '\s+')) AS w FROM part) WHERE regexp_extract(w, {_CUT}, 0) <> '')"
    o["idx_image"] = img + " SELECT word, doc, string_agg(DISTINCT src, chr(10) ORDER BY src) AS images FROM img GROUP BY word, doc"
    o["idx_image_dictionary"] = f"WITH i AS ({images}), m AS (SELECT src, min({{'r': row_key, 'a': alt}}) AS m FROM i GROUP BY src) SELECT {_hash('src')} AS hash, src, m.a AS alt, m.r AS row_key FROM m"
    o["idx_places"] = "SELECT DISTINCT lpad(regexp_extract(ip, '([0-9]+)$', 1), 5, '1') AS zip, row_key FROM pt_crawl WHERE ip IS NOT NULL"
    ids = "WITH k AS (SELECT DISTINCT row_key AS key FROM pt_crawl WHERE row_key IS NOT NULL), n AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS number FROM k), ids AS (SELECT key, number, " + " || ".join(f"chr(CAST(97 + (number // {26**i}) % 26 AS INTEGER))" for i in range(5)) + " AS id FROM n)"
    o["id_dictionary"] = ids + " SELECT key, number, id FROM ids"
    o["idx_top_pages"] = "WITH heads AS (SELECT DISTINCT row_key, title FROM pt_processed), " + _tokens("heads", "row_key", "title") + _RANKS + ", wd AS (SELECT DISTINCT word, doc FROM tok), t AS (SELECT word, doc, row_number() OVER (PARTITION BY word ORDER BY rank DESC, doc) AS n FROM wd JOIN ranks ON doc = url_hash) SELECT word, CAST(n - 1 AS INTEGER) AS place, doc FROM t WHERE n <= 20"
    norm_all = anchors + _normal("raw", "url", "anchors", "row_key, url") + ", nl AS (SELECT row_key, string_agg(DISTINCT full_link, chr(10) ORDER BY full_link) AS links FROM norm GROUP BY row_key)"
    o["idx_processed_table"] = norm_all + ", m AS (" + o["text_metadata"] + ") SELECT DISTINCT m.row_key, c.url, m.title, m.description, nl.links FROM m JOIN pt_crawl c ON c.row_key = m.row_key AND c.page IS NOT NULL LEFT JOIN nl ON nl.row_key = m.row_key WHERE m.row_key NOT IN (SELECT row_key FROM pt_processed)"
    o["page_canonical"] = "WITH c AS (SELECT sha1(page) AS h, min({'u': url, 'k': row_key}) AS m FROM pt_crawl WHERE page IS NOT NULL GROUP BY 1) SELECT DISTINCT p.row_key, c.m.k AS canonical FROM pt_crawl p JOIN c ON sha1(p.page) = c.h WHERE p.page IS NOT NULL"
    plain = _TOK + _INDEX
    o["search_keyword"] = plain + " SELECT doc, CAST(least(tf, 19) AS INTEGER) AS hits, positions[1] AS first FROM idx WHERE word = 'library'"
    o["search_and"] = plain + " SELECT doc FROM idx WHERE word IN ('library', 'harbour', 'nosuchword') GROUP BY doc HAVING count(*) = (SELECT count(DISTINCT word) FROM idx WHERE word IN ('library', 'harbour', 'nosuchword'))"
    o["search_any"] = plain + " SELECT doc, count(*) AS matches FROM idx WHERE word IN ('library', 'harbour', 'turbine') GROUP BY doc"
    o["search_tfidf"] = plain + ", q AS (SELECT word, log10((SELECT count(DISTINCT doc) FROM idx)::DOUBLE / count(*)) AS q FROM idx WHERE word IN ('library', 'harbour') GROUP BY word) SELECT doc, round(sum(q.q * idx.doc_tf), 6) AS tfidf FROM idx JOIN q ON idx.word = q.word GROUP BY doc"
    o["search_normalized_tf"] = p + ", own AS (SELECT word, doc, freq FROM post WHERE word IN ('library', 'harbour')) SELECT word, doc, round(freq / sqrt(sum(freq * freq) OVER (PARTITION BY doc)), 6) AS weight FROM own"
    o["search_title_match"] = f"SELECT row_key, title, round(CASE WHEN len(tw) = 0 THEN 0 ELSE len(list_intersect(tw, ['library', 'harbour'])) / len(tw) END, 6) AS score FROM (SELECT row_key, title, {_TITLE_WORDS.format('title', 'description')} AS tw FROM (SELECT DISTINCT row_key, title, description FROM pt_processed))"
    gap = plain + ", a AS (SELECT doc, unnest(positions[1:19]) AS p FROM idx WHERE word = 'library'), b AS (SELECT doc, unnest(positions[1:19]) AS q FROM idx WHERE word = 'harbour'), g AS (SELECT a.doc, min(abs(p - q)) AS gap FROM a JOIN b ON a.doc = b.doc GROUP BY a.doc)"
    o["search_phrase_span"] = gap + " SELECT doc, gap FROM g"
    o["search_phrase"] = plain + f", near AS ({_NEAR.format(0)}) SELECT doc, CAST(abs(b.p - b.q) + 1 AS INTEGER) AS span, round({_PHRASE}, 6) AS phrase, CAST(b.p AS VARCHAR) || ' ' || CAST(b.q AS VARCHAR) AS best FROM near"
    o["search_snippet"] = _SERVED + _INDEX + ", placed AS (SELECT pages.row_key AS doc, pages.text, coalesce(idx.positions[1:19], []) AS best FROM pages LEFT JOIN idx ON idx.doc = pages.row_key AND idx.word = 'library') SELECT doc, " + _snippet("text", "best", 12) + " AS snippet FROM placed"
    o["search_cosine"] = plain + p.removeprefix(_TOK) + """, own AS (SELECT word, doc, freq / sqrt(sum(freq * freq) OVER (PARTITION BY doc)) AS w FROM post WHERE word IN ('library', 'harbour')),
q AS (SELECT word, log10((SELECT count(DISTINCT doc) FROM idx)::DOUBLE / count(*)) AS q FROM idx WHERE word IN ('library', 'harbour') GROUP BY word)
SELECT doc, round(sum(q.q * own.w) / (SELECT sqrt(sum(q * q)) FROM q), 6) AS cosine FROM own JOIN q ON own.word = q.word GROUP BY doc"""
    o["search_positions"] = plain + " SELECT doc, string_agg(word || ':' || list_aggregate(list_transform(positions[1:19], lambda x: CAST(x AS VARCHAR)), 'string_agg', ' '), ';' ORDER BY word) AS lists FROM idx WHERE word IN ('library', 'harbour') GROUP BY doc"
    o["search_details"] = "WITH r AS (SELECT DISTINCT url_hash FROM pt_pgrk WHERE rank IS NOT NULL AND url_hash IS NOT NULL), h AS (SELECT row_key, max(title) AS title, max(url) AS url FROM pt_processed GROUP BY row_key) SELECT r.url_hash, coalesce(h.title, '') AS title, coalesce(h.url, '') AS url FROM r LEFT JOIN h ON r.url_hash = h.row_key"
    o["search_v1"] = _score(True, (0.3, 0.1, 0.4, 0.2), candidates=100_000)
    o["search_v2"] = _score(True, (0.3, 0.1, 0.4, 0.2), candidates=100_000, twice=True, offset=10)
    o["search_combined"] = _score(False, (0.5, 1.0, 2.0))
    o["search_page"] = _score(True, (20, 0.5, 1.0, 2.0), offset=10)
    o["search_v4"] = _score(True, (0.3, 0.14, 0.4, 0.16), True)
    o["search_v5"] = _score(False, (0.14, 0.4, 0.16))
    o["search_snapshot"] = "SELECT url, arg_max(page, (fetched_at, page)) AS page FROM pt_crawl WHERE page IS NOT NULL AND url = (SELECT min(url) FROM pt_crawl WHERE page IS NOT NULL) GROUP BY url"
    o["search_key_page"] = "SELECT DISTINCT row_key FROM pt_crawl ORDER BY row_key LIMIT 10 OFFSET 20"
    o["search_rank_sorted"] = _SERVED + _RANKS + ", h AS (SELECT DISTINCT doc AS url_hash FROM tok WHERE word = 'library') SELECT h.url_hash, round(coalesce(rank, 0), 6) AS rank FROM h LEFT JOIN ranks r ON h.url_hash = r.url_hash ORDER BY coalesce(r.rank, 0) DESC, h.url_hash LIMIT 50"
    o["search_diverse_topk"] = f"""WITH u AS (SELECT row_key AS url_hash, min(url) AS url FROM pt_crawl GROUP BY row_key){_RANKS}, x AS (SELECT url, rank, {_TOP.format('url')} AS domain, regexp_extract(url, '^[^?#]*', 0) AS root FROM u JOIN ranks r ON u.url_hash = r.url_hash),
a AS (SELECT *, row_number() OVER (PARTITION BY domain, root ORDER BY rank DESC, url) AS n FROM x), b AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rank DESC, url) AS m FROM a WHERE n = 1) SELECT url, domain FROM b WHERE m <= 2 ORDER BY rank DESC, url LIMIT 30"""
    o["search_location"] = (
        _SERVED
        + _INDEX
        + f""", h AS (SELECT doc FROM idx WHERE word IN ('library', 'harbour') GROUP BY doc HAVING count(*) = (SELECT count(DISTINCT word) FROM idx WHERE word IN ('library', 'harbour'))), near AS ({_NEAR.format(12)}),
z AS (SELECT row_key AS doc, max(2 * CASE WHEN d = 0 THEN 1.0 WHEN d < 100 THEN 0.8 WHEN d < 500 THEN 0.6 WHEN d < 1000 THEN 0.4 WHEN d < 2000 THEN 0.2 ELSE 0.1 END) AS place FROM (SELECT row_key, abs(CAST(regexp_extract(ip, '([0-9]+)$', 1) AS INTEGER) - 100) AS d FROM pt_crawl WHERE ip IS NOT NULL) GROUP BY row_key)
SELECT h.doc, round(z.place::DOUBLE + coalesce({_PHRASE}, 0), 6) AS score, CASE WHEN b IS NULL THEN '' ELSE CAST(b.p AS VARCHAR) || ' ' || CAST(b.q AS VARCHAR) END AS best FROM h JOIN z ON h.doc = z.doc LEFT JOIN near ON near.doc = h.doc"""
    )
    o["search_image_list"] = o["idx_image"].replace(" FROM img GROUP", " FROM img WHERE word = 'widget' GROUP").replace("SELECT word, doc, string_agg", "SELECT doc, string_agg")
    o["search_image_and"] = img + ", ok AS (SELECT doc FROM img WHERE word IN ('small', 'widget') GROUP BY doc HAVING count(DISTINCT word) = 2) SELECT doc, count(DISTINCT src) AS hits FROM img WHERE word IN ('small', 'widget') AND doc IN (SELECT doc FROM ok) GROUP BY doc"
    o["search_image_fuzzy"] = img + " SELECT doc, count(DISTINCT word) AS hits FROM img WHERE word IN ('small', 'widget', 'red') GROUP BY doc"
    o["search_documents"] = "WITH pdf AS (SELECT * FROM documents WHERE source = 'pdf'), " + _tokens("pdf", "doc_id", "text") + ", h AS (SELECT doc FROM tok WHERE word IN ('library', 'harbour') GROUP BY doc HAVING count(DISTINCT word) = (SELECT count(DISTINCT word) FROM tok WHERE word IN ('library', 'harbour'))) SELECT h.doc, pdf.url, pdf.lang FROM h JOIN pdf ON h.doc = pdf.doc_id ORDER BY h.doc LIMIT 20"
    o["search_id_lookup"] = ids + " SELECT key AS row_key, id, (SELECT min(url) FROM pt_crawl c WHERE c.row_key = ids.key) AS url FROM ids"
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    o["search_ip_check"] = f"SELECT regexp_matches(ip, '^({octet}\\.){{3}}{octet}$') OR regexp_matches(ip, '^([0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$') AS valid, count(*) AS n FROM pt_crawl WHERE ip IS NOT NULL GROUP BY 1"
    o["graph_crawled_edges"] = _EDGES + " SELECT src, dst FROM edges WHERE dst IN (SELECT row_key FROM nodes)"
    o["graph_adjacency"] = _EDGES + " SELECT src AS node, string_agg(dst, chr(10) ORDER BY dst) AS neighbours FROM edges GROUP BY src"
    o["graph_incoming"] = _EDGES + " SELECT dst, count(*) AS incoming FROM edges GROUP BY dst"
    o["graph_sinks"] = _EDGES + " SELECT row_key FROM nodes WHERE row_key NOT IN (SELECT src FROM edges)"
    tags = """WITH tags AS (SELECT row_key, url, unnest(regexp_extract_all(page, '(?is)(<a\\s+[^>]*href\\s*=[^>]*>.*?</a>)', 1)) AS tag FROM pt_crawl WHERE page IS NOT NULL AND url IS NOT NULL),
raws AS (SELECT row_key, url, regexp_extract(tag, '(?i)<a\\s+[^>]*href\\s*=\\s*[''"]?([^''"\\s>]+)[''"\\s>]', 1) AS raw, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM tags)"""
    o["graph_anchor_text"] = tags + _normal("raw", "url", "raws", "row_key, text") + f", f AS (SELECT DISTINCT row_key, full_link, text FROM norm WHERE text <> '') SELECT {_hash('full_link')} AS dst, row_key AS src, string_agg(text, '<br>' ORDER BY text) AS text FROM f GROUP BY full_link, row_key"
    o["graph_pagerank"] = _rank_rounds(4) + " SELECT row_key, round(rank + 1e-9::DOUBLE, 6) AS rank FROM r4"
    many = 45
    chain = _rank_rounds(many).replace(" AS (SELECT r.row_key", " AS MATERIALIZED (SELECT r.row_key").replace("w AS (SELECT e.src", "w AS MATERIALIZED (SELECT e.src") + ", every AS (" + " UNION ALL ".join(f"SELECT {k} AS k, row_key, rank, prev FROM r{k}" for k in range(1, many + 1)) + ")"
    last = " SELECT row_key, round(rank + 1e-9::DOUBLE, 5) AS rank FROM every WHERE k = (SELECT k FROM stop)"
    o["graph_pagerank_converged"] = chain + ", stop AS (SELECT min(k) AS k FROM (SELECT k, max(abs(rank - prev)) AS m FROM every GROUP BY k) WHERE m < 0.01)" + last
    o["graph_pagerank_sticky"] = chain + ", stop AS (SELECT max(f) AS k FROM (SELECT row_key, min(k) FILTER (WHERE abs(rank - prev) <= 0.1) AS f FROM every GROUP BY row_key))" + last
    o["graph_pagerank_domain_penalty"] = (
        _rank_rounds(
            3,
            f", dom AS (SELECT row_key, {_TOP.format('min(url)')} AS domain FROM pt_crawl GROUP BY row_key), idle AS (SELECT row_key FROM nodes WHERE row_key NOT IN (SELECT src FROM edges))",
            "0.85 / d.degree * CASE WHEN x.domain = y.domain THEN 0.3 ELSE 1 END",
            " LEFT JOIN dom x ON e.src = x.row_key LEFT JOIN dom y ON e.dst = y.row_key WHERE e.src <> e.dst",
            "0.15 + 0.85 * coalesce((SELECT sum(rank) FROM r{0} WHERE row_key IN (SELECT row_key FROM idle)), 0) / (SELECT count(*) FROM nodes)",
        )
        + " SELECT row_key, round(rank + 1e-9::DOUBLE, 6) AS rank FROM r3"
    )
    sources = "(SELECT row_key FROM nodes WHERE row_key NOT IN (SELECT dst FROM edges))"
    o["graph_pagerank_without_sources"] = (
        _rank_rounds(2, base=f"0.15 + 0.85 * 0.85 * (SELECT count(*) FROM {sources})").replace("r0 AS (SELECT row_key, 1.0::DOUBLE AS rank FROM nodes)", f"r0 AS (SELECT row_key, 1.0::DOUBLE AS rank FROM nodes WHERE row_key NOT IN {sources})")
        + " SELECT row_key, round(rank + 1e-9::DOUBLE, 6) AS rank FROM r2"
    )
    o["graph_converged_share"] = _rank_rounds(1) + " SELECT round(avg(CASE WHEN abs(rank - prev) < 0.5 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS percent FROM r1"
    o["graph_rank_histogram"] = "SELECT floor(rank * 100) / 100 AS bin, count(*) AS pages FROM pt_pgrk WHERE rank IS NOT NULL GROUP BY 1"
    o["graph_join_ranks"] = "WITH k AS (SELECT DISTINCT row_key AS url_hash FROM pt_crawl)" + _RANKS + " SELECT k.url_hash, coalesce(r.rank, 0) AS rank FROM k LEFT JOIN ranks r ON k.url_hash = r.url_hash"
    prefix = "CASE " + " ".join(f"WHEN substr(word, 1, {n}) = substr('{{0}}', 1, {n}) THEN {n}" for n in range(6, 0, -1)) + " ELSE 0 END"
    near = "(SELECT word, CAST(levenshtein(word, '{0}') AS INTEGER) AS distance FROM (SELECT DISTINCT word FROM tok) WHERE abs(length(word) - {2}) <= {1} AND levenshtein(word, '{0}') <= {1} ORDER BY distance, " + prefix + " DESC, abs(length(word) - {2}), word LIMIT {3})"
    o["suggest_prefix"] = _TOK + " SELECT DISTINCT word FROM tok WHERE starts_with(word, 'li') ORDER BY word LIMIT 20"
    o["suggest_fuzzy"] = _TOK + f" SELECT word, distance FROM {near.format('libary', 2, 6, 10)}"
    o["suggest_correct"] = _TOK + f" SELECT 0::INTEGER AS position, 'libary' AS typed, word FROM {near.format('libary', 1, 6, 5)} UNION ALL SELECT 1::INTEGER, 'harbor', word FROM {near.format('harbor', 1, 6, 5)}"
    o["suggest_last"] = _TOK + f" SELECT 'the ' || word AS suggestion, distance FROM {near.format('harbor', 2, 6, 5)}"
    o["suggest_query"] = _TOK + f" SELECT coalesce((SELECT word FROM {near.format('libary', 1, 6, 1)}), 'libary') || ' of ' || coalesce((SELECT word FROM {near.format('harbor', 1, 6, 1)}), 'harbor') || ' 42' AS corrected"
    o["suggest_exists"] = _TOK + " SELECT x AS word, x IN (SELECT word FROM tok) AS known, (SELECT count(*) FROM tok WHERE starts_with(tok.word, x)) > 0 AS begins FROM (VALUES ('library'), ('libary'), ('li'), ('qqq')) v(x)"
    grams = _TOK + ", g AS (SELECT doc, word, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c FROM tok WINDOW w AS (PARTITION BY doc ORDER BY pos))"
    o["ngram_next"] = grams + " SELECT word || ' ' || b AS gram, c AS next, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY 1, 2"
    o["ngram_followers"] = grams + " SELECT DISTINCT b AS next FROM g WHERE word = 'library' AND b IS NOT NULL"
    o["suggest_letters"] = _TOK + " SELECT substr(word, 3, 1) AS next, count(*) AS n FROM (SELECT DISTINCT word FROM tok WHERE starts_with(word, 'li') AND length(word) > 2) GROUP BY 1"
    o["letter_next"] = _TOK + ", v AS (SELECT DISTINCT word FROM tok WHERE length(word) > 2), x AS (SELECT word, unnest(range(1, length(word) - 1)) AS i FROM v) SELECT substr(word, i, 2) AS gram, substr(word, i + 2, 1) AS next, count(*) AS n FROM x GROUP BY 1, 2"
    o["crawl_frontier_step"] = (
        _LISTED
        + f""", u AS (SELECT DISTINCT full_link AS url FROM norm), c AS (SELECT url, lower({_HOST.format('url')}) AS host FROM u WHERE {_CRAWLABLE.format('url')} AND {black.format('url')}
 AND {_hash('url')} NOT IN (SELECT row_key FROM pt_crawl) AND {_TOP.format('url')} IN (SELECT {_TOP.format('url')} FROM pt_crawl WHERE responsecode = '200')),
hs AS (SELECT host, max(last_access) AS la, max(crawl_delay) AS cd FROM pt_hosts WHERE host IS NOT NULL GROUP BY host)
SELECT c.url, c.host, (hs.la IS NULL OR hs.la + to_microseconds(CAST(round(greatest(coalesce(hs.cd, 0), 1) * 1000000) AS BIGINT)) <= TIMESTAMP '2024-06-01 00:00:00') AND row_number() OVER (PARTITION BY c.host ORDER BY c.url) = 1 AS fetch FROM c LEFT JOIN hs ON c.host = hs.host"""
    )
    o["crawl_loop"] = (
        f"""WITH RECURSIVE seeds AS (SELECT min(url) AS url FROM pt_crawl GROUP BY {_HOST.format('url')}), h AS (SELECT url, max({{'f': fetched_at, 'r': responsecode, 'c': contenttype, 'p': page}}) AS m FROM pt_crawl GROUP BY url),
anchors AS (SELECT url, unnest(regexp_extract_all(m.p, '(?i)<a\\s+[^>]*href\\s*=\\s*[''"]?([^''"\\s>]+)[''"\\s>]', 1)) AS raw FROM h WHERE m.r = '200' AND m.p IS NOT NULL)"""
        + _normal("raw", "url", "anchors", "url")
        + f""", edges AS (SELECT DISTINCT url AS src, full_link AS dst FROM norm WHERE NOT {_UNWANTED.format('full_link')} AND {_CRAWLABLE.format('full_link')} AND {_TOP.format('full_link')} IN (SELECT {_TOP.format('url')} FROM seeds)),
reach AS (SELECT url FROM seeds WHERE {_CRAWLABLE.format('url')} UNION SELECT dst FROM reach JOIN edges ON src = reach.url) SELECT reach.url, coalesce(h.m.r, '404') AS responsecode FROM reach LEFT JOIN h ON reach.url = h.url"""
    )
    o["crawl_fetch_table"] = _LISTED + ", u AS (SELECT DISTINCT full_link AS url FROM norm), h AS (SELECT url, max({'f': fetched_at, 'r': responsecode, 'c': contenttype, 'p': page}) AS m FROM pt_crawl GROUP BY url) SELECT coalesce(h.m.r, '404') AS responsecode, count(*) AS n FROM u LEFT JOIN h ON u.url = h.url GROUP BY 1"
    return o
