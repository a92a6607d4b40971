"""The same queries as one SQL text each, for DuckDB over the same tables."""

from __future__ import annotations

import re

from checks import fixed as K
from checks.views import AS_OF_TEXT, BLOCK, DAY_LIMIT, FUTURES, INDUSTRIES, PREFERRED, WORDS

AS_OF = f"TIMESTAMP '{AS_OF_TEXT}'"


def q(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(x) for x in row) + ")" for row in rows) + ")"


# --- views -------------------------------------------------------------------------

VIEWS: dict[str, str] = {
    "v_sources": """
        SELECT n AS id, n % 4 AS industry_id, source AS name, 'https://' || source || '.example/' AS url,
               n % 12 AS weight,
               CASE n % 5 WHEN 1 THEN '+the !token tion' WHEN 2 THEN '!license'
                          WHEN 3 THEN 'tion ment ung' WHEN 4 THEN '+de la' END AS keywords
        FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '[0-9]+') AS INT) AS n FROM documents)""",
    "v_industries": f"SELECT * FROM {values(INDUSTRIES)} t(id, name, top_n, keywords)",
    "v_articles": f"""
        SELECT doc_id, lang, CAST(regexp_extract(source, '[0-9]+') AS INT) AS source_id,
               split_part(text, chr(10), 1) AS title,
               'https://' || source || '.example/doc/' || doc_id AS url,
               CASE WHEN length(text) > 140 THEN substr(text, 1, 140) || '...' ELSE text END AS summary,
               {AS_OF} - to_minutes(30 * CAST(CASE WHEN doc_id % 60 = 0 THEN -1 ELSE doc_id % 60 END AS INT))
                 AS published_at
        FROM documents""",
    "v_seen": f"""
        SELECT url, title, CASE WHEN doc_id % 35 <> 0 THEN source_id END AS source_id,
               {AS_OF} - to_days(CAST(doc_id % 15 AS INT)) AS first_seen_at
        FROM v_articles WHERE doc_id % 7 = 0""",
    "v_pages": f"""
        SELECT page_id, url, CAST(page_id % 20 AS INT) AS source_id, page_id % 10 <> 9 AS fetch_ok,
               CASE WHEN contains(html, '</body>') THEN replace(html, '</body>', own || '</body>')
                    ELSE html || own END AS html
        FROM (SELECT *, {q(BLOCK)} || '<a href="' || url || '">Story number ' || page_id || '</a></div>' AS own
              FROM pages)""",
    "v_fetched": """
        SELECT page_id, html,
               CASE page_id % 10 WHEN 6 THEN 'timeout' WHEN 7 THEN 'http' WHEN 8 THEN 'other' ELSE 'ok' END AS outcome,
               CASE WHEN page_id % 20 = 7 THEN 404 ELSE 503 END AS http_status,
               html AS message
        FROM pages""",
    "v_vectors": """
        SELECT e.vec_id, e.label, CASE WHEN b.vec_id IS NULL THEN e.embedding::DOUBLE[]
                 ELSE list_transform(b.embedding::DOUBLE[], lambda x, i: CASE WHEN i = 1 THEN x + 0.3 ELSE x END)
               END AS embedding
        FROM embeddings e LEFT JOIN embeddings b ON b.vec_id = e.vec_id - 1 AND e.vec_id % 4 = 1""",
    "v_snapshot": """
        SELECT CASE p_partkey % 3 WHEN 0 THEN 'cn' WHEN 1 THEN 'hk' ELSE 'global' END AS market, p_partkey AS pos,
               CAST(CASE WHEN p_partkey % 10 = 3 THEN p_partkey - 3 ELSE p_partkey END AS VARCHAR) AS code,
               p_name AS name,
               CASE WHEN p_partkey % 97 = 0 THEN 0.0 WHEN p_partkey % 89 = 0 THEN 'nan'::DOUBLE
                    ELSE p_retailprice END AS last,
               CASE WHEN p_partkey % 53 = 0 THEN '-'
                    ELSE printf('%.1f', (p_size - 25) / 10.0::DOUBLE) || CASE WHEN p_size % 2 = 0 THEN '%' ELSE '' END
               END AS change_pct
        FROM part""",
    "v_items": f"""
        SELECT p_partkey AS item_pos, CAST((p_partkey // 20) % 4 AS INT) AS industry_id,
               CASE WHEN (p_partkey // 20) % 5 = 0 THEN '' ELSE 'item ' || p_partkey END AS name,
               CAST(CASE WHEN (p_partkey // 20) % 7 = 0 THEN p_partkey + 1000000000 ELSE p_partkey END AS VARCHAR)
                 AS symbol,
               CASE p_partkey % 3 WHEN 0 THEN 'stock' WHEN 1 THEN 'stock_hk' ELSE 'futures' END AS item_type
        FROM part
        UNION ALL
        SELECT a::BIGINT, b, c, d, 'futures' FROM {values(FUTURES)} t(a, b, c, d)""",
    "v_checks": """
        SELECT event_id AS check_id, user_id AS source_id, ts AS checked_at,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'healthy' END AS status,
               CASE WHEN event_type = 'error' THEN 'HTTP ' || (500 + event_id % 4) END AS error
        FROM events""",
    "v_check_sources": """
        SELECT c_custkey AS id, c_name AS name, 'https://' || c_custkey || '.example/' AS url,
               'old' AS link_selector FROM customer""",
    "v_push_log": f"""
        SELECT event_id AS id, CAST(user_id % 10 AS INT) AS industry_id,
               CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'evening' END AS push_type,
               CASE WHEN event_type = 'error' THEN 'failed'
                    WHEN event_type IN ('signup', 'purchase') THEN 'skipped' ELSE 'success' END AS status,
               CASE event_type WHEN 'error' THEN 'error ' || event_id || ' ' || repeat('x', event_id % 700)
                    WHEN 'signup' THEN '{K.NO_RECIPIENTS}' WHEN 'purchase' THEN '{K.NO_NEWS}' END AS error_msg,
               CASE WHEN event_type NOT IN ('error', 'signup', 'purchase') THEN '<html>' || event_id END
                 AS html_snapshot,
               ts - to_days(CAST(event_id % 10 AS INT)) AS created_at
        FROM events""",
    "v_schedules": """
        SELECT c_custkey AS id, c_nationkey AS industry_id,
               CASE WHEN c_custkey % 2 = 0 THEN 'morning' ELSE 'evening' END AS push_type,
               CASE WHEN c_custkey % 24 <> 5 THEN c_custkey % 24 END AS hour,
               CASE WHEN c_custkey % 7 <> 3 THEN c_custkey % 60 END AS minute,
               c_custkey % 3 <> 0 AS enabled
        FROM customer""",
    "v_recipients": """
        SELECT c_custkey AS id, CAST(c_nationkey % 5 AS INT) AS industry_id,
               'c' || c_custkey || '@example.com' AS email
        FROM customer WHERE c_nationkey % 5 <> 2""",
    "v_smtp": """
        SELECT s_suppkey AS id, 'mail' || s_suppkey || '.example.com' AS host,
               'u' || s_suppkey || '@example.com' AS username,
               CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'c' || s_suppkey || '@example.com' END AS contact_email,
               CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'gAAAAA' || s_suppkey
                    ELSE 'secret-' || s_suppkey END AS password
        FROM supplier""",
    "v_urls": """
        SELECT page_id, CASE page_id % 12
            WHEN 0 THEN url WHEN 1 THEN 'file:///data/' || page_id WHEN 2 THEN 'ftp://example.com/' || page_id
            WHEN 3 THEN 'http:///feed/' || page_id WHEN 4 THEN 'http://10.0.0.' || (page_id % 256) || '/x'
            WHEN 5 THEN 'http://172.' || (page_id % 40) || '.0.1/x'
            WHEN 6 THEN 'https://8.8.8.' || (page_id % 256) || ':8443/x'
            WHEN 7 THEN 'http://[::1]/x' || page_id WHEN 8 THEN 'http://[fd00::' || (page_id % 10) || ']/x'
            WHEN 9 THEN 'http://[2001:db8::1]/' || page_id
            WHEN 10 THEN 'https://user:pw@' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/p'
            ELSE 'HTTP://192.168.1.' || (page_id % 256) || '/x' END AS url
        FROM pages""",
    "v_resolved": """
        SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
               CASE WHEN page_id % 9 = 0 THEN '10.1.2.3' ELSE '93.184.216.34' END AS ip
        FROM pages WHERE page_id % 3 <> 2""",
    "v_answers": """
        SELECT conv_id, turn,
               CASE conv_id % 5 WHEN 1 THEN 'News: ' || barred WHEN 2 THEN '摘要：本文 ' || barred
                    WHEN 3 THEN replace(barred, '. ', '.' || chr(10)) ELSE barred END AS answer,
               CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, 'Original ' || conv_id AS original
        FROM (SELECT *, CASE WHEN conv_id % 3 = 0 AND contains(text, '. ')
                    THEN substr(text, 1, strpos(text, '. ') - 1) || '|' || substr(text, strpos(text, '. ') + 2)
                    ELSE text END AS barred
              FROM conversations WHERE role = 'assistant')""",
    "v_kwmap": "SELECT * FROM " + values(
        [(p, i, w) for p, ws in WORDS.items() for i, w in enumerate(ws)]
    ) + " t(prefix, word_pos, word)",
}


def words(column: str) -> str:
    """Keyword lists of a text column as three list columns."""
    toks = f"list_filter(regexp_split_to_array(coalesce({column}, ''), '\\s+'), lambda w: w <> '')"
    return f"""
        list_transform(list_filter({toks}, lambda w: w[1] = '+'), lambda w: lower(w[2:])) AS must,
        list_transform(list_filter({toks}, lambda w: w[1] = '!'), lambda w: lower(w[2:])) AS must_not,
        list_transform(list_filter({toks}, lambda w: w[1] <> '+' AND w[1] <> '!'), lambda w: lower(w)) AS bonus"""


VIEWS["v_source_words"] = f"SELECT *, {words('keywords')} FROM v_sources"
VIEWS["v_industry_words"] = f"SELECT *, {words('keywords')} FROM v_industries"


def judged(articles: str, out: str = "judged") -> dict[str, str]:
    """Articles with both keyword verdicts and the partial scores."""
    return {
        out: f"""
        SELECT a.*, s.industry_id, s.name AS source_name, i.name AS industry_name, i.top_n,
               NOT list_bool_or(list_append(list_transform(i.must_not, lambda w: contains(ctext, w)), false))
                 AND (len(i.must) = 0
                      OR list_bool_or(list_transform(i.must, lambda w: contains(ctext, w)))) AS industry_ok,
               CASE WHEN list_bool_and(list_append(list_transform(s.must, lambda w: contains(ltitle, w)), true))
                     AND NOT list_bool_or(list_append(list_transform(s.must_not, lambda w: contains(ltitle, w)), false))
                    THEN CASE WHEN len(s.bonus) > 0
                              THEN len(list_filter(s.bonus, lambda w: contains(ltitle, w))) / len(s.bonus)
                              ELSE 0.5::DOUBLE END END AS kw,
               greatest(0.0::DOUBLE, 1.0::DOUBLE
                 - ((epoch_us({AS_OF}) - epoch_us(published_at)) / 3.6e9::DOUBLE) / 24.0::DOUBLE) AS tm,
               greatest(0.1::DOUBLE, least(1.0::DOUBLE, s.weight / 10.0::DOUBLE)) AS wt
        FROM (SELECT *, lower(title) AS ltitle, lower(title || ' ' || summary) AS ctext FROM {articles}) a
        JOIN v_source_words s ON s.id = a.source_id
        JOIN v_industry_words i ON i.id = s.industry_id""",
        "scored": f"""
        SELECT *, tm * 0.4::DOUBLE + wt * 0.3::DOUBLE + kw * 0.3::DOUBLE AS score
        FROM {out} WHERE industry_ok AND kw IS NOT NULL""",
    }


VIEWS.update(judged("v_articles"))
VIEWS["topped"] = """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY industry_id
                                                    ORDER BY score DESC, source_id, doc_id) AS rank FROM scored)
        WHERE rank <= top_n"""

# --- pages -------------------------------------------------------------------------

BLANKS = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160) || chr(12288))"
ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""


def code_free(html: str) -> str:
    for tag in ("script", "style"):
        html = f"regexp_replace({html}, '(?is)<{tag}[\\s>].*?</{tag}\\s*>', '', 'g')"
    return html


def no_comments(html: str) -> str:
    return code_free(f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')")


def decoded(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', {q(char)})"
    return text


def text_of(html: str) -> str:
    nodes = f"string_split(regexp_replace(replace({html}, '&nbsp;', chr(160)), '<[^>]*>', chr(1), 'g'), chr(1))"
    return decoded(f"array_to_string(list_transform({nodes}, lambda t: trim(t, {BLANKS})), '')")


def pieces(html: str, tag: str) -> str:
    return f"string_split(regexp_replace({html}, '(?i)<{tag}([\\s>/])', chr(1) || '<{tag}\\1', 'g'), chr(1))[2:]"


def attribute(name: str) -> str:
    pattern = rf"""(?i)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    value = f"regexp_extract(attrs, {q(pattern)}, 1)"
    return decoded(f"regexp_replace({value}, '^[\"'']|[\"'']$', '', 'g')")


def links(pages: str, scope: str = "clean") -> dict[str, str]:
    open_a = f"^<[aA]({ATTRS})>"
    return {
        "l_clean": f"SELECT *, {no_comments('html')} AS clean FROM {pages}",
        "l_cut": f"SELECT page_id, source_id, fetch_ok, url AS base, {pieces(scope, 'a')} AS cut FROM l_clean",
        "l_piece": """SELECT page_id, source_id, fetch_ok, base, unnest(cut) AS piece,
                             generate_subscripts(cut, 1) - 1 AS pos FROM l_cut""",
        "l_attr": f"""
            SELECT *, regexp_extract(piece, {q(open_a)}, 1) AS attrs,
                   regexp_replace(regexp_replace(piece, {q(open_a)}, ''), '(?is)</a[\\s>].*$', '') AS inner_html
            FROM l_piece""",
        "l_href": f"""
            SELECT *, trim({attribute('href')}, {BLANKS}) AS href, trim({attribute('title')}, {BLANKS}) AS title_attr,
                   {text_of('inner_html')} AS link_text,
                   regexp_extract(base, '^([a-z]+)://', 1) AS scheme,
                   regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) AS site,
                   regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS base_path
            FROM l_attr""",
        "l_url": """
            SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
                           WHEN href LIKE '//%' THEN scheme || ':' || href
                           WHEN href LIKE '/%' THEN site || href
                           WHEN href LIKE '?%' THEN site || base_path || href
                           WHEN href LIKE '../%' THEN site || CASE WHEN regexp_replace(base_path, '[^/]*/[^/]*$', '') = ''
                                THEN '/' ELSE regexp_replace(base_path, '[^/]*/[^/]*$', '') END || substr(href, 4)
                           ELSE site || regexp_replace(base_path, '[^/]*$', '') || href END AS url
            FROM l_href WHERE href <> '' AND href NOT LIKE '#%' AND href NOT LIKE 'javascript:%'""",
        "l_path": """
            SELECT *, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
                   CASE WHEN link_text <> '' THEN link_text ELSE title_attr END AS title
            FROM l_url WHERE regexp_matches(url, '^(?i:https?):')""",
        "l_first": """
            SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS nth
            FROM l_path WHERE length(path) >= 5""",
        "links": """SELECT page_id, source_id, fetch_ok, CAST(pos AS INT) AS pos, title, url
                    FROM l_first WHERE nth = 1 AND length(title) >= 4""",
    }


VIEWS["raw_pages"] = "SELECT *, 0 AS source_id, true AS fetch_ok FROM pages"


def scoped(pattern: str) -> str:
    return f"array_to_string(regexp_extract_all(clean, {q(pattern)}), '')"


def texts(pages: str) -> dict[str, str]:
    def noise(html: str, tags) -> str:
        for tag in tags:
            html = f"regexp_replace({html}, '(?is)<{tag}[\\s>/].*?</{tag}\\s*>', '', 'g')"
        return html

    inner = f"""CASE WHEN regexp_matches(clean, '(?i)<article[\\s>]')
        THEN regexp_replace(regexp_extract(clean, '(?is)<article(?:\\s[^>]*)?>(.*)$', 1), '(?is)</article[\\s>].*$', '')
        ELSE clean END"""

    def paras(html: str) -> str:
        start = q(f"^<[pP]{ATTRS}>")
        body = f"regexp_replace(regexp_replace(p, {start}, ''), '(?is)</p[\\s>].*$', '')"
        return f"list_transform({pieces(html, 'p')}, lambda p: {text_of(body)})"

    return {
        "t_clean": f"SELECT *, {no_comments('html')} AS clean FROM {pages}",
        "t_area": f"SELECT *, {inner} AS area FROM t_clean",
        "t_cut": f"""SELECT *, {noise('area', K.SUMMARY_NOISE)} AS area_s, {noise('area', K.ARTICLE_NOISE)} AS area_a
                     FROM t_area""",
        "t_paras": f"SELECT *, {paras('area_s')} AS ps, {paras('area_a')} AS pa FROM t_cut",
    }


def fault(text: str, for_summary: bool) -> str:
    shortest = K.SUMMARY_MIN_PARAGRAPH if for_summary else K.ARTICLE_MIN_PARAGRAPH
    phrases = K.SUMMARY_PHRASES if for_summary else K.ARTICLE_PHRASES
    bars = f"length({text}) - length(replace({text}, '|', '')) >= 3"
    if not for_summary:
        bars += f" OR length({text}) - length(replace({text}, '>>', '')) >= 4"
    digits = "" if for_summary else (
        f" WHEN regexp_matches(regexp_replace({text}, '[ .,]', '', 'g'), '^\\d+$') THEN 'digits'"
    )
    return (
        f"CASE WHEN length({text}) < {shortest} THEN 'short'"
        f" WHEN regexp_matches({text}, '{'|'.join(phrases)}') THEN 'phrase'"
        f" WHEN {bars} THEN 'links'{digits} ELSE 'kept' END"
    )


SUMMARY = f"""(SELECT CASE WHEN length(s) > 140 THEN substr(s, 1, 140) || '...' ELSE s END FROM (SELECT list_reduce(
    list_filter(ps, lambda p: {fault('p', True)} = 'kept'),
    lambda done, p: CASE WHEN length(done) >= 140 THEN done ELSE done || p END, '') AS s))"""
ARTICLE = f"array_to_string(list_filter(pa, lambda p: {fault('p', False)} = 'kept'), chr(10) || chr(10))"

# --- greedy deduplication ----------------------------------------------------------


def greedy(edges: str) -> dict[str, str]:
    """Vertices with an edge, walked in order, against the list of those kept."""
    return {
        "edges": edges,
        "verts": """
            SELECT id, row_number() OVER (ORDER BY id) AS rn,
                   coalesce((SELECT list(e.a) FROM edges e WHERE e.b = v.id), []) AS prev
            FROM (SELECT a AS id FROM edges UNION SELECT b FROM edges) v""",
        "walk": """
            SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept
            UNION ALL
            SELECT v.rn, CASE WHEN list_has_any(kept, v.prev) THEN kept ELSE list_append(kept, v.id) END
            FROM walk w JOIN verts v ON v.rn = w.rn + 1""",
        "gone": """SELECT id FROM verts WHERE NOT list_contains((SELECT kept FROM walk ORDER BY rn DESC LIMIT 1), id)""",
    }


GRAMS = """list_distinct(list_transform(range(1, greatest(length(title) - 2, 1) + 1),
    lambda i: substr(lower(title), i, 3)))"""


def title_edges(source: str, threshold: float, scope: str = "0") -> str:
    """`source` has id (input order), title; pairs similar enough inside one scope."""
    return f"""
        SELECT a, b FROM (
            SELECT x.id AS a, y.id AS b, len(list_intersect(x.g, y.g)) AS c, len(x.g) AS nx, len(y.g) AS ny
            FROM (SELECT *, {GRAMS} AS g, {scope} AS scope FROM {source}) x
            JOIN (SELECT *, {GRAMS} AS g, {scope} AS scope FROM {source}) y
              ON x.id < y.id AND x.scope = y.scope
             AND least(len(x.g), len(y.g)) >= {threshold} * greatest(len(x.g), len(y.g)))
        WHERE c / (nx + ny - c) >= {threshold}"""


FIRST_TITLES = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY source_id, doc_id) AS nth FROM v_articles)
    WHERE nth = 1"""
NUMBERED = "SELECT *, row_number() OVER (ORDER BY source_id, doc_id) AS id FROM first_titles"

# --- quotes ------------------------------------------------------------------------

VIEWS["first_code"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, code ORDER BY pos) AS nth FROM v_snapshot)
    WHERE nth = 1"""
VIEWS["futures_match"] = f"""
    SELECT * FROM (
        SELECT m.*, row_number() OVER (PARTITION BY item_pos ORDER BY how, word_pos, plain, pos) AS nth
        FROM (
            SELECT i.*, 'code' AS method, 0 AS how, 0 AS word_pos, 0 AS plain, s.pos, s.name AS found_name,
                   s.last, s.change_pct
            FROM v_items i JOIN v_snapshot s ON s.market = 'global' AND s.code = upper(i.symbol)
            WHERE item_type = 'futures'
            UNION ALL
            SELECT i.*, 'name', 1, k.word_pos, CASE WHEN contains(s.name, '{PREFERRED}') THEN 0 ELSE 1 END,
                   s.pos, s.name, s.last, s.change_pct
            FROM v_items i JOIN v_kwmap k ON k.prefix = lower(substr(i.symbol, 1, 2))
            JOIN v_snapshot s ON s.market = 'global' AND contains(lower(s.name), lower(k.word))
            WHERE item_type = 'futures') m)
    WHERE nth = 1"""
VIEWS["quoted"] = f"""
    SELECT item_pos, industry_id, coalesce(nullif(name, ''), found_name, symbol) AS name, symbol,
           round(last, 2) AS price, round(pct, 2) AS change_pct, kind AS item_type, {AS_OF} AS quoted_at
    FROM (
        SELECT i.item_pos, i.industry_id, i.name, i.symbol, s.name AS found_name, s.last,
               try_cast(trim(replace(s.change_pct, '%', '')) AS DOUBLE) AS pct, 'stock' AS kind
        FROM v_items i JOIN first_code s ON s.code = i.symbol
         AND s.market = CASE i.item_type WHEN 'stock' THEN 'cn' ELSE 'hk' END
        WHERE i.item_type <> 'futures'
        UNION ALL
        SELECT item_pos, industry_id, name, symbol, found_name, last,
               try_cast(trim(replace(change_pct, '%', '')) AS DOUBLE), 'futures'
        FROM futures_match WHERE last <> 0 AND NOT isnan(last))
    WHERE pct IS NOT NULL AND last IS NOT NULL"""


def two(column: str) -> str:
    return f"CASE WHEN isnan({column}) THEN 'nan' ELSE printf('%.2f', {column}) END"


VIEWS["shown"] = f"""
    SELECT *, {two('price')} AS price_text,
           CASE WHEN change_pct > 0 THEN '+' ELSE '' END || {two('change_pct')} || '%' AS change_text,
           CASE WHEN change_pct > 0 THEN 'up' WHEN change_pct < 0 THEN 'down' ELSE 'flat' END AS direction,
           strftime(quoted_at, '%H:%M:%S') AS time_text
    FROM quoted"""
VIEWS["contact"] = """SELECT coalesce(nullif(contact_email, ''), username) AS contact
                      FROM v_smtp ORDER BY id LIMIT 1"""
VIEWS["lines"] = """
    SELECT industry_id, item_pos, CASE item_type WHEN 'stock' THEN 0 ELSE 1 END AS section,
           '<tr><td>' || name || '</td><td>' || symbol || '</td><td>' || price_text || '</td><td class="'
           || direction || '">' || change_text || '</td><td>' || time_text || '</td></tr>' AS line
    FROM shown"""


def table(section: int, heading: str) -> str:
    lines_ = f"string_agg(line, '' ORDER BY item_pos) FILTER (section = {section})"
    return f"coalesce('<h2>{heading}</h2><table>' || {lines_} || '</table>', '')"


VIEWS["evening"] = f"""
    SELECT l.industry_id, '【' || any_value(i.name) || '】行业晚报 - 今日行情' AS subject,
           count(*) AS n_items, any_value(c.contact) AS contact,
           {table(0, K.STOCK_HEADING)} || {table(1, K.FUTURES_HEADING)}
             || '<p class="contact">' || any_value(c.contact) || '</p>' AS body
    FROM lines l JOIN v_industries i ON i.id = l.industry_id, contact c GROUP BY 1"""


def ready(kind: str, inputs: str, none: str) -> str:
    return f"""
    SELECT i.id AS industry_id, i.name AS industry_name, '{kind}' AS push_type,
           (SELECT count(*) FROM v_recipients r WHERE r.industry_id = i.id) AS n_recipients,
           CASE WHEN (SELECT count(*) FROM {inputs} s WHERE s.industry_id = i.id) = 0 THEN '{none}'
                WHEN (SELECT count(*) FROM v_recipients r WHERE r.industry_id = i.id) = 0 THEN '{K.NO_RECIPIENTS}'
                WHEN (SELECT count(*) FROM v_smtp) = 0 THEN '{K.NO_SMTP}' END AS reason
    FROM v_industries i"""


VIEWS["ready_morning"] = ready("morning", "v_sources", K.NO_SOURCES)
VIEWS["ready_evening"] = ready("evening", "v_items", K.NO_ITEMS)


def outcome(ready_: str, rows: str, errors: str, nothing: str) -> str:
    return f"""
    SELECT r.industry_id, r.push_type,
           CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN message IS NOT NULL THEN 'failed'
                WHEN coalesce(n, 0) = 0 THEN 'skipped' ELSE 'success' END AS status,
           CASE WHEN reason IS NOT NULL OR message IS NOT NULL THEN 0 ELSE coalesce(n, 0) END AS article_count,
           CASE WHEN reason IS NOT NULL THEN 0 ELSE n_recipients END AS recipient_count,
           CASE WHEN reason IS NOT NULL THEN reason WHEN message IS NOT NULL THEN substr(message, 1, 1000)
                WHEN coalesce(n, 0) = 0 THEN '{nothing}' END AS error_msg
    FROM {ready_} r LEFT JOIN (SELECT industry_id, count(*) AS n FROM {rows} GROUP BY 1) c USING (industry_id)
    LEFT JOIN ({errors}) e USING (industry_id)"""


NO_ERRORS = "SELECT NULL::INT AS industry_id, NULL::VARCHAR AS message WHERE false"


def log_of(found: str, evening: str, trigger: str) -> str:
    return f"""
    SELECT o.*, CASE WHEN status = 'success' THEN length(body) END AS html_snapshot,
           '{trigger}' AS triggered_by, {AS_OF} AS created_at
    FROM ({outcome('ready_evening', found, NO_ERRORS, K.NO_QUOTES)}) o
    LEFT JOIN {evening} e USING (industry_id)"""


def streak(source: str, keys: str, time: str, tie: str, add: str, reset: str, name: str) -> str:
    return f"""
    SELECT *, sum(CASE WHEN {add} THEN 1 ELSE 0 END)
                OVER (PARTITION BY {keys}, island ORDER BY {time}, {tie})::BIGINT AS {name}
    FROM (SELECT *, sum(CASE WHEN {reset} THEN 1 ELSE 0 END)
                OVER (PARTITION BY {keys} ORDER BY {time}, {tie}) AS island FROM {source})"""


VIEWS["counted"] = streak("v_checks", "source_id", "checked_at", "check_id",
                          "status = 'error'", "status <> 'error'", "failures")
CONFIG = ", ".join(q(x) for x in (K.NO_SOURCES, K.NO_ITEMS, K.NO_RECIPIENTS, K.NO_SMTP))
VIEWS["log_counted"] = streak(
    "v_push_log", "industry_id, push_type", "created_at", "id", "status = 'failed'",
    f"status <> 'failed' AND NOT (status = 'skipped' AND error_msg IN ({CONFIG}))", "streak",
)
VIEWS["last_health"] = """
    SELECT s.id AS source_id, s.name, coalesce(l.status, 'unknown') AS health_status,
           l.checked_at AS last_check_at, l.error AS last_error, coalesce(l.failures, 0) AS consecutive_failures
    FROM v_check_sources s LEFT JOIN (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY checked_at DESC, check_id DESC) AS nth
                       FROM counted) WHERE nth = 1) l ON l.source_id = s.id"""
VIEWS["timed"] = """
    SELECT id, industry_id, push_type, enabled,
           CASE WHEN hour IS NULL OR hour = 9 THEN CASE push_type WHEN 'evening' THEN 18 ELSE 9 END ELSE hour END AS hour,
           CASE WHEN hour IS NULL OR hour = 9 THEN coalesce(minute, 0) ELSE minute END AS minute
    FROM v_schedules"""
VIEWS["jobs"] = """
    SELECT push_type || '_' || industry_id AS job_id, industry_id::BIGINT AS industry_id, hour::BIGINT AS hour,
           coalesce(minute, 0)::BIGINT AS minute
    FROM (SELECT *, row_number() OVER (PARTITION BY push_type, industry_id ORDER BY id DESC) AS nth
          FROM timed WHERE enabled) WHERE nth = 1"""


def first_prefix(column: str) -> str:
    cases = " ".join(
        f"WHEN starts_with({column}, {q(p)}) THEN trim(substr({column}, {len(p) + 1}), {BLANKS})"
        for p in K.TITLE_PREFIXES
    )
    return f"CASE {cases} ELSE {column} END"


def each_prefix(source: str, column: str) -> str:
    """A chain of sub-selects, one per prefix."""
    sql = f"SELECT *, {column} AS s0 FROM {source}"
    for i, p in enumerate(K.SUMMARY_PREFIXES):
        sql = (f"SELECT *, CASE WHEN starts_with(s{i}, {q(p)}) THEN trim(substr(s{i}, {len(p) + 1}), {BLANKS})"
               f" ELSE s{i} END AS s{i + 1} FROM ({sql})")
    return sql


VIEWS["a_split"] = f"""
    SELECT *, CASE WHEN barred THEN trim(substr(txt, 1, strpos(txt, '|') - 1), {BLANKS})
                   WHEN len(ls) >= 2 THEN ls[1]
                   WHEN len(ls) = 1 AND length(ls[1]) <= 30 THEN ls[1] ELSE original END AS title,
              CASE WHEN barred THEN trim(substr(txt, strpos(txt, '|') + 1), {BLANKS})
                   WHEN len(ls) >= 2 THEN ls[2]
                   WHEN len(ls) = 1 AND length(ls[1]) > 30 THEN ls[1] ELSE '' END AS summary
    FROM (SELECT *, contains(txt, '|') AS barred,
                 list_filter(list_transform(string_split(txt, chr(10)), lambda x: trim(x, {BLANKS})),
                             lambda x: x <> '') AS ls
          FROM (SELECT *, trim(answer, {BLANKS}) AS txt FROM v_answers))"""


def clip(column: str) -> str:
    return f"CASE WHEN length({column}) > 140 THEN substr({column}, 1, 140) || '...' ELSE {column} END"


def head_tail(column: str) -> str:
    return (f"CASE WHEN length({column}) > 5000 THEN substr({column}, 1, 2500) || {q(K.OMITTED)}"
            f" || right({column}, 2500) ELSE {column} END")


def masked(column: str) -> str:
    for pattern, cover in K.MASKS:
        column = f"regexp_replace({column}, {q(pattern)}, {q(cover.replace('$1', chr(92) + '1'))}, 'g')"
    return column


def prompt(lang: str) -> str:
    first, middle, last = K.PROMPTS[lang].replace("{n}", "140").split("%s")
    return f"{q(first)} || a.title || {q(middle)} || {head_tail('d.text')} || {q(last)}"


# --- one text per query ------------------------------------------------------------

ORACLE: dict[str, str] = {}


def add(name: str, body: str, extra: dict[str, str] | None = None) -> None:
    """Put the views a text uses in front of it, in order of their definition."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def need(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z][a-z_]*\b", sql)):
            if word in known and word not in order and word not in busy:
                busy.add(word)
                need(known[word])
                order.append(word)

    busy: set[str] = set()
    need(body)
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    ORACLE[name] = (f"WITH RECURSIVE {ctes}\n{body}" if ctes else body)


add("scan_by_industry", "SELECT * FROM v_items WHERE industry_id = 1")
add("scan_projected", "SELECT id, name, url, link_selector FROM v_check_sources")
add("lookup_by_id", "SELECT id, name, url FROM v_check_sources WHERE id = 77")
add("select_by_ids", """SELECT id, name, pos::BIGINT AS request_pos FROM v_check_sources
    JOIN (VALUES (42, 0), (7, 1), (100000000, 2), (19, 3)) r(rid, pos) ON rid = id""")
add("first_config", "SELECT id, host, username FROM v_smtp ORDER BY id LIMIT 1")
add("append_seen", f"""
    SELECT url, title, source_id, first_seen_at FROM v_seen UNION ALL
    SELECT url, title, source_id, {AS_OF} FROM (
        SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_id, doc_id) AS nth FROM (
            SELECT doc_id, title, source_id, regexp_replace(url, '[0-9]$', '0') AS url
            FROM v_articles))
    WHERE nth = 1 AND url NOT IN (SELECT url FROM v_seen)""")
add("append_push_log", log_of("quoted", "evening", "manual"))
add("evolve_schema", """SELECT id, industry_id, name, url, weight, keywords, NULL::VARCHAR AS link_selector,
    'zh' AS language, 'unknown' AS health_status, NULL::TIMESTAMP AS last_check_at, NULL::VARCHAR AS last_error,
    0 AS consecutive_failures FROM v_sources""")
add("replace_by_key", """SELECT industry_id, item_pos, name, symbol, item_type FROM v_items WHERE industry_id NOT IN (2, 3)
    UNION ALL SELECT industry_id, item_pos + 1, name, symbol, item_type FROM v_items
    WHERE industry_id = 3 AND item_type = 'stock'""")
EARLY = "(push_type = 'evening' AND hour < 12)"
add("fix_schedule_hours", f"""SELECT id, push_type, CASE WHEN {EARLY} THEN 18 ELSE hour END AS hour,
    CASE WHEN {EARLY} THEN 0 ELSE minute END AS minute, coalesce({EARLY}, false) AS changed FROM v_schedules""")
add("fix_schedule_count", f"SELECT count(*) AS n_fixed FROM v_schedules WHERE {EARLY}")
add("scan_snapshot", "SELECT market, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM v_snapshot GROUP BY 1")
add("delete_selected", "SELECT id, industry_id, status FROM v_push_log WHERE status <> 'failed'")

LINK_COLS = "SELECT page_id, pos, title, url FROM links"
add("extract_links", LINK_COLS, links("v_pages"))
add("extract_links_raw", LINK_COLS, links("raw_pages"))
add("extract_links_scoped", LINK_COLS, links("v_pages", scoped(r"(?is)<nav[\s>].*?</nav\s*>")))
add("extract_links_nested", LINK_COLS, links("v_pages", scoped(r"(?is)<li[\s>].*?</li\s*>")))
add("extract_links_class", LINK_COLS, links("v_pages", scoped(r'(?is)<div class="extra">.*?</div>')))
add("extract_links_by_source", LINK_COLS, links("v_pages", "CASE page_id % 4 WHEN 0 THEN clean WHEN 1 THEN "
    + scoped(r"(?is)<nav[\s>].*?</nav\s*>") + " WHEN 2 THEN " + scoped(r'(?is)<div class="extra">.*?</div>') + " ELSE '' END"))
add("extract_summary", f"SELECT page_id, {SUMMARY} AS summary FROM t_paras", texts("v_pages"))
add("extract_article_text", f"SELECT page_id, {ARTICLE} AS article_text FROM t_paras", texts("v_pages"))
add("paragraph_filter", f"""
    SELECT {fault('p', True)} AS reason, count(*) AS n, 'summary' AS kind FROM (SELECT unnest(ps) AS p FROM t_paras) GROUP BY 1
    UNION ALL
    SELECT {fault('p', False)}, count(*), 'article' FROM (SELECT unnest(pa) AS p FROM t_paras) GROUP BY 1""", texts("v_pages"))
add("truncate_head_tail", f"SELECT doc_id, {head_tail('text')} AS body FROM documents")
add("min_length_gate", "SELECT doc_id, length(text) >= CASE WHEN lang = 'en' THEN 50 ELSE 100 END AS long_enough FROM documents")

add("split_title_summary", "SELECT conv_id, turn, title, summary FROM a_split")
add("strip_title_prefix", f"SELECT conv_id, turn, {first_prefix('answer')} AS title FROM v_answers")
add("strip_summary_prefix", f"SELECT conv_id, turn, s5 AS summary FROM ({each_prefix('v_answers', 'answer')})")
add("clip_text", f"SELECT doc_id, {clip('text')} AS clipped FROM documents")
add("summary_fallback", f"""SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'Given summary' ELSE {SUMMARY} END AS summary
    FROM t_paras""", texts("v_pages"))
add("read_answers", f"""SELECT conv_id, turn, CASE WHEN lang = 'en' THEN {first_prefix('title')} ELSE original END AS title,
    CASE WHEN lang = 'en' THEN {clip('summary')} ELSE {clip('s5')} END AS summary
    FROM ({each_prefix('a_split', 'txt')})""")
add("build_prompt", f"""SELECT doc_id, CASE WHEN a.lang = 'en' THEN {prompt('en')} ELSE {prompt('zh')} END AS prompt
    FROM v_articles a JOIN documents d USING (doc_id)""")
add("summarize_with", f"""
    SELECT page_id, 'Page ' || page_id AS title, coalesce(nullif(
        CASE WHEN length(art) >= CASE WHEN page_id % 2 = 0 THEN 50 ELSE 100 END
             THEN {clip(f"trim(split_part({head_tail('art')}, '.', 1), {BLANKS})")} END, ''), summary) AS summary
    FROM (SELECT page_id, {ARTICLE} AS art, {SUMMARY} AS summary FROM t_paras)""", texts("v_pages"))
add("parse_keywords", f"""SELECT doc_id, array_to_string(must, ' ') AS must, array_to_string(must_not, ' ') AS must_not,
    array_to_string(bonus, ' ') AS bonus FROM (SELECT doc_id, {words('keywords')} FROM (
        SELECT doc_id, replace(replace(title, ' t', ' +T'), ' d', ' !d') AS keywords FROM v_articles))""")
add("keyword_score", "SELECT doc_id, round(kw, 6) AS keyword_score FROM judged")
add("industry_filter", "SELECT doc_id, industry_id FROM judged WHERE industry_ok")
add("timeliness", "SELECT doc_id, round(tm, 6) AS time_part FROM judged")
add("weight_score", "SELECT id, round(greatest(0.1, least(1.0, weight / 10.0::DOUBLE)), 6) AS weight_part FROM v_sources")
add("score_articles", "SELECT doc_id, industry_id, round(score, 6) AS score FROM scored")
add("top_n_per_industry", """SELECT industry_id, rank::INT AS rank, doc_id, title, round(score, 6) AS score FROM topped""")
add("filter_report", """SELECT industry_id, count(*) AS total, count(*) - count(*) FILTER (industry_ok AND kw IS NOT NULL) AS filtered,
    count(*) FILTER (industry_ok AND kw IS NOT NULL) AS kept,
    least(count(*) FILTER (industry_ok AND kw IS NOT NULL), any_value(top_n)) AS top FROM judged GROUP BY 1""")
add("unseen_articles", "SELECT doc_id, url FROM v_articles WHERE url NOT IN (SELECT url FROM v_seen)")
add("attach_source", """SELECT doc_id, source_id, s.name AS source_name, s.weight AS source_weight, s.industry_id
    FROM v_articles a JOIN v_sources s ON s.id = a.source_id""")
FRESH = {**links("v_pages"), "fresh": "SELECT * FROM links WHERE fetch_ok AND url NOT IN (SELECT url FROM v_seen)"}
add("union_ok_sources", "SELECT source_id, page_id, pos, url FROM fresh", FRESH)
add("recipients_fanout", "SELECT industry_id, subject, email FROM evening JOIN v_recipients USING (industry_id)")

add("dedup_exact", "SELECT doc_id, source_id, title FROM first_titles", {"first_titles": FIRST_TITLES})
add("dedup_exact_per_industry", """SELECT doc_id, industry_id, title FROM (
    SELECT *, row_number() OVER (PARTITION BY s.industry_id, title ORDER BY source_id, doc_id) AS nth
    FROM v_articles a JOIN v_sources s ON s.id = a.source_id) WHERE nth = 1""")
add("dedup_semantic", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM gone)", greedy("""
    SELECT x.vec_id AS a, y.vec_id AS b FROM v_vectors x JOIN v_vectors y ON x.vec_id < y.vec_id
    AND list_cosine_similarity(x.embedding, y.embedding) >= 0.85"""))
add("dedup_titles", "SELECT doc_id, title FROM numbered WHERE id NOT IN (SELECT id FROM gone)", {
    "first_titles": FIRST_TITLES, "numbered": NUMBERED, **greedy(title_edges("numbered", 0.85))})
add("dedup_with_fallback", """SELECT doc_id, title, embedding IS NOT NULL AS has_vector
    FROM with_vec WHERE id NOT IN (SELECT id FROM gone)""", {
    "first_titles": FIRST_TITLES, "numbered": NUMBERED,
    "with_vec": "SELECT n.*, e.embedding FROM numbered n LEFT JOIN v_vectors e ON e.vec_id = n.doc_id",
    **greedy("""SELECT x.id AS a, y.id AS b FROM with_vec x JOIN with_vec y ON x.id < y.id
        AND x.embedding IS NOT NULL AND y.embedding IS NOT NULL
        AND list_cosine_similarity(x.embedding, y.embedding) >= 0.85""")})

STOCK = "SELECT item_pos, symbol, s.name AS found_name, {last} AS last, change_pct FROM v_items i JOIN first_code s ON s.code = i.symbol AND s.market = '{m}' WHERE item_type = '{t}'"
add("quotes_stock", STOCK.format(last=two("last"), m="cn", t="stock"))
add("quotes_stock_hk", STOCK.format(last=two("last"), m="hk", t="stock_hk"))
add("quotes_futures_exact", f"SELECT item_pos, symbol, found_name, {two('last')} AS last FROM futures_match WHERE method = 'code'")
add("quotes_futures_match", f"SELECT item_pos, symbol, method, found_name, {two('last')} AS last FROM futures_match")
add("parse_pct", "SELECT pos, round(try_cast(trim(replace(change_pct, '%', '')) AS DOUBLE), 6) AS pct FROM v_snapshot")
add("valid_price", "SELECT pos, last FROM v_snapshot WHERE last <> 0 AND NOT isnan(last)")
add("display_name", """SELECT item_pos, coalesce(nullif(i.name, ''), s.name, symbol) AS shown
    FROM v_items i JOIN first_code s ON s.code = i.symbol AND s.market = 'cn'""")
add("fetch_quotes", f"""SELECT item_pos, industry_id, name, symbol, {two('price')} AS price, change_pct, item_type, quoted_at FROM quoted""")
add("quote_coverage", """SELECT industry_id, count(*) AS requested, count(*) FILTER (item_pos IN (SELECT item_pos FROM quoted)) AS found
    FROM v_items GROUP BY 1""")
add("quotes_missing", "SELECT item_pos, symbol FROM v_items WHERE item_pos NOT IN (SELECT item_pos FROM quoted)")

CLASSIFIED = f"""
    SELECT page_id, CASE WHEN outcome <> 'ok' THEN 'error' WHEN n > 0 THEN 'healthy' ELSE 'warning' END AS status,
           CASE outcome WHEN 'timeout' THEN '{K.TIMED_OUT}' WHEN 'http' THEN 'HTTP ' || http_status
                WHEN 'other' THEN substr(message, 1, 200)
                ELSE CASE WHEN n = 0 THEN '{K.NO_LINKS.replace('%s', 'nav a')}' END END AS error
    FROM (SELECT *, len({pieces(scoped('(?is)<nav[\\s>].*?</nav' + chr(92) + 's*>'), 'a')}) AS n
          FROM (SELECT *, {no_comments('html')} AS clean FROM v_fetched))"""
add("classify_health", CLASSIFIED)
add("consecutive_failures", "SELECT check_id, source_id, status, failures FROM counted")
add("health_alerts", """SELECT check_id, source_id, failures, '【告警】新闻源「' || name || '」已连续检查失败 ' || failures || ' 次' AS subject
    FROM counted JOIN v_check_sources s ON s.id = source_id WHERE status = 'error' AND failures >= 3""")
add("health_rollup", """SELECT count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'warning') AS warning,
    count(*) FILTER (status = 'error') AS error FROM v_checks""")
add("latest_health", "SELECT * FROM last_health")
ORACLE["health_states_by_step"] = ORACLE["latest_health"]
RUN = {
    "new_checks": f"SELECT 1000000000 + page_id AS check_id, page_id % 40 AS source_id, {AS_OF} AS checked_at, status, error"
                  f" FROM ({CLASSIFIED})",
    "every_check": "SELECT check_id, source_id, checked_at, status, error FROM v_checks UNION ALL SELECT * FROM new_checks",
    "every_counted": streak("every_check", "source_id", "checked_at", "check_id", "status = 'error'", "status <> 'error'",
                            "failures"),
}
add("health_check", """SELECT check_id, source_id, status, error, failures, CASE WHEN status = 'error' AND failures >= 3
    AND s.id IS NOT NULL THEN '【告警】新闻源「' || name || '」已连续检查失败 ' || failures || ' 次' END AS subject
    FROM every_counted c LEFT JOIN v_check_sources s ON s.id = source_id WHERE check_id >= 1000000000""", RUN)
add("health_check_states", VIEWS["last_health"].replace("FROM counted", "FROM every_counted"), RUN)
LABEL = "CASE health_status " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in K.LABELS.items()) + " END"
add("health_labels", f"SELECT source_id, name || ': ' || {LABEL} || coalesce('（' || nullif(last_error, '') || '）', '') AS line FROM last_health")

READY_COLS = "SELECT industry_id, push_type, n_recipients, reason FROM"
add("push_readiness", f"{READY_COLS} ready_morning UNION ALL {READY_COLS} ready_evening")
add("push_outcome", outcome("ready_morning", "topped", """SELECT industry_id, arg_max(error_msg, id) AS message
    FROM v_push_log WHERE status = 'failed' AND industry_id = 1 GROUP BY 1""", K.NO_NEWS))
add("push_failure_streak", "SELECT id, industry_id, push_type, status, streak FROM log_counted")
add("push_alerts", """SELECT l.id, streak, '【告警】' || i.name || ' ' || CASE push_type WHEN 'morning' THEN '早报' ELSE '晚报' END
    || '已连续失败 ' || streak || ' 次' AS subject, substr(error_msg, 1, 500) AS error
    FROM log_counted l JOIN v_industries i ON i.id = l.industry_id WHERE status = 'failed' AND streak >= 3""")

add("prune_seen", f"SELECT url, first_seen_at FROM v_seen WHERE first_seen_at >= {AS_OF} - INTERVAL 7 DAY")
add("expire_snapshots", f"SELECT id, CASE WHEN created_at >= {AS_OF} - INTERVAL 3 DAY THEN html_snapshot END AS html_snapshot FROM v_push_log")
add("prune_push_log", f"SELECT id, created_at FROM v_push_log WHERE created_at >= {AS_OF} - INTERVAL 30 DAY")
ORACLE["prune_laid_out"], ORACLE["unseen_laid_out"] = ORACLE["prune_seen"], ORACLE["unseen_articles"]
add("cleanup_report", f"""SELECT (SELECT count(*) FROM v_seen WHERE first_seen_at < {AS_OF} - INTERVAL 7 DAY) AS seen_deleted,
    (SELECT count(*) FROM v_push_log WHERE created_at < {AS_OF} - INTERVAL 3 DAY AND html_snapshot IS NOT NULL) AS snapshots_cleared,
    (SELECT count(*) FROM v_push_log WHERE created_at < {AS_OF} - INTERVAL 30 DAY) AS log_deleted""")
add("reset_seen", """SELECT url, source_id FROM v_seen WHERE source_id IS NULL
    OR source_id NOT IN (SELECT id FROM v_sources WHERE industry_id IN (1, 3))""")

add("validate_schedule", """SELECT id, push_type, coalesce(CASE push_type WHEN 'morning' THEN hour BETWEEN 6 AND 12
    ELSE hour BETWEEN 16 AND 21 END, false) AS is_valid FROM v_schedules""")
add("default_schedule_time", "SELECT id, push_type, hour, minute FROM timed")
add("active_jobs", "SELECT job_id, industry_id, hour, minute FROM jobs")
add("due_jobs", f"""SELECT job_id, fires_at FROM (
    SELECT job_id, day + to_hours(hour::INT) + to_minutes(minute::INT) - INTERVAL 8 HOUR AS fires_at
    FROM (SELECT job_id, hour, minute FROM jobs UNION ALL VALUES ('daily_cleanup', 2, 0), ('daily_health_check', 6, 0)),
         (SELECT unnest(generate_series(TIMESTAMP '2024-01-29', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS day))
    WHERE fires_at > TIMESTAMP '2024-01-29 01:00:00' AND fires_at <= {AS_OF}""")

add("morning_report", """
    SELECT industry_id, '【' || any_value(industry_name) || '】行业早报 - 今日要闻' AS subject, count(*) AS n_items,
           any_value(c.contact) AS contact,
           '<ol>' || string_agg('<li><a href="' || url || '">' || title || '</a>'
               || CASE WHEN summary <> '' THEN '<div>' || summary || '</div>' ELSE '' END
               || '<i>' || source_name || ' · ' || strftime(published_at, '%Y-%m-%d %H:%M') || '</i></li>', ''
               ORDER BY rank) || '</ol><p class="contact">' || any_value(c.contact) || '</p>' AS body
    FROM topped, contact c GROUP BY 1""")
add("evening_report", "SELECT * FROM evening")
add("evening_report_lines", f"""
    SELECT industry_id, section, 1 AS part, item_pos, line FROM lines
    UNION ALL SELECT DISTINCT industry_id, section, 0, NULL::BIGINT, '<h2>' || CASE section WHEN 0 THEN '{K.STOCK_HEADING}'
        ELSE '{K.FUTURES_HEADING}' END || '</h2><table>' FROM lines
    UNION ALL SELECT DISTINCT industry_id, section, 2, NULL, '</table>' FROM lines
    UNION ALL SELECT DISTINCT industry_id, 2, 0, NULL, '<p class="contact">' || contact || '</p>' FROM lines, contact""")
add("evening_report_totals", "SELECT industry_id, subject, n_items, length(body) AS n_chars FROM evening")
add("quote_display", "SELECT item_pos, price_text, change_text, direction, time_text FROM shown")
DETAIL = {f"d_{k}": re.sub(r"\bt_(clean|area|cut|paras)\b", r"d_t_\1", v) for k, v in texts("details").items()}
BRIEF_ROWS = """
    SELECT industry_id, rank::INT AS rank, source_id, page_id, pos, title, url, summary, round(score, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY industry_id ORDER BY score DESC, source_id, page_id, pos) AS rank
          FROM brief_scored) WHERE rank <= top_n
      AND industry_id IN (SELECT industry_id FROM ready_morning WHERE reason IS NULL)"""
BRIEF_STEPS = {
    "brief_first": """SELECT *, row_number() OVER (ORDER BY source_id, page_id, pos) AS id FROM (
        SELECT *, row_number() OVER (PARTITION BY scope, title ORDER BY source_id, page_id, pos) AS nth FROM known)
        WHERE nth = 1""",
    **greedy(title_edges("brief_first", 0.85, "scope")),
    "brief_once": "SELECT * FROM brief_first WHERE id NOT IN (SELECT id FROM gone)",
    **{("brief_" + k): v.replace("FROM judged", "FROM brief_judged") for k, v in judged("brief_once").items()},
}
add("morning_brief", BRIEF_ROWS, {
    **FRESH,
    "details": "SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY 1",
    **DETAIL,
    "summaries": f"SELECT url, {SUMMARY} AS summary FROM d_t_paras",
    "known": f"""SELECT f.source_id, f.page_id, f.pos, f.title, f.url, coalesce(summary, '') AS summary,
        {AS_OF} AS published_at, s.industry_id AS scope
        FROM fresh f JOIN v_sources s ON s.id = f.source_id LEFT JOIN summaries m ON m.url = f.url""",
    **BRIEF_STEPS,
})
OWN_SCOPE = (
    "CASE WHEN source_id % 4 = 1 THEN " + scoped(r"(?is)<nav[\s>].*?</nav\s*>") + " WHEN source_id % 4 = 2 THEN "
    + scoped(r'(?is)<div class="extra">.*?</div>') + " WHEN source_id = 7 THEN '' ELSE clean END"
)
OWN_FRESH = {**links("v_pages", OWN_SCOPE), "fresh": FRESH["fresh"]}
ASKED = {
    **OWN_FRESH, "details": "SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY 1", **DETAIL,
    "texts": f"SELECT url, {SUMMARY} AS summary, {ARTICLE} AS art FROM d_t_paras",
    "answered": f"""
        SELECT f.*, s.industry_id AS scope, coalesce(t.summary, '') AS extracted, n % 2 = 1 AS en,
               coalesce(length(art) >= CASE WHEN n % 2 = 0 THEN 100 ELSE 50 END, false) AS asks, f.title LIKE '%3' AS fails,
               {clip(f"trim(split_part({head_tail('art')}, '.', 1), {BLANKS})")} AS answer
        FROM fresh f JOIN (SELECT *, id AS n FROM v_sources) s ON s.id = f.source_id LEFT JOIN texts t ON t.url = f.url""",
}
add("morning_brief_errors", """
    SELECT source_id, page_id, pos, 'ValueError: cannot read ' || title AS error FROM answered WHERE asks AND fails
    UNION ALL SELECT id, NULL, NULL, 'selector not supported: >' FROM v_sources WHERE id = 7""", ASKED)
add("morning_brief_summarized", BRIEF_ROWS, {
    **ASKED,
    "known": f"""SELECT source_id, page_id, pos, CASE WHEN en AND asks AND NOT fails THEN 'AI ' || title ELSE title END AS title,
        url, coalesce(nullif(CASE WHEN asks AND NOT fails THEN answer END, ''), extracted) AS summary,
        {AS_OF} AS published_at, scope FROM answered""",
    **BRIEF_STEPS,
})
add("evening_brief", log_of("quoted", "evening", "scheduler"))

add("mask_sensitive", f"SELECT doc_id, {masked('text')} AS masked FROM documents")
add("url_safety", r"""
    SELECT page_id, reason IS NULL AS is_safe, reason FROM (
        SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'no host'
            WHEN regexp_matches(host, '^(10\.|192\.168\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)[0-9.]+$')
              OR host = '::1' OR regexp_matches(host, '^f[cd][0-9a-f][0-9a-f]:') THEN 'private'
            WHEN regexp_matches(host, '^[0-9.]+$') OR contains(host, ':') THEN NULL
            WHEN p IS NULL THEN 'unresolved' WHEN p THEN 'private' END AS reason
        FROM (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme,
                     regexp_replace(regexp_extract(url, '^[A-Za-z]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)', 1), '[\[\]]', '', 'g') AS host
              FROM v_urls)
        LEFT JOIN (SELECT host, bool_or(ip LIKE '10.%') AS p FROM v_resolved GROUP BY 1) USING (host))""")
add("encrypt_column", "SELECT id, password, password LIKE 'secret-%' AS changed FROM v_smtp")
add("rate_limit", "SELECT event_id, user_id, ok AS allowed FROM decided", {
    "tries": "SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events",
    "decided": f"""
        SELECT user_id, rn, event_id, [t] AS hist, true AS ok FROM tries WHERE rn = 1
        UNION ALL
        SELECT user_id, rn, event_id, CASE WHEN len(h) < {DAY_LIMIT} THEN list_append(h, t) ELSE h END, len(h) < {DAY_LIMIT}
        FROM (SELECT a.user_id, a.rn, a.event_id, a.t, list_filter(d.hist, lambda x: a.t - x < 86400000000) AS h
              FROM decided d JOIN tries a ON a.user_id = d.user_id AND a.rn = d.rn + 1)"""})
add("stream_failures", "SELECT check_id, source_id, status, failures FROM counted")
ORACLE["stream_rate_limit"] = ORACLE["rate_limit"]

add("stream_unseen", "SELECT DISTINCT 'https://e.example/' || user_id AS url FROM events")
STREAM_STEPS = {
    "details": "SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY 1", **DETAIL,
    "summaries": f"SELECT url, {SUMMARY} AS summary FROM d_t_paras",
    "stream_first": f"""SELECT f.source_id, f.page_id, f.pos, f.title, f.url, coalesce(summary, '') AS summary,
        {AS_OF} AS published_at
        FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_id, page_id, pos) AS turn FROM fresh) f
        LEFT JOIN summaries m ON m.url = f.url WHERE turn = 1""",
    **{("stream_" + k): v.replace("FROM judged", "FROM stream_judged") for k, v in judged("stream_first").items()},
}
add("stream_briefing", """
    SELECT industry_id, source_id, page_id, pos, title, url, summary, round(score, 6) AS score FROM stream_scored""",
    {**FRESH, **STREAM_STEPS})
add("stream_briefing_by_source", """
    SELECT industry_id, source_id, page_id, pos, url, round(score, 6) AS score FROM stream_scored""",
    {**OWN_FRESH, **STREAM_STEPS})
