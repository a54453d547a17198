"""DuckDB oracle SQL for the registered queries.

Each string runs on the driver's views (``pages``, ``events``,
``documents`` ...).  The shared prelude rebuilds the stand-in inputs with
the same rules as ``sitelens.sources.fixtures``; the query bodies compute
the expected answers with plain SQL, often from the fixture rules rather
than by re-parsing the generated text.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixture prelude (must match sitelens.sources.fixtures)
# ---------------------------------------------------------------------------
PRELUDE = r"""
sp0 AS (
  SELECT page_id, url, html,
         regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS host,
         split_part(url, '#', 1) AS url_nf
  FROM pages
),
site_pages AS (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS i,
         length(host) % 4 AS tier
  FROM sp0
),
sites AS (
  SELECT DISTINCT substr(sha256(host), 1, 16) AS run_id,
         'https://' || host AS target_url, host AS hostname
  FROM sp0
),
captures AS (
  SELECT url_nf AS url, page_id, html,
         CASE WHEN page_id % 10 = 0 THEN 500 WHEN page_id % 11 = 0 THEN 304 ELSE 200 END AS status_code,
         page_id * 1000000 + 1704067200000000 AS ord
  FROM sp0
),
-- URL pieces of the page URLs (RFC 3986 appendix B)
page_url_parts AS (
  SELECT page_id, url,
         lower(regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 2)) AS scheme,
         regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 4) AS netloc,
         regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 5) AS raw_path
  FROM pages
)
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([PRELUDE.strip()] + [c.strip() for c in ctes])


# Title of a driver page: the <title> of its head, entities decoded, trimmed.
_TITLE_EXPR = r"""
nullif(trim(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(html, '(?s)<head>.*?<title>(.*?)</title>', 1),
    '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#39;?', chr(39), 'g'), '&amp;?', '&', 'g'),
  ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '')
"""

# canonical URL (P3) of a column named url
_CANON = r"""
lower(
  lower(regexp_extract({u}, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)', 2)) || '://' ||
  regexp_extract({u}, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)', 4) ||
  CASE
    WHEN regexp_replace(regexp_extract({u}, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)', 5), ';[^/]*$', '') = '' THEN '/'
    WHEN regexp_replace(regexp_extract({u}, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)', 5), ';[^/]*$', '') = '/' THEN '/'
    ELSE regexp_replace(regexp_replace(regexp_extract({u}, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)', 5), ';[^/]*$', ''), '/$', '')
  END)
"""


def canon(col: str) -> str:
    return _CANON.replace("{u}", col)


def title_case(col: str) -> str:
    return (
        "array_to_string(list_transform(regexp_extract_all(" + col + r", '(\p{L}+|\P{L}+)'), "
        "lambda x: upper(x[1]) || lower(x[2:])), '')"
    )


def section_of(url: str, host: str) -> str:
    """P8 in DuckDB terms (NULL = excluded)."""
    net = f"regexp_extract({url}, '^(([^:/?#]+):)?(//([^/?#]*))?', 4)"
    path = f"trim(regexp_replace(regexp_extract({url}, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)', 5), ';[^/]*$', ''), '/')"
    first = f"split_part({path}, '/', 1)"
    base = f"regexp_replace({first}, '\\.[^.]*$', '')"
    pretty = title_case(f"replace(replace({base}, '-', ' '), '_', ' ')")
    return f"""CASE WHEN {net} <> '' AND {net} <> {host} THEN 'External'
        WHEN {path} = '' THEN 'Home'
        WHEN lower({first}) IN ('raw','assets','static','_next','_nuxt','__') THEN NULL
        ELSE {pretty} END"""


INTRO_A = (
    "> This file provides a structured overview of "
)
INTRO_B = (
    " for use by large language models and AI assistants. "
    "Each section below groups related pages by topic. "
    "Links include titles and descriptions where available "
    "to help you quickly identify relevant content. "
    "The content is organised into the following sections: "
)


def _document_sql(pages_cte: str, links_cte: str) -> str:
    """Render documents from CTEs ``{pages_cte}(run_id, url, title,
    description, ord)`` and ``{links_cte}(run_id, links)``."""
    sec = section_of("p.url", "s.hostname")
    return f"""
doc_entries AS (
  SELECT p.run_id, {sec} AS section, p.url, p.ord,
         '- [' || coalesce(nullif(p.title, ''), p.url) || '](' || p.url || ')' ||
         CASE WHEN coalesce(p.description, '') <> '' THEN ': ' || p.description ELSE '' END AS line
  FROM {pages_cte} p JOIN sites s USING (run_id)
),
doc_blocks AS (
  SELECT run_id, section, min(ord) AS sec_ord,
         '## ' || section || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY url) AS block
  FROM doc_entries WHERE section IS NOT NULL GROUP BY run_id, section
),
doc_site AS (
  SELECT run_id, string_agg(section, ', ' ORDER BY sec_ord) AS section_list,
         string_agg(block, chr(10) || chr(10) ORDER BY sec_ord) AS body
  FROM doc_blocks GROUP BY run_id
),
doc_home AS (
  SELECT p.run_id, arg_min(p.title, p.ord) AS site_title, arg_min(p.description, p.ord) AS site_description
  FROM {pages_cte} p JOIN sites s USING (run_id)
  WHERE rtrim(p.url, '/') = 'https://' || s.hostname
  GROUP BY p.run_id
),
doc_counts AS (
  SELECT run_id, count(*) AS n FROM {pages_cte} GROUP BY run_id
),
doc_text AS (
  SELECT s.run_id, s.hostname,
    '# ' || coalesce(nullif(h.site_title, ''), s.hostname) || chr(10) || chr(10) ||
    '{INTRO_A}' || lower(s.hostname) || '{INTRO_B}' || coalesce(nullif(d.section_list, ''), 'various topics') || '.' || chr(10) ||
    '>' || chr(10) ||
    '> - **Generated**: 2024-01-31 00:00 UTC' || chr(10) ||
    '> - **Pages crawled**: ' || CAST(coalesce(c.n, 0) AS VARCHAR) || chr(10) ||
    '> - **Links discovered**: ' || CAST(coalesce(nullif(coalesce(l.links, 0), 0), coalesce(c.n, 0)) AS VARCHAR) ||
    CASE WHEN coalesce(h.site_description, '') <> '' THEN chr(10) || '>' || chr(10) || '> **Website Description**: ' || h.site_description ELSE '' END ||
    CASE WHEN d.body IS NOT NULL THEN chr(10) || chr(10) || d.body ELSE '' END AS raw_text,
    CAST(coalesce(c.n, 0) AS BIGINT) AS entry_count
  FROM sites s
  LEFT JOIN doc_site d USING (run_id)
  LEFT JOIN doc_home h USING (run_id)
  LEFT JOIN doc_counts c USING (run_id)
  LEFT JOIN {links_cte} l USING (run_id)
)"""


def _documents_select() -> str:
    return """
SELECT run_id, hostname,
       regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g') || chr(10) AS llms_txt,
       CAST(strlen(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g') || chr(10)) AS BIGINT) AS size_bytes,
       entry_count
FROM doc_text"""


# Extracted driver pages (the captured-pages flagship): status 200 only.
_CAPTURED_PAGES = r"""
cap_pages AS (
  SELECT s.run_id, c.url, c.ord, """ + _TITLE_EXPR + r""" AS title
  FROM captures c JOIN sites s ON regexp_extract(c.url, '^[^:/?#]+://([^/?#]*)', 1) = s.hostname
  WHERE c.status_code = 200
),
cap_canon AS (
  SELECT run_id, """ + canon("url") + r""" AS url, title,
         CASE WHEN coalesce(title, '') <> '' THEN 1.0 ELSE 0.0 END AS conf, ord
  FROM cap_pages
),
canon_pages AS (
  SELECT run_id, url,
         arg_max(title, conf * 1e18 - ord) AS title,
         CAST(NULL AS VARCHAR) AS description,
         min(ord) AS ord
  FROM cap_canon GROUP BY run_id, url
),
cap_links AS (
  SELECT s.run_id, count(*) AS links
  FROM captures c JOIN sites s ON regexp_extract(c.url, '^[^:/?#]+://([^/?#]*)', 1) = s.hostname
  GROUP BY s.run_id
)
"""


def _oracle_site_index_captured() -> str:
    return _with(_CAPTURED_PAGES, _document_sql("canon_pages", "cap_links")) + _documents_select()


def _oracle_scores_captured() -> str:
    return _with(
        _CAPTURED_PAGES,
        r"""
sc AS (
  SELECT run_id,
    ((sum(CASE WHEN coalesce(title,'') <> '' THEN 1 ELSE 0 END) / count(*)) + 0.0) / 2 AS coverage,
    avg(conf / 2) AS confidence,
    count(DISTINCT url) / count(*) AS redundancy,
    count(*) AS n
  FROM cap_canon GROUP BY run_id
)""",
    ) + """
SELECT s.run_id,
  coalesce(round(coverage, 4), 0.0) AS coverage,
  coalesce(round(confidence, 4), 0.0) AS confidence,
  coalesce(round(redundancy, 4), 0.0) AS redundancy,
  coalesce(round(coverage * 0.4 + confidence * 0.4 + redundancy * 0.2, 4), 0.0) AS total,
  CAST(coalesce(n, 0) AS BIGINT) AS pages
FROM sites s LEFT JOIN sc USING (run_id)"""




# ---------------------------------------------------------------------------
# P9 normalisation and link filters in DuckDB terms
# ---------------------------------------------------------------------------
_URI_D = r"'(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?'"
_ENC_RE = """'[^\\x21-\\x7e]|["<>`{}]'"""


def d_part(e: str, g: int) -> str:
    return f"regexp_extract({e}, {_URI_D}, {g})"


def d_enc(e: str) -> str:
    return (
        f"CASE WHEN regexp_matches({e}, {_ENC_RE}) THEN array_to_string(list_transform("
        f"regexp_extract_all({e}, '(?s).'), lambda c: CASE WHEN c = ' ' THEN '%20' "
        f"WHEN regexp_matches(c, {_ENC_RE}) THEN url_encode(c) ELSE c END), '') ELSE {e} END"
    )


def d_norm(e: str) -> str:
    """P9 serialisation (NULL when not http(s) with a host)."""
    scheme = f"lower({d_part(e, 2)})"
    net = f"lower({d_part(e, 4)})"
    host = f"regexp_extract({net}, '^(?:[^@]*@)?(\\[[^\\]]*\\]|[^:]*)', 1)"
    net2 = (
        f"CASE WHEN ({scheme} = 'http' AND suffix({net}, ':80')) OR ({scheme} = 'https' AND suffix({net}, ':443')) "
        f"THEN regexp_replace({net}, ':[0-9]+$', '') ELSE {net} END"
    )
    rp = d_part(e, 5)
    path = f"CASE WHEN {rp} = '' THEN '/' ELSE {rp} END"
    q = f"CASE WHEN {d_part(e, 6)} <> '' THEN '?' || {d_enc(d_part(e, 7))} ELSE '' END"
    fr = f"CASE WHEN contains({e}, '#') THEN '#' || {d_enc(d_part(e, 9))} ELSE '' END"
    return (
        f"CASE WHEN {scheme} IN ('http', 'https') AND {host} <> '' THEN "
        f"{scheme} || '://' || {net2} || {d_enc(path)} || {q} || {fr} END"
    )


def d_path(e: str) -> str:
    return f"regexp_replace({d_part(e, 5)}, ';[^/]*$', '')"


def d_suffix(path: str) -> str:
    return f"lower(regexp_extract(regexp_extract({path}, '([^/]*)/*$', 1), '^.+(\\.[^.]+)$', 1))"


def d_non_content(path: str) -> str:
    return (
        f"list_has_any(string_split(trim(lower({path}), '/'), '/'), "
        "['login','logout','signup','register','cart','checkout','admin','wp-admin','wp-login','account','search'])"
    )


# Links of every captured page of the link-graph hosts (G1 input):
# original anchors (root-relative in the driver pages) then the fixture's
# navigation anchors, resolved, filtered and deduplicated per page.
_LINKS = r"""
t3 AS (SELECT run_id, hostname FROM sites WHERE length(hostname) % 4 = 3),
pg_cap AS (
  SELECT url_nf AS url_key, arg_max(page_id, page_id) AS page_id
  FROM site_pages GROUP BY url_nf
),
cap_status AS (
  SELECT c.url_key, CASE WHEN p.page_id % 10 = 0 THEN 500 WHEN p.page_id % 11 = 0 THEN 304 ELSE 200 END AS status,
         p.html, p.host, p.i
  FROM pg_cap c JOIN site_pages p USING (page_id)
),
home_cap AS (
  SELECT 'https://' || hostname || '/' AS url_key, 200 AS status, hostname FROM t3
),
orig_href AS (
  SELECT c.url_key AS src, c.host, unnest(regexp_extract_all(c.html, '<a href="([^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(c.html, '<a href="([^"]*)"', 1), 1) AS pos,
         len(regexp_extract_all(c.html, '<a href="([^"]*)"', 1)) AS n_orig
  FROM cap_status c WHERE length(c.host) % 4 = 3
),
n_orig AS (
  SELECT c.url_key AS src, c.host, c.i, len(regexp_extract_all(c.html, '<a href="([^"]*)"', 1)) AS n
  FROM cap_status c WHERE length(c.host) % 4 = 3
),
nav_href AS (
  SELECT o.src, o.host, t.url_nf AS href, o.n + k.k + 1 AS pos
  FROM n_orig o
  CROSS JOIN (VALUES (0, 2, 0), (1, 2, 1), (2, 0, 1)) AS k(k, mul, add)
  JOIN site_pages t ON t.host = o.host AND t.i = CASE WHEN k.mul = 0 THEN 1 ELSE o.i * k.mul + k.add END
),
home_href AS (
  SELECT 'https://' || t3.hostname || '/' AS src, t3.hostname AS host, p.url_nf AS href, 1 AS pos
  FROM t3 JOIN site_pages p ON p.host = t3.hostname AND p.i = 1
),
all_href AS (
  SELECT src, host, CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//')
                         THEN regexp_extract(src, '^[^:/?#]+://[^/?#]*', 0) || href ELSE href END AS link, pos
  FROM (SELECT src, host, href, pos FROM orig_href UNION ALL SELECT * FROM nav_href UNION ALL SELECT * FROM home_href)
),
links AS (
  SELECT src, host, dst, min(pos) AS pos FROM (
    SELECT src, host, pos, """ + d_norm("split_part(link, '#', 1)") + r""" AS dst, link
    FROM all_href
    WHERE (""" + d_part("link", 4) + r""" = '' OR """ + d_part("link", 4) + r""" = host)
      AND split_part(link, '#', 1) <> ''
      AND """ + d_suffix(d_path("link")) + r""" IN ('', '.htm', '.html', '.md', '.txt')
      AND NOT """ + d_non_content(d_path("link")) + r"""
  ) WHERE dst IS NOT NULL GROUP BY src, host, dst
),
expand_status AS (
  SELECT url_key, status FROM cap_status UNION ALL SELECT url_key, status FROM home_cap
),
"""


def _bfs_levels(max_depth: int = 3, budget: int = 100) -> str:
    parts = [
        """
v0 AS (SELECT run_id, hostname, 'https://' || hostname || '/' AS u, 0 AS depth, CAST(0 AS BIGINT) AS rnk FROM t3),
seen0 AS (SELECT run_id, hostname, u, depth, rnk FROM v0)"""
    ]
    for d in range(max_depth + 1):
        parts.append(
            f"""
e{d} AS (
  SELECT v.run_id, v.hostname, v.rnk AS src_rank, l.dst, l.pos, v.u AS src
  FROM v{d} v JOIN expand_status s ON s.url_key = v.u AND s.status = 200
  JOIN links l ON l.src = v.u
)"""
        )
        if d == max_depth:
            break
        parts.append(
            f"""
c{d + 1} AS (
  SELECT e.run_id, e.hostname, e.dst AS u, min(e.src_rank * 1000000 + e.pos) AS k
  FROM e{d} e WHERE NOT EXISTS (SELECT 1 FROM seen{d} s WHERE s.run_id = e.run_id AND s.u = e.dst)
  GROUP BY e.run_id, e.hostname, e.dst
),
v{d + 1} AS (
  SELECT * FROM (
    SELECT c.run_id, c.hostname, c.u, {d + 1} AS depth,
           o.off + row_number() OVER (PARTITION BY c.run_id ORDER BY c.k, c.u) - 1 AS rnk
    FROM c{d + 1} c JOIN (SELECT run_id, count(*) AS off FROM seen{d} GROUP BY run_id) o USING (run_id)
  ) WHERE rnk < {budget}
),
seen{d + 1} AS (SELECT * FROM seen{d} UNION ALL SELECT * FROM v{d + 1})"""
        )
    edges = " UNION ALL ".join(f"SELECT * FROM e{d}" for d in range(max_depth + 1))
    parts.append(
        f"""
bfs_edges AS ({edges}),
bfs_visited AS (SELECT * FROM seen{max_depth}),
bfs_ranked AS (
  SELECT v.run_id, v.u, v.depth, v.rnk, coalesce(c.n, 0) AS inlinks,
         row_number() OVER (PARTITION BY v.run_id ORDER BY coalesce(c.n, 0) DESC, v.depth, v.u) AS importance
  FROM bfs_visited v LEFT JOIN (SELECT run_id, dst, count(*) AS n FROM bfs_edges GROUP BY run_id, dst) c
    ON c.run_id = v.run_id AND c.dst = v.u
)"""
    )
    return ",".join(parts)


# Candidates of every tier from the fixture rules (not by parsing files).
_CANDIDATES = r"""
host_n AS (SELECT host, count(*) AS n FROM site_pages GROUP BY host),
cand AS (
  SELECT s.run_id,
         CASE WHEN p.i % 2 = 1 THEN p.url_nf
              ELSE 'https://' || p.host || regexp_replace(p.url_nf, '^[^:/?#]+://([^/?#]*)', '') END AS raw_url,
         'llms' AS source, {'tier': 1, 'key': [CAST(5 + p.i AS BIGINT)]} AS ord
  FROM site_pages p JOIN sites s ON s.hostname = p.host WHERE p.tier = 0
  UNION ALL
  SELECT run_id, 'https://' || hostname || '/llms-full.txt', 'robots', {'tier': 2, 'key': [CAST(2 AS BIGINT)]}
  FROM sites WHERE length(hostname) % 4 = 1
  UNION ALL
  SELECT s.run_id, p.url_nf, 'sitemap', {'tier': 2, 'key': [CAST(4 AS BIGINT), 1, CAST(p.i - 1 AS BIGINT)]}
  FROM site_pages p JOIN sites s ON s.hostname = p.host WHERE p.tier = 1
  UNION ALL
  SELECT s.run_id, p.url_nf, 'sitemap',
         CASE WHEN h.n > 4 AND p.i % 2 = 1 THEN {'tier': 3, 'key': [CAST(0 AS BIGINT), 0, 1, CAST((p.i - 1) // 2 AS BIGINT)]}
              WHEN h.n > 4 THEN {'tier': 3, 'key': [CAST(0 AS BIGINT), 1, 1, CAST(p.i // 2 - 1 AS BIGINT)]}
              ELSE {'tier': 3, 'key': [CAST(1 AS BIGINT), CAST(p.i - 1 AS BIGINT)]} END
  FROM site_pages p JOIN sites s ON s.hostname = p.host JOIN host_n h ON h.host = p.host WHERE p.tier = 2
  UNION ALL
  SELECT run_id, u, 'crawl', {'tier': 4, 'key': [CAST(importance AS BIGINT)]} FROM bfs_ranked WHERE importance <= 50
),
discovered AS (
  SELECT run_id, url, arg_min(source, ord) AS provenance, min(ord) AS ord FROM (
    SELECT run_id, """ + d_norm("raw_url") + r""" AS url, source, ord FROM cand
  ) WHERE url IS NOT NULL GROUP BY run_id, url
),
pipe_caps AS (
  SELECT url_key, status, """ + _TITLE_EXPR + r""" AS title FROM cap_status
  UNION ALL SELECT url_key, status, hostname FROM home_cap
),
pipe_pages AS (
  SELECT d.run_id, d.url, c.title, CASE WHEN coalesce(c.title, '') <> '' THEN 1.0 ELSE 0.0 END AS conf, d.ord
  FROM discovered d JOIN pipe_caps c ON c.url_key = d.url WHERE c.status = 200
),
pipe_canon AS (
  SELECT run_id, """ + canon("url") + r""" AS url, title, conf, ord FROM pipe_pages
),
canon_pages AS (
  SELECT run_id, url, arg_min(title, {'c': -conf, 'o': ord}) AS title, CAST(NULL AS VARCHAR) AS description, min(ord) AS ord
  FROM pipe_canon GROUP BY run_id, url
),
pipe_links AS (SELECT run_id, count(*) AS links FROM discovered GROUP BY run_id)
"""


def _tiered_ctes() -> str:
    return _LINKS + _bfs_levels() + "," + _CANDIDATES


def _oracle_site_index_tiered() -> str:
    return _with(_tiered_ctes(), _document_sql("canon_pages", "pipe_links")) + _documents_select()



def _pipe(select_sql: str) -> str:
    return _with(_tiered_ctes()) + "\n" + select_sql


def _pipe2(extra: str, select_sql: str) -> str:
    return _with(_tiered_ctes(), extra) + "\n" + select_sql


_HOST_RE = "'^[^:/?#]+://([^/?#]*)'"

STAGE_ORACLES = {
    "d1_llms_links": _pipe(f"""
SELECT s.run_id,
       CASE WHEN p.i % 2 = 1 THEN p.url_nf ELSE 'https://' || p.host || regexp_replace(p.url_nf, {_HOST_RE}, '') END AS raw_url,
       CAST(5 + p.i AS BIGINT) AS line_no
FROM site_pages p JOIN sites s ON s.hostname = p.host WHERE p.tier = 0
UNION ALL
SELECT s.run_id, 'mailto:info@' || h.host, CAST(5 + h.n + 1 AS BIGINT)
FROM host_n h JOIN sites s ON s.hostname = h.host WHERE length(h.host) % 4 = 0"""),
    "d2_robots_hints": _pipe("""
SELECT run_id, 'https://' || hostname || '/llms-full.txt' AS raw_url, CAST(2 AS BIGINT) AS line_no
FROM sites WHERE length(hostname) % 4 = 1"""),
    "d4_sitemap_urls": _pipe("""
SELECT run_id, raw_url, CAST(ord.tier AS BIGINT) AS tier, array_to_string(ord.key, '.') AS ord_key
FROM cand WHERE source = 'sitemap'"""),
    "d4_deep_sitemaps": _with() + """
SELECT substr(sha256(host), 1, 16) AS run_id, url_nf AS raw_url,
       repeat('0.0.', CAST(k AS INTEGER)) || CASE WHEN k < 7 THEN '0.1.1.' ELSE '0.0.1.' END || CAST((i - 1) // 8 AS VARCHAR) AS ord_key
FROM (SELECT host, i, url_nf, (i - 1) % 8 AS k FROM site_pages)""",
    "d4_mutual_sitemaps": _with() + """
SELECT substr(sha256(host), 1, 16) AS run_id, url_nf AS raw_url,
       array_to_string(list_transform(range(1, k + 1), lambda j: '0.' || j || '.'), '') || '0.5.1.' || CAST((i - 1) // 5 AS VARCHAR) AS ord_key
FROM (SELECT host, i, url_nf, (i - 1) % 5 AS k FROM site_pages)""",
    "d6_tier_gate": _pipe("""
SELECT run_id, CASE length(hostname) % 4
    WHEN 0 THEN 'direct_llms,robots_hints' WHEN 1 THEN 'direct_llms,robots_hints'
    WHEN 2 THEN 'direct_llms,robots_hints,sitemap' ELSE 'direct_llms,robots_hints,sitemap,spider' END AS strategies
FROM sites"""),
    "d8_discovered": _pipe("""
SELECT run_id, url, provenance, CAST(ord.tier AS BIGINT) AS tier, array_to_string(ord.key, '.') AS ord_key FROM discovered"""),
    "d9_spider_top": _pipe("""
SELECT run_id, u AS url, CAST(importance AS BIGINT) AS importance, CAST(inlinks AS BIGINT) AS inlinks,
       CAST(depth AS BIGINT) AS depth FROM bfs_ranked WHERE importance <= 50"""),
    "d10_strategy_log": _pipe("""
SELECT s.run_id, 'direct_llms' AS strategy, length(s.hostname) % 4 = 0 AS success,
       CAST(CASE WHEN length(s.hostname) % 4 = 0 THEN NULL ELSE 404 END AS BIGINT) AS status_code,
       CAST(CASE WHEN length(s.hostname) % 4 = 0 THEN h.n ELSE 0 END AS BIGINT) AS urls_found
FROM sites s JOIN host_n h ON h.host = s.hostname
UNION ALL
SELECT s.run_id, 'robots_hints', length(s.hostname) % 4 = 1,
       CASE WHEN length(s.hostname) % 4 = 1 THEN NULL ELSE 404 END,
       CAST(CASE WHEN length(s.hostname) % 4 = 1 THEN h.n + 1 ELSE 0 END AS BIGINT)
FROM sites s JOIN host_n h ON h.host = s.hostname
UNION ALL
SELECT s.run_id, 'sitemap', length(s.hostname) % 4 = 2, NULL,
       CAST(CASE WHEN length(s.hostname) % 4 = 2 THEN h.n ELSE 0 END AS BIGINT)
FROM sites s JOIN host_n h ON h.host = s.hostname WHERE length(s.hostname) % 4 IN (2, 3)
UNION ALL
SELECT run_id, 'spider', count(*) > 0, NULL, CAST(least(count(*), 50) AS BIGINT)
FROM bfs_visited GROUP BY run_id"""),
    "g1_page_links": _pipe("""
SELECT run_id, src, dst, CAST(row_number() OVER (PARTITION BY run_id, src ORDER BY pos) AS BIGINT) AS link_order
FROM bfs_edges"""),
    "g2_bfs_visited": _pipe("""
SELECT v.run_id, v.u AS url, CAST(v.depth AS BIGINT) AS depth, CAST(v.rnk AS BIGINT) AS bfs_rank,
       coalesce(s.status = 200, false) AS expanded
FROM bfs_visited v LEFT JOIN expand_status s ON s.url_key = v.u"""),
    "g2_bfs_budget": _with(_LINKS + _bfs_levels(3, 10)) + """
SELECT run_id, u AS url, CAST(depth AS BIGINT) AS depth, CAST(rnk AS BIGINT) AS bfs_rank FROM bfs_visited""",
    "g3_inlinks": _pipe("""
SELECT run_id, u AS url, CAST(inlinks AS BIGINT) AS inlinks FROM bfs_ranked"""),
    "g4_importance": _pipe("""
SELECT run_id, u AS url, CAST(importance AS BIGINT) AS importance, CAST(inlinks AS BIGINT) AS inlinks,
       CAST(depth AS BIGINT) AS depth FROM bfs_ranked"""),
    "g6_scan_audit": _pipe("""
SELECT v.run_id, v.u AS url, CAST(v.depth AS BIGINT) AS depth,
       CAST((SELECT count(*) FROM bfs_edges e WHERE e.run_id = v.run_id AND e.src = v.u) AS BIGINT) AS links_found,
       CAST((SELECT count(*) FROM bfs_edges e WHERE e.run_id = v.run_id AND e.dst = v.u AND e.src_rank < v.rnk) AS BIGINT) AS inlink_score
FROM bfs_visited v JOIN expand_status s ON s.url_key = v.u AND s.status = 200"""),
    "g7_scan_summary": _pipe("""
SELECT v.run_id, CAST(count(*) AS BIGINT) AS pages_scanned,
       CAST(coalesce(max(u.n), 0) AS BIGINT) AS unique_links_found,
       CAST(3 AS BIGINT) AS max_depth, CAST(100 AS BIGINT) AS max_scan_pages
FROM bfs_visited v LEFT JOIN (SELECT run_id, count(DISTINCT dst) AS n FROM bfs_edges GROUP BY run_id) u USING (run_id)
GROUP BY v.run_id"""),
    "e7_outcomes": _pipe("""
SELECT d.run_id, d.url,
       CASE WHEN coalesce(c.status, 404) = 200 THEN 'extracted' ELSE 'skipped' END AS outcome,
       CASE WHEN c.status = 304 THEN 'not_modified' WHEN coalesce(c.status, 404) <> 200 THEN 'http_error' END AS reason,
       CAST(coalesce(c.status, 404) AS BIGINT) AS status_code
FROM discovered d LEFT JOIN pipe_caps c ON c.url_key = d.url"""),
    "e6_incremental_outcomes": _pipe2("""
lp AS (SELECT * FROM site_pages WHERE page_id IN (SELECT max(page_id) FROM site_pages GROUP BY url_nf)),
vals AS (SELECT url_nf AS url, page_id % 3 = 0 AS same FROM lp WHERE page_id % 3 <> 2)""", """
SELECT d.run_id, d.url,
       CASE WHEN coalesce(v.same, false) OR coalesce(c.status, 404) <> 200 THEN 'skipped' ELSE 'extracted' END AS outcome,
       CASE WHEN coalesce(v.same, false) OR c.status = 304 THEN 'not_modified'
            WHEN coalesce(c.status, 404) <> 200 THEN 'http_error' END AS reason,
       CAST(CASE WHEN coalesce(v.same, false) OR c.status = 304 THEN 304 ELSE coalesce(c.status, 404) END AS BIGINT) AS status_code
FROM discovered d LEFT JOIN pipe_caps c ON c.url_key = d.url LEFT JOIN vals v ON v.url = d.url"""),
    "e6_incremental_pages": _pipe2("""
lp AS (SELECT * FROM site_pages WHERE page_id IN (SELECT max(page_id) FROM site_pages GROUP BY url_nf)),
vals AS (SELECT url_nf AS url, page_id % 3 = 0 AS same FROM lp WHERE page_id % 3 <> 2)""", """
SELECT d.run_id, d.url, c.title, true AS parsed
FROM discovered d JOIN pipe_caps c ON c.url_key = d.url LEFT JOIN vals v ON v.url = d.url
WHERE c.status = 200 AND NOT coalesce(v.same, false)"""),
    "e9_single_page": _pipe(f"""
SELECT 'single' AS run_id, u AS url, title, CASE WHEN coalesce(title, '') <> '' THEN 'title' ELSE 'none' END AS title_source,
       CASE WHEN coalesce(title, '') <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS title_confidence
FROM (SELECT u, {d_norm('u')} AS k FROM (SELECT arg_max(url_nf, page_id) AS u FROM site_pages WHERE page_id % 10 <> 0 AND page_id % 11 <> 0))
JOIN pipe_caps ON url_key = k AND status = 200"""),
    "c2_write_back": _pipe("""
SELECT 'other-' || run_id AS run_id, url, title FROM pipe_pages UNION ALL SELECT run_id, url, title FROM canon_pages"""),
    "l11_batch_spans": _pipe("""
SELECT run_id, 'stage.' || stage AS name, stage AS system, 'success' AS outcome, true AS closed
FROM sites, (SELECT unnest(['discovery', 'extraction', 'canonicalization', 'scoring', 'generation']) AS stage)"""),
    "s5_batch_transitions": _pipe("""
SELECT run_id, stage, CAST(seq AS BIGINT) AS seq, CASE seq WHEN 1 THEN 'queued' WHEN 2 THEN 'processing' END AS from_state,
       CASE seq WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' ELSE 'completed' END AS to_state, 'completed' AS state
FROM sites, (SELECT unnest(['discovery', 'extraction', 'canonicalization', 'scoring', 'generation']) AS stage),
     (SELECT unnest([0, 1, 2]) AS seq)"""),
    "v1_batch_runs": _pipe2("""
sc AS (
  SELECT run_id, ((sum(CASE WHEN coalesce(title,'') <> '' THEN 1 ELSE 0 END) / count(*)) / 2) * 0.4 + avg(conf / 2) * 0.4
                 + (count(DISTINCT """ + canon("url") + """) / count(*)) * 0.2 AS total
  FROM pipe_pages GROUP BY run_id)""", """
SELECT s.run_id, s.hostname, 'completed' AS status, CAST(coalesce(round(total, 4), 0.0) AS DOUBLE) AS score, true AS done
FROM sites s LEFT JOIN sc USING (run_id)"""),
    "e8_pages": _pipe("""
SELECT run_id, url, title, CAST(NULL AS VARCHAR) AS description, d.provenance AS discovery,
       CASE WHEN coalesce(title, '') <> '' THEN 'title' ELSE 'none' END AS title_source,
       CAST(conf AS DOUBLE) AS title_confidence, 'none' AS description_source, CAST(0.0 AS DOUBLE) AS description_confidence
FROM pipe_pages JOIN discovered d USING (run_id, url)"""),
    "e10_validators": _pipe("""
SELECT d.run_id, d.url,
       coalesce(md5(p.html), md5('<!DOCTYPE html><html><head><title>' || h.hostname || '</title></head><body><a href="' ||
                fp.url_nf || '">start</a></body></html>')) AS etag,
       'Mon, 01 Jan 2024 00:00:00 GMT' AS last_modified
FROM discovered d
JOIN pipe_caps c ON c.url_key = d.url AND c.status = 200
LEFT JOIN cap_status p ON p.url_key = d.url
LEFT JOIN home_cap h ON h.url_key = d.url
LEFT JOIN site_pages fp ON fp.host = h.hostname AND fp.i = 1"""),
    "c1_canonical_pages": _pipe("""
SELECT run_id, url, title, CAST(ord.tier AS BIGINT) AS tier, array_to_string(ord.key, '.') AS ord_key FROM canon_pages"""),
    "c3_scores": _pipe2("""
sc AS (
  SELECT run_id,
    (sum(CASE WHEN coalesce(title,'') <> '' THEN 1 ELSE 0 END) / count(*)) / 2 AS coverage,
    avg(conf / 2) AS confidence,
    count(DISTINCT """ + canon("url") + """) / count(*) AS redundancy,
    count(*) AS n
  FROM pipe_pages GROUP BY run_id
)""", """
SELECT s.run_id,
  CAST(coalesce(round(coverage, 4), 0.0) AS DOUBLE) AS coverage,
  CAST(coalesce(round(confidence, 4), 0.0) AS DOUBLE) AS confidence,
  CAST(coalesce(round(redundancy, 4), 0.0) AS DOUBLE) AS redundancy,
  CAST(coalesce(round(coverage * 0.4 + confidence * 0.4 + redundancy * 0.2, 4), 0.0) AS DOUBLE) AS total,
  CAST(coalesce(n, 0) AS BIGINT) AS pages
FROM sites s LEFT JOIN sc USING (run_id)"""),
    "c4_sections": _pipe2(_document_sql("canon_pages", "pipe_links"), """
SELECT run_id, section, CAST(row_number() OVER (PARTITION BY run_id ORDER BY min(ord)) AS BIGINT) AS section_order,
       CAST(count(*) AS BIGINT) AS entries
FROM doc_entries WHERE section IS NOT NULL GROUP BY run_id, section"""),
    "c6_site_meta": _pipe2(_document_sql("canon_pages", "pipe_links"), """
SELECT s.run_id, h.site_title, h.site_description, CAST(coalesce(c.n, 0) AS BIGINT) AS pages_crawled,
       CAST(coalesce(nullif(coalesce(l.links, 0), 0), coalesce(c.n, 0)) AS BIGINT) AS links_discovered
FROM sites s LEFT JOIN doc_home h USING (run_id) LEFT JOIN doc_counts c USING (run_id) LEFT JOIN pipe_links l USING (run_id)"""),
    "c7_artifact_stats": _pipe2(_document_sql("canon_pages", "pipe_links") + """,
docs AS (""" + _documents_select() + """)""", """
SELECT run_id, size_bytes, entry_count,
       CAST(len(string_split(regexp_replace(llms_txt, '\n$', ''), chr(10))) AS BIGINT) AS line_count,
       CAST(len(list_filter(regexp_split_to_array(llms_txt, '\\s+'), lambda w: w <> '')) AS BIGINT) AS word_count
FROM docs"""),
    "l7_discovery_milestone": _pipe("""
SELECT s.run_id, CAST(count(d.url) AS BIGINT) AS pages_discovered,
       coalesce(array_to_string(list_sort(list_distinct(list(provenance) FILTER (WHERE provenance IS NOT NULL))), ','), '') AS strategies_used
FROM sites s LEFT JOIN discovered d USING (run_id) GROUP BY s.run_id"""),
    "l8_extraction_milestone": _pipe("""
SELECT s.run_id,
       CAST(count(d.url) FILTER (WHERE c.status = 200) AS BIGINT) AS pages_extracted,
       CAST(count(d.url) FILTER (WHERE c.status IS DISTINCT FROM 200) AS BIGINT) AS pages_skipped
FROM sites s LEFT JOIN discovered d USING (run_id) LEFT JOIN pipe_caps c ON c.url_key = d.url GROUP BY s.run_id"""),
    "c5_document_lines": _pipe2(_document_sql("canon_pages", "pipe_links") + """,
docs AS (""" + _documents_select() + """)""", """
SELECT run_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_no, unnest(l) AS line
FROM (SELECT run_id, string_split(regexp_replace(llms_txt, '\n$', ''), chr(10)) AS l FROM docs)"""),
    "c5_line_offsets": _pipe2(_document_sql("canon_pages", "pipe_links") + """,
docs AS (""" + _documents_select() + """),
ls AS (
  SELECT run_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_no, unnest(l) AS line
  FROM (SELECT run_id, string_split(regexp_replace(llms_txt, '\n$', ''), chr(10)) AS l FROM docs))""", """
SELECT run_id, line_no, line,
       CAST(sum(strlen(line) + 1) OVER (PARTITION BY run_id ORDER BY line_no) - strlen(line) - 1 AS BIGINT) AS byte_start
FROM ls"""),
    "v11_line_preview": _pipe2(_document_sql("canon_pages", "pipe_links") + """,
docs AS (""" + _documents_select() + """)""", """
SELECT run_id, CAST(len(l) AS BIGINT) AS line_count, len(l) > 20 AS truncated,
       CASE WHEN len(l) > 20 THEN array_to_string(l[1:20], chr(10)) ELSE llms_txt END AS preview
FROM (SELECT run_id, llms_txt, string_split(regexp_replace(llms_txt, '\n$', ''), chr(10)) AS l FROM docs)"""),
    "l9_generation_milestone": _pipe2(_document_sql("canon_pages", "pipe_links") + """,
docs AS (""" + _documents_select() + """)""", """
SELECT run_id, size_bytes AS llmstxt_size_bytes, entry_count, entry_count AS total_pages_indexed FROM docs"""),
}



_DOCS = r"""
dd AS (
  SELECT doc_id, lang, source, text, doc_id % 8 AS k,
         'Document ' || CAST(doc_id AS VARCHAR) || ' (' || source || ')' AS t,
         regexp_replace(text, '^\s+|\s+$', '', 'g') AS d,
         'https://' || lang || '.docs.example.org/' || CAST(doc_id AS VARCHAR) AS url,
         substr(sha256(lang || '.docs.example.org'), 1, 16) AS run_id
  FROM documents
)"""

_PAGE_HREFS = r"""
pc AS (
  SELECT url_nf, arg_max(html, page_id) AS html, arg_max(page_id, page_id) AS page_id FROM site_pages GROUP BY url_nf
),
ph AS (
  SELECT url_nf AS page_url, href, CAST(pos - 1 AS BIGINT) AS pos,
         regexp_extract(url_nf, '^[^:/?#]+://[^/?#]*', 0) || href AS link
  FROM (SELECT url_nf, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
               generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos
        FROM pc WHERE page_id % 10 <> 0 AND page_id % 11 <> 0)
)"""

SCALAR_ORACLES = {
    "e1_signals": _with(_DOCS) + """
SELECT url, true AS has_head, CASE WHEN k IN (0, 4, 7) THEN t END AS title,
       CAST(1 + CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 5 THEN 1 WHEN 7 THEN 3 ELSE 0 END AS BIGINT) AS meta_count,
       CASE WHEN k = 3 THEN t END AS ld_headline, CASE WHEN k = 3 THEN d END AS ld_description
FROM dd""",
    "e2_cascade": _with(_DOCS) + """
SELECT url,
  CASE WHEN k IN (5, 6) THEN NULL ELSE t END AS title,
  CASE k WHEN 0 THEN 'title' WHEN 1 THEN 'og:title' WHEN 2 THEN 'twitter:title' WHEN 3 THEN 'jsonld:headline'
         WHEN 4 THEN 'title' WHEN 7 THEN 'title' ELSE 'none' END AS title_source,
  CAST(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.75 WHEN 3 THEN 0.6 WHEN 4 THEN 1.0 WHEN 7 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS title_confidence,
  CASE WHEN k IN (4, 6) THEN NULL ELSE d END AS description,
  CASE k WHEN 0 THEN 'meta:description' WHEN 1 THEN 'og:description' WHEN 2 THEN 'twitter:description'
         WHEN 3 THEN 'jsonld:description' WHEN 5 THEN 'meta:description' WHEN 7 THEN 'og:description' ELSE 'none' END AS description_source,
  CAST(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.75 WHEN 3 THEN 0.6 WHEN 5 THEN 1.0 WHEN 7 THEN 0.8 ELSE 0.0 END AS DOUBLE) AS description_confidence
FROM dd""",
    "e11_page_events": _with(_DOCS) + """
SELECT substr(sha256(run_id || '|' || url || '|extraction'), 1, 32) AS id, run_id,
       'extraction.page_extracted' AS name, 'extraction' AS system, url,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS started_at, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS completed_at,
       CASE k WHEN 0 THEN 'title' WHEN 1 THEN 'og:title' WHEN 2 THEN 'twitter:title' WHEN 3 THEN 'jsonld:headline'
              WHEN 4 THEN 'title' WHEN 7 THEN 'title' ELSE 'none' END AS title_source,
       CASE WHEN k IN (4, 6) THEN NULL ELSE substr(d, 1, 120) END AS description,
       CASE k WHEN 0 THEN 'meta:description' WHEN 1 THEN 'og:description' WHEN 2 THEN 'twitter:description'
              WHEN 3 THEN 'jsonld:description' WHEN 5 THEN 'meta:description' WHEN 7 THEN 'og:description' ELSE 'none' END AS description_source
FROM dd""",
    "p1_url_parts": _with() + f"""
SELECT page_id, lower({d_part('url', 2)}) AS scheme, {d_part('url', 4)} AS netloc,
       regexp_replace({d_part('url', 5)}, ';[^/]*$', '') AS path,
       CASE WHEN {d_part('url', 6)} <> '' THEN {d_part('url', 7)} END AS query,
       CASE WHEN contains(url, '#') THEN {d_part('url', 9)} END AS fragment
FROM pages""",
    "p2_resolve_hrefs": _with(_PAGE_HREFS) + """
SELECT page_url, pos, href, link AS resolved FROM ph""",
    "p3_canonical": _with() + f"""
SELECT page_id, url, {canon('url')} AS canonical_url FROM pages""",
    "p4_link_filters": _with(_PAGE_HREFS) + f"""
SELECT page_url, pos, link, split_part(link, '#', 1) AS link_no_fragment,
       ({d_part('link', 4)} = '' OR {d_part('link', 4)} = {d_part('page_url', 4)}) AS same_domain,
       {d_suffix(d_path('link'))} AS suffix,
       {d_suffix(d_path('link'))} IN ('', '.htm', '.html', '.md', '.txt') AS extension_allowed,
       {d_non_content(d_path('link'))} AS non_content
FROM ph""",
    "p8_section_names": _with() + f"""
SELECT page_id, {canon('url')} AS url,
       {section_of(canon('url'), "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)")} AS section
FROM pages""",
    "p9_normalized_links": _with(_PAGE_HREFS) + f"""
SELECT page_url, pos, link, lower({d_part('link', 2)}) IN ('http', 'https') AS valid, {d_norm('link')} AS normalized FROM ph""",
    "p10_home_pages": _pipe("""
SELECT c.run_id, c.url, regexp_replace(c.url, '/+$', '') = 'https://' || s.hostname AS is_home
FROM canon_pages c JOIN sites s USING (run_id)"""),
    "p11_lines": _with() + r"""
SELECT doc_id, CAST(generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), 1) - 1 AS BIGINT) AS line_no,
       unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS line
FROM documents""",
    "p12_content_types": _pipe("""
SELECT url_nf AS url, 'text/html; charset=utf-8' AS content_type, true AS is_text FROM site_pages
UNION ALL SELECT 'https://' || host || '/llms.txt', 'text/plain', true FROM host_n WHERE length(host) % 4 = 0
UNION ALL SELECT 'https://' || host || '/robots.txt', 'text/plain', true FROM host_n WHERE length(host) % 4 = 1
UNION ALL SELECT 'https://' || host || '/sitemap-pages.xml', 'application/xml', false FROM host_n WHERE length(host) % 4 = 1
UNION ALL SELECT 'https://' || host || '/sitemap.xml', 'application/xml', false FROM host_n WHERE length(host) % 4 = 2
UNION ALL SELECT 'https://' || host || '/sitemap-odd.xml', 'application/xml', false FROM host_n WHERE length(host) % 4 = 2 AND n > 4
UNION ALL SELECT 'https://' || host || '/sitemap-even.xml', 'application/xml', false FROM host_n WHERE length(host) % 4 = 2 AND n > 4
UNION ALL SELECT 'https://' || host, 'text/html; charset=utf-8', true FROM host_n WHERE length(host) % 4 = 3"""),
    "p13_entry_titles": _pipe("""
SELECT run_id, url, coalesce(nullif(title, ''), url) AS entry_title FROM canon_pages"""),
}


_AUDIT = r"""
sl AS (
  SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id, event_id, user_id, value,
    CASE event_type WHEN 'view' THEN 'discovery' WHEN 'click' THEN 'extraction' WHEN 'signup' THEN 'canonicalization'
                    WHEN 'purchase' THEN 'scoring' WHEN 'error' THEN 'generation' END AS stage,
    ts AS started_at,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS completed_at,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(json_extract_string(props, '$.k') AS INTEGER) < 5 AS failed
  FROM events
),
ce AS (
  SELECT 'ev-' || CAST(event_id AS VARCHAR) AS id, run_id, 'stage.' || stage AS name, stage AS system, started_at, completed_at,
    CASE WHEN completed_at IS NULL THEN '{}'
         WHEN failed THEN '{"error": "stage failed: k=' || CAST(k AS VARCHAR) || '", "outcome": "failure"}'
         ELSE '{"outcome": "success"}' END AS metadata,
    CASE WHEN completed_at IS NULL THEN NULL WHEN failed THEN 'failure' ELSE 'success' END AS outcome,
    date_diff('microsecond', started_at, completed_at) / 1000000.0 AS dur, k
  FROM sl
),
ragg AS (
  SELECT run_id, user_id, min(started_at) AS first, max(coalesce(completed_at, started_at)) AS last,
         sum(CASE WHEN failed THEN 1 ELSE 0 END) AS failures, avg(value) AS avg_value
  FROM sl GROUP BY run_id, user_id
),
runs AS (
  SELECT run_id, 'site' || CAST(user_id AS VARCHAR) || '.example.com' AS hostname,
    'https://site' || CAST(user_id AS VARCHAR) || '.example.com' AS target_url,
    CASE WHEN user_id % 17 = 0 THEN 'running' WHEN failures > 3 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN user_id % 17 <> 0 AND failures <= 3 THEN round(avg_value / 500, 4) END AS score,
    first - INTERVAL 1 SECOND AS created_at,
    CASE WHEN user_id % 17 = 0 THEN NULL ELSE last END AS completed_at, user_id
  FROM ragg
),
items AS (
  SELECT 'wi-' || CAST(event_id AS VARCHAR) AS id, run_id, stage,
    CASE WHEN completed_at IS NULL THEN 'processing' WHEN failed THEN 'failed' ELSE 'completed' END AS state,
    CASE WHEN completed_at IS NOT NULL AND failed THEN 'stage failed: k=' || CAST(k AS VARCHAR) END AS last_error,
    started_at AS created_at, coalesce(completed_at, started_at) AS updated_at
  FROM sl
  UNION ALL
  SELECT 'wi-q-' || CAST(user_id AS VARCHAR), run_id, 'discovery', 'queued', NULL, created_at, created_at FROM runs
),
tr AS (
  SELECT 'wi-' || CAST(event_id AS VARCHAR) AS work_item_id, NULL AS from_state, 'queued' AS to_state, started_at AS created_at, 0 AS seq FROM sl
  UNION ALL SELECT 'wi-' || CAST(event_id AS VARCHAR), 'queued', 'processing', started_at, 1 FROM sl
  UNION ALL SELECT 'wi-' || CAST(event_id AS VARCHAR), 'processing', CASE WHEN failed THEN 'failed' ELSE 'completed' END, completed_at, 2
            FROM sl WHERE completed_at IS NOT NULL
  UNION ALL SELECT 'wi-' || CAST(event_id AS VARCHAR), CASE WHEN failed THEN 'failed' ELSE 'completed' END, 'processing',
            completed_at + INTERVAL 1 SECOND, 3 FROM sl WHERE completed_at IS NOT NULL AND event_id % 997 = 0
  UNION ALL SELECT 'wi-q-' || CAST(user_id AS VARCHAR), NULL, 'queued', created_at, 0 FROM runs
),
arts AS (
  SELECT r.run_id, '# ' || r.hostname || chr(10) || chr(10) || '> Activity of ' || r.hostname || chr(10) || chr(10) ||
         '## Events' || chr(10) || chr(10) ||
         string_agg('- [' || sl.stage || ' ' || CAST(sl.event_id AS VARCHAR) || '](https://' || r.hostname || '/e/' ||
                    CAST(sl.event_id AS VARCHAR) || ')', chr(10) ORDER BY sl.event_id) || chr(10) AS llms_txt
  FROM runs r JOIN sl USING (run_id) WHERE r.status = 'completed' GROUP BY r.run_id, r.hostname
)"""


def _tenths(units: str, per: int, suffix: str) -> str:
    q = f"({units} // {per})"
    r = f"({units} - {q} * {per})"
    t = f"(CASE WHEN {r} * 2 > {per} THEN {q} + 1 WHEN {r} * 2 = {per} THEN {q} + {q} % 2 ELSE {q} END)"
    return f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '{suffix}'"


def _ms_label_d(ms: str) -> str:
    return f"CASE WHEN {ms} < 1000 THEN CAST({ms} AS VARCHAR) || 'ms' ELSE {_tenths(ms, 100, 's')} END"


_STAGE_STATES = """
ss AS (
  SELECT r.run_id, st.stage_no, st.label,
    CASE WHEN coalesce(f.f, 0) = 1 THEN 'failed' WHEN coalesce(f.p, 0) = 1 THEN 'active'
         WHEN coalesce(f.c, 0) = 1 THEN 'done' ELSE 'pending' END AS state
  FROM runs r
  CROSS JOIN (VALUES (0, 'discovery', 'Discovery'), (1, 'extraction', 'Extraction'), (2, 'canonicalization', 'Canonicalize'),
                     (3, 'scoring', 'Scoring'), (4, 'generation', 'Generation')) st(stage_no, stage, label)
  LEFT JOIN (SELECT run_id, stage, max(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) AS f,
                    max(CASE WHEN state = 'processing' THEN 1 ELSE 0 END) AS p,
                    max(CASE WHEN state = 'completed' THEN 1 ELSE 0 END) AS c
             FROM items GROUP BY run_id, stage) f ON f.run_id = r.run_id AND f.stage = st.stage
)"""


def _audit(select_sql: str, extra: str = "") -> str:
    parts = [_AUDIT] + ([extra] if extra else [])
    return _with(*parts) + "\n" + select_sql


_MS = "CAST(trunc(dur * 1000) AS BIGINT)"
_MS_ITEM = "CAST(trunc(date_diff('microsecond', created_at, updated_at) / 1000000.0 * 1000) AS BIGINT)"

AUDIT_ORACLES = {
    "s1_accept_targets": _with(_PAGE_HREFS) + f"""
SELECT 'p' || page_id AS submission_id, url, true AS accepted, substr(sha256('p' || page_id || '|' || url), 1, 16) AS run_id,
       {d_part('url', 4)} AS hostname, CAST(NULL AS VARCHAR) AS reason
FROM pages
UNION ALL
SELECT 'h' || pos || '@' || page_url, href, false, NULL, NULL,
       CASE WHEN NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN 'missing scheme' ELSE 'missing host' END
FROM ph""",
    "s1_work_items": _with() + """
SELECT 'wi-' || substr(sha256('p' || page_id || '|' || url), 1, 16) AS id, substr(sha256('p' || page_id || '|' || url), 1, 16) AS run_id,
       'discovery' AS stage, 'queued' AS state, url, CAST(0 AS BIGINT) AS attempt_count, CAST(100 AS BIGINT) AS priority
FROM pages""",
    "l1_transition_violations": _audit("""
SELECT work_item_id, from_state, to_state, created_at FROM tr
WHERE from_state IS NOT NULL
  AND NOT (from_state = 'queued' AND to_state IN ('processing', 'failed'))
  AND NOT (from_state = 'processing' AND to_state IN ('completed', 'failed'))"""),
    "l2_state_gauge": _audit("""
SELECT state, CAST(sum(d) AS BIGINT) AS items FROM (
  SELECT to_state AS state, 1 AS d FROM tr UNION ALL SELECT from_state, -1 FROM tr WHERE from_state IS NOT NULL
) GROUP BY state"""),
    "l3_run_outcomes": _audit("""
SELECT CASE WHEN status = 'completed' THEN 'success' ELSE 'failure' END AS outcome, CAST(count(*) AS BIGINT) AS runs
FROM runs WHERE status IN ('completed', 'failed') GROUP BY 1"""),
    "l4_stage_outcomes": _audit("""
SELECT system AS stage, outcome, CAST(count(*) AS BIGINT) AS executions FROM ce WHERE completed_at IS NOT NULL GROUP BY 1, 2"""),
    "l5_stage_durations": _audit("""
SELECT system AS stage, CAST(count(*) AS BIGINT) AS executions, round(sum(dur), 6) AS total_seconds,
       round(avg(dur), 6) AS avg_seconds, round(quantile_cont(dur, 0.5), 6) AS p50_seconds,
       round(quantile_cont(dur, 0.95), 6) AS p95_seconds,
       CAST(sum(CASE WHEN dur <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS le_1s,
       CAST(sum(CASE WHEN dur > 1 AND dur <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS le_10s,
       CAST(sum(CASE WHEN dur > 10 AND dur <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS le_60s,
       CAST(sum(CASE WHEN dur > 60 AND dur <= 300 THEN 1 ELSE 0 END) AS BIGINT) AS le_300s,
       CAST(sum(CASE WHEN dur > 300 THEN 1 ELSE 0 END) AS BIGINT) AS gt_300s
FROM ce WHERE outcome = 'success' GROUP BY system"""),
    "l6_business_metrics": _audit("""
SELECT CAST(count(*) AS BIGINT) AS completed_runs, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS pages_indexed_total,
       round(avg(rs), 6) AS avg_run_seconds, round(quantile_cont(rs, 0.5), 6) AS p50_run_seconds, round(max(rs), 6) AS max_run_seconds,
       round(avg(strlen(a.llms_txt)), 6) AS avg_artifact_bytes, CAST(max(strlen(a.llms_txt)) AS BIGINT) AS max_artifact_bytes
FROM (SELECT run_id, date_diff('microsecond', created_at, completed_at) / 1000000.0 AS rs FROM runs WHERE status = 'completed') r
LEFT JOIN (SELECT run_id, count(*) AS n FROM ce WHERE system = 'extraction' AND completed_at IS NOT NULL GROUP BY run_id) p USING (run_id)
LEFT JOIN arts a USING (run_id)"""),
    "l12_event_durations": _audit("SELECT id, run_id, dur AS duration FROM ce"),
    "l13_log_lines": _audit("""
SELECT id, '{"name":"' || name || '"' || CASE WHEN outcome IS NOT NULL THEN ',"outcome":"' || outcome || '"' ELSE '' END ||
           ',"run_id":"' || run_id || '","system":"' || system || '"}' AS line FROM ce"""),
    "l14_failure_codes": _audit("""
SELECT failure_class, CAST(http_code AS BIGINT) AS http_code, CAST(n AS BIGINT) AS occurrences FROM (
  SELECT 'invalid_input' AS failure_class, 422 AS http_code, (SELECT count(*) FROM ph) AS n
  UNION ALL SELECT 'not_found', 404,
    (SELECT count(DISTINCT event_id) FROM events) + (SELECT count(*) FROM (SELECT DISTINCT 'run-' || user_id AS run_id FROM events) q
      WHERE q.run_id NOT IN (SELECT run_id FROM arts))
  UNION ALL SELECT 'stage_failure', 500, (SELECT count(*) FROM ce WHERE outcome = 'failure')
) WHERE n > 0""", _PAGE_HREFS),
    "v1_run_status": _audit("SELECT run_id, hostname, status, score, created_at, completed_at FROM runs"),
    "v2_history": _audit("SELECT run_id, hostname, status, created_at FROM runs ORDER BY created_at DESC, run_id LIMIT 50"),
    "v3_work_items": _audit("""
SELECT run_id, id, stage, state, created_at FROM items ORDER BY run_id, created_at, id"""),
    "v4_events": _audit("""
SELECT run_id, id, name, started_at, dur AS duration FROM ce ORDER BY run_id, started_at, id"""),
    "v5_artifacts": _audit("SELECT run_id, llms_txt FROM arts"),
    "v6_stage_states": _audit("""
SELECT r.run_id, st.stage, CAST(st.stage_no AS BIGINT) AS stage_no,
  CASE WHEN coalesce(f.f, 0) = 1 THEN 'failed' WHEN coalesce(f.p, 0) = 1 THEN 'active'
       WHEN coalesce(f.c, 0) = 1 THEN 'done' ELSE 'pending' END AS state
FROM runs r
CROSS JOIN (VALUES (0, 'discovery'), (1, 'extraction'), (2, 'canonicalization'), (3, 'scoring'), (4, 'generation')) st(stage_no, stage)
LEFT JOIN (SELECT run_id, stage, max(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) AS f,
                  max(CASE WHEN state = 'processing' THEN 1 ELSE 0 END) AS p,
                  max(CASE WHEN state = 'completed' THEN 1 ELSE 0 END) AS c
           FROM items GROUP BY run_id, stage) f ON f.run_id = r.run_id AND f.stage = st.stage"""),
    "v7_current_stage": _audit("""
SELECT run_id, coalesce(arg_max(CASE state WHEN 'active' THEN '▶' WHEN 'done' THEN '✓' ELSE '✗' END || ' ' || label, stage_no)
                        FILTER (WHERE state <> 'pending'), 'queued') AS label
FROM ss GROUP BY run_id""", _STAGE_STATES),
    "v8_timeline": _audit(f"""
SELECT run_id, stage, it.id AS item_id, it.state AS state,
       {_ms_label_d("CAST(trunc(date_diff('microsecond', it.created_at, it.updated_at) / 1000000.0 * 1000) AS BIGINT)")} AS duration_label,
       it.last_error AS last_error
FROM (
  SELECT run_id, stage,
         arg_max({{'id': id, 'state': state, 'created_at': created_at, 'updated_at': updated_at, 'last_error': last_error}},
                 {{'live': state <> 'queued', 'pos': CASE WHEN state = 'queued' THEN -o ELSE o END}}) AS it
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at, id) AS o FROM items)
  GROUP BY run_id, stage
)"""),
    "v9_recent_events": _audit(f"""
SELECT run_id, id, CAST(recent_rank AS BIGINT) AS recent_rank, strftime(started_at, '%H:%M:%S') AS time, name, system,
       CASE WHEN dur IS NULL THEN '' ELSE {_ms_label_d(_MS)} END AS duration_label,
       CASE WHEN outcome IS NULL THEN '' WHEN outcome = 'failure' THEN 'error=stage failed: k=' || CAST(k AS VARCHAR) || ' outcome=failure'
            ELSE 'outcome=success' END AS meta
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, id DESC) AS recent_rank FROM ce)
WHERE recent_rank <= 8"""),
    "v10_event_table": _audit("""
SELECT run_id, id, strftime(started_at, '%H:%M:%S') AS time, name, system,
       CASE WHEN dur IS NULL OR dur = 0 THEN NULL ELSE CAST(round(dur * 1000) AS BIGINT) END AS duration_ms,
       CASE WHEN outcome IS NULL THEN '' WHEN outcome = 'failure' THEN 'error=stage failed: k=' || CAST(k AS VARCHAR) || ', outcome=failure'
            ELSE 'outcome=success' END AS details
FROM ce"""),
    "v11_artifact_preview": _audit("""
SELECT run_id, CAST(len(string_split(regexp_replace(llms_txt, '\n$', ''), chr(10))) AS BIGINT) AS line_count,
       CAST(len(list_filter(regexp_split_to_array(llms_txt, '\\s+'), lambda w: w <> '')) AS BIGINT) AS word_count,
       len(string_split(regexp_replace(llms_txt, '\n$', ''), chr(10))) > 1000 AS truncated,
       llms_txt AS preview
FROM arts"""),
    "v12_run_groups": _audit("""
SELECT run_id, status, CASE WHEN status IN ('queued', 'running') THEN 'active' ELSE 'history' END AS "group" FROM runs"""),
    "v13_status_summary": _audit("""
SELECT total, completed, failed, in_progress,
       printf('%d/%d completed, %d failed, %d in progress', completed, total, failed, in_progress) AS summary,
       CAST(CASE WHEN failed > 0 THEN 1 WHEN in_progress > 0 THEN 2 ELSE 0 END AS BIGINT) AS exit_code
FROM (SELECT CAST(count(*) AS BIGINT) AS total,
             CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
             CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
             CAST(sum(CASE WHEN status IN ('running', 'queued') THEN 1 ELSE 0 END) AS BIGINT) AS in_progress FROM runs)"""),
    "v14_stage_events": _audit(f"""
SELECT run_id, id, name, CAST(from_end AS BIGINT) AS from_end,
       CASE WHEN dur IS NULL OR dur = 0 THEN '--' ELSE CAST({_MS} AS VARCHAR) || 'ms' END AS duration_label,
       coalesce(outcome, '?') AS outcome
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, id DESC) AS from_end FROM ce
      WHERE name LIKE 'stage.%') WHERE from_end <= 5"""),
    "v15_run_labels": _audit(f"""
SELECT run_id,
  CASE WHEN secs < 60 THEN CAST(secs AS VARCHAR) || 's'
       WHEN secs < 3600 THEN CAST(secs // 60 AS VARCHAR) || 'm ' || CAST(secs % 60 AS VARCHAR) || 's'
       ELSE CAST(secs // 3600 AS VARCHAR) || 'h ' || CAST((secs % 3600) // 60 AS VARCHAR) || 'm' END AS elapsed,
  {_tenths("CAST(round(coalesce(score, 0.0) * 10000) AS BIGINT)", 10, "%")} AS score_label
FROM (SELECT run_id, score, CAST(floor(date_diff('microsecond', created_at, TIMESTAMP '2024-02-01 00:00:00') / 1000000.0) AS BIGINT) AS secs
      FROM runs)"""),
}


STREAM_ORACLES = {
    "r1_dedup_events": _audit("SELECT id, run_id, name, started_at FROM ce"),
    "r2_stage_throughput": _audit("""
SELECT date_trunc('day', started_at) AS window_start, date_trunc('day', started_at) + INTERVAL 1 DAY AS window_end,
       system AS stage, CAST(count(*) AS BIGINT) AS executions,
       CAST(sum(CASE WHEN outcome = 'failure' THEN 1 ELSE 0 END) AS BIGINT) AS failures
FROM ce GROUP BY 1, 2, 3"""),
    "r2_sliding": _audit("""
SELECT ws AS window_start, ws + INTERVAL 2 HOUR AS window_end, system AS stage, CAST(count(*) AS BIGINT) AS executions,
       CAST(sum(CASE WHEN outcome = 'failure' THEN 1 ELSE 0 END) AS BIGINT) AS failures
FROM (SELECT system, outcome, unnest([date_trunc('hour', started_at), date_trunc('hour', started_at) - INTERVAL 1 HOUR]) AS ws FROM ce)
GROUP BY 1, 2, 3"""),
    "r3_activity_sessions": _audit("""
SELECT run_id, min(started_at) AS session_start, max(started_at) + INTERVAL 30 MINUTE AS session_end, CAST(count(*) AS BIGINT) AS events
FROM (
  SELECT run_id, started_at, sum(brk) OVER (PARTITION BY run_id ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS sess
  FROM (SELECT run_id, id, started_at,
               CASE WHEN lag(started_at) OVER (PARTITION BY run_id ORDER BY started_at, id) IS NULL
                      OR started_at - lag(started_at) OVER (PARTITION BY run_id ORDER BY started_at, id) >= INTERVAL 30 MINUTE
                    THEN 1 ELSE 0 END AS brk
        FROM ce)
) GROUP BY run_id, sess"""),
    "r4_incremental_recrawl": _with("""
lp AS (SELECT url_nf, arg_max(page_id, page_id) AS page_id FROM site_pages GROUP BY url_nf)""") + """
SELECT p.url_nf AS url, """ + _TITLE_EXPR + """ AS title
FROM lp JOIN site_pages p USING (page_id)
WHERE p.page_id % 10 <> 0 AND p.page_id % 11 <> 0 AND p.page_id % 3 <> 0""",
    "r5_latest_item_state": _audit("""
SELECT work_item_id, arg_max(to_state, {'t': created_at, 's': seq}) AS state FROM tr GROUP BY work_item_id"""),
}


STORE_ORACLES = {
    "s11_read_pages": _pipe("""
SELECT run_id, url, title, d.provenance AS discovery,
       CASE WHEN coalesce(title, '') <> '' THEN 'title' ELSE 'none' END AS title_source, CAST(conf AS DOUBLE) AS title_confidence
FROM pipe_pages JOIN discovered d USING (run_id, url)"""),
    "l10_run_milestone": _audit("""
SELECT r.run_id, CAST(coalesce(p.n, 0) AS BIGINT) AS total_pages_indexed,
       date_diff('microsecond', r.created_at, r.completed_at) / 1000000.0 AS duration_seconds,
       CAST(strlen(a.llms_txt) AS BIGINT) AS llmstxt_size_bytes
FROM runs r
LEFT JOIN (SELECT run_id, count(*) AS n FROM ce WHERE system = 'extraction' AND completed_at IS NOT NULL GROUP BY run_id) p USING (run_id)
LEFT JOIN arts a USING (run_id)
WHERE r.status = 'completed'"""),
    "l11_span_records": _audit("""
SELECT id, run_id, name, system, outcome,
       CASE WHEN outcome = 'failure' THEN 'stage failed: k=' || CAST(k AS VARCHAR) END AS error FROM ce"""),
    "s2_fetch": _pipe("""
SELECT d.run_id, d.url, CAST(coalesce(c.status, 404) AS BIGINT) AS status_code,
       CASE WHEN c.status IS NOT NULL THEN 'text/html; charset=utf-8' END AS content_type
FROM discovered d LEFT JOIN pipe_caps c ON c.url_key = d.url"""),
    "s3_site_list": _with() + """
SELECT CASE length(host) % 4 WHEN 0 THEN 'llms_txt' WHEN 1 THEN 'robots_hints' ELSE 'sitemap' END AS category,
       host AS site_id, 'https://' || host AS url
FROM (SELECT DISTINCT host FROM sp0) WHERE length(host) % 4 <> 3""",
    "s4_run_upsert": _audit("""
SELECT run_id, hostname, CASE WHEN status = 'running' THEN 'completed' ELSE status END AS status,
       CASE WHEN status = 'running' THEN 0.5 ELSE score END AS score, created_at,
       CASE WHEN status = 'running' THEN created_at + INTERVAL 1 DAY ELSE completed_at END AS completed_at
FROM runs
UNION ALL
SELECT 'run-new-' || event_type, NULL, 'queued', NULL, TIMESTAMP '2024-02-01 00:00:00', NULL FROM (SELECT DISTINCT event_type FROM events)"""),
    "s5_item_transitions": _audit("""
SELECT 'wi-' || CAST(event_id AS VARCHAR) AS work_item_id, NULL AS from_state, 'queued' AS to_state, started_at AS created_at FROM sl
UNION ALL SELECT 'wi-' || CAST(event_id AS VARCHAR), 'queued', 'processing', started_at + INTERVAL 1 MICROSECOND FROM sl
UNION ALL SELECT 'wi-' || CAST(event_id AS VARCHAR), 'processing', CASE WHEN failed THEN 'failed' ELSE 'completed' END, completed_at
          FROM sl WHERE completed_at IS NOT NULL"""),
    "s6_insert_ignore": _with() + """
SELECT DISTINCT substr(sha256(host), 1, 16) AS run_id, url_nf AS url FROM site_pages p
WHERE page_id % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM site_pages e WHERE e.page_id % 2 = 0 AND e.url_nf = p.url_nf AND e.host = p.host)""",
    "s7_page_upsert": _with(_DOCS) + """
SELECT url, CASE WHEN doc_id % 6 = 0 THEN 'a later v3: ' || t WHEN doc_id % 3 = 0 THEN 'v2: ' || t ELSE t END AS title FROM dd""",
    "s8_validators": _with("""
lp AS (SELECT * FROM site_pages WHERE page_id IN (SELECT max(page_id) FROM site_pages GROUP BY url_nf))""") + """
SELECT url_nf AS url, md5(html) AS etag, 'Mon, 01 Jan 2024 00:00:00 GMT' AS last_modified
FROM lp WHERE page_id % 10 <> 0 AND page_id % 11 <> 0
UNION ALL
SELECT url_nf, CASE WHEN page_id % 3 = 0 THEN md5(html) ELSE 'stale-' || CAST(page_id AS VARCHAR) END, NULL
FROM lp WHERE page_id % 3 <> 2 AND NOT (page_id % 10 <> 0 AND page_id % 11 <> 0)""",
    "s9_artifact_replace": _audit("""
SELECT run_id, CAST(strlen(t) AS BIGINT) AS size_bytes, split_part(t, chr(10), 1) AS first_line FROM (
  SELECT run_id, CASE WHEN CAST(split_part(run_id, '-', 2) AS BIGINT) % 2 = 0 THEN upper(llms_txt) ELSE llms_txt END AS t FROM arts)"""),
    "s10_event_log": _audit("""
SELECT id, run_id, name, system, started_at, completed_at, true AS valid_json FROM ce
UNION ALL
SELECT substr(sha256(run_id || '|' || url || '|extraction'), 1, 32), run_id, 'extraction.page_extracted', 'extraction',
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), true
FROM dd""", _DOCS),
}


_BODY_LEN = """
nav_len AS (SELECT src, 11 + sum(19 + strlen(href)) AS n FROM nav_href GROUP BY src),
body_len AS (
  SELECT c.url_key, strlen(c.html) + coalesce(n.n, 0) AS bytes FROM cap_status c LEFT JOIN nav_len n ON n.src = c.url_key
  UNION ALL
  SELECT h.url_key, strlen('<!DOCTYPE html><html><head><title>' || h.hostname || '</title></head><body><a href="' ||
                           fp.url_nf || '">start</a></body></html>')
  FROM home_cap h JOIN site_pages fp ON fp.host = h.hostname AND fp.i = 1
)"""

INSIGHT_ORACLES = {
    "x1_url_clusters": _pipe(f"""
SELECT run_id, url, canonical_url, substr(sha256(run_id || '|' || canonical_url), 1, 16) AS cluster_id,
       CAST(count(*) OVER (PARTITION BY run_id, canonical_url) AS BIGINT) AS cluster_size
FROM (SELECT run_id, url, {canon('url')} AS canonical_url FROM pipe_pages)"""),
    "x1_dedup_summary": _pipe(f"""
SELECT run_id, CAST(sum(n) AS BIGINT) AS raw_pages, CAST(count(*) AS BIGINT) AS canonical_pages,
       round(1 - count(*) / sum(n), 4) AS dedup_ratio, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicts
FROM (SELECT run_id, {canon('url')} AS c, count(*) AS n FROM pipe_pages GROUP BY 1, 2) GROUP BY run_id"""),
    "x2_link_audit": _with(_PAGE_HREFS) + f"""
SELECT page_url, pos, link,
       CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY page_url, split_part(link, '#', 1), reason IS NULL ORDER BY pos) > 1
            THEN 'duplicate' ELSE reason END AS reason
FROM (SELECT page_url, pos, link,
        CASE WHEN {d_part('link', 4)} <> '' AND {d_part('link', 4)} <> {d_part('page_url', 4)} THEN 'external'
             WHEN split_part(link, '#', 1) = '' THEN 'empty'
             WHEN {d_suffix(d_path('link'))} NOT IN ('', '.htm', '.html', '.md', '.txt') THEN 'extension_filtered'
             WHEN {d_non_content(d_path('link'))} THEN 'non_content_path' END AS reason
      FROM ph)""",
    "x2_scan_skips": f"""
SELECT e.run_id, e.src, e.dst, CASE WHEN s.depth >= 3 THEN 'depth_exceeded' ELSE 'page_budget' END AS reason
FROM ({STAGE_ORACLES["g1_page_links"]}) e
JOIN ({STAGE_ORACLES["g2_bfs_visited"]}) s ON s.run_id = e.run_id AND s.url = e.src
LEFT JOIN ({STAGE_ORACLES["g2_bfs_visited"]}) t ON t.run_id = e.run_id AND t.url = e.dst
WHERE t.url IS NULL""",
    "x4_fallback_depth": f"""
SELECT run_id, CAST(count(*) AS BIGINT) AS attempts,
       CAST(min(CASE WHEN success THEN list_position(['direct_llms', 'robots_hints', 'sitemap', 'spider'], strategy) END) AS BIGINT) AS fallback_depth
FROM ({STAGE_ORACLES["d10_strategy_log"]}) GROUP BY run_id""",
    "x10_run_compare": _pipe("""
SELECT run_id, url, CASE length(url) % 3 WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' ELSE 'same' END AS change FROM canon_pages
UNION ALL SELECT DISTINCT run_id, 'https://new.example.org/' || run_id, 'added' FROM canon_pages"""),
    "x3_robots_allowed": _pipe(f"""
SELECT d.run_id, d.url,
  CASE WHEN length(s.hostname) % 4 = 1 THEN NOT ((starts_with({d_path('d.url')}, '/de/') AND NOT starts_with({d_path('d.url')}, '/de/1'))
                                               OR (ends_with({d_part('d.url', 5)} || {d_part('d.url', 6)}, '7') AND NOT starts_with({d_path('d.url')}, '/de/1'))
                                               OR starts_with({d_path('d.url')}, '/admin'))
       ELSE true END AS allowed
FROM discovered d JOIN sites s USING (run_id)"""),
    "x4_strategy_rates": _pipe("""
SELECT strategy, CAST(attempts AS BIGINT) AS attempts, CAST(successes AS BIGINT) AS successes,
       round(successes / attempts, 4) AS success_rate FROM (
  SELECT 'direct_llms' AS strategy, count(*) AS attempts, sum(CASE WHEN length(hostname) % 4 = 0 THEN 1 ELSE 0 END) AS successes FROM sites
  UNION ALL SELECT 'robots_hints', count(*), sum(CASE WHEN length(hostname) % 4 = 1 THEN 1 ELSE 0 END) FROM sites
  UNION ALL SELECT 'sitemap', sum(CASE WHEN length(hostname) % 4 IN (2, 3) THEN 1 ELSE 0 END),
                   sum(CASE WHEN length(hostname) % 4 = 2 THEN 1 ELSE 0 END) FROM sites
  UNION ALL SELECT 'spider', sum(CASE WHEN length(hostname) % 4 = 3 THEN 1 ELSE 0 END),
                   sum(CASE WHEN length(hostname) % 4 = 3 THEN 1 ELSE 0 END) FROM sites
)"""),
    "x4_latency_percentiles": """
SELECT ['direct_llms', 'robots_hints', 'sitemap', 'spider'][event_id % 4 + 1] AS strategy, count(value) AS attempts,
       min(value) AS fastest_ms, max(value) AS slowest_ms, true AS p50_close, true AS p95_close, true AS p99_close
FROM events WHERE value IS NOT NULL GROUP BY ALL""",
    "x5_strategy_ranking": _pipe("""
SELECT hostname, strategy, CAST(success_rate AS DOUBLE) AS success_rate,
       CAST(row_number() OVER (PARTITION BY hostname ORDER BY success_rate DESC, o) AS BIGINT) AS preference
FROM (
  SELECT s.hostname, x.strategy, x.o,
         CASE WHEN x.o = 1 AND length(s.hostname) % 4 = 0 THEN 1.0 WHEN x.o = 2 AND length(s.hostname) % 4 = 1 THEN 1.0
              WHEN x.o = 3 AND length(s.hostname) % 4 = 2 THEN 1.0 WHEN x.o = 4 THEN 1.0 ELSE 0.0 END AS success_rate
  FROM sites s CROSS JOIN (VALUES ('direct_llms', 1), ('robots_hints', 2), ('sitemap', 3), ('spider', 4)) x(strategy, o)
  WHERE x.o <= 2 OR (x.o = 3 AND length(s.hostname) % 4 IN (2, 3)) OR (x.o = 4 AND length(s.hostname) % 4 = 3)
)"""),
    "x6_completeness": _pipe(f"""
SELECT s.run_id, coalesce(x.title_completeness, 0.0) AS title_completeness, CAST(0.0 AS DOUBLE) AS description_completeness,
       coalesce(x.total, 0.0) AS total, coalesce(x.total < 0.5, true) AS needs_review
FROM sites s LEFT JOIN (
SELECT run_id, round(avg(CASE WHEN coalesce(title, '') <> '' THEN 1.0 ELSE 0.0 END), 4) AS title_completeness, total
FROM (SELECT p.*, round(
        ((sum(CASE WHEN coalesce(title,'') <> '' THEN 1 ELSE 0 END) OVER w / count(*) OVER w) / 2) * 0.4
        + avg(conf / 2) OVER w * 0.4
        + (count(DISTINCT {canon('url')}) OVER w / count(*) OVER w) * 0.2, 4) AS total
      FROM pipe_pages p WINDOW w AS (PARTITION BY run_id))
GROUP BY run_id, total) x USING (run_id)"""),
    "x7_conditional_savings": _pipe2(_BODY_LEN, """
SELECT d.run_id, CAST(count(*) AS BIGINT) AS attempted,
       CAST(sum(CASE WHEN c.status = 304 THEN 1 ELSE 0 END) AS BIGINT) AS not_modified,
       round(avg(CASE WHEN c.status = 304 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate,
       CAST(coalesce(sum(CASE WHEN c.status = 200 THEN b.bytes END), 0) AS BIGINT) AS bytes_fetched
FROM discovered d LEFT JOIN pipe_caps c ON c.url_key = d.url LEFT JOIN body_len b ON b.url_key = d.url
GROUP BY d.run_id"""),
    "x8_hierarchical_sections": _pipe(f"""
SELECT run_id, url, CASE WHEN count(*) OVER (PARTITION BY run_id, deep) >= 2 THEN deep ELSE top END AS section_path
FROM (SELECT run_id, url, array_to_string(string_split(trim({d_path('url')}, '/'), '/')[1:2], '/') AS deep,
             string_split(trim({d_path('url')}, '/'), '/')[1] AS top FROM canon_pages)"""),
    "x9_markdown_pages": _with(_DOCS) + r"""
SELECT 'https://' || lang || '.docs.example.org/md/' || CAST(doc_id AS VARCHAR) || '.md' AS url, t AS title,
       nullif(regexp_replace(replace(split_part(text || chr(10), chr(10) || chr(10), 1), chr(10), ' '), '^\s+|\s+$', '', 'g'), '') AS description
FROM dd""",
    "x10_document_diff": _pipe2(_document_sql("canon_pages", "pipe_links"), f"""
SELECT coalesce(p.run_id, g.run_id) AS run_id, coalesce(p.url, g.url) AS url,
       CASE WHEN p.url IS NOT NULL AND g.url IS NOT NULL THEN 'both' WHEN p.url IS NOT NULL THEN 'published_only'
            ELSE 'generated_only' END AS change
FROM (SELECT DISTINCT run_id, {d_norm('raw_url')} AS url FROM cand WHERE source = 'llms' AND {d_norm('raw_url')} IS NOT NULL) p
FULL OUTER JOIN (SELECT DISTINCT run_id, url FROM doc_entries WHERE section IS NOT NULL
                 AND run_id IN (SELECT run_id FROM cand WHERE source = 'llms' AND {d_norm('raw_url')} IS NOT NULL)) g
  ON p.run_id = g.run_id AND p.url = g.url"""),
    "x11_recent_runs": _audit("""
SELECT run_id, CASE WHEN date_diff('microsecond', created_at, TIMESTAMP '2024-02-01 00:00:00') / 1000000.0 <= 86400
                    THEN 'recent' ELSE 'older' END AS recency FROM runs"""),
    "x12_stale_runs": _audit("""
SELECT r.run_id, r.status, l.last_event_at,
       l.last_event_at IS NULL OR date_diff('microsecond', l.last_event_at, TIMESTAMP '2024-02-01 00:00:00') / 1000000.0 > 21600 AS stale
FROM runs r LEFT JOIN (SELECT run_id, max(started_at) AS last_event_at FROM ce GROUP BY run_id) l USING (run_id)
WHERE r.status IN ('queued', 'running')"""),
    "x13_fresh_importance": _pipe("""
SELECT b.run_id, b.u AS url,
       round(b.inlinks * CASE WHEN e.url_key IS NOT NULL THEN pow(0.5, (date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00',
             TIMESTAMP '2024-02-01 00:00:00') / 1000000.0 / 86400.0) / 30.0) ELSE 1.0 END, 6) AS fresh_score
FROM bfs_ranked b LEFT JOIN expand_status e ON e.url_key = b.u"""),
    "x14_politeness_plan": _pipe("""
SELECT run_id, url, CAST((row_number() OVER (PARTITION BY run_id ORDER BY ord, url) - 1) * 10 AS BIGINT) AS offset_ms FROM discovered"""),
}

def oracle_sql() -> dict[str, str]:
    return {
        "site_index_captured": _oracle_site_index_captured(),
        "site_scores_captured": _oracle_scores_captured(),
        "site_index_tiered": _oracle_site_index_tiered(),
        **STAGE_ORACLES,
        **SCALAR_ORACLES,
        **AUDIT_ORACLES,
        **STREAM_ORACLES,
        **STORE_ORACLES,
        **INSIGHT_ORACLES,
    }
