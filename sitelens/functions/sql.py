"""SQL-facing functions.

``register_sql_functions(spark)`` makes the scalars usable from SQL:

* SQL-bodied temporary functions over the same built-in expressions the
  DataFrame helpers use (``canonical_url(u)``, ``url_section(u, host)``,
  ``normalize_http_url(u)`` ...), so Catalyst inlines them;
* ``resolve_url(base, href)``: the Arrow-batched ``urljoin`` UDF;
* ``html_links(url, html)``: an Arrow UDTF for ``LATERAL`` joins, one row
  per anchor (pos, href, link);
* ``sitemap_locs(body)``: struct(children, urls) of a sitemap document.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sitelens.config import DEFAULT_EXTENSIONS, SITEMAP_NS
from sitelens.functions import urls as U
from sitelens.functions.html import parse_signals
from sitelens.functions.text import _LINE_BREAK, _PY_SPACE


@udtf(returnType="pos int, href string, link string", useArrow=True)
class HtmlLinks:
    """Anchors of one HTML document in order, raw and resolved."""

    def eval(self, url: str, html: str):
        s = parse_signals(html, url)
        for i, (href, link) in enumerate(zip(s["hrefs"], s["links"])):
            yield i, href, link


def _defs() -> dict[str, tuple[str, str, str]]:
    exts = sorted({e.strip().lower() for e in DEFAULT_EXTENSIONS.split(",")})
    allowed = ", ".join("'" + e + "'" for e in exts)
    plain = r"regexp_replace(body, r'<(/?)[A-Za-z_][\w.\-]*:', '<$1')"
    sitemap = (
        f"CASE WHEN contains(body, '{SITEMAP_NS}') THEN named_struct("
        f"'children', transform(from_xml({plain}, 'sitemap array<struct<loc:string>>, url array<struct<loc:string>>', "
        f"map('mode', 'PERMISSIVE')).sitemap, e -> e.loc), "
        f"'urls', transform(from_xml({plain}, 'sitemap array<struct<loc:string>>, url array<struct<loc:string>>', "
        f"map('mode', 'PERMISSIVE')).url, e -> e.loc)) END"
    )
    return {
        "url_scheme": ("u STRING", "STRING", U.scheme_sql("u")),
        "url_netloc": ("u STRING", "STRING", U.netloc_sql("u")),
        "url_host": ("u STRING", "STRING", U.host_sql("u")),
        "url_path": ("u STRING", "STRING", U.path_sql("u")),
        "url_query": ("u STRING", "STRING", U.query_sql("u")),
        "url_fragment": ("u STRING", "STRING", U.fragment_sql("u")),
        "strip_fragment": ("u STRING", "STRING", U.strip_fragment_sql("u")),
        "canonical_url": ("u STRING", "STRING", U.canonical_sql("u")),
        "url_suffix": ("p STRING", "STRING", U.suffix_sql("p")),
        "is_allowed_extension": ("p STRING", "BOOLEAN", f"{U.suffix_sql('p')} IN ({allowed})"),
        "is_non_content_path": ("p STRING", "BOOLEAN", U.non_content_sql("p")),
        "url_section": ("u STRING, host STRING", "STRING", U.section_sql("u", "host")),
        "is_http_url": ("u STRING", "BOOLEAN", U.valid_http_sql("u")),
        "normalize_http_url": ("u STRING", "STRING", U.normalize_sql("u")),
        "is_home_url": ("u STRING, host STRING", "BOOLEAN", U.is_home_sql("u", "host")),
        "py_title": ("s STRING", "STRING", U.title_case_sql("s")),
        "py_strip": ("s STRING", "STRING", rf"regexp_replace(s, r'^[{_PY_SPACE}]+|[{_PY_SPACE}]+\z', '')"),
        "py_splitlines": (
            "s STRING",
            "ARRAY<STRING>",
            rf"CASE WHEN s = '' THEN array() ELSE split(regexp_replace(s, r'({_LINE_BREAK})\z', ''), r'{_LINE_BREAK}') END",
        ),
        "sitemap_locs": ("body STRING", "STRUCT<children: ARRAY<STRING>, urls: ARRAY<STRING>>", sitemap),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register every SQL-facing function in the session; returns names."""
    names = []
    for name, (args, ret, body) in _defs().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
        names.append(name)
    spark.udf.register("resolve_url", U._urljoin_udf)
    spark.udtf.register("html_links", HtmlLinks)
    return names + ["resolve_url", "html_links"]
