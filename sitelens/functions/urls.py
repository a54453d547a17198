"""URL scalars as native expressions.

Each helper takes a SQL expression text (usually a column name) and
returns a Column built with one ``F.expr`` call; the ``*_sql`` variants
return the text so helpers nest without extra round trips to the JVM.
Catalyst sees ordinary built-in expressions (regexp_extract, lower,
concat ...), all inside whole-stage codegen.  The only Python piece is
``resolve_url`` (RFC 3986 reference resolution), an Arrow-batched UDF.
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.config import NON_CONTENT_SEGMENTS, SECTION_SKIP_SEGMENTS

# RFC 3986 appendix B: scheme=2, authority=4, path=5, query=7, fragment=9.
URI_PATTERN = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
_URI = "r'(?s)" + URI_PATTERN + "'"


def _lits(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


# ---------------------------------------------------------------------------
# SQL text builders
# ---------------------------------------------------------------------------
def part_sql(e: str, group: int) -> str:
    return f"regexp_extract({e}, {_URI}, {group})"


def scheme_sql(e: str) -> str:
    return f"lower({part_sql(e, 2)})"


def netloc_sql(e: str) -> str:
    return part_sql(e, 4)


def raw_path_sql(e: str) -> str:
    return part_sql(e, 5)


def path_sql(e: str) -> str:
    return f"regexp_replace({raw_path_sql(e)}, r';[^/]*$', '')"


def query_sql(e: str) -> str:
    return f"CASE WHEN {part_sql(e, 6)} <> '' THEN {part_sql(e, 7)} END"


def fragment_sql(e: str) -> str:
    return f"CASE WHEN contains({e}, '#') THEN {part_sql(e, 9)} END"


def host_sql(e: str) -> str:
    return rf"lower(regexp_extract({netloc_sql(e)}, r'^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)', 1))"


def canonical_sql(e: str) -> str:
    p = path_sql(e)
    path = f"CASE WHEN {p} = '' OR {p} = '/' THEN '/' ELSE regexp_replace({p}, '/$', '') END"
    return f"lower(concat({scheme_sql(e)}, '://', {netloc_sql(e)}, {path}))"


def strip_fragment_sql(e: str) -> str:
    return f"substring_index({e}, '#', 1)"


def suffix_sql(path: str) -> str:
    name = f"regexp_extract({path}, r'([^/]*)/*$', 1)"
    return rf"lower(regexp_extract({name}, r'^.+(\.[^.]+)$', 1))"


def non_content_sql(path: str) -> str:
    segs = f"split(btrim(lower({path}), '/'), '/')"
    return f"arrays_overlap({segs}, array({_lits(NON_CONTENT_SEGMENTS)}))"


def title_case_sql(e: str) -> str:
    return rf"array_join(transform(regexp_extract_all({e}, r'(\p{{L}}+|\P{{L}}+)', 1), r -> initcap(r)), '')"


def section_sql(url: str, hostname: str) -> str:
    net = netloc_sql(url)
    trimmed = f"btrim({path_sql(url)}, '/')"
    first = f"substring_index({trimmed}, '/', 1)"
    base = rf"regexp_replace({first}, r'\.[^.]*$', '')"
    pretty = title_case_sql(f"translate({base}, '-_', '  ')")
    return (
        f"CASE WHEN {net} <> '' AND {net} <> {hostname} THEN 'External' "
        f"WHEN {trimmed} = '' THEN 'Home' "
        f"WHEN lower({first}) IN ({_lits(SECTION_SKIP_SEGMENTS)}) THEN CAST(NULL AS STRING) "
        f"ELSE {pretty} END"
    )


# Characters a WHATWG URL serialiser percent-encodes, besides controls and
# non-ASCII: space and  " < > ` { }
_ENCODE = r"""r'[^\x21-\x7e]|["<>`{}]'"""


def _percent_encode_sql(e: str) -> str:
    enc = (
        f"array_join(transform(regexp_extract_all({e}, r'(?s)(.)', 1), "
        f"ch -> CASE WHEN ch = ' ' THEN '%20' WHEN ch RLIKE {_ENCODE} THEN url_encode(ch) ELSE ch END), '')"
    )
    return f"CASE WHEN {e} RLIKE {_ENCODE} THEN {enc} ELSE {e} END"


def valid_http_sql(e: str) -> str:
    return f"({scheme_sql(e)} IN ('http', 'https') AND {host_sql(e)} <> '')"


def _no_dots_sql(p: str) -> str:
    """Path without ``.`` and ``..`` segments; a final one leaves its slash."""
    segs = f"split(substring({p}, 2), '/')"
    walked = (
        f"aggregate({segs}, CAST(array() AS array<string>), (acc, x) -> CASE WHEN x = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
        f"WHEN x = '.' THEN acc ELSE array_append(acc, x) END, acc -> "
        f"concat('/', array_join(acc, '/'), CASE WHEN size(acc) > 0 AND {p} RLIKE r'/[.][.]?$' THEN '/' ELSE '' END))"
    )
    return f"CASE WHEN {p} RLIKE r'/[.][.]?(/|$)' THEN {walked} ELSE {p} END"


def normalize_sql(e: str) -> str:
    """The URL is split once into a struct; the rest reads its fields."""
    parts = (
        f"named_struct('s', {scheme_sql(e)}, 'n', {netloc_sql(e)}, 'p', {raw_path_sql(e)}, "
        f"'q', {query_sql(e)}, 'f', {fragment_sql(e)})"
    )
    host = r"lower(regexp_extract(u.n, r'^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)', 1))"
    # User info keeps its case, the host does not.
    net = "CASE WHEN contains(u.n, '@') THEN concat(regexp_extract(u.n, '^(.*@)', 1), lower(regexp_replace(u.n, '^.*@', ''))) ELSE lower(u.n) END"
    net = (
        f"CASE WHEN (u.s = 'http' AND endswith(u.n, ':80')) OR (u.s = 'https' AND endswith(u.n, ':443')) "
        f"THEN regexp_replace({net}, ':[0-9]+$', '') ELSE {net} END"
    )
    path = f"CASE WHEN u.p = '' THEN '/' ELSE {_no_dots_sql('u.p')} END"
    out = (
        f"concat(u.s, '://', {net}, {_percent_encode_sql(path)}, "
        f"coalesce(concat('?', {_percent_encode_sql('u.q')}), ''), "
        f"coalesce(concat('#', {_percent_encode_sql('u.f')}), ''))"
    )
    built = f"CASE WHEN u.s IN ('http', 'https') AND {host} <> '' THEN {out} END"
    return f"get(transform(array({parts}), u -> {built}), 0)"


def is_home_sql(url: str, hostname: str) -> str:
    return f"(regexp_replace({url}, '/+$', '') = concat('https://', {hostname}))"


# ---------------------------------------------------------------------------
# Column helpers (one JVM call each)
# ---------------------------------------------------------------------------
def url_scheme(e: str) -> Column:
    """Lower-cased scheme ('' when absent)."""
    return F.expr(scheme_sql(e))


def url_netloc(e: str) -> Column:
    """Authority as written ('' when absent); port and case kept."""
    return F.expr(netloc_sql(e))


def url_raw_path(e: str) -> Column:
    """Path including any ``;params`` of the last segment."""
    return F.expr(raw_path_sql(e))


def url_path(e: str) -> Column:
    """Path without the ``;params`` of the last segment (stdlib split)."""
    return F.expr(path_sql(e))


def url_query(e: str) -> Column:
    """Query without '?', NULL when the URL has no '?'."""
    return F.expr(query_sql(e))


def url_fragment(e: str) -> Column:
    """Fragment without '#', NULL when the URL has no '#'."""
    return F.expr(fragment_sql(e))


def url_host(e: str) -> Column:
    """Host name: netloc without user info and port, lower-cased."""
    return F.expr(host_sql(e))


def canonical_url(e: str) -> Column:
    """Scheme://netloc/path without params/query/fragment, one trailing
    '/' removed unless root, the whole string lower-cased."""
    return F.expr(canonical_sql(e))


def strip_fragment(e: str) -> Column:
    """Text before the first '#'."""
    return F.expr(strip_fragment_sql(e))


def same_domain(netloc: str, hostname: str) -> Column:
    """P5: netloc empty or exactly the site's host (port included)."""
    return F.expr(f"({netloc} = '' OR {netloc} = {hostname})")


def path_suffix(path: str) -> Column:
    """Lower-cased suffix of the last path segment ('' when none),
    following ``PurePosixPath.suffix``: trailing slashes are ignored, a
    leading dot does not start a suffix, a final dot is no suffix."""
    return F.expr(suffix_sql(path))


def extension_allowed(path: str, extensions: Iterable[str]) -> Column:
    """Suffix in the allow list; '' in the list admits no suffix."""
    exts = sorted({e.strip().lower() for e in extensions})
    return F.expr(f"{suffix_sql(path)} IN ({_lits(exts)})")


def non_content_path(path: str) -> Column:
    """Some segment of the lower-cased path is a non-content name."""
    return F.expr(non_content_sql(path))


def title_case(e: str) -> Column:
    """Python ``str.title``: each run of letters gets an upper-case first
    letter and lower-case rest; other characters are kept."""
    return F.expr(title_case_sql(e))


def section_name(url: str, hostname: str) -> Column:
    """H2 section of a page URL; NULL means the page is left out."""
    return F.expr(section_sql(url, hostname))


def valid_http_url(e: str) -> Column:
    """P9 predicate: http(s) scheme and a non-empty host."""
    return F.expr(valid_http_sql(e))


def normalize_http_url(e: str) -> Column:
    """P9 serialisation: lower-case scheme and host, drop the default port,
    '/' for an empty path, no dot segments, percent-encode spaces and
    non-ASCII; NULL for a URL that is not http(s) with a host."""
    return F.expr(normalize_sql(e))


def is_home(url: str, hostname: str) -> Column:
    """P10: URL without trailing slashes equals https://<host>."""
    return F.expr(is_home_sql(url, hostname))


# ---------------------------------------------------------------------------
# Reference resolution
# ---------------------------------------------------------------------------
def _join_one(base: str | None, href: str | None) -> str | None:
    if base is None or href is None:
        return None
    try:
        return urljoin(base, href)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _urljoin_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_join_one(b, h) for b, h in zip(base, href)], dtype=object)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """``urljoin(base, href)`` over Arrow batches.

    A Python UDF inside a conditional is still evaluated for every row, so
    there is no native branch here.
    """
    b = F.col(base) if isinstance(base, str) else base
    h = F.col(href) if isinstance(href, str) else href
    return _urljoin_udf(b, h)
