"""One pass over each HTML body, producing the signals every later
stage needs.

The stdlib ``html.parser`` tokenizer runs inside ``mapInArrow`` tasks over
Arrow batches: Spark partitions the pages, the parser only turns one body
into a small record.  All decisions (title / description cascade, link
filters, dedup, ranking) are DataFrame expressions on the result.

Scope rules: metadata comes from the ``<head>`` element when the page has
one (it ends at ``</head>`` or ``</html>``, else at the end of the
document), otherwise from the whole document.  Links come from the whole
document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.text import py_strip

META_TYPE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("property", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

SIGNALS_FIELDS = [
    T.StructField("has_head", T.BooleanType()),
    T.StructField("title", T.StringType()),
    T.StructField("metas", T.ArrayType(META_TYPE)),
    T.StructField("ld_scripts", T.ArrayType(T.StringType())),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("hrefs", T.ArrayType(T.StringType())),
    T.StructField("parse_error", T.StringType()),
]

_LD_TYPE = "application/ld+json"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _charref(name: str) -> str:
    """Numeric character reference; the 0x80-0x9F range is read as
    windows-1252, as browsers do."""
    try:
        n = int(name[1:], 16) if name[:1] in ("x", "X") else int(name)
    except ValueError:
        return "&#" + name
    if 0x80 <= n <= 0x9F:
        return bytes([n]).decode("cp1252", errors="replace")
    if 0xD800 <= n <= 0xDFFF:  # a lone surrogate is no character
        return "\ufffd"
    try:
        return chr(n)
    except (ValueError, OverflowError):
        return "\ufffd"


def _string_of(children: list) -> str | None:
    """BeautifulSoup's ``.string``: the only child's text, looking through
    a chain of single-child tags; None when there are several children."""
    if len(children) != 1:
        return None
    only = children[0]
    return only if isinstance(only, str) else _string_of(only)


class _SignalParser(HTMLParser):
    """Collects title, meta tags, JSON-LD scripts and anchors in one pass."""

    def __init__(self) -> None:
        # References are decoded only where text is kept (inside <title>);
        # attribute values are always unescaped by the tokenizer.
        super().__init__(convert_charrefs=False)
        self.head_state = 0  # 0 before <head>, 1 inside, 2 after
        self.titles: list[tuple[bool, str | None]] = []  # (in_head, string)
        self._title: list | None = None  # children of the open <title>
        self._title_stack: list[tuple[str, list]] = []
        self._title_in_head = False
        self.metas: list[tuple[bool, dict[str, str]]] = []
        self.scripts: list[tuple[bool, str]] = []
        self._script: list[str] | None = None
        self._script_in_head = False
        self.hrefs: list[str] = []

    @property
    def _in_head(self) -> bool:
        return self.head_state == 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: ("" if v is None else v) for k, v in attrs}
        if self._title is not None and tag != "title":
            node: list = []
            self._title_stack[-1][1].append(node)
            if tag not in _VOID:
                self._title_stack.append((tag, node))
        if tag == "head" and self.head_state == 0:
            self.head_state = 1
        elif tag == "title" and self._title is None:
            self._title = []
            self._title_stack = [("title", self._title)]
            self._title_in_head = self._in_head
        elif tag == "meta":
            self.metas.append((self._in_head, a))
        elif tag == "script" and a.get("type") == _LD_TYPE:
            self._script = []
            self._script_in_head = self._in_head
        if tag == "a" and "href" in a:
            self.hrefs.append(a["href"])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("title", "script"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._title is not None and tag != "title":
            names = [t for t, _ in self._title_stack]
            if tag in names[1:]:
                while self._title_stack[-1][0] != tag:
                    self._title_stack.pop()
                self._title_stack.pop()
            return
        if tag == "title" and self._title is not None:
            self._close_title()
        elif tag == "script" and self._script is not None:
            self.scripts.append((self._script_in_head, "".join(self._script)))
            self._script = None
        elif tag in ("head", "html") and self.head_state == 1:
            self.head_state = 2

    def handle_data(self, data: str) -> None:
        if self._title is not None:
            kids = self._title_stack[-1][1]
            if kids and isinstance(kids[-1], str):
                kids[-1] += data  # one text node, as a tree builder keeps it
            else:
                kids.append(data)
        if self._script is not None:
            self._script.append(data)

    def handle_entityref(self, name: str) -> None:
        if self._title is not None:
            cp = name2codepoint.get(name)
            self.handle_data(chr(cp) if cp is not None else "&" + name)

    def handle_charref(self, name: str) -> None:
        if self._title is not None:
            self.handle_data(_charref(name))

    def handle_comment(self, data: str) -> None:
        if self._title is not None:
            self._title_stack[-1][1].append(data)

    def _close_title(self) -> None:
        self.titles.append((self._title_in_head, _string_of(self._title or [])))
        self._title = None
        self._title_stack = []

    def finish(self) -> None:
        self.close()
        if self._title is not None:
            self._close_title()
        if self._script is not None:
            self.scripts.append((self._script_in_head, "".join(self._script)))
            self._script = None


def jsonld_string(scripts: str, key: str) -> Column:
    """E5: the first string under ``key`` among the top-level objects of the
    JSON-LD ``scripts`` (array of texts, in document order), trimmed.

    Each text is parsed to a variant (NULL when it is no JSON); an array
    stands for its elements.  Numbers and other types never count.
    """
    parsed = f"transform({scripts}, t -> try_parse_json(t))"
    objects = (
        f"flatten(transform({parsed}, v -> CASE WHEN v IS NULL THEN array() "
        f"WHEN startswith(schema_of_variant(v), 'ARRAY') THEN coalesce(try_variant_get(v, '$', 'array<variant>'), array()) "
        f"ELSE array(v) END))"
    )
    values = f"transform({objects}, o -> try_variant_get(o, '$.{key}', 'variant'))"
    strings = f"filter({values}, x -> x IS NOT NULL AND schema_of_variant(x) = 'STRING')"
    return py_strip(F.expr(f"CAST(get({strings}, 0) AS STRING)"))


_SURROGATE = re.compile("[\ud800-\udfff]")


def _text(value: str | None) -> str | None:
    """Text that Arrow can carry: lone surrogates become U+FFFD."""
    return _SURROGATE.sub("\ufffd", value) if value else value


def parse_signals(html: str | None, base_url: str | None) -> dict:
    """Signals of one document (the per-row helper of E1)."""
    p = _SignalParser()
    error = None
    try:
        p.feed(html or "")
        p.finish()
    except Exception as e:  # noqa: BLE001 - one hostile page must not end the job; it is marked
        error = type(e).__name__
    has_head = p.head_state > 0

    def scoped(items):
        return [v for in_head, v in items if in_head or not has_head]

    titles = scoped(p.titles)
    title = titles[0] if titles else None
    metas = []
    for attrs in scoped(p.metas):
        content = attrs.get("content")
        metas.append(
            {
                "name": _text(attrs.get("name")),
                "property": _text(attrs.get("property")),
                "content": _text(content.strip()) if content else None,
            }
        )
    scripts = scoped(p.scripts)
    links = []
    for href in p.hrefs:
        try:
            links.append(_text(urljoin(base_url or "", href)))
        except ValueError:
            links.append(None)
    return {
        "has_head": has_head,
        "title": _text(title.strip()) if title is not None else None,
        "metas": metas,
        "ld_scripts": [_text(text) for text in scripts if text],
        "links": links,
        "hrefs": [_text(h) for h in p.hrefs],
        "parse_error": error,
    }


def extract_signals(
    df: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None
) -> DataFrame:
    """E1 over a DataFrame: ``keep`` columns + url + signal columns.

    Runs as ``mapInArrow`` so the body never leaves the task that read it;
    the output drops the body.
    """
    keep = [c for c in (keep or []) if c != url_col]
    src = df.select(*keep, url_col, html_col)
    passthrough = [src.schema[c] for c in keep + [url_col]]
    out_schema = T.StructType(passthrough + SIGNALS_FIELDS)
    arrow_schema = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow_schema
        from pyspark.sql.pandas.types import to_arrow_schema

        if arrow_schema is None:
            arrow_schema = to_arrow_schema(out_schema)
        names = [f.name for f in SIGNALS_FIELDS]
        for batch in batches:
            urls = batch.column(url_col).to_pylist()
            bodies = batch.column(html_col).to_pylist()
            rows = [parse_signals(h, u) for u, h in zip(urls, bodies)]
            cols = [batch.column(c) for c in keep + [url_col]]
            for name in names:
                cols.append(
                    pa.array([r[name] for r in rows], type=arrow_schema.field(name).type)
                )
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    return (
        src.mapInArrow(run, out_schema)
        .withColumn("ld_headline", jsonld_string("ld_scripts", "headline"))
        .withColumn("ld_description", jsonld_string("ld_scripts", "description"))
        .drop("ld_scripts")
    )
