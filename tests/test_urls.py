"""P-series scalars on literal URLs (cases the reference leaves untested)."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from sitelens.functions import text as T
from sitelens.functions import urls as U


def _one(spark, col, value, **extra):
    cols = {"u": value, **extra}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(col.alias("r")).first().r


def test_canonical_url(spark):
    cases = {
        "https://Example.com/Docs/": "https://example.com/docs",
        "https://example.com": "https://example.com/",
        "https://example.com/": "https://example.com/",
        "https://example.com/a//": "https://example.com/a/",
        "http://example.com/p;v=1?q=2#top": "http://example.com/p",
        "https://example.com/a;x/b;y": "https://example.com/a;x/b",
        "https://example.com/x?ref=1": "https://example.com/x",
    }
    for raw, want in cases.items():
        assert _one(spark, U.canonical_url("u"), raw) == want, raw


def test_url_parts(spark):
    u = "HTTPS://user@Host:8080/a/b;p?q=1#frag"
    assert _one(spark, U.url_scheme("u"), u) == "https"
    assert _one(spark, U.url_netloc("u"), u) == "user@Host:8080"
    assert _one(spark, U.url_path("u"), u) == "/a/b"
    assert _one(spark, U.url_query("u"), u) == "q=1"
    assert _one(spark, U.url_fragment("u"), u) == "frag"
    assert _one(spark, U.url_query("u"), "https://h/a") is None
    assert _one(spark, U.url_host("u"), u) == "host"


def test_suffix_follows_pure_posix_path(spark):
    from pathlib import PurePosixPath

    for path in ["/a/b.HTML", "/a/b", "/a/b/", "/a/.hidden", "/a/b.", "/a/b.tar.gz", "/", "", "/..a", "/x.md/"]:
        assert _one(spark, U.path_suffix("u"), path) == PurePosixPath(path).suffix.lower(), path


def test_non_content_and_extension(spark):
    assert _one(spark, U.non_content_path("u"), "/Admin/dashboard") is True
    assert _one(spark, U.non_content_path("u"), "/administrator") is False
    exts = [".html", ".htm", ".txt", ".md", ""]
    assert _one(spark, U.extension_allowed("u", exts), "/a.css") is False
    assert _one(spark, U.extension_allowed("u", exts), "/a") is True
    assert _one(spark, U.extension_allowed("u", [".html"]), "/a") is False


def test_section_names_title_case(spark):
    host = "example.com"
    cases = {
        "https://example.com/": "Home",
        "https://other.com/x": "External",
        "https://example.com/v2api/x": "V2Api",
        "https://example.com/3.x/": "3",
        "https://example.com/it's-me": "It'S Me",
        "https://example.com/getting_started.html": "Getting Started",
        "https://example.com/a1b2": "A1B2",
        "https://example.com/static/app.js": None,
        "https://example.com/__/x": None,
        "https://example.com/__init/x": "  Init",
    }
    for url, want in cases.items():
        got = _one(spark, U.section_name("u", "h"), url, h=host)
        assert got == want, (url, got)


def test_title_case_matches_python(spark):
    for s in ["v2api", "3.x", "it's me", "a1b2", "hello world", "ÉCOLE normale", "x-y_z"]:
        assert _one(spark, U.title_case("u"), s) == s.title(), s


def test_http_url_normalisation(spark):
    cases = {
        "https://Example.com": "https://example.com/",
        "HTTP://EXAMPLE.com:80/A b": "http://example.com/A%20b",
        "https://example.com:443/für?q=ä#x y": "https://example.com/f%C3%BCr?q=%C3%A4#x%20y",
        "https://example.com:8443/x": "https://example.com:8443/x",
        "mailto:info@example.com": None,
        "tel:123": None,
        "/relative": None,
    }
    for raw, want in cases.items():
        assert _one(spark, U.normalize_http_url("u"), raw) == want, raw


def test_resolve_url_matches_urljoin(spark):
    base = "https://example.com/docs/page"
    hrefs = ["/a", "b", "../c", "./d?x#y", "//other.com/e", "https://x.org/f", "#frag", "", "?q=1", "/g/../h"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    got = [r.r for r in df.select(U.resolve_url("b", "h").alias("r")).collect()]
    assert got == [urljoin(base, h) for h in hrefs]


def test_home_and_fragment(spark):
    assert _one(spark, U.is_home("u", "h"), "https://example.com//", h="example.com") is True
    assert _one(spark, U.is_home("u", "h"), "http://example.com/", h="example.com") is False
    assert _one(spark, U.strip_fragment("u"), "https://e.com/a#b#c") == "https://e.com/a"


def test_splitlines_and_strip(spark):
    texts = ["a\nb\r\nc\rd", "x\n", "", "one", "a\x0bb\x1cc d\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.r for r in df.select(T.split_lines("t").alias("r")).collect()]
    assert got == [t.splitlines() for t in texts]
    s = "　 \t x y \n\x1c"
    assert _one(spark, T.py_strip("u"), s) == s.strip()
    assert _one(spark, F.lit(1), "x") == 1


def test_normalisation_edge_cases(spark):
    cases = {
        "http://[::1]:80/a": "http://[::1]/a",
        "https://User@Example.com/x": "https://User@example.com/x",
        "https://example.com?q=1": "https://example.com/?q=1",
        "https://example.com/a%20b": "https://example.com/a%20b",
        "https://example.com/a b?c d#e f": "https://example.com/a%20b?c%20d#e%20f",
        "ftp://example.com/x": None,
        "https:///nohost": None,
    }
    for raw, want in cases.items():
        assert _one(spark, U.normalize_http_url("u"), raw) == want, raw
    assert _one(spark, U.url_host("u"), "http://[::1]:8080/") == "[::1]"


def test_normalize_dot_segments_and_user_info(spark):
    cases = {
        "https://e.com/a/./b/../c": "https://e.com/a/c",
        "https://e.com/../../x": "https://e.com/x",
        "https://e.com/a/..": "https://e.com/",
        "https://e.com/a/b/.": "https://e.com/a/b/",
        "https://e.com/a/...//b": "https://e.com/a/...//b",
        "https://e.com/.hidden/x..y": "https://e.com/.hidden/x..y",
        "HTTP://User:Pa@E.com:80/p": "http://User:Pa@e.com/p",
        "https://E.com:443?q=/../#/./": "https://e.com/?q=/../#/./",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: r.n for r in df.select("u", U.normalize_http_url("u").alias("n")).collect()}
    assert got == cases
