"""SQL-facing functions give the same answers as the DataFrame helpers."""

from urllib.parse import urljoin

from sitelens.functions.sql import register_sql_functions


def test_sql_scalars(spark):
    register_sql_functions(spark)
    r = spark.sql(
        """SELECT canonical_url('https://E.com/Docs/;p?q#f') AS c,
                  url_section('https://e.com/getting_started.html', 'e.com') AS s,
                  normalize_http_url('https://E.com:443/für') AS n,
                  is_non_content_path('/a/Login') AS nc,
                  is_allowed_extension('/x.css') AS ext,
                  py_title('v2api') AS t,
                  py_splitlines('a\\nb\\n') AS lines,
                  resolve_url('https://e.com/a/b', '../c') AS j"""
    ).first()
    assert r.c == "https://e.com/docs"
    assert r.s == "Getting Started"
    assert r.n == "https://e.com/f%C3%BCr"
    assert r.nc is True and r.ext is False
    assert r.t == "V2Api" and r.lines == ["a", "b"]
    assert r.j == urljoin("https://e.com/a/b", "../c")


def test_sql_table_functions(spark):
    register_sql_functions(spark)
    spark.createDataFrame(
        [("https://e.com/p", '<a href="/x">1</a><a href="y#z">2</a>')], "url string, html string"
    ).createOrReplaceTempView("docs_t")
    rows = spark.sql("SELECT l.pos, l.link FROM docs_t, LATERAL html_links(docs_t.url, docs_t.html) l ORDER BY l.pos").collect()
    assert [(x.pos, x.link) for x in rows] == [(0, "https://e.com/x"), (1, "https://e.com/y#z")]
    sm = spark.sql(
        """SELECT sitemap_locs('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://e.com/a</loc></url></urlset>') AS s"""
    ).first().s
    assert sm.urls == ["https://e.com/a"] and sm.children is None


def test_sql_functions_equal_dataframe_helpers_on_driver_pages(spark):
    import os

    from sitelens.functions import urls as U

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        return
    register_sql_functions(spark)
    spark.read.parquet(f"{sf}/pages.parquet").createOrReplaceTempView("pages_t")
    via_sql = spark.sql(
        "SELECT url, canonical_url(url) AS c, normalize_http_url(url) AS n, "
        "url_section(canonical_url(url), url_netloc(url)) AS s FROM pages_t"
    )
    via_df = spark.read.parquet(f"{sf}/pages.parquet").select(
        "url", U.canonical_url("url").alias("c"), U.normalize_http_url("url").alias("n"),
        U.section_name(U.canonical_sql("url"), U.netloc_sql("url")).alias("s"),
    )
    assert sorted(map(tuple, via_sql.collect())) == sorted(map(tuple, via_df.collect()))
