"""C1-C7 on literal pages: dedup ties, scores, rendered layout."""

from pyspark.sql import functions as F

from sitelens.operators import canonical, document

PAGE_SCHEMA = (
    "run_id string, url string, title string, description string, "
    "provenance struct<discovery:string,title:string,description:string>, "
    "confidence struct<title:double,description:double>, ord long"
)
SITES = "run_id string, target_url string, hostname string"


def _pages(spark, rows):
    return spark.createDataFrame(
        [(r, u, t, d, ("crawl", "title", "none"), (ct, cd), o) for r, u, t, d, ct, cd, o in rows], PAGE_SCHEMA
    )


def test_dedup_strict_win_and_tie(spark):
    p = _pages(
        spark,
        [
            ("r", "https://e.com/a/", "first", None, 1.0, 0.0, 1),
            ("r", "https://e.com/a?ref=x", "better", "d", 1.0, 1.0, 2),
            ("r", "https://e.com/B", "tie-first", None, 0.8, 0.0, 3),
            ("r", "https://e.com/b/", "tie-second", None, 0.8, 0.0, 4),
        ],
    )
    got = {r.url: (r.title, r.ord) for r in canonical.canonicalize(p).collect()}
    assert got == {"https://e.com/a": ("better", 1), "https://e.com/b": ("tie-first", 3)}


def test_scores_empty_partial_full(spark):
    sites = spark.createDataFrame([("r1", "https://a", "a"), ("r2", "https://b", "b")], SITES)
    p = _pages(
        spark,
        [
            ("r1", "https://a/1", "T", "D", 1.0, 1.0, 1),
            ("r1", "https://a/2", "T", "", 1.0, 0.0, 2),
            ("r1", "https://a/2", None, None, 0.0, 0.0, 3),
        ],
    )
    s = {r.run_id: r for r in canonical.score_pages(p, sites).collect()}
    assert (s["r2"].coverage, s["r2"].confidence, s["r2"].redundancy, s["r2"].total) == (0.0, 0.0, 0.0, 0.0)
    r1 = s["r1"]
    coverage = (2 / 3 + 1 / 3) / 2
    confidence = (1.0 + 0.5 + 0.0) / 3
    redundancy = 2 / 3
    assert r1.coverage == round(coverage, 4) and r1.confidence == round(confidence, 4)
    assert r1.redundancy == round(redundancy, 4)
    assert r1.total == round(coverage * 0.4 + confidence * 0.4 + redundancy * 0.2, 4)


def test_render_layout(spark):
    sites = spark.createDataFrame([("r", "https://example.com", "example.com")], SITES)
    p = _pages(
        spark,
        [
            ("r", "https://example.com/", "Example Site", "About it", 1.0, 1.0, 0),
            ("r", "https://example.com/pages/b", "B", None, 1.0, 0.0, 1),
            ("r", "https://example.com/pages/a", "A", "first", 1.0, 1.0, 2),
            ("r", "https://example.com/static/x.js", "asset", None, 1.0, 0.0, 3),
            ("r", "https://other.org/x", "", None, 0.0, 0.0, 4),
        ],
    )
    counts = spark.createDataFrame([("r", 5)], "run_id string, links_discovered long")
    doc = document.render_documents(p, sites, counts, "2024-05-06 07:08:09").first()
    lines = doc.llms_txt.split("\n")
    assert lines[0] == "# Example Site" and lines[1] == ""
    assert lines[2].startswith("> This file provides a structured overview of example.com ")
    assert lines[2].endswith("into the following sections: Home, Pages, External.")
    assert lines[3:7] == [">", "> - **Generated**: 2024-05-06 07:08 UTC", "> - **Pages crawled**: 5", "> - **Links discovered**: 5"]
    assert lines[7:9] == [">", "> **Website Description**: About it"]
    body = "\n".join(lines[9:])
    assert "## Pages\n\n- [A](https://example.com/pages/a): first\n- [B](https://example.com/pages/b)\n" in body
    assert "- [https://other.org/x](https://other.org/x)" in body
    assert "asset" not in body and doc.llms_txt.endswith(")\n")
    assert doc.size_bytes == len(doc.llms_txt.encode()) and doc.entry_count == 5
    stats = document.artifact_stats(document.render_documents(p, sites, counts)).first()
    assert stats.line_count == len(doc.llms_txt.splitlines()) and stats.word_count == len(doc.llms_txt.split())


def test_document_without_pages(spark):
    sites = spark.createDataFrame([("r", "https://example.com", "example.com")], SITES)
    p = _pages(spark, [])
    doc = document.render_documents(p, sites).first().llms_txt
    assert doc.startswith("# example.com\n") and "sections: various topics." in doc
    assert "**Pages crawled**: 0" in doc and doc.endswith("**Links discovered**: 0\n")


def test_distributed_lines_equal_rendered_text(spark, tmp_path):
    sites = spark.createDataFrame([("r", "https://example.com", "example.com"), ("q", "https://q.org", "q.org")], SITES)
    p = _pages(
        spark,
        [
            ("r", "https://example.com/", "Example Site", "About it", 1.0, 1.0, 0),
            ("r", "https://example.com/pages/b", "B", None, 1.0, 0.0, 1),
            ("r", "https://example.com/pages/a", "A", "first", 1.0, 1.0, 2),
            ("r", "https://example.com/docs/x", "X", None, 1.0, 0.0, 3),
            ("q", "https://q.org/z", "Z", None, 1.0, 0.0, 0),
        ],
    )
    docs = {r.run_id: r.llms_txt for r in document.render_documents(p, sites).collect()}
    lines = document.document_lines(p, sites).orderBy("run_id", "k0", "k1", "k2", "k3").collect()
    for run in ("r", "q"):
        text = "\n".join(x.line for x in lines if x.run_id == run).strip() + "\n"
        assert text == docs[run]
    out = str(tmp_path / "docs")
    document.write_documents(document.document_offsets(document.document_lines(p, sites)), out)
    for run in ("r", "q"):
        rows = spark.read.parquet(out).filter(F.col("run_id") == run).orderBy("line_no").collect()
        text = "\n".join(x.line for x in rows)
        assert text.strip() + "\n" == docs[run]
        for x in rows:
            assert text.encode()[x.byte_start:].startswith(x.line.encode())


def test_sizes_and_previews_from_lines_equal_string_form(spark):
    """Line breaks and blanks in titles, two pages of one entry URL, an end
    that is stripped, a site without pages, a site over many partitions."""
    names = ["r", "q", "none", "big"]
    sites = spark.createDataFrame([(n, f"https://{n}.org", f"{n}.org") for n in names], SITES)
    rows = [
        ("r", "https://r.org/", "Home \u00e4\u4e2d", "two\nlines\rthree\r\nfour", 1.0, 1.0, 0),
        ("r", "https://r.org/pages/b", "B\x0bB", "ends blank \u00a0\r\n ", 1.0, 0.0, 1),
        ("q", "https://q.org/docs/a b", "second", None, 1.0, 0.0, 0),
        ("q", "https://q.org/docs/a%20b", "first", "x\ny", 1.0, 0.0, 1),
    ]
    rows += [("big", f"https://big.org/s{i % 3}/{i}", f"Title {i}", "d" * (i % 50), 1.0, 1.0, i) for i in range(3000)]
    p = _pages(spark, rows)
    docs = document.render_documents(p, sites)
    lines, meta = document.document_lines(p, sites), document.site_meta(p, sites)
    stats = document.document_stats(lines, meta)
    by_run = lambda df: {r.run_id: r for r in df.collect()}
    assert by_run(stats) == by_run(document.artifact_stats(docs)) and len(by_run(stats)) == 4
    offsets = document.document_offsets(lines)
    text = {r.run_id: r.llms_txt for r in docs.collect()}
    for r in document.document_previews(offsets, max_lines=15).collect():
        all_lines = text[r.run_id].removesuffix("\n").split("\n")
        assert r.truncated == (r.line_count > 15)
        assert r.preview == ("\n".join(all_lines[:15]) if r.truncated else text[r.run_id])
    big = offsets.filter("run_id = 'big'").orderBy("line_no").collect()
    assert [r.line_no for r in big] == list(range(1, len(big) + 1)) and len(big) > 3000
    assert ("\n".join(r.line for r in big)).strip() + "\n" == text["big"]
    whole = text["big"].encode()
    assert all(whole[r.byte_start:r.byte_start + len(r.line)] == r.line.encode() for r in big)
