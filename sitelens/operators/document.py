"""llms.txt documents.

``document_lines`` is the distributed form: one row per heading or entry with
a sort key, so a very large site spreads over many tasks.  From these rows
follow the place of every line (``document_offsets``, prefix sums), the sizes
(``document_stats``, partial sums) and the previews (``document_previews``); no
row or task holds a document.  ``render_documents`` builds the single string
per site, an export for sites of moderate size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.config import ARTIFACT_PREVIEW_LINES, DOC_INTRO, DOC_NO_SECTIONS, DOC_TIME_FORMAT
from sitelens.functions.ordering import keyed_prefix_sums
from sitelens.functions.text import py_strip, split_lines
from sitelens.functions.urls import host_sql, is_home, normalize_http_url, section_name


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def sectioned_entries(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """C4: entries with their section; excluded pages are dropped.

    Columns: run_id, section, sec_ord, url, line, ord.
    """
    p = pages.join(sites.select("run_id", "hostname"), "run_id")
    p = p.withColumn("section", section_name("url", "hostname")).filter(F.col("section").isNotNull())
    p = p.withColumn("entry_url", F.coalesce(normalize_http_url("url"), F.col("url")))
    title = F.when(_nonempty(F.col("title")), F.col("title")).otherwise(F.col("url"))
    line = F.concat(
        F.lit("- ["), title, F.lit("]("), F.col("entry_url"), F.lit(")"),
        F.when(_nonempty(F.col("description")), F.concat(F.lit(": "), F.col("description"))).otherwise(F.lit("")),
    )
    # Section order = first position of any entry in it.  A partial
    # aggregate + join instead of a window keeps a hot section from landing
    # in one task (AQE splits the skewed join side).
    first = p.groupBy("run_id", "section").agg(F.min("ord").alias("sec_ord"))
    return p.join(first, ["run_id", "section"]).select(
        "run_id", "section", "sec_ord", F.col("entry_url").alias("url"), line.alias("line"), "ord"
    )


def site_meta(pages: DataFrame, sites: DataFrame, discovered_counts: DataFrame | None = None) -> DataFrame:
    """C6 + counts: home-page title/description, pages crawled, links
    discovered (falls back to the page count)."""
    p = pages.join(sites.select("run_id", "hostname"), "run_id")
    home = F.when(is_home("url", "hostname"), F.struct(F.col("ord"), F.col("title"), F.col("description")))
    agg = p.groupBy("run_id").agg(F.min(home).alias("home"), F.count(F.lit(1)).alias("pages_crawled"))
    meta = sites.select("run_id", "hostname").join(agg, "run_id", "left")
    if discovered_counts is not None:
        meta = meta.join(discovered_counts.select("run_id", "links_discovered"), "run_id", "left")
    else:
        meta = meta.withColumn("links_discovered", F.lit(None).cast("long"))
    n = F.coalesce(F.col("pages_crawled"), F.lit(0)).cast("long")
    links = F.coalesce(F.col("links_discovered"), F.lit(0)).cast("long")
    return meta.select(
        "run_id",
        "hostname",
        F.col("home.title").alias("site_title"),
        F.col("home.description").alias("site_description"),
        n.alias("pages_crawled"),
        F.when(links != 0, links).otherwise(n).alias("links_discovered"),
    )


def _header(generated_at: str) -> Column:
    host = F.expr(host_sql("concat('//', hostname)"))  # without a port
    heading = F.when(_nonempty(F.col("site_title")), F.col("site_title")).otherwise(F.col("hostname"))
    heading = F.when(_nonempty(heading), heading).otherwise(host)
    sections = F.when(_nonempty(F.col("section_list")), F.col("section_list")).otherwise(F.lit(DOC_NO_SECTIONS))
    pre, rest = DOC_INTRO.split("{host}")
    mid, post = rest.split("{sections}")
    intro = F.concat(F.lit(pre), host, F.lit(mid), sections, F.lit(post))
    ts = F.date_format(F.to_timestamp(F.lit(generated_at)), DOC_TIME_FORMAT)
    lines = F.concat(
        F.lit("# "), heading, F.lit("\n\n"), intro, F.lit("\n>\n> - **Generated**: "), ts,
        F.lit("\n> - **Pages crawled**: "), F.col("pages_crawled").cast("string"),
        F.lit("\n> - **Links discovered**: "), F.col("links_discovered").cast("string"),
        F.when(
            _nonempty(F.col("site_description")),
            F.concat(F.lit("\n>\n> **Website Description**: "), F.col("site_description")),
        ).otherwise(F.lit("")),
    )
    return lines


def render_documents(
    pages: DataFrame,
    sites: DataFrame,
    discovered_counts: DataFrame | None = None,
    generated_at: str = "2024-01-31 00:00:00",
) -> DataFrame:
    """One llms.txt per site.

    Two aggregation levels: entries -> section blocks keyed by
    (run_id, section), then blocks -> document keyed by run_id.
    Columns: run_id, hostname, llms_txt, size_bytes, entry_count.
    """
    entries = sectioned_entries(pages, sites)
    blocks = entries.groupBy("run_id", "section", "sec_ord").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("url", "line"))), lambda x: x["line"]), "\n"
        ).alias("body")
    )
    blocks = blocks.select(
        "run_id", "section", "sec_ord", F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("body")).alias("block")
    )
    per_site = blocks.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("sec_ord", "section", "block"))).alias("bs")
    )
    meta = site_meta(pages, sites, discovered_counts).join(per_site, "run_id", "left")
    meta = meta.withColumn("section_list", F.array_join(F.transform("bs", lambda b: b["section"]), ", "))
    body = F.array_join(F.transform("bs", lambda b: b["block"]), "\n\n")
    text = F.concat(
        _header(generated_at),
        F.when(F.size(F.coalesce(F.col("bs"), F.array())) > 0, F.concat(F.lit("\n\n"), body)).otherwise(F.lit("")),
    )
    text = F.concat(py_strip(text), F.lit("\n"))
    out = meta.select("run_id", "hostname", text.alias("llms_txt"), F.col("pages_crawled").alias("entry_count"))
    return out.select("run_id", "hostname", "llms_txt", F.octet_length("llms_txt").cast("long").alias("size_bytes"), "entry_count")


def document_lines(
    pages: DataFrame,
    sites: DataFrame,
    discovered_counts: DataFrame | None = None,
    generated_at: str = "2024-01-31 00:00:00",
) -> DataFrame:
    """C5 in distributed form: rows (run_id, k0, k1, k2, k3, line); sorted by
    the keys they give the document without collecting a site into one row.

    k0: 0 header, 1 body; k1: section order (the pages' ``ord`` type);
    k2: 0 section heading, 1 entry; k3: entry URL.
    """
    entries = sectioned_entries(pages, sites)
    sec = entries.groupBy("run_id", "section", "sec_ord").agg(F.lit(1).alias("_"))
    names = sec.groupBy("run_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("sec_ord", "section"))), lambda b: b["section"]), ", "
        ).alias("section_list")
    )
    ord_type = entries.schema["sec_ord"].dataType
    meta = site_meta(pages, sites, discovered_counts).join(names, "run_id", "left")
    head = meta.select(
        "run_id", F.lit(0).alias("k0"), F.lit(None).cast(ord_type).alias("k1"), F.lit(0).alias("k2"),
        F.lit("").alias("k3"), _header(generated_at).alias("line"),
    )
    heads = sec.select(
        "run_id", F.lit(1).alias("k0"), F.col("sec_ord").alias("k1"), F.lit(0).alias("k2"), F.lit("").alias("k3"),
        F.concat(F.lit("\n## "), "section", F.lit("\n")).alias("line"),
    )
    body = entries.select(
        "run_id", F.lit(1).alias("k0"), F.col("sec_ord").alias("k1"), F.lit(1).alias("k2"), F.col("url").alias("k3"), "line"
    )
    return head.unionByName(heads).unionByName(body)


def document_offsets(lines: DataFrame) -> DataFrame:
    """(run_id, line_no, byte_start, line): every line of every document (cut
    at line feeds) with its number from 1 and the bytes before it.

    Both are prefix sums over a range partitioning, so a site spans tasks.
    The document is the lines joined by line feeds, stripped, and a final
    line feed.
    """
    # Entries of one URL are ordered by their text, as in the string form.
    parts = lines.select(
        "run_id", "k0", "k1", "k2", "k3", F.when(F.col("k2") == 1, F.col("line")).otherwise("").alias("k4"),
        F.posexplode(F.split("line", "\n")).alias("k5", "line"),
    )
    sums = {"line_no": F.lit(1), "byte_start": F.octet_length("line") + 1}
    placed = keyed_prefix_sums(parts, ["run_id"], ["k0", "k1", "k2", "k3", "k4", "k5"], sums)
    return placed.select("run_id", (F.col("line_no") + 1).alias("line_no"), "byte_start", "line")


def write_documents(offsets: DataFrame, path: str) -> None:
    """Document sink: (run_id, line_no, byte_start, line) in document order,
    range-partitioned, so a very large site spans several tasks and many small
    sites share a file."""
    keys = ["run_id", "line_no"]
    offsets.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def _sizes(text: Column) -> dict[str, Column]:
    return {
        "size_bytes": F.octet_length(text),
        "line_count": F.size(split_lines(text)),
        "word_count": F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")),
    }


def document_stats(lines: DataFrame, meta: DataFrame) -> DataFrame:
    """C7 from ``document_lines`` and ``site_meta``: the sizes of each document
    by partial sums; only the end of the last line, which is stripped, is
    measured apart."""
    text = F.concat("line", F.lit("\n"))
    at = F.struct("k0", "k1", "k2", "k3", "line")
    sums = lines.groupBy("run_id").agg(*[F.sum(c).alias(x) for x, c in _sizes(text).items()], F.max(at).getField("line").alias("last"))
    whole, kept = (_sizes(F.concat(c, F.lit("\n"))) for c in (F.col("last"), py_strip("last")))
    counted = sums.join(meta.select("run_id", F.col("pages_crawled").alias("entry_count")), "run_id")
    size, line_count, word_count = ((F.col(x) - whole[x] + kept[x]).cast("long").alias(x) for x in whole)
    return counted.select("run_id", size, "entry_count", line_count, word_count)


def document_previews(offsets: DataFrame, max_lines: int = ARTIFACT_PREVIEW_LINES) -> DataFrame:
    """V11 from ``document_offsets``: (run_id, line_count, truncated, preview);
    a group collects ``max_lines`` lines at most."""
    shown = F.collect_list(F.when(F.col("line_no") <= max_lines, F.struct("line_no", "line")))
    out = offsets.groupBy("run_id").agg(F.count("*").alias("line_count"), F.array_sort(shown).alias("shown"))
    text = F.array_join(F.transform("shown", lambda x: x["line"]), "\n")
    truncated = F.col("line_count") > max_lines
    preview = F.when(truncated, text).otherwise(F.concat(py_strip(text), F.lit("\n")))
    return out.select("run_id", "line_count", truncated.alias("truncated"), preview.alias("preview"))


def artifact_stats(artifacts: DataFrame) -> DataFrame:
    """C7 / V11 of stored strings: bytes, entries, lines and words of each document."""
    size, line_count, word_count = (c.cast("long").alias(x) for x, c in _sizes(F.col("llms_txt")).items())
    return artifacts.select("run_id", size, F.col("entry_count").cast("long").alias("entry_count"), line_count, word_count)
