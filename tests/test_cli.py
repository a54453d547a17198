"""The batch CLI on stored tables: outputs per stage and llms.txt files
equal to the in-memory run."""

import glob
import os

import pyarrow.parquet as pq

from sitelens.plans import catalog, cli
from sitelens.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_cli_run_writes_all_outputs(spark, tmp_path):
    sites = str(tmp_path / "sites")
    caps = str(tmp_path / "captures")
    fx.sites(spark, SF).write.parquet(sites)
    fx.crawl_captures(spark, SF).write.parquet(caps)
    out = str(tmp_path / "out")
    written = cli.run(spark, sites, caps, out, documents=True)
    assert set(written) >= {"discovered", "pages", "canonical_pages", "scores", "artifacts", "llms_txt"}
    arts = {r.run_id: r.llms_txt for r in spark.read.parquet(written["documents"]).collect()}
    expected = {r.run_id: r.llms_txt for r in catalog.queries()["site_index_tiered"](spark, SF).collect()}
    assert arts == expected
    sizes = {r.run_id: (r.size_bytes, r.line_count) for r in spark.read.parquet(written["artifacts"]).collect()}
    assert sizes == {r: (len(t.encode()), len(t.splitlines())) for r, t in arts.items()}
    run_id = sorted(arts)[0]
    parts = sorted(glob.glob(os.path.join(written["llms_txt"], "part-*.parquet")))  # in document order
    lines = [r["line"] for p in parts for r in pq.read_table(p).to_pylist() if r["run_id"] == run_id]
    assert "\n".join(lines).strip() + "\n" == arts[run_id]
    assert not glob.glob(os.path.join(written["pages"], "run_id=*"))  # no folder per run
    runs = spark.read.parquet(written["runs"])
    assert {r.run_id for r in runs.filter("status = 'completed'").collect()} == set(arts)
    assert spark.read.parquet(written["transitions"]).count() == 15 * len(arts)
    events = spark.read.parquet(written["events"])
    assert events.filter("name LIKE 'stage.%'").count() == 5 * len(arts)
    assert events.filter("started_at IS NULL OR completed_at IS NULL").count() == 0


def test_cli_run_with_discovery_files_apart(spark, tmp_path):
    sites = str(tmp_path / "sites")
    pages = str(tmp_path / "pages")
    files = str(tmp_path / "files")
    fx.sites(spark, SF).write.parquet(sites)
    fx.page_captures(spark, SF, link_graph=True).unionByName(fx.discovery_captures(spark, SF)).write.parquet(pages)
    fx.discovery_captures(spark, SF).write.parquet(files)
    written = cli.run(spark, sites, pages, str(tmp_path / "out"), files_path=files, documents=True)
    arts = {r.run_id: r.llms_txt for r in spark.read.parquet(written["documents"]).collect()}
    expected = {r.run_id: r.llms_txt for r in catalog.queries()["site_index_tiered"](spark, SF).collect()}
    assert arts == expected
