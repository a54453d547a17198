"""The corpus pipeline against the operators' brute-force versions, stage by stage."""

import hashlib
import os

import pytest
from test_decontaminate import brute as contaminated
from test_simhash import brute_components

import corpus_pipeline as C

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after every stage."""
    docs, out = C.documents(spark, SF), []
    for name, stage in C.STAGES:
        after = C.materialize(stage(spark, docs, SF), "test-stage")
        out.append((name, docs, after))
        docs = after
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns_and_chain(stages):
    for name, before, after in stages[:-1]:
        assert after.schema == before.schema, name
    assert stages[-1][2].count() == stages[-2][2].count() > 100


def test_quality_stage(stages, spark):
    from sitelens.llm.quality import quality_rules

    _, before, after = stages[0]
    kept = {r.doc_id for r in quality_rules(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    assert rows_of(after) == [r for r in rows_of(before) if r[0] in kept]
    poor = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").join(before, "doc_id")
    assert poor.join(after, "doc_id", "left_semi").count() >= 0.9 * poor.count()


def test_one_document_per_group(stages):
    _, before, after = stages[1]
    component = brute_components([(r[0], r[1]) for r in rows_of(before)])
    assert rows_of(after) == [r for r in rows_of(before) if component[r[0]][1] == r[0]]


def test_no_contaminated_document(stages, spark):
    _, before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(r[0], r[1]) for r in rows_of(before)], items) if r[4]}
    assert bad and rows_of(after) == [r for r in rows_of(before) if r[0] not in bad]


def test_secrets_are_masked(stages):
    from test_secrets import brute_base

    _, before, after = stages[3]
    old = {r[0]: r for r in rows_of(before)}
    for doc_id, text, *_, n in rows_of(after):
        assert not brute_base(text.replace(C.MASK, " "))
        if C.MASK not in text:
            assert text == old[doc_id][1]
        assert n == len(text)


def test_ids_decode_to_the_texts(stages):
    _, before, after = stages[4]
    texts = {r[0]: r[1] for r in rows_of(before)}
    for r in after.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_on_edge_rows(edge_docs, few_labels, few_items, spark, tmp_path):
    for name, df in (("documents", edge_docs), ("labels", few_labels), ("benchmark", few_items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = C.documents(spark, str(tmp_path))
    for name, stage in C.STAGES[1:-1]:  # every stage on the rows as they are
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema, name
    grouped = C.keep_one_per_group(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in grouped if r.doc_id is not None) == [
        (1, None), (5, "same text of a repeated row"), (6, "one id"), (6, "two texts"),
        *[(r.doc_id, r.text) for r in edge_docs.filter("doc_id IN (7, 8)").orderBy("doc_id").collect()]]
    assert C.redact_secrets(spark, docs, str(tmp_path)).filter("doc_id = 1 AND text IS NULL").count() == 1
    out = C.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in out) and 1 not in {r.doc_id for r in out}


def test_run_on_empty_tables(no_docs, few_labels, few_items, spark, tmp_path):
    for name, df in (("documents", no_docs), ("labels", few_labels.filter("false")), ("benchmark", few_items.filter("false"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_quality_stage_uses_every_held_out_label(spark, tmp_path, monkeypatch):
    from sitelens.llm import quality as Q

    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 11} c{i}") for i in range(400)], "doc_id long, text string")
    # Far more labels than documents: a bounded share of them would lose documents.
    labels = spark.range(900_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "0 AS toxic")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    monkeypatch.setattr(Q, "exact_threshold", lambda scores: seen.append(scores.count()) or 0.0, raising=False)
    monkeypatch.setattr(Q, "best_threshold", lambda s, g: seen.append(len(s)) or 0.0)
    C.keep_quality(spark, docs, str(tmp_path))
    assert seen == [Q.labelled_sample(labels, 10**9).filter("fold = 0 AND doc_id < 400").count()]
