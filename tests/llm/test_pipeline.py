import pytest

import corpus_pipeline
from tidewatch.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "training_order"]


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage kept, over the small tables."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL))
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_take_effect(spark, kept):
    from tidewatch.llm import decontaminate, simhash

    for df in kept[:-1]:
        assert df.columns == corpus_pipeline.DOCUMENT
    n = [df.count() for df in kept]
    assert n[0] >= n[1] >= n[2] >= n[3] > 0
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(kept[1]).collect()}
    assert {r["doc_id"] for r in kept[2].collect()} == {i for i, c in groups.items() if i == c}
    assert decontaminate.find_leaks(kept[3], spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    assert max(r["count"] for r in kept[4].groupBy("doc_id").count().collect()) <= 2
    assert {r["doc_id"] for r in kept[5].select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept[4].select("doc_id").distinct().collect()}


def test_the_last_stage_as_shards(spark, kept, tmp_path):
    from tidewatch.llm import tokens

    path = str(tmp_path / "shards")
    assert corpus_pipeline.write(spark, SMALL, path) > 0
    assert {r["slot"]: bytes(r["tokens"]) for r in tokens.read_from(spark, path, 0).collect()} == {r["slot"]: bytes(r["tokens"]) for r in kept[5].collect()}


def test_run_gives_the_last_stage(spark, kept):
    a = {(r["slot"], r["doc_id"], r["seq"], bytes(r["tokens"])) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert a == {(r["slot"], r["doc_id"], r["seq"], bytes(r["tokens"])) for r in kept[5].collect()}
