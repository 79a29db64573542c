import corpus_pipeline
from tests.llm.cases import folder, prose, rows
from tests.llm.test_selection import toxic_tables


def test_each_stage_acts_on_what_its_predecessor_kept(spark, tmp_path):
    data, labels = toxic_tables(300)
    data += [(k + 10_000, *rest) for k, *rest in rows(5) if k is not None]
    data += [(20_000 + i, "too short", "en", "a") for i in range(3)]
    path = folder(spark, tmp_path, data, labels)
    docs, ids = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "bpe":
            assert out.columns == columns
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    toxic = {i for i in range(300) if i % 4 == 0}
    assert not ids["toxicity"] & toxic and ids["toxicity"] >= set(range(300)) - toxic
    assert 20_000 in ids["toxicity"] - ids["quality_rules"]
    assert 10_003 in ids["near_duplicates"] and 10_044 in ids["quality_rules"] - ids["near_duplicates"]
    assert ids["mixing"] <= ids["near_duplicates"] and ids["bpe"] == ids["mixing"]
    final = corpus_pipeline.run(spark, path)
    assert final.count() == docs.count() and prose(0, 3)


def test_empty_table(spark, tmp_path):
    path = folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
