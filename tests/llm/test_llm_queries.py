"""Registered queries of the training-data operators: SQL on the smallest tables, and the pipeline stage by stage."""

import os

import pytest

import oracle_check

SF = "sf0.001"
present = pytest.mark.skipif(not os.path.isdir(f"{oracle_check.ROOT}/{SF}"), reason="no test tables")


@present
@pytest.mark.parametrize("name", ["op2_block_neighbours", "op3_ngram_join", "op5_source_mix", "op6_url_filter", "op7_decontaminate", "op10_substring_dedup", "op11_phrase_mining", "op12_importance_resample", "op13_minhash_dedup"])
def test_equals_sql(spark, name):
    assert oracle_check.compare(spark, oracle_check.database(SF), name, SF) is None


@present
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    folder = f"{oracle_check.ROOT}/{SF}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder).cache()
        sizes.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "n-gram Jaccard join":
            from wordprism.llm.ngram_join import similar_groups

            assert similar_groups(docs, 5, 80).where("doc_id <> component_id").count() == 0
        if name == "benchmark decontamination":
            from wordprism.llm.decontaminate import contamination

            assert contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").count() == 0
    assert sizes[0] <= 200 and sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[4] == sizes[3]
    assert sorted(r.doc_id for r in P.run(spark, folder).collect()) == sorted(r.doc_id for r in docs.collect())
