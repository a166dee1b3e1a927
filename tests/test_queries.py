"""Registered queries against their SQL, and rules for their plans.

The quick queries run here on the smallest tables; ``tests/oracle_check.py`` runs all.
"""

import os

import pytest

import oracle_check
from wordprism.registry import ORACLES, QUERIES

SF = "sf0.001"
QUICK = (
    "src_corpus", "prj_onehot_label", "fn_map_text", "flt_stop_words", "tok_spans", "tok_vocab", "agg_iqr_filter",
    "agg_zipf_filter", "emb_token_norm", "smp_quota", "smp_stratified", "agg_silhouette", "ml_knn", "cat_filter_model",
    "sel_lasso", "q_word_refilter", "q_page", "ann_align", "ann_lemma", "idx_inverted", "emb_mean_pool", "sel_lasso_many",
    "cat_filter_projection", "cat_filter_explanation", "ml_linear_classifier", "ml_shap", "agg_infidelity", "snk_explanation_rows",
    "jn_token_explanation", "src_folder_corpus", "ml_pca", "ml_svd",
)
present = pytest.mark.skipif(not os.path.isdir(f"{oracle_check.ROOT}/{SF}"), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle_check.database(SF)


@present
@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, con, name):
    assert oracle_check.compare(spark, con, name, SF) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@present
@pytest.mark.parametrize("name", ("tok_spans", "agg_zipf_filter", "idx_inverted", "sel_lasso", "emb_token_norm", "q_word_refilter", "ml_knn", "sel_lasso_many", "ann_align"))
def test_plans_have_no_cross_join(spark, name):
    plan = QUERIES[name](spark, f"{oracle_check.ROOT}/{SF}")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@present
def test_spans_need_no_shuffle(spark):
    from wordprism.operators.tokens import token_spans
    from wordprism.sources.corpus import documents

    rows = token_spans(documents(spark, f"{oracle_check.ROOT}/{SF}/documents.parquet"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
