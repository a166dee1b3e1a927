"""Artifact names and choices. The names are derived from the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordprism.operators import catalog as cat
from wordprism.operators import views
from wordprism.plans.tables import stored
from wordprism.queries.base import plane, spans, table, texts
from wordprism.registry import cte, query
from wordprism.session import scratch_path

# Each document names one artifact: its source is the dataset, its language the model.
cte(
    "named",
    """
  select doc_id, case doc_id // 20 % 4
      when 0 then dataset || '_text.npz' when 1 then dataset || '_' || model || '_token_info.npz'
      when 2 then dataset || '_' || model || '-b' || layer || '_sentence_proj-' || proj || '.npz'
      else dataset || '_' || model || '-b' || layer || '_class_explanation-' || expl || '.npz' end as name,
    dataset, case when doc_id // 20 % 4 > 0 then model end as model, case when doc_id // 20 % 4 > 1 then layer end as layer,
    (['text', 'token', 'sentence', 'class'])[doc_id // 20 % 4 + 1] as kind,
    case doc_id // 20 % 4 when 1 then 'info' when 2 then 'proj' when 3 then 'explanation' end as opt,
    case doc_id // 20 % 4 when 2 then proj when 3 then expl end as method
  from (select doc_id, source || '-1000' as dataset, 'BERT-' || lang as model,
          (case when n_chars % 3 = 0 then 8 when n_chars % 3 = 1 then 12 else 100 end)::int as layer,
          (['PCA', 'UMAP', 'tSNE'])[n_chars % 3 + 1] as proj, (['LIME', 'SHAP'])[n_chars % 2 + 1] as expl
        from documents)""",
)


def named(spark, sf_dir):
    """``doc_id, name`` of the artifacts."""
    rows = table(spark, sf_dir, "documents")
    turn = F.col("n_chars") % 3
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))
    kind = pick(("text", "token", "sentence", "class"), F.floor(F.col("doc_id") / 20) % 4)
    method = F.when(kind == "sentence", pick(("PCA", "UMAP", "tSNE"), turn)).otherwise(pick(("LIME", "SHAP"), F.col("n_chars") % 2))
    layer = F.when(turn == 0, 8).when(turn == 1, 12).otherwise(100)
    name = cat.artifact_name(F.concat("source", F.lit("-1000")), F.concat(F.lit("BERT-"), "lang"), layer, kind, method)
    return rows.select("doc_id", F.concat(name, F.lit(".npz")).alias("name"))


def parsed(spark, sf_dir):
    """The catalog table: one row per artifact."""
    names = stored(named(spark, sf_dir).select("name").distinct(), "names")
    return stored(cat.parse_names(names).drop("name").distinct(), "catalog")


cte("artifact", "select distinct dataset, model, layer, kind, opt, method from named")


@query("cat_parse", "select * from named")
def cat_parse(spark, sf_dir):
    return cat.parse_names(named(spark, sf_dir))


@query(
    "cat_models",
    "select distinct dataset || '_' || model || '-b' || layer as model from artifact where kind not in ('text', 'token')",
)
def cat_models(spark, sf_dir):
    return cat.models(parsed(spark, sf_dir))


_ONE = "src1-1000", "BERT-en", 12
_BLOCK = "dataset = 'src1-1000' and model = 'BERT-en' and layer = 12"
_TOKEN = "dataset = 'src1-1000' and model = 'BERT-en' and kind = 'token'"
_TEXT = "dataset = 'src1-1000' and kind = 'text'"


@query(
    "cat_filter_model",
    f"""select dataset, kind, min(method) as method, coalesce(string_agg(distinct method, ',' order by method), '') as methods
        from artifact where ({_TEXT}) or ({_TOKEN}) or ({_BLOCK} and kind in ('sentence', 'class')) group by dataset, kind""",
)
def cat_filter_model(spark, sf_dir):
    rows = cat.filter_model(parsed(spark, sf_dir), *_ONE)
    return rows.withColumn("methods", F.array_join("methods", ","))


_LISTS = ", ".join(
    f"(select coalesce(string_agg(distinct method, ',' order by method), '') from artifact where {_BLOCK} and kind = '{kind}') as {name}"
    for kind, name in (("sentence", "projections"), ("class", "explanations"))
)


def _joined(rows):
    return rows.withColumns({c: F.array_join(c, ",") for c in ("projections", "explanations")})


@query(
    "cat_filter_projection",
    f"select *, {_LISTS} from artifact where ({_TEXT}) or ({_BLOCK} and kind = 'sentence' and method = 'UMAP')",
)
def cat_filter_projection(spark, sf_dir):
    return _joined(cat.filter_projection(parsed(spark, sf_dir), *_ONE, "UMAP"))


@query(
    "cat_filter_explanation",
    f"select *, {_LISTS} from artifact where ({_TOKEN}) or ({_BLOCK} and kind = 'class' and method = 'SHAP')",
)
def cat_filter_explanation(spark, sf_dir):
    return _joined(cat.filter_explanation(parsed(spark, sf_dir), *_ONE, "SHAP"))


@query(
    "scan_artifact",
    "select text_id, pos, token, \"start\", \"end\" from ctok where label = 'de'",
)
def scan_artifact(spark, sf_dir):
    """Writes tokens by label and reads one partition."""
    root = scratch_path(spark, "artifacts")
    cat.write_artifact(spans(spark, sf_dir), root, "tokens", ("label",))
    return cat.scan(spark, root, "tokens", label="de").drop("label")


@query("jn_label_projection", "select p.text_id, x, y, t.label from plane p join texts t using (text_id)")
def jn_label_projection(spark, sf_dir):
    return cat.label_projection(plane(spark, sf_dir).drop("label"), texts(spark, sf_dir))


@query(
    "q_page",
    """select ((rn - 1) // 10)::bigint as page, rn as row, text_id, ((rn - 1) // 10 * 10 + 1) || '-' || least((rn - 1) // 10 * 10 + 10, n) as label,
              rn > 10 as has_previous, (rn - 1) // 10 * 10 + 10 < n as has_next
       from (select text_id, row_number() over (order by ord) as rn, count(*) over () as n from texts)""",
)
def q_page(spark, sf_dir):
    """All pages of the text list with their controls."""
    rows = texts(spark, sf_dir).select("text_id", "ord")
    return views.paged(rows).select("page", "row", "text_id", "label", "has_previous", "has_next")
