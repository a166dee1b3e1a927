"""Scaling, classification, attributions, reports and the class-to-token links."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordprism.operators import catalog as cat
from wordprism.operators import classify, explain, sample, stats, surrogates, svm, views
from wordprism.plans.tables import stored
from wordprism.queries.base import content_frequency, spans, texts, token_weights
from wordprism.registry import cte, query
from wordprism.session import scratch_path


class Setting(NamedTuple):
    """What the explainers start from."""

    tokens: DataFrame  # token
    cells: DataFrame  # text_id, token, weight
    split: DataFrame  # text_id, label, ord, part
    scaler: DataFrame  # token, lo, span
    values: DataFrame  # text_id, token, value
    frequency: DataFrame | None = None  # token, frequency: all content tokens

    @property
    def train(self) -> DataFrame:
        return self.split.where("part = 'train'")

    @property
    def test(self) -> DataFrame:
        """A few rows per class, so they are sent to the tables that they meet."""
        return F.broadcast(self.split.where("part = 'test'"))


def setting(spark, sf_dir) -> Setting:
    """Kept tokens, their cells, the split and the scaled cells, each written once."""
    frequency = stored(content_frequency(spark, sf_dir), "frequency")
    kept = stats.iqr_filter(frequency, stats.LOWEST_FREQUENCY)
    tokens = stored(kept.select("token"), "kept")
    cells = stored(token_weights(spark, sf_dir, kept=tokens), "cells")
    split = stored(sample.train_test(texts(spark, sf_dir).select("text_id", "label", "ord")), "split")
    test = split.where("part = 'test'").select("text_id").distinct()
    scaler = stored(classify.fit_minmax(cells, split.where("part = 'train'"), tokens, others=test), "scaler")
    values = stored(classify.apply_minmax(cells, scaler, split, complete=True), "values")
    return Setting(tokens, cells, split, scaler, values, frequency)


def centroid_model(s: Setting) -> classify.LinearModel:
    model = classify.fit_centroids(s.values, s.train, s.tokens)
    return classify.LinearModel(stored(model.coef, "coef"), stored(model.classes, "classes"))


cte(
    "scaler",
    """
  select token, case when c = n then lo else least(coalesce(lo, 0), 0) end as lo,
         case when hi > case when c = n then lo else least(coalesce(lo, 0), 0) end
              then hi - case when c = n then lo else least(coalesce(lo, 0), 0) end else 1 end as span
  from (select k.token, min(weight) as lo, case when count(weight) = any_value(n) then max(weight) else greatest(coalesce(max(weight), 0), 0) end as hi,
               count(weight) as c, any_value(n) as n
        from kept k cross join (select count(*) as n from split where part = 'train')
        left join (select * from cells where text_id in (select text_id from split where part = 'train')) c on c.token = k.token
        group by k.token)""",
)
cte("scaled", "select text_id, token, (weight - lo) / span as value from cells join scaler using (token)")
cte(
    "centroid",
    """
  select "class", k.token, coalesce(s, 0) / n as m
  from kept k cross join (select label as "class", count(*) as n from split where part = 'train' group by 1) z
  left join (select label, token, sum(value) as s from scaled join split using (text_id) where part = 'train' group by 1, 2) u
    on u.label = z."class" and u.token = k.token""",
)
cte("coef", 'select "class", token, 2 * m as weight from centroid')
cte("bias", 'select "class", -sum(m * m) as bias from centroid group by 1')
cte(
    "margin",
    """
  select t.text_id, b."class", bias + coalesce(s, 0) as margin
  from (select text_id from split where part = 'test') t cross join bias b
  left join (select text_id, "class", sum(value * weight) as s from scaled join coef using (token)
             where text_id in (select text_id from split where part = 'test') group by 1, 2) u
    on u.text_id = t.text_id and u."class" = b."class\"""",
)
cte("prob", 'select text_id, "class", p / sum(p) over (partition by text_id) as prob from ('
    'select text_id, "class", 1 / (1 + exp(-margin)) as p from margin)')
cte(
    "predicted",
    """
  select text_id, label, "class" as predicted, prob as predicted_prob from prob join split using (text_id)
  qualify row_number() over (partition by text_id order by prob desc, "class") = 1""",
)
cte(
    "phi",
    """
  select p.text_id, c.token, c.weight * (coalesce(v.value, 0) - g.m) as phi
  from predicted p join coef c on c."class" = p.predicted
  join (select token, sum(value) / (select count(*) from predicted) as m from scaled
        where text_id in (select text_id from predicted) group by 1) g on g.token = c.token
  left join scaled v on v.text_id = p.text_id and v.token = c.token""",
)
cte(
    "attribution",
    """
  select c."class", c.token, coalesce(score, 0) as score from coef c
  left join (select predicted as "class", token, sum(abs(phi)) / any_value(n) as score
             from phi join predicted using (text_id) join (select predicted, count(*) as n from predicted group by 1) using (predicted)
             group by 1, 2) s using ("class", token)""",
)


@query("ml_label_encode", "select label, row_number() over (order by label) - 1 as code from (select distinct label from texts)")
def ml_label_encode(spark, sf_dir):
    return classify.encode_labels(texts(spark, sf_dir))


@query("ml_minmax", "select text_id, token, round(value, 6) as value from scaled")
def ml_minmax(spark, sf_dir):
    return setting(spark, sf_dir).values.select("text_id", "token", F.round("value", 6).alias("value"))


@query("ml_predict", "select text_id, label, predicted, round(predicted_prob, 6) as predicted_prob from predicted")
def ml_predict(spark, sf_dir):
    s = setting(spark, sf_dir)
    rows = classify.predict(s.values, s.test, centroid_model(s))
    return rows.withColumn("predicted_prob", F.round("predicted_prob", 6))


@query(
    "ml_linear_classifier",
    """
  select "class", (select count(*) from split where part = 'train' and label is not null) as n_rows, count(*) as n_own,
         true as within, true as bounded, true as settled
  from (select label as "class" from split where part = 'train' and label is not null) group by 1""",
)
def ml_linear_classifier(spark, sf_dir):
    """The SVM per class, as its certificate: coefficients that follow from the dual variables, and a gap within bounds.

    The optimum has no closed form, but weak duality proves from both tables that no
    coefficients have an objective lower by more than the gap.
    """
    s = setting(spark, sf_dir)
    return svm.certificate(s.values, s.train, dual_fit(s))


@query("ml_svm_coefficients")
def ml_svm_coefficients(spark, sf_dir):
    """The coefficient table of the SVM per class."""
    return dual_fit(setting(spark, sf_dir)).coef


def dual_fit(s: Setting) -> svm.DualFit:
    fit = svm.fit_dual(s.values, s.train, stored(numbered_tokens(s.tokens), "vocab"))
    return fit._replace(coef=stored(fit.coef, "coef"))


def svm_model(s: Setting) -> classify.LinearModel:
    model = classify.with_sigmoids(dual_fit(s))
    return model._replace(classes=stored(model.classes, "classes"))


def svm_predictions(s: Setting) -> tuple[classify.LinearModel, DataFrame]:
    model = svm_model(s)
    return model, stored(classify.predict(s.values, s.test, model), "predictions")


@query("ml_svm_predict")
def ml_svm_predict(spark, sf_dir):
    """Class and probability of the test rows by the SVM; ``ml_predict`` has them by the class centroids."""
    return svm_predictions(setting(spark, sf_dir))[1]


def numbered_tokens(tokens: DataFrame) -> DataFrame:
    from wordprism.plans.ranking import with_global_rank

    return with_global_rank(tokens, ["token"], "idx")


_REPORT = """
  select c."class", coalesce(hits::double / nullif(called, 0), 0) as precision, coalesce(hits::double / nullif(support, 0), 0) as recall,
         coalesce(2.0::double * hits / nullif(called + support, 0), 0) as f1, support, accuracy
  from (select b."class", count(*) filter (predicted = b."class") as called, count(*) filter (label = b."class") as support,
               count(*) filter (label = b."class" and predicted = b."class") as hits
        from predicted cross join bias b group by 1) c,
       (select count(*) filter (label = predicted)::double / count(*) as accuracy from predicted)"""
_MEASURES = ("precision", "recall", "f1", "accuracy")


def _rounded(df, names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


@query(
    "agg_class_report",
    'select "class", ' + ", ".join(f"round({m}, 6) as {m}" for m in _MEASURES) + f", support from ({_REPORT})",
)
def agg_class_report(spark, sf_dir):
    s = setting(spark, sf_dir)
    model = centroid_model(s)
    return _rounded(stats.class_report(classify.predict(s.values, s.test, model), model.classes), _MEASURES)


@query(
    "agg_report_summary",
    f"""select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1,
               round(max(accuracy), 6) as accuracy from ({_REPORT})""",
)
def agg_report_summary(spark, sf_dir):
    s = setting(spark, sf_dir)
    model = centroid_model(s)
    report = stats.class_report(classify.predict(s.values, s.test, model), model.classes)
    return _rounded(stats.report_summary(report), _MEASURES)


@query("agg_svm_class_report")
def agg_svm_class_report(spark, sf_dir):
    model, predictions = svm_predictions(setting(spark, sf_dir))
    return stats.class_report(predictions, model.classes)


@query("agg_svm_report_summary")
def agg_svm_report_summary(spark, sf_dir):
    model, predictions = svm_predictions(setting(spark, sf_dir))
    return stats.report_summary(stats.class_report(predictions, model.classes))


def explained(spark, sf_dir):
    """The class centroids as a linear model, which SQL can state, with its predictions and attributions."""
    s = setting(spark, sf_dir)
    model = centroid_model(s)
    predictions = stored(classify.predict(s.values, s.test, model), "predictions")
    phi = stored(explain.shap_linear(s.values, s.test, predictions, model), "phi")
    return s, model, predictions, phi


@query("ml_shap_linear", "select text_id, token, round(phi, 6) + 0.0 as phi from phi")
def ml_shap_linear(spark, sf_dir):
    return explained(spark, sf_dir)[3].select("text_id", "token", (F.round("phi", 6) + 0.0).alias("phi"))


@query("ml_lime")
def ml_lime(spark, sf_dir):
    s = setting(spark, sf_dir)
    model, predictions = svm_predictions(s)
    return surrogates.lime(s.values, s.train, predictions, model)


cte(
    "walked",
    """
  with t as (select text_id, predicted as c from predicted),
  x as (select text_id, token, value from scaled where text_id in (select text_id from t)),
  dx as (
    select r, b, token, sum(v) as dx from (
      select x.text_id as r, t.text_id as b, token, value as v from x cross join t union all select t.text_id, x.text_id, token, -value from x cross join t)
    where r <> b group by 1, 2, 3 having sum(v) <> 0),
  drawn as (select *, md5('1537:' || p || ':' || token) as k from dx cross join (select unnest(range(10)) as p)),
  along as (
    select r, b, p, token, k, c."class", sum(dx * weight) over (partition by r, b, p, c."class" order by k, token) as s from drawn join coef c using (token)),
  f as (
    select r, b, p, token, k, max(case when e."class" = c then q end) / sum(q) as f
    from (select a.*, 1 / (1 + exp(-(margin + s))) as q from along a join margin m on m.text_id = a.b and m."class" = a."class") e
    join t on t.text_id = r group by 1, 2, 3, 4, 5),
  f0 as (
    select t.text_id as r, m.text_id as b, max(case when m."class" = c then 1 / (1 + exp(-margin)) end) / sum(1 / (1 + exp(-margin))) as f0
    from t cross join margin m group by 1, 2),
  base as (select r, sum(f0) / count(*) as base from f0 group by 1),
  steps as (
    select r, p, token, k, sum(f - before) / (select count(*) from t) as df
    from (select f.*, coalesce(lag(f) over (partition by r, b, p order by k, token), f0) as before from f join f0 using (r, b)) group by 1, 2, 3, 4),
  mean as (
    select r, p, token, base + sum(df) over w as after, base + coalesce(sum(df) over (w rows between unbounded preceding and 1 preceding), 0) as before
    from steps join base using (r) window w as (partition by r, p order by k, token))
  select r as text_id, token, sum(ln(after / (1 - after)) - ln(before / (1 - before))) / 10 as phi from mean group by 1, 2""",
)


@query("ml_shap", "select text_id, token, round(phi, 6) + 0.0 as phi from walked")
def ml_shap(spark, sf_dir):
    """SHAP by permutations of the model that SQL can state; ``ml_svm_shap`` has it of the SVM."""
    s = setting(spark, sf_dir)
    model = centroid_model(s)
    predictions = stored(classify.predict(s.values, s.test, model), "predictions")
    phi = surrogates.permutation_shap(s.values, predictions, model)
    return phi.select("text_id", "token", (F.round("phi", 6) + 0.0).alias("phi"))


@query("ml_svm_shap")
def ml_svm_shap(spark, sf_dir):
    s = setting(spark, sf_dir)
    model, predictions = svm_predictions(s)
    return surrogates.permutation_shap(s.values, predictions, model)


@query("agg_class_attribution", 'select "class", token, round(score, 6) as score from attribution')
def agg_class_attribution(spark, sf_dir):
    _, model, predictions, phi = explained(spark, sf_dir)
    return _rounded(explain.class_attribution(phi, predictions, model), ("score",))


_UNIT = "((('0x' || substr(md5('1537:' || text_id || ':' || token || ':' || draw || ':{0}'), 1, 12))::bigint)::double + 0.5) / 281474976710656.0::double"
cte(
    "infidel",
    f"""
  with noisy as (
    select text_id, token, draw, 0.01 * sqrt(-2.0 * ln({_UNIT.format('u')})) * cos(2.0 * pi() * {_UNIT.format('v')}) as i
    from (select text_id, token, unnest(range(10)) as draw
          from predicted p join coef c on c."class" = p.predicted)),
  shift as (
    select n.text_id, draw, c."class", sum(i * weight) as d, sum(i * coalesce(phi, 0)) as ip
    from noisy n join coef c using (token) left join phi f on f.text_id = n.text_id and f.token = n.token group by 1, 2, 3),
  moved as (select text_id, draw, "class", ip, 1 / (1 + exp(-(margin - d))) as p from margin join shift using (text_id, "class"))
  select text_id, avg((ip - (predicted_prob - after)) ** 2) as infidelity
  from (select text_id, draw, any_value(ip) as ip, max(p) / sum(p) as after from moved group by 1, 2)
  join predicted using (text_id) group by 1""",
)


@query("agg_infidelity", "select text_id, round(infidelity, 6) as infidelity from infidel")
def agg_infidelity(spark, sf_dir):
    s, model, predictions, phi = explained(spark, sf_dir)
    return _rounded(explain.infidelity(s.values, predictions, phi, model), ("infidelity",))


@query(
    "agg_infidelity_summary",
    "select round(avg(infidelity), 6) as mean, round(stddev_samp(infidelity), 6) as std from infidel",
)
def agg_infidelity_summary(spark, sf_dir):
    s, model, predictions, phi = explained(spark, sf_dir)
    rows = explain.infidelity(s.values, predictions, phi, model)
    return _rounded(stats.infidelity_summary(rows), ("mean", "std"))


cte(
    "shown",
    """
  select "class", token, score as value from attribution
  where score > 0 and "class" in (select "class" from attribution group by 1 having min(score) <> max(score))
  qualify row_number() over (partition by "class" order by round(score, 9) desc, token) <= 5""",
)


def sankey(spark, sf_dir):
    _, model, predictions, phi = explained(spark, sf_dir)
    scores = explain.class_attribution(phi, predictions, model).withColumn("score", F.round("score", 9))
    return views.sankey_links(scores), model


@query("q_sankey", 'select "class", token, round(value, 6) as value from shown')
def q_sankey(spark, sf_dir):
    return _rounded(sankey(spark, sf_dir)[0], ("value",))


@query(
    "q_sankey_fixed",
    """
  with total as (select "class", sum(value) as total from selected_links group by 1)
  select 'class' as type, b."class" as node, case when total is null then round((select min(total) from total) / 2, 6) end as fixed_value
  from (select distinct label as "class" from texts) b left join total using ("class")
  union all select distinct 'token', token, null from selected_links""",
)
def q_sankey_fixed(spark, sf_dir):
    """Nodes for the links of a lasso selection; classes without links get a size."""
    from wordprism.operators import select
    from wordprism.queries.base import plane
    from wordprism.queries.select import POLYGON, share

    scores, rows = share(spark, sf_dir)
    ids = select.lasso(plane(spark, sf_dir), POLYGON)
    selected = select.selected_labels(texts(spark, sf_dir), ids)
    found = stored(views.sankey_links(scores, rows, selected), "links")
    classes = texts(spark, sf_dir).select(F.col("label").alias("class"))
    return _rounded(views.sankey_nodes(found, classes), ("fixed_value",))


@query(
    "jn_token_explanation",
    'select text_id, label, pos, token, "start", "end" from ctok where token in (select token from attribution)',
)
def jn_token_explanation(spark, sf_dir):
    s, model, predictions, phi = explained(spark, sf_dir)
    scores = explain.class_attribution(phi, predictions, model)
    found = cat.tokens_of_explanation(scores, spans(spark, sf_dir), s.frequency)
    return found.select("text_id", "label", "pos", "token", "start", "end")


def explained_rows(s: Setting, model: classify.LinearModel, predictions: DataFrame, phi: DataFrame) -> DataFrame:
    """The record of every explained row: original and predicted label, its probability, and the infidelity."""
    measured = explain.infidelity(s.values, predictions, phi, model)
    return predictions.select("text_id", "label", "predicted", "predicted_prob").join(measured, "text_id")


def saved_explanation(spark, sf_dir) -> str:
    """Attribution, class report and row records by method in a new store; returns its folder."""
    s, model, predictions, phi = explained(spark, sf_dir)
    method, root = F.lit("SHAP").alias("method"), scratch_path(spark, "artifacts")
    cat.save_explanation(
        explain.class_attribution(phi, predictions, model).select(method, "class", "token", "score"),
        stats.class_report(predictions, model.classes).select(method, "class", "precision", "recall", "f1", "accuracy"),
        explained_rows(s, model, predictions, phi).select(method, "*"),
        root, "documents", "hashed", 0,
    )
    return root


_STORED = {"dataset": "documents", "model": "hashed", "layer": 0, "method": "SHAP"}


@query("snk_explanation", """select 'SHAP' as method, "class", token, round(score, 6) as score from attribution""")
def snk_explanation(spark, sf_dir):
    """Attributions, written with their reports and read back by method."""
    rows = cat.scan(spark, saved_explanation(spark, sf_dir), "explanation", **_STORED)
    return _rounded(rows.select("method", "class", "token", "score"), ("score",))


@query(
    "snk_explanation_rows",
    """select 'SHAP' as method, text_id, label, predicted, round(predicted_prob, 6) as predicted_prob, round(infidelity, 6) as infidelity
       from predicted join infidel using (text_id)""",
)
def snk_explanation_rows(spark, sf_dir):
    """The records of the explained rows, read back from the same store."""
    rows = cat.scan(spark, saved_explanation(spark, sf_dir), "explanation_report", **_STORED)
    rows = rows.select("method", "text_id", "label", "predicted", "predicted_prob", "infidelity")
    return _rounded(rows, ("predicted_prob", "infidelity"))


@query("snk_svm_explanation")
def snk_svm_explanation(spark, sf_dir):
    """LIME and SHAP of the SVM with its class report and infidelities, written and read back by method."""
    s = setting(spark, sf_dir)
    model, predictions = svm_predictions(s)
    root = scratch_path(spark, "artifacts")
    found = {
        "LIME": surrogates.lime(s.values, s.train, predictions, model),
        "SHAP": surrogates.permutation_shap(s.values, predictions, model),
    }
    for name, phi in found.items():
        phi, method = stored(phi, "phi"), F.lit(name).alias("method")
        cat.save_explanation(
            explain.class_attribution(phi, predictions, model).select(method, "class", "token", "score"),
            stats.class_report(predictions, model.classes).select(method, "class", "precision", "recall", "f1", "accuracy"),
            explained_rows(s, model, predictions, phi).select(method, "*"),
            root, "documents", "hashed", 0,
        )
    return cat.scan(spark, root, "explanation", dataset="documents", model="hashed", layer=0).select("method", "class", "token", "score")
