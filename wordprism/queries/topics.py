"""Bags of words, TF-IDF and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordprism.operators import tokens as tk
from wordprism.operators import topics
from wordprism.plans.tables import stored
from wordprism.queries.base import texts
from wordprism.registry import cte, query
from wordprism.sources.stopwords import stop_words

cte(
    "terms",
    """
  select term, row_number() over (order by term) - 1 as idx, df from (
    select word as term, count(*) as total, count(distinct text_id) as df from prepared where length(word) >= 2 group by 1
    having count(distinct text_id) between 0.05 * (select count(*) from texts) and 0.95 * (select count(*) from texts)
    order by total desc, term limit 1000)""",
)
cte("counted", "select text_id, term, idx, count(*) as n from prepared join terms on word = term group by 1, 2, 3")
cte(
    "tfidf",
    """
  select text_id, term, idx, w / sqrt(sum(w * w) over (partition by text_id)) as weight from (
    select text_id, counted.term, counted.idx, n * (ln((1 + (select count(*) from texts))::double / (1 + df)) + 1) as w
    from counted join terms using (term))""",
)


def prepared(spark, sf_dir):
    """Texts, chosen terms and counts."""
    rows = texts(spark, sf_dir)
    words = stored(tk.prepared_words(rows, stop_words(spark)), "words")
    terms = stored(topics.count_terms(words, rows), "terms")
    return rows, terms, topics.count_matrix(words, terms)


def weighted(spark, sf_dir):
    rows, terms, counts = prepared(spark, sf_dir)
    return rows, terms, topics.tfidf_matrix(counts, terms, rows)


@query("ml_count_vec", "select text_id, term, idx, n from counted")
def ml_count_vec(spark, sf_dir):
    return prepared(spark, sf_dir)[2]


@query("ml_tfidf", "select text_id, term, idx, round(weight, 6) as weight from tfidf")
def ml_tfidf(spark, sf_dir):
    return weighted(spark, sf_dir)[2].withColumn("weight", F.round("weight", 6))


@query("ml_lda")
def ml_lda(spark, sf_dir):
    rows, terms, counts = prepared(spark, sf_dir)
    vectors = topics.term_vectors(counts, rows, terms.count(), "n")
    components, mixed = topics.fit_lda(vectors, terms)
    return topics.assign_topics(mixed, topics.topic_words(components), texts(spark, sf_dir))


@query("ml_nmf")
def ml_nmf(spark, sf_dir):
    _, terms, matrix = weighted(spark, sf_dir)
    components, mixed, _ = topics.fit_nmf(matrix, terms)
    return topics.assign_topics(mixed, topics.topic_words(components), texts(spark, sf_dir))


def svd_sql(steps: int = 300) -> str:
    """Main axes of the moments of the TF-IDF cells by power iteration, one after the other; names and texts as in ``assign_topics``."""
    diagonal = "list_transform(range(1, len(m) + 1), lambda i: m[i][i])"
    parts = [
        "moment as materialized (select a.idx as i, b.idx as j, sum(a.weight * b.weight) as c from tfidf a join tfidf b using (text_id) group by 1, 2)",
        "moment_row as (select x.idx as i, list(coalesce(c, 0) order by y.idx) as r from terms x cross join terms y left join moment on i = x.idx and j = y.idx group by x.idx)",
        "m0 as materialized (select list(r order by i) as m from moment_row)",
    ]
    for t in range(topics.TOPICS):
        parts += [
            f"""p{t} as (
    select 0 as k, m[list_position(d, list_max(d))] as v from (select m, {diagonal} as d from m{t}) union all
    select k + 1, list_transform(y, lambda z: z / sqrt(list_inner_product(y, y)))
    from (select k, list_transform(m, lambda r: list_inner_product(r, v)) as y from p{t}, m{t} where k < {steps}))""",
            f"""u{t} as materialized (
    select list_transform(v, lambda z: z * sign(v[list_position(a, list_max(a))])) as u from (select v, list_transform(v, lambda z: abs(z)) as a from p{t} where k = {steps}))""",
            f"""m{t + 1} as materialized (
    select list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * u[i] * u[j])) as m
    from (select m, u, list_inner_product(list_transform(m, lambda r: list_inner_product(r, u)), u) as l from m{t}, u{t}))""",
        ]
    axes = " union all ".join(f"select {t} as topic, unnest(u) as w, unnest(range(len(u))) as idx from u{t}" for t in range(topics.TOPICS))
    parts += [
        f"axis as materialized ({axes})",
        f"""axis_name as (
    select topic, string_agg(term, '-' order by rn) as name
    from (select topic, term, row_number() over (partition by topic order by round(w, 9) desc, term) as rn from axis join terms using (idx)) where rn <= {topics.WORDS_PER_TOPIC} group by topic)""",
        """axis_best as (
    select text_id, topic from (select text_id, topic, sum(weight * w) as s from tfidf join axis using (idx) group by 1, 2)
    qualify row_number() over (partition by text_id order by round(s, 9) desc, topic) = 1)""",
    ]
    chosen = "select text_id, name as topic from (select text_id, coalesce(axis_best.topic, 0) as topic from texts left join axis_best using (text_id)) join axis_name using (topic)"
    return "recursive with " + ",\n".join(parts) + "\n" + chosen


@query("ml_svd", svd_sql())
def ml_svd(spark, sf_dir):
    rows, terms, matrix = weighted(spark, sf_dir)
    components, scores = topics.fit_svd(matrix, rows, terms)
    return topics.assign_topics(scores.withColumn("weight", F.round("weight", 9)), topics.topic_words(components), rows)


# Languages stand in for fitted topics: their weights are sums of TF-IDF cells.
cte(
    "lang_topic",
    """
  select dense_rank() over (order by label)::int - 1 as topic, term, sum(weight) as weight
  from tfidf join texts using (text_id) group by label, term""",
)
cte(
    "topic_name",
    """
  select topic, string_agg(term, '-' order by rn) as name from (
    select topic, term, row_number() over (partition by topic order by round(weight, 9) desc, term) as rn from lang_topic)
  where rn <= 3 group by topic""",
)


def language_topics(spark, sf_dir):
    from wordprism.operators.classify import encode_labels

    rows, _, matrix = weighted(spark, sf_dir)
    matrix = stored(matrix, "tfidf")
    codes = encode_labels(rows).select("label", F.col("code").cast("int").alias("topic"))
    coded = rows.select("text_id", "label").join(codes, "label")
    weights = matrix.join(coded, "text_id").groupBy("topic", "term").agg(F.round(F.sum("weight"), 9).alias("weight"))
    return stored(weights, "topics"), matrix


@query("ml_topic_words", "select topic, name from topic_name")
def ml_topic_words(spark, sf_dir):
    return topics.topic_words(language_topics(spark, sf_dir)[0])


@query(
    "ml_topic_assign",
    """
    select text_id, name as topic from (
      select text_id, coalesce(b.topic, 0) as topic from texts left join (
      select text_id, t.topic from tfidf f join lang_topic t using (term) group by text_id, t.topic
      qualify row_number() over (partition by text_id order by round(sum(f.weight * round(t.weight, 9)), 9) desc, t.topic) = 1)
      b using (text_id))
    join topic_name using (topic)""",
)
def ml_topic_assign(spark, sf_dir):
    components, matrix = language_topics(spark, sf_dir)
    mixed = matrix.join(components.withColumnRenamed("weight", "_c"), "term").groupBy("text_id", "topic").agg(
        F.round(F.sum(F.col("weight") * F.col("_c")), 9).alias("weight")
    )
    return topics.assign_topics(mixed, topics.topic_words(components), texts(spark, sf_dir))
