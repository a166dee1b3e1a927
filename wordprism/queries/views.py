"""What the linked views show."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordprism.operators import views
from wordprism.queries.base import plane, spans, texts, word_occurrences, zipf_sql
from wordprism.queries.select import POLYGON, chosen, links, share
from wordprism.operators import select
from wordprism.registry import cte, query

cte(
    "refrequency",
    "select token, count(*) as frequency from ctok where text_id in (select text_id from inside) group by token",
)


@query("q_word_refilter", zipf_sql("refrequency"))
def q_word_refilter(spark, sf_dir):
    selected = select.lasso(plane(spark, sf_dir), POLYGON)
    return views.refilter_words(spans(spark, sf_dir), selected)


cte(
    "selected_links",
    """
  select "class", token, score as value from share
  where score > 0 and "class" in (select "class" from share group by 1 having min(score) <> max(score))
    and ("class", token) in (select (label, token) from ctok where text_id in (select text_id from inside))
    and "class" in (select label from texts where text_id in (select text_id from inside))
  qualify row_number() over (partition by "class" order by score desc, token) <= 5""",
)


@query("q_sankey_share", "select \"class\", token, round(value, 6) as value from selected_links")
def q_sankey_share(spark, sf_dir):
    """Links of the selected texts, by how much a token prefers a class."""
    scores, rows = share(spark, sf_dir)
    ids = select.lasso(plane(spark, sf_dir), POLYGON)
    selected = select.selected_labels(texts(spark, sf_dir), ids)
    return views.sankey_links(scores, rows, selected).withColumn("value", F.round("value", 6))


@query(
    "q_token_table",
    """
    select t.token, entries, word, tag_desc, entity from (
      select distinct token, coalesce(tag_word, '') as word, coalesce(tag_desc, '') as tag_desc, coalesce(entity, '') as entity
      from occurrence) t
    join (select token, count(*) as entries from occurrence group by 1) using (token)""",
)
def q_token_table(spark, sf_dir):
    return views.token_table(word_occurrences(spark, sf_dir), "n").drop("part")


@query(
    "q_span_dedup",
    """select distinct s.text_id, t.token, s."start", s."end" from selection s join ctok t
         on s.text_id = t.text_id and s."start" = t."start" where s.view in ('word', 'explanation')""",
)
def q_span_dedup(spark, sf_dir):
    found, occurrence = links(spark, sf_dir)
    _, rows = chosen(spark, sf_dir, (found, occurrence))
    held = rows.where(F.col("view").isin("word", "explanation")).drop("end", "view")
    return views.distinct_spans(held.join(occurrence, ["text_id", "start"]))


@query(
    "q_text_list",
    """
    with s as (select distinct text_id, "start", "end" from selection
               where view in ('word', 'explanation') and text_id in (select text_id from chosen)),
    l as (select *, lag("end", 1, 0) over (partition by text_id order by "start") as previous from s),
    m as (select text_id, string_agg(substr(text, previous + 1, "start" - previous) || '<mark>'
                 || substr(text, "start" + 1, "end" - "start") || '</mark>', '' order by "start") as head, max("end") as last
          from l join texts using (text_id) group by text_id)
    select text_id, ord, label, case when head is null then text else head || substr(text, last + 1) end as html
    from texts left join m using (text_id) where text_id in (select text_id from chosen)""",
)
def q_text_list(spark, sf_dir):
    ids, rows = chosen(spark, sf_dir)
    return views.text_list(texts(spark, sf_dir), ids, select.positions(rows, ids)).select("text_id", "ord", "label", "html")
