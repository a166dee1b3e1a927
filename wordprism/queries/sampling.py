"""Quotas, stratified samples, train/test split."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordprism.operators import sample
from wordprism.queries.base import table, texts
from wordprism.registry import cte, query

# Half of the texts, which is more than an even share of the small classes.
cte(
    "class_sizes",
    "select list(label order by label) as names, list(n order by label) as sizes, (sum(n) // 2)::bigint as n "
    "from (select label, count(*)::bigint as n from texts group by label)",
)
_QUOTAS = """recursive
  with q(step, quota) as (
    select 0, list_transform(range(1, len(sizes) + 1), lambda i:
      ceil(n / len(sizes))::bigint + case when i = len(sizes) then n - ceil(n / len(sizes))::bigint * len(sizes) else 0 end)
    from class_sizes
    union all
    select step + 1, list_transform(range(1, len(sizes) + 1), lambda i:
        capped[i] + case when opened[i] then missing // n_open else 0 end
        + case when i = last then missing - (missing // n_open) * n_open else 0 end)
    from (
      select *, n - list_sum(capped) as missing, len(list_filter(opened, lambda o: o)) as n_open,
             list_max(list_filter(range(1, len(sizes) + 1), lambda i: opened[i])) as last
      from (
        select step, sizes, n, quota,
               list_transform(range(1, len(sizes) + 1), lambda i: least(quota[i], sizes[i])) as capped,
               list_transform(range(1, len(sizes) + 1), lambda i: sizes[i] > least(quota[i], sizes[i])) as opened
        from q, class_sizes
        where len(list_filter(range(1, len(sizes) + 1), lambda i: quota[i] > sizes[i])) > 0))
  ),
  quotas as (
    select unnest(names) as label, unnest(quota)::bigint as n
    from class_sizes, (select quota from q order by step desc limit 1))
"""


def _half(rows):
    return rows.count() // 2


@query("smp_quota", _QUOTAS + " select label, n from quotas")
def smp_quota(spark, sf_dir):
    rows = texts(spark, sf_dir)
    return sample.quotas(rows, _half(rows))


@query(
    "smp_stratified",
    _QUOTAS + """
  select text_id, ord, label from (
    select text_id, ord, label, row_number() over (partition by label order by md5('1537:' || text_id), text_id) as rn from texts)
  join quotas using (label) where rn <= n""",
)
def smp_stratified(spark, sf_dir):
    rows = texts(spark, sf_dir).select("text_id", "ord", "label")
    return sample.stratified(rows, _half(rows))


def split_sql(source: str, per_class: int = 5) -> str:
    return f"""
  select text_id, label, ord, case
      when size > {per_class} then case when rn <= {per_class} then 'test' else 'train' end
      when size > 1 and ord = first then 'test' else 'train' end as part
  from (select text_id, label, ord, count(*) over (partition by label) as size, min(ord) over (partition by label) as first,
          row_number() over (partition by label order by md5('1537:' || text_id), text_id) as rn from {source})"""


cte("split", split_sql("texts"))
# small classes as well: one class per size of a part
cte("parts", "select 'p_' || p_partkey as text_id, p_partkey as ord, p_brand || p_type || p_size as label from part")


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p_"), F.col("p_partkey").cast("string")).alias("text_id"),
        F.col("p_partkey").alias("ord"),
        F.concat("p_brand", "p_type", F.col("p_size").cast("string")).alias("label"),
    )


@query("smp_train_test", split_sql("parts"))
def smp_train_test(spark, sf_dir):
    return sample.train_test(_parts(spark, sf_dir))


@query(
    "smp_split_report",
    """select coalesce(label, 'total') as "class", count(*) filter (part = 'train') as train,
              count(*) filter (part = 'test') as test, count(*) as total
       from split group by rollup (label)""",
)
def smp_split_report(spark, sf_dir):
    rows = texts(spark, sf_dir).select("text_id", "ord", "label")
    return sample.split_report(sample.train_test(rows))
