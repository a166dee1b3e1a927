"""One registered query per operator of this package, over whole tables, and the pipeline's SQL-free entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordprism.llm import block_neighbours, decontaminate, importance_resample, minhash_dedup, ngram_join, phrase_mining, quality_gam, separator_scan, shard_tree, source_mix, substring_dedup, token_files, url_filter
from wordprism.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_separator_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.token_counts(table(spark, sf_dir, "documents"))


OP2_SQL = """
with v as (
  select vec_id, embedding::double[] as vec from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), d as (
  select q.vec_id as query_id, c.vec_id, min(sqrt(list_reduce(list_transform(range(1, len(q.vec) + 1), lambda i: (q.vec[i] - c.vec[i]) * (q.vec[i] - c.vec[i])), lambda a, b: a + b))) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.vec) = len(c.vec) where q.vec_id % 100 = 0 group by all
), r as (
  select query_id, row_number() over (partition by query_id order by score, vec_id)::int as rank, vec_id, score from d
)
select * from r where rank <= 10
"""


@query("op2_block_neighbours", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return block_neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


OP3_SQL = """
recursive with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), s as materialized (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [w]
    else list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) end) as s from w
), g as materialized (select s, len(s) as n, min(doc_id) as id from s where len(s) > 0 group by s),
e as materialized (select id, n, unnest(s) as x from g),
p as materialized (
  select a.id as a, b.id as b from e a join e b on a.x = b.x and a.id < b.id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.id, b.id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), linked as materialized (select a as u, b as v from p union select b, a from p),
r as (select id as u, id as c from g where id in (select u from linked) union select l.v, r.c from r join linked l on l.u = r.u where r.c < l.v),
m as (select u, min(c) as c from r group by u)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(least(m.c, g.id), g.id, s.doc_id) as component_id
from s left join g on g.s = s.s left join m on m.u = g.id
"""


@query("op3_ngram_join", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), 3, 90)


@query("op4_shard_tree")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.shard_documents(table(spark, sf_dir, "documents"), 8)


OP5_SQL = """
with d as (
  select doc_id, source, md5(coalesce(text, '')) as digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), t as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, row_number() over (order by source nulls last) - 1 as i from t),
w as (select *, [3.0, 1.0, 2.0][(i % 3) + 1]::double as weight, source_size * 2.0::double as room from n),
l as (
  select *, (sum(source_size) over () * 1.5::double
    - coalesce(sum(room) over (order by room / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by room / weight, source nulls last rows between current row and unbounded following) as level
  from w
), g as (
  select source, source_size, case when open is null then room else least(room, open * weight) end as target
  from (select *, max(case when level * weight <= room then level end) over () as open from l)
), j as (
  select d.doc_id, d.size, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0 end as rate,
    ('0x' || substr(md5('11:' || coalesce(d.doc_id::varchar, 'null') || ':' || d.digest), 1, 8))::bigint / 4294967296.0::double as draw
  from d join g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::int))::bigint as taken from j
"""


@query("op5_source_mix", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_mix.mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = """
with u as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
    row_number() over () as r
  from pages
), rules(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f as (
  select r, max_by(h || p, length(h || p)) as rule, max_by(verdict, length(h || p)) as verdict
  from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by r
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join f using (r)
"""


@query("op6_url_filter", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules(spark))


OP7_SQL = """
with t as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark
), w as materialized (
  select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w from t
), bw as materialized (
  select distinct id as item_id, least(len(w), 10) as k, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: w[i:i + 9])) as g
  from w where kind = 'b' and len(w) > 0
), ks as (select distinct k from bw),
dw as materialized (
  select id as doc_id, k, unnest(range(1, len(w) - k + 2)) as pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as g
  from w, ks where kind = 'd' and len(w) >= k
), h as materialized (select doc_id, pos, k, item_id from dw join bw using (k, g)),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + k)) as p from h) group by doc_id),
i as (
  select doc_id, count(*) as n_items, sha256(string_agg(s, ',' order by s)) as items_sha256 from (select distinct doc_id, item_id::varchar as s from h) group by doc_id
)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join c on c.doc_id = id left join i on i.doc_id = id where kind = 'd'
"""


@query("op7_decontaminate", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return rows.drop("items", "spans")


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(table(spark, sf_dir, "documents"))


@query("op9_quality_gam")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score_documents(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


OP10_SQL = """
with w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as materialized (
  select doc_id, unnest(range(1, len(w) - 11)) as pos, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as g from w where len(w) >= 13
), f as (select g, min(doc_id) as first from g group by g having min(doc_id) < max(doc_id)),
c as (
  select doc_id, list_sort(list_distinct(list(p))) as gone from (select doc_id, unnest(range(pos, pos + 13)) as p from g join f using (g) where doc_id > first) group by doc_id
), k as (
  select w.doc_id, len(w) as n, coalesce(gone, []) as gone, list_filter(list_transform(w, lambda x, i: case when list_contains(coalesce(gone, []), i) then null else x end), lambda x: x is not null) as kept
  from w left join c using (doc_id)
)
select doc_id, n::bigint as n_words, len(gone)::bigint as n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from k
"""


@query("op10_substring_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


OP11_SQL = """
with p as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents
), w as materialized (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k),
f as materialized (select lang, k, phrase, count(*)::bigint as f, string_split(phrase, ' ') as w from g group by lang, k, phrase having count(*) >= 30),
c as materialized (select lang, k, phrase, f as a, w from f where k > 1),
cut as (select lang, phrase, a, w, k, unnest(range(1, k)) as cut from c),
s as (
  select cut.lang, cut.phrase, a, cut, x.f as l, y.f as r, ((2000000::hugeint * a) // (x.f + y.f))::bigint as score
  from cut join f x on x.lang = cut.lang and x.phrase = array_to_string(cut.w[1:cut], ' ')
    join f y on y.lang = cut.lang and y.phrase = array_to_string(cut.w[cut + 1:], ' ')
), weakest as (select lang, phrase, a, l, r, score from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
covered_by as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as f
  from c, (select unnest([2, 3]) as m) ms, (select unnest([1, 2, 3]) as i) starts where m < k and i + m - 1 <= k group by 1, 2
), standing as (select weakest.* from weakest left join covered_by i on i.lang = weakest.lang and i.phrase = weakest.phrase where i.f is null or 100 * i.f < 80 * a),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from standing)
select o.lang, rank, phrase, a, l, r, n, score from o join n on n.lang = o.lang where rank <= 2000
"""


@query("op11_phrase_mining", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine_phrases(table(spark, sf_dir, "documents"))


OP12_SQL = """
recursive with t as (
  select 'd' as kind, doc_id, text from documents union all select 'b', null, text from benchmark
), w as materialized (
  select kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w,
    row_number() over () as r from t
), f as materialized (
  select kind, r, unnest(list_concat(w, case when len(w) < 2 then [] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as f from w
), entry as materialized (
  select i, list_reduce(list_concat([i], range(8)), lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)::bigint as v
  from (select unnest(range(256)) as i)
), words as materialized (select f, hex(encode(f)) as h from (select distinct f from f)),
step as (
  select f, h, 0 as j, 4294967295::bigint as c from words
  union all
  select f, h, j + 1, xor(c // 256, v) from step join entry on i = xor(c % 256, ('0x' || substr(h, 2 * j + 1, 2))::bigint) where 2 * j < length(h)
), code as materialized (select f, xor(c, 4294967295) % 10000 as bucket from step where 2 * j = length(h)),
n as materialized (
  select bucket, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from f join code using (f) group by bucket
), g as materialized (
  select bucket, floor(1000 * ln(((t + 1) * (sum(t_s) + 10000))::double / ((s + 1) * (sum(t_t) + 10000))::double))::bigint as gain
  from n, (select sum(s)::bigint as t_s, sum(t)::bigint as t_t from n) group by bucket, s, t
), d as (
  select r, count(*) as n_features, sum(gain) as total from f join code using (f) join g using (bucket) where kind = 'd' group by r
), sc as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(floor(total::double / n_features), 0)::bigint as weight,
    ('0x' || substr(sha256('7:' || doc_id::varchar), 1, 8))::bigint as h
  from w left join d using (r) where kind = 'd'
), o as (select doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from sc),
k as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as wide from o)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * wide // 100 then place end as rank from k
"""


@query("op12_importance_resample", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = OP3_SQL.replace("len(w) < 3", "len(w) < 5").replace("range(1, len(w) - 1), lambda i: w[i:i + 2]", "range(1, len(w) - 3), lambda i: w[i:i + 4]")
OP13_SQL = OP13_SQL.replace(">= 90 *", ">= 85 *").replace(
    "coalesce(least(m.c, g.id), g.id, s.doc_id) as component_id", "coalesce(least(m.c, g.id), g.id, s.doc_id) as component_id, s.doc_id = coalesce(least(m.c, g.id), g.id, s.doc_id) as kept"
)


@query("op13_minhash_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
