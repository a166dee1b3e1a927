"""Inputs shared by the queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordprism.functions import text as tx
from wordprism.operators import annotate, embed, stats
from wordprism.operators import tokens as tk
from wordprism.plans.sieve import Sieve
from wordprism.plans.spread import spread
from wordprism.registry import cte
from wordprism.sources.corpus import documents
from wordprism.sources.stopwords import default_words, stop_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    return spread(documents(spark, f"{sf_dir}/documents.parquet", label))


def content_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency of content tokens; the filters run once per distinct token."""
    counted = stats.token_frequency(tk.tokens(texts(spark, sf_dir)))
    return tk.without_stop_words(counted, stop_words(spark))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as text vectors: ``text_id, label, vec``."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        tx.prefixed_id("doc_", "vec_id").alias("text_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two dimensions as a projection: ``text_id, label, x, y``."""
    rows = points(spark, sf_dir)
    return rows.select("text_id", "label", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


def tagged(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = annotate.numbered_words(texts(spark, sf_dir), keep)
    with_tags = annotate.pos_tags(rows, annotate.lexicon(spark), annotate.tag_names(spark))
    return annotate.named_entities(with_tags)


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long inverted index over content tokens."""
    return annotate.occurrences(tagged(spark, sf_dir, ("label",)), stop_words(spark))


def word_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index by distinct word: what is annotated depends on the word alone, and ``n`` tells how often it occurs."""
    rows = annotate.counted_words(texts(spark, sf_dir))
    with_tags = annotate.pos_tags(rows, annotate.lexicon(spark), annotate.tag_names(spark))
    return annotate.occurrences(annotate.named_entities(with_tags), stop_words(spark))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content tokens with label and span, where words are not needed."""
    rows = tk.token_spans(texts(spark, sf_dir), keep=("label",))
    return tk.without_stop_words(rows, stop_words(spark))


def token_weights(spark: SparkSession, sf_dir: str, how: str = "norm", kept: DataFrame | None = None) -> DataFrame:
    """Weights of the content tokens, or of the ``kept`` ones, which are content tokens already: only those are averaged.

    ``kept`` is read several times, so it should be stored.
    """
    sieve = None if kept is None else Sieve(kept, "token")

    def weights(rows: DataFrame, single: bool) -> DataFrame:
        measured = embed.encode_hashed(rows, spans=False, measure=how)
        if sieve is None:
            content = tk.without_stop_words(measured, stop_words(spark))
        else:
            content = sieve.sifted(measured).join(kept, "token", "left_semi")
        return embed.token_weights(content, how, embed.DIMENSIONS, single)

    once, more = tk.single_rows(texts(spark, sf_dir))
    return weights(more, False).unionByName(weights(once, True))


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


W, NW = tx.WORD, tx.NOT_WORD_OR_SPACE

cte(
    "texts",
    "select 'doc_' || doc_id as text_id, doc_id as ord, text, cast(null as varchar) as processed_text, "
    "lang as label, cast(null as varchar) as topic from documents",
)
cte("stop", f"select unnest([{quoted(default_words())}]) as word")


def _spans_sql(pattern: str) -> str:
    return f"""
  select text_id, label, pos, token, (e - length(token))::int as "start", e::int as "end" from (
    select text_id, label, pos, regexp_replace(piece, '^\\s+', '') as token,
           sum(length(piece)) over (partition by text_id order by pos) as e
    from (
      select text_id, label, unnest(ps) as piece, unnest(range(len(ps)))::int as pos
      from (select text_id, label, regexp_extract_all(text, '\\s*{pattern}') as ps from texts)))"""


cte("tok", _spans_sql(tk.TOKEN))
cte("word_spans", _spans_sql(tk.HYPHENATED))
cte(
    "content",
    f"""
  select token from (select distinct token from tok)
  where regexp_matches(token, '{tx.LETTER}')
    and not (regexp_matches(token, '^\\p{{N}}+$') or regexp_matches(token, '{tx.NUMBER}'))
    and not regexp_matches(lower(token), '{tx.ORDINAL}') and not regexp_matches(lower(token), '{tx.DECADE}')
    and lower(regexp_replace(token, '{NW}', '', 'g')) not in (select word from stop)""",
)
cte("ctok", "select tok.* from tok where token in (select token from content)")
cte("freq", "select token, count(*) as frequency from ctok group by token")

_LEX = ", ".join(f"('{w}', '{tag}')" for tag, words in annotate.LEXICON.items() for w in words.split())
_NAMES = ", ".join(f"('{tag}', '{name}')" for tag, name in annotate.TAG_NAMES.items())
_RULES = " ".join(f"when regexp_matches(word, '{p}') then '{tag}'" for tag, p in annotate.TAG_RULES)
cte(
    "tags",
    f"""
  select text_id, tag_idx, word, "start", "end", tag,
         case when name is null then tag else name || ' (' || tag || ')' end as tag_desc,
         case when tag = 'NNP' then 'NAME' end as entity
  from (select w.text_id, w.pos as tag_idx, w.token as word, w."start", w."end",
               coalesce(l.tag, case {_RULES.replace('word', 'w.token')} else '{annotate.OTHER_TAG}' end) as tag
        from word_spans w left join (values {_LEX}) l(word, tag) on lower(w.token) = l.word)
  left join (values {_NAMES}) n(tag, name) using (tag)""",
)
cte(
    "occurrence",
    """
  select t.text_id, t.label, t.pos, t.token, t."start", t."end", g.tag_idx, g.word as tag_word, g.tag_desc,
         g.entity, g."start" as tag_start, g."end" as tag_end
  from ctok t left join tags g
    on t.text_id = g.text_id and g."start" <= t."end" and t."end" <= g."end"
  qualify row_number() over (partition by t.text_id, t.pos order by g.tag_idx) = 1""",
)
_HEX = ", ".join(f"((('0x' || substr(h, {1 + 4 * k}, 4))::int)::double / 65535 - 0.5)" for k in range(8))
cte("hashed", f"select token, [{_HEX}] as v from (select token, md5(token) as h from (select distinct token from tok))")
_CTX = ", ".join(
    f"(c.v[{k + 1}] + coalesce(b.v[{k + 1}], 0) + coalesce(a.v[{k + 1}], 0)) / n as v{k}" for k in range(8)
)
cte(
    "token_vec",
    f"""
  select text_id, label, pos, t.token, "start", "end", {_CTX}
  from (select *, 1 + (tb is not null)::int + (ta is not null)::int as n from (
          select *, lag(token) over w as tb, lead(token) over w as ta from tok
          window w as (partition by text_id order by pos))) t
  join hashed c on c.token = t.token left join hashed b on b.token = tb left join hashed a on a.token = ta""",
)
_SQ = " + ".join(f"v{k} * v{k}" for k in range(8))
cte(
    "weights",
    f"""
  select text_id, token, avg(sqrt({_SQ})) as weight from token_vec
  where token in (select token from content) group by text_id, token""",
)


def bounds_sql(source: str, lowest: int) -> str:
    """One row lo, hi, n, n_inner, low, high for a table with ``frequency``."""
    return f"""
  select lo, hi, n, n_inner, greatest(lo, 10 ^ (q1 - 0.1 * (q3 - q1))) as low,
         least(hi, 10 ^ (q3 + 1.5 * (q3 - q1))) as high
  from (
    select any_value(lo) as lo, any_value(hi) as hi, any_value(n) as n, count(distinct frequency) filter (i) as n_inner,
           quantile_cont(log10(frequency), 0.25) filter (i) as q1, quantile_cont(log10(frequency), 0.75) filter (i) as q3
    from (select frequency, lo, hi, n, frequency > lo and frequency < hi as i from {source},
            (select greatest(min(frequency), {lowest}) as lo, max(frequency) as hi, count(distinct frequency) as n from {source})))"""


def zipf_sql(source: str) -> str:
    return f"""
  select token, frequency from {source}, ({bounds_sql(source, 3)}) b
  where not (lo <> hi and n > 3 and n_inner > 3) or (frequency > low and frequency < high)
  order by frequency desc, token desc limit 70"""


cte(
    "kept",
    f"select token, frequency from freq, ({bounds_sql('freq', 3)}) b where n_inner > 0 and frequency > low and frequency < high",
)
