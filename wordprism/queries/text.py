"""Sources, predicates and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordprism.functions import text as tx
from wordprism.operators import catalog as cat
from wordprism.operators import tokens as tk
from wordprism.queries.base import quoted, spans, table, texts
from wordprism.registry import cte, query
from wordprism.session import scratch_path
from wordprism.sources import stopwords

_STRIP = r"regexp_replace(regexp_replace({0}, '^[ \t\n\v\f\r]+', ''), '[ \t\n\v\f\r]+$', '')"


def stripped_sql(x: str) -> str:
    return _STRIP.format(x)


@query("src_corpus", "select * from texts")
def src_corpus(spark, sf_dir):
    return texts(spark, sf_dir)


@query(
    "src_stop_words",
    """select word, count(token) as n from stop
       left join (select token from tok) on lower(regexp_replace(token, '[^\\p{L}\\p{N}_\\s]', '', 'g')) = word
       group by word""",
)
def src_stop_words(spark, sf_dir):
    """The list, with how often the corpus uses each word."""
    used = tk.tokens(texts(spark, sf_dir)).groupBy(tx.stop_key("token").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    words = stopwords.stop_words(spark)
    return words.join(used, "word", "left").select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("snk_text", "select * from texts")
def snk_text(spark, sf_dir):
    root = scratch_path(spark, "artifacts")
    cat.save_texts(texts(spark, sf_dir), root, "documents")
    return cat.scan(spark, root, "text", dataset="documents").drop("dataset")


@query("prj_title_text", f"select p_partkey, {stripped_sql('p_name')} || ' ' || {stripped_sql('p_type')} as text from part")
def prj_title_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.title_and_text("p_name", "p_type").alias("text"))


_FLAGS = (
    "cast(l_quantity > 45 as int)", "cast(l_discount > 0.08 as int)", "cast(l_tax > 0.06 as int)",
    "cast(l_returnflag = 'R' as int)", "cast(l_linestatus = 'F' as int)", "cast(l_linenumber > 5 as int)",
)
_CLASSES = ("compsci", "physics", "math", "statistics", "biology", "finance")


@query(
    "prj_onehot_label",
    f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               ([{quoted(_CLASSES)}])[list_position(f, list_max(f))] as label
        from (select *, [{', '.join(_FLAGS)}] as f from lineitem)""",
)
def prj_onehot_label(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    label = tx.label_from_flags([F.expr(f) for f in _FLAGS], _CLASSES)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", label.alias("label"))


@query(
    "prj_rating_label",
    """select event_id, case when score < 3 then 'bad' when score >= 3 then 'good' end as label
       from (select event_id, case when event_type <> 'error' then value end as score from events)""",
)
def prj_rating_label(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    return rows.select("event_id", tx.label_from_rating("score").alias("label"))


@query("prj_text_id", "select 'src_' || source || '_' || doc_id as text_id from documents")
def prj_text_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(tx.prefixed_id("src_", "source", F.lit("_"), "doc_id").alias("text_id"))


@query(
    "prj_label_coalesce",
    """select d.doc_id, coalesce(case l.quality when 1 then 'kept' when 0 then 'left' end, d.lang) as label
       from documents d left join labels l using (doc_id)""",
)
def prj_label_coalesce(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "kept").when(F.col("quality") == 0, "left").alias("label"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("topic")).join(marks, "doc_id", "left")
    return rows.select("doc_id", tx.effective_label().alias("label"))


@query("flt_text_length", "select doc_id, length(text) as size from documents where length(text) between 1 and 5000")
def flt_text_length(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(tx.length_within("text", 5000))
    return rows.select("doc_id", F.length("text").cast("long").alias("size"))


_JOINED = r"regexp_replace(text, '\n+', ' ', 'g')"


@query("fn_squash_newlines", f"select doc_id, {stripped_sql(_JOINED)} as text from documents")
def fn_squash_newlines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.squash_newlines("text").alias("text"))


@query(
    "fn_quote_format",
    "select doc_id, replace(replace(text, ', ', ' '''''), '''''', '\"') as text from documents",
)
def fn_quote_format(spark, sf_dir):
    """Commas of the corpus stand in for doubled apostrophes."""
    doubled = F.replace(F.col("text"), F.lit(", "), F.lit(" ''"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.format_quotes(doubled).alias("text"))


_MAP = {"the": "THE", "of": "", "de": "von $1", "THE": "Th3", "la": "l\\a"}


def _map_sql(expression: str) -> str:
    # a separator is shared by neighbouring words, so each replacement runs twice
    for key, value in _MAP.items():
        literal = value.replace("\\", "\\\\")
        once = f"regexp_replace({{0}}, '(^|[^\\p{{{{L}}}}\\p{{{{N}}}}_]){key}($|[^\\p{{{{L}}}}\\p{{{{N}}}}_])', '\\1{literal}\\2', 'g')"
        expression = once.format(once.format(expression))
    return expression


@query("fn_map_text", f"select doc_id, {_map_sql('text')} as text from documents")
def fn_map_text(spark, sf_dir):
    return texts(spark, sf_dir).select(F.col("ord").alias("doc_id"), tx.map_text("text", _MAP).alias("text"))


def _predicate(name: str, function, condition: str) -> None:
    """A test of every distinct token, of itself and with forms the corpus lacks."""
    sql = f"""
      select form, {condition} as hit
      from (select distinct token || suffix as form from tok, (select unnest(['', 's', 'th', '3d5', ',000']) as suffix))"""

    def run(spark, sf_dir):
        forms = F.explode(F.array(*[F.lit(s) for s in ("", "s", "th", "3d5", ",000")]))
        rows = tk.tokens(texts(spark, sf_dir)).select("token").distinct().select("token", forms.alias("suffix"))
        return rows.select(F.concat("token", "suffix").alias("form")).distinct().select("form", function("form").alias("hit"))

    query(name, sql)(run)


_predicate("fn_is_number", tx.is_number, f"regexp_matches(form, '^\\p{{N}}+$') or regexp_matches(form, '{tx.NUMBER}')")
_predicate("fn_is_ordinal", tx.is_ordinal, f"regexp_matches(lower(form), '{tx.ORDINAL}')")
_predicate("fn_is_decade", tx.is_decade, f"regexp_matches(lower(form), '{tx.DECADE}')")
_predicate("fn_has_letter", tx.has_letter, f"regexp_matches(form, '{tx.LETTER}')")


@query("flt_stop_words", "select token from content")
def flt_stop_words(spark, sf_dir):
    return tk.content_tokens(tk.tokens(texts(spark, sf_dir)), stopwords.stop_words(spark))


cte(
    "prepared",
    f"""
  select distinct text_id, word from (
    select text_id, translate(lower(unnest(regexp_extract_all(
        regexp_replace(text, '{tx.EMAIL}', '', 'g'), '{tk.HYPHENATED}'))),
      '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '') as word
    from texts)
  where regexp_matches(word, '^\\p{{L}}+$') and word not in (select word from stop)""",
)


@query(
    "fn_preprocess",
    """
    select text_id, coalesce(string_agg(word, ' ' order by word), '') as processed_text
    from texts left join prepared using (text_id) group by text_id""",
)
def fn_preprocess(spark, sf_dir):
    rows = texts(spark, sf_dir)
    return tk.prepared_texts(tk.prepared_words(rows, stopwords.stop_words(spark)), rows)


@query(
    "fn_normalize_text",
    f"select doc_id, translate(lower(translate(text, 'İ', 'I')), '{tx.ACCENTED}', '{tx.PLAIN}') as text from documents",
)
def fn_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text("text").alias("text"))


@query(
    "fn_clean_token",
    """select replace(case when pos > 0 then '##' || token else token end, '##', '') as token, count(*) as n
       from tok group by 1""",
)
def fn_clean_token(spark, sf_dir):
    marked = F.when(F.col("pos") > 0, F.concat(F.lit("##"), "token")).otherwise(F.col("token"))
    rows = tk.tokens(texts(spark, sf_dir)).select(tx.clean_token(marked).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_special_tokens",
    f"""select text_id, count(*) as n from (
          select text_id, case when token in ('.', '|') then '[SEP]' else token end as token from tok)
        where token not in ({quoted(tx.SPECIAL_TOKENS)}) group by text_id""",
)
def flt_special_tokens(spark, sf_dir):
    """Sentence marks of the corpus stand in for the marks a model adds."""
    marked = F.when(F.col("token").isin(".", "|"), "[SEP]").otherwise(F.col("token"))
    rows = tk.without_special(tk.tokens(texts(spark, sf_dir)).withColumn("token", marked))
    return rows.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))


_AT = "strpos(lower(tag_word), lower(token))"


@query(
    "fn_word_part",
    f"""select distinct token, tag_word as word,
          case when {_AT} > 0 then substr(tag_word, 1, {_AT} - 1) else '' end as before,
          case when {_AT} > 0 then substr(tag_word, {_AT}, length(token)) else '' end as part,
          case when {_AT} > 0 then substr(tag_word, {_AT} + length(token)) else tag_word end as after
        from occurrence where tag_word is not null""",
)
def fn_word_part(spark, sf_dir):
    from wordprism.queries.base import occurrences

    pairs = occurrences(spark, sf_dir).where(F.col("tag_word").isNotNull()).select("token", F.col("tag_word").alias("word")).distinct()
    return pairs.select("token", "word", tx.word_part("token", "word").alias("p")).select("token", "word", "p.*")


@query(
    "fn_highlight",
    """
    with s as (select text_id, "start", "end",
                 lag("end", 1, 0) over (partition by text_id order by "start") as previous
               from ctok where token = upper(token[1]) || token[2:]),
    m as (select text_id, string_agg(substr(text, previous + 1, "start" - previous) || '<mark>'
                 || substr(text, "start" + 1, "end" - "start") || '</mark>', '' order by "start") as head, max("end") as last
          from s join texts using (text_id) group by text_id)
    select text_id, case when head is null then text else head || substr(text, last + 1) end as html
    from texts left join m using (text_id)""",
)
def fn_highlight(spark, sf_dir):
    from wordprism.operators.views import highlighted

    first = F.concat(F.upper(F.substring("token", 1, 1)), F.substring(F.col("token"), F.lit(2), F.length("token")))
    marked = spans(spark, sf_dir).where(F.col("token") == first)
    return highlighted(texts(spark, sf_dir), marked)
