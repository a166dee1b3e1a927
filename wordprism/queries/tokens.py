"""Tokens, annotation, token vectors and frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordprism.operators import annotate, embed, stats
from wordprism.operators import catalog as cat
from wordprism.operators import tokens as tk

from wordprism.queries.base import content_frequency, occurrences, tagged, texts, token_weights, zipf_sql
from wordprism.registry import cte, query
from wordprism.session import scratch_path
from wordprism.sources.stopwords import stop_words


@query("tok_spans", 'select text_id, pos, token, "start", "end" from tok')
def tok_spans(spark, sf_dir):
    return tk.token_spans(texts(spark, sf_dir))


@query("tok_vocab", "select token, row_number() over (order by token) - 1 as idx from content")
def tok_vocab(spark, sf_dir):
    return tk.vocabulary(tk.tokens(texts(spark, sf_dir)), stop_words(spark))


@query(
    "tok_counts",
    "select count(distinct token) as n_tokens, (select count(*) from content) as n_kept from tok",
)
def tok_counts(spark, sf_dir):
    return tk.token_totals(tk.tokens(texts(spark, sf_dir)), stop_words(spark))


@query("ann_pos", 'select text_id, tag_idx, word, "start", "end", tag, tag_desc from tags')
def ann_pos(spark, sf_dir):
    return annotate.pos_tags(annotate.words(texts(spark, sf_dir)), annotate.lexicon(spark), annotate.tag_names(spark))


_GAZETTEER = """
  select lower(token) as name, 'COMMON' as entity from word_spans
  where regexp_matches(token, '^\\p{Lu}') group by 1 having count(*) >= 5"""


@query(
    "ann_entity",
    f"""
    with g as ({_GAZETTEER}),
    r as (select *, case when tag = 'NNP' then tag_idx - row_number() over (
                 partition by text_id, tag = 'NNP' order by tag_idx) end as run from tags),
    n as (select text_id, run, string_agg(lower(word), ' ' order by tag_idx) as name from r where run is not null group by 1, 2)
    select r.text_id, r.tag_idx, r.word, r."start", r."end", r.tag, r.tag_desc,
           case when r.run is not null then coalesce(g.entity, 'NAME') end as entity
    from r left join n on r.text_id = n.text_id and r.run = n.run left join g on n.name = g.name""",
)
def ann_entity(spark, sf_dir):
    """Runs of proper nouns; the gazetteer holds the common capitalised words."""
    rows, lookups = annotate.words(texts(spark, sf_dir)), (annotate.lexicon(spark), annotate.tag_names(spark))
    counted = stats.token_frequency(tk.tokens(texts(spark, sf_dir), annotate.HYPHENATED))  # spans are not needed to count
    names = (
        counted.where(F.col("token").rlike(r"^\p{Lu}")).groupBy(F.lower("token").alias("name"))
        .agg(F.sum("frequency").alias("n")).where("n >= 5").select("name", F.lit("COMMON").alias("entity"))
    )
    return annotate.named_entities(annotate.pos_tags(rows, *lookups), names, nouns=annotate.proper_nouns(rows, *lookups))


@query(
    "ann_lemma",
    """
    with w as materialized (select text_id, pos as tag_idx, lower(token) as word from word_spans),
    f as materialized (select word, count(*) as n from w group by word),
    p as materialized (select word, n, substr(word, 1, length(word) - 1) as stem from f where length(word) > 1 and ends_with(word, 's')),
    l as materialized (select p.word, p.stem as lemma from p join f on f.word = p.stem where f.n > p.n)
    select w.text_id, w.tag_idx, w.word, coalesce(l.lemma, w.word) as lemma from w left join l on l.word = w.word""",
)
def ann_lemma(spark, sf_dir):
    """Lemma table from the corpus: a form in -s belongs to its more frequent stem."""
    rows = annotate.words(texts(spark, sf_dir)).select("text_id", "tag_idx", F.lower("word").alias("word"))
    counted = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    stems = counted.select(F.col("word").alias("lemma"), F.concat("word", F.lit("s")).alias("word"), F.col("n").alias("m"))
    lemmas = counted.join(stems, "word").where("m > n").select("word", "lemma")
    return annotate.lemmatised(rows, lemmas)


@query(
    "ann_align",
    """
    select t.text_id, t.pos, t.token, t."start", t."end", g.tag_idx, g.word as tag_word, g.tag_desc, g.entity,
           g."start" as tag_start, g."end" as tag_end
    from tok t left join tags g on t.text_id = g.text_id and g."start" <= t."end" and t."end" <= g."end"
    qualify row_number() over (partition by t.text_id, t.pos order by g.tag_idx) = 1""",
)
def ann_align(spark, sf_dir):
    return annotate.word_tokens(tagged(spark, sf_dir))


_OCCURRENCE = 'text_id, label, pos, token, "start", "end", tag_idx, tag_word, tag_desc, entity, tag_start, tag_end'


@query("idx_inverted", f"select {_OCCURRENCE} from occurrence")
def idx_inverted(spark, sf_dir):
    return occurrences(spark, sf_dir)


@query("snk_token_info", f"select {_OCCURRENCE} from occurrence")
def snk_token_info(spark, sf_dir):
    root = scratch_path(spark, "artifacts")
    cat.save_token_info(occurrences(spark, sf_dir), root, "documents", "hashed")
    return cat.scan(spark, root, "token_info", dataset="documents", model="hashed").drop("dataset", "model")


def _rounded(count: int) -> str:
    return ", ".join(f"round(v{k}, 6) as v{k}" for k in range(count))


@query("emb_encode", f'select text_id, pos, token, "start", "end", {_rounded(8)} from token_vec')
def emb_encode(spark, sf_dir):
    rows = embed.encode_hashed(texts(spark, sf_dir))
    values = [F.round(F.col("vec")[k], 6).alias(f"v{k}") for k in range(embed.DIMENSIONS)]
    return rows.select("text_id", "pos", "token", "start", "end", *values)


@query(
    "emb_layer",
    f"""select layer, count(*) as n, round(sum(v0), 4) as v0 from (
          select unnest([11, 12]) as layer, v0 from token_vec) group by layer""",
)
def emb_layer(spark, sf_dir):
    """The last two of 13 layers, one of them named from the end."""
    rows = embed.encode_hashed(texts(spark, sf_dir), spans=False)
    layered = rows.withColumn("layer", F.explode(F.sequence(F.lit(10), F.lit(12))))
    chosen = embed.choose_layers(layered, [11, -1], 13)
    return chosen.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("vec")[0]), 4).alias("v0"))


cte(
    "pooled",
    "select text_id, any_value(label) as label, "
    + ", ".join(f"sum(v{k}) / count(*) as v{k}" for k in range(8))
    + " from token_vec group by text_id",
)


@query(
    "emb_mean_pool",
    "select text_id, " + ", ".join(f"round(coalesce(v{k}, 0), 6) + 0.0 as v{k}" for k in range(8))
    + " from texts left join pooled using (text_id)",
)
def emb_mean_pool(spark, sf_dir):
    rows = texts(spark, sf_dir)
    pooled = embed.mean_pool(embed.encode_hashed(rows, spans=False), embed.DIMENSIONS, rows)
    return pooled.select("text_id", *[(F.round(F.col("vec")[k], 6) + 0.0).alias(f"v{k}") for k in range(embed.DIMENSIONS)])


@query("emb_token_norm", "select text_id, token, round(weight, 6) as weight from weights")
def emb_token_norm(spark, sf_dir):
    return token_weights(spark, sf_dir).select("text_id", "token", F.round("weight", 6).alias("weight"))


_MEAN = " + ".join(f"v{k}" for k in range(8))


@query(
    "emb_token_mean",
    f"""select text_id, token, round(avg(({_MEAN}) / 8), 6) + 0.0 as weight from token_vec
        where token in (select token from content) group by text_id, token""",
)
def emb_token_mean(spark, sf_dir):
    return token_weights(spark, sf_dir, "mean").select("text_id", "token", (F.round("weight", 6) + 0.0).alias("weight"))


@query(
    "emb_text_token_matrix",
    """select text_id, idx, round(weight, 6) as weight
       from weights join (select token, row_number() over (order by token) - 1 as idx from content) using (token)""",
)
def emb_text_token_matrix(spark, sf_dir):
    vocab = tk.vocabulary(tk.tokens(texts(spark, sf_dir)), stop_words(spark))
    matrix = embed.text_token_matrix(token_weights(spark, sf_dir), vocab)
    return matrix.select("text_id", "idx", F.round("weight", 6).alias("weight"))


@query("snk_features", f'select text_id, 12 as layer, pos, token, "start", "end", {_rounded(8)} from token_vec')
def snk_features(spark, sf_dir):
    """Writes token vectors by layer and reads one layer back."""
    root = scratch_path(spark, "artifacts")
    cat.save_features(embed.encode_hashed(texts(spark, sf_dir), layer=12), root, "documents", "hashed")
    rows = cat.scan(spark, root, "features", dataset="documents", model="hashed", layer=12)
    values = [F.round(F.col("vec")[k], 6).alias(f"v{k}") for k in range(embed.DIMENSIONS)]
    return rows.select("text_id", "layer", "pos", "token", "start", "end", *values)


@query("agg_token_freq", "select token, frequency from freq")
def agg_token_freq(spark, sf_dir):
    return content_frequency(spark, sf_dir)


@query("agg_freq_hist", "select frequency, count(*) as n_tokens from freq group by frequency")
def agg_freq_hist(spark, sf_dir):
    return stats.frequency_histogram(content_frequency(spark, sf_dir))


@query("agg_iqr_filter", "select token, frequency from kept")
def agg_iqr_filter(spark, sf_dir):
    return stats.iqr_filter(content_frequency(spark, sf_dir), stats.LOWEST_FREQUENCY)


@query("agg_zipf_filter", zipf_sql("freq"))
def agg_zipf_filter(spark, sf_dir):
    return stats.zipf_filter(content_frequency(spark, sf_dir))
