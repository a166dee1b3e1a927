"""Tokens with exact spans, the vocabulary and token filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordprism.functions import text as tx
from wordprism.plans.ranking import with_global_rank
from wordprism.plans.tables import stored

# A piece is one token with the white space before it. Laid end to end the pieces
# rebuild the text, so token offsets are running sums of piece lengths.
TOKEN = rf"({tx.WORD}+|{tx.NOT_WORD_OR_SPACE})"
HYPHENATED = rf"({tx.WORD}+(?:-{tx.WORD}+)*|{tx.NOT_WORD_OR_SPACE})"
_CHUNK = 64


def token_spans(
    texts: DataFrame,
    pattern: str = TOKEN,
    keep: tuple[str, ...] = (),
    neighbours: bool = False,
    counts: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Split texts into ``text_id, pos, token, start, end`` (end exclusive).

    Everything happens inside the row of a text: no shuffle and no sort. The
    running sums are taken in two levels (chunks of 64 pieces, then pieces), which
    keeps the work near linear for texts of any length. ``neighbours`` adds the
    tokens before and after (``before``, ``after``; null at the ends). ``counts`` names
    measures of a piece; each adds the sum of its measure over all pieces before.
    """
    pieces = F.regexp_extract_all("text", F.lit(r"\s*" + pattern), F.lit(0))
    split = texts.select("text_id", *keep, pieces.alias("_p")).where(F.size("_p") > 0)
    count = F.size("_p")
    number = F.sequence(F.lit(0), F.floor((count - 1) / _CHUNK).cast("int"))

    def chunked(array: Column) -> Column:
        return F.transform(number, lambda c: F.slice(array, c * _CHUNK + 1, F.lit(_CHUNK)))

    measures = {"offset": F.length, **(counts or {})}
    last = lambda acc: F.element_at(acc, -1)

    def before(items: str, begin: Column, measure: Callable[[Column], Column]) -> Column:
        """For each entry of an array: ``begin`` and the measures of the entries before it."""
        sums = F.aggregate(items, F.array(begin), lambda acc, x: F.array_append(acc, last(acc) + measure(x)))
        return F.slice(sums, F.lit(1), F.size(items))

    def total(measure: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda chunk: F.aggregate(chunk, F.lit(0), lambda acc, p: acc + measure(p))

    columns = {"piece": chunked(F.col("_p"))}
    if neighbours:
        columns["before"] = chunked(F.concat(F.array(F.lit(None).cast("string")), F.slice("_p", 1, count - 1)))
        columns["after"] = chunked(F.concat(F.slice("_p", F.lit(2), count), F.array(F.lit(None).cast("string"))))
    chunks = split.select("text_id", *keep, *[c.alias(name) for name, c in columns.items()])
    chunks = chunks.select("*", *[before("piece", F.lit(0), total(m)).alias(name) for name, m in measures.items()])
    names = [*columns, *measures]
    rows = chunks.select("text_id", *keep, F.posexplode(F.arrays_zip(*names)).alias("_chunk", "_z"))
    rows = rows.select("text_id", *keep, "_chunk", *[F.col(f"_z.{n}").alias(n) for n in names])
    rows = rows.withColumns({name: before("piece", F.col(name), m) for name, m in measures.items()})
    rows = rows.select("text_id", *keep, "_chunk", F.posexplode(F.arrays_zip(*names)).alias("_i", "_z"))
    token = lambda n: F.ltrim(F.col(f"_z.{n}"), F.lit(tx.BLANKS))
    end = F.col("_z.offset") + F.length("_z.piece")
    return rows.select(
        "text_id",
        *keep,
        (F.col("_chunk") * _CHUNK + F.col("_i")).alias("pos"),
        token("piece").alias("token"),
        (end - F.length(token("piece"))).alias("start"),
        end.alias("end"),
        *([token("before").alias("before"), token("after").alias("after")] if neighbours else []),
        *[F.col(f"_z.{name}").alias(name) for name in counts or {}],
    )


def tokens(texts: DataFrame, pattern: str = TOKEN, keep: tuple[str, ...] = ()) -> DataFrame:
    """``text_id, pos, token`` only: for counting, where spans are not needed."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return texts.select("text_id", *keep, F.posexplode(found).alias("pos", "token"))


def tokens_in_context(texts: DataFrame, pattern: str = TOKEN, keep: tuple[str, ...] = ()) -> DataFrame:
    """``text_id, pos, token, before, after`` without spans, within the row of a text."""
    found = texts.select("text_id", *keep, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("token"))
    nothing = F.array(F.lit(None).cast("string"))
    shifted = found.where(F.size("token") > 0).select(
        "text_id", *keep, "token",
        F.concat(nothing, F.slice("token", F.lit(1), F.size("token") - 1)).alias("before"),
        F.concat(F.slice("token", F.lit(2), F.size("token")), nothing).alias("after"),
    )
    rows = shifted.select("text_id", *keep, F.posexplode(F.arrays_zip("token", "before", "after")).alias("pos", "_z"))
    return rows.select("text_id", *keep, "pos", "_z.token", "_z.before", "_z.after")


def without_stop_words(rows: DataFrame, stop_words: DataFrame, token: str = "token") -> DataFrame:
    """Rows whose token is a content word (row-level filter, keeps repetitions)."""
    rows = rows.where(tx.is_content(token))
    blocked = stop_words.select(F.col("word").alias("_stop"))
    return rows.join(blocked, tx.stop_key(token) == F.col("_stop"), "left_anti")


def content_tokens(rows: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Distinct content tokens; the tests run once per distinct token."""
    distinct = rows.select(tx.strip("token").alias("token")).distinct()
    return without_stop_words(distinct, stop_words)


def vocabulary(rows: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Content tokens numbered in code point order: ``token, idx``."""
    return with_global_rank(content_tokens(rows, stop_words), ["token"], "idx")


def token_totals(rows: DataFrame, stop_words: DataFrame) -> DataFrame:
    """One row: number of distinct tokens before and after the stop-word filter."""
    distinct = rows.select(F.col("token").alias("raw"), tx.strip("token").alias("token")).distinct()
    blocked = stop_words.select(F.col("word").alias("_stop"), F.lit(True).alias("_blocked"))
    flagged = distinct.join(blocked, tx.stop_key("token") == F.col("_stop"), "left")
    kept = tx.is_content("token") & F.col("_blocked").isNull()
    per_token = flagged.groupBy("token").agg(F.count(F.lit(1)).alias("forms"), F.max(kept.cast("int")).alias("kept"))
    return per_token.agg(
        F.coalesce(F.sum("forms"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum("kept"), F.lit(0)).cast("long").alias("n_kept"),
    )


def without_special(rows: DataFrame, special: tuple[str, ...] = tx.SPECIAL_TOKENS) -> DataFrame:
    return rows.where(~tx.is_special("token", special))


def single_rows(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts whose id stands in one row only, and the rows of all others: repeated ids and none."""
    several = stored(texts.groupBy("text_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("text_id"), "several")
    once = texts.where(F.col("text_id").isNotNull()).join(several, "text_id", "left_anti")
    return once, texts.join(several, "text_id", "left_semi").unionByName(texts.where(F.col("text_id").isNull()))


def prepared_words(
    texts: DataFrame,
    stop_words: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    stem: bool = False,
) -> DataFrame:
    """Distinct words per text for topic models: ``text_id, word``.

    E-mail addresses go first; words are lower-cased, freed of punctuation, kept
    when alphabetic and not a stop word, then stemmed and/or replaced by their
    lemma (a table ``word, lemma``).
    """
    once, more = single_rows(texts)  # words of a single row are made distinct within it
    words = _word_rows(once).unionByName(_word_rows(more).distinct())
    if stop_words is not None:
        words = words.join(stop_words.select("word"), "word", "left_anti")
    if stem or lemmas is not None:
        from wordprism.operators.annotate import lemmatised, stemmed

        if stem:
            words = words.withColumn("word", stemmed("word"))
        if lemmas is not None:
            words = lemmatised(words, lemmas, "word", "word")
        words = words.distinct()
    return words.select("text_id", "word")


def _word_rows(texts: DataFrame) -> DataFrame:
    """``text_id, word``: the alphabetic words of each row, once per row."""
    plain = F.when(F.contains("text", F.lit("@")), F.regexp_replace("text", tx.EMAIL, "")).otherwise(F.col("text"))
    found = F.array_distinct(F.regexp_extract_all(tx.strip(plain), F.lit(HYPHENATED), F.lit(0)))
    words = F.array_distinct(F.transform(found, lambda token: _ascii_unpunctuated(F.lower(token))))
    return texts.select("text_id", F.explode(words).alias("word")).where(F.col("word").rlike(r"^\p{L}+$"))


def _ascii_unpunctuated(word: Column) -> Column:
    # The ASCII punctuation marks.
    return F.translate(word, r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", "")


def prepared_texts(words: DataFrame, texts: DataFrame) -> DataFrame:
    """``text_id, processed_text`` for every text: its words in order, joined by blanks; empty without words."""
    listed = words.groupBy("text_id").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("processed_text"))
    return texts.select("text_id").join(listed, "text_id", "left").select("text_id", F.coalesce("processed_text", F.lit("")).alias("processed_text"))
