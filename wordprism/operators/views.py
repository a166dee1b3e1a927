"""What the linked views show for a selection: words, links, tables, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordprism.functions import text as tx
from wordprism.functions.geometry import rescale
from wordprism.operators.stats import MOST_WORDS, token_frequency, zipf_filter
from wordprism.plans.ranking import with_global_rank
from wordprism.plans.tables import stored

LINKS_PER_CLASS = 5
PAGE = 10
WORD_SIZES = (20, 40)


def refilter_words(occurrence: DataFrame, selected: DataFrame | None = None, most: int = MOST_WORDS) -> DataFrame:
    """The most telling words of the selected texts (of all texts without a selection).

    Words are recounted over the whole vocabulary before the filter. A selection
    that is active but empty shows nothing.
    """
    rows = occurrence
    if selected is not None:
        rows = rows.join(selected.select("text_id"), "text_id", "left_semi")
    return zipf_filter(token_frequency(rows), most)


def word_sizes(words: DataFrame, sizes: tuple[int, int] = WORD_SIZES) -> DataFrame:
    """Add ``size``: the frequency scaled linearly to the font sizes.

    Meant for the at most ``MOST_WORDS`` words of the word view.
    """
    low = words.agg(F.min("frequency").cast("double")).scalar()
    high = words.agg(F.max("frequency").cast("double")).scalar()
    return words.withColumn("size", rescale("frequency", low, high, *sizes))


def extent(points: DataFrame) -> DataFrame:
    """One row: smallest and largest x and y."""
    return points.agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


def to_screen(points: DataFrame, width: float, height: float) -> DataFrame:
    """Points mapped to [0, width] x [height, 0]: y grows downwards on the screen."""
    box = extent(points).select(F.struct("*")).scalar()
    return points.select(
        "text_id",
        rescale("x", box["min_x"], box["max_x"], 0, width).alias("x"),
        rescale("y", box["min_y"], box["max_y"], height, 0).alias("y"),
    )


def sankey_links(
    attribution: DataFrame,
    occurrence: DataFrame | None = None,
    selected: DataFrame | None = None,
    most: int = LINKS_PER_CLASS,
) -> DataFrame:
    """Links ``class, token, value``: the best tokens per class with a positive score.

    A class whose scores are all equal has no links. With a selection (``text_id,
    label``), only classes of selected texts remain and a token needs an
    occurrence in a selected text of that class. Ties go to the smaller token.
    """
    flat = attribution.groupBy("class").agg(F.max("score").alias("_hi"), F.min("score").alias("_lo"))
    usable = flat.where(F.col("_hi") != F.col("_lo")).select("class")
    rows = attribution.join(usable, "class", "left_semi").where(F.col("score") > 0)
    if selected is not None:
        chosen = selected.select("text_id", F.col("label").alias("class")).distinct()
        # texts first: their key is unique, and hot tokens shrink before they meet the scores
        present = (
            occurrence.select("text_id", F.col("label").alias("class"), "token")
            .join(chosen, ["text_id", "class"], "left_semi")
            .select("class", "token").distinct()
        )
        rows = rows.join(present, ["class", "token"], "left_semi")
    best = Window.partitionBy("class").orderBy(F.desc("score"), "token")
    ranked = rows.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= most)
    return ranked.select("class", "token", F.col("score").alias("value"))


def sankey_nodes(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Nodes ``type, node, fixed_value``: classes, then distinct tokens.

    A class without links gets half of the smallest class total.
    """
    totals = links.groupBy("class").agg(F.sum("value").alias("total"))
    smallest = totals.agg(F.min("total")).scalar()
    named = classes.select("class").distinct().join(totals, "class", "left")
    cls = named.select(
        F.lit("class").alias("type"), F.col("class").alias("node"),
        F.when(F.col("total").isNull(), smallest / 2).alias("fixed_value"),
    )
    tokens = links.select(F.lit("token").alias("type"), F.col("token").alias("node")).distinct()
    return cls.unionByName(tokens.withColumn("fixed_value", F.lit(None).cast("double")))


def token_table(occurrence: DataFrame, times: str | None = None) -> DataFrame:
    """Per token: ``entries`` and its distinct ``word, tag_desc, entity`` rows.

    ``times`` names the column that tells how many occurrences a row stands for (one without it).
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    per_row = occurrence.groupBy("token", blank("tag_word"), blank("tag_desc"), blank("entity")).agg(
        (F.sum(times) if times else F.count(F.lit(1))).alias("_n")
    )
    per_row = stored(per_row, "entries")  # read for the rows and for their sums
    entries = per_row.groupBy("token").agg(F.sum("_n").alias("entries"))
    table = per_row.drop("_n").join(entries, "token")
    part = tx.word_part("token", "tag_word")
    return table.select(
        "token", "entries", F.col("tag_word").alias("word"), part["part"].alias("part"), "tag_desc", "entity"
    )


def distinct_spans(spans: DataFrame) -> DataFrame:
    """Each (token, start, end) of a text once."""
    return spans.select("text_id", "token", "start", "end").distinct()


def highlighted(texts: DataFrame, spans: DataFrame, opening: str = "<mark>", closing: str = "</mark>") -> DataFrame:
    """``text_id, html``: texts with their spans marked; texts without spans unchanged.

    A span that reaches into a later one is dropped, so marks never nest.
    """
    order = Window.partitionBy("text_id").orderBy("start", "end")
    rows = spans.select("text_id", "start", "end").distinct().withColumn("_next", F.lead("start").over(order))
    kept = rows.where(F.col("_next").isNull() | (F.col("end") <= F.col("_next")))
    kept = kept.withColumn("previous", F.lag("end", 1, 0).over(order))
    lists = kept.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "previous"))).alias("_s"))
    joined = texts.select("text_id", "text").join(lists, "text_id", "left")
    html = F.coalesce(tx.highlight("text", "_s", opening, closing), F.col("text"))
    return joined.select("text_id", html.alias("html"))


def page(texts: DataFrame, number: int, size: int = PAGE, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Rows of one page (0-based), with ``row`` counted from 1.

    A page is reached by ordering and skipping; only rows up to its end are kept
    by the sort.
    """
    chosen = texts.orderBy(*order).offset(number * size).limit(size)
    at = Window.orderBy(*order)  # at most one page of rows
    return chosen.withColumn("row", (F.row_number().over(at) + number * size).cast("long"))


def _controls(page: Column, n: Column, size: int) -> dict[str, Column]:
    first = page * size + 1
    last = F.least(first + size - 1, n)
    return {
        "first_row": first.cast("long"),
        "last_row": last.cast("long"),
        "label": F.concat(first.cast("string"), F.lit("-"), last.cast("string")),
        "has_previous": page > 0,
        "has_next": first + size - 1 < n,
    }


def pages(texts: DataFrame, size: int = PAGE) -> DataFrame:
    """The page table: ``page, first_row, last_row, label, has_previous, has_next``."""
    n = texts.count()
    numbers = texts.sparkSession.range(-(-n // size)).withColumnRenamed("id", "page")
    return numbers.withColumns(_controls(F.col("page"), F.lit(n).cast("long"), size))


def paged(texts: DataFrame, size: int = PAGE, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """All texts with their ``row`` (from 1), ``page`` (from 0) and the controls of the page."""
    n = texts.agg(F.count(F.lit(1))).scalar()
    ranked = with_global_rank(texts, list(order), "row").withColumn("_n", n)
    ranked = ranked.withColumn("page", F.floor(F.col("row") / size).cast("long")).withColumn("row", F.col("row") + 1)
    return ranked.withColumns(_controls(F.col("page"), F.col("_n"), size)).drop("_n")


def text_list(texts: DataFrame, selected: DataFrame | None, spans: DataFrame | None = None, marks: bool = True) -> DataFrame:
    """Text cards ``text_id, ord, label, html`` of the selection (all without one)."""
    label: Column = F.coalesce("label", "topic").alias("label")
    cards = texts.select("text_id", "ord", label, "text")
    if selected is not None:
        cards = cards.join(selected.select("text_id"), "text_id", "left_semi")
    if spans is None or not marks:
        return cards.withColumnRenamed("text", "html")
    return cards.drop("text").join(highlighted(cards, spans), "text_id")
