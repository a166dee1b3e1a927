"""Linked selections: what each view selects and how selections combine.

A selection is a table ``view, text_id, start, end``; spans are set for the word
and explanation views only, which keep one row per occurrence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordprism.functions.geometry import in_polygon

# The views in the order in which they are folded.
VIEWS = ("lasso", "class", "word", "text", "explanation")
WITH_SPANS = ("word", "explanation")


def as_selection(rows: DataFrame, view: str) -> DataFrame:
    if view not in VIEWS:
        raise ValueError(f"unknown view {view}")
    span = lambda c: F.col(c).cast("int") if view in WITH_SPANS else F.lit(None).cast("int")
    return rows.select(
        F.lit(view).alias("view"), "text_id", span("start").alias("start"), span("end").alias("end")
    )


def lasso(projection: DataFrame, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Points inside or on a polygon."""
    return projection.where(in_polygon("x", "y", polygon))


def by_class(texts: DataFrame, classes: Sequence[str]) -> DataFrame:
    return texts.where(F.coalesce("label", "topic").isin(*classes))


def by_word(occurrence: DataFrame, token: str) -> DataFrame:
    """Occurrences (text and span) of one token."""
    return occurrence.where(F.col("token") == token)


def toggle_texts(selection: DataFrame, clicked: DataFrame) -> DataFrame:
    """Text view after clicks: a selected text leaves the list, another joins it.

    ``clicked`` may hold a text several times; an even number of clicks has no effect.
    """
    listed = selection.select("text_id").distinct().withColumn("n", F.lit(1))
    clicks = clicked.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))
    both = listed.unionByName(clicks).groupBy("text_id").agg(F.sum("n").alias("n"))
    return both.where(F.col("n") % 2 == 1).select("text_id")


def linked_by_class(links: DataFrame, occurrence: DataFrame, cls: str) -> DataFrame:
    """Class node: occurrences of its linked tokens in texts of that class."""
    tokens = links.where(F.col("class") == cls).select("token")
    return occurrence.where(F.col("label") == cls).join(tokens, "token", "left_semi")


def linked_by_token(links: DataFrame, occurrence: DataFrame, token: str) -> DataFrame:
    """Token node: its occurrences in texts of any class it is linked to."""
    classes = links.where(F.col("token") == token).select(F.col("class").alias("label"))
    return occurrence.where(F.col("token") == token).join(classes, "label", "left_semi")


def union(*selections: DataFrame) -> DataFrame:
    result = selections[0]
    for other in selections[1:]:
        result = result.unionByName(other)
    return result


def projection_entries(selection: DataFrame) -> DataFrame:
    """The lasso list followed by the class list, as the scatter plot holds them."""
    return selection.where(F.col("view").isin("lasso", "class")).select("view", "text_id")


def clear(selection: DataFrame, view: str | None = None) -> DataFrame:
    """Without the entries of one view, or of all of them."""
    return selection.where(F.col("view") != view) if view else selection.limit(0)


def _view_bits(selection: DataFrame) -> DataFrame:
    bit = F.lit(None).cast("long")
    for i, view in enumerate(VIEWS):
        bit = F.when(F.col("view") == view, F.lit(1 << i).cast("long")).otherwise(bit)
    return selection.groupBy("text_id").agg(F.bit_or(bit).alias("mask"))


def intersect(selection: DataFrame, strict: bool = False) -> DataFrame:
    """Texts that pass every view: ``text_id``.

    Views are folded in order. An empty view does not restrict, and while the
    running result is empty the next view replaces it, which also happens after
    two views without common texts. ``strict`` leaves an empty result empty.

    Each text carries a 5-bit mask of its views; which of the 32 masks occur is
    one number, and the fold is arithmetic on it.
    """
    masks = _view_bits(selection)
    present = masks.agg(F.bit_or(F.expr("shiftleft(1L, cast(mask as int))"))).scalar()
    present = F.coalesce(present, F.lit(0).cast("long"))
    in_view = [sum(1 << m for m in range(32) if m >> i & 1) for i in range(len(VIEWS))]
    view = [present.bitwiseAND(F.lit(bits)) for bits in in_view]
    if strict:
        result = present
        for v in view:
            result = F.when(v == 0, result).otherwise(result.bitwiseAND(v))
    else:
        result = view[0]
        for v in view[1:]:
            result = F.when(result == 0, v).when(v == 0, result).otherwise(result.bitwiseAND(v))
    # the fold is evaluated once, as a one-row subquery
    chosen = masks.sparkSession.range(1).select(result.alias("m")).scalar()
    bit = chosen.bitwiseAND(F.expr("shiftleft(1L, cast(mask as int))"))
    return masks.where(bit != 0).select("text_id")


def positions(selection: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans that the word and explanation views hold for the given texts."""
    spans = selection.where(F.col("view").isin(*WITH_SPANS))
    return spans.join(texts.select("text_id").distinct(), "text_id", "left_semi")


def count_entries(selection: DataFrame, but: str | None = None) -> DataFrame:
    """One row ``n``: selected entries, without one view (``projection`` means two)."""
    left_out = {"projection": ("lasso", "class"), None: ()}.get(but, (but,))
    kept = ~F.col("view").isin(*left_out) if left_out else F.lit(True)
    return selection.agg(F.count_if(kept).alias("n"))


def mark_points(points: DataFrame, selected: DataFrame | None, classes: Sequence[str] = ()) -> DataFrame:
    """Add ``unselected`` to every point.

    A point is unselected when a selection exists that lacks it, or classes are
    chosen and its label is not among them.
    """
    flag = F.lit(False)
    if classes:
        flag = ~F.coalesce(F.col("label").isin(*classes), F.lit(False))
    if selected is None:
        return points.withColumn("unselected", flag)
    ids = selected.select("text_id").distinct()
    some = ids.agg(F.count(F.lit(1)) > 0).scalar()
    marked = points.join(ids.withColumn("_in", F.lit(True)), "text_id", "left")
    return marked.withColumn("unselected", flag | (some & F.col("_in").isNull())).drop("_in")


def selected_labels(texts: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected texts with their labels, each once."""
    label = F.coalesce("label", "topic").alias("label")
    return texts.select("text_id", label).join(selected.select("text_id"), "text_id", "left_semi").distinct()


def link_counts(links: DataFrame, occurrence: DataFrame, selected: DataFrame) -> DataFrame:
    """Per class: links whose token occurs in a selected text; per token: 1 or 0.

    ``type, node, n`` for all nodes of the diagram.
    """
    hit = (
        occurrence.join(selected.select("text_id"), "text_id", "left_semi")
        .select("token").distinct().withColumn("_hit", F.lit(1))
    )
    marked = links.select("class", "token").distinct().join(hit, "token", "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    nodes = marked.groupBy(F.lit("class").alias("type"), F.col("class").alias("node")).agg(F.sum("_hit").alias("n"))
    tokens = marked.groupBy(F.lit("token").alias("type"), F.col("token").alias("node")).agg(F.max("_hit").cast("long").alias("n"))
    return nodes.unionByName(tokens)
