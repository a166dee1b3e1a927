"""Mix sources to target weights by repeating or thinning their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordprism.plans.tables import stored

WEIGHTS = (3, 1, 2)  # of the sources in code-point order, repeating
SHARE = 1.5  # words of the mix, as a part of all words
MOST = 2.0  # times a source's size that its target may reach
BROADCAST_SOURCES = 100_000  # more sources than this are joined by a shuffle
_DRAW = float(1 << 32)


def n_words(text: Column | str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from rows with ``source, size``.

    Shares go by weight; a target stops at ``most`` times its source and the excess is
    shared by weight among the rest. With sources ordered by capacity per weight,
    the capped ones come first: one pass of running sums finds the level.
    """
    total = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    ranked = total.withColumn("_weight", weight).withColumn("_room", F.col("source_size") * F.lit(float(most)))
    level = Window.orderBy((F.col("_room") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    below, above = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    goal = F.sum("source_size").over(everything) * F.lit(float(share))
    ranked = ranked.withColumn("_level", (goal - F.coalesce(F.sum("_room").over(below), F.lit(0.0))) / F.sum("_weight").over(above))
    # the level is the one at the first source that has room; it is lower at every later one
    open_level = F.max(F.when(F.col("_level") * F.col("_weight") <= F.col("_room"), F.col("_level"))).over(everything)
    target = F.when(open_level.isNull(), F.col("_room")).otherwise(F.least(F.col("_room"), open_level * F.col("_weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: int) -> Column:
    """Number in [0, 1) that depends on the seed and the key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(_DRAW)


def document_key(doc_id: Column, text: Column) -> Column:
    """What a document is drawn by: its id and the digest of its text, so that rows that share an id draw apart."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def mixing_plan(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies``.

    ``rate`` is target / source size, ``copies`` its floor plus one more when the
    document's draw falls below the fraction. The first pass reads source and words
    only and ends in one row per source.

    Null source: a source of its own, after all others. Null text: size 0. A row is
    drawn by its id (or ``null``) and its text, so only equal texts under one id are
    drawn alike. A source
    without words has target 0 and rate 0. Columns of ``docs`` that bear one of the
    added names are replaced. No rows give no rows.
    """
    sized = docs.withColumn("size", n_words("text"))
    plan = stored(targets(sized.select("source", "size"), weights, share, most), "targets")
    plan = plan.withColumnRenamed("source", "_source")
    rows = sized.drop("source_size", "target", "rate", "copies")
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(plan) if small else plan, rows["source"].eqNullSafe(plan["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", rate)
    extra = (draw(document_key(F.col("doc_id"), F.col("text")), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate") + extra)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows of ``docs``: each row as often as ``mixing_plan`` says, with all its columns whatever their names."""
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))
    planned = mixing_plan(rows, **options).where("copies > 0").select("_row", "copies")
    return planned.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
