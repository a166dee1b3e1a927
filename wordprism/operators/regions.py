"""Points in many polygons at once, by a join on the cells of a grid.

A polygon becomes one row per cell of its bounding box. The row holds the edges
that can matter to a point of that cell: those that reach the cell's band of
heights and do not end left of the cell. An edge that lies wholly to the right and
passes through the whole band is crossed by every ray to the right, so it is
counted once, when the row is made. A point has one cell, so it meets a polygon
at most once and needs no grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 32  # of the grid, each way


def _spot(value: Column, low: Column, high: Column, cells: int) -> Column:
    """Number of the cell that holds a value; rises with the value, so a range of values is a range of cells."""
    return F.when(high > low, F.floor((value - low) / (high - low) * cells)).otherwise(F.lit(0)).cast("int")


def _edges(polygons: DataFrame) -> DataFrame:
    """``polygon, ax, ay, bx, by``: consecutive corners, and the last with the first."""
    corners = F.filter("corners", lambda c: ~F.isnan(c["x"]) & ~F.isnan(c["y"]) & c["x"].isNotNull() & c["y"].isNotNull())
    valid = polygons.where("polygon is not null and size(corners) > 0").select("polygon", corners.alias("c"), F.size("corners").alias("n"))
    valid = valid.where(F.size("c") == F.col("n"))
    pairs = F.arrays_zip(F.col("c").alias("a"), F.concat(F.slice("c", F.lit(2), F.col("n")), F.slice("c", 1, 1)).alias("b"))
    return valid.select("polygon", F.inline(pairs)).select(
        "polygon", *[F.col(f"{end}.{axis}").cast("double").alias(end + axis) for end in "ab" for axis in "xy"]
    )


def grid(polygons: DataFrame, cells: int = CELLS) -> DataFrame:
    """``cx, cy, polygon, flip, edges`` and the extent ``x0, x1, y0, y1`` that the cells divide."""
    edges = _edges(polygons)
    low, high = lambda axis: F.least(f"a{axis}", f"b{axis}"), lambda axis: F.greatest(f"a{axis}", f"b{axis}")
    extent = edges.agg(F.min(low("x")).alias("x0"), F.max(high("x")).alias("x1"), F.min(low("y")).alias("y0"), F.max(high("y")).alias("y1"))
    extent = extent.agg(F.first(F.struct("x0", "x1", "y0", "y1"))).scalar()
    placed = edges.select("*", extent.alias("e"))
    spot = lambda value, axis: _spot(value, F.col(f"e.{axis}0"), F.col(f"e.{axis}1"), cells)
    spans = {f"{axis}{k}": spot(end(axis), axis) for axis in "xy" for k, end in (("l", low), ("h", high))}
    placed = placed.select("*", *[v.alias(k) for k, v in spans.items()])
    boxes = placed.groupBy("polygon").agg(F.min("xl").alias("left"), F.max("xh").alias("right"), F.first("e").alias("e"))
    bands = placed.select("polygon", F.explode(F.sequence("yl", "yh")).alias("cy"), "ax", "ay", "bx", "by", "xl", "xh", "yl", "yh")
    edge = F.struct("ax", "ay", "bx", "by", "xl", "xh", ((F.col("yl") < F.col("cy")) & (F.col("cy") < F.col("yh"))).alias("through"))
    rows = bands.groupBy("polygon", "cy").agg(F.collect_list(edge).alias("all")).join(boxes, "polygon")
    rows = rows.withColumn("cx", F.explode(F.sequence("left", "right")))
    counted = lambda e: e["through"] & (e["xl"] > F.col("cx"))
    return rows.select(
        "cx", "cy", "polygon", (F.size(F.filter("all", counted)) % 2 == 1).alias("flip"),
        F.filter("all", lambda e: (e["xh"] >= F.col("cx")) & ~counted(e)).alias("edges"), "e.*",
    ).where("flip or size(edges) > 0")


def in_polygons(points: DataFrame, polygons: DataFrame, cells: int = CELLS) -> DataFrame:
    """Every row of ``points`` (x, y and other columns) with every polygon that holds it: its columns and ``polygon``.

    ``polygons`` is polygon (unique id), corners (array of x, y). Even-odd rule; a
    point on the border is inside. Points with a null or NaN coordinate lie in no
    polygon, nor does any point in a polygon without corners or with such a corner.
    One or two corners make a point or a line. A column ``polygon`` of ``points`` is replaced.
    """
    own = [c for c in points.columns if c != "polygon"]
    index = grid(polygons, cells)
    extent = index.agg(F.first(F.struct("x0", "x1", "y0", "y1"))).scalar()
    x, y = F.col("_x"), F.col("_y")
    rows = points.select(F.struct(*own).alias("_row"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), extent.alias("_e"))
    rows = rows.where(x.between(F.col("_e.x0"), F.col("_e.x1")) & y.between(F.col("_e.y0"), F.col("_e.y1")) & ~F.isnan(x) & ~F.isnan(y))
    rows = rows.select(
        "_row", "_x", "_y", *[_spot(v, F.col(f"_e.{a}0"), F.col(f"_e.{a}1"), cells).alias(f"c{a}") for a, v in (("x", x), ("y", y))]
    )
    met = rows.join(index.drop("x0", "x1", "y0", "y1"), ["cx", "cy"])
    border = F.exists(
        "edges",
        lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"]))
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )
    crossed = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (
        x < (e["bx"] - e["ax"]) * F.coalesce(F.try_divide(y - e["ay"], e["by"] - e["ay"]), F.lit(0.0)) + e["ax"]
    )
    odd = F.size(F.filter("edges", crossed)) % 2 == 1
    return met.where(border | (odd != F.col("flip"))).select("_row.*", "polygon")
