"""Plane geometry as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_polygon(x: Column | str, y: Column | str, polygon: Sequence[tuple[float, float]]) -> Column:
    """Inside or on the border of a polygon (even-odd rule), without a join."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    y = (F.col(y) if isinstance(y, str) else y).cast("double")
    corners = [(float(a), float(b)) for a, b in polygon]
    edges = F.array(
        *[
            F.struct(F.lit(ax).alias("ax"), F.lit(ay).alias("ay"), F.lit(bx).alias("bx"), F.lit(by).alias("by"))
            for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1])
        ]
    )
    on_border = F.exists(
        edges,
        lambda e: (
            ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"]))
            & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
            & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        ),
    )
    crossed = lambda e: (
        ((e["ay"] > y) != (e["by"] > y))
        & (x < (e["bx"] - e["ax"]) * F.coalesce(F.try_divide(y - e["ay"], e["by"] - e["ay"]), F.lit(0.0)) + e["ax"])
    )
    odd = F.aggregate(edges, F.lit(False), lambda acc, e: F.when(crossed(e), ~acc).otherwise(acc))
    lowest_x, highest_x = min(a for a, _ in corners), max(a for a, _ in corners)
    lowest_y, highest_y = min(b for _, b in corners), max(b for _, b in corners)
    boxed = x.between(lowest_x, highest_x) & y.between(lowest_y, highest_y)
    return boxed & (on_border | odd)


def rescale(value: Column | str, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Linear map of [low, high] to [to_low, to_high]; the middle where low = high."""
    value = F.col(value) if isinstance(value, str) else value
    share = F.coalesce(F.try_divide(value.cast("double") - low, high - low), F.lit(0.5))
    return F.lit(float(to_low)) + share * (to_high - to_low)
