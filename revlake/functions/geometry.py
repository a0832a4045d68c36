"""Boxes, points and similarity transforms as Column expressions. A box is a struct x0, y0, x1, y1, a point x, y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def unit(value: Column, extent: Column) -> Column:
    """Coordinate over its page's extent (1 at least), held between 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / F.greatest(extent.cast("double"), F.lit(1.0))))


def unit_point(p: Column, width: Column, height: Column) -> Column:
    return point(unit(p["x"], width), unit(p["y"], height))


def unit_box(b: Column, width: Column, height: Column) -> Column:
    """Normalised box with its edges in order."""
    xs, ys = (unit(b["x0"], width), unit(b["x1"], width)), (unit(b["y0"], height), unit(b["y1"], height))
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre(b: Column) -> Column:
    return point((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def moved(p: Column, t: Column) -> Column:
    """Point of the old frame in the new one; t: struct scale, rotation, tx, ty."""
    c, s = F.cos(t["rotation"]), F.sin(t["rotation"])
    return point(t["scale"] * (c * p["x"] - s * p["y"]) + t["tx"], t["scale"] * (s * p["x"] + c * p["y"]) + t["ty"])


def moved_box(b: Column, t: Column) -> Column:
    """Envelope of a box's four moved corners."""
    corners = [moved(point(b[x], b[y]), t) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    xs, ys = [c["x"] for c in corners], [c["y"] for c in corners]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def union_box(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger magnitude; 1 if both vanish."""
    high = F.greatest(F.abs(a), F.abs(b))
    return F.when(high < 1e-10, 1.0).otherwise(F.least(F.abs(a), F.abs(b)) / high)


def aspect(b: Column) -> Column:
    return F.when(height(b) < 1e-8, F.when(width(b) > 1e-8, 1000.0).otherwise(1.0)).otherwise(F.least(F.lit(1000.0), width(b) / height(b)))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; boxes without area only overlap when equal."""
    common = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    union = area(a) + area(b) - common
    return F.when(union > 1e-12, common / union).otherwise((a == b).cast("double"))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two map<string,int>; 1 if both are empty."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y")))
    values = F.map_values(both)
    sums = F.aggregate(values, F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")), lambda s, v: F.struct((s["low"] + F.least(v["x"], v["y"])).alias("low"), (s["high"] + F.greatest(v["x"], v["y"])).alias("high")))
    return F.when(sums["high"] == 0, 1.0).otherwise(sums["low"] / sums["high"])


def position_score(d: Column, radius: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / max(radius, 1e-9))


def context_similarity(a: Column, b: Column) -> Column:
    """Mean closeness of two arrays of neighbourhood statistics."""
    parts = F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(0.02))))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(parts)
