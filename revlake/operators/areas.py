"""Exact area of a union of boxes, by slabs between their edges and merged intervals within each slab."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_area(boxes: DataFrame, keys: list[str], box: Column | str = "bbox", clip: tuple[Column, Column] | None = None) -> DataFrame:
    """(keys, area): area of the union of each key's boxes, clipped to (0, 0) .. clip (the unit square by default).

    Edges of a key give slabs (lead); a box covers the slabs that it spans; a slab's intervals are merged by a running maximum
    (gaps and islands). Keys without boxes have no row.
    """
    b = F.col(box) if isinstance(box, str) else box
    right, bottom = clip or (F.lit(1.0), F.lit(1.0))
    held = lambda v, most: F.least(most.cast("double"), F.greatest(F.lit(0.0), v))
    rows = boxes.select(*keys, held(b["x0"], right).alias("x0"), held(b["y0"], bottom).alias("y0"), held(b["x1"], right).alias("x1"), held(b["y1"], bottom).alias("y1"))
    edges = rows.select(*keys, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    slabs = edges.withColumn("right", F.lead("left").over(Window.partitionBy(*keys).orderBy("left"))).where(F.col("right") > F.col("left"))
    middle = (F.col("left") + F.col("right")) / 2
    cover = slabs.join(rows, keys).where((F.col("x0") <= middle) & (middle <= F.col("x1")) & (F.col("y1") > F.col("y0"))).select(*keys, "left", "right", "y0", "y1")
    w = Window.partitionBy(*keys, "left").orderBy("y0", "y1")
    before = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce("before", F.col("y0"))))
    measured = cover.withColumn("before", before).withColumn("part", part).groupBy(*keys).agg(F.sum(F.col("part") * (F.col("right") - F.col("left"))).alias("area"))
    return rows.select(*keys).distinct().join(measured, keys, "left").select(*keys, F.coalesce("area", F.lit(0.0)).alias("area"))
