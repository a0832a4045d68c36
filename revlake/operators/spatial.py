"""Spatial joins within pages: all pairs within a radius, and nearest neighbours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread


def radius_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float, lx: str = "lx", ly: str = "ly", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Rows of left and right with equal keys whose points are within the radius (inclusive), and their distance d.

    Points are put into square cells as wide as the radius. Each left row is copied to the nine cells around its own and
    joined on (keys, cell), so the join is an equi-join whose keys are spread over the page. With radius 0 points must be
    equal. Rows with a null, infinite or not-a-number coordinate join nothing.
    """
    if not math.isfinite(radius) or radius < 0:
        raise ValueError("radius must be a finite non-negative value")
    finite = lambda *c: [F.abs(F.col(x)) < float("inf") for x in c]
    left, right = left.where(finite(lx, ly)[0] & finite(lx, ly)[1]), right.where(finite(rx, ry)[0] & finite(rx, ry)[1])
    d = F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry))
    if radius == 0:
        return left.join(right.withColumns({"__x": F.col(rx), "__y": F.col(ry)}), [*[left[k] == right[k] for k in keys], F.col(lx) == F.col("__x"), F.col(ly) == F.col("__y")]).drop("__x", "__y", *[right[k] for k in keys]).withColumn("d", F.lit(0.0))
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.flatten(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.transform(F.array(*[F.lit(j) for j in (-1, 0, 1)]), lambda j: F.struct((cell(lx) + i).alias("cx"), (cell(ly) + j).alias("cy"))))))
    copied = left.withColumn("__cell", around).withColumns({"__cx": F.col("__cell.cx"), "__cy": F.col("__cell.cy")}).drop("__cell")
    placed = right.withColumns({"__cx": cell(rx), "__cy": cell(ry)})
    return copied.join(placed, [*keys, "__cx", "__cy"]).drop("__cx", "__cy").withColumn("d", d).where(F.col("d") <= radius)


def nearest_join(points: DataFrame, keys: list[str], id_col: str, x: str, y: str, count: int) -> DataFrame:
    """(keys, id, neighbour, rank, d): each point's `count` nearest of its page, itself first, ties by id. One page at a time."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        d, at = nearest(pdf[["x", "y"]].to_numpy(), count)
        ids, each = pdf["id"].to_numpy(), at.shape[1]
        out = pdf[[*keys, "id"]].loc[pdf.index.repeat(each)].reset_index(drop=True)
        return out.assign(neighbour=ids[at.ravel()], rank=np.tile(np.arange(1, each + 1), len(ids)), d=d.ravel())

    rows = points.select(*keys, F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    kind = rows.schema["id"].dataType.simpleString()
    ddl = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(kernel, f"{ddl}, id {kind}, neighbour {kind}, rank int, d double")


def nearest(points: np.ndarray, count: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Distances and indices of each point's nearest points, itself first, ties by index; computed in blocks of rows."""
    points = check_points(points)
    n = len(points)
    count = min(max(int(count), 0), n)
    d, at = np.empty((n, count)), np.empty((n, count), np.int64)
    for lo in range(0, n, block):
        part = slice(lo, min(lo + block, n))
        square = (points[part, None, 0] - points[None, :, 0]) ** 2 + (points[part, None, 1] - points[None, :, 1]) ** 2
        square[np.arange(square.shape[0]), np.arange(lo, part.stop)] = -1
        if not count:
            continue
        last = np.partition(square, count - 1, axis=1)[:, count - 1]
        row, column = np.nonzero(square <= last[:, None])  # with all ties of the last, so few are sorted
        value = square[row, column]
        order = np.lexsort((column, value, row))
        first = np.searchsorted(row, np.arange(square.shape[0]))[:, None] + np.arange(count)
        at[part], d[part] = column[order][first], np.sqrt(np.maximum(value[order][first], 0))
    return d, at


def check_points(points: np.ndarray) -> np.ndarray:
    points = np.asarray(points, np.float64)
    if points.ndim != 2 or points.shape[1] != 2:
        raise ValueError("points must have the shape (n, 2)")
    if not np.isfinite(points).all():
        raise ValueError("points must be finite")
    return points


def neighbourhood(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, context): text share, its complement, mean distance, spread plus mean area of the six nearest entities."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], kind="stable")
        n = len(pdf)
        out = np.zeros((n, 4))
        if n > 1:
            d, at = nearest(pdf[["x", "y"]].to_numpy(), min(7, n))
            text, size = pdf["is_text"].to_numpy(float), pdf["area"].to_numpy(float)
            at, d = at[:, 1:], d[:, 1:]
            mean = d.mean(1)
            out = np.stack([text[at].mean(1), 1 - text[at].mean(1), mean, np.sqrt(((d - mean[:, None]) ** 2).mean(1)) + size[at].mean(1)], 1)
        got = pdf[[*keys, "id"]].copy()
        got["context"] = list(out.tolist())
        return got

    ddl = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys) + ", id string, context array<double>"
    order: Column = F.struct("kind", "bbox", "id")
    rows = spread(pages.select(*keys, "id", "anchor", "kind", "bbox"), keys).select(*keys, "id", F.col("anchor.x").alias("x"), F.col("anchor.y").alias("y"), (F.col("kind") == "text").alias("is_text"), (F.greatest(F.lit(0.0), F.col("bbox.x1") - F.col("bbox.x0")) * F.greatest(F.lit(0.0), F.col("bbox.y1") - F.col("bbox.y0"))).alias("area"), F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("rank"))
    return rows.groupBy(*keys).applyInPandas(kernel, ddl)
