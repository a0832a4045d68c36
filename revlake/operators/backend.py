"""The strategy behind matching: how neighbours, pairs within a radius and one-to-one assignments are found."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .assignment import least_cost
from .spatial import nearest_join, radius_join


class MatchingBackend(Protocol):
    """What the tiers ask for; another implementation may be handed to match_entities."""

    def nearest_neighbours(self, points: DataFrame, keys: list[str], id_col: str, x: str, y: str, count: int) -> DataFrame: ...

    def radius_pairs(self, left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame: ...

    def assign(self, candidates: DataFrame, keys: list[str], least: float, sparse_from: int) -> DataFrame: ...


class NativeBackend:
    """Page kernels for neighbours, a cell equi-join for pairs, dense or sparse assignment by component."""

    def nearest_neighbours(self, points: DataFrame, keys: list[str], id_col: str, x: str, y: str, count: int) -> DataFrame:
        return nearest_join(points, keys, id_col, x, y, count)

    def radius_pairs(self, left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
        return radius_join(left, right, keys, radius)

    def assign(self, candidates: DataFrame, keys: list[str], least: float, sparse_from: int) -> DataFrame:
        return least_cost(candidates, keys, least, sparse_from)


class PlainBackend:
    """The same results from plain joins of a page's rows and windows, to check the native one against; quadratic in a page."""

    def nearest_neighbours(self, points: DataFrame, keys: list[str], id_col: str, x: str, y: str, count: int) -> DataFrame:
        a = points.select(*keys, F.col(id_col).alias("id"), F.col(x).alias("__x"), F.col(y).alias("__y"))
        b = points.select(*keys, F.col(id_col).alias("neighbour"), F.col(x).alias("__u"), F.col(y).alias("__v"))
        order = Window.partitionBy(*keys, "id").orderBy((F.col("id") != F.col("neighbour")).cast("int"), "d", "neighbour")
        pairs = a.join(b, keys).withColumn("d", F.hypot(F.col("__x") - F.col("__u"), F.col("__y") - F.col("__v")))
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select(*keys, "id", "neighbour", "rank", "d")

    def radius_pairs(self, left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
        return left.join(right, keys).withColumn("d", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))).where(F.col("d") <= radius)

    def assign(self, candidates: DataFrame, keys: list[str], least: float, sparse_from: int) -> DataFrame:
        return least_cost(candidates, keys, least, 1)  # every component by the sparse method


NATIVE = NativeBackend()
