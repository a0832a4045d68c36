"""Raw tables at the scan boundary, and a synthetic revision pair made from an orders table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.extraction import BOX, POINT, complete

SCHEMAS = {
    "raw_documents": "pair_id string, side string, file_name string, size_bytes long, header string, encrypted boolean, page_count int",
    "raw_pages": "pair_id string, side string, page_index int, width double, height double",
    "raw_spans": f"pair_id string, side string, page_index int, block_index int, line_index int, span_index int, text string, bbox {BOX}, origin {POINT}, dir {POINT}, font string, size double, flags int, color int, alpha int",
    "raw_drawings": f"pair_id string, side string, page_index int, source_index int, items array<struct<op:string,pts:array<{POINT}>>>, rect {BOX}, color array<double>, fill array<double>, width double, dashes string, stroke_opacity double, fill_opacity double, close_path boolean",
    "raw_images": f"pair_id string, side string, page_index int, image_index int, bbox {BOX}",
}


@dataclass(frozen=True)
class RawTables:
    """The five raw tables of any number of revision pairs; side is old or new, coordinates are points on the page."""

    documents: DataFrame
    pages: DataFrame
    spans: DataFrame
    drawings: DataFrame
    images: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str, pairs: list[str] | None = None) -> RawTables:
        """From Parquet folders under path; pairs prune partitions when the tables are partitioned by pair_id."""
        tables = (spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in SCHEMAS.items())
        return RawTables(*(t if pairs is None else t.where(F.col("pair_id").isin(pairs)) for t in tables))

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """As Parquet partitioned by pair_id, so that a pair is read without the others."""
        for name, df in zip(SCHEMAS, (self.documents, self.pages, self.spans, self.drawings, self.images), strict=True):
            df.write.mode(mode).partitionBy("pair_id").parquet(f"{path}/{name}")

    @staticmethod
    def of(spark: SparkSession, **rows: list) -> RawTables:
        """From lists of rows by table name without raw_; missing tables are empty."""
        return RawTables(*(spark.createDataFrame(rows.get(name.removeprefix("raw_"), []), ddl) for name, ddl in SCHEMAS.items()))


def synthetic_pair(orders: DataFrame, per_page: int = 250, pair_id: str = "orders") -> DataFrame:
    """An old and a new revision as an entity table: orders placed by key, with edits, moves, removals and a global shift."""
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "geometry").otherwise("text")
    text = F.when(k % 6 == 1, F.concat((k % 400).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(" mm"))).when(k % 6 == 2, F.concat(F.lit("NOTE: "), "o_orderpriority")).when(k % 6 == 4, F.concat(F.lit("POSITION .0"), (k % 90 + 10).cast("string"), F.lit(" A B"))).when(k % 6 == 5, F.concat(F.lit("REVISION "), "o_orderstatus")).otherwise("")
    base = orders.select(k.alias("k"), F.floor(k / per_page).cast("int").alias("page_index"), (((k * 7919) % 10007) / F.lit(10007.0)).alias("x"), (((k * 104729) % 9973) / F.lit(9973.0)).alias("y"), kind.alias("kind"), text.alias("text"))
    old = base.withColumn("side", F.lit("old"))
    k = F.col("k")
    new = base.where(k % 17 != 0).withColumns({"side": F.lit("new"), "text": F.when((k % 11 == 0) & (F.col("text") != ""), F.concat("text", F.lit(" X"))).otherwise(F.col("text")), "x": F.col("x") + 0.01 + F.when(k % 13 == 0, 0.010).when(k % 19 == 0, 0.09).otherwise(0.0), "y": F.col("y") - 0.005})
    both = old.unionByName(new)
    w, h = 0.01 + (k % 7) / F.lit(1000.0), 0.008 + (k % 5) / F.lit(1000.0)
    signature = F.concat_ws("|", "kind", "text", F.when(F.col("kind") == "geometry", k % 40).otherwise(F.lit(0)).cast("string"))
    shape = F.when(F.col("kind") == "geometry", F.concat(F.lit("shape-"), (k % 400).cast("string"))).otherwise("text-span")
    rows = both.select(
        F.lit(pair_id).alias("pair_id"), "side", "page_index", F.concat(F.lit("e-"), F.lpad(k.cast("string"), 9, "0")).alias("id"), "kind",
        G.box(F.col("x"), F.col("y"), F.col("x") + w, F.col("y") + h).alias("bbox"), G.point(F.col("x"), F.col("y")).alias("anchor"),
        signature.alias("content_signature"), shape.alias("shape_signature"), F.lit("style").alias("style_signature"),
        "text", F.lower("text").alias("text_normalized"), F.lit("font").alias("font_name"), F.when(F.col("kind") == "text", 0.01).otherwise(0.0).alias("font_size"),
        F.when(F.col("kind") == "geometry", F.create_map(F.lit("l"), (k % 5 + 1).cast("int"), F.lit("c"), (k % 3).cast("int"))).alias("op_histogram"), F.when(F.col("kind") == "geometry", (k % 5 + 1 + k % 3).cast("int")).alias("primitive_count"), F.when(F.col("kind") == "geometry", w + h).alias("path_length"),
    )
    return complete(rows)
