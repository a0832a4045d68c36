"""Raw spans and drawings of pages to the canonical table of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import casefold, digest, normalize_text

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
POINT = "struct<x:double,y:double>"
ENTITY = (
    f"pair_id string, side string, page_index int, id string, kind string, bbox {BOX}, anchor {POINT}, content_signature string, shape_signature string, style_signature string, "
    f"text string, text_normalized string, font_name string, font_size double, op_histogram map<string,int>, primitive_count int, path_length double, block_index int, line_index int, span_index int, "
    f"direction {POINT}, segments array<struct<a:{POINT},b:{POINT}>>, callout_category string, callout_structure string, member_ids array<string>, attachments array<{POINT}>"
)
DOCUMENT_PAGE = ["pair_id", "side", "page_index"]
EXTRACTION_WHITE, VALIDATION_WHITE = 0.995, 0.985


def is_white(colour: Column, threshold: float) -> Column:
    return F.when(colour.isNull(), False).otherwise(F.forall(colour, lambda c: c >= threshold))


def visible_paint(stroke: Column, fill: Column, stroke_opacity: Column, fill_opacity: Column, threshold: float) -> Column:
    """Whether a path has a stroke or a fill that is neither transparent nor white."""
    seen = lambda colour, opacity: colour.isNotNull() & (F.coalesce(opacity, F.lit(1.0)) > 0.001) & ~is_white(colour, threshold)
    return seen(stroke, stroke_opacity) | seen(fill, fill_opacity)


def colour_name(colour: Column) -> Column:
    """Channels from 0 to 1 as #rrggbb; none for null."""
    hexes = F.transform(colour, lambda c: F.lower(F.lpad(F.hex(F.bround(c * 255).cast("long")), 2, "0")))
    return F.when(colour.isNull(), "none").otherwise(F.concat(F.lit("#"), F.array_join(hexes, "")))


def path_length(points: Column, closed: Column) -> Column:
    """Length of a polyline, with its closing edge if closed."""
    pairs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: G.distance(a, b))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)
    return F.when(F.size(points) < 2, 0.0).otherwise(total + F.when(closed, G.distance(F.element_at(points, -1), F.element_at(points, 1))).otherwise(0.0))


def straight_segments(op: Column, points: Column) -> Column:
    """One segment of a line, four of a rectangle or quad, none of a curve."""
    segment = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    ring = F.array(*[segment(F.get(points, F.lit(i)), F.get(points, F.lit((i + 1) % 4))) for i in range(4)])
    none = F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>")
    return F.when(op == "l", F.array(segment(F.get(points, F.lit(0)), F.get(points, F.lit(1))))).when(op.isin("re", "qu"), ring).otherwise(none)


def geometry_entities(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """One entity per visible path with known operations."""
    d = drawings.join(pages.select(*DOCUMENT_PAGE, "width", "height").withColumnsRenamed({"width": "page_width", "height": "page_height"}), DOCUMENT_PAGE)
    d = d.where(visible_paint(F.col("color"), F.col("fill"), F.col("stroke_opacity"), F.col("fill_opacity"), EXTRACTION_WHITE))
    w, h = F.col("page_width"), F.col("page_height")
    known = F.filter("items", lambda i: i["op"].isin("l", "c", "re", "qu") & (F.size(i["pts"]) > 0))
    d = d.withColumn("parts", F.transform(known, lambda i: F.struct(i["op"].alias("op"), F.transform(i["pts"], lambda p: G.unit_point(p, w, h)).alias("pts")))).where(F.size("parts") > 0)
    every = F.flatten(F.transform("parts", lambda i: i["pts"]))
    d = d.withColumn("every", every)
    mean = lambda axis: F.aggregate("every", F.lit(0.0), lambda s, p: s + p[axis]) / F.size("every")
    d = d.withColumns({"cx": mean("x"), "cy": mean("y"), "bbox": G.unit_box(F.coalesce("rect", G.box(F.lit(0.0), F.lit(0.0), w, h)), w, h)})
    six = lambda c: F.format_string("%.6f", c)
    relative = F.transform("parts", lambda i: F.concat(i["op"], F.lit(":"), F.array_join(F.transform(i["pts"], lambda p: F.concat(six(F.round(p["x"], 6) - F.col("cx")), F.lit(","), six(F.round(p["y"], 6) - F.col("cy")))), ";")))
    size = F.greatest(w, h, F.lit(1.0))
    style = digest(colour_name(F.col("color")), colour_name(F.col("fill")), F.round(F.coalesce(F.col("width"), F.lit(0.0)) / size, 6), F.coalesce("dashes", F.lit("")), F.round(F.coalesce("stroke_opacity", F.lit(1.0)), 4), F.round(F.coalesce("fill_opacity", F.lit(1.0)), 4), F.coalesce("close_path", F.lit(False)))
    ops = F.transform("parts", lambda i: i["op"])
    d = d.withColumns({"style_signature": style, "shape_signature": digest(F.array_join(relative, "|")), "ops": ops})
    d = d.withColumn("content_signature", digest(F.lit("geometry"), F.col("shape_signature"), F.col("style_signature")))
    lengths = F.aggregate(F.transform("parts", lambda i: path_length(i["pts"], i["op"].isin("re", "qu"))), F.lit(0.0), lambda s, x: s + x)
    seed = digest(F.col("page_index"), F.col("source_index"), F.col("content_signature"), *(F.round(F.col(f"bbox.{c}"), 6) for c in ("x0", "y0", "x1", "y1")), length=16)
    return d.select(
        *DOCUMENT_PAGE,
        F.concat(F.lit("p"), F.col("page_index") + 1, F.lit("-g-"), seed).alias("id"),
        F.lit("geometry").alias("kind"),
        "bbox",
        G.centre(F.col("bbox")).alias("anchor"),
        "content_signature",
        "shape_signature",
        "style_signature",
        F.map_from_entries(F.transform(F.array_sort(F.array_distinct("ops")), lambda o: F.struct(o, F.size(F.filter("ops", lambda x: x == o))))).alias("op_histogram"),
        F.size("ops").alias("primitive_count"),
        F.round(lengths, 6).alias("path_length"),
        F.flatten(F.transform("parts", lambda i: straight_segments(i["op"], i["pts"]))).alias("segments"),
    )


def text_entities(spans: DataFrame, pages: DataFrame, ascii_only: bool = False) -> DataFrame:
    """One entity per visible span with text."""
    s = spans.join(pages.select(*DOCUMENT_PAGE, "width", "height"), DOCUMENT_PAGE).withColumnRenamed("text", "raw").withColumn("text", normalize_text(F.col("raw"), ascii_only))
    s = s.where((F.col("text") != "") & (F.col("alpha").isNull() | (F.col("alpha") > 0)))
    w, h = F.col("width"), F.col("height")
    s = s.withColumn("bbox", G.unit_box(F.col("bbox"), w, h))
    anchor = F.when(F.col("origin").isNotNull(), G.unit_point(F.col("origin"), w, h)).otherwise(G.point(F.col("bbox.x0"), (F.col("bbox.y0") + F.col("bbox.y1")) / 2))
    size = F.round(F.coalesce("size", F.lit(0.0)) / F.greatest(w, h, F.lit(1.0)), 6)
    colour = F.when(F.col("color").isNull(), "none").otherwise(F.concat(F.lit("#"), F.lower(F.lpad(F.hex("color"), 6, "0"))))
    order = Window.partitionBy(*DOCUMENT_PAGE).orderBy("block_index", "line_index", "span_index")
    s = s.withColumns({"anchor": anchor, "font_size": size, "font_name": F.coalesce("font", F.lit("")), "source_index": F.row_number().over(order) - 1})
    s = s.withColumn("style_signature", digest(F.col("font_name"), F.coalesce("flags", F.lit(0)), colour, F.col("font_size")))
    s = s.withColumn("content_signature", digest(F.lit("text"), F.col("text"), F.col("style_signature")))
    seed = digest(F.col("page_index"), F.col("source_index"), F.col("content_signature"), F.round("anchor.x", 6), F.round("anchor.y", 6), length=16)
    return s.select(
        *DOCUMENT_PAGE,
        F.concat(F.lit("p"), F.col("page_index") + 1, F.lit("-t-"), seed).alias("id"),
        F.lit("text").alias("kind"),
        "bbox",
        "anchor",
        "content_signature",
        F.lit("text-span").alias("shape_signature"),
        "style_signature",
        "text",
        casefold(F.col("text"), ascii_only).alias("text_normalized"),
        "font_name",
        "font_size",
        "block_index",
        "line_index",
        "span_index",
        F.coalesce("dir", G.point(F.lit(1.0), F.lit(0.0))).alias("direction"),
    )


def complete(entities: DataFrame) -> DataFrame:
    """All entity columns, with defaults for those that are missing or null."""
    defaults = {
        "text": F.lit(""), "text_normalized": F.lit(""), "font_name": F.lit(""), "font_size": F.lit(0.0), "op_histogram": F.create_map().cast("map<string,int>"), "primitive_count": F.lit(0), "path_length": F.lit(0.0),
        "block_index": F.lit(-1), "line_index": F.lit(-1), "span_index": F.lit(-1), "direction": G.point(F.lit(1.0), F.lit(0.0)), "segments": F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>"),
        "callout_category": F.lit(None).cast("string"), "callout_structure": F.lit(""), "member_ids": F.array().cast("array<string>"), "attachments": F.array().cast(f"array<{POINT}>"),
    }
    have = set(entities.columns)
    out = entities.withColumns({c: F.coalesce(F.col(c), d) if c in have and c != "callout_category" else d for c, d in defaults.items() if not (c in have and c == "callout_category")})
    return out.to(out.sparkSession.createDataFrame([], ENTITY).schema)


def number_duplicates(entities: DataFrame) -> DataFrame:
    """Equal ids of a page get the suffixes -1, -2, ... in the order of kind, box and id."""
    n = F.row_number().over(Window.partitionBy(*DOCUMENT_PAGE, "id").orderBy("kind", "bbox"))
    return entities.withColumn("__n", n).withColumn("id", F.when(F.col("__n") > 1, F.concat_ws("-", "id", (F.col("__n") - 1).cast("string"))).otherwise(F.col("id"))).drop("__n")


def extract(spans: DataFrame, drawings: DataFrame, pages: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Entities of all pages: texts and geometry, with all columns and distinct ids."""
    return number_duplicates(complete(text_entities(spans, pages, ascii_only)).unionByName(complete(geometry_entities(drawings, pages))))
