"""Queries over rows made from the driver's tables for operators that those tables do not feed: drawings, callout parts, changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .operators import callouts
from .operators.callouts import Item
from .operators.changes import change_id, label, modification_kinds, page_view, pixel_boxes, selected_change, visible_regions
from .operators.extraction import geometry_entities
from .operators.matching import attribute_score, structural_score
from .operators.validation import page_capabilities, validate
from .settings import DEFAULTS
from .sources.tables import SCHEMAS

EM = 0.012  # height of made texts


def _rows(spark: SparkSession, sf_dir: str, per_page: int, **columns: Column) -> DataFrame:
    """Orders dealt to pages of so many, in place i of their page, with further columns of k, page_index and i."""
    k = F.col("o_orderkey").cast("long")
    base = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), F.floor(k / per_page).cast("int").alias("page_index"), (k % per_page).cast("int").alias("i"))
    for name, value in columns.items():
        base = base.withColumn(name, value)
    return base


def _by_page(rows: DataFrame, make: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows (page_index and more) that a kernel of the engine gives for each page's rows."""

    def kernel(pdf):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        page = int(pdf["page_index"].iloc[0])
        return pd.DataFrame([(page, *x) for x in make(pdf.sort_values("k").to_dict("records"))], columns=["page_index", *names])

    return rows.groupBy("page_index").applyInPandas(kernel, f"page_index int, {schema}")


def _text(r: dict, **more) -> Item:
    """A made row as a text item."""
    return Item(str(r["k"]), r["page_index"], "text", (r["x"], r["y"], r["x"] + r["w"], r["y"] + EM), (r["x"], r["y"] + EM), text=r["text"], size=0.01, **more)


def _path(name: str, r: dict, segments: Iterable = (), ops: tuple = (("l", 1),), box: tuple | None = None, primitives: int = 1) -> Item:
    segments = tuple(segments)
    xs, ys = ([p[a] for s in segments for p in s] for a in (0, 1))
    box = box or (min(xs), min(ys), max(xs), max(ys))
    return Item(name, r["page_index"], "geometry", box, (box[0], box[1]), ops=ops, primitives=primitives, segments=segments)


def _placed() -> dict[str, Column]:
    """Texts in rows of five."""
    return {"x": (F.col("i") % 5) * 0.06 + (F.col("k") % 3) * 0.004, "y": F.floor(F.col("i") / 5) * 0.03 + (F.col("k") % 7) * 0.002, "w": F.lit(0.03)}


def _tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, 40, **_placed(), text=F.concat(F.when(F.col("k") % 11 == 0, "±").when(F.col("k") * 7 % 13 < 6, "+").otherwise("-"), F.lit("0."), (F.col("k") % 9 + 1).cast("string")))


def tolerance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper and lower tolerances that clearly belong together, and single ones."""
    return _by_page(_tolerances(spark, sf_dir), lambda rows: [(int(u[0].id), int(u[-1].id) if len(u) > 1 else 0) for u in callouts.tolerance_units([_text(r) for r in rows], DEFAULTS)], "first long, second long").select("page_index", F.least("first", F.when(F.col("second") > 0, F.col("second"))).alias("first"), F.when(F.col("second") > 0, F.greatest("first", "second")).otherwise(0).alias("second"))


def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far single tolerances stand after the numbers of their page."""

    def scores(rows):
        roots, units = [r for r in rows if r["k"] % 4 == 0], [r for r in rows if r["k"] % 4]
        costs = callouts.unit_costs([_text(r) for r in roots], [(_text(r),) for r in units], DEFAULTS)
        return [(r["k"], u["k"], round(float(costs[i, j]), 6)) for i, r in enumerate(roots) for j, u in enumerate(units) if costs[i, j] < float("inf")]

    return _by_page(_tolerances(spark, sf_dir), scores, "root long, unit long, cost double")


def limit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that can be the two rows of a limit dimension."""
    rows = _rows(spark, sf_dir, 40, **_placed() | {"w": 0.02 + (F.col("k") % 4) * 0.003}, text=F.concat((F.col("k") % 50).cast("string"), F.when(F.col("k") % 3 == 0, ".5").otherwise(".25")))

    def pairs(rows):
        costs = callouts.limit_costs([_text(r) for r in rows], DEFAULTS)
        return [(rows[i]["k"], rows[j]["k"], round(float(costs[i, j]), 6)) for i in range(len(rows)) for j in range(i + 1, len(rows)) if costs[i, j] < float("inf")]

    return _by_page(rows, pairs, "first long, second long, cost double")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty frames to a page: two to four cells; the lower rail of each seventh frame ends half way."""
    return _rows(spark, sf_dir, 20, x=0.05 + (F.col("i") % 4) * 0.22, y=0.05 + F.floor(F.col("i") / 4) * 0.15, h=0.02 + (F.col("k") % 3) * 0.005, m=(2 + F.col("k") % 3).cast("int"), low=F.when(F.col("k") % 7 == 0, F.floor((2 + F.col("k") % 3) / 2)).otherwise(2 + F.col("k") % 3).cast("int"))


def _frame_paths(rows: list[dict]) -> list[Item]:
    out = []
    for r in rows:
        x, y, end, bottom = r["x"], r["y"], r["x"] + 0.04 * r["m"], r["y"] + r["h"]
        middle = x + 0.04
        out += [_path(f"{r['k']}-a", r, [((x, y), (middle, y)), ((x, bottom), (x + 0.04 * r["low"], bottom))]), _path(f"{r['k']}-b", r, [((end, y), (middle, y))])]
        out += [_path(f"{r['k']}-{j}", r, [((x + 0.04 * j, y), (x + 0.04 * j, bottom))]) for j in range(r["m"] + 1)]
    return out


def frame_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of frames that several paths draw together."""
    return _by_page(_frames(spark, sf_dir), lambda rows: [tuple(round(v, 6) for v in c.box) for c in callouts.cells_of_rails(_frame_paths(rows), DEFAULTS)], "x0 double, y0 double, x1 double, y1 double")


def unified_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of frames, and drawn rectangles that such cells do not cover from side to side."""

    def cells(rows):
        boxes = [_path(f"{r['k']}-r", r, ops=(("re", 1),), box=(r["x"], r["y"], r["x"] + 0.04 * r["m"], r["y"] + r["h"])) for r in rows if r["k"] % 3]
        return [tuple(round(v, 6) for v in c.box) for c in callouts.frame_cells(_frame_paths(rows) + boxes, DEFAULTS)]

    return _by_page(_frames(spark, sf_dir), cells, "x0 double, y0 double, x1 double, y1 double")


def glyph_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact outlines of lines without text in them."""
    rows = _rows(spark, sf_dir, 50, x=(F.col("i") % 10) * 0.09, y=F.floor(F.col("i") / 10) * 0.09, size=0.01 + (F.col("k") % 6) * 0.006, n=(F.col("k") % 20).cast("int"))

    def marks(rows):
        paths = [_path(str(r["k"]), r, ops=(("l", r["n"]),) if r["k"] % 5 else (("c", 1), ("l", r["n"])), box=(r["x"], r["y"], r["x"] + r["size"], r["y"] + r["size"]), primitives=r["n"]) for r in rows]
        texts = [_text(r | {"text": "A" if r["k"] % 2 else " ", "x": r["x"] + r["size"] / 2 - 0.001, "y": r["y"] + r["size"] / 2 - EM / 2, "w": 0.002}) for r in rows if r["k"] % 3 == 0]
        return [(int(e.id),) for e in callouts.glyphs(paths, texts, frozenset(), DEFAULTS)]

    return _by_page(rows, marks, "k long")


def segment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected groups of segments: five chains to a page, some with a gap."""
    rows = _rows(spark, sf_dir, 30, j=F.floor(F.col("i") / 5).cast("int"), g=(F.col("i") % 5).cast("int"))

    def groups(rows):
        segments = tuple((((r["j"] * 0.1 + (0.01 if r["k"] % 11 == 0 else 0.0)), r["g"] * 0.1), ((r["j"] + 1) * 0.1, r["g"] * 0.1)) for r in rows)
        return [(rows[own[0]]["k"], len(own)) for own in callouts.connected_segments(segments, DEFAULTS.connect)]

    return _by_page(rows, groups, "first long, members long")


def drawn_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths of four or five segments are rectangles."""
    rows = _rows(spark, sf_dir, 50, x=(F.col("i") % 10) * 0.09, y=F.floor(F.col("i") / 10) * 0.09, w=0.01 + (F.col("k") % 6) * 0.006)

    def rated(rows):
        for r in rows:
            a, b, c, d = (r["x"], r["y"]), (r["x"] + r["w"], r["y"]), (r["x"] + r["w"], r["y"] + 0.02), (r["x"], r["y"] + 0.02)
            ring = [(a, b), (b, c), (c, d), (d, a)]
            segments = [ring[:3], [*ring, (a, c)], ring, [*ring[:3], (d, (a[0], a[1] + 0.01))], ring][r["k"] % 5]
            yield r["k"], callouts.is_rectangle(_path(str(r["k"]), r, segments, ops=(("l", len(segments)),)))

    return _by_page(rows, rated, "k long, rectangle boolean")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a callout joined line by line."""
    rows = _rows(spark, sf_dir, 6, x=(F.col("k") * 5 % 7) * 0.05, y=F.floor(F.col("i") / 3) * 0.05 + (F.col("k") % 3) * 0.001, w=F.lit(0.03), text=F.concat(F.lit("t"), F.col("k").cast("string")))
    return _by_page(rows, lambda rows: [(callouts.joined_text([_text(r) for r in rows]),)], "text string")


def token_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals and sign of tolerance texts."""
    k = F.col("k")
    text = F.concat(F.element_at(F.array(*map(F.lit, ["+", "-", "±", "", "−"])), (k % 5 + 1).cast("int")), (k % 9).cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.when(k % 2 == 0, ",").otherwise("."), (k % 1000).cast("string"))), F.when(k % 8 == 0, " / 2").otherwise(""))
    decimals, polarity = F.pandas_udf(lambda t: t.map(callouts.decimals), "int"), F.pandas_udf(lambda t: t.map(callouts.polarity), "string")
    return _rows(spark, sf_dir, 100, text=text).select("k", decimals("text").alias("decimals"), polarity("text").alias("polarity"))


# Texts with their structure alone, and attached to a leader.
PROFILES = [("4X Ø10.5 THRU", "diameter", "diameter"), ("R5", "radius", "radius"), ("SR5", "spherical-radius", "spherical-radius"), ("45° ±1", "angular", "angular"), ("12.5", "", "linear"), ("12.5 13.0", "", ""), ("DIA. 8", "diameter", "diameter"), ("12 ±0.1", "linear", "linear"), ("SCALE 1", "", ""), ("A: 5", "", ""), ("POSITION 0.1", "", ""), ("3 TYP", "linear", "linear"), ("Ø5 Ø6", "", ""), ("30 DEG", "", "angular"), ("words", "", "")]


def dimension_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure of texts that read as one dimension."""
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in PROFILES]), (F.col("k") % len(PROFILES) + 1).cast("int"))

    def kernel(batches):
        for pdf in batches:
            yield pdf.assign(structure=[callouts.dimension_structure(t, a) or "" for t, a in zip(pdf["text"], pdf["attached"], strict=True)])[["k", "structure"]]

    return _rows(spark, sf_dir, 100, text=text, attached=F.col("k") % 2 == 0).mapInPandas(kernel, "k long, structure string")


def _raw_drawings(rows: DataFrame) -> DataFrame:
    """Paths of one or two operations in points on pages of 600 x 800, some white or transparent."""
    k, at = F.col("k"), lambda dx, dy: G.point(F.col("x") + dx, F.col("y") + dy)
    s = F.col("s")
    zero = F.lit(0.0)
    corners = F.array(at(zero, zero), at(s, zero), at(s, s), at(zero, s))
    first = F.when(k % 4 == 0, F.struct(F.lit("l").alias("op"), F.array(at(zero, zero), at(s, zero)).alias("pts"))).otherwise(F.struct(F.element_at(F.array(*map(F.lit, ["re", "qu", "c"])), (k % 4).cast("int")).alias("op"), corners.alias("pts")))
    more = F.when(k % 2 == 0, F.array(F.struct(F.lit("l").alias("op"), F.array(at(zero, zero), at(s, s)).alias("pts")))).otherwise(F.array().cast("array<struct<op:string,pts:array<struct<x:double,y:double>>>>"))
    colour = F.when(k % 7 == 0, F.array(F.lit(1.0), F.lit(1.0), F.lit(0.999))).otherwise(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))
    none = F.lit(None)
    return rows.select(
        F.lit("p").alias("pair_id"), F.lit("old").alias("side"), "page_index", k.cast("int").alias("source_index"), F.concat(F.array(first), more).alias("items"), G.box(F.col("x"), F.col("y"), F.col("x") + s, F.col("y") + s).alias("rect"), colour.alias("color"),
        F.when(k % 21 == 0, F.array(F.lit(0.2))).cast("array<double>").alias("fill"), F.lit(1.0).alias("width"), none.cast("string").alias("dashes"), F.when(k % 11 == 0, 0.0).cast("double").alias("stroke_opacity"), none.cast("double").alias("fill_opacity"), F.lit(False).alias("close_path"),
    )


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, sf_dir, 100, x=(F.col("k") * 7919 % 500).cast("double"), y=(F.col("k") * 104729 % 700).cast("double"), s=(F.col("k") % 30 + 10).cast("double"))
    pages = rows.select(F.lit("p").alias("pair_id"), F.lit("old").alias("side"), "page_index").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    return _raw_drawings(rows), pages


def drawn_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible paths as geometry entities: box, operations, straight segments, length."""
    drawings, pages = _drawn(spark, sf_dir)
    e = geometry_entities(drawings, pages)
    ops = F.array_join(F.transform(F.array_sort(F.map_entries("op_histogram")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return e.select("page_index", *(F.round(f"bbox.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")), ops.alias("ops"), "primitive_count", F.size("segments").alias("segments"), F.round("path_length", 5).alias("path_length"), F.round("anchor.x", 6).alias("cx"))


def drawn_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of visible paths, and whether a page has only pictures, with pages made of drawings, images or neither."""
    drawings, pages = _drawn(spark, sf_dir)
    some = drawings.where("page_index % 3 <> 0")
    images = pages.where("page_index % 2 = 0").select("pair_id", "side", "page_index", F.lit(0).alias("image_index"), G.box(F.lit(0.0), F.lit(0.0), F.lit(600.0), F.when(F.col("page_index") % 4 == 0, 800.0).otherwise(200.0)).alias("bbox"))
    spans = spark.createDataFrame([], SCHEMAS["raw_spans"])
    c = page_capabilities(pages, spans, some, images)
    return c.select("page_index", "drawing_count", "image_count", F.round("image_coverage_fraction", 5).alias("image_cover"), "effectively_scanned", "has_vector_or_text", "has_only_raster_content")


def raster_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of five pages, made from suppliers, that hold scanned pages."""
    k = F.col("s_suppkey")
    base = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.floor(k / 5).cast("string").alias("pair_id"), F.lit("old").alias("side"), (k % 5).cast("int").alias("page_index"), k.alias("k"))
    pages = base.withColumns({"width": F.lit(100.0), "height": F.lit(100.0)})
    images = base.where("k % 3 = 0").select("pair_id", "side", "page_index", F.lit(0).alias("image_index"), G.box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.when(F.col("k") % 2 == 0, 50.0).otherwise(90.0)).alias("bbox"))
    null = F.lit(None)
    spans = base.where("k % 2 = 0").select("pair_id", "side", "page_index", F.lit(0).alias("block_index"), F.lit(0).alias("line_index"), F.lit(0).alias("span_index"), F.lit("text").alias("text"), G.box(F.lit(1.0), F.lit(1.0), F.lit(9.0), F.lit(3.0)).alias("bbox"), null.cast("struct<x:double,y:double>").alias("origin"), null.cast("struct<x:double,y:double>").alias("dir"), F.lit("f").alias("font"), F.lit(2.0).alias("size"), F.lit(0).alias("flags"), F.lit(0).alias("color"), null.cast("int").alias("alpha"))
    caps = page_capabilities(pages, spans, spark.createDataFrame([], SCHEMAS["raw_drawings"]), images)
    documents = base.groupBy("pair_id", "side").agg(F.count("*").cast("int").alias("page_count")).withColumns({"file_name": F.concat(F.lit("d"), "pair_id", F.lit(".pdf")), "size_bytes": F.lit(1000).cast("long"), "header": F.lit("%PDF-1.4"), "encrypted": F.lit(False)})
    return validate(documents, caps).select(F.col("pair_id").alias("document"), F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce("error", F.lit("")).alias("error"))


def moved_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and boxes under similarity transforms, and their distances from where they were."""
    k = F.col("k")
    t = F.struct((0.9 + (k % 5) * 0.05).alias("scale"), ((k % 7) * 0.1 - 0.3).alias("rotation"), ((k % 3) * 0.01).alias("tx"), ((k % 4) * -0.02).alias("ty"))
    rows = _rows(spark, sf_dir, 100, x=(k * 7919 % 1009) / 1009.0, y=(k * 104729 % 997) / 997.0, t=t)
    p, m = G.point(F.col("x"), F.col("y")), G.moved(G.point(F.col("x"), F.col("y")), F.col("t"))
    b = G.moved_box(G.box(F.col("x"), F.col("y"), F.col("x") + 0.1, F.col("y") + 0.05), F.col("t"))
    return rows.select("k", F.round(m["x"], 6).alias("x"), F.round(m["y"], 6).alias("y"), F.round(G.distance(p, m), 6).alias("d"), F.round(G.area(b), 8).alias("area"))


def _edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new structs of made entities, with differences in text, place, font, style and shape."""
    k = F.col("k")
    kind = F.when(k % 3 == 0, "geometry").otherwise("text")

    def entity(x: Column, text: Column, font: Column, style: Column, shape: Column) -> Column:
        return F.struct(
            F.concat(F.lit("e"), k.cast("string")).alias("id"), kind.alias("kind"), G.box(x, F.lit(0.2), x + 0.02, F.lit(0.2) + F.when(shape == "s", 0.01).otherwise(0.02)).alias("bbox"), G.point(x, F.lit(0.2)).alias("anchor"), text.alias("text"), F.lower(text).alias("text_normalized"), F.lit("f").alias("font_name"), font.alias("font_size"),
            style.alias("style_signature"), shape.alias("shape_signature"), (k % 4 + 1).cast("int").alias("primitive_count"), (k % 5 + 1).cast("double").alias("path_length"), F.create_map(F.lit("l"), (k % 4 + 1).cast("int")).alias("op_histogram"), F.lit(None).cast("string").alias("callout_category"), F.lit("").alias("callout_structure"),
            F.array().cast("array<struct<x:double,y:double>>").alias("attachments"), F.when(k % 4 == 0, "DIMENSION").otherwise("NOTE").alias("category"), F.lit(False).alias("glyph"), F.array((k % 3) / 3.0, 1 - (k % 3) / 3.0, (k % 5) * 0.01, F.lit(0.1)).alias("context"),
        )

    x = (k % 50) * 0.01
    old = entity(x, F.concat(F.lit("T"), (k % 20).cast("string")), F.lit(0.01), F.lit("a"), F.lit("s"))
    new = entity(x + (k % 6) * 0.003, F.concat(F.lit("T"), F.when(k % 5 == 0, k % 7).otherwise(k % 20).cast("string")), F.when(k % 7 == 0, 0.02).otherwise(0.01), F.when(k % 9 == 0, "b").otherwise("a"), F.when(k % 4 == 0, "r").otherwise("s"))
    return _rows(spark, sf_dir, 100, o=old, n=new).withColumn("d", F.abs(F.col("n.anchor.x") - F.col("o.anchor.x")))


def _same() -> Column:
    return F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("rotation"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))


def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between matched entities, their labels and change ids."""
    o, n = F.col("o"), F.col("n")
    return _edit(spark, sf_dir).select("k", F.array_join(modification_kinds(o, n, F.col("d"), DEFAULTS), ",").alias("kinds"), label(n).alias("label"), change_id(F.col("page_index"), F.lit("modified"), o["id"], F.when(F.col("k") % 2 == 0, n["id"])).alias("id"))


def edit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute and structural scores of texts and geometry whose text similarity is given: 1 if equal, else 0.5."""
    o, n, d = F.col("o"), F.col("n"), F.col("d")
    alike = F.when(o["text"] == n["text"], 1.0).otherwise(0.5)
    null = F.lit(None).cast("double")
    return _edit(spark, sf_dir).select("k", F.round(attribute_score(o, n, _same(), d, alike, null), 9).alias("attribute"), F.round(structural_score(o, n, _same(), d, alike, null), 9).alias("structural"))


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _rows(spark, sf_dir, 100, pair_id=F.lit("p"), id=F.concat(F.lit("chg-"), k.cast("string")), change_type=F.element_at(F.array(*map(F.lit, ["added", "removed", "moved", "modified"])), (k % 4 + 1).cast("int")), bbox=G.box((k % 9) / 10.0, (k % 7) / 10.0, (k % 9) / 10.0 + 0.1, (k % 7) / 10.0 + 0.05))


def shown_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a page whose types are switched on, in pixels of a zoomed image."""
    return pixel_boxes(visible_regions(page_view(_view(spark, sf_dir), 3), {"removed": False, "moved": True}), 1000.0, 800.0, 1.5, 10.0, 20.0).select("id", "change_type", *(F.round(f"pixels.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


def change_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change by its id, once among the filtered ones and once hidden by the filter."""
    every = _view(spark, sf_dir)
    kept = visible_regions(every, {"added": False})
    return selected_change(every, kept, "chg-321").unionByName(selected_change(every, kept, "chg-324")).select("page_index", "id", "change_type", "filters_cleared")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (tolerance_pairs, unit_scores, limit_pairs, frame_cells, unified_cells, glyph_marks, segment_groups, drawn_rectangles, reading_order, token_traits, dimension_profiles, drawn_entities, drawn_inventory, raster_gate, moved_points, field_changes, edit_scores, shown_regions, change_lookup)}


def _made(per_page: int, more: str = "") -> str:
    return f"select o_orderkey as k, cast(floor(o_orderkey / {per_page}) as int) as page_index, o_orderkey % {per_page} as i{', ' + more if more else ''} from orders"


_AT = "(o_orderkey % 40 % 5) * 0.06e0 + (o_orderkey % 3) * 0.004e0 as x, floor(o_orderkey % 40 / 5) * 0.03e0 + (o_orderkey % 7) * 0.002e0 as y"
_TOLERANCE = f"t as ({_made(40, _AT + ', 0.03e0 as w, case when o_orderkey % 11 = 0 then 0 when o_orderkey * 7 % 13 < 6 then 1 else -1 end as sign')})"
_FRAME = f"f as ({_made(20, '0.05e0 + (o_orderkey % 20 % 4) * 0.22e0 as x, 0.05e0 + floor(o_orderkey % 20 / 4) * 0.15e0 as y, 0.02e0 + (o_orderkey % 3) * 0.005e0 as h, 2 + o_orderkey % 3 as m, case when o_orderkey % 7 = 0 then floor((2 + o_orderkey % 3) / 2) else 2 + o_orderkey % 3 end as low')}), cells as (select page_index, round(x + 0.04e0 * j, 6) as x0, round(y, 6) as y0, round(x + 0.04e0 * (j + 1), 6) as x1, round(y + h, 6) as y1 from (select *, unnest(range(0, cast(low as int))) as j from f))"
_EDIT = """e as (select o_orderkey as k, cast(floor(o_orderkey / 100) as int) as page_index, case when o_orderkey % 3 = 0 then 'geometry' else 'text' end as kind, (o_orderkey % 50) * 0.01e0 as x, (o_orderkey % 50) * 0.01e0 + (o_orderkey % 6) * 0.003e0 as nx,
  'T' || (o_orderkey % 20) as ot, 'T' || (case when o_orderkey % 5 = 0 then o_orderkey % 7 else o_orderkey % 20 end) as nt, o_orderkey % 7 = 0 as font, o_orderkey % 9 = 0 as style, o_orderkey % 4 = 0 as shape, o_orderkey % 4 + 1 as n, 'e' || o_orderkey as id from orders),
g as (select *, abs(nx - x) as d, greatest(0e0, least(x + 0.02e0, nx + 0.02e0) - greatest(x, nx)) * 0.01e0 as common, 0.02e0 * 0.01e0 as oa, 0.02e0 * (case when shape then 0.02e0 else 0.01e0 end) as na from e)"""

ORACLE_SQL: dict[str, str] = {
    "tolerance_pairs": f"""with {_TOLERANCE}, p as (select a.page_index, a.k as a, b.k as b, abs(a.y - b.y) / {EM}e0 as drp, abs(a.x - b.x) / {EM}e0 as shift, greatest(0e0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)) / {EM}e0 as across, greatest(0e0, greatest(a.y, b.y) - least(a.y + {EM}e0, b.y + {EM}e0)) / {EM}e0 as down
  from t a join t b on a.page_index = b.page_index and a.sign * b.sign < 0),
c as (select page_index, a, b, least(case when drp <= 0.55e0 and across <= 2.75e0 then drp + across end, case when shift <= 0.75e0 and down <= 2.25e0 then shift + down end) as cost from p),
r as (select *, row_number() over w as r, lead(cost) over w as nx from c where cost is not null window w as (partition by a order by cost)),
best as (select page_index, a, b from r where r = 1 and (nx is null or nx - cost > 0.2e0)),
pair as (select x.page_index, x.a, x.b from best x join best y on x.a = y.b and x.b = y.a where x.a < x.b)
select page_index, a as first, b as second from pair union all select page_index, k, 0 from t where k not in (select a from pair) and k not in (select b from pair)""",
    "unit_scores": f"""with {_TOLERANCE} select * from (select r.page_index, r.k as root, u.k as unit, round(sqrt(((u.x - (r.x + r.w)) / {EM}e0) ** 2 + (((u.y + (u.y + {EM}e0)) / 2 - (r.y + (r.y + {EM}e0)) / 2) / {EM}e0) ** 2), 6) as cost from t r join t u on r.page_index = u.page_index and r.k % 4 = 0 and u.k % 4 <> 0
  where u.x >= r.x - 0.5e0 * {EM}e0 and u.x - (r.x + r.w) <= 2.75e0 * {EM}e0 and greatest(0e0, greatest(r.y, u.y) - least(r.y + {EM}e0, u.y + {EM}e0)) <= 2.25e0 * {EM}e0)""",
    "limit_pairs": f"""with t as ({_made(40, _AT + ', 0.02e0 + (o_orderkey % 4) * 0.003e0 as w')}), p as (select a.page_index, a.k as first, b.k as second, abs(a.x - b.x) as shift, abs((a.y + {EM}e0) - (b.y + {EM}e0)) as drp, least(a.x + a.w - a.x, b.x + b.w - b.x) / greatest(a.x + a.w - a.x, b.x + b.w - b.x) as wide from t a join t b on a.page_index = b.page_index and a.k < b.k and (a.k % 3 = 0) = (b.k % 3 = 0))
select page_index, first, second, round(shift / {EM}e0 + (1 - wide), 6) as cost from p where wide >= 0.75e0 and shift <= 0.75e0 * {EM}e0 and drp > 0.55e0 * {EM}e0 and drp <= 2.25e0 * {EM}e0""",
    "frame_cells": f"with {_FRAME} select * from cells",
    "unified_cells": f"with {_FRAME} select * from cells union all select page_index, round(x, 6), round(y, 6), round(x + 0.04e0 * m, 6), round(y + h, 6) from f where k % 3 <> 0 and low < m",
    "glyph_marks": f"with t as ({_made(50)}) select page_index, k from t where k % 20 >= 12 and k % 5 <> 0 and 0.01e0 + (k % 6) * 0.006e0 <= 0.035e0 and not (k % 3 = 0 and k % 2 = 1)",
    "segment_groups": f"with t as ({_made(30)}), s as (select page_index, k, i % 5 as g, sum(case when k % 11 = 0 then 1 else 0 end) over (partition by page_index, i % 5 order by k) as island from t) select page_index, min(k) as first, count(*) as members from s group by page_index, g, island",
    "drawn_rectangles": f"with t as ({_made(50)}) select page_index, k, k % 5 >= 2 as rectangle from t",
    "reading_order": f"with t as ({_made(6)}), l as (select page_index, floor(i / 3) as line, string_agg('t' || k, ' ' order by k * 5 % 7, cast(k as varchar)) as text from t group by page_index, floor(i / 3)) select page_index, string_agg(text, ' / ' order by line) as text from l group by page_index",
    "token_traits": "select o_orderkey as k, case when o_orderkey % 3 = 0 then 0 else length(cast(o_orderkey % 1000 as varchar)) end as decimals, case when o_orderkey % 8 = 0 then '' when o_orderkey % 5 = 0 then '+' when o_orderkey % 5 in (1, 4) then '-' else '' end as polarity from orders",
    "dimension_profiles": f"with p as (select o_orderkey as k, {[a for _, a, _ in PROFILES]}[o_orderkey % {len(PROFILES)} + 1] as a, {[b for _, _, b in PROFILES]}[o_orderkey % {len(PROFILES)} + 1] as b from orders) select k, case when s = '' then '' else 'dimension:' || s end as structure from (select k, case when k % 2 = 0 then b else a end as s from p)",
    "drawn_entities": """with t as (select o_orderkey as k, cast(floor(o_orderkey / 100) as int) as page_index, (o_orderkey * 7919 % 500) * 1e0 as x, (o_orderkey * 104729 % 700) * 1e0 as y, (o_orderkey % 30 + 10) * 1e0 as s from orders where (o_orderkey % 11 <> 0 and o_orderkey % 7 <> 0) or o_orderkey % 21 = 0),
v as (select *, ['l', 're', 'qu', 'c'][k % 4 + 1] as op, k % 2 = 0 as two, x / 600 as x0, y / 800 as y0, (x + s) / 600 as x1, (y + s) / 800 as y1 from t),
m as (select *, x1 - x0 as w, y1 - y0 as h from v)
select page_index, round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1, case when two and op = 'l' then 'l:2' when two and op < 'l' then op || ':1,l:1' when two then 'l:1,' || op || ':1' else op || ':1' end as ops, case when two then 2 else 1 end as primitive_count,
  (case op when 'l' then 1 when 'c' then 0 else 4 end) + (case when two then 1 else 0 end) as segments, round(round((case op when 'l' then w when 'c' then w + h + w else 2 * w + 2 * h end) + (case when two then sqrt(w * w + h * h) else 0e0 end), 6), 5) as path_length, round((x0 + x1) / 2, 6) as cx from m""",
    "drawn_inventory": """with t as (select o_orderkey as k, cast(floor(o_orderkey / 100) as int) as page_index from orders), d as (select page_index, count(*) filter (where page_index % 3 <> 0 and ((k % 11 <> 0 and k % 7 <> 0) or k % 21 = 0)) as drawing_count from t group by page_index),
i as (select *, case when page_index % 2 = 0 then 1 else 0 end as image_count, case when page_index % 4 = 0 then 1e0 when page_index % 2 = 0 then 0.25e0 else 0e0 end as image_cover from d)
select page_index, drawing_count, image_count, image_cover, image_count > 0 and (drawing_count = 0 or image_cover >= 0.85e0 and drawing_count <= 5) as effectively_scanned, drawing_count > 0 as has_vector_or_text, image_count > 0 and drawing_count = 0 as has_only_raster_content from i""",
    "raster_gate": """with p as (select cast(cast(floor(s_suppkey / 5) as int) as varchar) as document, s_suppkey % 5 + 1 as page, s_suppkey % 3 = 0 and s_suppkey % 2 = 1 as scanned from supplier)
select document, case when bool_or(scanned) then 'raster' else '' end as error_code, case when bool_or(scanned) then '''d' || document || '.pdf'' contains effectively scanned page(s) ' || string_agg(cast(page as varchar), ', ' order by page) filter (where scanned) || '.' else '' end as error from p group by document""",
    "moved_points": """with t as (select o_orderkey as k, (o_orderkey * 7919 % 1009) / 1009e0 as x, (o_orderkey * 104729 % 997) / 997e0 as y, 0.9e0 + (o_orderkey % 5) * 0.05e0 as s, (o_orderkey % 7) * 0.1e0 - 0.3e0 as r, (o_orderkey % 3) * 0.01e0 as tx, (o_orderkey % 4) * -0.02e0 as ty from orders),
m as (select *, s * (cos(r) * x - sin(r) * y) + tx as mx, s * (sin(r) * x + cos(r) * y) + ty as my from t)
select k, round(mx, 6) as x, round(my, 6) as y, round(sqrt((x - mx) ** 2 + (y - my) ** 2), 6) as d, round(s * (abs(cos(r)) * 0.1e0 + abs(sin(r)) * 0.05e0) * s * (abs(sin(r)) * 0.1e0 + abs(cos(r)) * 0.05e0), 8) as area from m""",
    "field_changes": f"""with {_EDIT} select k, coalesce(list_aggregate(case when kind = 'text' then [case when d > 0.006e0 then 'position' end, case when ot <> nt then 'text' end, case when font then 'text-style' end, null, case when style and not font then 'style' end]
  else [case when d > 0.006e0 and not shape then 'position' end, case when shape then 'geometry' end, case when style then 'style' end] end, 'string_agg', ','), '') as kinds,
  case when kind = 'text' then nt else 'Vector geometry (' || n || case when n = 1 then ' primitive)' else ' primitives)' end end as label, 'chg-' || substr(sha256(page_index || '|modified|' || id || '|' || case when k % 2 = 0 then id else '' end), 1, 14) as id from g""",
    "edit_scores": f"""with {_EDIT}, s as (select *, case when ot = nt then 1e0 else 0.5e0 end as alike, case when style then 0e0 else 1e0 end as st, case when font then 0.5e0 else 1e0 end as ft, case when shape then 1e0 else 2e0 end as na_aspect, k % 4 = 0 as dim from g)
select k, round(case when d > 0.018e0 then 0e0 when kind = 'geometry' then 0.34e0 * greatest(0e0, 1 - d / 0.018e0) + 0.24e0 * (common / (oa + na - common)) + 0.20e0 + 0.12e0 * (na_aspect / 2) + 0.10e0 * st else 0.48e0 * greatest(0e0, 1 - d / 0.018e0) + 0.22e0 * alike + 0.13e0 + 0.09e0 * ft + 0.08e0 * st end, 9) as attribute,
  round(case when kind = 'geometry' then 0.25e0 + 0.16e0 * (na_aspect / 2) + 0.13e0 * (oa / na) + 0.15e0 + 0.08e0 * st + 0.12e0 + 0.11e0 * greatest(0e0, 1 - d / 0.16e0) when dim and ot <> nt and d > 0.018e0 then 0e0 else 0.36e0 * alike + 0.17e0 + 0.12e0 * ft + 0.18e0 + 0.17e0 * greatest(0e0, 1 - d / 0.16e0) end, 9) as structural from s""",
    "shown_regions": f"with t as ({_made(100)}) select 'chg-' || k as id, ['added', 'removed', 'moved', 'modified'][k % 4 + 1] as change_type, round((k % 9) / 10e0 * 1500 + 10, 4) as x0, round((k % 7) / 10e0 * 1200 + 20, 4) as y0, round(((k % 9) / 10e0 + 0.1e0) * 1500 + 10, 4) as x1, round(((k % 7) / 10e0 + 0.05e0) * 1200 + 20, 4) as y1 from t where page_index = 3 and k % 4 <> 1",
    "change_lookup": f"with t as ({_made(100)}) select page_index, 'chg-' || k as id, ['added', 'removed', 'moved', 'modified'][k % 4 + 1] as change_type, k % 4 = 0 as filters_cleared from t where k in (321, 324)",
}
