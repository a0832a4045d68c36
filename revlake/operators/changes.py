"""Changes from matches and leftovers, their interpretation, and roll-ups by page and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.classify import reason, relevant, with_category
from ..functions.text import casefold, digest, python_repr
from ..settings import CHANGE_TYPES, DEFAULTS, Settings
from .areas import union_area
from .matching import PAGE, Matches
from .spatial import radius_join

CHANGE = ["pair_id", "page_index", "id", "change_type", "category", "inspection_relevant", "relevance_reason", "bbox", "old_bbox", "label", "detail", "modification_kinds", "old_entity_id", "new_entity_id", "before_text", "after_text", "match_tier", "similarity_score", "old_member_entity_ids", "new_member_entity_ids"]
NONE = "No structured vector or text-layer differences were detected."


def change_id(page: Column, kind: Column, old_id: Column, new_id: Column) -> Column:
    return F.concat(F.lit("chg-"), digest(page, kind, F.coalesce(old_id, F.lit("")), F.coalesce(new_id, F.lit("")), length=14))


def label(e: Column) -> Column:
    n = e["primitive_count"]
    return F.when(e["kind"] == "text", e["text"]).otherwise(F.concat(F.lit("Vector geometry ("), n.cast("string"), F.when(n == 1, " primitive)").otherwise(" primitives)")))


def modification_kinds(o: Column, n: Column, d: Column, settings: Settings) -> Column:
    """What differs between matched entities, in reporting order."""
    far, shape = d > settings.moved_distance, o["shape_signature"] != n["shape_signature"]
    same_size = F.abs(G.area(o["bbox"]) - G.area(n["bbox"])) <= 0.02 * F.greatest(G.area(o["bbox"]), G.area(n["bbox"]), F.lit(1e-9))
    font = (o["font_size"] != n["font_size"]) | (o["font_name"] != n["font_name"])
    style = o["style_signature"] != n["style_signature"]
    text = F.array(F.when(far, "position"), F.when(o["text"] != n["text"], "text"), F.when(font, "text-style"), F.when(o["callout_category"].isNotNull() & shape, "callout-structure"), F.when(style & ~font, "style"))
    drawn = F.array(F.when(far & (~shape | same_size), "position"), F.when(shape, "geometry"), F.when(style, "style"))
    return F.array_compact(F.when(o["kind"] == "text", text).otherwise(drawn))


def derive(found: Matches, transforms: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Changes before interpretation: one per changed match and per leftover, with hint (callout category) and side of context."""
    fields = ["id", "kind", "bbox", "shape_signature", "style_signature", "text", "font_size", "font_name", "primitive_count", "callout_category", "member_ids"]
    identity = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("rotation"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    rest = found.rest
    old = rest.where("side = 'old'").select(*PAGE, F.col("id").alias("old_id"), F.struct(*fields).alias("o"))
    new = rest.where("side = 'new'").select(*PAGE, F.col("id").alias("new_id"), F.struct(*fields).alias("n"))
    t = transforms.select(*PAGE, F.col("transform").alias("t"))
    o, n = F.col("o"), F.col("n")
    text = lambda e: F.when(e["kind"] == "text", e["text"])
    none = F.array().cast("array<string>")

    both = found.matches.where("tier <> 'exact'").join(old, [*PAGE, "old_id"]).join(new, [*PAGE, "new_id"]).join(t, PAGE, "left").withColumn("t", F.coalesce("t", identity))
    both = both.withColumn("kinds", modification_kinds(o, n, F.col("d"), settings)).where(F.size("kinds") > 0)
    callout = o["callout_category"].isNotNull() | n["callout_category"].isNotNull()
    named = F.array_join("kinds", ", ")
    changed = both.select(
        *PAGE,
        F.when((F.size("kinds") == 1) & (F.col("kinds")[0] == "position"), "moved").otherwise("modified").alias("change_type"),
        n["kind"].alias("kind"), F.lit("new").alias("context_side"), F.coalesce(n["callout_category"], o["callout_category"]).alias("hint"), n["bbox"].alias("at"),
        F.when(callout, G.union_box(G.moved_box(o["bbox"], F.col("t")), n["bbox"])).otherwise(n["bbox"]).alias("bbox"), o["bbox"].alias("old_bbox"),
        label(n).alias("label"),
        F.when((o["kind"] == "text") | (n["kind"] == "text"), F.concat(python_repr(text(o)), F.lit(" -> "), python_repr(text(n)), F.lit(" ("), named, F.lit(")"))).otherwise(F.concat(F.lit("Vector entity changed: "), named, F.lit("."))).alias("detail"),
        F.col("kinds").alias("modification_kinds"), o["id"].alias("old_entity_id"), n["id"].alias("new_entity_id"), text(o).alias("before_text"), text(n).alias("after_text"),
        F.col("tier").alias("match_tier"), F.col("score").alias("similarity_score"), o["member_ids"].alias("old_member_entity_ids"), n["member_ids"].alias("new_member_entity_ids"),
    )

    def lone(side: str, rows: DataFrame) -> DataFrame:
        removed = side == "old"
        e = F.struct(*fields)
        rows = rows.select(*PAGE, e.alias("e")).join(t, PAGE, "left").withColumn("t", F.coalesce("t", identity))
        e, null = F.col("e"), F.lit(None).cast("string")
        return rows.select(
            *PAGE, F.lit("removed" if removed else "added").alias("change_type"), e["kind"].alias("kind"), F.lit(side).alias("context_side"), e["callout_category"].alias("hint"), e["bbox"].alias("at"),
            (G.moved_box(e["bbox"], F.col("t")) if removed else e["bbox"]).alias("bbox"), (e["bbox"] if removed else F.lit(None).cast(rows.schema["e"].dataType["bbox"].dataType)).alias("old_bbox"),
            label(e).alias("label"), F.concat(label(e), F.lit(" removed." if removed else " added.")).alias("detail"), none.alias("modification_kinds"),
            (e["id"] if removed else null).alias("old_entity_id"), (null if removed else e["id"]).alias("new_entity_id"),
            (text(e) if removed else null).alias("before_text"), (null if removed else text(e)).alias("after_text"), null.alias("match_tier"), F.lit(None).cast("double").alias("similarity_score"),
            (e["member_ids"] if removed else none).alias("old_member_entity_ids"), (none if removed else e["member_ids"]).alias("new_member_entity_ids"),
        )

    out = changed.unionByName(lone("old", found.unmatched_old)).unionByName(lone("new", found.unmatched_new))
    return out.withColumn("id", change_id(F.col("page_index"), F.col("change_type"), F.col("old_entity_id"), F.col("new_entity_id")))


def interpret(changes: DataFrame, entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds category, relevance and reason. entities: all entities of the pages, with the categories of their texts.

    A hint decides; a text is classified with its page as context; geometry takes the category of the nearest dimension or
    GD&T text within the annotation radius.
    """
    key = [*PAGE, "side"]
    combined = F.concat_ws(" -> ", F.when(F.col("before_text") != "", F.col("before_text")), F.when(F.col("after_text") != "", F.col("after_text")))
    rows = changes.withColumn("combined", combined)
    texts = entities.where("kind = 'text'").select(*key, "id", "text", "bbox", "category")
    asked = rows.where("hint is null and kind = 'text'").select(*PAGE, F.col("context_side").alias("side"), F.col("id").alias("item"), F.col("combined").alias("text"), F.col("at").alias("bbox"))
    by_text = with_category(asked, texts, key, settings).select(*PAGE, F.col("item").alias("id"), F.col("category").alias("own"))
    drawn = rows.where("hint is null and kind = 'geometry'").select(*PAGE, F.col("context_side").alias("side"), F.col("id").alias("item"), G.centre(F.col("at")).alias("p")).withColumns({"lx": F.col("p.x"), "ly": F.col("p.y")})
    notes = texts.where("category in ('DIMENSION', 'GD&T')").select(*key, F.col("id").alias("text_id"), "category", G.centre(F.col("bbox")).alias("q")).withColumns({"rx": F.col("q.x"), "ry": F.col("q.y")})
    near = radius_join(drawn, notes, key, settings.annotation_radius).groupBy(*PAGE, "item").agg(F.min_by("category", F.struct("d", "text_id")).alias("near")).withColumnRenamed("item", "id")
    out = rows.join(by_text, [*PAGE, "id"], "left").join(near, [*PAGE, "id"], "left")
    out = out.withColumn("category", F.coalesce("hint", F.when(F.col("kind") == "text", F.col("own")).otherwise(F.coalesce("near", F.lit("GEOMETRY")))))
    out = out.withColumn("inspection_relevant", relevant(F.col("category"), F.col("combined")))
    return out.withColumn("relevance_reason", reason(F.col("category"), F.col("inspection_relevant"))).select(*CHANGE)


def in_order(changes: DataFrame) -> DataFrame:
    return changes.orderBy("pair_id", "page_index", "bbox.y0", "bbox.x0", "change_type", "id")


def page_areas(changes: DataFrame) -> DataFrame:
    """Fractions of a page under change boxes: all, and those relevant to inspection."""
    every = union_area(changes, PAGE).select(*PAGE, F.round(F.least(F.lit(1.0), "area"), 8).alias("affected_area_fraction"))
    some = union_area(changes.where("inspection_relevant"), PAGE).select(*PAGE, F.round(F.least(F.lit(1.0), "area"), 8).alias("relevant_area_fraction"))
    return every.join(some, PAGE, "left").withColumn("relevant_area_fraction", F.coalesce("relevant_area_fraction", F.lit(0.0)))


def change_counts(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, change_type, changes): all four types, with zeros."""
    types = pairs.select("pair_id").distinct().withColumn("change_type", F.explode(F.array(*[F.lit(t) for t in CHANGE_TYPES])))
    return types.join(changes.groupBy("pair_id", "change_type").agg(F.count("*").alias("n")), ["pair_id", "change_type"], "left").select("pair_id", "change_type", F.coalesce("n", F.lit(0)).alias("changes"))


def summaries(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """(pair_id, changes, relevant, mean_affected_area_fraction, summary) per pair. pages: (pair_id, affected_area_fraction)."""
    total = changes.groupBy("pair_id").agg(F.count("*").alias("changes"), F.count_if("inspection_relevant").alias("relevant"), *(F.count_if(F.col("change_type") == t).alias(t) for t in CHANGE_TYPES))
    by = changes.where("inspection_relevant").groupBy("pair_id", "category").agg(F.count("*").alias("n")).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("category", "n"))).alias("by"))
    mean = pages.groupBy("pair_id").agg(F.avg("affected_area_fraction").alias("mean_affected_area_fraction"))
    out = mean.join(total, "pair_id", "left").join(by, "pair_id", "left")
    types = F.concat_ws(", ", *[F.when(F.col(t) > 0, F.concat_ws(" ", F.col(t).cast("string"), F.lit(t))) for t in CHANGE_TYPES])
    categories = F.array_join(F.transform("by", lambda x: F.concat_ws(" ", x["n"].cast("string"), x["category"])), ", ")
    relevance = F.when(F.size("by") > 0, F.concat(F.col("relevant").cast("string"), F.lit(" are inspection-relevant ("), categories, F.lit(").")))
    relevance = F.coalesce(relevance, F.lit("None matched the configured deterministic inspection-relevance rules."))
    sentence = F.concat(F.lit("Detected "), F.col("changes").cast("string"), F.lit(" structured changes: "), types, F.lit(". "), relevance, F.lit(" Change boxes cover "), F.format_string("%.2f", F.col("mean_affected_area_fraction") * 100), F.lit("% of the average compared page area."))
    return out.select("pair_id", F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("relevant", F.lit(0)).alias("relevant"), "mean_affected_area_fraction", F.coalesce(sentence, F.lit(NONE)).alias("summary"))


def filter_changes(changes: DataFrame, query: str = "", types: list[str] | None = None, categories: list[str] | None = None, relevant_only: bool = False) -> DataFrame:
    """Changes that hold the query in any shown text (case folded), of the given types and categories; an empty list keeps none."""
    tier = F.coalesce("match_tier", F.lit("unmatched"))
    shown = F.concat_ws(" ", (F.col("page_index") + 1).cast("string"), "change_type", "category", "label", "detail", "relevance_reason", tier, F.coalesce("before_text", F.lit("")), F.coalesce("after_text", F.lit("")))
    out = changes
    if query:  # ASCII texts are folded without Python
        rows = changes.withColumn("__shown", shown)
        ascii_text = F.col("__shown").rlike(r"^\p{ASCII}*$")
        plain = rows.where(ascii_text & F.contains(F.lower("__shown"), F.lit(query.casefold())))
        out = plain.unionByName(rows.where(~ascii_text).where(F.contains(casefold(F.col("__shown")), F.lit(query.casefold())))).drop("__shown")
    out = out if types is None else out.where(F.col("change_type").isin(types))
    out = out if categories is None else out.where(F.col("category").isin(categories))
    return out.where("inspection_relevant") if relevant_only else out


def visible_regions(filtered: DataFrame, shown: dict[str, bool]) -> DataFrame:
    """Filtered changes whose type's toggle is on; a type without a toggle is shown."""
    return filtered.where(~F.col("change_type").isin([t for t, on in shown.items() if not on]))


def page_view(changes: DataFrame, page_index: int) -> DataFrame:
    """Changes of one page of every pair."""
    return changes.where(F.col("page_index") == page_index)


def selected_change(changes: DataFrame, filtered: DataFrame, change_id: str) -> DataFrame:
    """The change of an id, with filters_cleared: whether the filters hide it and have to go."""
    found = changes.where(F.col("id") == change_id)
    seen = filtered.where(F.col("id") == change_id).select(*PAGE, "id").withColumn("__seen", F.lit(True))
    return found.join(seen, [*PAGE, "id"], "left").withColumn("filters_cleared", F.col("__seen").isNull()).drop("__seen")


def pixel_boxes(changes: DataFrame, width: float, height: float, zoom: float = 1.0, left: float = 0.0, top: float = 0.0) -> DataFrame:
    """Adds pixels: the box on a page image of the given size in pixels, zoomed, with its corner at (left, top)."""
    at = lambda c, extent, offset: F.col(f"bbox.{c}") * (extent * zoom) + offset
    return changes.withColumn("pixels", G.box(at("x0", width, left), at("y0", height, top), at("x1", width, left), at("y1", height, top)))


def change_table(changes: DataFrame) -> DataFrame:
    """The nine columns of a results table, as text."""
    score = F.when(F.col("similarity_score").isNull(), "N/A").otherwise(F.format_string("%.3f", "similarity_score"))
    return changes.select((F.col("page_index") + 1).cast("string").alias("page"), F.col("change_type").alias("type"), "category", F.when(F.col("inspection_relevant"), "Yes").otherwise("No").alias("relevant"), "label", "detail", F.coalesce("match_tier", F.lit("unmatched")).alias("tier"), score.alias("score"), F.col("relevance_reason").alias("reason"))


def first_changes(changes: DataFrame, count: int) -> DataFrame:
    """The first changes of each pair in reporting order."""
    order = Window.partitionBy("pair_id").orderBy("page_index", "bbox.y0", "bbox.x0", "change_type", "id")
    return changes.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= count).drop("__n")
