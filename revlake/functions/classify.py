"""Category of a text, and whether a change matters to inspection, as Column expressions and one neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import ADMINISTRATIVE_WORDS, INSPECTION_WORDS, Settings
from . import geometry as G
from .patterns import CLASS_DIMENSION, CLASS_GDT_WORDS, CLASS_NOT_DIMENSION, CLASS_NOTE, CLASS_REVISION, CLASS_REVISION_CELL, GDT_FEATURES, GDT_MODIFIERS, java
from .text import squeeze

# The reasons that a decision gives.
REASONS = {
    "GEOMETRY": "Vector geometry changed; physical form may be affected.",
    "DIMENSION": "A measured requirement or tolerance changed.",
    "GD&T": "A GD&T control or datum-related requirement changed.",
    "NOTE+": "The note contains an inspection-impact keyword.",
    "NOTE": "General note change has no configured inspection keyword.",
    "REVISION+": "Revision text describes a technical inspection impact.",
    "REVISION": "Administrative revision metadata is not itself inspectable.",
    "OTHER": "Unclassified text change has no deterministic inspection rule.",
}


def in_title_block(b: Column, settings: Settings) -> Column:
    c = G.centre(b)
    return ((c["x"] >= settings.title_x) & (c["y"] >= settings.title_y)) | (c["y"] >= 0.9)


def has_word(text: Column, words: list[str]) -> Column:
    return F.upper(text).rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")


def is_revision_cell(text: Column) -> Column:
    """Every value around arrows has the shape of a revision letter, number or date."""
    return F.forall(F.split(squeeze(text), r"(?U)\s*->\s*"), lambda v: F.trim(v).rlike(java(CLASS_REVISION_CELL, whole=True)))


def category(text: Column, b: Column, near_revision: Column, settings: Settings) -> Column:
    """First category that applies. near_revision: whether the text or its neighbours speak of a revision."""
    t = squeeze(text)
    token = F.trim(F.regexp_extract(t, java(CLASS_DIMENSION), 0))
    bare = in_title_block(b, settings) & token.rlike(r"(?U)^\d{1,4}$")
    return (
        F.when(t.rlike(f"[{GDT_FEATURES}{GDT_MODIFIERS}]") | t.rlike(java(CLASS_GDT_WORDS)), "GD&T")
        .when(t.rlike(java(CLASS_REVISION)), "REVISION")
        .when(in_title_block(b, settings) & near_revision & is_revision_cell(t), "REVISION")
        .when(t.rlike(java(CLASS_NOTE)), "NOTE")
        .when(~t.rlike(java(CLASS_NOT_DIMENSION)) & (token != "") & ~bare, "DIMENSION")
        .otherwise("OTHER")
    )


def with_category(items: DataFrame, context: DataFrame, key: list[str], settings: Settings) -> DataFrame:
    """items (key columns, item, text, bbox, ...) with a category column.

    context: texts of the pages (key columns, id, text, bbox). Only texts in the title block that look like a revision cell need
    their neighbours, so only those are joined: by page, then the six nearest within the radius.
    """
    radius = max(0.1, settings.annotation_radius * 2)
    asking = items.where(in_title_block(F.col("bbox"), settings) & is_revision_cell(F.col("text"))).select(*key, "item", F.col("bbox").alias("__at"))
    c = G.centre(F.col("bbox"))
    close = ((c["x"] >= settings.title_x - radius - 1e-6) & (c["y"] >= settings.title_y - radius - 1e-6)) | (c["y"] >= 0.9 - radius - 1e-6)  # no other is within the radius of a title block
    near = asking.join(context.where(close).select(*key, F.col("id").alias("__id"), F.col("text").alias("__text"), F.col("bbox").alias("__bbox")), key)
    near = near.withColumn("__d", G.distance(G.centre(F.col("__bbox")), G.centre(F.col("__at")))).where(F.col("__d") <= radius)
    six = near.groupBy(*key, "item").agg(F.slice(F.array_sort(F.collect_list(F.struct("__d", "__id", "__text"))), 1, 6).alias("__near"))
    words = six.select(*key, "item", F.concat_ws(" ", F.transform("__near", lambda x: x["__text"])).alias("__around"))
    found = items.join(words, [*key, "item"], "left")
    near_revision = F.concat_ws(" ", squeeze(F.col("text")), F.coalesce("__around", F.lit(""))).rlike(java(CLASS_REVISION))
    return found.withColumn("category", category(F.col("text"), F.col("bbox"), near_revision, settings)).drop("__around")


def relevant(cat: Column, combined: Column) -> Column:
    technical = [w for w in INSPECTION_WORDS if w not in ADMINISTRATIVE_WORDS]
    return F.when(cat.isin("GEOMETRY", "DIMENSION", "GD&T"), True).when(cat == "NOTE", has_word(combined, INSPECTION_WORDS)).when(cat == "REVISION", has_word(combined, technical)).otherwise(False)


def reason(cat: Column, is_relevant: Column) -> Column:
    """The sentence that goes with a category and its relevance."""
    out = F.lit(REASONS["OTHER"])
    for name in ("GEOMETRY", "DIMENSION", "GD&T"):
        out = F.when(cat == name, REASONS[name]).otherwise(out)
    for name in ("NOTE", "REVISION"):
        out = F.when(cat == name, F.when(is_relevant, REASONS[name + "+"]).otherwise(REASONS[name])).otherwise(out)
    return out
