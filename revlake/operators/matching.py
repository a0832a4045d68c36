"""The cascade that pairs a page's old and new entities: exact, attribute and structural tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.classify import with_category
from ..functions.text import text_similarity
from ..session import materialize, release
from ..settings import DEFAULTS, Settings
from .assignment import greedy, reject_ambiguous
from .backend import NATIVE, MatchingBackend
from .spatial import neighbourhood

PAGE = ["pair_id", "page_index"]


def glyph_shape(e: Column, settings: Settings) -> Column:
    """A compact outline of many line segments and nothing else, as CAD fonts draw symbols."""
    ops = F.map_keys(e["op_histogram"])
    return (e["kind"] == "geometry") & (F.size(ops) == 1) & F.array_contains(ops, "l") & (e["primitive_count"] >= settings.glyph_primitives) & (G.width(e["bbox"]) <= settings.glyph_extent) & (G.height(e["bbox"]) <= settings.glyph_extent)


def inside(p: Column, b: Column, tolerance: Column | float = 0.0) -> Column:
    return (p["x"] >= b["x0"] - tolerance) & (p["x"] <= b["x1"] + tolerance) & (p["y"] >= b["y0"] - tolerance) & (p["y"] <= b["y1"] + tolerance)


def unparented_glyphs(entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(pair_id, page_index, side, id) of glyphs without text in them that stand just left of a dimension's text.

    entities have a category column. Anti join with texts inside, semi join with dimensions to the right, page by page.
    """
    key = [*PAGE, "side"]
    e = F.struct("kind", "op_histogram", "primitive_count", "bbox")
    glyphs = entities.where(glyph_shape(e, settings)).select(*key, "id", "bbox")
    texts = entities.where("kind = 'text'").select(*key, F.col("bbox").alias("t"), "text", "category", "font_size")
    tolerance = F.greatest(F.lit(0.0005), 0.05 * F.least(G.width(F.col("bbox")), G.height(F.col("bbox"))))
    holding = glyphs.join(texts.where("trim(text) <> ''"), key).where(inside(G.centre(F.col("t")), F.col("bbox"), tolerance)).select(*key, "id")
    b, t = F.col("bbox"), F.col("t")
    scale = F.greatest(G.height(t), F.col("font_size"), F.lit(1e-5))
    beside = (b["x0"] <= t["x0"]) & (b["x1"] <= t["x0"] + 0.15 * scale) & (F.greatest(F.lit(0.0), t["x0"] - b["x1"]) <= 0.75 * scale) & (F.least(b["y1"], t["y1"]) - F.greatest(b["y0"], t["y0"]) >= 0.5 * F.least(G.height(b), G.height(t)))
    leading = glyphs.join(texts.where("category = 'DIMENSION'"), key).where(beside).select(*key, "id")
    return leading.distinct().join(holding, [*key, "id"], "left_anti")


def callout_features(o: Column, n: Column, t: Column, settings: Settings) -> tuple[Column, Column, Column]:
    """Whether two callouts may be one, how far their structures agree, and how far their attachments do."""
    family = lambda e: F.split(e["callout_structure"], ":")[0]
    compatible = (o["callout_category"] == n["callout_category"]) & (family(o) == family(n)) & ((family(o) != "dimension") | (o["callout_structure"] == n["callout_structure"]))
    a = F.transform(o["attachments"], lambda p: G.moved(p, t))
    b = n["attachments"]
    forth = F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: G.distance(p, q))))
    back = F.transform(b, lambda q: F.array_min(F.transform(a, lambda p: G.distance(q, p))))
    d = F.concat(forth, back)
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
    both, one = (F.size(a) > 0) & (F.size(b) > 0), (F.size(a) > 0) | (F.size(b) > 0)
    reachable = ~both | (F.array_max(d) <= settings.attachment_match)
    attachment = F.when(both, G.position_score(mean, settings.attachment_match)).when(one, 0.2).otherwise(0.5)
    return F.coalesce(compatible & reachable, F.lit(False)), text_similarity(o["callout_structure"], n["callout_structure"]), attachment


def is_callout(e: Column) -> Column:
    return e["callout_category"].isNotNull()


# The weights of the two scores and of their parts.


def attribute_score(o: Column, n: Column, t: Column, d: Column, content: Column, topology: Column, settings: Settings = DEFAULTS) -> Column:
    """Score of an edit in place. content and topology: text similarities, null where they do not apply."""
    compatible, _, attachment = callout_features(o, n, t, settings)
    position = G.position_score(d, settings.attribute_radius)
    style = (o["style_signature"] == n["style_signature"]).cast("double")
    size = G.ratio(o["font_size"] * t["scale"], n["font_size"])
    same = (o["category"] == n["category"]).cast("double")
    text = 0.48 * position + 0.22 * content + 0.13 * same + 0.09 * size + 0.08 * style
    callout = F.when(compatible, 0.34 * position + 0.22 * content + 0.18 * topology + 0.20 * attachment + 0.06 * size).otherwise(0.0)
    shape = 0.34 * position + 0.24 * G.overlap(G.moved_box(o["bbox"], t), n["bbox"]) + 0.20 * G.histogram_similarity(o["op_histogram"], n["op_histogram"]) + 0.12 * G.ratio(G.aspect(o["bbox"]), G.aspect(n["bbox"])) + 0.10 * style
    score = F.when(o["kind"] == "geometry", shape).when(is_callout(o), callout).otherwise(text)
    return F.when((o["kind"] == n["kind"]) & (is_callout(o) == is_callout(n)) & (d <= settings.attribute_radius), score).otherwise(0.0)


def structural_score(o: Column, n: Column, t: Column, d: Column, content: Column, topology: Column, settings: Settings = DEFAULTS) -> Column:
    """Score of a move, from content, shape, neighbourhood and position."""
    compatible, _, attachment = callout_features(o, n, t, settings)
    position = G.position_score(d, settings.structural_radius)
    context = G.context_similarity(o["context"], n["context"])
    style = (o["style_signature"] == n["style_signature"]).cast("double")
    same = (o["category"] == n["category"]).cast("double")
    # A bare dimension whose value and place both changed has no identity left.
    lost = (o["category"] == "DIMENSION") & (n["category"] == "DIMENSION") & (o["text_normalized"] != n["text_normalized"]) & (d > settings.attribute_radius)
    text = F.when(lost, 0.0).otherwise(0.36 * content + 0.17 * same + 0.12 * G.ratio(o["font_size"], n["font_size"]) + 0.18 * context + 0.17 * position)
    callout = F.when(compatible, 0.28 * content + 0.19 * topology + 0.22 * attachment + 0.17 * position + 0.14 * context).otherwise(0.0)
    shape = 0.25 * G.histogram_similarity(o["op_histogram"], n["op_histogram"]) + 0.16 * G.ratio(G.aspect(o["bbox"]), G.aspect(n["bbox"])) + 0.13 * G.ratio(G.area(o["bbox"]), G.area(n["bbox"])) + 0.15 * G.ratio(o["path_length"], n["path_length"]) + 0.08 * style + 0.12 * context + 0.11 * position
    score = F.when(o["kind"] == "geometry", shape).when(is_callout(o), callout).otherwise(text)
    allowed = (o["kind"] == n["kind"]) & (is_callout(o) == is_callout(n)) & (d <= settings.structural_radius) & ~o["glyph"] & ~n["glyph"]
    return F.when(allowed, score).otherwise(0.0)


@dataclass
class Matches:
    """matches: (pair_id, page_index, old_id, new_id, tier, score, d); entities with category; leftovers are anti joins."""

    matches: DataFrame
    entities: DataFrame
    open: DataFrame | None = None  # entities without the exactly matched, where these were cut

    @property
    def rest(self) -> DataFrame:
        return self.entities if self.open is None else self.open

    @property
    def unmatched_old(self) -> DataFrame:
        return self.rest.where("side = 'old'").join(self.matches.select(*PAGE, F.col("old_id").alias("id")), [*PAGE, "id"], "left_anti")

    @property
    def unmatched_new(self) -> DataFrame:
        return self.rest.where("side = 'new'").join(self.matches.select(*PAGE, F.col("new_id").alias("id")), [*PAGE, "id"], "left_anti")


def _scored(near: DataFrame, score, least: float, settings: Settings) -> DataFrame:
    """Candidates whose score is at least `least`. Text similarities, which need Python, are computed for those texts only that would
    reach it if they were all alike: the score grows with them, so no other can."""
    o, n, t = F.col("o"), F.col("n"), F.col("t")
    one, null = F.lit(1.0), F.lit(None).cast("double")
    out = [*PAGE, o["id"].alias("old_id"), n["id"].alias("new_id"), "score", "d", is_callout(o).alias("callout")]
    rated = lambda df, content, topology: df.withColumn("score", score(o, n, t, F.col("d"), content, topology, settings)).where(F.col("score") >= least)
    near = materialize(rated(near, one, one))
    texts = near.where(o["kind"] == "text").drop("score").withColumn("content", text_similarity(o["text_normalized"], n["text_normalized"]))
    both = is_callout(o) & is_callout(n)
    plain = texts.where(~both).withColumn("topology", null)
    framed = texts.where(both).withColumn("topology", text_similarity(o["callout_structure"], n["callout_structure"]))
    scored = materialize(near.where(o["kind"] == "geometry").select(*out).unionByName(rated(plain.unionByName(framed), F.col("content"), F.col("topology")).select(*out)))
    release(near)
    return scored


def exact_candidates(old: DataFrame, new: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Hash join of registered old and new rows on page, kind and content signature, within the exact radius.

    old: pair_id, page_index, kind, sig, lx, ly and more; new: pair_id, page_index, kind, sig, rx, ry and more.
    """
    same = old.join(new, [*PAGE, "kind", "sig"])
    return same.withColumn("d", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))).where(F.col("d") <= settings.exact_radius)


def prepare(entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """entities with category, glyph and context, all seen from their full page."""
    key = [*PAGE, "side"]
    texts = entities.where("kind = 'text'").select(*key, "id", "text", "bbox")
    categories = with_category(texts.withColumnRenamed("id", "item"), texts, key, DEFAULTS).select(*key, F.col("item").alias("id"), "category")
    seen = neighbourhood(entities, key).join(categories, [*key, "id"], "left")
    marked = materialize(entities.join(seen, [*key, "id"], "left"))
    glyphs = unparented_glyphs(marked, settings).withColumn("glyph", F.lit(True))
    if glyphs.isEmpty():
        return marked.withColumn("glyph", F.lit(False))
    out = materialize(marked.join(glyphs, [*key, "id"], "left").withColumn("glyph", F.coalesce("glyph", F.lit(False))))
    release(marked)
    return out


def match_entities(entities: DataFrame, transforms: DataFrame, settings: Settings = DEFAULTS, backend: MatchingBackend = NATIVE) -> Matches:
    """Pairs old with new entities page by page; each tier sees what the tiers before it left.

    transforms: (pair_id, page_index, transform). Pages without one are overlaid as they are.
    """
    ready = prepare(entities, settings)
    identity = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("rotation"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    fields = ["id", "kind", "bbox", "anchor", "content_signature", "style_signature", "text_normalized", "font_size", "op_histogram", "path_length", "callout_category", "callout_structure", "attachments", "category", "glyph", "context"]

    def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        side = lambda s, c: rows.where(F.col("side") == s).select(*PAGE, F.struct(*fields).alias(c))
        old = side("old", "o").join(transforms.select(*PAGE, F.col("transform").alias("t")), PAGE, "left").withColumn("t", F.coalesce("t", identity)).withColumn("p", G.moved(F.col("o.anchor"), F.col("t")))
        old = old.withColumns({"lx": F.col("p.x"), "ly": F.col("p.y"), "kind": F.col("o.kind")})
        return old, side("new", "n").withColumns({"rx": F.col("n.anchor.x"), "ry": F.col("n.anchor.y"), "kind": F.col("n.kind")})

    old, new = sides(ready)
    same = exact_candidates(old.withColumn("sig", F.col("o.content_signature")), new.withColumn("sig", F.col("n.content_signature")), settings)
    o, n, t = F.col("o"), F.col("n"), F.col("t")
    fit, _, _ = callout_features(o, n, t, settings)
    exact = same.where(~is_callout(o) | fit).select(*PAGE, o["id"].alias("old_id"), n["id"].alias("new_id"), F.lit(1.0).alias("score"), "d", is_callout(o).alias("callout"))
    first = materialize(greedy(reject_ambiguous(exact, PAGE, settings.match_margin), PAGE).withColumn("tier", F.lit("exact")))

    # What is left, cut once: neither the later tiers nor the changes need an entity that was matched exactly.
    taken = lambda found: found.select(*PAGE, F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old_id").alias("id")), F.struct(F.lit("new").alias("side"), F.col("new_id").alias("id")))).alias("e")).select(*PAGE, "e.*")
    rest = materialize(ready.join(taken(first), [*PAGE, "side", "id"], "left_anti"))

    def pairs(rows: DataFrame, radius: float) -> DataFrame:
        old, new = (x.withColumn(k, F.col(f"{c}.id")) for x, k, c in zip(sides(rows), ("old_id", "new_id"), "on", strict=True))
        near = backend.radius_pairs(old.select(*PAGE, "kind", "old_id", "lx", "ly"), new.select(*PAGE, "kind", "new_id", "rx", "ry"), [*PAGE, "kind"], radius).select(*PAGE, "old_id", "new_id", "d")
        return near.join(old.select(*PAGE, "old_id", "o", "t"), [*PAGE, "old_id"]).join(new.select(*PAGE, "new_id", "n"), [*PAGE, "new_id"]).drop("old_id", "new_id")

    near = pairs(rest, settings.attribute_radius)
    scored = _scored(near, attribute_score, settings.attribute_score, settings)
    second = materialize(greedy(reject_ambiguous(scored, PAGE, settings.match_margin), PAGE).withColumn("tier", F.lit("attribute")))

    near = pairs(rest.join(taken(second), [*PAGE, "side", "id"], "left_anti"), settings.structural_radius)
    scored = _scored(near, structural_score, settings.structural_score, settings)
    third = materialize(backend.assign(reject_ambiguous(scored, PAGE, settings.match_margin), PAGE, settings.structural_score, settings.sparse_from).withColumn("tier", F.lit("structural")))

    return Matches(first.unionByName(second).unionByName(third).withColumn("score", F.round("score", 6)).drop("callout"), ready, rest)
