"""The engine's operators as queries over the driver's tables, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions.classify import reason, relevant, with_category
from .functions.text import digest, normalize_text
from . import made_queries
from .operators import callouts, matching
from .operators.alignment import align, anchor_pairs, least_squares_fits, unique_keys
from .operators.areas import union_area
from .operators.changes import change_counts, change_table, filter_changes, summaries
from .operators.matching import PAGE, attribute_score, match_entities
from .operators.assignment import greedy, least_cost, reject_ambiguous
from .operators.extraction import number_duplicates, text_entities
from .operators.spatial import nearest_join, neighbourhood, radius_join
from .operators.validation import page_capabilities, validate
from .plans.compare import Comparison, compare_entities
from .sources.tables import synthetic_pair


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_pair(_orders(spark, sf_dir))


def _side(df: DataFrame, side: str) -> DataFrame:
    a = "l" if side == "old" else "r"
    return df.where(F.col("side") == side).select(*PAGE, "kind", F.col("id").alias(f"{side}_id"), "content_signature", F.col("anchor.x").alias(f"{a}x"), F.col("anchor.y").alias(f"{a}y"), "bbox", "op_histogram", "style_signature").withColumnsRenamed({c: f"{side}_{c}" for c in ("content_signature", "bbox", "op_histogram", "style_signature")})


def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic revision pair itself."""
    e = _pair(spark, sf_dir)
    return e.select("side", "page_index", "id", "kind", F.round("anchor.x", 6).alias("x"), F.round("anchor.y", 6).alias("y"), "text", "content_signature")


def radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new entities of one kind within the attribute radius."""
    e = _pair(spark, sf_dir)
    return radius_join(_side(e, "old"), _side(e, "new"), [*PAGE, "kind"], 0.018).select("page_index", "kind", "old_id", "new_id", F.round("d", 6).alias("d"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each old entity's seven nearest, itself first."""
    e = _pair(spark, sf_dir).where("side = 'old'").withColumns({"x": F.col("anchor.x"), "y": F.col("anchor.y")})
    return nearest_join(e, ["page_index"], "id", "x", "y", 7).select("page_index", "id", "neighbour", "rank", F.round("d", 6).alias("d"))


def exact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash join on page, kind and content, within the exact radius of the true shift."""
    e = _pair(spark, sf_dir)
    old = _side(e, "old").withColumnsRenamed({"old_content_signature": "sig"}).withColumns({"lx": F.col("lx") + 0.01, "ly": F.col("ly") - 0.005})
    return matching.exact_candidates(old, _side(e, "new").withColumnRenamed("new_content_signature", "sig")).select("page_index", "kind", "old_id", "new_id")


def unique_anchor_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur once on their page and side."""
    return unique_keys(_pair(spark, sf_dir)).select("page_index", "side", "kind", "anchor_key")


def least_squares_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form similarity fit of each page's anchors."""
    fits = least_squares_fits(anchor_pairs(_pair(spark, sf_dir)))
    return fits.select("page_index", "anchors", F.round("transform.scale", 6).alias("scale"), F.round("transform.rotation", 6).alias("rotation"))


def registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust registration of every page."""
    a = align(_pair(spark, sf_dir))
    return a.select("page_index", "status", "anchor_count", "inlier_count", F.round("transform.tx", 5).alias("tx"), F.round("transform.ty", 5).alias("ty"))


def text_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of every text, with neighbours in title blocks."""
    t = _pair(spark, sf_dir).where("kind = 'text' and side = 'old'").select(*PAGE, "id", "text", "bbox")
    from .settings import DEFAULTS

    got = with_category(t.withColumnRenamed("id", "item"), t, PAGE, DEFAULTS)
    r = relevant(F.col("category"), F.col("text"))
    return got.select("page_index", F.col("item").alias("id"), "category", r.alias("relevant"), reason(F.col("category"), r).alias("reason"))


def geometry_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute scores of geometry within the radius: position, overlap, histogram, aspect and style."""
    e = _pair(spark, sf_dir).where("kind = 'geometry'")
    full = lambda s, a, c: e.where(F.col("side") == s).select(*PAGE, F.struct(*e.columns, F.lit(None).cast("string").alias("category")).alias(c)).withColumns({f"{a}x": F.col(f"{c}.anchor.x"), f"{a}y": F.col(f"{c}.anchor.y")})
    t = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("rotation"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    j = radius_join(full("old", "l", "o"), full("new", "r", "n"), PAGE, 0.018).withColumn("t", t)
    null = F.lit(None).cast("double")
    return j.select("page_index", F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"), F.round(attribute_score(F.col("o"), F.col("n"), F.col("t"), F.col("d"), null, null), 6).alias("score"))


def covered_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union area of each page's old boxes."""
    e = _pair(spark, sf_dir).where("side = 'old'")
    return union_area(e, ["page_index"]).select("page_index", F.round("area", 6).alias("area"))


def duplicate_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of duplicates: here all entities of one page and content have one id, and get numbers by kind and box."""
    e = _pair(spark, sf_dir).where("side = 'old'").withColumns({"own": F.col("id"), "id": F.col("content_signature")})
    return number_duplicates(e).select("page_index", F.col("own").alias("id"), F.col("id").alias("numbered"))


def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form and digests of part names."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    t = normalize_text(F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type", F.lit(" ")), ascii_only=True)
    return p.select("p_partkey", t.alias("text"), digest(F.lit("text"), t, F.col("p_size")).alias("content_signature"), digest(F.lit("text"), t, F.col("p_size"), length=16).alias("short"))


def document_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule that documents made from suppliers break."""
    k = F.col("s_suppkey")
    d = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.cast("string").alias("pair_id"), F.lit("old").alias("side"), F.concat(F.lit("f"), k.cast("string"), F.when(k % 7 == 0, ".txt").otherwise(".PDF")).alias("file_name"), F.when(k % 11 == 0, 0).when(k % 13 == 0, 200 * 1024 * 1024).otherwise(k * 1000).cast("long").alias("size_bytes"), F.when(k % 5 == 0, "PK").otherwise("%PDF-1.7").alias("header"), (k % 17 == 0).alias("encrypted"), (k % 4).cast("int").alias("page_count"))
    none = spark.createDataFrame([], "pair_id string, side string, page_index int, effectively_scanned boolean")
    return validate(d, none).select(F.col("pair_id").alias("document"), "error_code", "error")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change list made from orders, for the operators on change lists."""
    k = F.col("o_orderkey")
    at = lambda m: F.element_at(F.array(*[F.lit(x) for x in m]), (k % len(m) + 1).cast("int"))
    box = G.box((k % 89) / F.lit(100.0), (k % 83) / F.lit(100.0), (k % 89) / F.lit(100.0) + 0.01, (k % 83) / F.lit(100.0) + 0.01)
    return _orders(spark, sf_dir).select(
        (k % 7).cast("string").alias("pair_id"), (k % 23).cast("int").alias("page_index"), F.concat(F.lit("chg-"), k.cast("string")).alias("id"), at(["added", "removed", "moved", "modified"]).alias("change_type"), at(["DIMENSION", "GD&T", "NOTE", "REVISION", "GEOMETRY"]).alias("category"), (k % 3 == 0).alias("inspection_relevant"), F.lit("reason").alias("relevance_reason"), box.alias("bbox"),
        F.col("o_orderpriority").alias("label"), F.concat("o_orderpriority", F.lit(" changed.")).alias("detail"), F.when(k % 2 == 0, "exact").alias("match_tier"), F.when(k % 2 == 0, (k % 1000) / F.lit(1000.0)).alias("similarity_score"), F.lit(None).cast("string").alias("before_text"), F.col("o_orderstatus").alias("after_text"),
    )


def filtered_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change list filtered by text, type, category and relevance, as a results table shows it."""
    f = filter_changes(_changes(spark, sf_dir), "URGENT", ["added", "moved"], ["DIMENSION", "NOTE", "GEOMETRY"], relevant_only=True)
    return change_table(f.withColumn("label", F.concat_ws(" ", "label", "id")))


def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary sentence per pair."""
    c = _changes(spark, sf_dir)
    pages = c.groupBy("pair_id", "page_index").agg((F.count("*") / F.lit(100000.0)).alias("affected_area_fraction"))
    return summaries(c, pages).select("pair_id", "changes", "relevant", "summary")


def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _changes(spark, sf_dir)
    return change_counts(c.where("change_type <> 'moved' or pair_id <> '3'"), c)


def page_affected_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union area of change boxes per page."""
    return union_area(_changes(spark, sf_dir), PAGE).select(*PAGE, F.round("area", 6).alias("area"))


def _compared(spark: SparkSession, sf_dir: str, callouts: bool = True) -> Comparison:
    return compare_entities(_pair(spark, sf_dir), strict=False, callouts=callouts)


def tier_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the three tiers on the registered pair."""
    e = _pair(spark, sf_dir)
    return match_entities(e, align(e)).matches.select("page_index", "old_id", "new_id", "tier", "score")


def compared_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison: typed, categorised and rated changes."""
    return _compared(spark, sf_dir).changes.select("page_index", "id", "change_type", "category", "inspection_relevant", "relevance_reason", "label", "detail", "match_tier", "similarity_score", "old_entity_id", "new_entity_id")


def compared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _compared(spark, sf_dir).pages
    return p.select("page_index", F.col("alignment.status").alias("status"), "entity_count_old", "entity_count_new", "affected_area_fraction", "relevant_area_fraction")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates within a wide radius, scored by nearness, for the operators on candidates."""
    e = _pair(spark, sf_dir)
    j = radius_join(_side(e, "old"), _side(e, "new"), [*PAGE, "kind"], 0.06).withColumn("d", F.round("d", 6))
    return j.select("page_index", "old_id", "new_id", F.round(1 - F.col("d"), 6).alias("score"), "d", F.substring("old_id", -1, 1).isin("0", "3", "6", "9").alias("callout"))


def _by_page(candidates: DataFrame, choose: Callable[[list[tuple[float, str, str]]], list[tuple[str, str]]]) -> DataFrame:
    """(page_index, old_id, new_id) that a rule of the callout kernel chooses from a page's (d, old_id, new_id)."""

    def kernel(pdf):
        import pandas as pd

        got = sorted(choose(list(zip(pdf["d"], pdf["old_id"], pdf["new_id"], strict=True))))
        return pd.DataFrame({"page_index": pdf["page_index"].iloc[0], "old_id": [a for a, _ in got], "new_id": [b for _, b in got]})

    return candidates.select("page_index", "d", "old_id", "new_id").groupBy("page_index").applyInPandas(kernel, "page_index int, old_id string, new_id string")


def clear_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each old entity's best partner, where the next is clearly worse."""

    def choose(rows):
        by: dict[str, list] = {}
        for d, a, b in rows:
            by.setdefault(a, []).append((d, b))
        return [(a, best) for a, own in by.items() if (best := callouts.clear_best(own, 0.02)) is not None]

    return _by_page(_scored(spark, sf_dir), choose)


def mutual_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that clearly choose each other."""
    return _by_page(_scored(spark, sf_dir), lambda rows: list(callouts.mutual(rows, 0.01)))


def unambiguous_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates left after flagged entities with two close scores lost theirs."""
    return reject_ambiguous(_scored(spark, sf_dir), ["page_index"], 0.015).select("page_index", "old_id", "new_id", "score")


def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one pairs of the candidates."""
    return greedy(_scored(spark, sf_dir), ["page_index"]).select("page_index", "old_id", "new_id", "score")


def least_cost_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs of greatest total score within components of the candidates."""
    return least_cost(_scored(spark, sf_dir).where("score >= 0.96"), ["page_index"], 0.96, 1200).select("page_index", "old_id", "new_id", "score")


def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text share, distance and spread of each old entity's six nearest."""
    e = _pair(spark, sf_dir).where("side = 'old'")
    c = neighbourhood(e, ["page_index"])
    return c.select("page_index", "id", F.round(F.col("context")[0], 6).alias("text_share"), F.round(F.col("context")[2], 6).alias("mean_distance"), F.round(F.col("context")[3], 6).alias("spread"))


def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal extents of old boxes merged within bands of the page, as line runs are."""
    e = _pair(spark, sf_dir).where("side = 'old'").select("page_index", F.floor(F.col("bbox.y0") * 20).cast("double").alias("band"), F.col("bbox.x0").alias("lo"), F.col("bbox.x1").alias("hi"), "id")

    def kernel(pdf):
        import pandas as pd

        found = callouts.rails(list(zip(pdf["band"], pdf["lo"], pdf["hi"], pdf["id"], strict=True)), 0.002)
        return pd.DataFrame([(pdf["page_index"].iloc[0], int(r.at), r.lo, r.hi, len(r.owners)) for r in found], columns=["page_index", "band", "lo", "hi", "members"])

    m = e.groupBy("page_index").applyInPandas(kernel, "page_index int, band int, lo double, hi double, members long")
    return m.select("page_index", "band", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "members")


def fragment_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of dimension fragments, twelve kinds of them."""
    k = F.col("o_orderkey")
    n = lambda m: (k % m + 1).cast("string")
    texts = [F.concat(n(50), F.lit("X")), F.lit(" Ø "), F.concat(n(40), F.lit(".5")), F.concat(F.lit("±0."), n(9)), F.lit("THRU"), F.concat(F.lit("R"), n(9)), F.concat(n(90), F.lit("°")), F.lit("mm"), F.concat(F.lit("SHEET "), n(9)), F.concat(F.lit("⌀"), n(30), F.lit(" +/- 0.1")), F.lit("words"), F.lit("⌖")]
    role = F.pandas_udf(lambda t: t.map(callouts.fragment_role), "string")
    return _orders(spark, sf_dir).select(k.alias("k"), role(F.element_at(F.array(*texts), (k % 12 + 1).cast("int"))).alias("role"))


def _raw_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, spans and images made from customers, 30 to a page of 612 x 792 points."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("p").alias("pair_id"), F.lit("old").alias("side"), F.floor(k / 30).cast("int").alias("page_index"), k.alias("k"), "c_name", "c_mktsegment", "c_nationkey")
    x, y = (F.col("k") % 53 * 10).cast("double"), (F.col("k") % 71 * 10).cast("double")
    spans = c.select("pair_id", "side", "page_index", F.col("k").cast("int").alias("block_index"), F.lit(0).alias("line_index"), F.lit(0).alias("span_index"), F.concat(F.lit(" "), "c_name", F.lit("   "), "c_mktsegment").alias("text"), G.box(x, y, x + 80, y + 12).alias("bbox"), F.lit(None).cast("struct<x:double,y:double>").alias("origin"), F.lit(None).cast("struct<x:double,y:double>").alias("dir"), F.col("c_mktsegment").alias("font"), (F.col("k") % 3 + 10).cast("double").alias("size"), F.lit(0).alias("flags"), F.lit(255).alias("color"), F.when(F.col("k") % 9 == 0, 0).cast("int").alias("alpha"))
    pages = c.select("pair_id", "side", "page_index").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    images = c.where("k % 4 = 0").select("pair_id", "side", "page_index", F.col("k").cast("int").alias("image_index"), G.box(x - 40, y - 40, x + 160, y + 200).alias("bbox"))
    return pages, spans, images


def extracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text entities of raw spans: normal form, unit box, anchor and digests."""
    pages, spans, _ = _raw_pages(spark, sf_dir)
    e = text_entities(spans, pages, ascii_only=True)
    return e.select("page_index", "text", "text_normalized", "font_name", "font_size", "style_signature", "content_signature", *(F.round(f"bbox.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")), F.round("anchor.y", 6).alias("anchor_y"))


def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and covered fractions of raw pages, and whether they are scans."""
    pages, spans, images = _raw_pages(spark, sf_dir)
    from .sources.tables import SCHEMAS

    c = page_capabilities(pages, spans, spark.createDataFrame([], SCHEMAS["raw_drawings"]), images)
    return c.select("page_index", "text_span_count", "image_count", F.round("image_coverage_fraction", 5).alias("image_cover"), F.round("structured_coverage_fraction", 5).alias("structured_cover"), "effectively_scanned")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (entity_table, radius_pairs, nearest_neighbours, exact_candidates, unique_anchor_keys, least_squares_fit, registration, text_categories, geometry_scores, covered_area, duplicate_ordinals, text_digests, document_gate, filtered_changes, change_summary, counts_by_type, page_affected_area, clear_choices, mutual_choices, unambiguous_candidates, greedy_pairs, least_cost_pairs, context_vectors, merged_runs, fragment_roles, extracted_texts, page_inventory, tier_matches, compared_changes, compared_pages)}

QUERIES |= made_queries.QUERIES

_PAIR = """
base as (
  select o_orderkey as k, cast(floor(o_orderkey / 250) as int) as page_index, ((o_orderkey * 7919) % 10007) / 10007e0 as x, ((o_orderkey * 104729) % 9973) / 9973e0 as y,
    case when o_orderkey % 3 = 0 then 'geometry' else 'text' end as kind,
    case o_orderkey % 6 when 1 then cast(o_orderkey % 400 as varchar) || '.' || cast(o_orderkey % 10 as varchar) || ' mm' when 2 then 'NOTE: ' || o_orderpriority
      when 4 then 'POSITION .0' || cast(o_orderkey % 90 + 10 as varchar) || ' A B' when 5 then 'REVISION ' || o_orderstatus else '' end as text
  from orders),
both_sides as (
  select 'old' as side, * from base
  union all
  select 'new', k, page_index, x + 0.01e0 + case when k % 13 = 0 then 0.010e0 when k % 19 = 0 then 0.09e0 else 0e0 end, y - 0.005e0, kind, case when k % 11 = 0 and text <> '' then text || ' X' else text end
  from base where k % 17 <> 0),
entity as (
  select side, page_index, 'e-' || lpad(cast(k as varchar), 9, '0') as id, k, kind, x, y, text,
    kind || '|' || text || '|' || cast(case when kind = 'geometry' then k % 40 else 0 end as varchar) as content_signature,
    x as x0, y as y0, x + (0.01e0 + (k % 7) / 1000e0) as x1, y + (0.008e0 + (k % 5) / 1000e0) as y1
  from both_sides)"""

_KEYS = """
keyed as (select page_index, side, kind, x, y, case when kind = 'text' then case when length(text) >= 2 then lower(text) end else 'shape-' || cast(k % 400 as varchar) end as anchor_key from entity),
uniq as (select page_index, side, kind, anchor_key, any_value(x) as x, any_value(y) as y from keyed where anchor_key is not null and anchor_key <> '' group by all having count(*) = 1)"""

# The classifier's words and token pattern, as SQL writes them.
_GDT = "(regexp_matches(text, '[⌖⏥⏊∥⌭⌒⌓○⌀ⓂⓁⓈ]') or regexp_matches(text, '(?i)\\b(ANGULARITY|CIRCULARITY|CONCENTRICITY|CYLINDRICITY|DATUM|FLATNESS|MMC|LMC|PARALLELISM|PERPENDICULARITY|POSITION|PROFILE|RUNOUT|STRAIGHTNESS|SYMMETRY|TOTAL\\s+RUNOUT)\\b'))"
_NOTE = "regexp_matches(text, '(?i)\\b(GENERAL\\s+NOTES?|NOTES?|UNLESS\\s+OTHERWISE|DO\\s+NOT|TYP(ICAL)?|DEBURR|BREAK\\s+(ALL\\s+)?EDGES|REMOVE\\s+BURRS|MATERIAL|FINISH|WELD|SURFACE|HARDNESS|TORQUE|CLEAN)\\b')"
_TOKEN = "trim(regexp_extract(text, '(?i)(^|\\s)(\\d+\\s*[xX]\\s*)?(R|SR|Ø|⌀|DIA\\.?|M)?\\s*(\\d+([.,]\\d+)?|[.,]\\d+)(\\s*/\\s*\\d+)?\\s*(MM|CM|M|IN|FT|°|DEG|\"|'')?(\\s*(±|\\+/-|\\+\\s*\\d|[-+]\\s*\\d|MAX\\b|MIN\\b|REF\\b|TYP\\b|THRU\\b|EQ\\s+SP))?', 0))"
_WORDS = "ACCEPT|CHAMFER|CHECK|CLEAN|COATING|CRITICAL|DIAMETER|FINISH|FLATNESS|HARDNESS|INSPECT|MATERIAL|MEASURE|PARALLEL|PERPENDICULAR|POSITION|PROFILE|ROUGHNESS|SURFACE|THREAD|TOLERANCE|TORQUE|VERIFY|WELD"

_LIST = """
change as (
  select cast(o_orderkey % 7 as varchar) as pair_id, cast(o_orderkey % 23 as int) as page_index, 'chg-' || cast(o_orderkey as varchar) as id, o_orderkey as k,
    ['added', 'removed', 'moved', 'modified'][o_orderkey % 4 + 1] as change_type, ['DIMENSION', 'GD&T', 'NOTE', 'REVISION', 'GEOMETRY'][o_orderkey % 5 + 1] as category, o_orderkey % 3 = 0 as relevant,
    o_orderpriority as label, case when o_orderkey % 2 = 0 then 'exact' end as tier, case when o_orderkey % 2 = 0 then (o_orderkey % 1000) / 1000e0 end as score, o_orderstatus as after_text,
    (o_orderkey % 89) / 100e0 as x0, (o_orderkey % 83) / 100e0 as y0, (o_orderkey % 89) / 100e0 + 0.01e0 as x1, (o_orderkey % 83) / 100e0 + 0.01e0 as y1
  from orders)"""


def _area_sql(source: str, keys: str) -> str:
    """Union area by slabs and merged intervals."""
    return f"""
box as (select {keys}, greatest(0e0, least(1e0, x0)) as x0, greatest(0e0, least(1e0, y0)) as y0, greatest(0e0, least(1e0, x1)) as x1, greatest(0e0, least(1e0, y1)) as y1 from {source}),
edge as (select distinct {keys}, unnest([x0, x1]) as l from box),
slab as (select {keys}, l, lead(l) over (partition by {keys} order by l) as r from edge),
cover as (select {", ".join(f"s.{k.strip()}" for k in keys.split(","))}, s.l, s.r, b.y0, b.y1, max(b.y1) over (partition by {", ".join(f"s.{k.strip()}" for k in keys.split(","))}, s.l order by b.y0, b.y1 rows between unbounded preceding and 1 preceding) as before
  from slab s join box b on {" and ".join(f"s.{k.strip()} = b.{k.strip()}" for k in keys.split(","))} and b.x0 <= (s.l + s.r) / 2 and (s.l + s.r) / 2 <= b.x1 and b.y1 > b.y0 where s.r > s.l)
select {keys}, round(coalesce(sum(greatest(0e0, y1 - greatest(y0, coalesce(before, y0))) * (r - l)), 0), 6) as area from cover group by {keys}"""


_GEOMETRY = f"""{_PAIR}, g as (select *, k % 5 + 1 as hl, k % 3 as hc, (x1 - x0) / (y1 - y0) as aspect from entity where kind = 'geometry'),
p as (select o.page_index, o.id as old_id, n.id as new_id, sqrt((o.x - n.x) ** 2 + (o.y - n.y) ** 2) as d, greatest(0e0, least(o.x1, n.x1) - greatest(o.x0, n.x0)) * greatest(0e0, least(o.y1, n.y1) - greatest(o.y0, n.y0)) as i,
  (o.x1 - o.x0) * (o.y1 - o.y0) as ao, (n.x1 - n.x0) * (n.y1 - n.y0) as an, (least(o.hl, n.hl) + least(o.hc, n.hc)) / cast(greatest(o.hl, n.hl) + greatest(o.hc, n.hc) as double) as h, least(o.aspect, n.aspect) / greatest(o.aspect, n.aspect) as r
  from g o join g n on o.side = 'old' and n.side = 'new' and o.page_index = n.page_index),
scored as (select page_index, old_id, new_id, round(0.34e0 * greatest(0e0, 1 - d / 0.018e0) + 0.24e0 * (i / (ao + an - i)) + 0.20e0 * h + 0.12e0 * r + 0.10e0, 6) as score from p where d <= 0.018e0)"""

_CAND = f"""{_PAIR}, near as (select o.page_index, o.id as old_id, n.id as new_id, round(sqrt((o.x - n.x) * (o.x - n.x) + (o.y - n.y) * (o.y - n.y)), 6) as d from entity o join entity n on o.side = 'old' and n.side = 'new' and o.page_index = n.page_index and o.kind = n.kind where sqrt((o.x - n.x) * (o.x - n.x) + (o.y - n.y) * (o.y - n.y)) <= 0.06e0),
cand as (select *, round(1 - d, 6) as score, right(old_id, 1) in ('0', '3', '6', '9') as callout from near)"""


def _clear_sql(by: str, choice: str, margin: str) -> str:
    return f"select page_index, old_id, new_id from (select *, row_number() over w as r, lead(d) over w as nx from cand window w as (partition by page_index, {by} order by d, {choice})) where r = 1 and (nx is null or nx - d > {margin})"


def _close_sql(by: str) -> str:
    return f"select page_index, {by} from (select page_index, {by}, score, row_number() over (partition by page_index, {by} order by score desc) as r from cand where callout) where r <= 2 group by all having count(*) > 1 and max(score) - min(score) < 0.015e0"


_SPANS = """
c as (select cast(floor(c_custkey / 30) as int) as page_index, c_custkey as k, c_name, c_mktsegment, (c_custkey % 53) * 10e0 as x, (c_custkey % 71) * 10e0 as y from customer)"""

ORACLE_SQL: dict[str, str] = {
    "entity_table": f"with {_PAIR} select side, page_index, id, kind, round(x, 6) as x, round(y, 6) as y, text, content_signature from entity",
    "radius_pairs": f"with {_PAIR} select o.page_index, o.kind, o.id as old_id, n.id as new_id, round(sqrt((o.x - n.x) * (o.x - n.x) + (o.y - n.y) * (o.y - n.y)), 6) as d from entity o join entity n on o.side = 'old' and n.side = 'new' and o.page_index = n.page_index and o.kind = n.kind where sqrt((o.x - n.x) * (o.x - n.x) + (o.y - n.y) * (o.y - n.y)) <= 0.018e0",
    "nearest_neighbours": f"with {_PAIR} select page_index, id, neighbour, cast(r as int) as rank, round(sqrt(q), 6) as d from (select *, row_number() over (partition by page_index, id order by cast(id <> neighbour as int), q, neighbour) as r from (select a.page_index, a.id, b.id as neighbour, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as q from entity a join entity b on a.side = 'old' and b.side = 'old' and a.page_index = b.page_index)) where r <= 7",
    "exact_candidates": f"with {_PAIR} select o.page_index, o.kind, o.id as old_id, n.id as new_id from entity o join entity n on o.side = 'old' and n.side = 'new' and o.page_index = n.page_index and o.kind = n.kind and o.content_signature = n.content_signature where sqrt((o.x + 0.01e0 - n.x) ** 2 + (o.y - 0.005e0 - n.y) ** 2) <= 0.0025e0",
    "unique_anchor_keys": f"with {_PAIR}, {_KEYS} select page_index, side, kind, anchor_key from uniq",
    "least_squares_fit": f"with {_PAIR}, {_KEYS}, pt as (select o.page_index, o.x as a, o.y as b, n.x as c, n.y as d from uniq o join uniq n on o.side = 'old' and n.side = 'new' and o.page_index = n.page_index and o.kind = n.kind and o.anchor_key = n.anchor_key), m as (select page_index, avg(a) as ma, avg(b) as mb, avg(c) as mc, avg(d) as md, count(*) as anchors from pt group by page_index), s as (select page_index, anchors, sum((a - ma) * (c - mc) + (b - mb) * (d - md)) as dot, sum((a - ma) * (d - md) - (b - mb) * (c - mc)) as crs, sum((a - ma) ** 2 + (b - mb) ** 2) as size from pt join m using (page_index) group by page_index, anchors) select page_index, anchors, round(sqrt(dot * dot + crs * crs) / size, 6) as scale, round(atan2(crs, dot), 6) as rotation from s where anchors >= 2",
    "text_categories": f"""with {_PAIR}, t as (select * from entity where kind = 'text' and side = 'old'), tok as (select *, {_TOKEN} as token, ((x0 + x1) / 2 >= 0.62e0 and (y0 + y1) / 2 >= 0.76e0) or (y0 + y1) / 2 >= 0.9e0 as title from t),
c as (select page_index, id, text, case when {_GDT} then 'GD&T' when regexp_matches(text, '(?i)\\b(REV|REVISION|ECN|ECO|CHANGE\\s+NOTICE)\\b') then 'REVISION' when {_NOTE} then 'NOTE'
  when not regexp_matches(text, '(?i)\\b(DRAWING|DWG|PAGE|PART|SCALE|SHEET|ZONE)\\b') and token <> '' and not (title and regexp_matches(token, '^\\d{{1,4}}$')) then 'DIMENSION' else 'OTHER' end as category from tok),
r as (select *, case when category in ('DIMENSION', 'GD&T') then true when category in ('NOTE', 'REVISION') then regexp_matches(upper(text), '\\b({_WORDS})\\b') else false end as relevant from c)
select page_index, id, category, relevant, case category when 'DIMENSION' then 'A measured requirement or tolerance changed.' when 'GD&T' then 'A GD&T control or datum-related requirement changed.'
  when 'NOTE' then case when relevant then 'The note contains an inspection-impact keyword.' else 'General note change has no configured inspection keyword.' end
  when 'REVISION' then case when relevant then 'Revision text describes a technical inspection impact.' else 'Administrative revision metadata is not itself inspectable.' end
  else 'Unclassified text change has no deterministic inspection rule.' end as reason from r""",
    "geometry_scores": f"with {_GEOMETRY} select page_index, old_id, new_id, score from scored",
    "clear_choices": f"with {_CAND} {_clear_sql('old_id', 'new_id', '0.02e0')}",
    "mutual_choices": f"with {_CAND} select a.* from ({_clear_sql('old_id', 'new_id', '0.01e0')}) a join ({_clear_sql('new_id', 'old_id', '0.01e0')}) b using (page_index, old_id, new_id)",
    "unambiguous_candidates": f"with {_CAND}, bo as ({_close_sql('old_id')}), bn as ({_close_sql('new_id')}) select page_index, old_id, new_id, score from cand anti join bo using (page_index, old_id) anti join bn using (page_index, new_id)",
    # Greedy choice by rounds: of the candidates left, those that come first for both their entities are taken.
    "greedy_pairs": f"""with recursive {_CAND}, ordered as (select page_index, old_id, new_id, score, row_number() over (partition by page_index order by score desc, d, old_id, new_id) as place from cand),
step as (select 0 as round, page_index, old_id, new_id, score, place, false as taken from ordered
  union all
  select * from (with open as (select * from step where not taken), marked as (select *, place = min(place) over (partition by page_index, old_id) and place = min(place) over (partition by page_index, new_id) as first from open),
    gone as (select page_index, old_id, new_id from marked where first)
    select round + 1, page_index, old_id, new_id, score, place, first from marked m where first or (not exists (select 1 from gone g where g.page_index = m.page_index and g.old_id = m.old_id) and not exists (select 1 from gone g where g.page_index = m.page_index and g.new_id = m.new_id))))
select page_index, old_id, new_id, score from step where taken""",
    "context_vectors": f"with {_PAIR}, o as (select *, (x1 - x0) * (y1 - y0) as area from entity where side = 'old'), six as (select * from (select a.page_index, a.id, b.kind, b.area, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d, row_number() over (partition by a.page_index, a.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.kind, b.x0, b.y0) as r from o a join o b on a.page_index = b.page_index and a.id <> b.id) where r <= 6) select page_index, id, round(avg(cast(kind = 'text' as double)), 6) as text_share, round(avg(d), 6) as mean_distance, round(stddev_pop(d) + avg(area), 6) as spread from six group by page_index, id",
    "merged_runs": f"with {_PAIR}, o as (select page_index, cast(floor(y0 * 20) as int) as band, x0 as lo, x1 as hi from entity where side = 'old'), f as (select *, case when lo > max(hi) over (partition by page_index, band order by lo, hi rows between unbounded preceding and 1 preceding) + 0.002e0 then 1 else 0 end as nw from o), g as (select *, sum(nw) over (partition by page_index, band order by lo, hi rows between unbounded preceding and current row) as island from f) select page_index, band, round(min(lo), 6) as lo, round(max(hi), 6) as hi, count(*) as members from g group by page_index, band, island",
    "fragment_roles": "select o_orderkey as k, ['prefix', 'feature', 'nominal', 'tolerance', 'qualifier', 'core', 'nominal', 'unit', 'other', 'core', 'other', 'gdt'][o_orderkey % 12 + 1] as role from orders",
    "extracted_texts": f"with {_SPANS}, s as (select *, c_name || ' ' || c_mktsegment as text, round((k % 3 + 10) / 792e0, 6) as font_size from c where k % 9 <> 0), t as (select *, substr(sha256(c_mktsegment || '|0|#0000ff|' || cast(font_size as varchar)), 1, 20) as style from s) select page_index, text, lower(text) as text_normalized, c_mktsegment as font_name, font_size, style as style_signature, substr(sha256('text|' || text || '|' || style), 1, 20) as content_signature, round(x / 612, 6) as x0, round(y / 792, 6) as y0, round(least(1e0, (x + 80) / 612), 6) as x1, round(least(1e0, (y + 12) / 792), 6) as y1, round((y / 792 + least(1e0, (y + 12) / 792)) / 2, 6) as anchor_y from t",
    "page_inventory": f"""with {_SPANS}, rects as (select page_index, 'i' as what, greatest(0e0, x - 40) as x0, greatest(0e0, y - 40) as y0, least(612e0, x + 160) as x1, least(792e0, y + 200) as y1 from c where k % 4 = 0 union all select page_index, 's', x, y, least(612e0, x + 80), least(792e0, y + 12) from c where k % 9 <> 0),
edge as (select distinct page_index, what, unnest([x0, x1]) as l from rects), slab as (select *, lead(l) over (partition by page_index, what order by l) as r from edge),
cover as (select s.page_index, s.what, s.l, s.r, b.y0, b.y1, max(b.y1) over (partition by s.page_index, s.what, s.l order by b.y0, b.y1 rows between unbounded preceding and 1 preceding) as before from slab s join rects b on s.page_index = b.page_index and s.what = b.what and b.x0 <= (s.l + s.r) / 2 and (s.l + s.r) / 2 <= b.x1 and b.y1 > b.y0 where s.r > s.l),
area as (select page_index, what, sum(greatest(0e0, y1 - greatest(y0, coalesce(before, y0))) * (r - l)) / (612e0 * 792e0) as a from cover group by page_index, what),
n as (select page_index, count(*) filter (where k % 9 <> 0) as text_span_count, count(*) filter (where k % 4 = 0) as image_count from c group by page_index),
j as (select n.*, coalesce(i.a, 0) as ia, coalesce(s.a, 0) as sa from n left join area i on n.page_index = i.page_index and i.what = 'i' left join area s on n.page_index = s.page_index and s.what = 's')
select page_index, text_span_count, image_count, round(ia, 5) as image_cover, round(sa, 5) as structured_cover, image_count > 0 and (text_span_count = 0 or ia >= 0.85e0 and (text_span_count <= 5 or sa <= 0.02e0)) as effectively_scanned from j""",
    "covered_area": f"with {_PAIR}, old_box as (select * from entity where side = 'old'), {_area_sql('old_box', 'page_index')}",
    "duplicate_ordinals": f"with {_PAIR}, n as (select *, row_number() over (partition by page_index, content_signature order by kind, x0, y0, x1, y1) - 1 as n from entity where side = 'old') select page_index, id, content_signature || case when n > 0 then '-' || cast(n as varchar) else '' end as numbered from n",
    "text_digests": "with p as (select p_partkey, trim(regexp_replace(p_name || '  ' || p_type, '\\s+', ' ', 'g')) as text, p_size from part) select p_partkey, text, substr(sha256('text|' || text || '|' || cast(p_size as varchar)), 1, 20) as content_signature, substr(sha256('text|' || text || '|' || cast(p_size as varchar)), 1, 16) as short from p",
    "document_gate": """with d as (select s_suppkey as k, 'f' || cast(s_suppkey as varchar) || case when s_suppkey % 7 = 0 then '.txt' else '.PDF' end as name, case when s_suppkey % 11 = 0 then 0 when s_suppkey % 13 = 0 then 209715200 else s_suppkey * 1000 end as size, s_suppkey % 5 = 0 as bad_header from supplier),
e as (select k, name, case when k % 7 = 0 then ' is not a PDF. Only .pdf files are supported.' when size = 0 then ' is empty.' when size > 104857600 then ' exceeds the 100 MB size limit.' when bad_header then ' does not have a valid PDF header.' when k % 17 = 0 then ' is password protected.' when k % 4 < 1 then ' has no pages.' end as why from d)
select cast(k as varchar) as document, case when why is not null then 'invalid' end as error_code, '''' || name || '''' || why as error from e""",
    "filtered_changes": f"with {_LIST} select cast(page_index + 1 as varchar) as page, change_type as type, category, 'Yes' as relevant, label || ' ' || id as label, label || ' changed.' as detail, coalesce(tier, 'unmatched') as tier, coalesce(format('{{:.3f}}', score), 'N/A') as score, 'reason' as reason from change where relevant and change_type in ('added', 'moved') and category in ('DIMENSION', 'NOTE', 'GEOMETRY') and contains(lower(label), 'urgent')",
    "change_summary": f"""with {_LIST}, m as (select pair_id, avg(f) as mean from (select pair_id, page_index, count(*) / 100000e0 as f from change group by all) group by pair_id),
n as (select pair_id, count(*) as changes, count(*) filter (where relevant) as rel, string_agg(t, ', ' order by pos) as types from (select pair_id, change_type, relevant, null as t, null as pos from change) group by pair_id),
ty as (select pair_id, string_agg(cast(c as varchar) || ' ' || change_type, ', ' order by list_position(['added', 'removed', 'moved', 'modified'], change_type)) as types from (select pair_id, change_type, count(*) as c from change group by all) group by pair_id),
ca as (select pair_id, string_agg(cast(c as varchar) || ' ' || category, ', ' order by category) as cats from (select pair_id, category, count(*) as c from change where relevant group by all) group by pair_id)
select pair_id, changes, rel as relevant, 'Detected ' || changes || ' structured changes: ' || ty.types || '. ' || rel || ' are inspection-relevant (' || cats || '). Change boxes cover ' || format('{{:.2f}}', mean * 100) || '% of the average compared page area.' as summary from n join m using (pair_id) join ty using (pair_id) join ca using (pair_id)""",
    "counts_by_type": f"with {_LIST}, f as (select * from change where change_type <> 'moved' or pair_id <> '3'), t as (select distinct pair_id, ty as change_type from change, (select unnest(['added', 'removed', 'moved', 'modified']) as ty)) select pair_id, change_type, count(f.id) as changes from t left join f using (pair_id, change_type) group by all",
    "page_affected_area": f"with {_LIST}, {_area_sql('change', 'pair_id, page_index')}",
} | made_queries.ORACLE_SQL
