"""Gate of documents, and the inventory of their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidDocument, RasterDocument
from ..settings import DEFAULTS, Settings
from .areas import union_area
from .extraction import DOCUMENT_PAGE, VALIDATION_WHITE, visible_paint

DOCUMENT = ["pair_id", "side"]


def visible_spans(spans: DataFrame) -> DataFrame:
    return spans.where((F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")) != "") & (F.col("alpha").isNull() | (F.col("alpha") > 0)))


def visible_drawings(drawings: DataFrame) -> DataFrame:
    return drawings.where(visible_paint(F.col("color"), F.col("fill"), F.col("stroke_opacity"), F.col("fill_opacity"), VALIDATION_WHITE))


def page_capabilities(pages: DataFrame, spans: DataFrame, drawings: DataFrame, images: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per page: counts, covered fractions, effectively_scanned, has_vector_or_text and has_only_raster_content."""
    text, paths = visible_spans(spans), visible_drawings(drawings)
    count = lambda df, name: df.groupBy(*DOCUMENT_PAGE).agg(F.count("*").alias(name))
    structured = text.select(*DOCUMENT_PAGE, "bbox").unionByName(paths.where("rect is not null").select(*DOCUMENT_PAGE, F.col("rect").alias("bbox")))

    def covered(df: DataFrame, name: str) -> DataFrame:
        sized = df.join(pages.select(*DOCUMENT_PAGE, "width", "height"), DOCUMENT_PAGE)
        return union_area(sized, [*DOCUMENT_PAGE, "width", "height"], clip=(F.col("width"), F.col("height"))).select(*DOCUMENT_PAGE, F.col("area").alias(name))

    out = pages
    for part in (count(text, "text_span_count"), count(paths, "drawing_count"), count(images, "image_count"), covered(images, "image_area"), covered(structured, "structured_area")):
        out = out.join(part, DOCUMENT_PAGE, "left")
    size = F.greatest(F.col("width") * F.col("height"), F.lit(1e-9))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select(*DOCUMENT_PAGE, "width", "height", *(zero(c).alias(c) for c in ("drawing_count", "text_span_count", "image_count")), (zero("image_area") / size).alias("image_cover"), (zero("structured_area") / size).alias("structured_cover"))
    entities = F.col("text_span_count") + F.col("drawing_count")
    dominant = (F.col("image_cover") >= settings.scanned_image_coverage) & ((entities <= settings.scanned_max_entities) | (F.col("structured_cover") <= settings.scanned_structured_coverage))
    scanned = (F.col("image_count") > 0) & ((entities == 0) | dominant)
    return out.select(
        *DOCUMENT_PAGE, "width", "height", "drawing_count", "text_span_count", "image_count",
        F.round("image_cover", 8).alias("image_coverage_fraction"), F.round("structured_cover", 8).alias("structured_coverage_fraction"),
        scanned.alias("effectively_scanned"), (entities > 0).alias("has_vector_or_text"), ((F.col("image_count") > 0) & (entities == 0)).alias("has_only_raster_content"),
    )


def validate(documents: DataFrame, capabilities: DataFrame, settings: Settings = DEFAULTS, strict: bool = False) -> DataFrame:
    """documents (pair_id, side, file_name, size_bytes, header, encrypted, page_count) with error_code and error.

    The first rule that fails names the error; null where the document is acceptable. strict: raise the first error.
    """
    scanned = capabilities.where("effectively_scanned").groupBy(*DOCUMENT).agg(F.array_sort(F.collect_list(F.col("page_index") + 1)).alias("scanned"))
    d = documents.join(scanned, DOCUMENT, "left")
    name = F.concat(F.lit("'"), "file_name", F.lit("'"))
    shown = F.concat(F.array_join(F.slice(F.col("scanned").cast("array<string>"), 1, 8), ", "), F.when(F.size("scanned") > 8, "...").otherwise(""))
    rules = [
        (~F.lower("file_name").endswith(".pdf"), "invalid", F.concat(name, F.lit(" is not a PDF. Only .pdf files are supported."))),
        (F.col("size_bytes").isNull(), "invalid", F.concat(F.lit("PDF not found: "), "file_name")),
        (F.col("size_bytes") == 0, "invalid", F.concat(name, F.lit(" is empty."))),
        (F.col("size_bytes") > settings.max_file_mb * 1024 * 1024, "invalid", F.concat(name, F.lit(f" exceeds the {settings.max_file_mb} MB size limit."))),
        (~F.col("header").startswith("%PDF-"), "invalid", F.concat(name, F.lit(" does not have a valid PDF header."))),
        (F.col("page_count").isNull(), "invalid", F.concat(F.lit("Could not open "), name)),
        (F.coalesce("encrypted", F.lit(False)), "invalid", F.concat(name, F.lit(" is password protected."))),
        (F.col("page_count") < 1, "invalid", F.concat(name, F.lit(" has no pages."))),
        (F.col("scanned").isNotNull(), "raster", F.concat(name, F.lit(" contains effectively scanned page(s) "), shown, F.lit("."))),
    ]
    code, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, kind, text in reversed(rules):
        code, message = F.when(test, kind).otherwise(code), F.when(test, text).otherwise(message)
    out = d.withColumns({"error_code": code, "error": message}).drop("scanned")
    if strict and (bad := out.where("error_code is not null").orderBy("pair_id", "side").first()):
        raise (RasterDocument if bad.error_code == "raster" else InvalidDocument)(bad.error)
    return out


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, size_bytes and header of files, for the gate: only the first five bytes of content are kept.

    Spark's reader lists no empty files, so a document that has no row here is missing or empty.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size_bytes"), F.decode(F.substring("content", 1, 5), "ISO-8859-1").alias("header"))
