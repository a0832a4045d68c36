"""A whole comparison of any number of revision pairs: tables in, tables out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Cancelled, RegistrationError
from ..operators.alignment import NOTES, PAGE, align
from ..operators.callouts import reconstruct
from ..operators.changes import change_counts, derive, interpret, page_areas, summaries
from ..operators.extraction import extract
from ..operators.matching import match_entities
from ..operators.validation import page_capabilities, validate
from ..session import materialize, release
from ..settings import ANALYSIS_MODE, DEFAULTS, ENGINE_VERSION, Settings
from ..sources.tables import RawTables

Progress = Callable[[str, float, str], None]


@dataclass
class Comparison:
    """Result tables: one row per pair, per page of either side, and per change."""

    comparisons: DataFrame
    pages: DataFrame
    changes: DataFrame
    alignments: DataFrame
    matches: DataFrame
    entities: DataFrame

    @property
    def relevant_changes(self) -> DataFrame:
        return self.changes.where("inspection_relevant")

    @property
    def counts(self) -> DataFrame:
        return change_counts(self.changes, self.comparisons)


class Steps:
    """Reports stages as they begin, and stops between them when asked to."""

    def __init__(self, progress: Progress | None, cancelled: Callable[[], bool] | None):
        self.progress, self.cancelled = progress, cancelled

    def begin(self, stage: str, fraction: float, message: str) -> None:
        if self.cancelled and self.cancelled():
            raise Cancelled("Comparison cancelled.")
        if self.progress:
            self.progress(stage, max(0.0, min(1.0, fraction)), message)


def page_notes(capabilities: DataFrame) -> DataFrame:
    """(pair_id, page_index, notes) from what each side's page holds, old before new."""
    role = F.initcap("side")
    page = (F.col("page_index") + 1).cast("string")
    text_only = F.when((F.col("text_span_count") > 0) & (F.col("drawing_count") == 0), F.concat(role, F.lit(" page "), page, F.lit(" has a text layer but no vector paths; only text can be compared.")))
    images = F.when(F.col("image_count") > 0, F.concat(role, F.lit(" page "), page, F.lit(" contains "), F.col("image_count").cast("string"), F.lit(" embedded image object(s); they were ignored because image comparison is disabled.")))
    rows = capabilities.select(*PAGE, F.struct((F.col("side") == "new").alias("k"), F.array_compact(F.array(text_only, images)).alias("notes")).alias("s"))
    return rows.groupBy(*PAGE).agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["notes"])).alias("notes"))


def compare_entities(entities: DataFrame, settings: Settings = DEFAULTS, *, pages: DataFrame | None = None, strict: bool = True, callouts: bool = True, steps: Steps | None = None) -> Comparison:
    """Compares an entity table. pages: (pair_id, side, page_index, width, height, notes is optional); default: those with entities.

    A pair with a page that cannot be registered has status failed and no changes; strict raises instead.
    """
    steps = steps or Steps(None, None)
    entities = materialize(entities)
    sides = (entities.select(*PAGE, "side").distinct().withColumns({"width": F.lit(0.0), "height": F.lit(0.0)}) if pages is None else pages.select(*PAGE, "side", "width", "height"))
    size = lambda side, name: F.coalesce(F.max(F.when(F.col("side") == side, F.col(name))), F.lit(0.0)).alias(f"{side}_{name}")
    present = sides.groupBy(*PAGE).agg(*(size(s, n) for s in ("old", "new") for n in ("width", "height")), F.max((F.col("side") == "old").cast("int")).alias("in_old"), F.max((F.col("side") == "new").cast("int")).alias("in_new"))
    steps.begin("alignment", 0.3, "Aligning pages")
    aligned = align(entities, settings)
    identity = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("rotation"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    single = (F.col("in_old") == 0) | (F.col("in_new") == 0)
    alignments = materialize(
        present.join(aligned, PAGE, "left").select(
            *PAGE,
            F.when(single, "not-applicable").otherwise(F.coalesce("status", F.lit("identity-unverified"))).alias("status"),
            F.when(single, identity).otherwise(F.coalesce("transform", identity)).alias("transform"),
            *(F.coalesce(F.when(~single, F.col(c)), F.lit(0)).alias(c) for c in ("anchor_count", "inlier_count")),
            *(F.coalesce(F.when(~single, F.col(c)), F.lit(0.0)).alias(c) for c in ("inlier_ratio", "rms_residual")),
            F.when(single, NOTES["single"]).otherwise(F.coalesce("note", F.lit(NOTES["blank"]))).alias("note"),
        )
    )
    failed = alignments.where("status = 'failed'")
    if strict and (bad := failed.orderBy(*PAGE).first()):
        raise RegistrationError(f"Page {bad.page_index + 1} could not be aligned reliably. Confirm that both files are revisions of the same drawing sheet.")
    lost = failed.select("pair_id").distinct()
    # By page, since a pair may hold all rows; not at all where nothing is lost.
    usable = entities if failed.isEmpty() else entities.join(alignments.join(lost, "pair_id", "left_semi").select(*PAGE), PAGE, "left_anti")
    steps.begin("matching", 0.5, "Tier-matching pages")
    rebuilt = materialize(reconstruct(usable, settings)) if callouts else usable  # else each use of it would run the grammar again
    found = match_entities(rebuilt, alignments, settings)
    if rebuilt is not usable:
        release(rebuilt)
    steps.begin("changes", 0.8, "Interpreting changes")
    changes = materialize(interpret(derive(found, alignments, settings), found.entities, settings))
    counts = entities.groupBy(*PAGE).agg(F.count_if(F.col("side") == "old").alias("entity_count_old"), F.count_if(F.col("side") == "new").alias("entity_count_new"))
    notes = pages.select(*PAGE, "notes").dropDuplicates(PAGE) if pages is not None and "notes" in pages.columns else alignments.select(*PAGE, F.array().cast("array<string>").alias("notes"))
    page_rows = (
        alignments.join(present.drop("in_old", "in_new"), PAGE).join(counts, PAGE, "left").join(page_areas(changes), PAGE, "left").join(notes, PAGE, "left")
        .select(*PAGE, *(f"{s}_{n}" for s in ("old", "new") for n in ("width", "height")), F.struct("status", "transform", "anchor_count", "inlier_count", "inlier_ratio", "rms_residual", "note").alias("alignment"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("entity_count_old", "entity_count_new")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("affected_area_fraction", "relevant_area_fraction")), F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.col("note") != "", F.col("note"))))).alias("notes"))
    )
    page_rows = materialize(page_rows)
    n_pages = sides.groupBy("pair_id").agg(F.count_distinct(F.when(F.col("side") == "old", F.col("page_index"))).alias("n_old"), F.count_distinct(F.when(F.col("side") == "new", F.col("page_index"))).alias("n_new"))
    differ = F.when(F.col("n_old") != F.col("n_new"), F.concat(F.lit("Page counts differ ("), F.col("n_old").cast("string"), F.lit(" old vs "), F.col("n_new").cast("string"), F.lit(" new); extra pages are treated as wholly removed or added.")))
    comparisons = n_pages.join(summaries(changes, page_rows), "pair_id", "left").join(lost.withColumn("lost", F.lit(True)), "pair_id", "left")
    comparisons = comparisons.select("pair_id", F.when(F.col("lost"), "failed").otherwise("complete").alias("status"), F.when(F.col("lost"), "alignment").alias("error_code"), "changes", "relevant", "mean_affected_area_fraction", F.when(F.col("lost"), NOTES["failed"]).otherwise(F.col("summary")).alias("summary"), F.array_compact(F.array(differ)).alias("notes"), F.lit(ENGINE_VERSION).alias("engine_version"), F.lit(ANALYSIS_MODE).alias("analysis_mode"))
    steps.begin("complete", 1.0, "Comparison complete")
    return Comparison(comparisons, page_rows, changes, alignments, found.matches, found.entities)


def compare(raw: RawTables, settings: Settings = DEFAULTS, *, strict: bool = True, ascii_only: bool = False, progress: Progress | None = None, cancelled: Callable[[], bool] | None = None) -> Comparison:
    """Validates, extracts, registers, reconstructs, matches and reports every pair. Not strict: failing pairs become rows with a status."""
    steps = Steps(progress, cancelled)
    steps.begin("validation", 0.01, "Validating document structure")
    capabilities = materialize(page_capabilities(raw.pages, raw.spans, raw.drawings, raw.images, settings))
    checked = validate(raw.documents, capabilities, settings, strict)
    rejected = materialize(checked.where("error_code is not null").select("pair_id", "side", "error_code", "error"))
    bad = rejected.select("pair_id").distinct()
    good = lambda df: df.join(bad, "pair_id", "left_anti")
    steps.begin("extraction", 0.05, "Extracting pages")
    entities = extract(good(raw.spans), good(raw.drawings), good(raw.pages), ascii_only)
    pages = good(raw.pages).join(page_notes(capabilities), PAGE, "left")
    out = compare_entities(entities, settings, pages=pages, strict=strict, steps=steps)
    names = raw.documents.groupBy("pair_id").agg(F.max(F.when(F.col("side") == "old", F.col("file_name"))).alias("old_file"), F.max(F.when(F.col("side") == "new", F.col("file_name"))).alias("new_file"))
    errors = rejected.groupBy("pair_id").agg(F.min_by("error_code", "side").alias("why"), F.min_by("error", "side").alias("what"))
    rows = names.join(out.comparisons, "pair_id", "left").join(errors, "pair_id", "left")
    out.comparisons = rows.select("pair_id", "old_file", "new_file", F.coalesce("status", F.lit("rejected")).alias("status"), F.coalesce("why", "error_code").alias("error_code"), F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("relevant", F.lit(0)).alias("relevant"), "mean_affected_area_fraction", F.coalesce("what", "summary").alias("summary"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), F.lit(ENGINE_VERSION).alias("engine_version"), F.lit(ANALYSIS_MODE).alias("analysis_mode"))
    return out
