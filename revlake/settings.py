"""Thresholds of a comparison, in page coordinates from 0 to 1, passed explicitly to every operator."""

from __future__ import annotations

from dataclasses import dataclass

# The tiers, change types and categories of the data model.
KINDS = ("geometry", "text")
CHANGE_TYPES = ("added", "removed", "moved", "modified")
TIERS = ("exact", "attribute", "structural")
CATEGORIES = ("DIMENSION", "GD&T", "NOTE", "REVISION", "GEOMETRY", "OTHER")
ENGINE_VERSION = "0.2.0"
ANALYSIS_MODE = "vector-and-text-entities-only"

# Words that make a note or a revision relevant to inspection, and those that are administrative.
INSPECTION_WORDS = "ACCEPT CHAMFER CHECK CLEAN COATING CRITICAL DIAMETER FINISH FLATNESS HARDNESS INSPECT MATERIAL MEASURE PARALLEL PERPENDICULAR POSITION PROFILE ROUGHNESS SURFACE THREAD TOLERANCE TORQUE VERIFY WELD".split()
ADMINISTRATIVE_WORDS = "APPROVED CHECKED DATE DRAWN ISSUED RELEASED REV REVISION".split()


@dataclass(frozen=True)
class Settings:
    """All tunable values; the defaults are fixed values of the engine."""

    # documents
    max_file_mb: int = 100
    scanned_image_coverage: float = 0.85
    scanned_max_entities: int = 5
    scanned_structured_coverage: float = 0.02
    # registration
    inlier_tolerance: float = 0.006
    min_inlier_ratio: float = 0.55
    max_rms: float = 0.004
    max_hypotheses: int = 400
    max_origin_shift: float = 0.15
    # matching
    exact_radius: float = 0.0025
    attribute_radius: float = 0.018
    structural_radius: float = 0.16
    moved_distance: float = 0.006
    attribute_score: float = 0.58
    structural_score: float = 0.68
    glyph_extent: float = 0.035
    glyph_primitives: int = 12
    sparse_from: int = 1200
    # callout grammar
    inline_gap: float = 2.75
    baseline: float = 0.55
    stacked_gap: float = 2.25
    pair_alignment: float = 0.75
    limit_ratio: float = 0.75
    hypothesis_margin: float = 0.20
    # frames
    frame_edge: float = 0.003
    connect: float = 0.0002
    frame_min_height: float = 0.003
    cell_min_width: float = 0.002
    frame_max_height: float = 0.08
    frame_max_width: float = 0.55
    frame_max_cells: int = 12
    feature_min_fill: float = 0.15
    feature_max_fill: float = 0.92
    feature_max_offset: float = 0.25
    # leaders
    leader_touch: float = 1.25
    attachment_margin: float = 0.35
    attachment_match: float = 0.035
    match_margin: float = 0.055
    # interpretation
    annotation_radius: float = 0.035
    title_x: float = 0.62
    title_y: float = 0.76
    preview_dpi: int = 125


DEFAULTS = Settings()
