"""Registration of a page's two revisions: anchors by joins on unique keys, then a robust similarity fit per page."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ..settings import DEFAULTS, Settings

PAGE = ["pair_id", "page_index"]
TRANSFORM = "struct<scale:double,rotation:double,tx:double,ty:double>"
ALIGNMENT = f"pair_id string, page_index int, status string, transform {TRANSFORM}, anchor_count int, inlier_count int, inlier_ratio double, rms_residual double, note string"

# What an alignment reports.
NOTES = {
    "none": "No unique stable anchors were available; the page frames were overlaid without registration.",
    "one": "Only one unique anchor was available, so its translation could not be verified; the page frames were overlaid without registration.",
    "no_fit": "Stable anchors existed, but no valid similarity transform could be fitted.",
    "aligned": "Alignment accepted from deterministic vector/text anchors.",
    "failed": "The drawings could not be registered reliably; comparison was declined.",
    "blank": "One or both pages are blank; alignment is not applicable.",
    "single": "Page exists in only one revision; all structured entities are page additions/removals.",
}


def keyed_anchors(entities: DataFrame) -> DataFrame:
    """Entities that have an anchor key: text of two characters or more, or a shape."""
    return entities.select(*PAGE, "side", "kind", F.when(F.col("kind") == "text", F.when(F.length("text_normalized") >= 2, F.col("text_normalized"))).otherwise(F.col("shape_signature")).alias("anchor_key"), "anchor").where("anchor_key is not null and anchor_key <> ''")


def unique_keys(entities: DataFrame) -> DataFrame:
    """Entities whose anchor key occurs once on their page and side."""
    return keyed_anchors(entities).groupBy(*PAGE, "side", "kind", "anchor_key").agg(F.count("*").alias("n"), F.first("anchor").alias("anchor")).where("n = 1").drop("n")


def anchor_pairs(entities: DataFrame) -> DataFrame:
    """(pair_id, page_index, kind, anchor_key, old, new) of keys unique on both sides."""
    once = lambda side: F.count_if(F.col("side") == side) == 1
    place = lambda side: F.first(F.when(F.col("side") == side, F.col("anchor")), ignorenulls=True)
    both = keyed_anchors(entities).groupBy(*PAGE, "kind", "anchor_key").agg(place("old").alias("old"), place("new").alias("new"), (once("old") & once("new")).alias("__once"))
    return both.where("__once").drop("__once")


@lru_cache(64)
def hypotheses(count: int, limit: int) -> np.ndarray:
    """Index pairs to fit exactly: all, or a cycle through the anchors and seeded random pairs up to the limit.

    Any strict majority of anchors holds two neighbours of the cycle, so an acceptable fit is always tried.
    """
    if count * (count - 1) // 2 <= limit:
        return np.array([(i, j) for i in range(count) for j in range(i + 1, count)], np.int64)
    chosen = {(min(i, (i + 1) % count), max(i, (i + 1) % count)) for i in range(count)}
    draw = random.Random(0xCAD5EED)
    goal = min(count * (count - 1) // 2, max(limit, count))
    while len(chosen) < goal:
        chosen.add(tuple(sorted(draw.sample(range(count), 2))))
    return np.array(sorted(chosen), np.int64)


def residuals(old: np.ndarray, new: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Distances of moved old points to new ones; fit: rows of scale, rotation, tx, ty. Shape (fits, points)."""
    s, r, tx, ty = (fit[:, i : i + 1] for i in range(4))
    c, d = s * np.cos(r), s * np.sin(r)
    return np.hypot(c * old[:, 0] - d * old[:, 1] + tx - new[:, 0], d * old[:, 0] + c * old[:, 1] + ty - new[:, 1])


def least_squares(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Similarity of least squares in closed form from centred sums of dot and cross products."""
    o, n = old - old.mean(0), new - new.mean(0)
    dot, cross = float((o * n).sum()), float((o[:, 0] * n[:, 1] - o[:, 1] * n[:, 0]).sum())
    size = float((o * o).sum())
    moment = o.T @ n
    det = float(np.linalg.det(moment))
    length = np.hypot(dot, cross) if det >= 0 else np.sqrt(float((moment**2).sum()) + 2 * abs(det))
    scale = length / size if size > 1e-12 else 1.0
    rotation = np.arctan2(cross, dot)
    c, s = np.cos(rotation), np.sin(rotation)
    shift = new.mean(0) - scale * np.array([c * old.mean(0)[0] - s * old.mean(0)[1], s * old.mean(0)[0] + c * old.mean(0)[1]])
    return np.array([scale, rotation, *shift])


def least_squares_fits(pairs: DataFrame) -> DataFrame:
    """(pair_id, page_index, anchors, transform): the similarity of least squares of all anchor pairs of a page, two at least."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["kind", "anchor_key"], kind="stable")
        fit = least_squares(rows[["ox", "oy"]].to_numpy(float), rows[["nx", "ny"]].to_numpy(float))
        return pd.DataFrame([{"pair_id": rows["pair_id"].iloc[0], "page_index": rows["page_index"].iloc[0], "anchors": len(rows), "transform": dict(zip(("scale", "rotation", "tx", "ty"), map(float, fit), strict=True))}] if len(rows) > 1 else [], columns=["pair_id", "page_index", "anchors", "transform"])

    flat = pairs.select(*PAGE, "kind", "anchor_key", F.col("old.x").alias("ox"), F.col("old.y").alias("oy"), F.col("new.x").alias("nx"), F.col("new.y").alias("ny"))
    return flat.groupBy(*PAGE).applyInPandas(kernel, f"pair_id string, page_index int, anchors long, transform {TRANSFORM}")


def fit_page(old: np.ndarray, new: np.ndarray, settings: Settings = DEFAULTS) -> dict:
    """Status and transform from matched anchors, in their canonical order."""
    identity = (1.0, 0.0, 0.0, 0.0)
    n = len(old)
    if n < 2:
        return dict(status="identity-unverified", transform=identity, anchor_count=n, inlier_count=0, inlier_ratio=0.0, rms_residual=0.0, note=NOTES["one" if n else "none"])
    pairs = hypotheses(n, settings.max_hypotheses)
    a, b = pairs[:, 0], pairs[:, 1]
    do, dn = old[b] - old[a], new[b] - new[a]
    lo, ln = np.hypot(*do.T), np.hypot(*dn.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = ln / lo
    good = (lo >= 1e-8) & (ln >= 1e-8) & (scale >= 0.5) & (scale <= 2.0)
    a, scale = a[good], scale[good]
    rotation = np.arctan2(dn[good, 1], dn[good, 0]) - np.arctan2(do[good, 1], do[good, 0])
    c, s = scale * np.cos(rotation), scale * np.sin(rotation)
    fits = np.stack([scale, rotation, new[a, 0] - (c * old[a, 0] - s * old[a, 1]), new[a, 1] - (s * old[a, 0] + c * old[a, 1])], 1)
    best, best_rank = None, (1, -np.inf, -np.inf)
    for at in range(0, len(fits), 256):
        r = residuals(old, new, fits[at : at + 256])
        within = r <= settings.inlier_tolerance
        count = within.sum(1)
        for k in np.flatnonzero(count >= max(2, best_rank[0], count.max())):  # of fits with fewer inliers none is the best
            rank = (int(count[k]), -float(np.sqrt(np.mean(r[k][within[k]] ** 2))), -abs(fits[at + k][0] - 1))
            if rank > best_rank:
                best, best_rank = np.flatnonzero(within[k]), rank
    if best is None:
        return dict(status="failed", transform=identity, anchor_count=n, inlier_count=0, inlier_ratio=0.0, rms_residual=0.0, note=NOTES["no_fit"])
    for _ in range(2):
        fit = least_squares(old[best], new[best])
        row = residuals(old, new, fit[None])[0]
        inside = np.flatnonzero(row <= settings.inlier_tolerance)
        if len(inside) < 2:
            break
        best = inside
    rms = float(np.sqrt(np.mean(row[inside] ** 2))) if len(inside) else float("inf")
    share = len(inside) / n
    accepted = share >= settings.min_inlier_ratio and rms <= settings.max_rms
    out = dict(anchor_count=n, inlier_count=len(inside), inlier_ratio=round(share, 6))
    if accepted and max(abs(fit[2]), abs(fit[3])) > settings.max_origin_shift:
        note = f"Anchor alignment would move the page origin {abs(fit[2]) * 100:.2f}% horizontally and {abs(fit[3]) * 100:.2f}% vertically, beyond the configured {settings.max_origin_shift * 100:.2f}% limit; the page frames were overlaid without registration."
        return out | dict(status="identity-unverified", transform=identity, rms_residual=round(rms, 8), note=note)
    return out | dict(status="aligned" if accepted else "failed", transform=tuple(map(float, fit)) if accepted else identity, rms_residual=round(rms, 8) if np.isfinite(rms) else 1.0, note=NOTES["aligned" if accepted else "failed"])


def align(entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per page of either side: status, transform and figures. Only anchors go to Python, page by page."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "anchor_key"], kind="stable")
        got = fit_page(pdf[["ox", "oy"]].to_numpy(float), pdf[["nx", "ny"]].to_numpy(float), settings)
        got["transform"] = dict(zip(("scale", "rotation", "tx", "ty"), got["transform"], strict=True))
        return pd.DataFrame([{"pair_id": pdf["pair_id"].iloc[0], "page_index": pdf["page_index"].iloc[0], **got}])

    anchors = anchor_pairs(entities).select(*PAGE, (F.col("kind") != "text").cast("int").alias("rank"), "anchor_key", F.col("old.x").alias("ox"), F.col("old.y").alias("oy"), F.col("new.x").alias("nx"), F.col("new.y").alias("ny"))
    fitted = spread(anchors, PAGE).groupBy(*PAGE).applyInPandas(kernel, ALIGNMENT)
    pages = entities.groupBy(*PAGE).agg(F.count_if(F.col("side") == "old").alias("n_old"), F.count_if(F.col("side") == "new").alias("n_new"))
    identity = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("rotation"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    both = (F.col("n_old") > 0) & (F.col("n_new") > 0)
    return pages.join(fitted, PAGE, "left").select(
        *PAGE,
        F.coalesce("status", F.lit("identity-unverified")).alias("status"),
        F.coalesce("transform", identity).alias("transform"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("anchor_count", "inlier_count")),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("inlier_ratio", "rms_residual")),
        F.coalesce("note", F.when(both, NOTES["none"]).otherwise(NOTES["blank"])).alias("note"),
    )
