"""The comparison engine on small drawings, against brute force where a rule has one."""

from __future__ import annotations

import csv
import itertools
import json
import math
from dataclasses import replace

import numpy as np
import pytest
from drawings import Drawing, box, plate, tables, xy
from pyspark.sql import functions as F

from revlake.errors import Cancelled, InvalidDocument, RasterDocument, RegistrationError
from revlake.operators import assignment, callouts
from revlake.operators.callouts import Item, reconstruct_page
from revlake.plans.compare import compare, compare_entities
from revlake.settings import DEFAULTS


@pytest.fixture(scope="module")
def plate_result(spark):
    return compare(tables(spark, plate("old", False), plate("new", True)))


def test_plate_golden(plate_result):
    rows = plate_result.changes.collect()
    by = {c: sum(r.category == c for r in rows) for c in {r.category for r in rows}}
    assert by == {"DIMENSION": 1, "GD&T": 1, "NOTE": 1, "REVISION": 1, "GEOMETRY": 2}
    assert sum(r.inspection_relevant for r in rows) == 5
    assert [r.inspection_relevant for r in rows if r.category == "REVISION"] == [False]
    assert all(r.id.startswith("chg-") and len(r.id) == 18 for r in rows)
    one = plate_result.comparisons.first()
    assert one.summary.startswith("Detected 6 structured changes: 1 added, 5 modified. 5 are inspection-relevant (1 DIMENSION, 1 GD&T, 2 GEOMETRY, 1 NOTE).")
    assert {r.change_type: r.changes for r in plate_result.counts.collect()} == {"added": 1, "removed": 0, "moved": 0, "modified": 5}
    assert plate_result.pages.first().alignment.status == "aligned"


def test_identical_revisions_have_no_changes(spark):
    r = compare(tables(spark, plate("old", False), plate("new", False)))
    assert r.changes.count() == 0 and r.comparisons.first().summary == "No structured vector or text-layer differences were detected."


def test_extra_page_is_added_and_notes(spark):
    new = plate("new", False)
    new.pages = 2
    new.text(100, 100, "SECOND PAGE", page=1)
    r = compare(tables(spark, plate("old", False), new))
    pages = {p.page_index: p for p in r.pages.collect()}
    assert pages[1].alignment.status == "not-applicable" and pages[1].entity_count_old == 0
    assert [c.change_type for c in r.changes.collect()] == ["added"]
    assert "Page counts differ" in r.comparisons.first().notes[0]
    assert any("text layer but no vector paths" in n for n in pages[1].notes)


def test_gate(spark):
    def error(**kw):
        with pytest.raises(InvalidDocument) as e:
            compare(tables(spark, plate("old", False), plate("new", False), **kw))
        return str(e.value)

    assert "is not a PDF" in error(file_name="a.dwg")
    assert "is empty" in error(size_bytes=0)
    assert "100 MB" in error(size_bytes=200 * 1024 * 1024)
    assert "header" in error(header="PK123")
    assert "password" in error(encrypted=True)
    assert "no pages" in error(page_count=0)
    scan = Drawing("scan", "old").image(0, 0, 792, 612)
    with pytest.raises(RasterDocument):
        compare(tables(spark, scan, Drawing("scan", "new").image(0, 0, 792, 612)))
    lax = compare(tables(spark, scan, Drawing("scan", "new").image(0, 0, 792, 612), plate("old", False), plate("new", True)), strict=False)
    status = {r.pair_id: (r.status, r.error_code, r.changes) for r in lax.comparisons.collect()}
    assert status == {"scan": ("rejected", "raster", 0), "plate": ("complete", None, 6)}


def test_scanned_pages_need_dominant_image(spark):
    from revlake.operators.validation import page_capabilities

    d = Drawing("p", "old", 300, 200, pages=3).image(0, 0, 300, 200).text(10, 10, "stamp")
    d.image(0, 0, 100, 100, page=1).text(10, 50, "text", page=1).image(0, 0, 300, 200, page=2)
    for i in range(6):
        d.rect(0, 0, 290, 190, page=2)
    raw = tables(spark, d)
    got = {r.page_index: r for r in page_capabilities(raw.pages, raw.spans, raw.drawings, raw.images).collect()}
    assert [got[i].effectively_scanned for i in range(3)] == [True, False, False]
    assert math.isclose(got[1].image_coverage_fraction, 1 / 6, abs_tol=1e-6)


def test_hidden_and_white_content_is_not_extracted(spark):
    from revlake.operators.extraction import extract

    d = Drawing("p", "old", 300, 200).text(10, 20, "hidden", alpha=0).text(10, 60, "  shown   text ").rect(5, 5, 50, 50, colour=(1.0, 1.0, 1.0)).rect(5, 5, 50, 50, colour=None, fill=(0.2, 0.2, 0.2)).line(0, 0, 30, 40).line(0, 0, 30, 40)
    raw = tables(spark, d)
    rows = extract(raw.spans, raw.drawings, raw.pages).orderBy("kind", "bbox", "id").collect()
    assert [r.text for r in rows if r.kind == "text"] == ["shown text"]
    shapes = [r for r in rows if r.kind == "geometry"]
    assert len(shapes) == 3 and len({r.id for r in shapes}) == 3
    line = next(r for r in shapes if r.op_histogram == {"l": 1})
    assert math.isclose(line.path_length, round(math.hypot(0.1, 0.2), 6)) and len(line.segments) == 1
    assert [r.primitive_count for r in shapes] == [1, 1, 1]


def test_registration_recovers_transforms():
    from revlake.operators.alignment import fit_page, least_squares

    rng = np.random.default_rng(3)
    old = rng.random((40, 2)) * 0.8
    for angle, scale, shift in ((0.0, 1.0, (0.01, -0.005)), (0.05, 1.02, (0.03, -0.04))):
        c, s = scale * math.cos(angle), scale * math.sin(angle)
        new = old @ np.array([[c, s], [-s, c]]) + shift
        fit = least_squares(old, new)
        assert np.allclose(fit, [scale, angle, *shift], atol=1e-9)
        noisy = new.copy()
        noisy[:12] += 0.2
        got = fit_page(old, noisy)
        assert got["status"] == "aligned" and got["inlier_count"] == 28 and np.allclose(got["transform"], [scale, angle, *shift], atol=1e-9)
        noisy[:20] += rng.random((20, 2))
        assert fit_page(old, noisy)["status"] == "failed"
    assert fit_page(old[:1], old[:1])["status"] == fit_page(old[:0], old[:0])["status"] == "identity-unverified"
    assert fit_page(old, old + 0.3)["status"] == "identity-unverified"
    big = rng.random((60, 2))
    assert fit_page(big, big + 0.02)["status"] == "aligned"
    m = rng.standard_normal((30, 2))
    reflected = m * [1, -1]
    u, sv, vt = np.linalg.svd((m - m.mean(0)).T @ (reflected - reflected.mean(0)))
    assert math.isclose(least_squares(m, reflected)[0], sv.sum() / ((m - m.mean(0)) ** 2).sum(), rel_tol=1e-9)


def test_unregistrable_pair(spark):
    def d(side, order):
        out = Drawing("x", side)
        for i, j in enumerate(order):
            out.text(60 + 70 * (j % 9), 60 + 120 * (j // 9), f"UNIQUE {i}")
        return out

    raw = tables(spark, d("old", range(12)), d("new", [5, 11, 2, 9, 0, 7, 3, 10, 1, 8, 4, 6]))
    with pytest.raises(RegistrationError):
        compare(raw)
    assert compare(raw, strict=False).comparisons.first().status == "failed"


def test_cancel_and_progress(spark):
    seen = []
    raw = tables(spark, plate("old", False), plate("new", False))
    with pytest.raises(Cancelled):
        compare(raw, progress=lambda s, f, m: seen.append((s, f)), cancelled=lambda: len(seen) >= 2)
    assert seen[0] == ("validation", 0.01)


def entity_rows(spark, items):
    """items: (side, Item); a one-page entity table."""
    from revlake.operators.callouts import to_row
    from revlake.operators.extraction import ENTITY

    rows = [to_row(i, "p", side) for side, i in items]
    schema = spark.createDataFrame([], ENTITY).schema
    return spark.createDataFrame([[r[f.name] for f in schema] for r in rows], schema)


def text_item(i, text, x=0.2, y=0.2, w=0.08):
    return Item(i, 0, "text", (x, y, x + w, y + 0.02), (x, y), f"text:{text}", "text-span", "style", text, text.casefold(), "", 0.01)


def shape_item(i, x=0.2, y=0.2, shape="shape", **kw):
    return Item(i, 0, "geometry", (x - 0.03, y - 0.02, x + 0.03, y + 0.02), (x, y), f"geometry:{shape}", shape, "style", ops=(("l", 4),), primitives=4, length=0.2, **kw)


@pytest.fixture(scope="module")
def tiers(spark):
    """Old and new items of separate cases, each on a page of its own, matched at once."""
    glyph = lambda i, x: Item(i, 0, "geometry", (x, 0.2, x + 0.008, 0.214), (x + 0.004, 0.207), "g", "g", "style", ops=(("l", 48),), primitives=48, length=0.04)
    callout = lambda i, x, points: replace(text_item(i, "10 ±0.1", x), category="DIMENSION", structure="dimension:linear", attachments=points, content=f"callout {i}")
    cases = [
        ("exact", [text_item("o", "NOTE A")], [text_item("n", "NOTE A")]),
        ("attribute", [text_item("o", "10 mm")], [text_item("n", "12 mm")]),
        ("moved", [shape_item("o")], [shape_item("n", 0.29)]),
        ("far", [shape_item("o", 0.1)], [shape_item("n", 0.6)]),
        ("kinds", [shape_item("o")], [text_item("n", "A")]),
        ("lost dimension", [text_item("o", "10 mm")], [text_item("n", "12 mm", 0.25)]),
        ("glyph", [glyph("o", 0.2), text_item("t", "10.5", 0.21)], [glyph("n", 0.25), text_item("u", "10.5", 0.26)]),
        ("leaders agree", [callout("o", 0.2, ((0.5, 0.5),))], [callout("n", 0.21, ((0.5, 0.51),))]),
        ("leaders differ", [callout("o", 0.2, ((0.5, 0.5),))], [callout("n", 0.21, ((0.9, 0.5),))]),
        ("ambiguous", [callout("o", 0.2, ())], [callout("n", 0.205, ()), callout("m", 0.195, ())]),
        ("crossing", [shape_item("a", 0.30), shape_item("b", 0.36)], [shape_item("c", 0.34), shape_item("d", 0.40)]),
        ("empty new", [text_item("o", "A B")], []),
    ]
    rows = [(s, replace(e, page=p)) for p, (_, old, new) in enumerate(cases) for s, es in (("old", old), ("new", new)) for e in es]
    from revlake.operators.matching import match_entities

    none = spark.createDataFrame([], "pair_id string, page_index int, transform struct<scale:double,rotation:double,tx:double,ty:double>")
    found = match_entities(entity_rows(spark, rows), none)
    got: dict = {name: [] for name, _, _ in cases}
    for r in found.matches.collect():
        got[cases[r.page_index][0]].append((r.old_id, r.new_id, r.tier, r.score))
    got["unmatched"] = {(cases[r.page_index][0], r.id) for r in found.unmatched_old.collect()} | {(cases[r.page_index][0], r.id) for r in found.unmatched_new.collect()}
    return got


def test_tiers(tiers):
    assert [m[:3] for m in tiers["exact"]] == [("o", "n", "exact")]
    assert [m[:3] for m in tiers["attribute"]] == [("o", "n", "attribute")]
    assert [m[2] for m in tiers["moved"]] == ["structural"] and tiers["moved"][0][3] >= 0.68
    assert not tiers["far"] and not tiers["kinds"] and not tiers["lost dimension"] and not tiers["empty new"]
    assert {("far", "o"), ("far", "n"), ("empty new", "o")} <= tiers["unmatched"]
    assert all(m[0] != "o" for m in tiers["glyph"])
    assert [m[2] for m in tiers["leaders agree"]] == ["attribute"] and not tiers["leaders differ"] and not tiers["ambiguous"]
    assert {m[:2] for m in tiers["crossing"]} == {("a", "c"), ("b", "d")}


def test_dense_and_sparse_assignment_against_permutations():
    rng = np.random.default_rng(4)
    for rows, columns in itertools.product(range(0, 5), range(0, 5)):
        cost = rng.random((rows, columns))
        r, c = assignment.dense_assignment(cost)
        best = min((sum(cost[i, j] for i, j in zip(range(rows), p)) for p in itertools.permutations(range(columns), rows)), default=0) if rows <= columns else min(sum(cost[i, j] for j, i in enumerate(p)) for p in itertools.permutations(range(rows), columns))
        assert math.isclose(cost[r, c].sum(), best, abs_tol=1e-12) and list(r) == sorted(r)
    for _ in range(200):
        rows, columns = int(rng.integers(1, 5)), int(rng.integers(1, 5))
        edges = [(i, j, float(rng.random())) for i in range(rows) for j in range(columns) if rng.random() < 0.6]
        unmatched = 0.4
        w = {(i, j): c for i, j, c in edges}
        options = []
        for choice in itertools.product(range(-1, columns), repeat=rows):
            used = [j for j in choice if j >= 0]
            if len(used) == len(set(used)) and all(j < 0 or (i, j) in w for i, j in enumerate(choice)):
                options.append(sum(unmatched if j < 0 else w[i, j] for i, j in enumerate(choice)))
        for limit in (0, 1000):
            got = assignment.assign_component(rows, columns, edges, unmatched, limit)
            assert math.isclose(sum(w[i, j] for i, j in got.items()) + unmatched * (rows - len(got)), min(options), abs_tol=1e-9)
    with pytest.raises(ValueError):
        assignment.assign_component(1, 1, [(0, 2, 0.1)], 1.0, 10)
    with pytest.raises(ValueError):
        assignment.dense_assignment(np.array([[float("nan")]]))


def test_neighbours_against_brute_force():
    from revlake.operators.spatial import nearest

    x = np.random.default_rng(1).integers(0, 6, (80, 2)) / 10
    d, at = nearest(x, 7, block=16)
    for i in range(80):
        full = sorted(range(80), key=lambda j: (j != i, ((x[i] - x[j]) ** 2).sum(), j))[:7]
        assert list(at[i]) == full and np.allclose(d[i], [math.dist(x[i], x[j]) for j in full])
    assert nearest(np.empty((0, 2)), 3)[0].shape == (0, 0)
    with pytest.raises(ValueError):
        nearest(np.array([[float("inf"), 0.0]]), 1)


def test_radius_join_edges(spark):
    from revlake.operators.spatial import radius_join

    left = spark.createDataFrame([("p", 1, 0.5, 0.5), ("p", 2, 0.1, 0.1), ("q", 3, 0.5, 0.5), ("p", 4, float("nan"), 0.5), ("p", 5, None, 0.5)], "page string, a int, lx double, ly double")
    right = spark.createDataFrame([("p", 1, 0.5, 0.5), ("p", 2, 0.75, 0.5), ("q", 3, 0.5, 0.5)], "page string, b int, rx double, ry double")
    pairs = lambda r: {(x.page, x.a, x.b, x.d) for x in radius_join(left, right, ["page"], r).collect()}
    assert pairs(0.0) == {("p", 1, 1, 0.0), ("q", 3, 3, 0.0)}
    assert pairs(0.25) == {("p", 1, 1, 0.0), ("p", 1, 2, 0.25), ("q", 3, 3, 0.0)}
    for bad in (-1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            pairs(bad)


def test_union_area_against_grid(spark):
    from revlake.operators.areas import union_area

    rng = np.random.default_rng(2)
    boxes = [tuple(sorted(rng.integers(-2, 12, 2))) + tuple(sorted(rng.integers(-2, 12, 2))) for _ in range(25)]
    rows = [(k, box(a / 10, c / 10, b / 10, d / 10)) for k in range(3) for a, b, c, d in boxes[k * 8 : k * 8 + 8]]
    got = {r.k: r.area for r in union_area(spark.createDataFrame(rows, "k int, bbox struct<x0:double,y0:double,x1:double,y1:double>"), ["k"]).collect()}
    for k in range(3):
        cells = {(x, y) for a, b, c, d in boxes[k * 8 : k * 8 + 8] for x in range(max(0, a), min(10, b)) for y in range(max(0, c), min(10, d))}
        assert math.isclose(got[k], len(cells) / 100, abs_tol=1e-9)


ROLES = {"": "other", "SECTION A-A": "other", "POSITION": "gdt", "⌖": "gdt", "THRU": "qualifier", "4X": "prefix", "Ø": "feature", "⌀": "feature", "+0.1": "tolerance", "±0.05": "tolerance", "+0.1/-0.2": "tolerance", "12.5": "nominal", "(12.5)": "nominal", ".5": "nominal", "90°": "nominal", "MM": "unit", "Ø12 ±0.1": "core", "R5": "core", "words": "other", "NOTE 4": "other", "A: 5": "other"}


@pytest.mark.parametrize("text", ROLES)
def test_roles(text):
    assert callouts.fragment_role(text) == ROLES[text]


def test_structures():
    s = callouts.dimension_structure
    assert s("4X Ø10.5 THRU", False) == "dimension:diameter" and s("R5", False) == "dimension:radius" and s("SR5", False) == "dimension:spherical-radius"
    assert s("45° ±1", False) == "dimension:angular" and s("12.5", False) is None and s("12.5", True) == "dimension:linear"
    assert s("12.5 13.0", True) is None and s("12.5 / 13.0", False, 2, True) == "dimension:linear:limit" and s("12.5 MM", False, 2) == "dimension:linear"
    assert callouts.clean("12�0.5  −3") == "12 ±0.5 -3"


def fragment(i, text, x, y, h=0.014, **kw):
    w = max(0.014, 0.0065 * len(text))
    return Item(i, 0, "text", (x, y - h / 2, x + w, y + h / 2), (x + w / 2, y), i, "text-span", "s", text, text.casefold(), size=h, **kw)


def path(i, *segments, ops="l"):
    xs, ys = [p[0] for s in segments for p in s], [p[1] for s in segments for p in s]
    b = (min(xs), min(ys), max(xs), max(ys))
    return Item(i, 0, "geometry", b, ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2), i, i, "s", ops=((ops, len(segments)),), primitives=len(segments), segments=segments)


def rectangle(i, x0, y0, x1, y1):
    c = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return replace(path(i, *((c[k], c[(k + 1) % 4]) for k in range(4))), ops=(("re", 1),), primitives=1)


def made(items):
    return [e for e in reconstruct_page(items) if e.category]


def test_inline_dimension_with_tolerance():
    items = [fragment("a", "4X", 0.30, 0.5), fragment("b", "Ø", 0.32, 0.5), fragment("c", "10.5", 0.34, 0.5), fragment("d", "±0.1", 0.37, 0.5), fragment("e", "SCALE 1:2", 0.7, 0.1)]
    (c,) = made(items)
    assert (c.category, c.structure, c.text, set(c.members)) == ("DIMENSION", "dimension:diameter", "4X Ø 10.5 ±0.1", {"a", "b", "c", "d"})
    assert "e" in {e.id for e in reconstruct_page(items)}
    assert [e.content for e in made(items)] == [e.content for e in made(items[::-1])]


def test_stacked_tolerances_and_standalone_signs():
    (c,) = made([fragment("n", "Ø12.5", 0.3, 0.5), fragment("p", "+0.2", 0.336, 0.492), fragment("q", "-0.1", 0.336, 0.508)])
    assert set(c.members) == {"n", "p", "q"}
    (c,) = made([fragment("n", "12.5", 0.3, 0.5), fragment("s", "+", 0.335, 0.5), fragment("t", "0.2", 0.352, 0.5)])
    assert set(c.members) == {"n", "s", "t"}


def test_a_bare_number_needs_a_leader():
    number = fragment("n", "12.5", 0.3, 0.5)
    assert not made([number])
    leader = path("l", ((0.329, 0.5), (0.45, 0.6)))
    (c,) = made([number, leader])
    assert c.attachments == ((0.45, 0.6),) and c.structure == "dimension:linear"
    rival = fragment("m", "13.5", 0.331, 0.5)
    assert not [c for c in made([number, rival, leader]) if c.text == "12.5"]


def test_limit_dimension():
    (c,) = made([fragment("f", "Ø", 0.28, 0.505, block=1, line=2), fragment("u", "12.50", 0.3, 0.495, block=1, line=2), fragment("v", "12.40", 0.3, 0.515, block=1, line=3)])
    assert c.structure == "dimension:diameter:limit" and c.text == "Ø 12.50 / 12.40"


def frame(x, y, texts, w=0.05, h=0.02):
    cells = [rectangle(f"r{i}", x + i * w, y, x + (i + 1) * w, y + h) for i in range(len(texts))]
    return cells + [fragment(f"t{i}", t, x + i * w + 0.01, y + h / 2, h=0.01) for i, t in enumerate(texts) if t]


def test_framed_control():
    (c,) = made(frame(0.3, 0.3, ["⌖", "0.10", "A", "B"]))
    assert (c.category, c.structure, c.text) == ("GD&T", "gdt:4", "⌖ | 0.10 | A | B") and len(c.members) == 8
    assert not made(frame(0.3, 0.3, ["ITEM", "QTY", "A", "B"]))


def test_vector_symbol_frames():
    mark = [path(f"m{i}", ((0.315, 0.304 + 0.003 * i), (0.335, 0.306 + 0.003 * i)), ops="c") for i in range(4)]
    blank = ["", "0.10", "A", "B"]
    (c,) = made(frame(0.3, 0.3, blank) + mark)
    assert c.structure == "gdt:4" and {m.id for m in mark} <= set(c.members)
    assert not made(frame(0.3, 0.3, blank))
    assert made(frame(0.3, 0.3, ["", "0.10", "A"]) + mark)


def test_frame_from_batched_rails_and_walls():
    rails = path("rails", ((0.3, 0.3), (0.5, 0.3)), ((0.3, 0.32), (0.5, 0.32)))
    walls = path("walls", *(((0.3 + 0.05 * i, 0.3), (0.3 + 0.05 * i, 0.32)) for i in range(5)), ((0.7, 0.7), (0.8, 0.8)))
    texts = [e for e in frame(0.3, 0.3, ["⌖", "0.10", "A", "B"]) if e.kind == "text"]
    out = reconstruct_page([rails, walls, *texts])
    (c,) = [e for e in out if e.category]
    assert c.structure == "gdt:4"
    assert any(e.segments == (((0.7, 0.7), (0.8, 0.8)),) for e in out)


def test_unframed_control():
    (c,) = made([fragment("p", "POSITION", 0.2, 0.5), fragment("q", "0.10", 0.26, 0.5), fragment("a", "A", 0.3, 0.5), fragment("b", "B", 0.33, 0.5)])
    assert c.structure == "gdt:text" and c.text == "POSITION | 0.10 | A | B"
    assert not made([fragment("p", "POSITION", 0.2, 0.5), fragment("q", "0.10", 0.26, 0.5), fragment("a", "A", 0.3, 0.5)])


def test_segment_groups_against_all_pairs():
    rng = np.random.default_rng(7)
    segments = tuple(((float(a), float(b)), (float(a + c), float(b + d))) for a, b, c, d in np.c_[rng.random((60, 2)), (rng.random((60, 2)) - 0.5) * 0.2])
    up = list(range(60))
    for i in range(60):
        for j in range(i):
            if callouts.segments_meet(segments[i], segments[j], 0.0002):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    want = sorted(tuple(i for i in range(60) if up[i] == r) for r in set(up))
    assert sorted(callouts.connected_segments(segments, 0.0002)) == want


def test_moved_callout_is_one_change(spark):
    def d(side, dx):
        out = Drawing("c", side)
        for i in range(6):
            out.text(60 + 100 * i, 60, f"ANCHOR {i}")
        return out.text(300 + dx, 300, "Ø12.5").text(335 + dx, 300, "±0.1")

    rows = compare(tables(spark, d("old", 0), d("new", 30))).changes.collect()
    assert [(r.change_type, r.category, r.before_text) for r in rows] == [("moved", "DIMENSION", "Ø12.5 ±0.1")]
    assert len(rows[0].old_member_entity_ids) == 2 and rows[0].bbox.x0 < rows[0].old_bbox.x0 + 0.001


def test_sinks(plate_result, tmp_path):
    from revlake import sinks

    one = json.loads(sinks.export_json(plate_result, "plate", tmp_path / "a.json").read_text())
    assert one["engine_version"] == "0.2.0" and len(one["pages"][0]["changes"]) == 6 and one["pages"][0]["changes"][0]["bbox"][0] >= 0
    with pytest.raises(FileExistsError):
        sinks.export_json(plate_result, "plate", tmp_path / "a.json")
    rows = list(csv.reader(sinks.export_csv(plate_result, "plate", tmp_path / "a.csv").open(encoding="utf-8-sig")))
    assert rows[0] == sinks.CSV_COLUMNS and len(rows) == 7 and rows[1][0] == "1"
    assert sinks.annotations(plate_result).count() == 6 and sinks.annotations(plate_result, relevant_only=True).count() == 5
    sinks.write_csv(plate_result.changes, str(tmp_path / "csv"))
    sinks.write_json(plate_result, str(tmp_path / "json"))


def test_filters(plate_result):
    from revlake.operators.changes import change_table, filter_changes

    c = plate_result.changes
    assert filter_changes(c, "surface").count() == 1 and filter_changes(c, types=[]).count() == 0 and filter_changes(c, types=["added"]).count() == 1
    assert filter_changes(c, categories=["NOTE", "REVISION"], relevant_only=True).count() == 1 and filter_changes(c, "unmatched").count() == 1
    assert change_table(c).columns == ["page", "type", "category", "relevant", "label", "detail", "tier", "score", "reason"]


def test_command_line_and_stream(spark, tmp_path, capsys):
    from revlake import cli
    from revlake.streaming.arrivals import compare_arrivals

    raw = str(tmp_path / "raw")
    tables(spark, plate("old", False), plate("new", True), plate("old", False, "same"), plate("new", False, "same")).write(raw)
    assert cli.main([raw, "--csv", str(tmp_path / "csv"), "--pair", "plate"]) == 0
    assert "plate: Detected 6" in capsys.readouterr().out
    assert cli.main([raw, "--csv", str(tmp_path / "csv"), "--pair", "plate"]) == 2
    spark.createDataFrame([("plate",), ("same",)], "pair_id string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("pair_id string").json(str(tmp_path / "in"))
    compare_arrivals(stream, raw, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/changes")).count() == 6
    assert {r.pair_id: r.changes for r in spark.read.parquet(str(tmp_path / "out/comparisons")).collect()} == {"plate": 6, "same": 0}


def test_empty_table(spark):
    r = compare_entities(entity_rows(spark, []))
    assert r.changes.count() == r.comparisons.count() == r.pages.count() == 0


def test_settings_are_passed(spark):
    wide = replace(DEFAULTS, structural_radius=0.6)
    rows = [("old", shape_item("o", 0.1)), ("new", shape_item("n", 0.6))]
    assert compare_entities(entity_rows(spark, rows)).matches.count() == 0
    assert compare_entities(entity_rows(spark, rows), replace(wide, structural_score=0.5)).matches.count() == 1
    assert xy(1, 2) == {"x": 1.0, "y": 2.0} and F.lit(1) is not None


def test_backends_agree(spark):
    from conftest import SMALL

    from revlake.operators.alignment import align
    from revlake.operators.backend import NATIVE, PlainBackend
    from revlake.operators.matching import match_entities
    from revlake.sources.tables import synthetic_pair

    entities = synthetic_pair(spark.read.parquet(f"{SMALL}/orders.parquet").where("o_orderkey < 500"))
    plain = PlainBackend()
    points = entities.where("side = 'old'").withColumns({"x": F.col("anchor.x"), "y": F.col("anchor.y")})
    near = [sorted((r.id, r["rank"], round(r.d, 9)) for r in b.nearest_neighbours(points, ["page_index"], "id", "x", "y", 5).collect()) for b in (NATIVE, plain)]
    assert near[0] == near[1] and len(near[0]) == 5 * points.count()
    transforms = align(entities)
    found = [sorted((r.old_id, r.new_id, r.tier, round(r.score, 6)) for r in match_entities(entities, transforms, backend=b).matches.collect()) for b in (NATIVE, plain)]
    assert found[0] == found[1] and {t for *_, t, _ in found[0]} >= {"exact", "attribute"}


def test_scan_of_files(spark, tmp_path):
    from revlake.operators.validation import scan_files

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 and more")
    (tmp_path / "b.pdf").write_bytes(b"PK")
    (tmp_path / "c.pdf").write_bytes(b"")
    got = {r.file_name: (r.size_bytes, r.header) for r in scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (17, "%PDF-"), "b.pdf": (2, "PK")}


def test_output_apart_from_source():
    from revlake.cli import overlaps

    assert overlaps("/x/raw", "file:///x/raw/") and overlaps("/x/raw/out", "/x/raw") and not overlaps("/x/raw2", "/x/raw")


def test_filter_folds_case(spark):
    from revlake.operators.changes import filter_changes

    rows = [(0, "added", "NOTE", "Straße 1", "d", "r", None, None, None), (0, "added", "NOTE", "STRASSE 2", "d", "r", None, "x", None), (1, "moved", "NOTE", "Weg", "d", "r", "exact", None, None)]
    changes = spark.createDataFrame(rows, "page_index int, change_type string, category string, label string, detail string, relevance_reason string, match_tier string, before_text string, after_text string")
    assert sorted(r.label for r in filter_changes(changes, "straße").collect()) == ["STRASSE 2", "Straße 1"]
    assert [r.label for r in filter_changes(changes, "EXACT").collect()] == ["Weg"] and filter_changes(changes, "", []).count() == 0


def test_the_grammar_runs_once_and_kernels_are_spread(spark, monkeypatch):
    """What the tiers read is cut from the grammar, and a kernel's few bytes are dealt over all partitions."""
    from revlake.operators.callouts import reconstruct
    from revlake.plans import compare
    from revlake.sources.tables import synthetic_pair

    entities = synthetic_pair(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    read = []
    monkeypatch.setattr(compare, "match_entities", lambda rows, *_: read.append(rows) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        compare.compare_entities(entities)
    assert "FlatMapGroups" not in read[0]._jdf.queryExecution().toString()
    assert reconstruct(entities).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
