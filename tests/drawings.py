"""Small drawings as raw tables; text boxes are estimated from font size and length."""

from __future__ import annotations


def xy(x, y):
    return {"x": float(x), "y": float(y)}


def box(x0, y0, x1, y1):
    return {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}


class Drawing:
    """Collects rows of one side of a pair."""

    def __init__(self, pair_id: str, side: str, width: float = 792.0, height: float = 612.0, pages: int = 1):
        self.key, self.width, self.height, self.pages = (pair_id, side), float(width), float(height), pages
        self.spans, self.drawings, self.images = [], [], []

    def text(self, x, y, text, size=11.0, page=0, alpha=None, line=0):
        self.spans.append((*self.key, page, len(self.spans), line, 0, text, box(x, y - size * 0.8, x + 0.55 * size * len(text), y + size * 0.2), xy(x, y), xy(1, 0), "Helv", float(size), 0, 0, alpha))
        return self

    def path(self, items, rect, page=0, colour=(0.0, 0.0, 0.0), fill=None, width=1.0):
        self.drawings.append((*self.key, page, len(self.drawings), items, rect, list(colour) if colour else None, list(fill) if fill else None, width, "", 1.0, 1.0, False))
        return self

    def rect(self, x0, y0, x1, y1, **kw):
        pts = [xy(x0, y0), xy(x1, y0), xy(x1, y1), xy(x0, y1)]
        return self.path([("re", pts)], box(x0, y0, x1, y1), **kw)

    def line(self, x0, y0, x1, y1, **kw):
        return self.path([("l", [xy(x0, y0), xy(x1, y1)])], box(min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)), **kw)

    def circle(self, x, y, r, **kw):
        k = 0.5523 * r
        arcs = [("c", [xy(x + r, y), xy(x + r, y + k), xy(x + k, y + r), xy(x, y + r)]), ("c", [xy(x, y + r), xy(x - k, y + r), xy(x - r, y + k), xy(x - r, y)]), ("c", [xy(x - r, y), xy(x - r, y - k), xy(x - k, y - r), xy(x, y - r)]), ("c", [xy(x, y - r), xy(x + k, y - r), xy(x + r, y - k), xy(x + r, y)])]
        return self.path(arcs, box(x - r, y - r, x + r, y + r), **kw)

    def image(self, x0, y0, x1, y1, page=0):
        self.images.append((*self.key, page, len(self.images), box(x0, y0, x1, y1)))
        return self


def tables(spark, *drawings, **document):
    from revlake.sources.tables import RawTables

    rows = {"documents": [], "pages": [], "spans": [], "drawings": [], "images": []}
    for d in drawings:
        base = {"file_name": f"{d.key[1]}.pdf", "size_bytes": 1000, "header": "%PDF-1.7", "encrypted": False, "page_count": d.pages} | document
        rows["documents"].append((*d.key, *base.values()))
        rows["pages"] += [(*d.key, p, d.width, d.height) for p in range(d.pages)]
        rows["spans"] += d.spans
        rows["drawings"] += d.drawings
        rows["images"] += d.images
    return RawTables.of(spark, **rows)


def plate(side: str, revised: bool, pair_id: str = "plate") -> Drawing:
    """A machined plate with a border, a title block, notes, a dimension and a position tolerance."""
    d = Drawing(pair_id, side)
    d.rect(24, 24, 768, 588).rect(500, 480, 768, 588).line(500, 520, 768, 520, width=0.7).line(620, 480, 620, 588, width=0.7)
    d.rect(155, 145, 445 if revised else 430, 345, width=1.8).circle(220, 245, 28, width=1.4).circle(365, 245, 28, width=1.4)
    if revised:
        d.circle(292, 245, 18, width=1.4)
    d.text(160, 112, "PLATE, MOUNTING", 16)
    d.text(160, 382, "WIDTH 55.0 ±0.1 mm" if revised else "WIDTH 50.0 ±0.1 mm", 11)
    d.text(160, 410, "POSITION | DIA 0.10 | A | B" if revised else "POSITION | DIA 0.20 | A | B", 10)
    d.text(160, 438, "NOTE: SURFACE FINISH 32 Ra" if revised else "NOTE: SURFACE FINISH 63 Ra", 10)
    d.text(510, 502, "PART: PD-1001", 10).text(510, 542, "MATERIAL: 6061-T6", 9).text(634, 542, "REVISION", 9)
    d.text(675, 570, "B" if revised else "A", 12)
    return d
