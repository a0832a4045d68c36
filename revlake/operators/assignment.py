"""One-to-one assignment: greedy by rank, and least cost within connected components of candidates."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread


def reject_ambiguous(candidates: DataFrame, keys: list[str], margin: float, flag: str = "callout") -> DataFrame:
    """Drops all candidates of a flagged old or new entity whose best two scores are closer than the margin."""
    out = candidates
    for side in ("old_id", "new_id"):
        ranked = candidates.where(flag).withColumn("r", F.row_number().over(Window.partitionBy(*keys, side).orderBy(F.desc("score"))))
        top = ranked.where("r <= 2").groupBy(*keys, side).agg(F.count("*").alias("n"), (F.max("score") - F.min("score")).alias("gap"))
        out = out.join(top.where((F.col("n") > 1) & (F.col("gap") < margin)).select(*keys, side), [*keys, side], "left_anti")
    return out


def greedy(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Takes candidates by descending score, then distance, then ids, while both entities are free. One page at a time."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "d", "old_id", "new_id"], ascending=[False, True, True, True], kind="stable")
        old, new, keep = set(), set(), []
        for a, b in zip(pdf["old_id"], pdf["new_id"], strict=True):
            free = a not in old and b not in new
            keep.append(free)
            if free:
                old.add(a)
                new.add(b)
        return pdf[np.array(keep, bool)]

    return spread(candidates, keys).groupBy(*keys).applyInPandas(kernel, candidates.schema)


def components(edges: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """Connected components of bipartite edges as sorted old and new nodes, by least old node."""
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def find(a):
        while up.setdefault(a, a) != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for o, n in edges:
        a, b = find((0, o)), find((1, n))
        if a != b:
            up[max(a, b)] = min(a, b)
    groups: dict = defaultdict(lambda: (set(), set()))
    for side, node in list(up):
        groups[find((side, node))][side].add(node)
    return [(sorted(o), sorted(n)) for _, (o, n) in sorted(groups.items())]


def dense_assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a least-cost assignment of a finite rectangular matrix, rows ascending.

    Shortest augmenting paths with potentials, one row at a time; the longer side is never the one augmented.
    """
    cost = np.asarray(cost, np.float64)
    if cost.ndim != 2 or not np.isfinite(cost).all():
        raise ValueError("cost must be a finite matrix")
    if cost.shape[0] > cost.shape[1]:
        c, r = dense_assignment(cost.T)
        order = np.argsort(r)
        return r[order], c[order]
    rows, cols = cost.shape
    u, v, owner = np.zeros(rows), np.zeros(cols), np.full(cols, -1)
    for start in range(rows):
        best, via, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        row, reach, last = start, 0.0, -1
        scanned = []
        while True:
            scanned.append((row, reach))
            step = reach + cost[row] - u[row] - v
            better = ~done & (step < best)
            best[better], via[better] = step[better], row
            last = int(np.argmin(np.where(done, np.inf, best)))
            reach = best[last]
            done[last] = True
            if owner[last] < 0:
                break
            row = int(owner[last])
        for r, at in scanned:
            u[r] += reach - at
        v[done] -= reach - best[done]
        while True:
            row = via[last]
            owner[last] = row
            if row == start:
                break
            last = next(int(c) for c in np.flatnonzero(done) if owner[c] == row and c != last)
    columns = np.full(rows, -1)
    columns[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return np.arange(rows), columns


def sparse_assignment(rows: int, columns: int, edges: list[tuple[int, int, float]], unmatched: float) -> dict[int, int]:
    """Least-cost partial assignment over sparse edges, where leaving a row alone costs `unmatched`.

    Each row finds a shortest augmenting path over reduced costs (Dijkstra); a path may end at a free column or by leaving any
    row on it alone, so memory is that of the edges.
    """
    out: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for r, c, w in edges:
        out[r].append((c, w))
    for r in range(rows):  # a private column each
        out[r].append((columns + r, unmatched))
    u, v = [0.0] * rows, defaultdict(float)
    owner: dict[int, int] = {}
    for start in range(rows):
        best: dict[int, float] = {}
        via: dict[int, int] = {}
        done: dict[int, float] = {}
        scanned = [(start, 0.0)]
        heap: list[tuple[float, int]] = []
        row, reach = start, 0.0
        while True:
            for c, w in out[row]:
                d = reach + w - u[row] - v[c]
                if c not in done and d < best.get(c, float("inf")) - 1e-15:
                    best[c], via[c] = d, row
                    heapq.heappush(heap, (d, c))
            while True:
                reach, last = heapq.heappop(heap)
                if last not in done and reach <= best[last]:
                    break
            done[last] = reach
            if last not in owner:
                break
            row = owner[last]
            scanned.append((row, reach))
        for r, at in scanned:
            u[r] += reach - at
        for c, at in done.items():
            v[c] -= reach - at
        match = {r: c for c, r in owner.items()}
        while True:
            r = via[last]
            owner[last] = r
            if r == start:
                break
            last = match[r]
    return {r: c for c, r in owner.items() if c < columns}


def assign_component(rows: int, columns: int, edges: list[tuple[int, int, float]], unmatched: float, sparse_from: int) -> dict[int, int]:
    """Row to column of a component; dense below sparse_from rows or columns, else sparse. Edges must be valid and distinct."""
    seen = set()
    for r, c, w in edges:
        if not (0 <= r < rows and 0 <= c < columns) or (r, c) in seen or not np.isfinite(w) or w < 0:
            raise ValueError("edges must be distinct, within bounds, and of finite non-negative cost")
        seen.add((r, c))
    if max(rows, columns) > sparse_from:
        return sparse_assignment(rows, columns, edges, unmatched)
    forbidden = max([2.0, unmatched + 1.0, *(w + 1.0 for _, _, w in edges)])
    cost = np.full((rows, columns + rows), forbidden)
    cost[np.arange(rows), columns + np.arange(rows)] = unmatched
    for r, c, w in edges:
        cost[r, c] = w
    r, c = dense_assignment(cost)
    allowed = {(a, b) for a, b, _ in edges}
    return {int(a): int(b) for a, b in zip(r, c, strict=True) if (int(a), int(b)) in allowed}


def least_cost(candidates: DataFrame, keys: list[str], minimum: float, sparse_from: int) -> DataFrame:
    """Per page the assignment within each connected component of candidates that has the greatest total score."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        old, new = sorted(set(pdf["old_id"])), sorted(set(pdf["new_id"]))
        at_old, at_new = {x: i for i, x in enumerate(old)}, {x: i for i, x in enumerate(new)}
        score = {(at_old[a], at_new[b]): (s, i) for i, (a, b, s) in enumerate(zip(pdf["old_id"], pdf["new_id"], pdf["score"], strict=True))}
        keep = []
        by_old: dict[int, list] = defaultdict(list)
        for (a, b), (s, i) in score.items():
            by_old[a].append((b, s, i))
        for rows, columns in components(list(score)):
            place = {b: j for j, b in enumerate(columns)}
            edges = [(i, place[b], max(1e-12, 1 - s + (i * len(columns) + place[b]) * 1e-12)) for i, a in enumerate(rows) for b, s, _ in sorted(by_old[a])]
            for i, j in assign_component(len(rows), len(columns), edges, 1 - minimum + 1e-7, sparse_from).items():
                s, k = score[rows[i], columns[j]]
                if s >= minimum:
                    keep.append(k)
        return pdf.iloc[sorted(keep)]

    return spread(candidates, keys).groupBy(*keys).applyInPandas(kernel, candidates.schema)
