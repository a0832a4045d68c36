"""Embedding near-dedup: a small-world graph per shard, every shard queried by every vector, verified cosines, components.

Vectors are dealt to shards by a hash; each shard's graph is built in one task and audited: its beam is doubled until queries
placed exactly at the threshold from known members find them; a shard that never gets there is compared in full. A task takes two
shards (or one with itself) and asks each one's graph for the other's vectors. Candidates are verified in double precision a bounded
part at a time; a task reports how many links each of its vectors has and joins what it linked with a local union-find, so groups of
copies give counts and stars, never pairs.

A link must be found from both its ends. A task sums a checksum of its links that opposite finds cancel; where it is not 0 the two
shards are compared in full.

Scale: equal vectors are folded first. A shard holds about `shard_rows` vectors and a task two shards with the hits of 512 queries, so its
memory is bounded, however many links there are; work grows with vectors times shards, and each graph is sent once to each shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components
from .hnsw import Graph

MOST = 200_000  # hits of 512 queries that are gathered along links; products with all vectors cost less than following more


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def join(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins nodes a[k] and b[k] in place; up: each node's root, the least node of its component."""
    while True:
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (above := up[up]).tobytes() != up.tobytes():
            up[:] = above


def hits(graph: Graph, q: np.ndarray, least: float, width: int, rows: int):
    """(query, vector) pairs by the graph with that beam, at 0 by products with all vectors; in parts of 512 queries by `rows` vectors at most."""
    for lo in range(0, len(q), 512):
        part = q[lo : lo + 512].astype(np.float32)
        found = graph.within(part, least, width, most=MOST) if width else None
        for r, c in graph.parts_within(part, least, rows) if found is None else [found]:
            yield lo + r, c


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, beam: int = 32, audit: float = 0.995, shards: int = 8, shard_rows: int = 50_000, block_rows: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links are pairs found with a cosine of at least `least`.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    length with each other. Rows of one id are one node. A null id links with nothing. Empty tables give an empty
    result; extra columns are not read. block_rows: vectors of a shard in one block of products.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    folded = materialize(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = folded.count()
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    shards = max(shards, -(-n // shard_rows))
    keyed = folded.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))

    def build(key, table):
        x = unit(table.column("v"))
        graph = Graph(x)
        width = beam
        while not (passed := graph.recall(least, width) >= audit) and width * 8 <= len(x):
            width *= 2
        if not passed:
            width = 0  # vectors no link leads to are found at no beam, and a wider one costs more than all products: those answer this shard
        import pickle

        raw = table.column("v").combine_chunks()
        graph.x = None  # made again from the vectors, which are sent as they came
        return pa.table({"dim": [key[0].as_py()], "shard": [key[1].as_py()], "graph": [pickle.dumps((graph, raw, table.column("rep").to_numpy(), table.column("copies").to_numpy(), width))]}, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("graph", pa.binary())]))

    graphs = materialize(keyed.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary"))

    none = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]).empty_table()

    def search(key, table):
        import pickle

        own = key[1].as_py() == key[2].as_py()
        if len(table) < 2 - own:  # one of the shards has no vectors of this length
            return none
        ends = []
        for sent in table.column("graph"):
            graph, raw, reps, copies, width = pickle.loads(sent.as_buffer())
            x = unit(raw)
            graph.x = np.ascontiguousarray(x, np.float32)
            ends.append((graph, x, reps, copies, width))
        nodes = np.unique(np.concatenate([e[2] for e in ends]))
        place = [np.searchsorted(nodes, e[2]) for e in ends]
        ways = [(0, 0)] if own else [(0, 1), (1, 0)]

        def linked(full: bool):
            links, up, uneven = [np.zeros(len(e[2]), np.int64) for e in ends], np.arange(len(nodes)), 0
            for i, j in ways[:1] if full else ways:
                (_, q, ids, held, _), (graph, x, reps, copies, width) = ends[i], ends[j]
                for r, c in hits(graph, q, least - 1e-4, 0 if full else width, block_rows):
                    exact = np.concatenate([np.empty(0), *(np.einsum("id,id->i", q[r[k : k + 50_000]], x[c[k : k + 50_000]]) for k in range(0, len(r), 50_000))])
                    keep = (exact >= least) & (ids[r] != reps[c])
                    r, c = r[keep], c[keep]
                    links[i] += np.bincount(r, weights=copies[c], minlength=len(ids)).astype(np.int64)
                    if full and not own:
                        links[j] += np.bincount(c, weights=held[r], minlength=len(reps)).astype(np.int64)
                    join(up, place[i][r], place[j][c])
                    a, b = ids[r], reps[c]
                    mixed = (np.minimum(a, b) * np.int64(0x5851F42D4C957F2D) + np.maximum(a, b)) >> np.int64(40) & np.int64(0xFFFFF)
                    uneven += int(np.where(a < b, mixed + 1, -mixed - 1).sum())  # with the opposite links, which give the opposite, 0
            return links, up, uneven

        full = not all(e[4] for e in ends)
        links, up, uneven = linked(full)
        if uneven and not full:
            links, up, _ = linked(True)
        below = np.flatnonzero(up != np.arange(len(nodes)))
        at = [np.flatnonzero(x) for x in links]
        counts = [pa.table([pa.array(e[2][k]), pa.array(x[k]), pa.nulls(len(k), pa.int64())], schema=none.schema) for e, x, k in zip(ends, links, at, strict=True)]
        return pa.concat_tables([*counts, pa.table([pa.array(nodes[below]), pa.nulls(len(below), pa.int64()), pa.array(nodes[up[below]])], schema=none.schema)])

    pairs = shards * (shards + 1) // 2
    sent = graphs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("dim", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "graph")
    found = materialize(sent.repartition(min(pairs, 4096), "dim", "low", "high").groupBy("dim", "low", "high").applyInArrow(search, "rep long, links long, root long"))
    component = connected_components(found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    counted = found.where("root is null").groupBy("rep").agg(F.sum("links").alias("links"))
    named = folded.join(counted, "rep", "left").join(component, "rep", "left").select("v", F.col("rep").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    labelled = good.join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return labelled.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
