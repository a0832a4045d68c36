"""Exact Jaccard join of documents by their word shingles, in the metric space of the Jaccard distance.

Regions. The first pivots are single shingles. A document is at distance 1 - 1/n from the pivots it holds and at 1 from the
others, so its nearest pivots are its own shingles, taken in one global order, rarest first. A partner within 1 - t shares at
least ceil(t n) of them, so it also holds one of the first n - ceil(t n) + 1: that many regions get a copy of the document, and
two linked documents meet in one. Shingles that no other document holds need no region, and a document of whose
shingles fewer than ceil(t n) are shared has no partner at all and is in none.

Within a region the document with the smallest id is the next pivot, and the distance of each other document to it is computed
once per pair of texts. Regions whose documents are thereby connected are done. The others, joined where they share
documents, form clusters: the largest component of a cluster is one side, and each document outside it is a site that is compared
with the cluster's documents of other components. Sites skip documents that the triangle inequality rules out
through their pivots. Any link not yet known lies in an open region, between a site and another document, so none is lost.

Scale: shingle counts are exact over all documents. Tasks exchange sorted hash arrays, one binary per task and key range, so
no shingle, however frequent, makes a large partition; equal sets are folded first; a group of near copies is linked to its pivots
and never expanded to pairs. A cluster's documents and its sites are dealt in blocks, and each block of the one is compared with each of the
other, so a task holds two blocks however large the cluster is; of a cluster of m documents m^2 / block rows are sent at most. Nothing is
broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, finalize, forget, materialize, pack48, part_of, parts_for, shingle_hashes, unpack48, word_hashes, words
from .graph import connected_components

PAST = 1 << 61  # ids are below it
LOW48 = np.uint64((1 << 48) - 1)


def shingle_set(memo: WordHashes, text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of a text with fewer words its whole sequence; none without words."""
    w = word_hashes(memo, words(text))
    if 0 < len(w) < k:
        h = np.uint64(len(w))
        for x in w:
            h = finalize(np.array([h], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x)[0]
        return np.array([h], np.uint64)
    return np.unique(shingle_hashes(w, k))


def _send(parts: int, k: int, chunk_tokens: int) -> Callable:
    """Scan: per chunk of documents a header (ids, sizes, set hashes) and one binary of shingles for each part."""

    def kernel(batches):
        forget()
        memo = WordHashes()
        chunk = TaskContext.get().partitionId() << 32
        ids: list = []
        sets: list[np.ndarray] = []
        size = 0

        def flush():
            n = np.array([len(s) for s in sets], np.int64)
            tokens = np.concatenate(sets)
            at = np.r_[0, np.cumsum(n)]
            mixed = finalize(tokens ^ np.uint64(0xA0761D6478BD642F))
            total = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
            other = np.r_[np.uint64(0), np.cumsum(finalize(mixed), dtype=np.uint64)]
            head = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)), pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64))], names=["doc_id", "n", "s1", "s2"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            rows = [(chunk % parts, True, sink.getvalue().to_pybytes(), b"")]
            doc = np.repeat(np.arange(len(n)), n)
            part = part_of(tokens, parts).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                if cut[p] < cut[p + 1]:
                    own = order[cut[p] : cut[p + 1]]
                    rows.append((p, False, np.bincount(doc[own], minlength=len(n)).astype("<u4").tobytes(), pack48(tokens[own])))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["part", "chunk", "head", "docs", "tokens"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(memo, text, k)
                ids.append(doc_id)
                sets.append(s)
                size += len(s) + 16
                if size >= chunk_tokens:
                    yield flush()
                    chunk, ids, sets, size = chunk + 1, [], [], 0
        if ids:
            yield flush()

    return kernel


def _count(key, table):
    """Gather of a part: exact document counts; back to each chunk go the shingles that several documents hold, with the counts' logarithms
    in eighths, which order them by rarity however frequent they are."""
    part = key[0].as_py()
    rows = table.to_pylist()
    out = [(r["chunk"], True, r["docs"], b"", b"") for r in rows if r["head"]]
    rows = [r for r in rows if not r["head"]]
    if rows:
        arrays = [unpack48(r["tokens"]) for r in rows]
        tokens = np.concatenate(arrays)
        _, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        held = np.minimum(np.ceil(8 * np.log2(counts)), 255).astype(np.uint8)[at]
        end = np.cumsum([len(a) for a in arrays])
        for r, a, stop in zip(rows, arrays, end, strict=True):
            mine = held[stop - len(a) : stop]
            shared = mine > 0
            per_doc = np.frombuffer(r["docs"], "<u4")
            doc = np.repeat(np.arange(len(per_doc)), per_doc)[shared]
            full = (a[shared] & LOW48) | np.uint64(part << 48)
            out.append((r["chunk"], False, np.bincount(doc, minlength=len(per_doc)).astype("<u4").tobytes(), full.astype("<u8").tobytes(), mine[shared].tobytes()))
    columns = list(zip(*out, strict=True))
    return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1]), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["chunk", "head", "docs", "tokens", "counts"])


def _assemble(percent: int) -> Callable:
    """Chunk: per document its size, set hashes and, if it may have a partner, its shared shingles and its regions."""

    def kernel(key, table):
        rows = table.to_pylist()
        head = pa.ipc.open_stream(next(r["docs"] for r in rows if r["head"])).read_all()
        rows = [r for r in rows if not r["head"]]
        n = head.column("n").to_numpy()
        if rows:
            doc = np.concatenate([np.repeat(np.arange(len(n)), np.frombuffer(r["docs"], "<u4")) for r in rows])
            tokens = np.concatenate([np.frombuffer(r["tokens"], "<u8") for r in rows])
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows])
            order = np.lexsort((tokens, counts, doc))
            doc, tokens = doc[order], tokens[order].view(np.int64)
        else:
            doc, tokens = np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(doc, np.arange(len(n) + 1))
        shared = np.diff(at)
        may = (n > 0) & (100 * shared >= percent * n)
        regions = np.where(may, (n - (percent * n + 99) // 100 + 1) - (n - shared), 0)
        keep = np.repeat(may, shared)
        size = np.where(may, shared, 0)
        offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
        first = np.arange(len(tokens)) - np.repeat(at[:-1], shared) < np.repeat(regions, shared)
        return pa.Table.from_arrays(
            [*(head.column(c) for c in ("doc_id", "n", "s1", "s2")), pa.LargeListArray.from_arrays(offsets, tokens[keep]).cast(pa.list_(pa.int64())), pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(regions)].astype(np.int64), tokens[first]).cast(pa.list_(pa.int64()))],
            names=["doc_id", "n", "s1", "s2", "tokens", "regions"],
        )

    return kernel


def _distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with the size of their intersection, their distance, and whether they are linked."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("common"), (F.col("na") + F.col("nb")).alias("both"))
    union = F.col("both") - F.col("common")
    return both.select("a", "b", (1 - F.col("common") / union).alias("d"), (F.col("common") * 100 >= union * percent).alias("linked"))


def _compare(percent: int) -> Callable:
    """Block of a cluster: links between its sites and its documents in other components."""
    reach = 1 - percent / 100 + 1e-9

    def kernel(key, table):
        out: list[tuple[int, int]] = []
        role = table.column("site").to_numpy(zero_copy_only=False)
        doc, n, comp, pivot, d = (table.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "n", "component", "pivot", "d"))
        lists = table.column("tokens").combine_chunks()
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        members = np.flatnonzero(~role)
        if len(members):
            tokens = np.concatenate([flat[bounds[i] : bounds[i + 1]] for i in members])
            of = np.repeat(np.arange(len(members)), [bounds[i + 1] - bounds[i] for i in members])
            order = np.argsort(tokens, kind="stable")
            tokens, of = tokens[order], of[order]
            for i in np.flatnonzero(role):
                own = np.sort(flat[bounds[i] : bounds[i + 1]])
                low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
                hits = np.concatenate([of[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b] or [of[:0]])
                common = np.bincount(hits, minlength=len(members))
                apart = (pivot[members] == pivot[i]) & (np.abs(d[members] - d[i]) > reach)
                linked = (common * 100 >= (n[members] + n[i] - common) * percent) & (comp[members] != comp[i]) & ~apart
                out += [(int(doc[i]), int(doc[j])) for j in members[linked]]
        columns = list(zip(*out, strict=True)) or [(), ()]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return kernel


def _relabel(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (doc, component) of documents that are not their own component, after joining the components of links (a, b)."""
    a, b = label.select(F.col("doc").alias("a"), F.col("component").alias("ca")), label.select(F.col("doc").alias("b"), F.col("component").alias("cb"))
    linked = links.join(a, "a", "left").join(b, "b", "left")
    joined = connected_components(linked.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = label.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("doc", F.coalesce("to", "component").alias("component"))
    fresh = joined.select(F.col("node").alias("doc"), "component").join(label.select("doc"), "doc", "left_anti")
    return materialize(moved.unionByName(fresh).where("doc <> component"), release=True)


def jaccard_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    block: int = 512,
    chunk_tokens: int = 400_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link when 100 * intersection >= percent * union.

    Null and empty texts and texts without words have no shingles and link with nothing. Rows of one id are one node with the links of
    all their texts; each row keeps its own n_shingles. Ids are below 2^61. A
    null id links with nothing and has a null component. Empty tables give an empty result; extra columns are not read.
    """
    parts = min(parts_for(docs), 65_535)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = read.mapInArrow(_send(parts, shingle_words, chunk_tokens), "part int, chunk long, head boolean, docs binary, tokens binary")
    counted = sent.groupBy("part").applyInArrow(_count, "chunk long, head boolean, docs binary, tokens binary, counts binary")
    nodes = materialize(counted.groupBy("chunk").applyInArrow(_assemble(percent), "doc_id long, n long, s1 long, s2 long, tokens array<long>, regions array<long>"), release=True)

    able = nodes.where("size(regions) > 0 and doc_id is not null")
    # A set is a node under the least id that has it; where one id has several sets, the others get nodes of their own past all ids.
    key = ["n", "s1", "s2"]
    first = F.row_number().over(Window.partitionBy("rep").orderBy(*key)) == 1
    same = able.groupBy(*key).agg(F.min("doc_id").alias("rep")).withColumn("node", F.when(first, F.col("rep")).otherwise(F.lit(PAST) + F.pmod(F.xxhash64(*key), F.lit(PAST))))
    held = able.join(same, key)
    copies = held.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    sets = materialize(held.where("doc_id = rep").dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "n", "tokens", "regions"), release=True)

    members = sets.select(F.explode("regions").alias("region"), F.col("doc_id").alias("doc"))
    pivots = members.groupBy("region").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last")).where("pivot <> last").select("region", "pivot")
    active = materialize(members.join(pivots.select("region"), "region"))
    label = copies.where(F.col("b") < PAST).select(F.col("a").alias("doc"), F.col("b").alias("component"))
    inside = active.join(active.groupBy("region").agg(F.min("doc").alias("pivot")), "region")
    pairs = inside.where("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    compared = materialize(_distances(pairs, sets, percent), release=True)
    label = _relabel(label, compared.where("linked").select("a", "b").unionByName(copies.where(F.col("b") >= PAST)))

    # Open regions: those that still hold several components. Regions that share documents make a cluster.
    state = inside.join(label, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    spread = state.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("region")
    opened = materialize(state.join(spread, "region", "left_semi").select("doc", "pivot", "component").distinct())
    cluster = connected_components(opened.where("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b"))).select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    nearest = compared.groupBy(F.col("a").alias("doc")).agg(F.min_by("b", "d").alias("pivot"), F.min("d").alias("d"))
    held = opened.select("doc", "component").distinct().join(cluster, "doc").join(nearest, "doc", "left")
    parts_of = held.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    largest = parts_of.groupBy("cluster").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.sum("size").alias("docs"), F.max("size").alias("top"))
    in_blocks = lambda size: F.greatest(F.ceil(size / block).cast("int"), F.lit(1))
    held = held.join(largest, "cluster").withColumns({"blocks": in_blocks(F.col("docs")), "site_blocks": in_blocks(F.col("docs") - F.col("top"))}).join(sets.select(F.col("doc_id").alias("doc"), "n", "tokens"), "doc")
    columns = ["cluster", "doc", "component", "pivot", "d", "n", "tokens"]
    dealt = lambda value, blocks: F.pmod(value, F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    members = held.select(*columns, dealt(F.xxhash64("doc"), "blocks").alias("block"), every("site_blocks").alias("site_block"), F.lit(False).alias("site"))
    sites = held.where("component <> largest").select(*columns, every("blocks").alias("block"), dealt(F.xxhash64("doc", F.lit(1)), "site_blocks").alias("site_block"), F.lit(True).alias("site"))
    links = members.unionByName(sites).groupBy("cluster", "block", "site_block").applyInArrow(_compare(percent), "a long, b long")
    label = _relabel(label, links)
    label = label.withColumnRenamed("doc", "doc_id").groupBy("doc_id").agg(F.min("component").alias("component"))
    return nodes.select("doc_id", "n").join(label, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
