"""Language-model scoring with a log-frequency Bloom filter.

Bigram counts are quantised to logarithmic levels q(c) = 1 + floor(log2 c). For every training bigram the keys
(bigram, 1) ... (bigram, q) are put into a Bloom filter; a count is read back by probing level 1, 2, ... until the first
miss. Word counts are exact. Probabilities are the Dirichlet-smoothed

    P(w | v) = (c^(v, w) + mu * P1(w)) / (C(v) + mu),   P1(w) = (c(w) + 1) / (N + V + 1),

with the filter's c^ and a start symbol before each text.

Scale: the counting pass sends, per task, sorted and pre-aggregated hash arrays as one binary per partition (few rows, no
per-word rows), so neither a frequent word nor a frequent bigram makes one partition large. The filter is built in shards by
key range where the counts meet; it grows with the corpus. Shards are broadcast in groups of at most `broadcast_bytes`, a
checked bound: a filter within the bound takes one scoring pass; a larger one takes one pass per group, each pass
adding the group's answers to per-document codes that are checkpointed between the passes. No pass holds more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, crc_mod, cuts, finalize, materialize, pack48, part_of, parts_for, slices, unpack48, word_hashes, words

END, START = b" ", b"  "  # no word holds a blank
#: Count that stands for each level: the middle of [2^(q-1), 2^q).
LEVEL_COUNT = np.array([0.0, 1.0] + [1.5 * 2.0 ** (q - 1) - 0.5 for q in range(2, 64)])


def bigram_hashes(w: np.ndarray, starts: np.ndarray, start_hash: int) -> np.ndarray:
    """Hash of (previous token, token) for concatenated texts; starts: index of each text's first token."""
    prev = np.empty_like(w)
    prev[1:] = w[:-1]
    prev[starts] = np.uint64(start_hash)
    return finalize(prev * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F))


def tokens_of(memo: WordHashes, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by the end token, and the tokens in each."""
    flat: list[bytes] = []
    n = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        ws = words(text)
        flat += ws
        flat.append(END)
        n[i] = len(ws) + 1
    return word_hashes(memo, flat), n


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def probes(keys: np.ndarray, level: int, k: int, m: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit positions of (key, level) by double hashing in a filter of m bits."""
    a = finalize(keys + np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64)))
    b = finalize(a ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    m = np.asarray(m, np.uint64)
    for _ in range(k):
        yield a % m
        a = a + b


def build_filter(keys: np.ndarray, counts: np.ndarray, bits_per_key: int, k: int) -> np.ndarray:
    """Bloom filter (uint8 array) of the keys with the levels of their counts."""
    q = np.frexp(counts.astype(np.float64))[1]
    total = int(q.sum())
    out = np.zeros(max(8, (total * bits_per_key + 7) // 8), np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        for bit in probes(keys[q >= level], level, k, len(out) * 8):
            np.bitwise_or.at(out, (bit >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (bit & np.uint64(7)).astype(np.uint8)))
    return out


class Table:
    """Shards [low, high) of the model: exact word counts and the filter."""

    def __init__(self, shards: tuple, parts: int, k: int):
        """shards: joined(...) of a group; the arrays are used in place, a worker holds one copy."""
        self.low, self.words, self.counts, self.bytes, self.sizes = shards
        self.parts, self.k, self.high = parts, k, self.low + len(self.sizes)
        self.offsets = np.r_[0, np.cumsum(self.sizes)[:-1]].astype(np.uint64)

    @staticmethod
    def joined(rows: list[tuple[int, bytes, bytes, bytes]], low: int, high: int) -> tuple:
        """(low, words, counts, filter bytes, filter bits per part) of the parts low .. high - 1; parts without keys have no bits."""
        sizes = np.zeros(high - low, np.uint64)
        for part, _, _, bits in rows:
            sizes[part - low] = len(bits) * 8
        return (low, np.frombuffer(b"".join(r[1] for r in rows), "<u8"), np.frombuffer(b"".join(r[2] for r in rows), "<i8"), np.frombuffer(b"".join(r[3] for r in rows), np.uint8), sizes)

    def count(self, w: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(w), np.int64)
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, self.counts[at], 0)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level up to which every membership probe hits."""
        out, part = np.zeros(len(h), np.uint8), part_of(h, self.parts).astype(np.int64)
        alive = np.flatnonzero((part >= self.low) & (part < self.high))
        alive = alive[self.sizes[part[alive] - self.low] > 0]
        level = 0
        while len(alive) and level < 63:
            level += 1
            own = part[alive] - self.low
            hit, keys = np.ones(len(alive), bool), h[alive] & np.uint64((1 << 48) - 1)
            for bit in probes(keys, level, self.k, self.sizes[own]):
                bit = bit + self.offsets[own]
                hit &= (self.bytes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            out[alive] = level
        return out


def count_shards(docs: DataFrame, text_col: str, parts: int, bits_per_key: int, k: int, chunk_tokens: int) -> DataFrame:
    """Per key range: exact word counts, the Bloom shard of the bigram counts and totals, over all rows of docs."""

    def send(batches):
        memo = WordHashes()
        end, start = memo[END], memo[START]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            uni, n1 = np.unique(np.concatenate([x[0] for x in held]), return_counts=True)
            bi, n2 = np.unique(np.concatenate([x[1] for x in held]), return_counts=True)
            a, b = cuts(uni, parts), cuts(bi, parts)
            rows = {"part": [], "uni": [], "uni_n": [], "bi": [], "bi_n": []}
            for p in range(parts):
                u, v = slice(a[p], a[p + 1]), slice(b[p], b[p + 1])
                if u.start == u.stop and v.start == v.stop:
                    continue
                rows["part"].append(p)
                rows["uni"].append(uni[u].astype("<u8").tobytes())
                rows["uni_n"].append(n1[u].astype("<u4").tobytes())
                rows["bi"].append(pack48(bi[v]))
                # counts above one only: their index and value; nearly all are one
                more = np.flatnonzero(n2[v] > 1)
                rows["bi_n"].append(np.stack([more, n2[v][more]]).astype("<u4").tobytes())
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("uni", "uni_n", "bi", "bi_n"))]))

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], 1 << 20):
                w, n = tokens_of(memo, texts[lo:hi])
                held.append((w, bigram_hashes(w, np.r_[0, np.cumsum(n)[:-1]], start)))
                size += len(w)
                if size >= chunk_tokens:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        del end

    def gather(key, table):
        uni = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table.column("uni")])
        n1 = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("uni_n")]).astype(np.int64)
        uni, n1 = sum_by_key(uni, n1)
        keys, counts = [], []
        for b, c in zip(table.column("bi"), table.column("bi_n"), strict=True):
            keys.append(x := unpack48(b.as_py()))
            n = np.ones(len(x), np.int64)
            at, more = np.frombuffer(c.as_py(), "<u4").reshape(2, -1)
            n[at] = more
            counts.append(n)
        bi, n2 = sum_by_key(np.concatenate(keys), np.concatenate(counts))
        bits = build_filter(bi, n2, bits_per_key, k)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "uni": [uni.astype("<u8").tobytes()], "uni_n": [n1.astype("<i8").tobytes()], "bits": [bits.tobytes()], "n": pa.array([int(n1.sum())], pa.int64()), "v": pa.array([len(uni)], pa.int64()), "n_bigrams": pa.array([len(bi)], pa.int64())})

    sent = docs.select(text_col).mapInArrow(send, "part int, uni binary, uni_n binary, bi binary, bi_n binary")
    return sent.groupBy("part").applyInArrow(gather, "part int, uni binary, uni_n binary, bits binary, n long, v long, n_bigrams long")


def score_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out_mod: int = 7,
    held_out_remainder: int = 2,
    mu: float = 200.0,
    bits_per_key: int = 10,
    probes_per_level: int = 6,
    chunk_tokens: int = 1_000_000,
    broadcast_bytes: int = 512 << 20,
) -> DataFrame:
    """Log10 probabilities of every text under the add-one unigram base and under the filter's bigram model.

    Nulls: a null text is the empty text (one end token); a null id counts as training. Repeated rows count and score as
    often as they occur. An empty table gives an empty result; if no row is for training, N = V = 0 and every
    token has base probability 1. Extra columns are not read. Texts are scored whole, in blocks of tokens.
    """
    held = F.coalesce(crc_mod(id_col, held_out_mod) == held_out_remainder, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    parts = parts_for(docs)
    shards = materialize(count_shards(rows.where(~F.col("held_out")), "text", parts, bits_per_key, probes_per_level, chunk_tokens))
    sizes = shards.select("part", "n", "v", (F.length("uni") + F.length("uni_n") + F.length("bits")).alias("size")).collect()  # one small row per partition
    total_n, total_v = sum(r.n for r in sizes), sum(r.v for r in sizes)
    groups: list[list[int]] = [[]]
    held_bytes = 0
    for r in sorted(sizes, key=lambda r: r.part):
        if groups[-1] and held_bytes + r.size > broadcast_bytes:
            groups.append([])
            held_bytes = 0
        groups[-1].append(r.part)
        held_bytes += r.size

    def shared(group: list[int]):
        got = shards.where(F.col("part").between(group[0], group[-1])).select("part", "uni", "uni_n", "bits").toLocalIterator() if group else []
        held = sorted(((r.part, bytes(r.uni), bytes(r.uni_n), bytes(r.bits)) for r in got), key=lambda r: r[0])
        return docs.sparkSession.sparkContext.broadcast(Table.joined(held, group[0] if group else 0, group[-1] + 1 if group else 0))

    schema = pa.schema([("doc_id", docs.select(id_col).limit(0).toArrow().schema.field(0).type), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
    id_type = docs.schema[id_col].dataType.simpleString()
    out_ddl = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scores(counts: np.ndarray, levels: np.ndarray, w: np.ndarray, n: np.ndarray, start_count: int):
        first = np.r_[0, np.cumsum(n)[:-1]]
        base = (counts + 1) / (total_n + total_v + 1)
        context = np.empty(len(w), np.float64)
        context[1:] = counts[:-1]
        context[first] = start_count
        p = (LEVEL_COUNT[levels] + mu * base) / (np.maximum(context, LEVEL_COUNT[levels]) + mu)
        return np.add.reduceat((counts > 0).astype(np.int64), first), np.add.reduceat(np.log10(base), first), np.add.reduceat(np.log10(p), first)

    def run(shared_table, last: bool):
        def kernel(batches):
            memo = WordHashes()
            end, start = memo[END], memo[START]
            table = Table(shared_table.value, parts, probes_per_level)
            for batch in batches:
                ids, held, texts = batch.column(0), batch.column(2), batch.column(1).to_pylist()
                before = batch.column(3).to_pylist() if batch.num_columns > 3 else None
                for lo, hi in slices([len(t or "") for t in texts], 1 << 20):
                    w, n = tokens_of(memo, texts[lo:hi])
                    distinct, at = np.unique(w, return_inverse=True)
                    counts = table.count(distinct)[at]
                    levels = table.levels(bigram_hashes(w, np.r_[0, np.cumsum(n)[:-1]], start))
                    start_count = int(table.count(np.array([end], np.uint64))[0])
                    bounds = np.r_[0, np.cumsum(n)]
                    if before is not None:
                        old = [np.frombuffer(x, np.uint8).reshape(-1) for x in before[lo:hi]]
                        start_count += int(old[0][:8].view("<i8")[0])
                        counts = counts + np.concatenate([x[8 : 8 + 8 * k].view("<i8") for x, k in zip(old, n, strict=True)])
                        levels = np.maximum(levels, np.concatenate([x[8 + 8 * k :] for x, k in zip(old, n, strict=True)]))
                    if not last:
                        head = np.array([start_count], "<i8").tobytes()
                        codes = [head + counts[a:b].astype("<i8").tobytes() + levels[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), held.slice(lo, hi - lo), pa.array(codes, pa.binary())], names=["doc_id", "text", "held_out", "codes"])
                        continue
                    known, base, score = scores(counts, levels, w, n, start_count)
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(schema.field(0).type), held.slice(lo, hi - lo), pa.array(n), pa.array(known), pa.array(np.full(hi - lo, total_n, np.int64)), pa.array(base), pa.array(score)], schema=schema)

        return kernel

    for group in groups[:-1]:
        rows = materialize(rows.mapInArrow(run(shared(group), False), f"doc_id {id_type}, text string, held_out boolean, codes binary"))
    return rows.mapInArrow(run(shared(groups[-1]), True), out_ddl)
