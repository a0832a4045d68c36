"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, so it
does not depend on their order, and inserting or deleting a paragraph adds or subtracts one vector. The vector has two parts:
DIGEST lanes modulo 2^64, uniformly random per paragraph, decide equality; SKETCH lanes modulo 2^16 hold signed
counts of the paragraph's word triples, whose inner products estimate how alike two texts are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordHashes, input_bytes, shingle_hashes, word_hashes

DIGEST, SKETCH, TRIPLE = 4, 256, 3


class Fingerprint:
    """Sum of paragraph vectors; add() and remove() take texts, of which each line is a paragraph."""

    def __init__(self, memo: WordHashes | None = None):
        self.memo = memo if memo is not None else WordHashes()
        self.digest = np.zeros(DIGEST, np.uint64)
        self.sketch = np.zeros(SKETCH, np.uint16)

    def _vectors(self, text: str, run: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sums over a text's paragraphs; an empty text has none, an empty run of paragraphs (part of a text) an empty one."""
        data = text.encode("utf-8", "surrogatepass")
        paragraphs = data.split(b"\n") if data or run else []
        digest = np.zeros(DIGEST, np.uint64)
        flat: list[bytes] = []
        closing = [b""] * (TRIPLE - 1)
        if paragraphs:
            digest = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8 * DIGEST).digest() for p in paragraphs), "<u8").reshape(-1, DIGEST).sum(0, dtype=np.uint64)
            for p in data.translate(ASCII_LOWER).split(b"\n"):
                if w := p.split():
                    flat += w
                    flat += closing
        if not flat:
            return digest, np.zeros(SKETCH, np.uint16)
        w = word_hashes(self.memo, flat)
        h = shingle_hashes(w, TRIPLE)
        h = h[w[: len(h)] != np.uint64(self.memo[b""])]
        lanes = np.bincount((h >> np.uint64(56)).astype(np.int64), weights=1.0 - 2.0 * (h & np.uint64(1)).astype(np.float64), minlength=SKETCH)
        return digest, lanes.astype(np.int64).astype(np.uint16)

    def add(self, text: str, run: bool = False) -> Fingerprint:
        d, s = self._vectors(text, run)
        self.digest, self.sketch = self.digest + d, self.sketch + s
        return self

    def remove(self, text: str) -> Fingerprint:
        d, s = self._vectors(text)
        self.digest, self.sketch = self.digest - d, self.sketch - s
        return self

    def plus(self, other: Fingerprint) -> Fingerprint:
        """Fingerprint of the paragraphs of both."""
        out = Fingerprint(self.memo)
        out.digest, out.sketch = self.digest + other.digest, self.sketch + other.sketch
        return out

    def hex(self) -> str:
        return self.digest.astype("<u8").tobytes().hex() + self.sketch.astype("<u2").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the cosine of the sketches between 0 and just below 1; 0 if either has no words."""
        if np.array_equal(self.digest, other.digest) and np.array_equal(self.sketch, other.sketch):
            return 1.0
        a, b = self.sketch.astype(np.int16).astype(np.float64), other.sketch.astype(np.int16).astype(np.float64)
        size = float(np.sqrt(a.dot(a) * b.dot(b)))
        return min(max(float(a.dot(b)) / size, 0.0), 1 - 1e-9) if size else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def kept_paragraphs(text: str) -> int:
    """Where the paragraphs end that edited() leaves as they are; -1 if it changes the first."""
    return text.rfind("\n", 0, len(text) - len(text) // 2)


def with_next(docs: DataFrame, id_col: str, text_col: str, bucket_mb: int = 16) -> DataFrame:
    """Rows (bucket, extra, doc_id, text): key ranges of doc_id, each with a copy (extra) of the row that follows its last.

    Ranges come from quantiles of the ids, so no range holds more than its share of rows whatever the ids are. Texts
    are shuffled once; of each range only its greatest id goes to the driver, one number per range.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(50_000, input_bytes(docs) // (bucket_mb << 20)))
    bounds = sorted(set(rows.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)))
    bucket = F.lit(0)
    if bounds:
        at = F.array(*[F.lit(int(b)) for b in bounds])
        bucket = F.coalesce(F.size(F.filter(at, lambda b: b < F.col("doc_id"))), F.lit(0)) if len(bounds) < 32 else None
        if bucket is None:
            sorted_bounds = np.array(bounds, np.int64)

            @F.pandas_udf("int")
            def bucket_of(ids):
                return pd.Series(np.searchsorted(sorted_bounds, ids.fillna(np.iinfo(np.int64).min).astype("int64").to_numpy()).astype(np.int32))

            bucket = bucket_of("doc_id")
    rows = rows.withColumn("bucket", bucket.cast("int"))
    tops = {r.bucket: r.top for r in rows.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(tops)
    # The range above gets a copy of the greatest id of the range below; the lowest range gets the greatest of all.
    above = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    if not used:
        return rows.withColumn("extra", F.lit(False))
    pairs = F.create_map(*[x for b in used for x in (F.lit(b), F.struct(F.lit(tops[b]).cast("long").alias("top"), F.lit(above[b]).alias("to")))])
    mine = pairs[F.col("bucket")]
    copies = F.when(F.col("doc_id").eqNullSafe(mine["top"]), F.array(F.struct(F.col("bucket"), F.lit(False).alias("extra")), F.struct(mine["to"].alias("bucket"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("extra"))))
    return rows.select("doc_id", "text", F.explode(copies).alias("x")).select("x.bucket", "x.extra", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_mb: int = 16) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses to the edited text and to the next document.

    Order: descending doc_id, then text, then the row itself; null ids last. The document after the last is the first. A null
    text is empty; one row alone is its own next document. Equal texts have equal fingerprints whatever their
    ids. Repeated rows each get a row. Empty tables give an empty result. Extra columns are not read.
    """
    rows = with_next(docs, id_col, text_col, bucket_mb)
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def kernel(key, table):
        memo = WordHashes()
        ids, texts, extra = table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("extra").to_pylist()
        bottom = -(1 << 64)
        rank = lambda i: (-(bottom if ids[i] is None else ids[i]), texts[i])
        own = sorted((i for i in range(len(ids)) if not extra[i]), key=rank)
        copied = [i for i in range(len(ids)) if extra[i]]
        after = min(copied, key=rank)
        # A fingerprint is the sum of its paragraphs', so those that an edit keeps are hashed once for both texts.
        ends = {i: kept_paragraphs(texts[i]) for i in own}
        heads = {i: Fingerprint(memo).add(texts[i][:end], run=True) if end >= 0 else Fingerprint(memo) for i, end in ends.items()}
        prints = {i: heads[i].plus(Fingerprint(memo).add(texts[i][ends[i] + 1 :], run=ends[i] >= 0)) for i in own}
        prints[after] = Fingerprint(memo).add(texts[after])
        got = []
        for i, j in zip(own, [*own[1:], after], strict=True):
            new = edited(texts[i], texts[j])
            fp = heads[i].plus(Fingerprint(memo).add(new[ends[i] + 1 :], run=ends[i] >= 0))
            got.append((ids[i], len(texts[i]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), prints[i].hex(), fp.hex(), prints[i].likeness(fp), prints[i].likeness(prints[j])))
        return pa.Table.from_pydict({f.name: [r[k] for r in got] for k, f in enumerate(out)}, schema=out)

    return rows.groupBy("bucket").applyInArrow(kernel, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


__all__ = ["DIGEST", "SKETCH", "Fingerprint", "edited", "fingerprint_edits", "with_next"]
