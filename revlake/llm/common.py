"""Shared helpers of the training-data operators: hashing kernels, packing, checkpointing."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable
from itertools import compress, islice, repeat
from operator import is_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases the ASCII letters of UTF-8 bytes and leaves everything else.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Odd multipliers for combining word hashes; any odd 64-bit constants do.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
MEMO_WORDS = 250_000


class WordHashes(dict):
    """Memo from a word's bytes to its 64-bit hash; emptied when it holds MEMO_WORDS words, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


#: Encoders that worker processes keep between tasks, by file.
KEPT: list[dict] = []


def forget() -> None:
    """Drops what earlier tasks of other operators left in this worker process."""
    for kept in KEPT:
        kept.clear()


class Memo:
    """Values of strings, computed once per string for those not seen lately; kept per worker process, in two generations.

    When the young generation holds `limit` strings it becomes the old one, so memory is bounded and strings in use stay.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 400_000):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def values(self, keys: list[str]) -> list:
        young = self.young
        if len(young) >= self.limit:
            self.old, self.young = young, {}
            young = self.young
        got = list(map(young.get, keys))
        missing = dict.fromkeys(compress(keys, map(is_, got, repeat(None))))
        if not missing:
            return got
        new = []
        for k in missing:
            if (v := self.old.get(k)) is not None:
                young[k] = v
            else:
                new.append(k)
        young.update(zip(new, self.compute(new), strict=True))
        return [young[k] if v is None else v for k, v in zip(keys, got, strict=True)]

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def settle(self, keep: int) -> None:
        """At a task's end: keep the strings met first, which are the frequent ones, so that an idle worker holds little."""
        self.old = {}
        if len(self.young) > keep:
            self.young = dict(islice(self.young.items(), keep))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 bytes; bytes.split() has exactly that separator set."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def word_hashes(memo: WordHashes, tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, tokens), np.uint64, count=len(tokens))


def finalize(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k word hashes (order-sensitive); empty when there are fewer."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = finalize(h + w[i : i + n] * MIX[i % len(MIX)] + np.uint64(i + 1)) if k > len(MIX) else h + (w[i : i + n] ^ (w[i : i + n] >> np.uint64(29))) * MIX[i]
    return finalize(h)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each hash by its high 32 bits; monotone in the hash, so sorted hashes have contiguous partitions."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def cuts(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the partitions within sorted hashes (parts + 1 offsets)."""
    return np.searchsorted(part_of(sorted_hashes, parts), np.arange(parts + 1, dtype=np.uint64))


def pack48(h: np.ndarray) -> bytes:
    """The low 48 bits of each hash, 6 bytes each; with the partition (high bits) they identify it."""
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the input's size (file bytes for a scan)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, mb: int = 16) -> int:
    """How many partitions keys of df are dealt over: the session's shuffle partitions, more when those would exceed mb each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(n, min(100_000, size // (mb << 20))) if size < 1 << 60 else n


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir. Where it is unset, one machine uses a temporary one, and a cluster, whose machines
    share none, is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="revlake-checkpoint-"))


def materialize(df: DataFrame, release: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    release: let the driver collect its garbage, on which Spark deletes the shuffle files that nothing refers to any more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    if release:
        spark = df.sparkSession
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def crc_mod(column: str, mod: int):
    """crc32 of the column's text modulo mod; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def slices(lengths: list[int], most: int):
    """Ranges of consecutive rows whose lengths add up to about `most`, at least one row each."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
