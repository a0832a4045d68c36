"""Sum-of-squares online packing of token sequences.

Each scan task packs the documents it reads, in order, into windows. A level array N counts the partially filled windows at
each fill; a document of s tokens goes to the fill level h (0: a new window) whose choice makes the sum of N[h]^2 smallest.
Documents longer than a window give whole windows and a rest. What is still partially filled when a task ends is cut and
joined into full windows; the last rest is cut at powers of two, which need no padding. So nothing is padded.

Scale: no shuffle and no state across tasks; a task holds the level array and its partially filled windows only, which the
sum-of-squares rule keeps few (and `max_open` bounds exactly: reaching it closes the task's windows as its end would).
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, Memo, slices

#: Letters and digits below U+0180. The normaliser (NFC, lower case) leaves each a single character of its kind, but for U+0130, whose
#: small form ends in a mark.
LETTERS, DIGITS = ("".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == kind and c != "\u0130") for kind in "LN")
#: A stop or comma that ends a word after one of them: a token of its own, so the word is looked up without it. Words of other
#: characters are looked up with their stop.
STOP = re.compile(rf"[.,](?<=[{LETTERS}{DIGITS}].)(?!\S)")
#: Words of these and ASCII signs (but for "<|", with which special tokens begin), and the parts that the tokenizer takes them in.
PLAIN = re.compile(rf"(?:(?!<\|)[{LETTERS}{DIGITS}!-/:-@\[-`{{-~])+")
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")
#: A character's UTF-8 bytes as the characters that stand for them in the vocabulary: printable bytes for themselves, the others from
#: U+0100 on in order.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
BYTES = {c: "".join(_HIDDEN.get(b, chr(b)) for b in chr(c).encode()) for c in range(0x180)}
_TOKENIZERS: dict[str, WordTokenizer] = {}  # one per file in a worker process, so that its memo serves later tasks
KEPT.append(_TOKENIZERS)


class WordTokenizer:
    """Ids of whole texts by tokenizers, through a memo of words between ASCII blanks.

    The tokenizer drops white space and never joins across it, and its normaliser (NFC, lower case) does not
    act across it, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(self._ids, 700_000)

    @staticmethod
    def of(path: str) -> WordTokenizer:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        return _TOKENIZERS[path]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The words' ids: plain words are cut into their parts here and merged by the tokenizer's model, others go all through it."""
        plain, merged = PLAIN.fullmatch, self.tokenizer.model.tokenize
        out: list[bytes | None] = []
        for w in words:
            if not plain(w):
                out.append(None)
            elif w.isascii() and w.isalpha():
                out.append(array("I", [t.id for t in merged(w.lower())]).tobytes())
            else:
                out.append(array("I", [t.id for part in PARTS.findall(w.lower()) for t in merged(part if part.isascii() else part.translate(BYTES))]).tobytes())
        rest = iter(self.tokenizer.encode_batch_fast([w for w, x in zip(words, out, strict=True) if x is None], add_special_tokens=False))
        return [array("I", next(rest).ids).tobytes() if x is None else x for x in out]

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        words = [STOP.sub(r" \g<0>", t.replace("\n", " ")).split(" ") for t in texts]
        values = self.memo.values([w for ws in words for w in ws])
        at = 0
        for ws in words:
            yield np.frombuffer(b"".join(values[at : at + len(ws)]), "<u4")
            at += len(ws)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))


class SumOfSquares:
    """Level array of partially filled windows: choose(size) returns the fill level to use (0: a new window).

    Two more arrays hold, by level from the window down to 0, what the sum of squares gains from one window more at the level and loses
    from one less, so that a choice is one difference and its first minimum: of equals the fullest level.
    """

    NEVER = 1 << 40

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # [0] and [window] stay 0
        self.gain = np.ones(window + 1, np.int64)  # 2 n + 1; a full window leaves the array
        self.loss = np.full(window + 1, -self.NEVER)  # 2 n - 1, from levels that hold a window; a new one is free
        self.gain[0] = self.loss[window] = 0

    def choose(self, size: int) -> int:
        """The level h with h + size <= window that makes the sum of squares smallest; the fullest of equals."""
        w = self.window
        return 0 if size >= w else w - size - int(np.argmin(self.gain[: w - size + 1] - self.loss[size:]))

    def _set(self, level: int, change: int) -> None:
        n = self.count[level] = self.count[level] + change
        self.gain[self.window - level] = 2 * n + 1
        self.loss[self.window - level] = 2 * n - 1 if n else -self.NEVER

    def move(self, level: int, size: int) -> None:
        if level:
            self._set(level, -1)
        if level + size < self.window:
            self._set(level + size, 1)


class Packer:
    """Packs (doc, ids) into windows; rows are (doc, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int, max_open: int):
        self.window, self.next, self.max_open = window, first_sequence, max_open
        self.levels, self.open, self.n_open = SumOfSquares(window), {}, 0

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _row(self, piece: tuple, sequence: int, offset: int) -> tuple:
        doc, start, ids, total = piece
        return (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset)

    def _rows(self, pieces: list[tuple]) -> Iterator[tuple]:
        sequence, offset = self._sequence(), 0
        for piece in pieces:
            yield self._row(piece, sequence, offset)
            offset += len(piece[2])

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, start = len(ids), 0
        while total - start >= self.window:
            yield from self._rows([(doc, start, ids[start : start + self.window], total)])
            start += self.window
        size = total - start
        if not size:
            return
        level = self.levels.choose(size)
        pieces = self.open[level].pop() if level else []
        pieces.append((doc, start, ids[start:].astype(np.uint16 if ids.max() < 65536 else np.uint32), total))
        self.levels.move(level, size)
        if level + size == self.window:
            yield from self._rows(pieces)
        else:
            self.open.setdefault(level + size, []).append(pieces)
        self.n_open += (level == 0) - (level + size == self.window)
        if self.n_open >= self.max_open:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        """Cuts and joins what is partially filled: the fullest first, so that most documents stay whole."""
        stream = [piece for level in sorted(self.open, reverse=True) for pieces in self.open[level] for piece in pieces]
        left = sum(len(p[2]) for p in stream)
        held: list[tuple] = []
        room = need = min(self.window, 1 << (left.bit_length() - 1)) if left else 0
        for doc, start, ids, total in stream:
            while len(ids):
                take, ids = ids[:room], ids[room:]
                held.append((doc, start, take, total))
                start, room, left = start + len(take), room - len(take), left - len(take)
                if not room:
                    yield from self._rows(held)
                    held, room = [], min(self.window, 1 << (left.bit_length() - 1)) if left else 0
        assert not held and not left, need
        self.levels, self.open, self.n_open = SumOfSquares(self.window), {}, 0


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    end_id: int = 2,
    max_open: int = 4096,
    encoder: Callable[[str], Callable[[list[str]], Iterable[np.ndarray]]] | None = None,
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone; a null id stays null. Repeated rows are packed each. Empty tables give an
    empty result. Extra columns are not read. Sequences are numbered by scan partition, so a task that is run
    again after a lost executor gives the same rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def kernel(batches):
        words = None if encoder else WordTokenizer.of(tokenizer_path)
        encode = words.encode_all if words else encoder(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 36, max_open)
        id_arrow = None
        rows: list[tuple] = []

        def block():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices([len(t) for t in texts], 1 << 20):
                for doc, ids in zip(docs[lo:hi], encode(texts[lo:hi]), strict=True):
                    rows.extend(packer.add(doc, np.append(ids, np.uint32(end_id))))
                if len(rows) >= 20_000:
                    yield block()
                    rows = []
        rows.extend(packer.close())
        if words:
            words.memo.settle(400_000)
        if rows:
            yield block()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in names[1:]))
