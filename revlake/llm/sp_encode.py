"""Exact merge-type (BPE) SentencePiece encoding by backtracking, and decoding.

Texts are cut where no piece of the vocabulary spans the cut (before blanks, around characters outside the vocabulary, before most
stops), so words are encoded apart and memoised. A word is encoded by walking left to right: the Aho-Corasick automaton gives the longest
piece at each position; a piece may follow another only if re-merging their joint text gives back exactly the two; when no
piece fits, the walk steps back, and a bitfield marks positions that cannot be continued. Merge scores must be distinct for this.
Pieces of blanks share the lowest score, so they are merged when all else is, leftmost first, which one pass over a run does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, Memo, slices

SPACE = "▁"
#: Begins a word that no blank precedes. A text that holds this character itself is encoded without the memo.
BARE = "\ufdd0"
MEMO_PAIRS = 300_000


_ENCODERS: dict[str, BacktrackingEncoder] = {}  # one per file in a worker process, so that its memo serves later tasks
KEPT.append(_ENCODERS)


class BacktrackingEncoder:
    """Encoder of one model file, with a memo from words to their ids as text."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.texts[i]: i for i in normal}
        self.scores = {self.texts[i]: sp.get_score(i) for i in normal}
        self.unknown = sp.unk_id()
        words = [t for t in self.ids if t.strip(SPACE)]
        if len({self.scores[t] for t in words if len(t) > 1}) < sum(len(t) > 1 for t in words):
            raise ValueError("pieces other than blanks share a score")
        if any(SPACE in t.lstrip(SPACE) or t.startswith(SPACE * 2) for t in words):
            raise ValueError("a piece spans a word and blanks")
        self.blanks = {len(t) for t in self.ids if not t.strip(SPACE)}
        if len({self.scores[SPACE * n] for n in self.blanks if n > 1}) > 1 or any(self.scores[SPACE * n] >= self.scores[t] for n in self.blanks if n > 1 for t in words if len(t) > 1):
            raise ValueError("blanks are not merged last")
        self.characters = {c for text in self.ids for c in text}
        # A segment: blanks with the characters up to the next blank; characters outside the vocabulary stand alone.
        inside = "".join(re.escape(c) for c in sorted(self.characters - {SPACE}))
        self.segments = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]").findall
        joint = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        before = "".join(re.escape(c) for c in sorted(self.characters) if c.isalnum() and c < "\u0180" and c + "." not in joint and c + "," not in joint)
        #: A stop or comma that ends a word after a character that no piece has before it.
        self.stop = re.compile(f"[.,](?<=[{before}].)(?!\\S)" if before else r"(?!)")
        self.memo = Memo(lambda keys: list(map(self._value, keys)), 700_000)
        self.decoded: dict[str, bytes] = {}  # of keys that do not decode to themselves
        self.automaton = ahocorasick.Automaton()
        for text in self.ids:
            self.automaton.add_word(text, text)
        self.automaton.make_automaton()
        self.ranks = {t: i for i, t in enumerate(sorted((t for t in words if len(t) > 1), key=lambda t: -self.scores[t]))}
        self.made: dict[str, tuple[str, ...] | None] = {}
        self.compatible: dict[tuple[str, str], bool] = {}

    @staticmethod
    def of(path: str) -> BacktrackingEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = BacktrackingEncoder(path)
        return _ENCODERS[path]

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Merges adjacent symbols by descending score, leftmost first, as the definition has it, until `stop` are left or none merge."""
        parts, scores = list(text), self.scores
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def made_of(self, piece: str) -> tuple[str, ...] | None:
        """The two parts whose merge gives a piece (none: a single character), None if its text is not merged to it."""
        got = self.made.get(piece, ())
        if got == ():
            parts = self.merge(piece, 2)
            got = self.made[piece] = tuple(parts) if len(parts) == 1 or len(parts) == 2 and piece in self.ids else None
        return got

    def apart(self, left: str, right: str) -> bool:
        """Whether two symbols meet when their joint text is merged: undoing the merges that made them, the latest first, no two
        symbols that met at their border would have been merged before."""
        rank, limit, joint = self.ranks, 1 << 40, None  # the whole two may make a piece: fits() looks for that
        while joint is None or joint >= limit:
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.made_of(left)[-1]
            else:
                limit, right = b + 1, self.made_of(right)[0]
            joint = rank.get(left + right)
        return False

    def fits(self, left: str, right: str) -> bool:
        """Whether re-merging the joint text of two pieces gives back exactly the two (left empty: right by itself)."""
        got = self.compatible.get((left, right))
        if got is None:
            if len(self.compatible) >= MEMO_PAIRS:
                self.compatible.clear()
            whole = self.made_of(right) is not None and (not left or self.made_of(left) is not None)
            got = self.compatible[left, right] = whole and (not left or left + right not in self.ranks and self.apart(left, right))
        return got

    def _matches(self, text: str) -> list[list[str]]:
        """Pieces that begin at each position, the longest last."""
        at: list[list[str]] = [[] for _ in text]
        for end, piece in self.automaton.iter(text):
            at[end + 1 - len(piece)].append(piece)
        return at

    def blank_run(self, n: int) -> list[str]:
        """Pieces of n blanks: the leftmost pair of symbols that make a piece is merged first, so those to the left are settled."""
        out: list[int] = []
        sizes = self.blanks
        for _ in range(n):
            size = 1
            while out and out[-1] + size in sizes:
                size += out.pop()
            out.append(size)
        return [SPACE * size for size in out]

    def pieces(self, text: str) -> list[str]:
        """Pieces of one segment."""
        word = text.lstrip(SPACE)
        blanks = len(text) - len(word)
        if not word:
            return self.blank_run(blanks)
        if blanks > 1:
            first, *rest = self.pieces(SPACE + word)
            return self.blank_run(blanks) + rest if first == SPACE else [*self.blank_run(blanks - 1), first, *rest]
        if len(text) == 1:
            return [text]
        out = [piece for _, piece in self.automaton.iter_long(text)]
        previous = ""
        for piece in out:  # the longest piece at every position, where each may follow the one before
            if not self.fits(previous, piece):
                return self._walk(text)
            previous = piece
        return out

    def _walk(self, text: str) -> list[str]:
        at = self._matches(text)
        failed = bytearray(len(text) // 8 + 1)  # bitfield of positions from which no way leads on
        out: list[str] = []
        left = [len(at[0])]  # candidates not yet tried at each depth
        pos = 0
        while pos < len(text):
            previous, k, found = out[-1] if out else "", left[-1], None
            while k:
                k -= 1
                piece = at[pos][k]
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and self.fits(previous, piece):
                    found = piece
                    break
            left[-1] = k
            if found:
                out.append(found)
                pos += len(found)
                if pos < len(text):
                    left.append(len(at[pos]))
            elif out:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos -= len(out.pop())
                left.pop()
            else:
                return self.merge(text)
        return out

    def _ids(self, segments: list[str]) -> list[int]:
        ids: list[int] = []
        for segment in segments:
            for piece in self.pieces(segment):
                if piece in self.ids:
                    ids.append(self.ids[piece])
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
                else:
                    ids.append(self.unknown)
        return ids

    def _value(self, key: str) -> str:
        """Ids of a key as text; also decodes them, and keeps the decoded bytes where they are not the key's."""
        text = key[1:] if key[:1] == BARE else SPACE + key.replace(" ", SPACE)
        ids = self._ids(self.segments(text))
        back = self.decode_bytes(ids)
        if back != text.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
            self.decoded[key] = back
        return ",".join(map(str, ids))

    def _keys(self, text: str) -> list[str]:
        """A text's words: each stands for a blank and itself, one that begins with BARE for what follows that."""
        words = self.stop.sub(f" {BARE}\\g<0>", text).split(" ")
        if text[0] != " " and "  " not in text:
            return words
        out, blanks = [], 0
        for w in words:
            if w:
                out.append(" " * blanks + w)
                blanks = 0
            else:
                blanks += 1
        return [*out, " " * (blanks - 1)] if blanks else out

    def encode_all(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text its ids, comma-joined, and the text decoded from them."""
        plain = [t.replace(SPACE, " ") if t and BARE not in t else "" for t in texts]
        keys = [self._keys(t) if t else [] for t in plain]
        values = self.memo.values([k for ks in keys for k in ks])
        at = 0
        for text, t, ks in zip(texts, plain, keys, strict=True):
            if text and not t:
                ids = self._ids(self.segments(SPACE + text.replace(" ", SPACE)))
                yield ",".join(map(str, ids)), self._text(self.decode_bytes(ids))
                continue
            if not self.decoded or self.decoded.keys().isdisjoint(ks):
                back = t
            else:
                own = ((k, k[1:] if k[:1] == BARE else " " + k) for k in ks)
                back = self._text(b"".join([self.decoded[k] if k in self.decoded else x.encode("utf-8", "surrogatepass") for k, x in own]))
            yield ",".join(values[at : at + len(ks)]), back
            at += len(ks)
        if len(self.decoded) > MEMO_PAIRS:  # texts of characters that do not come back, as lone surrogates
            self.decoded.clear()
            self.memo.clear()

    def encode(self, text: str) -> list[int]:
        return self.both(text)[0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.texts[i].replace(SPACE, " ").encode() for i in ids)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces joined as UTF-8 (U+FFFD per byte that is invalid), blanks restored, the first dropped."""
        return self._text(self.decode_bytes(ids))

    @staticmethod
    def _text(data: bytes) -> str:
        return data.removeprefix(b" ").decode("utf-8", "replace")

    def both(self, text: str) -> tuple[list[int], str]:
        """Ids of a text, and the text decoded from them."""
        ids, back = next(self.encode_all([text]))
        return list(map(int, ids.split(","))) if ids else [], back


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = True) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256, and without digests_only ids and decoded.

    A null text is empty and has no ids; ids may be null or repeated, and each row gives a row. Empty tables give an empty
    result. Extra columns are not read. There is no shuffle; a task's memory is its batch and the bounded memos.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def kernel(batches):
        encoder = BacktrackingEncoder.of(model_path)
        for batch in batches:
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            for lo, hi in slices([len(t) for t in texts], 1 << 20):
                for ids, decoded in encoder.encode_all(texts[lo:hi]):
                    row = (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    rows.append(row if digests_only else (*row, list(map(int, ids.split(","))) if ids else [], decoded))
            columns = list(zip(*rows, strict=True)) or [[]] * (3 if digests_only else 5)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names=names[: len(columns) + 1])
        encoder.memo.settle(400_000)

    out = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>, decoded string")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, out)


__all__ = ["BacktrackingEncoder", "encode_documents"]
