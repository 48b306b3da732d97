"""Reader of SentencePiece ``.model`` files and byte-pair merging by heap.

Only what counting and encoding need is read: the pieces with scores and types
and the normaliser's flags.  Models whose normaliser rewrites characters, or
that hold user-defined or unused pieces, are refused rather than approximated.
"""

from __future__ import annotations

import codecs
import struct
from heapq import heapify, heappop, heappush

#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def _bad_bytes(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("quantloom.each_byte", _bad_bytes)


def decoded(text: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is not part of a character."""
    return text.decode("utf-8", "quantloom.each_byte")


def _fields(buf: bytes):
    at = 0
    end = len(buf)

    def varint(i):
        value = shift = 0
        while True:
            byte = buf[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, i
            shift += 7

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value = buf[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            value = buf[at : at + n]
            at += n
        yield key >> 3, value


class PieceModel:
    """Pieces of a byte-pair model: ``rank`` gives each mergeable piece's
    priority (0 first), ``ids`` its identifier, ``byte_ids`` those of the 256
    fallback bytes."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        normalizer: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for field, value in _fields(data):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append(part[1].decode())
                scores.append(struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0])
                kinds.append(part.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a byte-pair model")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("the model's normaliser is not the identity with a leading space")
        if {USER_DEFINED, UNUSED} & set(kinds) or kinds.count(BYTE) != 256:
            raise ValueError("user-defined or unused pieces, or no byte fallback")
        usable = [i for i, k in enumerate(kinds) if k == NORMAL]
        self.ids = {self.pieces[i]: i for i in usable}
        levels = {s: r for r, s in enumerate(sorted({scores[i] for i in usable}, reverse=True))}
        self.rank = {self.pieces[i]: levels[scores[i]] for i in usable}
        self.byte_ids = [0] * 256
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.longest = max(map(len, self.ids))
        self.characters = {p for p in self.ids if len(p) == 1}
        #: Two characters in a row that some piece holds.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: A text may be cut before a space that follows another character.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: A line break that no piece holds is always a byte of its own.
        self.lines = not any("\n" in p for p in self.ids)

    def count(self, text: str) -> int:
        """Symbols left of ``text`` (spaces written as U+2581): each character
        is a symbol (a character without a piece: its bytes), and each merge
        takes one away.  A heap entry is rank * 2**32 + left position; it is
        stale if the pair that now starts there has another rank."""
        left = len(text)
        if not self.characters.issuperset(text):
            left = sum(1 if c in self.characters else len(c.encode()) for c in text)
        return left - self._merge(list(text), text)

    def _merge(self, sym: list[str], text: str) -> int:
        """Merge the characters of ``text``, listed in ``sym``, in place (a
        symbol that was merged away becomes empty); the number of merges."""
        rank = self.rank.get
        merges, n = 0, len(sym)
        heap = [r << 32 | i for i, r in enumerate(map(rank, map(str.__add__, text, text[1:]))) if r is not None]
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or not sym[i]:
                continue
            merged = sym[i] + sym[j]
            if rank(merged) != entry >> 32:
                continue
            merges += 1
            sym[i] = merged
            sym[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(merged + sym[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank(sym[h] + merged)
                if r is not None:
                    heappush(heap, r << 32 | h)
        return merges

    def safe_parts(self, text: str) -> list[str]:
        """``text`` cut wherever no piece holds the two characters in a row,
        so that no merge reaches over a cut."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(map(str.__add__, text, text[1:]), 1) if pair not in inside]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def beside(self, left: str, right: str) -> bool:
        """Whether the two pieces may stand side by side in an encoding: merging
        ``left + right`` gives them back."""
        sym = list(left + right)
        self._merge(sym, left + right)
        return [x for x in sym if x] == [left, right]


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))
