"""Tokenizing texts piece by piece.

Both public vocabularies never merge across the borders used here, so a text's ids are the ids of its pieces
in order. A piece (a word with its white space) is split into parts by the vocabulary's own pattern, and each
distinct part goes through the tokenizers library's model once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


_MAPPED = np.array([ord(c) for c in byte_characters()], "<u2")
_BYTE = {c: b for b, c in enumerate(byte_characters())}


def mapped(parts: list[bytes]) -> list[str]:
    """Parts in the byte alphabet. Between them stands the byte FF, which is in no UTF-8 text."""
    if not parts:
        return []
    joined = np.frombuffer(b"\xff".join(parts), np.uint8)
    return _MAPPED[joined].tobytes().decode("utf-16-le").split("\xff")


def unmapped(part: str) -> bytes:
    return bytes(map(_BYTE.__getitem__, part))


def plain(word: str) -> bool:
    """Whether all characters are Latin ones below U+0250, on which all Unicode versions agree."""
    return word.isascii() or max(word) < "ɐ"


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + len) one after the other."""
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(int(lens.sum()))


class Runs:
    """Keys and a run of integers for each. Beyond `limit` keys only those of the call at hand are kept, which bounds its memory."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.code: dict = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, keys: list, flat: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.code)
        self.code.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.starts, self.lens = room(self.starts, n, len(keys)), room(self.lens, n, len(keys))
        self.starts[n : n + len(keys)] = self.used + np.cumsum(lens) - lens
        self.lens[n : n + len(keys)] = lens
        self.flat = room(self.flat, self.used, len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def held(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        codes = np.fromiter(map(self.code.__getitem__, keys), np.int64, len(keys))
        lens = self.lens[codes]
        return self.flat[ragged(self.starts[codes], lens)], lens

    def get(self, keys: list, make: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All keys' runs in one array, and the runs' lengths. make: gives both for keys that aren't held yet."""
        new = list(dict.fromkeys(k for k in keys if k not in self.code))
        if new and len(self.code) + len(new) > self.limit:
            kept = list(set(keys).difference(new))
            runs = self.held(kept)
            self.clear()
            self.add(kept, *runs)
        if new:
            self.add(new, *make(new))
        return self.held(keys)


def room(buffer: np.ndarray, used: int, more: int) -> np.ndarray:
    """The buffer, or one of twice the size if more items don't fit behind those used."""
    if used + more <= len(buffer):
        return buffer
    grown = np.zeros(2 * (used + more), buffer.dtype)
    grown[:used] = buffer[:used]
    return grown


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over runs of counts values each; a run may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


class PieceTable:
    def __init__(self, model, split: Callable[[str], tuple], pieces: int = 400_000, parts: int = 1_000_000, special: dict[str, int] | None = None):
        """model: a tokenizer's model, for parts in the byte alphabet. split: a piece's parts. special: ids of parts that don't go through the model."""
        self.model, self.split, self.special = model, split, special or {}
        self.pieces, self.parts = Runs(pieces), Runs(parts)

    def _model(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lens, tokenize = [], [], self.model.tokenize
        for part, name in zip(parts, mapped(list(map(str.encode, parts))), strict=True):
            own = [token.id for token in tokenize(name)] if part not in self.special else [self.special[part]]
            ids += own
            lens.append(len(own))
        return np.array(ids, np.int32), np.array(lens, np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(self.split, pieces))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        parts = list(chain.from_iterable(split))
        if not parts:
            return np.zeros(0, np.int32), counts
        ids, lens = self.parts.get(parts, self._model)
        return ids, sums(lens, counts)

    def ids(self, pieces: pa.StringArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in one array, and their number per document. pieces: those of all documents, of which counts many are each one's."""
        coded = pieces.dictionary_encode()
        ids, lens = self.pieces.get(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._pieces)
        begins, at = np.cumsum(lens) - lens, coded.indices.to_numpy()
        lens = lens[at]
        return ids[ragged(begins[at], lens)], sums(lens, counts)
