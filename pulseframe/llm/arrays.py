"""Words and hashes of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits, the underscore and all beyond ASCII.
_LETTER = np.array([chr(i).isalnum() and i < 128 or i == 95 or i >= 128 for i in range(256)])
#: A..Z to a..z, other bytes unchanged.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts are cut into pieces of about so many bytes, at spaces, before arrays are made of them.
PIECE = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any slice follows; one longer than data."""
    up, _ = _Powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end), alike wherever a slice stands."""
    _, down = _Powers.upto(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all slices of n items, by start."""
    _, down = _Powers.upto(len(prefix))
    return mixed((prefix[n:] - prefix[:-n]) * down[: len(prefix) - n] + np.uint64(n))


@dataclass
class Words:
    """Words of some texts: ``data`` holds the texts, one space before each and one at the end."""

    data: np.ndarray
    prefix: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    n_docs: int

    def docs_from(self) -> np.ndarray:
        """The first word of each text, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words(texts: list[bytes], lower: bool = False, bare: bool = False) -> Words:
    """lower: A-Z as a-z. bare: without punctuation at the words' ends, and without words that are nothing else."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]  # the data begin and end with a space
    if bare:
        letter = _LETTER[data]
        rank = np.concatenate(([0], np.cumsum(letter, dtype=np.int64)))
        at = np.flatnonzero(letter)
        has = rank[end] > rank[start]
        start, end = start[has], end[has]
        start, end = at[rank[start]], at[rank[end] - 1] + 1
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    prefix = prefix_hash(data)
    hashes = slice_hash(prefix, start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():  # sums modulo a power of two are weak for long strings of a known kind
        hashes[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return Words(data, prefix, start, end, hashes, np.searchsorted(ends, start, side="right").astype(np.int32) if len(ends) else np.zeros(0, np.int32), len(texts))


def pieces(texts: list[bytes], size: int | None = None) -> Iterator[tuple[list[int], list[bytes]]]:
    """Whole texts in groups of about size bytes: their numbers, and the texts. A longer text is a group of its own."""
    size = size or PIECE
    numbers: list[int] = []
    group: list[bytes] = []
    held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield numbers, group
            numbers, group, held = [], [], 0
        numbers.append(i)
        group.append(t)
        held += len(t)
    if group:
        yield numbers, group


def split_long(text: bytes, size: int | None = None) -> list[bytes]:
    """Parts of a text of about size bytes, each ending with a space or at the text's end; no word is cut."""
    size = size or PIECE
    parts, at = [], 0
    while len(text) - at > size:
        to = at + size
        while to < len(text) and not _SPACE[text[to]]:
            to += 1
        parts.append(text[at:to])
        at = to
    parts.append(text[at:])
    return parts


def windowed_parts(text: bytes, span: int, step: int, lower: bool = False, bare: bool = False, size: int | None = None) -> Iterator[tuple[Words, int, int]]:
    """The windows of span words, one every step words, of one text of any length: (words of a part, words before it, its windows).

    A part begins where its first window does, so the windows are those of the uncut text: the first, and one more as long
    as words are left that no window holds.
    """
    tail, done = b"", 0
    cut = split_long(text, size)
    for i, piece in enumerate(cut):
        raw = tail + piece
        w = words([raw], lower, bare)
        n = len(w.start)
        if i + 1 == len(cut):
            count = 0 if n <= (span - step if done else 0) else 1 + max(0, -(-(n - span) // step))
        else:
            count = (n - span) // step + 1 if n >= span else 0
        if count:
            yield w, done, count
        tail = raw
        if count and i + 1 < len(cut):
            tail = raw[max(0, int(w.start[count * step]) - 2) :]  # with the character before the word; data begins with a space of its own
            done += count * step


def word_hashes(text: bytes, lower: bool = False, bare: bool = False) -> np.ndarray:
    """Hashes of the words of one text of any length."""
    return np.concatenate([words([p], lower, bare).hash for p in split_long(text)])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0xD6E8FEB86659FD93) + b)
