"""Suffix-array deduplication by a common-prefix-aware distributed merge sort (operator 4).

A string of ``length`` bytes goes if it also starts in a document with a smaller doc_id.  Sorting all suffixes would
exchange dozens of bytes for each byte of input, so the sort is over anchored suffixes: each string of ``length`` bytes has
one anchor, the start of its k-gram with the smallest hash, and equal strings have equal anchors.  All strings around one
anchor are held by one entry: the suffix at the anchor (as far as these strings go) followed by the bytes before it,
backwards.  Entries whose k-gram stands in one document only cannot match and are left out; which these are is asked
first.

Then the entries are sorted over all chunks.  A sample of them gives splitters, so that each part is a range of suffixes.
Each chunk sorts its distinct entries into a run, front-codes it (common prefix with the entry before, then the rest) and
sends each part its range.  A part merges its runs with a loser tree that keeps the common prefix of each loser with the
winner: entries that differ there are not compared at all, others only beyond it.  In the merged order, with the common
prefixes that the tree found, the entries that share so many bytes from the anchor on are an interval; the bytes before
the anchor are ranked in the same way.  So a string is a pair of intervals, and its smallest document a minimum over
the entries in both.  The answer is that minimum for each entry and each of its strings.

A k-gram that so many different entries share that they would crowd a part (the sample shows these) is not sorted by
anchors: each string around it is an entry of its own, a plain suffix cut at ``length``, and parts may begin between them.

Defined cases: null and empty texts have no bytes; a null doc_id counts as smaller than all others; rows with equal
doc_id never remove from each other; any bytes may occur, zeros too; texts shorter than the length are left whole; an
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .arrays import encode, gram_hash, pieces, prefix_hash
from .chunks import PART_BYTES, Chunks, ask_parts, bits_of, names_of, pack, repeated, short_bits, unpack

LENGTH = 50
#: Bytes of text that arrays are made of at a time.
PIECE = 1 << 18
#: Zeros around a chunk's texts, as many as the longest length.
PAD = 250
#: Bytes of text whose entries meet in a part; a task holds one part at a time.
MERGE_BYTES = 16 << 20
#: The sample that splits the order into ranges: chunks at least, entries a chunk, entries a range; and the most ranges.
SPLIT_CHUNKS, SPLIT_EACH, SPLIT_RANGE = 32, 2048, 20
MOST_RANGES = 65536
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which the first known bytes are not looked at."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


class FrontCoded:
    """A sorted run of distinct byte strings: each as its common prefix with the one before and the rest."""

    @staticmethod
    def encode(run: list[bytes]) -> bytes:
        before, prefix, rest = b"", [], []
        for s in run:
            k = common_prefix(before, s)
            prefix.append(k)
            rest.append(s[k:])
            before = s
        head = np.array([prefix, [len(r) for r in rest]], np.uint16).tobytes()
        return len(run).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(head + b"".join(rest))

    @staticmethod
    def encode_rows(rows: np.ndarray, starts: list[int]) -> list[bytes]:
        """The same for ascending distinct rows of one width; a run begins at each of starts and the last one ends there."""
        prefix = np.zeros(len(rows), np.int64)
        if len(rows) > 1:
            prefix[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
        prefix[starts[:-1]] = 0
        rest = rows[np.arange(rows.shape[1])[None, :] >= prefix[:, None]]
        size = (rows.shape[1] - prefix).astype(np.uint16)
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        out, coder = [], zstandard.ZstdCompressor(level=1)
        for a, b in zip(starts, starts[1:], strict=False):
            head = np.stack([prefix[a:b].astype(np.uint16), size[a:b]]).tobytes()
            out.append((b - a).to_bytes(4, "little") + coder.compress(head + rest[ends[a] : ends[b]].tobytes()))
        return out

    @staticmethod
    def decode(blob: bytes) -> Iterator[tuple[bytes, int]]:
        """(string, common prefix with the one before)."""
        n = int.from_bytes(blob[:4], "little")
        raw = zstandard.ZstdDecompressor().decompress(blob[4:])
        prefix, size = np.frombuffer(raw, np.uint16, 2 * n).reshape(2, n).tolist()
        at, before = 4 * n, b""
        for k, m in zip(prefix, size, strict=True):
            before = before[:k] + raw[at : at + m]
            at += m
            yield before, k


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(string, run, common prefix with the string before) in order, from runs of (string, common prefix with the one before).

    A loser tree.  A loser at a node is kept with its common prefix with the string that beat it.  When a run moves on, its
    new string's common prefix with the last winner is known from front coding, and so is that of each loser on its way
    up: the one that shares more with the last winner is smaller; only at a tie are bytes compared, beyond the shared ones.
    """
    k = max(1, len(runs))
    heads: list[bytes | None] = [None] * k
    shared = [0] * k
    for i, run in enumerate(runs):
        if (x := next(run, None)) is not None:
            heads[i] = x[0]
    losers = [-1] * k

    def beats(i: int, j: int) -> bool:
        """Whether run i's head goes before run j's; the loser's shared becomes its common prefix with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            shared[j if b is None else i] = -1  # a run at its end shares less than any other
            return b is None and (a is not None or i < j)
        n = common_prefix(a, b, shared[i])
        first = a[n:] < b[n:] or (len(a) == len(b) == n and i < j)
        shared[j if first else i] = n
        return first

    # Played once from the leaves: node p has children 2p and 2p + 1, leaf i is node k + i.
    winner = [0] * (2 * k)
    for i in range(k):
        winner[k + i] = i
    for p in range(k - 1, 0, -1):
        i, j = winner[2 * p], winner[2 * p + 1]
        shared[i] = shared[j] = 0
        winner[p], losers[p] = (i, j) if beats(i, j) else (j, i)
    top = winner[1] if k > 1 else 0
    shared[top] = 0
    while heads[top] is not None:
        yield heads[top], top, shared[top]
        if (x := next(runs[top], None)) is None:
            heads[top], known = None, -1
        else:
            heads[top], known = x
        shared[top] = known
        i, p = top, (top + k) // 2
        while p:  # the one that shares more with the last winner is smaller, and the other keeps what it shares
            j = losers[p]
            if shared[j] > known or (shared[j] == known and beats(j, i)):
                losers[p], i = i, j
                known = shared[j]
            p //= 2
        top = i


def anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, k-gram hash) of each maximal row of strings with the same anchor."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    grams = gram_hash(prefix_hash(data), k)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - k + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    text = np.repeat(np.arange(len(texts)), size)[: len(low)]
    ok = np.flatnonzero(np.arange(len(low)) + length <= (begin + size)[text])
    at, of = (low[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64), text[ok]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])))) if len(ok) else none
    last = np.concatenate((new[1:] - 1, [len(ok) - 1])) if len(new) else none
    of, where = of[new], at[new]
    return of, where - begin[of], ok[new] - begin[of], ok[last] - begin[of], grams[where]


class _Chunk:
    def __init__(self, docs: pd.DataFrame, length: int, k: int) -> None:
        self.ids = docs["_id"].to_numpy(np.int64)
        self.texts = [encode(t) for t in docs["text"]]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.cumsum(size) - size
        self.data = np.frombuffer(b"".join([bytes(PAD), *self.texts, bytes(PAD)]), np.uint8)
        found = []
        for numbers, group in pieces(self.texts, PIECE):
            if len(group[0]) <= 8 * PIECE:
                part = anchors(group, length, k)
                found.append((np.array(numbers)[part[0]], *part[1:]))
                continue
            for a in range(0, len(group[0]) - length + 1, PIECE):  # a very long text, by its strings' starts
                part = anchors([group[0][a : a + PIECE + length - 1]], length, k)
                found.append((np.full(len(part[0]), numbers[0]), *(x + a for x in part[1:4]), part[4]))
        self.of, self.at, self.first, self.last, self.hash = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)

    def keys(self, short) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shortened hashes, each anchor's number among them, and which stand in two documents of this chunk."""
        keys, back = np.unique(short(self.hash), return_inverse=True)
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, back, self.ids[self.of])
        np.maximum.at(high, back, self.ids[self.of])
        return keys, back, low != high

    def items(self, some: np.ndarray, length: int, k: int, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, anchor, first start, last start, whether its k-gram is heavy); around heavy k-grams each start is an anchor of its own."""
        of, at, first, last = self.of[some], self.at[some], self.first[some], self.last[some]
        crowded = np.zeros(len(some), bool)
        if len(heavy) and len(some):
            crowded = np.isin(np.ascontiguousarray(self.rows(of, at, at, at, k, 0)[:, :k]).view(f"S{k}").ravel(), heavy)
        if crowded.any():
            n = np.where(crowded, last - first + 1, 1)
            back = np.repeat(np.arange(len(some)), n)
            start = first[back] + np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
            crowded = crowded[back]
            of, at, first, last = of[back], *(np.where(crowded, start, x[back]) for x in (at, first, last))
        return of, at, first, last, crowded

    def rows(self, of: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, room: int) -> np.ndarray:
        """The entries: suffix, its size, the bytes before it backwards, their size; padded with zeros."""
        out = np.zeros((len(of), length + room + 2), np.uint8)
        for a in range(0, len(of), 1 << 16):
            some = slice(a, a + (1 << 16))
            where = self.begin[of[some]] + at[some] + PAD
            right, left = last[some] + length - at[some], at[some] - first[some]
            x = out[some]
            x[:, :length] = self.data[where[:, None] + np.arange(length)] * (np.arange(length) < right[:, None])
            x[:, length] = right
            x[:, length + 1 : -1] = self.data[where[:, None] - 1 - np.arange(room)] * (np.arange(room) < left[:, None])
            x[:, -1] = left
        return out


class _Order:
    """Which part an entry belongs to: ranges of k-grams, then ranges of the strings around heavy k-grams."""

    def __init__(self, light: list[bytes], strings: list[bytes], heavy: list[bytes], length: int, k: int, each: int) -> None:
        self.light, self.strings, self.heavy = (np.array(x, f"S{n}") for x, n in ((light, k), (strings, length), (heavy, k)))
        self.length, self.k, self.each = length, k, each

    def parts(self, rows: np.ndarray, crowded: np.ndarray) -> np.ndarray:
        """each: into how many parts by hash a range is dealt, where there are more parts than ranges."""
        out = np.empty(len(rows), np.int64)
        for some, n, splitters, base in ((~crowded, self.k, self.light, 0), (crowded, self.length, self.strings, len(self.light) + 1)):
            own = np.ascontiguousarray(rows[some, :n])
            out[some] = (base + np.searchsorted(splitters, own.view(f"S{n}").ravel(), side="right")) * self.each
            if self.each > 1:
                out[some] += ((own.astype(np.uint64) * (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(axis=1) >> np.uint64(32)).astype(np.int64) % self.each
        return out


def _splitters(sample: list[bytes], ranges: int) -> list[bytes]:
    sample.sort()
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def _learn_order(chunks: Chunks, wanted: int, survivors, length: int, k: int) -> _Order:
    """The parts' bounds from a sample of entries that may match."""
    room = length - k
    ranges = min(wanted, MOST_RANGES)
    most = max(SPLIT_CHUNKS, -(-SPLIT_RANGE * ranges // SPLIT_EACH))

    def look(d: pd.DataFrame, got: dict) -> list[bytes]:
        c = _Chunk(d, length, k)
        of, at, first, last, _ = c.items(survivors(c, got), length, k, np.zeros(0, f"S{k}"))
        rows = np.unique(c.rows(of, at, first, last, length, room).view(f"S{length + room + 2}").ravel()) if len(of) else []
        return [bytes(r).ljust(length + room + 2, b"\0") for r in rows[:: max(1, -(-len(rows) // SPLIT_EACH))]]

    sample = chunks.peek(look, most)  # at most SPLIT_EACH entries of each
    share = len(sample) / ranges
    heavy = sorted(g for g, n in Counter(r[:k] for r in sample).items() if n >= max(8, share / 2))
    known = set(heavy)
    strings = []
    for n, r in enumerate(sample):
        if r[:k] in known:
            low, high = length - r[length], r[-1]  # strings with so many bytes before the anchor
            j = low + n % (high - low + 1)
            strings.append(r[length + 1 : length + 1 + j][::-1] + r[: length - j])
    parts = min(ranges, int(len(strings) * (room + 1) / max(1, share)) + 1)  # a heavy entry becomes up to room + 1 strings
    return _Order(_splitters([r[:k] for r in sample if r[:k] not in known], ranges), _splitters(strings, parts), heavy, length, k, -(-wanted // ranges))


def dedup_suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every document."""
    if not 4 <= length <= PAD:
        raise ValueError(f"the length must be from 4 to {PAD}")
    with Chunks(docs) as chunks:
        return _dedup(chunks, length)


def _dedup(chunks: Chunks, length: int) -> DataFrame:
    k = length // 2
    room = length - k
    width = length + room + 2
    parts, bits = chunks.parts(PART_BYTES), short_bits(chunks.bytes)

    def short(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - bits)) << np.uint64(64 - bits)

    def question(d: pd.DataFrame, got: dict) -> list[tuple[int, bytes]]:
        return ask_parts(_Chunk(d, length, k).keys(short)[0], parts)

    chunks.ask(question, repeated, 0)

    def survivors(c: _Chunk, got: dict) -> np.ndarray:
        """Anchors whose k-gram stands in another document too."""
        keys, back, twice = c.keys(short)
        return np.flatnonzero((twice | bits_of(got.get(0, []), len(keys)))[back])

    order = _learn_order(chunks, chunks.parts(MERGE_BYTES), survivors, length, k)

    def run_of(d: pd.DataFrame, got: dict) -> tuple[_Chunk, tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
        """The chunk; its items; its distinct entries by part and in order; their parts; each item's entry."""
        c = _Chunk(d, length, k)
        items = c.items(survivors(c, got), length, k, order.heavy)
        rows = c.rows(*items[:4], length, room)
        part = order.parts(rows, items[4])
        keyed = np.concatenate([part.astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
        distinct, entry = np.unique(keyed.view(f"S{width + 4}").ravel(), return_inverse=True)
        distinct = distinct.view(np.uint8).reshape(-1, width + 4)
        return c, items, distinct[:, 4:], np.ascontiguousarray(distinct[:, :4]).view(">u4").ravel().astype(np.int64), entry

    def send(d: pd.DataFrame, got: dict) -> list[tuple[int, bytes]]:
        c, items, rows, part, entry = run_of(d, got)
        if not len(rows):
            return []
        smallest = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(smallest, entry, c.ids[items[0]])
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))).tolist()
        runs = FrontCoded.encode_rows(rows, starts)
        return [(int(part[a]), len(run).to_bytes(8, "little") + run + pack(smallest[a:b])) for run, a, b in zip(runs, starts, starts[1:], strict=False)]

    def sort_and_compare(blobs: list[bytes], names: list[int]) -> list[bytes]:
        runs, ids = [], []
        for b in blobs:
            n = int.from_bytes(b[:8], "little")
            runs.append(FrontCoded.decode(b[8 : 8 + n]))
            ids.append(unpack(b[8 + n :]).view(np.int64))
        of, prefix, strings = [], [], []
        for s, r, n in merge(runs):
            of.append(r)
            prefix.append(n)
            if n < width or not strings:
                strings.append(s)
        prefix = np.array(prefix)
        new = prefix < width
        new[0] = True
        entry = np.cumsum(new) - 1
        by_run = np.argsort(np.array(of), kind="stable")  # places in the merged order, run by run
        smallest = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(smallest, entry[by_run], np.concatenate(ids))
        rows = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, width)
        every = minima(rows, prefix[new], smallest, length, room)
        ends = np.cumsum([len(i) for i in ids])
        return [_pack_answer(every[entry[x]]) for x in np.split(by_run, ends[:-1])]

    chunks.ask(send, sort_and_compare, 1)

    def result(d: pd.DataFrame, got: dict) -> pd.DataFrame:
        c, (of, at, first, last, _), rows, _, entry = run_of(d, got)
        gone = [[] for _ in c.texts]
        if len(of):
            smallest = np.concatenate([_unpack_answer(b) for b in got[1]]).reshape(len(rows), room + 1)[entry]
            start = at[:, None] - np.arange(room + 1)[None, :]
            goes = (smallest < c.ids[of][:, None]) & (start >= first[:, None]) & (start <= last[:, None])
            which, back = np.nonzero(goes)
            by_text = np.argsort(of[which], kind="stable")
            texts, starts = of[which][by_text], start[which, back][by_text]
            for t, own in zip(*_split(texts, starts), strict=True):
                gone[t] = own
        out = []
        for doc_id, text, starts in zip(names_of(c.ids), c.texts, gone, strict=True):
            n, spans, kept = 0, 0, text
            if len(starts):
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + length, -1)
                covered = np.cumsum(edge[:-1]) > 0
                n, spans = int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
            out.append((doc_id, len(text), n, spans, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], dtype=object)

    return chunks.finish(result, SCHEMA)


def minima(rows: np.ndarray, prefix: np.ndarray, smallest: np.ndarray, length: int, room: int) -> np.ndarray:
    """For ascending distinct entries and each number j of bytes before the anchor: the smallest document with that string.

    prefix is each entry's common prefix with the one before.  The string with j bytes before the anchor is shared by the
    entries of one interval of the order in which neighbours share length - j bytes, and of one interval of the order of
    the bytes before the anchor in which neighbours share j.
    """
    k = length - room
    out = np.repeat(smallest[:, None], room + 1, axis=1)
    new = prefix < k
    new[0] = True
    some = np.flatnonzero(~new | np.append(~new[1:], False))  # entries that share their k-gram with another one
    if not len(some):
        return out
    right, left = rows[some, length], rows[some, -1]
    before = np.ascontiguousarray(rows[some, length + 1 : -1])
    order = np.argsort(before.view(f"S{room}").ravel(), kind="stable")
    differ = before[order][1:] != before[order][:-1]
    shared = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), room)))
    own, interval = smallest[some], np.empty(len(some), np.int64)
    for j in range(room + 1):
        has = np.flatnonzero((right >= length - j) & (left >= j))
        if len(has) < 2:
            continue
        interval[order] = np.cumsum(shared < j)
        key = (np.cumsum(prefix[some] < length - j) * np.int64(len(some) + 1) + interval)[has]
        by_key = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], key[by_key][1:] != key[by_key][:-1])))
        low = np.minimum.reduceat(own[has][by_key], at)
        out[some[has[by_key]], j] = np.repeat(low, np.diff(np.append(at, len(has))))
    return out


def _pack_answer(x: np.ndarray) -> bytes:
    """Row by row, as stretches of equal numbers."""
    flat = x.ravel()
    at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    places = pack(np.append(at, len(flat)))
    return len(places).to_bytes(8, "little") + places + pack(flat[at])


def _unpack_answer(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.repeat(unpack(blob[8 + n :]).view(np.int64), np.diff(unpack(blob[8 : 8 + n]).view(np.int64)))


def _split(texts: np.ndarray, starts: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(texts):
        return [], []
    new = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1])))
    return texts[new].tolist(), np.split(starts, new[1:])

