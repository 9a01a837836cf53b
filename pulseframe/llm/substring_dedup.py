"""Substring deduplication by level-wise doubling (operator 6).

A window of twice the length can only repeat if both its halves do.  So windows of ``base`` words are looked at first;
those that repeat are extended to twice that length where the window that follows repeats too, and so on up to the
length that decides.  Up to there a level compares shortened hashes, which may let too much through and never too
little; the deciding level compares the windows that are left by 128 bits of the SHA-256 of their words.  A window's words
go if the same words start earlier: in a document with a smaller doc_id, or in the same one.

Doubling past the deciding length would change no removal, as a longer repeated window is a row of shorter ones; so the
levels end there, or earlier when no candidates survive.

Defined cases: null and empty texts have no words; a null doc_id counts as smaller than all others; rows with the same
doc_id follow each other in the order of a hash of their texts; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .arrays import encode, mixed, split_long, words
from .chunks import PART_BYTES, Chunks, ask_parts, bits_of, names_of, pack, pack_bits, parts_of, repeated, short_bits, unpack

WINDOW, BASE = 20, 5
#: Bytes of text whose windows meet in a part at the deciding level.
DECIDE_BYTES = 16 << 20
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _fold(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling and adding."""
    power, have, out = mixed(h + np.uint64(seed)), 1, None
    at = 0
    while n:
        if n & 1:
            out = power[: len(power)] if out is None else mixed(out[: len(h) - at - have + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + power[at:][: len(h) - at - have + 1])
            at += have
        n >>= 1
        if n:
            power = mixed(power[:-have] * np.uint64(0xC2B2AE3D27D4EB4F) + power[have:] + np.uint64(have)) if len(power) > have else power[:0]
            have *= 2
    return out


class _Chunk:
    """The words of a chunk's documents, in order."""

    def __init__(self, docs: pd.DataFrame) -> None:
        docs = docs.assign(_t=[encode(t) for t in docs["text"]]).sort_values(["_id", "_h"], kind="stable")
        self.ids, self.texts = names_of(docs["_id"].to_numpy(np.int64)), docs["_t"].to_list()
        self.first = int(docs["_id"].iloc[0]), int(docs["_h"].iloc[0])
        hashes, self.counts = [], []
        for t in self.texts:
            own = [words([p]).hash for p in split_long(t)] if t else []
            hashes += own
            self.counts.append(sum(map(len, own)))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        ends = np.cumsum(self.counts)
        self.left = np.repeat(ends, self.counts) - np.arange(len(self.hash))  # words from here to the document's end

    def runs(self, n: int, at: np.ndarray, seed: int) -> np.ndarray:
        return _fold(self.hash, n, seed)[at] if len(at) else np.zeros(0, np.uint64)

    def digests(self, n: int, at: np.ndarray) -> np.ndarray:
        """128 bits of the SHA-256 of the n words from each place on, joined by spaces: (places, 2)."""
        out, begin = [], 0
        for text, count in zip(self.texts, self.counts, strict=True):
            own = at[np.searchsorted(at, begin) : np.searchsorted(at, begin + count)] - begin
            if len(own):
                w = text.split()
                joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
                to = ends[own + n - 1] - 1
                start = ends[own] - np.fromiter((len(w[i]) + 1 for i in own.tolist()), np.int64, len(own))
                out.append(b"".join([hashlib.sha256(joined[a:b]).digest()[:16] for a, b in zip(start.tolist(), to.tolist(), strict=True)]))
            begin += count
        return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)

    def level(self, n: int, before: np.ndarray | None) -> np.ndarray:
        """Starts of the windows of n words that may repeat."""
        fits = np.flatnonzero(self.left >= n)
        if before is None:
            return fits
        half = np.zeros(len(self.hash), bool)
        half[before] = True
        return fits[half[fits] & half[fits + n // 2]]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every document."""
    lengths = [window]
    while lengths[0] % 2 == 0 and lengths[0] // 2 >= base:
        lengths.insert(0, lengths[0] // 2)
    with Chunks(docs) as chunks:
        return _dedup(chunks, window, lengths)


def _dedup(chunks: Chunks, window: int, lengths: list[int]) -> DataFrame:
    parts, decide_parts, bits = chunks.parts(PART_BYTES), chunks.parts(DECIDE_BYTES), short_bits(chunks.bytes)

    def short(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - bits)) << np.uint64(64 - bits)

    def candidates(c: _Chunk, got: dict, upto: int) -> np.ndarray | None:
        """Windows that repeat at all lengths before lengths[upto], and so may at that one."""
        before = None
        for k in range(upto):
            at = c.level(lengths[k], before)
            keys, back, count = np.unique(short(c.runs(lengths[k], at, k)), return_inverse=True, return_counts=True)
            before = at[((count > 1) | bits_of(got.get(k, []), len(keys)))[back]]
        return c.level(lengths[upto], before)

    for k, n in enumerate(lengths[:-1]):

        def question(d: pd.DataFrame, got: dict, k=k, n=n) -> list[tuple[int, bytes]]:
            c = _Chunk(d)
            return ask_parts(np.unique(short(c.runs(n, candidates(c, got, k), k))), parts)

        chunks.ask(question, repeated, k)
    last = len(lengths) - 1

    def decide(d: pd.DataFrame, got: dict) -> list[tuple[int, bytes]]:
        c = _Chunk(d)
        found = c.digests(window, candidates(c, got, last))
        one, two = _distinct(found[:, 0], found[:, 1])
        cuts = parts_of(one, decide_parts)
        return [(p, _two(one[a:b], two[a:b], c.first)) for p in range(decide_parts) if (a := cuts[p]) < (b := cuts[p + 1])]

    def earlier(blobs: list[bytes], names: list[int]) -> list[bytes]:
        """For each window of each chunk, whether a chunk of smaller documents has it."""
        every = [_untwo(b) for b in blobs]
        rank = np.empty(len(every), np.int64)
        rank[sorted(range(len(every)), key=lambda i: every[i][2])] = np.arange(len(every))
        one, two = np.concatenate([e[0] for e in every]), np.concatenate([e[1] for e in every])
        owner = np.repeat(rank, [len(e[0]) for e in every])
        order = np.lexsort((owner, two, one))
        new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
        seen = np.empty(len(order), bool)
        seen[order] = ~new
        return [pack_bits(x) for x in np.split(seen, np.cumsum([len(e[0]) for e in every])[:-1])]

    chunks.ask(decide, earlier, last)

    def result(d: pd.DataFrame, got: dict) -> pd.DataFrame:
        c = _Chunk(d)
        at = candidates(c, got, last)
        one, two = c.digests(window, at).T
        order = np.lexsort((at, two, one))
        new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))) if len(at) else np.zeros(0, bool)
        elsewhere = bits_of(got.get(last, []), int(new.sum()))[np.cumsum(new) - 1] if len(at) else new
        gone = np.zeros(len(c.hash) + 1, np.int64)
        hit = at[order][~new | elsewhere]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + window, -1)
        out = np.cumsum(gone[:-1]) > 0
        rows, begin = [], 0
        for doc_id, text, n in zip(c.ids, c.texts, c.counts, strict=True):
            mask = out[begin : begin + n]
            kept = [w for w, x in zip(text.split(), mask.tolist(), strict=True) if not x] if mask.any() else text.split()
            rows.append((doc_id, n, int(mask.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            begin += n
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"], dtype=object)

    return chunks.finish(result, SCHEMA)


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(one) else np.zeros(0, bool)
    return one[new], two[new]


def _two(one: np.ndarray, two: np.ndarray, first: tuple[int, int]) -> bytes:
    a, b = pack(one), pack(two)
    return b"".join(x.to_bytes(8, "little", signed=True) for x in first) + len(a).to_bytes(8, "little") + a + b


def _untwo(blob: bytes) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    n = int.from_bytes(blob[16:24], "little")
    first = int.from_bytes(blob[:8], "little", signed=True), int.from_bytes(blob[8:16], "little", signed=True)
    return unpack(blob[24 : 24 + n]), unpack(blob[24 + n :]), first
