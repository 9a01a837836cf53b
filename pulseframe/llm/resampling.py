"""Importance resampling towards a target distribution (operator 12).

A feature is a run of one to three consecutive words, known by its bucket (CRC-32 of its bytes modulo the buckets).  Counts of
all documents and of all target texts give each bucket a gain; a document's weight is the sum of its features' gains, computed
over arrays of words: the checksum of a run follows from those of its words, as the checksum of joined strings is linear in
them.  weight plus Gumbel noise from the doc_id is the score, and the greatest scores are a draw without replacement.

The draw: partitions sort their eligible rows into runs; runs are dealt by sampled splitters into ranges of the order, of which
those behind the exact draw count (known from exact counts of the ranges) are not sent at all.  A range merges its runs with a
tournament tree, reading each run block by block in the order of the blocks' first keys, so it holds at most a block of each
run, and stops at the exact draw count.  Ranks are the counts of the ranges before plus the place in the merge.

Defined cases: null and empty texts have no features and weight 0; a null doc_id is the empty string for the noise and sorts
before the others; rows with equal score and doc_id follow by falling number of features, then in a fixed order of their own; an
empty target leaves the corpus counts alone to decide; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _LOWER, LONG_WORD, PIECE, encode, pieces
from .common import cut, drop_path, id_of, name_of, partitions, scratch_path

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 5, 20, 42
#: Rows of a run's block, rows of a range, ranges at most, and rows sampled for each splitter.
BLOCK, RANGE_ROWS, RANGES, SAMPLE = 4096, 1_000_000, 4096, 32
_POLYNOMIAL = 0xEDB88320
#: Bytes of words: digits, lower-case letters and all beyond ASCII.
_WORD = np.array([48 <= i <= 57 or 97 <= i <= 122 or i >= 128 for i in range(256)])
KEY = ["score", "_id", "n_features", "row"]


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_STEP = _byte_table()


def _shift_tables() -> list[np.ndarray]:
    """For each power of two: what a checksum becomes by so many bytes behind it, by the checksum's four bytes."""
    out = [np.stack([(c >> np.uint32(8)) ^ _STEP[c & 255] for c in (np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4))])]
    for _ in range(31):
        out.append(np.stack([_through(out[-1], row) for row in out[-1]]))
    return out


def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


_SHIFT = _shift_tables()


def joined_checksum(a: np.ndarray, b: np.ndarray, b_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from those of the parts and the second's length."""
    a = a.copy()
    for bit in range(int(b_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero(b_bytes >> bit & 1)
        a[at] = _through(_SHIFT[bit], a[at])
    return a ^ b


def _checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    c = np.full(len(start), 0xFFFFFFFF, np.uint32)
    short = np.flatnonzero(size <= LONG_WORD)
    for k in range(int(size[short].max(initial=0))):
        short = short[size[short] > k]
        c[short] = _STEP[(c[short] ^ data[start[short] + k]) & 255] ^ (c[short] >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        c[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return c


def _runs(texts: list[bytes], skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Checksums of all features of some texts, the text of each, words a text, and where the words start.

    skip: so many words of the (only) text were seen before; features that end in these are left out.
    """
    data = _LOWER[np.frombuffer(b"\0".join([b"", *texts, b""]), np.uint8)]
    word = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    doc = np.searchsorted(ends, start, side="right")
    c, size = _checksums(data, start, end), end - start
    space = np.full(len(c), zlib.crc32(b" "), np.uint32)
    one = np.ones(len(c), np.int64)
    before = joined_checksum(c, space, one)  # with the space behind
    found, who = [c[skip:]], [doc[skip:]]
    for n in (2, 3):
        k = max(0, len(c) - n + 1)
        whole = joined_checksum(before[:k], c[n - 1 :], size[n - 1 :])
        good = doc[:k] == doc[n - 1 :]
        good[: max(0, skip - n + 1)] = False
        found.append(whole[good])
        who.append(doc[:k][good])
        before = joined_checksum(whole, space[:k], one[:k])
    return np.concatenate(found), np.concatenate(who), np.bincount(doc[skip:], minlength=len(texts)), start


def _cut(text: bytes) -> list[bytes]:
    """Parts of about a piece; no word is cut."""
    parts, at = [], 0
    while len(text) - at > PIECE:
        to = at + PIECE
        while to < len(text) and _WORD[_LOWER[text[to]]]:
            to += 1
        parts.append(text[at:to])
        at = to
    return [*parts, text[at:]]


def features(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of some texts, buckets of their features, the text of each feature (by place in the numbers), words a text; a long text comes in several."""
    for numbers, group in pieces(texts):
        if len(group) > 1 or len(group[0]) <= 2 * PIECE:
            c, who, n, _ = _runs(group)
            yield numbers, c % np.uint32(buckets), who, n
            continue
        tail, seen = b"", 0
        for part in _cut(group[0]):
            raw = tail + part
            c, who, n, start = _runs([raw], seen)
            yield numbers, c % np.uint32(buckets), who, n
            seen = min(2, len(start))
            tail = raw[int(start[-seen]) - 1 :] if seen else b""  # the array has a byte of its own in front


def bucket_counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features by bucket over all rows of a table with text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, c, _, _ in features([encode(t) for t in b["text"]], buckets):
                total += np.bincount(c, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = df.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of smoothed shares, by bucket."""
    s, t, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + k) / (float(a + 1) * float(t + k)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """_id, n_words, n_features, weight, score of every document."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, count, weight = (np.zeros(len(b), np.int64) for _ in range(3))
            for numbers, c, who, n in features([encode(t) for t in b["text"]], buckets):
                words[numbers] += n
                count[numbers] += np.bincount(who, minlength=len(numbers))
                np.add.at(weight, np.array(numbers)[who], gain[c])
            yield pd.DataFrame({"_id": b["_id"], "n_words": words, "n_features": count, "weight": weight, "h": b["h"]})

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    rows = docs.select(id_of().alias("_id"), h.alias("h"), "text").mapInPandas(run, "_id long, n_words long, n_features long, weight long, h long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((F.col("h") + 0.5) / 4294967296.0))).cast("long")
    return rows.select("_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


class Tournament:
    """A tournament tree over runs: the winner is the smallest head; a new head replays the matches on its way up only.

    Runs without a head lose against all others.
    """

    def __init__(self, runs: int) -> None:
        self.size = 1 << max(0, runs - 1).bit_length()
        self.heads: list[tuple | None] = [None] * self.size
        self.winner = [-1] * (2 * self.size)

    def put(self, run: int, head: tuple | None) -> None:
        self.heads[run] = head
        at = run + self.size
        self.winner[at] = run if head is not None else -1
        while at > 1:
            at >>= 1
            a, b = self.winner[2 * at], self.winner[2 * at + 1]
            self.winner[at] = b if a < 0 else a if b < 0 or self.heads[a] < self.heads[b] else b

    def best(self) -> int:
        return self.winner[1]


def merged(blocks: Iterator[tuple[int, list[tuple]]], most: int) -> Iterator[tuple]:
    """The first most items of all runs in order; blocks are (run, its ascending items), by their first items.

    A block is read when the merge comes to its first item, so a run has one block in memory, or waits for its last item to go.
    """
    tree, slots = Tournament(2), {}
    rest: dict[int, list[list[tuple]]] = {}
    place: dict[int, tuple[list[tuple], int]] = {}
    ahead = next(blocks, None)
    while most > 0:
        w = tree.best()
        while ahead is not None and (w < 0 or ahead[1][0] <= tree.heads[w]):
            run, items = ahead
            slot = slots.setdefault(run, len(slots))
            if slot >= tree.size:
                wider = Tournament(2 * tree.size)
                for k, head in enumerate(tree.heads):
                    if head is not None:
                        wider.put(k, head)
                tree = wider
            if slot in place:
                rest.setdefault(slot, []).append(items)
            else:
                place[slot] = (items, 0)
                tree.put(slot, items[0])
            ahead, w = next(blocks, None), tree.best()
        if w < 0:
            return
        yield tree.heads[w]
        most -= 1
        items, at = place[w]
        if at + 1 < len(items):
            place[w] = (items, at + 1)
            tree.put(w, items[at + 1])
        elif rest.get(w):
            place[w] = (rest[w].pop(0), 0)
            tree.put(w, place[w][0][0])
        else:
            del place[w]
            tree.put(w, None)


def _keys(b: pd.DataFrame) -> list[tuple]:
    return list(zip((-b["score"]).tolist(), b["_id"].tolist(), (-b["n_features"]).tolist(), b["row"].tolist(), b["weight"].tolist(), strict=True))


def draw(rows: DataFrame, most: int, range_rows: int = RANGE_ROWS) -> tuple[DataFrame | None, tuple | None]:
    """The first most of eligible rows (score falling, _id, n_features falling, row) with their rank, and the last one's key."""
    spark = rows.sparkSession
    if most <= 0:
        return None, None
    parts = max(partitions(spark), min(RANGES, -(-most // range_rows)))
    every = max(1, 2 * most // (parts * SAMPLE))
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("score", "_id", "n_features", "row", "weight")
    lead = [(-r.score, r._id, -r.n_features, r.row) for r in sample.orderBy(F.desc("score"), "_id", F.desc("n_features"), "row").limit(2 * parts * SAMPLE).collect()]  # so many at most
    step = max(1, -(-len(lead) // (2 * parts)))
    splitters = lead[step::step]

    def range_of(key: tuple) -> int:
        return bisect_left(splitters, key[:4])

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(splitters) + 1, np.int64)
        edge = np.array([s[0] for s in splitters], np.int64)
        for b in batches:
            low, high = (np.searchsorted(edge, -b["score"].to_numpy(np.int64), side) for side in ("left", "right"))
            n += np.bincount(low[low == high], minlength=len(n))
            for key in _keys(b[low != high]):
                n[range_of(key)] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"part": at, "n": n[at]})

    counts = dict.fromkeys(range(len(splitters) + 1), 0)
    for r in rows.select("score", "_id", "n_features", "row", "weight").mapInPandas(tally, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():  # a row a range
        counts[r.part] = r.n
    first, before = {}, 0
    for p in range(len(splitters) + 1):
        if before >= most:
            break
        first[p] = before
        before += counts[p]
    final = max(first)
    top = splitters[final] if final < len(splitters) else None
    needed = rows if top is None else rows.where(F.col("score") >= -top[0])

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of this partition, in blocks; a run holds the rows that a batch brings."""
        for b in batches:
            if not len(b):
                continue
            by: dict[int, list[tuple]] = {}
            for key in sorted(_keys(b)):
                by.setdefault(range_of(key), []).append(key)
            run = int(b["row"].iloc[0])  # no other run holds this row
            for p, keys in by.items():
                if p in first:
                    for at in range(0, len(keys), BLOCK):
                        k = keys[at : at + BLOCK]
                        yield pd.DataFrame({"part": [p], "run": [run], "lead": [k[0][0]], "lead_id": [k[0][1]], "lead_n": [k[0][2]], "lead_row": [k[0][3]], "keys": [np.array(k, np.int64).tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream() -> Iterator[tuple[int, int, list[tuple]]]:
            for b in batches:
                for p, run, keys in zip(b["part"].tolist(), b["run"].tolist(), b["keys"], strict=True):
                    yield p, run, [tuple(k) for k in np.frombuffer(keys, np.int64).reshape(-1, 5).tolist()]

        every = stream()
        item = next(every, None)
        while item is not None:
            p = item[0]

            def of_part(p: int = p) -> Iterator[tuple[int, list[tuple]]]:
                nonlocal item
                while item is not None and item[0] == p:
                    now, item = item, next(every, None)
                    yield now[1:]

            out, rank = [], first[p]
            blocks = of_part()
            for key in merged(blocks, most - rank):
                rank += 1
                out.append((*key, rank))
                if len(out) >= 10_000:
                    yield _ranked(out)
                    out = []
            if out:
                yield _ranked(out)
            for _ in blocks:  # behind the draw
                pass

    runs = needed.select("score", "_id", "n_features", "row", "weight").mapInPandas(sort, "part long, run long, lead long, lead_id long, lead_n long, lead_row long, keys binary")
    dealt = runs.repartition(max(partitions(spark), len(first)), "part").sortWithinPartitions("part", "lead", "lead_id", "lead_n", "lead_row", "run")
    out = cut(dealt.mapInPandas(merge, "_id long, n_features long, weight long, score long, row long, rank long"))
    last = out.where(F.col("rank") == most).first()
    return out, (last.score, last._id, last.n_features, last.row)


def _ranked(out: list[tuple]) -> pd.DataFrame:
    score, ids, n, row, weight, rank = np.array(out, np.int64).T
    return pd.DataFrame({"_id": ids, "n_features": -n, "weight": weight, "score": -score, "row": row, "rank": rank})


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    percent of the documents with least_words or more are drawn, the greatest scores first.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "scores")
    scored(docs, target, buckets, seed).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    table = spark.read.parquet(path)
    eligible = table.where(F.col("n_words") >= least_words)
    drawn, last = draw(eligible, eligible.count() * percent // 100, range_rows)
    out = table.withColumn("rank", F.lit(None).cast("long"))
    if drawn is not None:
        s, i, n, r = (F.lit(v) for v in last)
        behind = (F.col("score") < s) | ((F.col("score") == s) & ((F.col("_id") > i) | ((F.col("_id") == i) & ((F.col("n_features") < n) | ((F.col("n_features") == n) & (F.col("row") > r))))))
        out = out.where((F.col("n_words") < least_words) | behind).drop("n_words").unionByName(drawn)
    out = cut(out.select(name_of().alias("doc_id"), "n_features", "weight", "score", "rank"))
    drop_path(spark, path)
    return out
