"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 7).

A fingerprint's bit is 1 if it is set in over half of the XXH64 values of the text's word shingles.  Two fingerprints
link at up to ``radius`` differing bits.  Each distinct fingerprint emits all its variants within half the radius; two
fingerprints link if and only if they emit a common variant, so the variants are shuffled and those emitted twice or
more are looked up.

All 2081 variants (64 bits, radius 4) are emitted, but not one row each: variants that agree in their leading
``key_bits`` bits travel as one row (key, fingerprint) and are spread out where they arrive, which is where a key's
variants are sorted and compared.  A key with many fingerprints is dealt over several slices of its variants, each
found by a hash of the variant, so no task holds more than a bounded number of them at a time.  A variant's
fingerprints are all linked to each other, so a star to the smallest of them keeps every link's component.

Defined cases: a null, empty or white text has fingerprint 0, which links like any other; with fewer words than a
shingle the whole sequence is the shingle; equal fingerprints link, equal doc_ids alone do not; a null doc_id takes part and sorts before the
others; repeated rows each give a row; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, components, cut, id_of, name_of, partitions, text_of, unused

SEED = 42
#: Variants that a task sorts at a time.
AT_ONCE = 4_000_000
#: Rows whose variants are made together before those of other slices go.
MADE = 1024


def fingerprint(text: str | None, width: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    counts, n, step = np.zeros(64, np.int64), len(words) - width + 1, 65536
    for at in range(0, n, step):
        upto = min(n, at + step)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist(), strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """_id, hash (of the text) and fp (the fingerprint as a signed long) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "hash": b["hash"], "fp": np.array([fingerprint(t, width) for t in b["text"]], np.uint64).view(np.int64)})

    return docs.select(id_of().alias("_id"), F.xxhash64(text_of()).alias("hash"), "text").mapInPandas(run, "_id long, hash long, fp long")


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """For each number of flips up to most: the masks over so many low bits."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(bits), k)], np.uint64) for k in range(most + 1)]


def _mix(z: np.ndarray) -> np.ndarray:
    z = z * np.uint64(0x9E3779B97F4A7C15)
    return z ^ (z >> np.uint64(32))


def _links(key: np.ndarray, fp: np.ndarray, slices: np.ndarray, which: np.ndarray, key_bits: int, half: int) -> np.ndarray:
    """Pairs (smallest, other) of fingerprints that share a variant under one of the keys."""
    low = 64 - key_bits
    rest = np.uint64((1 << low) - 1)
    used = np.bitwise_count((fp >> np.uint64(low)) ^ key)
    masks = [np.concatenate(_masks(low, half - k)) for k in range(half + 1)]
    variants, owner = [], []
    for k in range(half + 1):
        every = np.flatnonzero(used == k)
        for at in range(0, len(every), MADE):
            rows = every[at : at + MADE]
            base = (key[rows] << np.uint64(low)) | (fp[rows] & rest)
            z, who = (base[:, None] ^ masks[k][None, :]).ravel(), np.repeat(rows.astype(np.int32), len(masks[k]))
            if (slices[rows] > 1).any():  # only this slice's are kept
                mine = (_mix(z) >> np.uint64(40)) % slices[who].astype(np.uint64) == which[who].astype(np.uint64)
                z, who = z[mine], who[mine]
            variants.append(z)
            owner.append(who)
    z, who = np.concatenate(variants), np.concatenate(owner)
    ordered = np.sort(z)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.empty((0, 2), np.uint64)
    bits = np.zeros(1 << 20, bool)
    bits[(_mix(twice) >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(_mix(z) >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(twice, z[maybe])
    hit = twice[np.minimum(at, len(twice) - 1)] == z[maybe]
    at, f = at[hit], fp[who[maybe[hit]]]
    first = np.full(len(twice), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(first, at, f)
    pairs = np.stack([first[at], f], axis=1)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    near = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * half  # verified, though a common variant implies it
    return np.unique(pairs[near], axis=0)


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to connect all within the radius."""
    spark = fps.sparkSession
    half = radius // 2
    n = fps.count()
    key_bits = int(min(28, max(12, np.ceil(np.log2(max(n, 1) * 2081 / 1_000_000)))))
    top = [int(m) for ms in _masks(key_bits, half) for m in ms]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = np.array(top, np.uint64)
        for b in batches:
            fp = b["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(fp), 4096):
                f = fp[at : at + 4096]
                keys = (f >> np.uint64(64 - key_bits))[:, None] ^ flips[None, :]
                yield pd.DataFrame({"key": keys.ravel().astype(np.int64), "fp": np.repeat(f.view(np.int64), len(flips))})

    rows = fps.select("fp").mapInPandas(emit, "key long, fp long")
    each = sum(len(m) for m in _masks(64, half)) / len(top)  # variants a row, on average
    # A key that many fingerprints stand close to is dealt over slices: each slice gets the key's rows and one part of its variants.
    home = F.shiftrightunsigned("fp", 64 - key_bits).alias("key")
    crowd = fps.groupBy(home).count().where(F.col("count") > max(2000, 64 * n / 2**key_bits))
    near = crowd.collect()  # bounded: each of these holds over 64 / 2**key_bits of all, so there are under 2**key_bits / 64
    slices: dict[int, int] = {}
    for r in near:
        for m in top:
            slices[r.key ^ m] = slices.get(r.key ^ m, 0) + r["count"]
    plan = {k: int(np.ceil(v * each * 8 / AT_ONCE)) for k, v in slices.items() if v * each * 8 > AT_ONCE}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in emit(batches):
            s = b["key"].map(plan).fillna(1).astype(np.int32) if plan else pd.Series(1, index=b.index, dtype=np.int32)
            out = b.assign(slices=s).loc[b.index.repeat(s)] if plan else b.assign(slices=s)
            yield out.assign(which=out.groupby(level=0).cumcount().astype(np.int32) if plan else np.int32(0))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def flush(b: pd.DataFrame) -> pd.DataFrame:
            got = _links(b["key"].to_numpy(np.int64).view(np.uint64), b["fp"].to_numpy(np.int64).view(np.uint64), b["slices"].to_numpy(), b["which"].to_numpy(), key_bits, half)
            return pd.DataFrame({"a": got[:, 0].view(np.int64), "b": got[:, 1].view(np.int64)})

        for b in batches:
            held.append(b)
            count += len(b)
            if count * each < AT_ONCE:
                continue
            b = pd.concat(held)
            last = (b["key"].to_numpy() == b["key"].iloc[-1]) & (b["which"].to_numpy() == b["which"].iloc[-1])
            if not last.all():
                yield flush(b[~last])
                b = b[last]
            held, count = [b], len(b)
        if held:
            yield flush(pd.concat(held))

    rows = fps.select("fp").mapInPandas(deal, "key long, fp long, slices int, which int")
    dealt = rows.repartition(partitions(spark), "key", "which").sortWithinPartitions("key", "which")
    return dealt.mapInPandas(meet, "a long, b long").distinct()


def _groups(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """_id, hash, fp of every document; and fp, _first (its smallest _id), _group (the smallest fp reachable) of every fingerprint."""
    if radius % 2:
        raise ValueError("the radius must be even")
    each = cut(fingerprints(docs, width))
    first = cut(each.groupBy("fp").agg(F.min("_id").alias("_first")))
    linked = components(ball_links(first.select("fp"), radius))
    return each, first.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "_first", F.coalesce("component", "fp").alias("_group"))


def _grouped(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """_id, hash, fp and _component (the smallest _id reachable) of every document."""
    each, named = _groups(docs, width, radius)
    smallest = named.groupBy("_group").agg(F.min("_first").alias("_component"))
    return each.join(cut(named.join(smallest, "_group").select("fp", "_component")), "fp")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id reachable) of every document."""
    return _grouped(docs, width, radius).select(name_of().alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), name_of("_component").alias("component_id"))


def first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One document of each _group, the one with the smallest doc_id, with all its columns; rows has _group, _id and hash.

    Of several rows with that doc_id the one whose text has the smallest hash stays.  A doc_id may stand in many groups,
    each of which keeps a row of its own.
    """
    firsts = cut(rows.groupBy("_group", "_id", "hash").agg(F.count("*").alias("_rows")).groupBy("_group").agg(F.min(F.struct("_id", "hash", "_rows")).alias("_r")).select("_r._id", "_r.hash", "_r._rows"))
    first_id, first_hash = unused(docs, "_first_id", "_first_hash")
    key = [id_of() == F.col(first_id), F.xxhash64(text_of()) == F.col(first_hash)]
    kept = docs.join(firsts.select(F.col("_id").alias(first_id), F.col("hash").alias(first_hash)), key, "left_semi")
    if firsts.where("_rows > 1").limit(1).count():  # rows that agree in doc_id and text
        kept = kept.select(id_of().alias("_id"), F.xxhash64(text_of()).alias("_hash"), F.struct(*columns_of(docs)).alias("_row"))
        kept = kept.groupBy("_id", "_hash").agg(F.min("_row").alias("_row")).select("_row.*")
    return kept


def keep_first(docs: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """One document of each group of linked fingerprints (see first_of_each)."""
    each, named = _groups(docs, width, radius)
    return first_of_each(docs, each.join(named.select("fp", "_group"), "fp"))
