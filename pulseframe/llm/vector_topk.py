"""Exact top-k by inner product with multi-resolution segment statistics (operator 11).

A vector is cut into 1, 4 and 16 segments; a segment is known by its mean and its deviation from that.  For two vectors these
bound the distance from below, sum of length * ((mean - mean')**2 + (dev - dev')**2), and so, as 2 <x, y> = |x|**2 + |y|**2 -
|x - y|**2, the inner product from above.  Vectors are ordered by octave of length and the interleaved bits of their four
means, and cut into blocks along that order.  A query is first answered in its own block, which gives it a threshold: its k-th
score so far.  Then it goes only to the blocks whose box (least and greatest mean and greatest deviation in each of 16 segments)
may hold more, and there meets the bounds from coarse to fine; exact products are computed for what survives.

Blocks have a bounded number of rows, and a block that very many queries come to is searched in slices of them, so no task
grows with the input.  The boxes are all that is broadcast; from ``BOXES`` blocks on neighbours share one.

Defined cases: components become floor(256 * x), those beyond 2**62 count as 2**62; vectors that are null or hold null or
non-finite components take no part; a shorter vector is filled with zeros, an empty one is all zeros; a null vec_id is no query
and sorts before the others; a query leaves out its own row only, not others with its vec_id or vector; rows that share a
vec_id are queries each; scores beyond 64 bits are the nearest 64-bit number; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, cut, drop_path, id_of, name_of, partitions, scratch_path

SCALE, LIMIT = 256, 2**62
SEGMENTS = (1, 4, 16)
#: Rows of a block, blocks with a box of their own, ranges of the order, and queries that a block is searched for at a time.
BLOCK, BOXES, RANGES, SLICE = 32768, 8192, 32768, 8192
#: Candidates by falling bound that are looked at first, to raise a query's threshold; queries whose bounds are computed together.
FIRST, TOGETHER = 32, 64
HITS = "query long, q_id long, score long, vec_id long, row long"
_MOST = np.iinfo(np.int64).max


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all rows' segments, each times the root of the segment's length; the columns are a multiple of 16."""
    w = x.reshape(len(x), segments, -1).astype(float)
    mean = w.mean(axis=2)
    return mean * np.sqrt(w.shape[2]), np.sqrt(((w - mean[:, :, None]) ** 2).sum(axis=2))


def _order(x: np.ndarray) -> np.ndarray:
    """Octave of length, then five bits of each of the four means, interleaved."""
    mean, _ = segment_statistics(x, 4)
    size = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    place = 32 / (1 + np.exp(-6.4 * mean / np.maximum(size, 1)[:, None]))
    place = np.minimum(place.astype(np.int64), 31)
    key = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1))), -1).astype(np.int64)
    for bit in range(4, -1, -1):
        for s in range(4):
            key = key * 2 + (place[:, s] >> bit & 1)
    return key


def _unpack(blobs: pd.Series, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), dims)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows with q."""
    if np.sqrt((x.astype(float) ** 2).sum(axis=1)).max(initial=0.0) * np.sqrt((q.astype(float) ** 2).sum()) < 2**52:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)  # all partial sums are whole numbers that a double holds
    ints = [int(v) for v in q]
    return np.array([max(-_MOST - 1, min(_MOST, sum(int(a) * b for a, b in zip(row, ints, strict=True)))) for row in x], np.int64)


def _below(score: float) -> float:
    """A threshold that no rounding of scores beyond 53 bits lifts over the score."""
    return score - abs(score) * 2.0**-51


class Searched:
    """The vectors of a block with their statistics, and the search for queries' best among them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.x, self.ids, self.rows = x, ids, rows
        self.levels = [np.hstack(segment_statistics(x, s)) for s in SEGMENTS]
        self.size = float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max(initial=0.0))
        self.exact = 0  # products computed

    def best(self, qs: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query: positions and scores, best first, of up to k rows other than own that score floor or more."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(qs), TOGETHER):
            q = qs[at : at + TOGETHER]
            slack = 1 + 1e-9 * self.size * np.sqrt((q.astype(float) ** 2).sum(axis=1))  # for the rounding of bounds
            least = floors[at : at + TOGETHER] - slack
            among, alive = np.arange(len(self.rows)), own[at : at + TOGETHER, None] != self.rows[None, :]
            bounds = np.zeros(alive.shape)
            for level, s in zip(self.levels, SEGMENTS, strict=True):
                bounds = np.hstack(segment_statistics(q, s)) @ (level if len(among) == len(level) else level[among]).T
                alive &= bounds >= least[:, None]
                some = alive.any(axis=0)
                if not some.all():
                    among, alive, bounds = among[some], alive[:, some], bounds[:, some]
            out += [self._one(q[i], among[a], bounds[i, a], floors[at + i], slack[i], k) for i, a in enumerate(alive)]
        return out

    def _one(self, q: np.ndarray, at: np.ndarray, bounds: np.ndarray, floor: float, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(at) > FIRST:
            lead = np.argpartition(-bounds, FIRST)[:FIRST]
            first = products(self.x[at[lead]], q)
            if k <= FIRST:
                floor = max(floor, _below(float(np.partition(first, FIRST - k)[FIRST - k])))
            keep = bounds + slack >= floor
            keep[lead] = False
            self.exact += FIRST + int(keep.sum())
            at, scores = np.concatenate([at[lead], at[keep]]), np.concatenate([first, products(self.x[at[keep]], q)])
        else:
            self.exact += len(at)
            scores = products(self.x[at], q)
        good = scores >= floor
        at, scores = at[good], scores[good]
        if len(at) > k:
            good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[good], scores[good]
        order = np.lexsort((self.rows[at], self.ids[at], ~scores))[:k]  # ~ falls as the score rises, without overflow
        return at[order], scores[order]


def _box(x: np.ndarray) -> bytes:
    mean, dev = segment_statistics(x, SEGMENTS[-1])
    return np.stack([mean.min(axis=0), mean.max(axis=0), dev.max(axis=0)]).tobytes()


def _hits(q: pd.DataFrame, vectors: np.ndarray, block: Searched, k: int) -> pd.DataFrame:
    got = block.best(vectors, q["row"].to_numpy(np.int64), q["floor"].to_numpy(float), k)
    each = [len(p) for p, _ in got]
    at, scores = (np.concatenate([g[i] for g in got] or [np.zeros(0, np.int64)]) for i in (0, 1))
    return pd.DataFrame({"query": np.repeat(q["row"].to_numpy(np.int64), each), "q_id": np.repeat(q["_id"].to_numpy(np.int64), each), "score": scores, "vec_id": block.ids[at], "row": block.rows[at]})


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, id_name: str = "vec_id", value: str = "embedding", block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each row whose id is divisible by every with all other rows."""
    spark = vectors.sparkSession
    whole = vectors.select(id_of(id_name).alias("_id"), F.col(value).cast("array<double>").alias("_e"))
    fine = F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = whole.where(F.col("_e").isNotNull() & fine)
    part = F.transform("_e", lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x, F.lit(-1e17)), F.lit(1e17)) * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long"))
    whole = whole.select("_id", part.alias("_v"))
    count, dims, most = whole.agg(F.count("*"), F.max(F.size("_v")), F.max(F.array_max(F.transform("_v", lambda x: F.abs(x))))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = -(-max(dims, 1) // SEGMENTS[-1]) * SEGMENTS[-1]
    kind = next((t for t in ("<i2", "<i4") if (most or 0) < np.iinfo(t).max), "<i8")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), dims), kind)
            for i, v in enumerate(b["_v"]):
                x[i, : len(v)] = v
            yield pd.DataFrame({"_id": b["_id"], "place": _order(x), "v": [r.tobytes() for r in x]})

    wanted = max(partitions(spark), -(-count // block_rows))
    ranges = min(wanted, RANGES)
    each = -(-wanted // ranges)  # blocks a range
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sub = F.least(F.floor(inside / F.lit(max(1, -(-count // (ranges * each))))), F.lit(each - 1)).cast("long")
    key = ["place", F.xxhash64("_id", "v"), "_id"]  # copies have one place and are spread by the rest
    ordered = whole.mapInPandas(packed, "_id long, place long, v binary").repartitionByRange(ranges, *key).sortWithinPartitions(*key)
    path = scratch_path(spark, "vectors")
    ordered.select("_id", "v", F.monotonically_increasing_id().alias("row"), (F.spark_partition_id().cast("long") * each + sub).alias("block")).write.parquet(path)
    table = spark.read.parquet(path)
    asked = F.col("_id") != NO_ID
    asked = asked & (F.col("_id") % every == 0)

    def at_home(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x = _unpack(b["v"], dims, kind)
        ids, rows = b["_id"].to_numpy(np.int64), b["row"].to_numpy(np.int64)
        mine = (ids != NO_ID) & (np.fmod(ids, every) == 0)
        got = _hits(b[mine].assign(floor=-np.inf), x[mine], Searched(x, ids, rows), k)
        return pd.concat([got, pd.DataFrame({"block": [key[0]], "box": [_box(x)]})])[["query", "q_id", "score", "vec_id", "row", "block", "box"]].astype({c.split()[0]: "Int64" for c in f"{HITS}, block long".split(", ")})

    first = cut(table.groupBy("block").applyInPandas(at_home, f"{HITS}, block long, box binary"))
    home = first.where("box is null").select(*[c.split()[0] for c in HITS.split(", ")])
    group = max(1, -(-(ranges * each) // BOXES))  # blocks that share a box
    shared = first.where("box is not null").select("block", "box", F.floor(F.col("block") / group).cast("long").alias("shared"))

    def merged(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        box = np.stack([np.frombuffer(v).reshape(3, -1) for v in b["box"]])
        return pd.DataFrame({"shared": [key[0]], "box": [np.stack([box[:, 0].min(axis=0), box[:, 1].max(axis=0), box[:, 2].max(axis=0)]).tobytes()]})

    boxes = shared.groupBy("shared").applyInPandas(merged, "shared long, box binary").orderBy("shared").collect()  # BOXES rows of 384 bytes at most
    names, box = np.array([r.shared for r in boxes]), np.stack([np.frombuffer(r.box).reshape(3, -1) for r in boxes])

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                q = b.iloc[at : at + 64]
                x = _unpack(q["v"], dims, kind)
                mean, dev = segment_statistics(x, SEGMENTS[-1])
                most = np.maximum(mean[:, None, :] * box[None, :, 0], mean[:, None, :] * box[None, :, 1]).sum(axis=2) + dev @ box[:, 2].T
                size = np.sqrt((x.astype(float) ** 2).sum(axis=1))
                slack = 1 + 1e-9 * size[:, None] * np.sqrt((np.maximum(np.abs(box[:, 0]), np.abs(box[:, 1])) ** 2 + box[:, 2] ** 2).sum(axis=1))[None, :]
                i, j = np.nonzero(most + slack >= q["floor"].to_numpy(float)[:, None])
                yield q.iloc[i].assign(shared=names[j])[["_id", "row", "v", "home", "floor", "shared"]]

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    floors = home.withColumn("_k", rank).where(F.col("_k") == k).select(F.col("query").alias("row"), (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 2.0**-51).alias("floor"))
    queries = table.where(asked).withColumnRenamed("block", "home").join(floors, "row", "left").select("_id", "row", "v", "home", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    sent = queries.mapInPandas(routed, "_id long, row long, v binary, home long, floor double, shared long")
    if group == 1:
        sent = sent.withColumn("block", F.col("shared"))
    else:
        last = F.least((F.col("shared") + 1) * group, F.lit(ranges * each)) - 1
        sent = sent.withColumn("block", F.explode(F.sequence(F.col("shared") * group, last)))
    sent = cut(sent.where("block <> home").withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(1 << 30))).drop("shared", "home"))
    load = sent.groupBy("block").count().select("block", F.ceil(F.col("count") / SLICE).cast("long").alias("slices"))
    load = cut(load)
    spread = sent.join(load, "block").withColumn("slice", F.col("slice") % F.col("slices"))
    split = table.join(load, "block").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))

    def search(key: tuple, b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        block = Searched(_unpack(b["v"], dims, kind), b["_id"].to_numpy(np.int64), b["row"].to_numpy(np.int64))
        return _hits(q, _unpack(q["v"], dims, kind), block, k)

    rest = split.select("block", "slice", "_id", "row", "v").groupBy("block", "slice").cogroup(spread.select("block", "slice", "_id", "row", "v", "floor").groupBy("block", "slice")).applyInPandas(search, HITS)
    out = cut(home.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k))
    drop_path(spark, path)
    return out.select(F.col("q_id").alias("query_id"), "rank", name_of("vec_id").alias("vec_id"), "score")
