"""Reversible line deduplication: sharded cuckoo filters over exact reference tables (operator 10).

A line's key is the line without white space at both ends, A-Z lower-cased; the tables hold 128 bits of its SHA-256.  The
index has one reference for each (key, document) pair, dealt over shards by a hash of the pair, so a line that stands
in a third of all documents is spread over all shards.  Kept in the shared folder are, for each shard, its cuckoo filters
and the changes made to its exact table: a row with sign 1 for each reference that was added, -1 for each that was taken.

An insertion reads the shards' filters, not their tables.  References that the filters have surely not seen are new; only
the others are looked up in the exact table (its rows meet them before they are summed or shuffled), so inserting a document twice counts once.  A deletion looks up what the
filters may have, takes it out of both, and ignores what they surely lack.  Either writes the changed filters and the
new rows and nothing else, but for every eighth change, which also sums up the table.  A filter without room for a batch is built anew from its shard's table, twice as large.  Reference counts and the largest
document of a key are sums and maxima over the tables, combined before the shuffle.

Defined cases: a null or empty text is one empty line; a null doc_id counts as a document before all others; rows with
the same doc_id are one document for the counts, and each of them loses the same lines; empty tables give empty results.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import encode, mixed
from .common import cut, evenly, id_of, partitions, text_of

MIN_CHARS = 40
MIN_DOCS = 5
#: References that a shard of a new index is made for.
SHARD_ROWS = 250_000
MOST_PARTITIONS = 32768
#: Changes after which an index sums up its table.
COMPACT = 8
_BLANKS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CuckooFilter:
    """Approximate set of 64-bit values with deletion: four 16-bit tags a bucket, two buckets a value.

    Values that find no place after ``KICKS`` moves go to an exact overflow list, so nothing is ever lost.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int) -> None:
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.7)))))
        self.tags = np.zeros((self.buckets, self.SLOTS), np.uint16)
        self.overflow: dict[int, int] = {}

    def to_bytes(self) -> bytes:
        rest = np.array([[v, n] for v, n in self.overflow.items()], np.uint64).reshape(-1, 2)
        return self.buckets.to_bytes(8, "little") + self.tags.tobytes() + rest.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        f = cls(1)
        f.buckets = int.from_bytes(raw[:8], "little")
        end = 8 + 2 * cls.SLOTS * f.buckets
        f.tags = np.frombuffer(raw[8:end], np.uint16).reshape(-1, cls.SLOTS).copy()
        f.overflow = {int(v): int(n) for v, n in np.frombuffer(raw[end:], np.uint64).reshape(-1, 2)}
        return f

    def room(self) -> int:
        """How many more values it is made for."""
        return max(0, int(self.buckets * self.SLOTS * 0.85) - int(np.count_nonzero(self.tags)))

    def _places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(values.astype(np.uint64))
        tag = (h >> np.uint64(48)).astype(np.uint16)
        tag[tag == 0] = 1
        one = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return tag, one, self._other(one, tag)

    def _other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(tag.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def may_have(self, values: np.ndarray) -> np.ndarray:
        tag, one, two = self._places(values)
        found = (self.tags[one] == tag[:, None]).any(axis=1) | (self.tags[two] == tag[:, None]).any(axis=1)
        if self.overflow:
            found |= np.isin(values.astype(np.uint64), np.array(list(self.overflow), np.uint64))
        return found

    def add(self, values: np.ndarray) -> None:
        tag, one, two = self._places(values)
        left = np.arange(len(values))
        for bucket in (one, two):
            for slot in range(self.SLOTS):
                free = left[self.tags[bucket[left], slot] == 0]
                _, first = np.unique(bucket[free], return_index=True)
                self.tags[bucket[free[first]], slot] = tag[free[first]]
                left = np.setdiff1d(left, free[first], assume_unique=True)
        for i in left:
            self._kick(int(values[i]) & (2**64 - 1), int(tag[i]), int(two[i]))

    def _kick(self, value: int, tag: int, bucket: int) -> None:
        path = []
        for k in range(self.KICKS):
            free = np.flatnonzero(self.tags[bucket] == 0)
            if len(free):
                self.tags[bucket, free[0]] = tag
                return
            slot = (tag + k) % self.SLOTS
            path.append((bucket, slot, int(self.tags[bucket, slot])))
            self.tags[bucket, slot], tag = tag, int(self.tags[bucket, slot])
            bucket = int(self._other(np.array([bucket]), np.array([tag], np.uint16))[0])
        for bucket, slot, old in reversed(path):
            self.tags[bucket, slot] = old
        self.overflow[value] = self.overflow.get(value, 0) + 1

    def remove(self, values: np.ndarray) -> None:
        """Of values that were added."""
        tag, one, two = self._places(values)
        for v, t, a, b in zip(values.astype(np.uint64).tolist(), tag.tolist(), one.tolist(), two.tolist(), strict=True):
            if v in self.overflow:
                self.overflow[v] -= 1
                if not self.overflow[v]:
                    del self.overflow[v]
                continue
            for bucket in (a, b):
                at = np.flatnonzero(self.tags[bucket] == t)
                if len(at):
                    self.tags[bucket, at[0]] = 0
                    break


def key_of(line: Column) -> Column:
    return F.translate(F.regexp_replace(line, _BLANKS, ""), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key_hash(key: Column) -> Column:
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 32)


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_hash, key): the long lines of each row, once each."""
    keys = F.array_distinct(F.transform(F.filter(F.transform(lines_of(text_of()), key_of), lambda k: F.length(k) >= min_chars), _key_hash))
    return docs.select(id_of().alias("id"), F.xxhash64(text_of()).alias("text_hash"), F.explode(keys).alias("key"))


class LineIndex:
    """The references of all documents inserted so far; every change gives a new index and leaves the old one."""

    TABLE = "shard int, key string, id long, sign int"
    FILTERS = "shard int, room long, filter binary"
    #: Of a pass over shards: kind 0 is a shard's filter, 1 a row of its table, 2 a row of the batch.
    ROWS = "shard int, kind int, key string, id long, value long, room long, filter binary"

    def __init__(self, table: DataFrame, filters: DataFrame, shards: int, min_chars: int, changes: int = 0) -> None:
        self.table, self.filters, self.shards, self.min_chars, self.changes = table, filters, shards, min_chars, changes

    @classmethod
    def empty(cls, spark: SparkSession, shards: int | None = None, min_chars: int = MIN_CHARS) -> LineIndex:
        return cls(spark.createDataFrame([], cls.TABLE), spark.createDataFrame([], cls.FILTERS), shards or partitions(spark), min_chars)

    def live(self) -> DataFrame:
        """(shard, key, id): the references that are there."""
        return self.table.groupBy("shard", "key", "id").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def known(self, asked: DataFrame) -> DataFrame:
        """(key, id) of the references in asked that are there; no other row of the table is shuffled or summed."""
        own = self.table.join(asked.select("shard", "key", "id").distinct(), ["shard", "key", "id"], "left_semi")
        return own.groupBy("key", "id").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def counts(self) -> DataFrame:
        """(key, n_docs, last): reference count and largest document of each key."""
        return self.live().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("last"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; those that are there already are not counted again."""
        return self.insert_references(references(docs, self.min_chars))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes documents (their whole texts are needed) out again; those that are not there change nothing."""
        return self.delete_references(references(docs, self.min_chars))

    def insert_references(self, refs: DataFrame) -> LineIndex:
        batch = self._rows(refs, 2)
        met = self._pass(self._filter_rows().unionByName(self._to_rebuild(batch)).unionByName(batch), _probe_and_add)
        maybe = met.where("kind = 1").select("shard", "key", "id", "value")
        new, filters = met.where("kind = 2"), met.where("kind = 0")
        if maybe.limit(1).count():  # the exact table decides, and the filters get what it lacks
            missing = cut(maybe.join(self.known(maybe), ["key", "id"], "left_anti"))
            new = new.select("shard", "key", "id").unionByName(missing.select("shard", "key", "id"))
            if missing.limit(1).count():
                filters = self._pass(filters.unionByName(self._kind(missing, 2)), _add)
        return self._changed(new, 1, filters)

    def delete_references(self, refs: DataFrame) -> LineIndex:
        batch = self._rows(refs, 2)
        met = self._pass(self._filter_rows().unionByName(batch), _probe).where("kind = 1")
        gone = cut(met.select("shard", "key", "id", "value").join(self.known(met), ["key", "id"]))
        return self._changed(gone, -1, self._pass(self._filter_rows().unionByName(self._kind(gone, 2)), _remove))

    def _rows(self, refs: DataFrame, kind: int) -> DataFrame:
        shard = F.pmod(F.xxhash64("key", "id"), F.lit(self.shards)).cast("int").alias("shard")
        return self._kind(refs.select(shard, "key", "id", F.xxhash64("id", "key").alias("value")), kind)

    def _kind(self, rows: DataFrame, kind: int) -> DataFrame:
        return rows.select("shard", F.lit(kind).alias("kind"), "key", "id", "value", F.lit(0).cast("long").alias("room"), F.lit(None).cast("binary").alias("filter"))

    def _filter_rows(self) -> DataFrame:
        none = [F.lit(v).cast(t).alias(c) for c, t, v in (("key", "string", ""), ("id", "long", 0), ("value", "long", 0))]  # nulls would make floats of the numbers
        return self.filters.select("shard", F.lit(0).alias("kind"), *none, "room", "filter")

    def _to_rebuild(self, batch: DataFrame) -> DataFrame:
        """The table's rows of shards whose filter has no room for the batch."""
        full = cut(batch.groupBy("shard").count().join(self.filters, "shard").where(F.col("count") > F.col("room")).select("shard"))
        rows = self.live() if full.limit(1).count() else self.live().limit(0)
        return self._kind(rows.join(full, "shard").withColumn("value", F.xxhash64("id", "key")), 1)

    def _pass(self, rows: DataFrame, change: Callable[[CuckooFilter | None, pd.DataFrame, pd.DataFrame], tuple[CuckooFilter | None, pd.DataFrame]]) -> DataFrame:
        """change(filter, table rows, batch) -> the filter to keep and the rows to give, shard by shard."""

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            own = rows.loc[rows["kind"] == 0, "filter"]
            held = CuckooFilter.from_bytes(zstandard.ZstdDecompressor().decompress(own.iloc[0])) if len(own) else None
            held, out = change(held, rows[rows["kind"] == 1], rows[rows["kind"] == 2].drop_duplicates(["key", "id"]))
            if held is not None:
                blob = zstandard.ZstdCompressor(level=1).compress(held.to_bytes())
                kept = pd.DataFrame({"shard": [rows["shard"].iloc[0]], "kind": [0], "key": [""], "id": [0], "value": [0], "room": [held.room()], "filter": [blob]})
                out = pd.concat([out, kept]) if len(out) else kept
            return out

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for b in batches:
                for _, part in b.groupby("shard", sort=False):
                    if held and held[-1]["shard"].iloc[0] != part["shard"].iloc[0]:
                        yield one(pd.concat(held))
                        held = []
                    held.append(part)
            if held:
                yield one(pd.concat(held))

        dealt = rows.repartition(min(self.shards, MOST_PARTITIONS), evenly(F.col("shard"))).sortWithinPartitions("shard", "kind")
        return cut(dealt.mapInPandas(run, self.ROWS))

    def _changed(self, rows: DataFrame, sign: int, filters: DataFrame) -> LineIndex:
        """The index with these rows; after COMPACT changes the table is summed up, so that it does not grow with what came and went."""
        table, changes = self.table.unionByName(rows.select("shard", "key", "id", F.lit(sign).alias("sign"))), self.changes + 1
        new = LineIndex(table, filters.select("shard", "room", "filter"), self.shards, self.min_chars, changes)
        if changes >= COMPACT:
            new.table, new.changes = cut(new.live().withColumn("sign", F.lit(1))), 0
        return new


def _values(rows: pd.DataFrame) -> np.ndarray:
    return rows["value"].to_numpy(np.int64).view(np.uint64)


def _probe_and_add(held: CuckooFilter | None, table: pd.DataFrame, batch: pd.DataFrame) -> tuple[CuckooFilter | None, pd.DataFrame]:
    """Rows that the filter surely lacks are added and given as kind 2, the others as kind 1."""
    if held is None or len(table):
        held = CuckooFilter(2 * (len(table) + len(batch)))
        held.add(_values(table))
    maybe = held.may_have(_values(batch))
    held.add(_values(batch)[~maybe])
    return held, batch.assign(kind=np.where(maybe, 1, 2))


def _probe(held: CuckooFilter | None, table: pd.DataFrame, batch: pd.DataFrame) -> tuple[None, pd.DataFrame]:
    maybe = held.may_have(_values(batch)) if held is not None else np.zeros(len(batch), bool)
    return None, batch[maybe].assign(kind=1)


def _add(held: CuckooFilter | None, table: pd.DataFrame, batch: pd.DataFrame) -> tuple[CuckooFilter | None, pd.DataFrame]:
    if held is not None:
        held.add(_values(batch))
    return held, batch[:0]


def _remove(held: CuckooFilter | None, table: pd.DataFrame, batch: pd.DataFrame) -> tuple[CuckooFilter | None, pd.DataFrame]:
    if held is not None:
        held.remove(_values(batch))
    return held, batch[:0]


def _without(min_chars: int):
    """A column function: (text, keys that it loses) -> struct of kept text and number of dropped lines; texts without such keys are null."""

    @F.pandas_udf("kept string, dropped long")
    def run(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
        kept, dropped = [None] * len(texts), [0] * len(texts)
        for i, (text, keys) in enumerate(zip(texts, lost, strict=True)):
            if text is None or keys is None:
                continue
            gone, lines = set(keys), text.split("\n")
            stay = []
            for line in lines:
                key = line.strip(" \t\n\x0b\x0c\r")
                if len(key) < min_chars or hashlib.sha256(encode(key).lower()).hexdigest()[:32] not in gone:
                    stay.append(line)
            kept[i], dropped[i] = "\n".join(stay), len(lines) - len(stay)
        return pd.DataFrame({"kept": kept, "dropped": dropped})

    return run


def clean(docs: DataFrame, index: LineIndex, min_docs: int = MIN_DOCS, refs: DataFrame | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every document, by the index's counts; refs: references(docs), if they are there.

    A row's keys are its own lines, so no list is longer than a text, however many rows a doc_id has.
    """
    common = cut(index.counts().where(F.col("n_docs") >= min_docs))  # kept, so that the join can split a crowded key
    refs = references(docs, index.min_chars) if refs is None else refs
    lost = refs.join(common, "key").where("id <> last").groupBy("id", "text_hash").agg(F.collect_set("key").alias("_keys")).select(F.col("id").alias("_id"), F.col("text_hash").alias("_h"), "_keys")
    d = docs.select("doc_id", text_of().alias("_text"), id_of().alias("_i"), F.xxhash64(text_of()).alias("_own"))
    d = d.join(lost, (F.col("_i") == F.col("_id")) & (F.col("_own") == F.col("_h")), "left")
    # A document that loses all its lines keeps no line at all, which joins to the empty text.
    d = d.withColumn("_left", _without(index.min_chars)(F.when(F.col("_keys").isNotNull(), F.col("_text")), F.col("_keys")))
    return d.select("doc_id", F.size(lines_of(F.col("_text"))).cast("long").alias("n_lines"), F.col("_left.dropped").alias("n_dropped"), F.coalesce("_left.kept", "_text").alias("kept_text"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 2, revised: int = 16) -> DataFrame:
    """clean() by an index of all documents.

    They are inserted in several batches, and one in ``revised`` of them is deleted and inserted again, as a corpus that
    grows and is corrected would; the index is the same as after one insertion.
    """
    refs = cut(references(docs, min_chars))
    index = LineIndex.empty(docs.sparkSession, max(partitions(docs.sparkSession), -(-refs.count() // SHARD_ROWS)), min_chars)
    of = F.xxhash64("id", F.lit("batch"))
    for k in range(batches):
        index = index.insert_references(refs.where(F.pmod(of, F.lit(batches)) == k))
    some = refs.where(F.pmod(of, F.lit(revised)) == revised - 1)
    return clean(docs, index.delete_references(some).insert_references(some), min_docs, refs)
