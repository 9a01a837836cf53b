"""Questions about all documents that each chunk of documents asks and gets answered.

Exact and compact alternatives to shuffling a row for each position of each text.  The documents lie in chunks by ascending
doc_id, in a table written once to the shared folder and bucketed by chunk, so a pass over it moves no text.  In a pass
each chunk makes sorted, packed questions; they are dealt into parts by their leading bits; a part answers all its
chunks, each answer as long as the question or a bit for each key of it; the answers go back to the chunks in the next pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, drop_path, evenly, id_of, partitions, scratch_path, text_of

CHUNK_BYTES = 8 << 20
#: Bytes of text whose questions meet in a part, where these are a hash for each window.
PART_BYTES = 64 << 20
MOST_BUCKETS = 32768
QUESTION = "part int, chunk int, step int, blob binary"
ANSWER = "chunk int, step int, part int, blob binary"


def pack(keys: np.ndarray) -> bytes:
    """Any array of 64-bit integers; ascending ones take little more than the entropy of their gaps."""
    keys = np.ascontiguousarray(keys).view(np.uint64)
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=8 * n), np.uint8) if n else np.zeros(0, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_bits(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()


def unpack_bits(blob: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8, offset=8), count=int.from_bytes(blob[:8], "little")).astype(bool)


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's share of ascending 64-bit keys begins, and their number at the end."""
    cuts = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)]))


class Chunks:
    """The chunk table of some documents; a context, at whose end the table goes.

    Documents are ranged by (doc_id, hash of the text), so that neither a doc_id with very many rows nor a group of copies is one
    chunk.  A range is a file and a bucket; ranges larger than a chunk hold several, cut by row number.
    """

    def __init__(self, docs: DataFrame, chunk_bytes: int | None = None) -> None:
        self.spark = docs.sparkSession
        rows = docs.select(id_of().alias("_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("_h"))
        count, self.bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
        chunk_bytes = (chunk_bytes or CHUNK_BYTES) * min(8, max(1, self.bytes >> 40))  # up to eight times as large from 8 TiB on, so that questions stay large
        wanted = max(partitions(self.spark), -(-self.bytes // chunk_bytes))
        self.buckets = min(wanted, MOST_BUCKETS)
        each = -(-wanted // self.buckets)  # chunks a bucket
        self.chunks = self.buckets * each
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        sub = F.least(F.floor(row / F.lit(max(1, -(-count // self.chunks)))).cast("long"), F.lit(each - 1))
        ranged = rows.repartitionByRange(self.buckets, "_id", "_h").sortWithinPartitions("_id", "_h")
        ranged = ranged.withColumn("chunk", evenly(sub * self.buckets + F.spark_partition_id()))
        self.path = scratch_path(self.spark, "chunks")
        self.name = self.path.rsplit("/", 1)[1].replace("-", "_")
        ranged.write.bucketBy(self.buckets, "chunk").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.table = self.spark.table(self.name)
        self.answers = self.spark.createDataFrame([], ANSWER)

    def __enter__(self) -> Chunks:
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)

    def parts(self, part_bytes: int) -> int:
        """How many parts hold the questions about part_bytes of text each."""
        return max(partitions(self.spark), -(-self.bytes // part_bytes))

    def ask(self, question: Callable[[pd.DataFrame, dict], list[tuple[int, bytes]]], answer: Callable[[list[bytes], list[int]], list[bytes]], step: int) -> None:
        """question(documents, answers so far) -> (part, blob); answer(blobs of one part, their chunks) -> one blob for each."""

        def make(key: tuple, docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            rows = question(docs, _by_step(got)) if len(docs) else []
            return pd.DataFrame([(part, key[0], step, blob) for part, blob in rows], columns=["part", "chunk", "step", "blob"])

        def reply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for b in batches:
                for _, part in b.groupby("part", sort=False):
                    if held and held[-1]["part"].iloc[0] != part["part"].iloc[0]:
                        yield one(pd.concat(held))
                        held = []
                    held.append(part)
            if held:
                yield one(pd.concat(held))

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            blobs = answer(rows["blob"].to_list(), rows["chunk"].to_list())
            return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "step": step, "part": rows["part"].to_numpy(), "blob": blobs})

        asked = self._both().applyInPandas(make, QUESTION)
        n = max(partitions(self.spark), min(self.buckets, MOST_BUCKETS))
        got = asked.repartition(n, evenly(F.col("part"))).sortWithinPartitions("part").mapInPandas(reply, ANSWER)
        self.answers = self.answers.unionByName(cut(got))

    def peek(self, look: Callable[[pd.DataFrame, dict], list[bytes]], most: int) -> list[bytes]:
        """look(documents, answers so far) of most chunks, spread over all; for samples of a bounded size."""
        some = self.table.select("chunk").distinct().orderBy(F.xxhash64("chunk")).limit(most)
        names = [r.chunk for r in some.collect()]  # most at the most

        def make(key: tuple, docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"blob": look(docs, _by_step(got)) if len(docs) else []})

        table, answers = (x.where(F.col("chunk").isin(names)) for x in (self.table, self.answers))
        return [r.blob for r in table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(make, "blob binary").collect()] if names else []

    def finish(self, result: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str) -> DataFrame:
        """result(documents, answers) -> rows, kept apart from the chunk table."""

        def make(key: tuple, docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            return result(docs, _by_step(got)) if len(docs) else _empty(schema)

        return cut(self._both().applyInPandas(make, schema))

    def _both(self):
        return self.table.groupBy("chunk").cogroup(self.answers.groupBy("chunk"))


def _empty(schema: str) -> pd.DataFrame:
    return pd.DataFrame(columns=[c.split()[0] for c in schema.split(",")])


def names_of(ids: np.ndarray) -> list[int | None]:
    """doc_ids of the inner ids, as objects, so that a null beside them does not make floats of them."""
    return [None if i == NO_ID else i for i in ids.tolist()]


def _by_step(got: pd.DataFrame) -> dict[int, list[bytes]]:
    """The answers of each step, by part."""
    return {int(s): g.sort_values("part")["blob"].to_list() for s, g in got.groupby("step")}


def ask_parts(keys: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Questions about ascending distinct keys."""
    at = parts_of(keys, parts)
    return [(p, pack(keys[at[p] : at[p + 1]])) for p in range(parts) if at[p] < at[p + 1]]


def repeated(blobs: list[bytes], chunks: list[int]) -> list[bytes]:
    """For each key of each question, whether another chunk asks for it too."""
    keys = [unpack(b) for b in blobs]
    every = np.sort(np.concatenate(keys))
    twice = every[1:][every[1:] == every[:-1]]
    return [pack_bits(is_in(k, twice)) for k in keys]


def is_in(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return ordered[at] == keys


def bits_of(answers: list[bytes], n: int) -> np.ndarray:
    return np.concatenate([unpack_bits(b) for b in answers]) if answers else np.zeros(n, bool)


def short_bits(total_bytes: int) -> int:
    """How many leading bits of a hash tell keys apart well enough for a filter that only lets too much through."""
    return min(64, max(32, int(total_bytes).bit_length() + 8))
