"""A bounded sample of labelled documents for fitting classifiers, and the held-out rule."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod modulus is rest; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, per_class: int, max_bytes: int) -> DataFrame:
    """_n, text, _label of at most per_class documents a class that are not held out.

    Whole texts: ids are taken in hash order while the texts' bytes stay within max_bytes.  A document labelled twice
    counts as the larger label; of several rows with one doc_id that whose text has the smallest hash is its text.  Only ids
    and sizes come to the driver, a row an id.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus, rest)).groupBy("doc_id").agg(F.max(label).alias("_label"))
    order = [F.xxhash64(F.col("doc_id"), F.lit(7)), F.col("doc_id")]
    picked = [r for k in (0, 1) for r in known.where(F.col("_label") == k).orderBy(*order).limit(per_class).collect()]
    ids = F.broadcast(spark.createDataFrame([(r.doc_id, r._label, n) for n, r in enumerate(picked)], "_id long, _label int, _n int"))  # 2 * per_class rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("_id"))
    rows = rows.withColumn("_t", F.xxhash64("text"))
    keep, left = [], max_bytes
    if picked:
        first = F.min(F.struct("_t", F.octet_length("text").alias("b"))).alias("c")
        for r in sorted(rows.groupBy("_n", F.xxhash64("doc_id").alias("h")).agg(first).collect(), key=lambda r: (r.h, r._n)):
            if r.c.b <= left:
                keep.append((r._n, r.c._t))
                left -= r.c.b
    chosen = F.broadcast(spark.createDataFrame(keep, "_n int, _t long"))  # 2 * per_class rows at most
    return rows.join(chosen, ["_n", "_t"]).groupBy("_n", "_label").agg(F.min("text").alias("text")).select("_n", "text", "_label")


def fit_in_task(rows: DataFrame, fit: Callable[[list[tuple[str, int]]], Any]) -> Any:
    """fit of a bounded sample's (text, label), run by one task, so that the driver holds the model alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [x for b in batches for x in zip(b["_n"], b["text"], b["_label"], strict=True)]
        yield pd.DataFrame({"model": [pickle.dumps(fit([(t, int(y)) for _, t, y in sorted(got)]))]})

    got = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(got.model) if got else fit([])  # without rows there may be no task either
