"""Mixing sources to target weights (operator 3).

DataFrame functions only.  Every document gets a hash-random key; within a source the documents are cut into ranges of
that key, sorted in each range, and running token counts are the sums of the ranges before plus a running sum inside.
A source with target t and size s gives floor(t / s) whole epochs and then the documents before the point where the
running count meets the rest of the budget.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, after all others; a null
doc_id has a key like any other; repeated rows are rows of their own; empty tables give empty results; sources without
words have target 0.  Extra columns are ignored by mix() and kept by materialise().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, text_of, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Hexadecimal digits of the key that name its range: 4096 ranges a source.
RANGE_DIGITS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Targets are the level l for which sum(min(most * size, l * weight)) is share times all sizes: what sources cannot
    take is shared again by weight.  Sources meet their cap in the order of size / weight, so one running sum finds l.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.select("source", "source_size", pick.alias("weight"))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_at", F.col("_cap") / F.col("weight"))
    rank = Window.orderBy("_at", F.col("source").asc_nulls_last())
    done, rest, every = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing), rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(done), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.max(F.when(F.col("_level") <= F.col("_at"), F.col("_level"))).over(every)
    return s.select("source", "source_size", "weight", F.round(F.coalesce(F.least(F.col("_cap"), level * F.col("weight")), F.col("_cap")), 6).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and text_hash for every document.

    taken counts words, repeats included, cut at exactly floor(target); copies is that in whole documents, where the
    one on the cut is in if its middle is.
    """
    size = F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    text_hash = F.md5(text_of().cast("binary"))  # in the key, as very many rows may share a doc_id
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text_hash))
    d = docs.select("doc_id", "source", size.alias("size"), key.alias("_key"), text_hash.alias("text_hash"))
    d = d.withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    ranges = d.groupBy("source", "_range").agg(F.sum("size").alias("_n"))
    aims = targets(ranges.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, most)
    aims = aims.select(F.col("source").alias("_source"), "source_size", "target")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(aims, F.col("source").eqNullSafe(F.col("_source")))
    ranges = ranges.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before", "source_size", "target")
    inside = Window.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    budget = F.floor("target").cast("long")
    d = d.withColumn("_start", F.col("_before") + F.col("_in")).withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    d = d.withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - F.col("_start")))
    return d.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("_epochs") * F.col("size") + part).alias("taken"),
        (F.col("_epochs") + F.when((part * 2 >= F.col("size")) & (part > 0), 1).otherwise(0)).alias("copies"),
        "text_hash",
    )


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row as often as copies says, with all columns of the input.

    copies depends on doc_id, source and text alone up to ties, so it is joined back on these; rows that agree in all three are
    numbered in both tables.
    """
    doc, source, hashed, row, copies, copy, d, s, h, k = unused(docs, "_doc", "_source", "_hash", "_row", "_copies", "_copy", "_d", "_s", "_h", "_k")
    plan = mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("text_hash").alias(h), F.col("copies").alias(copies))
    plan = plan.withColumn(k, F.row_number().over(Window.partitionBy(d, s, h).orderBy(F.desc(copies))))
    rows = docs.withColumns({doc: F.col("doc_id"), source: F.col("source"), hashed: F.md5(text_of().cast("binary"))})
    rows = rows.withColumn(row, F.row_number().over(Window.partitionBy(doc, source, hashed).orderBy(F.lit(0))))
    same = F.col(doc).eqNullSafe(F.col(d)) & F.col(source).eqNullSafe(F.col(s)) & (F.col(hashed) == F.col(h)) & (F.col(row) == F.col(k))
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return rows.join(plan, same).withColumn(copy, every).select(*columns_of(docs))
