"""Clustering and classification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import graph


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds features: the columns, centred and scaled."""
    v = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df)
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(v).transform(v).drop("_raw")


#: Numbers of clusters that are fitted at the same time; a fit is a chain of short jobs, which leave cores idle between them.
FITS = 6


def kmeans(df: DataFrame, columns: list[str], ks: range = range(2, 8), seed: int = 42) -> DataFrame:
    """Adds cluster, for the number of clusters with the best silhouette (the first of equal ones)."""
    v = standardised(df, columns).persist()
    v.count()  # fills the cache once, before the fits share it

    def fitted(k: int) -> tuple[float, DataFrame]:
        out = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v)
        return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(out), out

    with ThreadPool(FITS) as pool:
        best = max(pool.map(inheritable_thread_target(fitted), ks, chunksize=1), key=lambda x: x[0])
    v.unpersist()
    return best[1].drop("features")


def dbscan(df: DataFrame, key: list[str], columns: list[str], tie: str, eps: float = 0.5, least: int = 3) -> DataFrame:
    """key, tie, cluster: density clusters of each group's rows, with the columns standardised in the group (see graph)."""
    return graph.density_clusters(df, key, columns, tie, eps, least).select(*key, tie, "cluster")


def centred_windows(df: DataFrame, key: list[str], position: str, value: str, label: str, half: int) -> DataFrame:
    """key, position, label, window: the values from half before to half after; rows near a series' ends are left out."""
    w = Window.partitionBy(*key).orderBy(position).rowsBetween(-half, half)
    return df.withColumn("window", F.collect_list(F.col(value).cast("double")).over(w)).where(F.size("window") == 2 * half + 1).select(*key, position, label, "window")


def forest(df: DataFrame, features: str, label: str, trees: int = 20, depth: int = 6, train: float = 0.7, seed: int = 42) -> tuple[RandomForestClassificationModel, DataFrame]:
    """A forest with balanced classes, fitted to a share of the rows by hash, and the other rows with probability and prediction."""
    place = F.pmod(F.xxhash64(features, label, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    d = df.withColumn("_v", array_to_vector(F.col(features))).withColumn("_part", place)
    n = d.count()
    counts = {r[label]: r["count"] for r in d.groupBy(label).count().collect()}  # one row a class
    weight = F.lit(1.0)
    for k, c in counts.items():
        weight = F.when(F.col(label) == k, n / (len(counts) * c)).otherwise(weight)
    d = d.withColumn("_weight", weight)
    model = RandomForestClassifier(featuresCol="_v", labelCol=label, weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed).fit(d.where(F.col("_part") < train))
    out = model.transform(d.where(F.col("_part") >= train)).withColumn("p", vector_to_array("probability")[1])
    return model, out.select(*df.columns, "p", "prediction")


def average_ranks(df: DataFrame, dataset: str, method: str, value: str) -> DataFrame:
    """Mean rank of each method over the datasets (larger values rank first; ties share their mean rank)."""
    w = Window.partitionBy(dataset)
    d = df.withColumn("_r", F.rank().over(w.orderBy(F.desc(value)))).withColumn("_c", F.count("*").over(Window.partitionBy(dataset, value)))
    return d.groupBy(method).agg(F.avg(F.col("_r") + (F.col("_c") - 1) / 2).alias("mean_rank"), F.count("*").alias("datasets"))


def _chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution, by the series or the continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, y = dof / 2, x / 2
    scale = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= y / (a + k)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * scale
    b, c = y + 1 - a, 1e300
    d = 1 / b
    out = d
    for k in range(1, 1000):
        b += 2
        d = 1 / (-k * (k - a) * d + b)
        c = b - k * (k - a) / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * scale


def friedman(df: DataFrame, dataset: str, method: str, value: str, alpha: float = 0.05) -> DataFrame:
    """k, n, chi2 (corrected for ties), p, and whether the methods differ at alpha; methods with fewer datasets than others are left out."""
    counts = df.groupBy(method).agg(F.count("*").alias("_n"))
    most = counts.withColumn("_most", F.max("_n").over(Window.partitionBy(F.lit(1)))).where("_n = _most").select(method)  # a row a method
    d = df.join(most, method)
    w = Window.partitionBy(dataset)
    d = d.withColumn("_r", F.rank().over(w.orderBy(F.desc(value)))).withColumn("_c", F.count("*").over(Window.partitionBy(dataset, value)))
    g = d.groupBy(method).agg(F.sum(F.col("_r") + (F.col("_c") - 1) / 2).alias("_s"), F.count("*").alias("n"), F.sum(F.pow("_c", F.lit(2)) - 1).alias("_t"))
    g = g.agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum("_t").alias("_t"))
    plain = 12 * F.col("_ss") / (F.col("n") * F.col("k") * (F.col("k") + 1)) - 3 * F.col("n") * (F.col("k") + 1)
    g = g.select("k", "n", (plain / (1 - F.col("_t") / (F.col("n") * F.col("k") * (F.pow("k", F.lit(2)) - 1)))).alias("chi2"))

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[_chi2_tail(x, int(k) - 1) for x, k in zip(b["chi2"], b["k"], strict=True)])

    return g.mapInPandas(tail, "k long, n long, chi2 double, p double").withColumn("differ", F.col("p") < alpha)


def _before(df: DataFrame, group: list[str], order: str, count: str) -> DataFrame:
    """Adds _before: the sum of count over the group's rows that stand before in the order, whose values are distinct in a group.

    Groups are few and large, so rows are dealt by ranges of the whole order; a range's rows are summed up by themselves and what
    the group has in ranges before is added: a row a range and group, and no task holds a group.
    """
    by = [*group, F.col(order).asc_nulls_last()]
    ranged = kept(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).withColumn("_range", F.spark_partition_id()))
    whole = ranged.groupBy("_range", *group).agg(F.sum(count).alias("_own"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("_range", *group, F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range", *group).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_before", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(F.broadcast(offsets), ["_range", *group])
    return out.select(*df.columns, (F.col("_before") + F.col("_offset")).alias("_before"))


def wilcoxon(df: DataFrame, dataset: str, method: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Signed-rank statistics of all pairs of methods: w (the smaller sum), n, z, p, p_holm, and whether the pair differs.

    Pairs that are equal are ranked with the others and then left out of the sums (n counts those that are left); z has
    their and the ties' correction, p is by the normal approximation, and Holm's rule sets the level.
    """
    a = df.select(F.col(dataset).alias("_d"), F.col(method).alias("a"), F.col(value).alias("_x"))
    b = df.select(F.col(dataset).alias("_e"), F.col(method).alias("b"), F.col(value).alias("_y"))
    d = a.join(b, (F.col("_d") == F.col("_e")) & (F.col("a") < F.col("b"))).withColumn("_diff", F.col("_x") - F.col("_y"))
    of_sign = lambda test: F.sum(F.when(test, 1).otherwise(0))
    d = d.groupBy("a", "b", F.abs("_diff").alias("_abs")).agg(F.count("*").alias("_c"), of_sign(F.col("_diff") > 0).alias("_up"), of_sign(F.col("_diff") < 0).alias("_down"), of_sign(F.col("_diff") == 0).alias("_zero"))
    d = _before(d, ["a", "b"], "_abs", "_c").withColumn("_rank", F.col("_before") + 1 + (F.col("_c") - 1) / 2)
    s = d.groupBy("a", "b").agg(
        F.sum(F.col("_up") * F.col("_rank")).alias("plus"), F.sum(F.col("_down") * F.col("_rank")).alias("minus"),
        F.sum("_c").alias("_n"), F.sum("_zero").alias("_z"), F.sum((F.col("_c") - F.col("_zero")) * (F.pow("_c", F.lit(2)) - 1)).alias("_t"),
    ).where("_n > _z")
    cubic = lambda c: F.col(c) * (F.col(c) + 1) * (2 * F.col(c) + 1)
    spread = F.sqrt((cubic("_n") - cubic("_z") - F.col("_t") / 2) / 24)
    middle = (F.col("_n") * (F.col("_n") + 1) - F.col("_z") * (F.col("_z") + 1)) / 4
    schema = "a string, b string, w double, n long, z double, p double, p_holm double"
    rows = s.withColumn("w", F.least("plus", "minus")).select("a", "b", "w", (F.col("_n") - F.col("_z")).alias("n"), ((F.col("w") - middle) / spread).alias("z"))

    def holm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(batches))  # one row a pair of methods
        p["p"] = [min(1.0, math.erfc(abs(z) / math.sqrt(2))) for z in p["z"]]
        p = p.sort_values(["p", "a", "b"])
        p["p_holm"] = np.minimum(1.0, np.maximum.accumulate(p["p"].to_numpy() * np.arange(len(p), 0, -1)))
        yield p

    return rows.coalesce(1).mapInPandas(holm, schema).withColumn("differ", F.col("p_holm") <= alpha)
