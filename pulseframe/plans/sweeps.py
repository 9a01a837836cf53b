"""Sweeps over thresholds and strategies as single jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, intervals, metrics
from ..sources.bridge import POST, PRE, THETA


def cluster_metrics(events: DataFrame, truth: DataFrame, hours: DataFrame, grid: DataFrame, theta: int, pre: int, post: int) -> DataFrame:
    """Metrics after clustering for each threshold of a small grid: threshold, alarms, clusters, counts, rates, score."""
    levels = sorted(r.threshold for r in grid.collect())  # a grid has at most as many rows as it was made of
    e = events.where(F.col("value") >= levels[0]) if levels else events.limit(0)
    r = clusters.sweep(e.withColumn("_gaps", F.array(F.lit(theta))), ["user_id"], "t", "event_id", "_gaps", "value", levels)
    named = F.element_at(F.array(*[F.lit(x) for x in levels]).cast("array<double>"), F.col("setting") + 1)
    r = r.withColumn("threshold", named)
    wide = truth.select("user_id", "seizure", (F.col("start") - pre).alias("_low"), (F.col("end") + post).alias("_high"))
    m = intervals.range_join(r.select("threshold", "user_id", "event_id", "t", "size"), wide, ["user_id"], "t", "_low", "_high", 12 * 3600 * 1_000_000, "left")
    m = m.groupBy("threshold", "user_id", "event_id", "size").agg(F.min("seizure").alias("seizure"))
    s = m.groupBy("threshold", "user_id").agg(F.sum("size").alias("alarms"), F.count("*").alias("clusters"), F.countDistinct("seizure").alias("detected"), F.count("seizure").alias("tp"))
    g = s.groupBy("threshold").agg(*[F.sum(x).alias(x) for x in ("alarms", "clusters", "detected", "tp")])
    total = truth.agg(F.count("*").alias("n_truth")).crossJoin(hours.agg(F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours")))  # one row each
    out = grid.join(g, "threshold", "left").na.fill(0).crossJoin(F.broadcast(total)).withColumn("fp", F.col("clusters") - F.col("tp"))
    out = out.withColumn("sensitivity", F.round(metrics.ratio(F.col("detected"), F.col("n_truth")), 6))
    out = out.withColumn("fa_per_hour", F.round(F.when(F.col("hours") > 0, F.col("fp") / F.col("hours")).otherwise(0.0), 6))
    return out.withColumn("score", F.round(metrics.challenge_score(F.col("sensitivity"), F.col("fa_per_hour")), 6))


CLUSTER_METRICS_SQL = f"""e0 AS (SELECT ti.threshold, e.user_id, e.event_id, e.t FROM ev e, ti WHERE e.value >= ti.threshold),
e1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY threshold, user_id ORDER BY t, event_id) > {THETA} THEN 1 ELSE 0 END AS nw FROM e0),
e2 AS (SELECT *, sum(nw) OVER (PARTITION BY threshold, user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS c FROM e1),
e3 AS (
  SELECT a.threshold, a.user_id, a.c, a.event_id, a.t, count(*) AS size,
    coalesce(CAST(sum(CASE WHEN b.t <> a.t THEN abs(a.t - b.t) END) AS DOUBLE) / nullif(sum(CASE WHEN b.t <> a.t THEN 1 ELSE 0 END), 0), 0) AS dist
  FROM e2 a JOIN e2 b ON a.threshold = b.threshold AND a.user_id = b.user_id AND a.c = b.c GROUP BY ALL),
e4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY threshold, user_id, c ORDER BY dist, t, event_id) AS r FROM e3) WHERE r = 1),
e5 AS (
  SELECT a.threshold, a.user_id, a.event_id, a.size, min(i.seizure) AS seizure
  FROM e4 a LEFT JOIN tr i ON a.user_id = i.user_id AND a.t BETWEEN i."start" - {PRE} AND i."end" + {POST} GROUP BY ALL),
e6 AS (SELECT threshold, user_id, sum(size) AS alarms, count(*) AS clusters, count(DISTINCT seizure) AS detected, count(seizure) AS tp FROM e5 GROUP BY ALL),
e7 AS (SELECT threshold, sum(alarms) AS alarms, sum(clusters) AS clusters, sum(detected) AS detected, sum(tp) AS tp FROM e6 GROUP BY threshold),
tt AS (SELECT (SELECT count(*) FROM tr) AS n_truth, (SELECT sum(hours) FROM hr) AS hours),
e8 AS (
  SELECT ti.threshold, CAST(coalesce(alarms, 0) AS BIGINT) AS alarms, CAST(coalesce(clusters, 0) AS BIGINT) AS clusters, n_truth, CAST(coalesce(detected, 0) AS BIGINT) AS detected,
    CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(clusters, 0) - coalesce(tp, 0) AS BIGINT) AS fp, hours
  FROM ti LEFT JOIN e7 ON ti.threshold = e7.threshold, tt),
e9 AS (SELECT *, round(CAST(detected AS DOUBLE) / nullif(n_truth, 0), 6) AS sensitivity, round(coalesce(fp / nullif(hours, 0), 0), 6) AS fa_per_hour FROM e8),
cu AS (SELECT *, round(CAST(100 AS DOUBLE) * sensitivity - CAST(0.4 AS DOUBLE) * fa_per_hour, 6) AS score FROM e9)"""


def sweep_counts(alarms: DataFrame, truth: DataFrame, thetas: list[int], pre: int, post: int) -> DataFrame:
    """theta, user_id, alarms0, alarms, fp0, fp, sens0, sens: each series before and after clustering by each gap."""
    a = alarms.select("user_id", "event_id", "t")
    gaps = F.array(*[F.lit(t).cast("long") for t in thetas])
    r = clusters.sweep(a.withColumn("_gaps", gaps), ["user_id"], "t", "event_id", "_gaps")
    r = r.select(F.element_at(gaps, F.col("setting") + 1).alias("theta"), "user_id", "event_id", "t")
    every = a.select(F.lit(0).cast("long").alias("theta"), "user_id", "event_id", "t").unionByName(r)
    wide = truth.select("user_id", "seizure", (F.col("start") - pre).alias("_low"), (F.col("end") + post).alias("_high"))
    m = intervals.range_join(every, wide, ["user_id"], "t", "_low", "_high", 12 * 3600 * 1_000_000, "left").groupBy("theta", "user_id", "event_id").agg(F.min("seizure").alias("seizure"))
    s = m.groupBy("theta", "user_id").agg(F.count("*").alias("alarms"), F.sum(F.col("seizure").isNull().cast("long")).alias("fp"), F.countDistinct("seizure").alias("detected"))
    s = s.join(truth.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").withColumn("sens", F.coalesce(F.col("detected") / F.col("n"), F.lit(0.0)))
    before = s.where("theta = 0").select("user_id", F.col("alarms").alias("alarms0"), F.col("fp").alias("fp0"), F.col("sens").alias("sens0"))
    return s.where("theta > 0").join(before, "user_id").select("theta", "user_id", "alarms0", "alarms", "fp0", "fp", "sens0", "sens")
