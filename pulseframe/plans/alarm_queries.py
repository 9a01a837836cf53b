"""Queries over alarms and annotated intervals: clustering, matching, metrics, sweeps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import clusters, intervals, metrics
from ..sources import bridge
from ..sources.bridge import HOUR, POST, PRE, THETA
from .registry import query
from .sweeps import CLUSTER_METRICS_SQL, cluster_metrics, sweep_counts

KEY = ["user_id"]


def _clustered(spark: SparkSession, d: str, theta: int = THETA) -> DataFrame:
    return clusters.by_gap(bridge.alarms(spark, d), KEY, "t", theta, "event_id")


def _representatives(spark: SparkSession, d: str, theta: int = THETA) -> DataFrame:
    return clusters.representatives(_clustered(spark, d, theta), KEY, "t", "event_id")


def _counts(spark: SparkSession, d: str, alarms: DataFrame | None = None, pre: int = PRE, post: int = POST) -> DataFrame:
    a = _representatives(spark, d) if alarms is None else alarms
    return metrics.match_counts(a, bridge.truth(spark, d), bridge.hours(spark, d).select("user_id", "subject", "hours"), KEY, pre, post)


#: Clusters and representatives of the alarms in SQL; counts of each series for a table of alarms.
CLUSTERS = f"""c0 AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {THETA} THEN 1 ELSE 0 END AS nw FROM al),
cl AS (SELECT user_id, subject, event_id, t, score, sum(nw) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM c0),
pr AS (
  SELECT a.user_id, a.cluster, a.event_id, a.t, a.score,
    coalesce(CAST(sum(CASE WHEN b.t <> a.t THEN abs(a.t - b.t) END) AS DOUBLE) / nullif(sum(CASE WHEN b.t <> a.t THEN 1 ELSE 0 END), 0), 0) AS dist,
    count(*) AS size, max(b.t) - min(b.t) AS span
  FROM cl a JOIN cl b ON a.user_id = b.user_id AND a.cluster = b.cluster GROUP BY ALL),
rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cluster ORDER BY dist, t, event_id) AS r FROM pr) WHERE r = 1)"""


def _match_sql(alarms: str, pre: int = PRE, post: int = POST) -> str:
    return f"""ma AS (
  SELECT a.user_id, a.event_id, min(i.seizure) AS seizure
  FROM {alarms} a LEFT JOIN tr i ON a.user_id = i.user_id AND a.t BETWEEN i."start" - {pre} AND i."end" + {post} GROUP BY a.user_id, a.event_id),
co AS (
  SELECT h.user_id, h.subject, h.hours, CAST(coalesce(n.n, 0) AS BIGINT) AS n_truth, CAST(coalesce(m.detected, 0) AS BIGINT) AS detected,
    CAST(coalesce(m.tp, 0) AS BIGINT) AS tp, CAST(coalesce(m.fp, 0) AS BIGINT) AS fp
  FROM hr h LEFT JOIN (SELECT user_id, count(*) AS n FROM tr GROUP BY user_id) n ON n.user_id = h.user_id
  LEFT JOIN (SELECT user_id, count(DISTINCT seizure) AS detected, count(seizure) AS tp, count(*) - count(seizure) AS fp FROM ma GROUP BY user_id) m ON m.user_id = h.user_id)"""


_POOL = """CAST(coalesce(sum(n_truth), 0) AS BIGINT) AS n_truth, CAST(coalesce(sum(detected), 0) AS BIGINT) AS detected, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp,
  CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, round(coalesce(sum(hours), 0), 4) AS hours,
  round(CAST(sum(detected) AS DOUBLE) / nullif(sum(n_truth), 0), 6) AS sensitivity, round(coalesce(CAST(sum(fp) AS DOUBLE) / nullif(sum(hours), 0), 0), 6) AS fa_per_hour"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"hours": F.round("hours", 4), "sensitivity": F.round("sensitivity", 6), "fa_per_hour": F.round("fa_per_hour", 6)})


@query(f"WITH {CLUSTERS}, {_match_sql('rp')} SELECT {_POOL} FROM co")
def alarm_clusters_eval(spark: SparkSession, d: str) -> DataFrame:
    """Alarms, clusters by gap, representatives, first match against extended intervals, pooled metrics."""
    return _rounded(metrics.pooled(_counts(spark, d)))


@query(f"WITH {CLUSTERS} SELECT user_id, CAST(cluster AS BIGINT) AS cluster, event_id, t, score, size, span FROM rp")
def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    return _representatives(spark, d).select("user_id", F.col("cluster").cast("long").alias("cluster"), "event_id", "t", "score", "size", "span")


@query(f"""WITH {CLUSTERS},
p2 AS (SELECT *, CASE WHEN size > 1 THEN (SELECT sum(abs(pr.t - b.t)) FROM cl b WHERE b.user_id = pr.user_id AND b.cluster = pr.cluster) / CAST(size - 1 AS DOUBLE) ELSE 0 END AS d2 FROM pr)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, event_id, t, size FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cluster ORDER BY d2, t, event_id) AS r FROM p2) WHERE r = 1""")
def cluster_representatives_all_others(spark: SparkSession, d: str) -> DataFrame:
    r = clusters.representatives(_clustered(spark, d), KEY, "t", "event_id", distinct_times=False)
    return r.select("user_id", F.col("cluster").cast("long").alias("cluster"), "event_id", "t", "size")


@query(f"WITH {_match_sql('al')} SELECT {_POOL} FROM co")
def base_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.pooled(_counts(spark, d, bridge.alarms(spark, d))))


@query(f"WITH {_match_sql('al')} SELECT user_id, subject, round(hours, 4) AS hours, n_truth, detected, tp, fp FROM co")
def match_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, bridge.alarms(spark, d)).withColumn("hours", F.round("hours", 4))


THETAS = [2 * HOUR, 6 * HOUR, 12 * HOUR, 24 * HOUR, 48 * HOUR]
#: The test tables are sparser than recordings: what is a second there is so many microseconds here.
UNIT = 160 * 1_000_000
# The gaps of the strategy sweep, in seconds.
GAPS = [2, 5, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 300, 420, 600, 900, 1200, 1500, 1800]


@query("""WITH th AS (SELECT unnest([%s]) AS theta),
c0 AS (SELECT theta, user_id, event_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY theta, user_id ORDER BY t, event_id) > theta THEN 1 ELSE 0 END AS nw FROM al, th),
c1 AS (SELECT *, sum(nw) OVER (PARTITION BY theta, user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS c FROM c0),
c2 AS (SELECT theta, user_id, c, count(*) AS size FROM c1 GROUP BY ALL)
SELECT CAST(theta AS BIGINT) AS theta, count(*) AS clusters, max(size) AS largest, CAST(sum(size) AS BIGINT) AS alarms FROM c2 GROUP BY theta""" % ", ".join(f"CAST({t} AS BIGINT)" for t in THETAS))
def alarm_clusters_by_theta(spark: SparkSession, d: str) -> DataFrame:
    grid = F.explode(F.array(*[F.lit(t).cast("long") for t in THETAS])).alias("theta")
    a = bridge.alarms(spark, d).select("*", grid)
    c = clusters.by_gap(a, ["theta", "user_id"], "t", F.col("theta"), "event_id").groupBy("theta", "user_id", "cluster").agg(F.count("*").alias("size"))
    return c.groupBy("theta").agg(F.count("*").alias("clusters"), F.max("size").alias("largest"), F.sum("size").alias("alarms"))


def _responder_sql(rule: str) -> str:
    return f"""WITH {_match_sql('al')},
s AS (SELECT subject, sum(n_truth) AS n_truth, sum(detected) AS detected, sum(tp) AS tp, sum(fp) AS fp, sum(hours) AS hours FROM co GROUP BY subject HAVING sum(n_truth) > 0),
r AS (SELECT *, {rule} AS responder FROM s)
SELECT responder, {_POOL}, count(*) AS subjects, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY responder"""


def _responders(spark: SparkSession, d: str, rule: str) -> DataFrame:
    r = metrics.responder_summary(_counts(spark, d, bridge.alarms(spark, d)), "subject", rule)
    return _rounded(r).withColumn("share", F.round("share", 6)).select("responder", "n_truth", "detected", "tp", "fp", "hours", "sensitivity", "fa_per_hour", "subjects", "share")


@query(_responder_sql("detected * 3 >= n_truth * 2"))
def responder_summary(spark: SparkSession, d: str) -> DataFrame:
    return _responders(spark, d, "two_thirds")


@query(_responder_sql("detected * 3 > n_truth * 2"))
def responder_strict(spark: SparkSession, d: str) -> DataFrame:
    return _responders(spark, d, "strict")


@query(_responder_sql("CAST(detected AS DOUBLE) / n_truth >= CAST(0.66 AS DOUBLE)"))
def responder_066(spark: SparkSession, d: str) -> DataFrame:
    return _responders(spark, d, "066")


@query(f"""WITH {_match_sql('al')},
s AS (SELECT subject, sum(n_truth) AS n, CAST(sum(detected) AS DOUBLE) / sum(n_truth) AS rate, CAST(sum(tp) AS DOUBLE) / nullif(sum(tp) + sum(fp), 0) AS prec FROM co GROUP BY subject HAVING sum(n_truth) > 0),
g AS (SELECT rate >= CAST(2 AS DOUBLE) / 3 AS responder, count(*) AS n, avg(rate) AS mean_rate, median(rate) AS median_rate, stddev_samp(rate) AS std_rate, min(rate) AS low, max(rate) AS high, avg(prec) AS mean_precision FROM s GROUP BY 1)
SELECT responder, n, round(mean_rate, 6) AS mean_rate, round(median_rate, 6) AS median_rate, round(std_rate, 6) AS std_rate, round(low, 6) AS low, round(high, 6) AS high,
  round(mean_precision, 6) AS mean_precision, round(mean_rate - min(mean_rate) OVER (), 6) AS over_lowest FROM g""")
def responder_comparison(spark: SparkSession, d: str) -> DataFrame:
    s = _counts(spark, d, bridge.alarms(spark, d)).groupBy("subject").agg(*[F.sum(c).alias(c) for c in ("n_truth", "detected", "tp", "fp")]).where("n_truth > 0")
    s = s.select((F.col("detected") / F.col("n_truth")).alias("rate"), metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("prec"))
    g = s.groupBy((F.col("rate") >= F.lit(2.0) / 3).alias("responder")).agg(
        F.count("*").alias("n"), F.avg("rate").alias("mean_rate"), F.percentile("rate", 0.5).alias("median_rate"), F.stddev_samp("rate").alias("std_rate"), F.min("rate").alias("low"), F.max("rate").alias("high"), F.avg("prec").alias("mean_precision")
    )
    g = g.withColumn("over_lowest", F.col("mean_rate") - F.min("mean_rate").over(Window.partitionBy(F.lit(1))))
    return g.select("responder", "n", *[F.round(c, 6).alias(c) for c in ("mean_rate", "median_rate", "std_rate", "low", "high", "mean_precision", "over_lowest")])


GRID = 20
_SHARES = ", ".join(f"CAST({99.9 * k / (GRID - 1) / 100.0!r} AS DOUBLE)" for k in range(GRID))
_GRID_SQL = f"th AS (SELECT DISTINCT unnest(quantile_cont(value, [{_SHARES}])) AS threshold FROM ev)"


@query(f"WITH {_GRID_SQL} SELECT round(threshold, 6) AS threshold FROM th")
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_grid(bridge.events(spark, d), "value", GRID).select(F.round("threshold", 6).alias("threshold"))


_CURVE_SQL = f"""{_GRID_SQL}, ti AS (SELECT round(threshold, 6) AS threshold FROM th),
{CLUSTER_METRICS_SQL}"""
_CURVE_COLUMNS = ("threshold", "alarms", "clusters", "n_truth", "detected", "tp", "fp", "sensitivity", "fa_per_hour", "score")


def _curve(spark: SparkSession, d: str, split: str | None = None) -> DataFrame:
    e, tr, hr = bridge.events(spark, d), bridge.truth(spark, d), bridge.hours(spark, d)
    grid = metrics.threshold_grid(e, "value", GRID).select(F.round("threshold", 6).alias("threshold"))
    if split:
        keep = scalars.split_of(F.col("subject")) == split
        e, tr, hr = e.where(keep), tr.where(keep), hr.where(keep)
    return cluster_metrics(e, tr, hr, grid, THETA, PRE, POST).select(*_CURVE_COLUMNS)


@query(f"WITH {_CURVE_SQL} SELECT {', '.join(_CURVE_COLUMNS)} FROM cu")
def threshold_tradeoff(spark: SparkSession, d: str) -> DataFrame:
    """Metrics after clustering for every threshold, in one job: no table is read once for each threshold."""
    return _curve(spark, d)


_BEST = """SELECT * FROM (
  SELECT 'sensitivity' AS aim, threshold, sensitivity, fa_per_hour FROM cu ORDER BY coalesce(sensitivity, -1) DESC, threshold LIMIT 1) a
UNION ALL SELECT * FROM (SELECT 'fewest_false_alarms' AS aim, threshold, sensitivity, fa_per_hour FROM cu ORDER BY CASE WHEN sensitivity > 0 THEN 0 ELSE 1 END, fa_per_hour, threshold LIMIT 1) b
UNION ALL SELECT * FROM (SELECT 'challenge' AS aim, threshold, sensitivity, fa_per_hour FROM cu ORDER BY 100.0 * coalesce(sensitivity, -1) - 0.4 * fa_per_hour DESC, threshold LIMIT 1) c"""


@query(f"WITH {_CURVE_SQL} {_BEST}")
def optimal_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.optimal_thresholds(_curve(spark, d))


def _split_curve_sql(split: str, subjects: str) -> str:
    """The curve over some subjects, its tables named apart."""
    own = re.sub(r"\b(e[0-9]|tt|cu|ev|tr|hr)\b", rf"\1_{split}", CLUSTER_METRICS_SQL)
    return f"ev_{split} AS (SELECT * FROM ev WHERE subject {subjects}), tr_{split} AS (SELECT * FROM tr WHERE subject {subjects}), hr_{split} AS (SELECT * FROM hr WHERE subject {subjects}), {own}"


@query(f"""WITH {_GRID_SQL}, ti AS (SELECT round(threshold, 6) AS threshold FROM th), {_split_curve_sql("a", "BETWEEN 1 AND 96")}, {_split_curve_sql("b", "BETWEEN 97 AND 125")}, be AS ({_BEST.replace("cu", "cu_a")})
SELECT aim, be.threshold, be.sensitivity AS train_sensitivity, be.fa_per_hour AS train_fa_per_hour, t.sensitivity AS test_sensitivity, t.fa_per_hour AS test_fa_per_hour FROM be LEFT JOIN cu_b t ON t.threshold = be.threshold""")
def train_select_test(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds chosen on the training subjects and measured on the others."""
    chosen = metrics.optimal_thresholds(_curve(spark, d, "train")).select("aim", "threshold", F.col("sensitivity").alias("train_sensitivity"), F.col("fa_per_hour").alias("train_fa_per_hour"))
    test = _curve(spark, d, "test").select("threshold", F.col("sensitivity").alias("test_sensitivity"), F.col("fa_per_hour").alias("test_fa_per_hour"))
    return chosen.join(test, "threshold", "left").select("aim", "threshold", "train_sensitivity", "train_fa_per_hour", "test_sensitivity", "test_fa_per_hour")


_SWEEP_SQL = """th AS (SELECT unnest([%s]) AS theta),
b0 AS (SELECT theta, user_id, subject, event_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY theta, user_id ORDER BY t, event_id) > theta THEN 1 ELSE 0 END AS nw FROM al, th),
b1 AS (SELECT *, sum(nw) OVER (PARTITION BY theta, user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS c FROM b0),
b2 AS (
  SELECT a.theta, a.user_id, a.subject, a.c, a.event_id, a.t,
    coalesce(CAST(sum(CASE WHEN b.t <> a.t THEN abs(a.t - b.t) END) AS DOUBLE) / nullif(sum(CASE WHEN b.t <> a.t THEN 1 ELSE 0 END), 0), 0) AS dist
  FROM b1 a JOIN b1 b ON a.theta = b.theta AND a.user_id = b.user_id AND a.c = b.c GROUP BY ALL),
b3 AS (SELECT theta, user_id, subject, event_id, t FROM (SELECT *, row_number() OVER (PARTITION BY theta, user_id, c ORDER BY dist, t, event_id) AS r FROM b2) WHERE r = 1),
b4 AS (SELECT CAST(0 AS BIGINT) AS theta, user_id, subject, event_id, t FROM al UNION ALL SELECT theta, user_id, subject, event_id, t FROM b3),
b5 AS (SELECT a.theta, a.user_id, a.event_id, min(i.seizure) AS seizure FROM b4 a LEFT JOIN tr i ON a.user_id = i.user_id AND a.t BETWEEN i."start" - %d AND i."end" + %d GROUP BY ALL),
b6 AS (SELECT theta, user_id, count(*) AS alarms, count(*) - count(seizure) AS fp, count(DISTINCT seizure) AS detected FROM b5 GROUP BY ALL),
nt AS (SELECT user_id, count(*) AS n FROM tr GROUP BY user_id),
b7 AS (
  SELECT a.theta, a.user_id, z.alarms AS alarms0, a.alarms, z.fp AS fp0, a.fp, coalesce(CAST(z.detected AS DOUBLE) / n.n, 0) AS sens0, coalesce(CAST(a.detected AS DOUBLE) / n.n, 0) AS sens
  FROM b6 a JOIN b6 z ON a.user_id = z.user_id AND z.theta = 0 LEFT JOIN nt n ON n.user_id = a.user_id WHERE a.theta > 0),
b8 AS (
  SELECT *, CAST(0.6 AS DOUBLE) * CASE WHEN fp0 > 0 THEN CAST(fp0 - fp AS DOUBLE) / fp0 ELSE 0 END + CAST(0.3 AS DOUBLE) * CASE WHEN alarms0 > 0 THEN CAST(alarms0 - alarms AS DOUBLE) / alarms0 ELSE 0 END
    - 2 * greatest(0, sens0 - sens) AS score FROM b7)""" % (", ".join(f"CAST({t * UNIT} AS BIGINT)" for t in GAPS), PRE, POST)


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    s = sweep_counts(bridge.alarms(spark, d), bridge.truth(spark, d), [g * UNIT for g in GAPS], PRE, POST)
    score = clusters.strategy_score(F.col("fp0"), F.col("fp"), F.col("alarms0"), F.col("alarms"), F.col("sens0"), F.col("sens"))
    return s.withColumn("score", score)


@query(f"WITH {_SWEEP_SQL} SELECT theta, count(*) AS series, CAST(sum(alarms) AS BIGINT) AS alarms, CAST(sum(fp) AS BIGINT) AS fp, round(avg(score), 6) AS mean_score, round(avg(sens), 6) AS mean_sensitivity FROM b8 GROUP BY theta")
def strategy_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d).groupBy("theta").agg(F.count("*").alias("series"), F.sum("alarms").alias("alarms"), F.sum("fp").alias("fp"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("sens"), 6).alias("mean_sensitivity"))


@query(f"""WITH {_SWEEP_SQL}, g AS (
  SELECT theta, round(avg(score) FILTER (user_id % 125 + 1 <= 96), 6) AS train_score, round(avg(score) FILTER (user_id % 125 + 1 > 96), 6) AS test_score,
    CAST(coalesce(sum(alarms) FILTER (user_id % 125 + 1 > 96), 0) AS BIGINT) AS test_alarms, CAST(coalesce(sum(fp) FILTER (user_id % 125 + 1 > 96), 0) AS BIGINT) AS test_fp FROM b8 GROUP BY theta)
SELECT theta, train_score, test_score, test_alarms, test_fp FROM g ORDER BY train_score DESC NULLS LAST, theta LIMIT 1""")
def best_strategy(spark: SparkSession, d: str) -> DataFrame:
    """The gap with the best mean score over the training subjects, and what it does on the test subjects."""
    split = scalars.split_of(F.col("user_id") % 125 + 1)
    on = lambda name, c: F.when(split == name, F.col(c))
    g = _sweep(spark, d).groupBy("theta").agg(
        F.round(F.avg(on("train", "score")), 6).alias("train_score"), F.round(F.avg(on("test", "score")), 6).alias("test_score"),
        *[F.coalesce(F.sum(on("test", c)), F.lit(0)).alias(f"test_{c}") for c in ("alarms", "fp")],
    )
    return g.orderBy(F.desc_nulls_last("train_score"), "theta").limit(1)


@query(f"""WITH {CLUSTERS},
u AS (SELECT user_id, count(*) AS before, count(DISTINCT cluster) AS after, sum(CASE WHEN t >= 0 THEN 0 END) AS z FROM cl GROUP BY user_id),
sp AS (SELECT user_id, sum(span) / CAST({HOUR} AS DOUBLE) AS covered FROM rp GROUP BY user_id),
ns AS (SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) AS es, count(*) FILTER (event_type = 'error') AS ev_n FROM ev GROUP BY user_id),
j AS (SELECT u.user_id, before, after, ev_n AS events, es AS samples, es / n AS share, covered FROM u JOIN sp ON u.user_id = sp.user_id JOIN ns ON ns.user_id = u.user_id),
k AS (SELECT *, samples * CASE WHEN share < 0.01 THEN 10 WHEN share < 0.05 THEN 5 ELSE 3 END AS room, CAST(before - after AS DOUBLE) / before AS red FROM j)
SELECT user_id, before, after, events, round(
  CASE WHEN events > 0 THEN CASE WHEN after < events THEN 4.0 WHEN after > events * 5 THEN 0.5 ELSE 0 END ELSE 0 END
  + CASE WHEN samples > 0 AND share > 0 AND covered / after > room THEN least(CASE WHEN share < 0.01 THEN 2.0 WHEN share < 0.05 THEN 1.5 ELSE 1.0 END, covered / after / room) ELSE 0 END
  + CASE WHEN after = 1 AND before > 100 THEN 5.0 ELSE 0 END
  + CASE WHEN covered > before * 2 THEN greatest(20.0, (covered / before - 2) * 0.1) ELSE 0 END
  + CASE WHEN red > 0.99 THEN 3.0 WHEN red > 0.95 THEN 1.5 ELSE 0 END, 6) AS penalty FROM k""")
def smart_sweep_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Penalties for clustering too much, with an hour as the sample."""
    c = _clustered(spark, d)
    u = c.groupBy("user_id").agg(F.count("*").alias("before"), F.countDistinct("cluster").alias("after"))
    sp = _representatives(spark, d).groupBy("user_id").agg((F.sum("span") / float(HOUR)).alias("covered"))
    error = F.col("event_type") == "error"
    n = bridge.events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(error.cast("long")).alias("events"))
    j = u.join(sp, "user_id").join(n, "user_id")
    samples = F.col("events").cast("double")
    p = scalars.clustering_penalty(F.col("before"), F.col("after"), F.col("events"), samples, samples / F.col("n"), F.col("covered"))
    return j.select("user_id", "before", "after", "events", F.round(p, 6).alias("penalty"))


@query("""WITH g0 AS (SELECT user_id, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) > 2 THEN 1 ELSE 0 END AS nw FROM se WHERE value >= 80),
g1 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS c FROM g0)
SELECT user_id, count(*) AS n, CAST(round_even(avg(idx), 0) AS BIGINT) AS position FROM g1 GROUP BY user_id, c HAVING count(*) >= 2""")
def gap_group_means(spark: SparkSession, d: str) -> DataFrame:
    g = clusters.gap_means(bridge.series(spark, d).where("value >= 80"), KEY, "idx", 2, 2)
    return g.select("user_id", "n", "position")


@query("SELECT user_id, idx, value, rank FROM (SELECT user_id, idx, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, idx DESC) AS rank FROM se) WHERE rank <= 5")
def topk_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_k(bridge.series(spark, d), KEY, "value", "idx", 5).select("user_id", "idx", "value", F.col("rank").cast("long").alias("rank"))


@query("""SELECT user_id, idx, value, rank FROM (SELECT user_id, idx, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, idx DESC) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM se)
WHERE rank <= greatest(1, floor(n * CAST(0.05 AS DOUBLE)))""")
def topk_ratio(spark: SparkSession, d: str) -> DataFrame:
    k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * 0.05))
    return metrics.top_k(bridge.series(spark, d), KEY, "value", "idx", k).select("user_id", "idx", "value", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id, max_by(idx, struct_pack(a := value, b := -idx)) AS idx, max(value) AS value FROM se GROUP BY user_id")
def argmax_scores(spark: SparkSession, d: str) -> DataFrame:
    return bridge.series(spark, d).groupBy("user_id").agg(F.max_by("idx", F.struct("value", -F.col("idx"))).alias("idx"), F.max("value").alias("value"))


@query("""WITH k AS (SELECT unnest([CAST(0.02 AS DOUBLE), CAST(0.05 AS DOUBLE), CAST(0.1 AS DOUBLE)]) AS ratio), g AS (SELECT unnest([1, 3]) AS gap), z AS (SELECT unnest([1, 2]) AS least),
r AS (SELECT user_id, idx, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, idx DESC) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM se),
f AS (SELECT ratio, gap, user_id, idx FROM r, k, g WHERE rank <= greatest(1, floor(n * ratio))),
a AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY ratio, gap, user_id ORDER BY idx) > gap THEN 1 ELSE 0 END AS nw FROM f),
b AS (SELECT *, sum(nw) OVER (PARTITION BY ratio, gap, user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS c FROM a),
q AS (SELECT ratio, gap, user_id, c, count(*) AS n, CAST(round_even(avg(idx), 0) AS BIGINT) AS pos FROM b GROUP BY ALL),
w AS (SELECT q.*, least FROM q, z WHERE q.n >= least),
h AS (SELECT w.ratio, w.gap, w.least, w.user_id, w.pos, min(s.idx) AS hit FROM w LEFT JOIN se s ON s.user_id = w.user_id AND s.event_type = 'error' AND s.idx BETWEEN w.pos - 2 AND w.pos + 2 GROUP BY ALL)
SELECT ratio, CAST(gap AS INTEGER) AS gap, CAST(least AS INTEGER) AS least, count(*) AS detections, count(hit) AS hits FROM h GROUP BY ALL""")
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """All combinations of top share, gap and least group in one job: each is a filter on a rank that is made once."""
    s = bridge.series(spark, d)
    grid = spark.range(1).select(F.explode(F.array(F.lit(0.02), F.lit(0.05), F.lit(0.1))).alias("ratio")).select("ratio", F.explode(F.array(F.lit(1), F.lit(3))).alias("gap"))
    w = Window.partitionBy("user_id")
    ranked = s.select("user_id", "idx", F.row_number().over(w.orderBy(F.desc("value"), F.desc("idx"))).alias("rank"), F.count("*").over(w).alias("n"))
    f = ranked.crossJoin(F.broadcast(grid)).where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.col("ratio")))).drop("n")  # the grid has six rows
    c = clusters.by_gap(f, ["ratio", "gap", "user_id"], "idx", F.col("gap"), "idx")
    q = c.groupBy("ratio", "gap", "user_id", "cluster").agg(F.count("*").alias("n"), F.bround(F.avg("idx"), 0).cast("long").alias("pos"))
    q = q.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("least")).where("n >= least")
    near = s.where("event_type = 'error'").select("user_id", (F.col("idx") - 2).alias("low"), (F.col("idx") + 2).alias("high"), F.col("idx").alias("event"))
    h = intervals.range_join(q, near, KEY, "pos", "low", "high", 16, "left").groupBy("ratio", "gap", "least", "user_id", "pos", "cluster").agg(F.min("event").alias("hit"))
    return h.groupBy("ratio", "gap", "least").agg(F.count("*").alias("detections"), F.count("hit").alias("hits"))


_ALARM_INTERVALS = f'ai AS (SELECT user_id, event_id, t AS "start", t + {4 * HOUR} AS "end" FROM al)'


def _alarm_intervals(spark: SparkSession, d: str) -> DataFrame:
    return bridge.alarms(spark, d).select("user_id", "event_id", F.col("t").alias("start"), (F.col("t") + 4 * HOUR).alias("end"))


@query(f"""WITH {_ALARM_INTERVALS}
SELECT a.user_id, a.event_id, i.seizure, round(CAST(least(a."end", i."end") - greatest(a."start", i."start") AS DOUBLE) / least(a."end" - a."start", i."end" - i."start"), 6) AS overlap
FROM ai a JOIN tr i ON a.user_id = i.user_id AND a."start" < i."end" AND i."start" < a."end"
WHERE CAST(least(a."end", i."end") - greatest(a."start", i."start") AS DOUBLE) / least(a."end" - a."start", i."end" - i."start") >= 0.1""")
def overlap_ratio_match(spark: SparkSession, d: str) -> DataFrame:
    j = intervals.overlaps(_alarm_intervals(spark, d), bridge.truth(spark, d), KEY, 12 * HOUR, 0.1)
    return j.select("user_id", "event_id", F.col("seizure_b").alias("seizure"), F.round("overlap", 6).alias("overlap"))


@query(f"""SELECT user_id, seizure, event_id, t FROM (
  SELECT i.user_id, i.seizure, a.event_id, a.t, row_number() OVER (PARTITION BY i.user_id, i.seizure ORDER BY a.t, a.event_id) AS r
  FROM tr i JOIN al a ON a.user_id = i.user_id AND a.t BETWEEN i."start" - {PRE} AND i."end" + {POST}) WHERE r = 1""")
def tolerance_match(spark: SparkSession, d: str) -> DataFrame:
    """The first alarm within each interval's tolerance."""
    i = bridge.truth(spark, d).select("user_id", "seizure", (F.col("start") - PRE).alias("low"), (F.col("end") + POST).alias("high"))
    j = intervals.range_join(bridge.alarms(spark, d), i, KEY, "t", "low", "high", 12 * HOUR)
    return j.groupBy("user_id", "seizure").agg(F.min(F.struct("t", "event_id")).alias("a")).select("user_id", "seizure", "a.event_id", "a.t")


@query(f"""WITH m AS (SELECT a.user_id, i.seizure, count(*) AS alarms FROM al a JOIN tr i ON a.user_id = i.user_id AND a.t BETWEEN i."start" - {PRE} AND i."end" + {POST} GROUP BY ALL)
SELECT user_id, count(*) AS detected, CAST(sum(alarms) AS BIGINT) AS matches, (SELECT count(*) FROM al a WHERE a.user_id = m.user_id) - CAST(sum(alarms) AS BIGINT) AS fp FROM m GROUP BY user_id""")
def all_matches_metrics(spark: SparkSession, d: str) -> DataFrame:
    """An alarm counts for every interval that holds it, so false alarms, total less matches, can be negative."""
    a = bridge.alarms(spark, d)
    i = bridge.truth(spark, d).select("user_id", "seizure", (F.col("start") - PRE).alias("low"), (F.col("end") + POST).alias("high"))
    m = intervals.range_join(a, i, KEY, "t", "low", "high", 12 * HOUR).groupBy("user_id").agg(F.countDistinct("seizure").alias("detected"), F.count("*").alias("matches"))
    return m.join(a.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").select("user_id", "detected", "matches", (F.col("n") - F.col("matches")).alias("fp"))


@query("""SELECT a.user_id, a.event_id, a.t, (SELECT i."start" FROM tr i WHERE i.user_id = a.user_id ORDER BY abs(i."start" - a.t), i."start" LIMIT 1) AS nearest FROM al a""")
def nearest_event_distance(spark: SparkSession, d: str) -> DataFrame:
    return intervals.nearest(bridge.alarms(spark, d).select("user_id", "event_id", "t"), bridge.truth(spark, d), KEY, "t", "start")


@query(f"""SELECT a.user_id, a.event_id, i.seizure, CASE WHEN a.t < i."start" THEN 'pre' WHEN a.t <= i."end" THEN 'during' ELSE 'post' END AS phase, a.t - i."start" AS offset_us
FROM al a JOIN tr i ON a.user_id = i.user_id AND a.t BETWEEN i."start" - {PRE} AND i."end" + {POST}""")
def pre_during_post(spark: SparkSession, d: str) -> DataFrame:
    i = bridge.truth(spark, d).select("user_id", "seizure", "start", "end", (F.col("start") - PRE).alias("low"), (F.col("end") + POST).alias("high"))
    j = intervals.range_join(bridge.alarms(spark, d), i, KEY, "t", "low", "high", 12 * HOUR)
    return j.select("user_id", "event_id", "seizure", scalars.detection_phase(F.col("t"), F.col("start"), F.col("end")).alias("phase"), (F.col("t") - F.col("start")).alias("offset_us"))


_WIDE = f'tw AS (SELECT user_id, "start", "start" + {36 * HOUR} AS "end" FROM tr)'


@query(f"""WITH {_WIDE},
m0 AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tw),
m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + {HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM m0)
SELECT user_id, min("start") AS "start", max("end") AS "end", count(*) AS n FROM m1 GROUP BY user_id, g""")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    wide = bridge.truth(spark, d).select("user_id", "start", (F.col("start") + 36 * HOUR).alias("end"))
    return intervals.merge(wide, KEY, HOUR).select("user_id", "start", "end", "n")


@query(f"""SELECT user_id, min("start") AS "start", min("end") AS "end", count(*) AS n FROM tr
GROUP BY user_id, ("start" + {12 * HOUR}) // {24 * HOUR}, ("end" + {12 * HOUR}) // {24 * HOUR}""")
def distinct_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals whose bounds round to the same day count once."""
    return intervals.distinct_rounded(bridge.truth(spark, d), KEY, 24 * HOUR)


@query(f"""WITH {_ALARM_INTERVALS},
p AS (SELECT a.user_id, a.event_id, i.seizure FROM ai a JOIN tr i ON a.user_id = i.user_id AND a."start" < i."end" AND i."start" < a."end"),
c AS (SELECT user_id, count(DISTINCT seizure) AS tp, count(DISTINCT event_id) AS hit FROM p GROUP BY user_id),
n AS (SELECT user_id, count(*) AS n FROM tr GROUP BY user_id), m AS (SELECT user_id, count(*) AS m FROM ai GROUP BY user_id),
j AS (SELECT coalesce(n.user_id, m.user_id) AS user_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM n FULL JOIN m ON n.user_id = m.user_id)
SELECT j.user_id, coalesce(tp, 0) AS tp, n - coalesce(tp, 0) AS fn, m - coalesce(hit, 0) AS fp, round(CAST(coalesce(tp, 0) AS DOUBLE) / nullif(n + m - coalesce(hit, 0), 0), 6) AS iou
FROM j LEFT JOIN c ON j.user_id = c.user_id""")
def cluster_iou(spark: SparkSession, d: str) -> DataFrame:
    e = metrics.mask_events(bridge.truth(spark, d), _alarm_intervals(spark, d), KEY, 12 * HOUR)
    return e.withColumn("iou", F.round("iou", 6))


@query("""WITH gp AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM al),
r AS (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY gap) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM gp WHERE gap IS NOT NULL),
m AS (SELECT user_id, gap FROM r WHERE r = n // 2 + 1),
u AS (SELECT DISTINCT user_id FROM al)
SELECT u.user_id, coalesce(CAST(trunc(least(2.0, greatest(0.5, gap / CAST(%d AS DOUBLE))) * %d) AS BIGINT), %d) AS theta FROM u LEFT JOIN m ON u.user_id = m.user_id""" % (THETA, THETA, THETA))
def adaptive_thetas(spark: SparkSession, d: str) -> DataFrame:
    return clusters.adaptive_theta(bridge.alarms(spark, d), KEY, "t", "event_id", THETA)


@query("""WITH gp AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM al),
r AS (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY gap) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM gp WHERE gap IS NOT NULL),
m AS (SELECT user_id, gap FROM r WHERE r = floor(CAST(0.3 AS DOUBLE) * (n - 1)) + 1),
u AS (SELECT DISTINCT user_id FROM al)
SELECT u.user_id, greatest(coalesce(gap, %d), %d) AS theta FROM u LEFT JOIN m ON u.user_id = m.user_id""" % (HOUR, HOUR))
def percentile_thetas(spark: SparkSession, d: str) -> DataFrame:
    return clusters.percentile_theta(bridge.alarms(spark, d), KEY, "t", "event_id", 0.3, HOUR)


def score_aware_sql(thetas: list[int]) -> str:
    """sr: theta, user_id, event_id, t, score, r (place by falling score), c (cluster); recursive."""
    return f"""s0 AS (SELECT user_id, event_id, t, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, t, event_id) AS r FROM al),
sr AS (
  SELECT theta, user_id, event_id, t, score, r, CAST(0 AS BIGINT) AS c, [t] AS members FROM s0, (SELECT unnest([{", ".join(f"CAST({t} AS BIGINT)" for t in thetas)}]) AS theta) WHERE r = 1
  UNION ALL
  SELECT theta, user_id, event_id, t, score, r, CASE WHEN near THEN c ELSE c + 1 END, CASE WHEN near THEN list_append(members, t) ELSE [t] END FROM (
    SELECT sr.theta, s.user_id, s.event_id, s.t, s.score, s.r, sr.c, sr.members, len(list_filter(sr.members, lambda x: abs(x - s.t) <= sr.theta)) > 0 AS near
    FROM sr JOIN s0 s ON s.user_id = sr.user_id AND s.r = sr.r + 1))"""


@query(f"WITH RECURSIVE {bridge.SQL}, {score_aware_sql([THETA])} SELECT user_id, c AS cluster, count(*) AS size, max(score) AS best FROM sr GROUP BY user_id, c", shared=False)
def score_aware_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Sequential by falling score."""
    c = clusters.score_aware(bridge.alarms(spark, d), KEY, "t", "score", "event_id", THETA)
    return c.groupBy("user_id", "cluster").agg(F.count("*").alias("size"), F.max("score").alias("best"))


@query(f"""WITH {CLUSTERS}, s AS (SELECT CAST(unnest(range(1, 51)) AS BIGINT) AS least),
k AS (SELECT least, rp.* FROM rp, s WHERE size >= least),
m AS (SELECT k.least, k.user_id, k.event_id, min(i.seizure) AS seizure FROM k LEFT JOIN tr i ON k.user_id = i.user_id AND k.t BETWEEN i."start" - {PRE} AND i."end" + {POST} GROUP BY ALL),
g AS (SELECT least, count(*) AS clusters, count(seizure) AS tp, count(*) - count(seizure) AS fp FROM m GROUP BY least),
b AS (SELECT clusters AS c1, tp AS t1, fp AS f1 FROM g WHERE least = 1)
SELECT s.least, coalesce(clusters, 0) AS clusters, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, round(CASE WHEN clusters IS NULL THEN -10.0 ELSE
  CAST(0.6 AS DOUBLE) * (f1 - fp) / greatest(f1, 1) + CAST(0.3 AS DOUBLE) * (c1 - clusters) / c1 - CAST(2 AS DOUBLE) * (t1 - tp) / greatest(t1, 1) END, 6) AS score FROM s LEFT JOIN g ON s.least = g.least LEFT JOIN b ON true""")
def min_size_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Clusters, hits, false alarms and score for each least cluster size; sizes that leave nothing have zeros and a score of -10."""
    r = _representatives(spark, d)
    m = intervals.first_match(r, bridge.truth(spark, d), KEY, "t", "event_id", "seizure", PRE, POST).join(r.select("user_id", "event_id", "size"), ["user_id", "event_id"])
    sizes = spark.range(1, 51).withColumnRenamed("id", "least")
    k = m.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("size"), F.lit(50)))).alias("least"))
    g = k.groupBy("least").agg(F.count("*").alias("clusters"), F.count("seizure").alias("tp"), F.sum(F.col("seizure").isNull().cast("long")).alias("fp"))
    every = sizes.join(g, "least", "left").na.fill(0)  # fifty rows
    at_one = lambda c: F.max(F.when(F.col("least") == 1, F.col(c))).over(Window.partitionBy(F.lit(1)))
    less = lambda c: (at_one(c) - F.col(c)) / F.greatest(at_one(c), F.lit(1))
    score = F.when(F.col("clusters") == 0, -10.0).otherwise(0.6 * less("fp") + 0.3 * less("clusters") - 2.0 * less("tp"))
    return every.withColumn("score", F.round(score, 6))


@query(f"""WITH {CLUSTERS}, m AS (SELECT rp.user_id, rp.event_id, size, min(i.seizure) AS seizure FROM rp LEFT JOIN tr i ON rp.user_id = i.user_id AND rp.t BETWEEN i."start" - {PRE} AND i."end" + {POST} GROUP BY ALL)
SELECT size, count(*) AS clusters, count(seizure) AS tp, count(*) - count(seizure) AS fp FROM m GROUP BY size""")
def cluster_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    r = _representatives(spark, d)
    m = intervals.first_match(r, bridge.truth(spark, d), KEY, "t", "event_id", "seizure", PRE, POST).join(r.select("user_id", "event_id", "size"), ["user_id", "event_id"])
    return m.groupBy("size").agg(F.count("*").alias("clusters"), F.count("seizure").alias("tp"), F.sum(F.col("seizure").isNull().cast("long")).alias("fp"))
