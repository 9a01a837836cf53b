"""The large sweeps over clustering strategies, and the strategies for windowed recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import clusters, intervals, metrics, profile, sequence
from ..sources import bridge
from ..sources.bridge import HOUR, POST, PRE
from .alarm_queries import UNIT, score_aware_sql
from .registry import query
from .series_queries import _FULL, _N, _in_windows
from .signal_queries import _lengths_sql

KEY = ["user_id"]

# The gaps of the sweep with penalties, in seconds.
SMART = [2, 5, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 300, 420, 600, 900]
# The large sweep's gaps in seconds, the percentiles of all gaps, and pairs of gaps.
TIME = [5, 10, 15, 20, 25, 30, 35, 40, 45, 60, 75, 90, 120, 150, 180, 240, 300]
FINE = [2, 3, 6, 8, 12, 18, 22, 28, 32, 38, 42, 48, 55, 65, 85, 105]
EXTENDED = [360, 450, 600, 900, 1200, 1800]
ADAPTIVE = [10, 25, 50, 75, 90, 95, 99]
SCORE_AWARE = [30, 60, 120, 180]
HYBRID = [(60, 120), (30, 90), (45, 180), (90, 240)]
SUBJECT_AWARE = [45, 90, 135]


def _representatives_sql(alarms: str, by: str) -> str:
    """rc to rr: representatives of alarms with a column theta, by setting and series."""
    return f"""rc AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY {by}, user_id ORDER BY t, event_id) > theta THEN 1 ELSE 0 END AS nw FROM {alarms}),
rd AS (SELECT *, sum(nw) OVER (PARTITION BY {by}, user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS c FROM rc),
re AS (
  SELECT a.{by}, a.user_id, a.c, a.event_id, a.t, max(b.t) - min(b.t) AS span,
    coalesce(CAST(sum(CASE WHEN b.t <> a.t THEN abs(a.t - b.t) END) AS DOUBLE) / nullif(sum(CASE WHEN b.t <> a.t THEN 1 ELSE 0 END), 0), 0) AS dist
  FROM rd a JOIN rd b ON a.{by} = b.{by} AND a.user_id = b.user_id AND a.c = b.c GROUP BY ALL),
rr AS (SELECT {by}, user_id, event_id, t, span FROM (SELECT *, row_number() OVER (PARTITION BY {by}, user_id, c ORDER BY dist, t, event_id) AS r FROM re) WHERE r = 1)"""


_HIT = f"""LEFT JOIN tr i ON a.user_id = i.user_id AND a.t BETWEEN i."start" - {PRE} AND i."end" + {POST}"""


@query(f"""WITH th AS (SELECT unnest([{", ".join(f"CAST({s * UNIT} AS BIGINT)" for s in SMART)}]) AS theta), sa AS (SELECT theta, user_id, event_id, t FROM al, th),
{_representatives_sql("sa", "theta")},
h AS (SELECT a.theta, a.user_id, a.event_id, any_value(a.span) AS span, min(i.seizure) AS seizure FROM rr a {_HIT} GROUP BY a.theta, a.user_id, a.event_id),
g AS (SELECT theta, user_id, count(*) AS after, count(*) - count(seizure) AS fp, count(DISTINCT seizure) AS detected, sum(span) / CAST({HOUR} AS DOUBLE) AS covered FROM h GROUP BY ALL),
b0 AS (SELECT a.user_id, a.event_id, min(i.seizure) AS seizure FROM al a {_HIT} GROUP BY a.user_id, a.event_id),
b AS (SELECT user_id, count(*) AS before, count(*) - count(seizure) AS fp0, count(DISTINCT seizure) AS detected0 FROM b0 GROUP BY user_id),
e AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS events FROM ev GROUP BY user_id),
j AS (SELECT g.*, before, fp0, detected0, events, CAST(events AS DOUBLE) / n AS share, CAST(before - after AS DOUBLE) / before AS red,
  events * CASE WHEN CAST(events AS DOUBLE) / n < 0.01 THEN 10 WHEN CAST(events AS DOUBLE) / n < 0.05 THEN 5 ELSE 3 END AS room FROM g JOIN b ON g.user_id = b.user_id JOIN e ON e.user_id = g.user_id),
k AS (SELECT *, CASE WHEN events > 0 THEN CASE WHEN after < events THEN 4.0 WHEN after > events * 5 THEN 0.5 ELSE 0 END ELSE 0 END
  + CASE WHEN events > 0 AND covered / after > room THEN least(CASE WHEN share < 0.01 THEN 2.0 WHEN share < 0.05 THEN 1.5 ELSE 1.0 END, covered / after / room) ELSE 0 END
  + CASE WHEN after = 1 AND before > 100 THEN 5.0 ELSE 0 END + CASE WHEN covered > before * 2 THEN greatest(20.0, (covered / before - 2) * 0.1) ELSE 0 END
  + CASE WHEN red > 0.99 THEN 3.0 WHEN red > 0.95 THEN 1.5 ELSE 0 END AS penalty FROM j),
s AS (SELECT *, round(CAST(0.6 AS DOUBLE) * CASE WHEN fp0 > 0 THEN CAST(fp0 - fp AS DOUBLE) / fp0 ELSE 0 END + CAST(0.3 AS DOUBLE) * red
  - 2 * coalesce(CAST(detected0 - detected AS DOUBLE) / nullif(events, 0), 0) - penalty, 6) AS score FROM k)
SELECT user_id, theta, after AS clusters, fp, round(penalty, 6) AS penalty, score, settings FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, theta) AS r, count(*) OVER (PARTITION BY user_id) AS settings FROM s) WHERE r = 1""")
def smart_sweep(spark: SparkSession, d: str) -> DataFrame:
    """For each recording the best of 16 gaps, with penalties for clustering more than the true events allow."""
    a, tr = bridge.alarms(spark, d), bridge.truth(spark, d)
    gaps = F.array(*[F.lit(s * UNIT).cast("long") for s in SMART])
    r = clusters.sweep(a.withColumn("_gaps", gaps), KEY, "t", "event_id", "_gaps")
    wide = tr.select("user_id", "seizure", (F.col("start") - PRE).alias("low"), (F.col("end") + POST).alias("high"))

    def hits(x: DataFrame, by: list[str]) -> DataFrame:
        m = intervals.range_join(x, wide, KEY, "t", "low", "high", 12 * HOUR, "left").groupBy(*by, "event_id").agg(F.min("seizure").alias("seizure"), F.first("span").alias("span"))
        return m.groupBy(*by).agg(F.count("*").alias("after"), F.sum(F.col("seizure").isNull().cast("long")).alias("fp"), F.countDistinct("seizure").alias("detected"), (F.sum("span") / float(HOUR)).alias("covered"))

    g = hits(r.withColumn("theta", F.element_at(gaps, F.col("setting") + 1)), ["theta", "user_id"])
    b = hits(a.withColumn("span", F.lit(0).cast("long")), KEY).select("user_id", F.col("after").alias("before"), F.col("fp").alias("fp0"), F.col("detected").alias("detected0"))
    e = bridge.events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("events"))
    j = g.join(b, "user_id").join(e, "user_id")
    samples = F.col("events").cast("double")
    j = j.withColumn("penalty", scalars.clustering_penalty(F.col("before"), F.col("after"), F.col("events"), samples, samples / F.col("n"), F.col("covered")))
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("events"), F.lit(0)), F.lit(0.0))
    score = clusters.strategy_score(F.col("fp0"), F.col("fp"), F.col("before"), F.col("after"), share("detected0"), share("detected")) - F.col("penalty")
    w = Window.partitionBy("user_id")
    j = j.withColumn("score", F.round(score, 6)).withColumn("settings", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "theta")))
    return j.where("r = 1").select("user_id", "theta", F.col("after").alias("clusters"), "fp", F.round("penalty", 6).alias("penalty"), "score", "settings")


def _fixed() -> list[tuple[str, str, int]]:
    """(strategy, method, gap) of the strategies whose gap does not depend on the data."""
    out = [(f"{name}_{s}s", method, s * UNIT) for name, method, gaps in (("time", "time_based", TIME), ("fine_time", "fine_time_based", FINE), ("extended_time", "extended_time_based", EXTENDED)) for s in gaps]
    return out + [(f"hybrid_{a}_{b}s", "multi_threshold", max(a, b) * UNIT) for a, b in HYBRID]


_FIXED_SQL = ", ".join(f"('{n}', '{m}', {g})" for n, m, g in _fixed())
_SUBJECT_SQL = ", ".join(f"('subject_aware_{s}s', 'subject_aware', {s * UNIT})" for s in SUBJECT_AWARE)


@query(f"""WITH RECURSIVE {bridge.SQL}, {score_aware_sql([s * UNIT for s in SCORE_AWARE])},
gp AS (SELECT user_id, subject, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM al),
ga AS (SELECT gap, row_number() OVER (ORDER BY gap) AS r, count(*) OVER () AS n FROM gp WHERE gap IS NOT NULL),
ad AS (SELECT 'adaptive_p' || p AS strategy, 'adaptive_time_based' AS method, CAST(gap AS DOUBLE) AS theta FROM ga, (SELECT unnest({ADAPTIVE}) AS p) WHERE r = floor(CAST(p AS DOUBLE) / 100 * (n - 1)) + 1 AND gap > 0),
sg AS (SELECT subject, gap, row_number() OVER (PARTITION BY subject ORDER BY gap) AS r, count(*) OVER (PARTITION BY subject) AS n FROM gp WHERE gap IS NOT NULL),
sm AS (SELECT subject, gap FROM sg WHERE r = n // 2 + 1),
us AS (SELECT DISTINCT user_id, subject FROM al),
st AS (
  SELECT strategy, method, user_id, CAST(theta AS DOUBLE) AS theta FROM (VALUES {_FIXED_SQL}) f(strategy, method, theta), us
  UNION ALL SELECT strategy, method, user_id, theta FROM ad, us
  UNION ALL SELECT strategy, method, user_id, base * least(2.0, greatest(0.5, coalesce(gap, base) / CAST(base AS DOUBLE))) FROM (VALUES {_SUBJECT_SQL}) f(strategy, method, base), us LEFT JOIN sm ON us.subject = sm.subject),
sa AS (SELECT strategy, st.user_id, theta, event_id, t FROM al JOIN st ON al.user_id = st.user_id),
{_representatives_sql("sa", "strategy")},
rx AS (
  SELECT strategy, user_id, event_id, t FROM rr
  UNION ALL SELECT 'score_aware_' || (theta // {UNIT}) || 's', user_id, event_id, t FROM (SELECT *, row_number() OVER (PARTITION BY theta, user_id, c ORDER BY r) AS k FROM sr) WHERE k = 1
  UNION ALL SELECT 'none', user_id, event_id, t FROM al),
h AS (SELECT a.strategy, a.user_id, a.event_id, min(i.seizure) AS seizure FROM rx a {_HIT} GROUP BY a.strategy, a.user_id, a.event_id),
g AS (SELECT strategy, count(*) AS clusters, count(seizure) AS tp, count(*) - count(seizure) AS fp, count(DISTINCT CASE WHEN seizure IS NOT NULL THEN user_id END) AS found FROM h GROUP BY strategy),
z AS (SELECT clusters AS c0, fp AS f0, found AS d0, (SELECT count(DISTINCT user_id) FROM tr) AS files FROM g WHERE strategy = 'none'),
q AS (SELECT g.*, round(CAST(found AS DOUBLE) / files, 6) AS sensitivity, round(CAST(0.6 AS DOUBLE) * CASE WHEN f0 > 0 THEN CAST(f0 - fp AS DOUBLE) / f0 ELSE 0 END + CAST(0.3 AS DOUBLE) * CAST(c0 - clusters AS DOUBLE) / c0
  - 2 * greatest(0, CAST(d0 AS DOUBLE) / files - CAST(found AS DOUBLE) / files), 6) AS score FROM g, z WHERE strategy <> 'none')
SELECT strategy, clusters, tp, fp, sensitivity, score, row_number() OVER (ORDER BY score DESC, strategy) = 1 AS best FROM q""", shared=False)
def large_sweep(spark: SparkSession, d: str) -> DataFrame:
    """57 strategies: fixed gaps, percentiles of all gaps, gaps by subject, two gaps (the larger decides), and clusters by score."""
    a, tr = bridge.alarms(spark, d), bridge.truth(spark, d)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    gaps = a.select("user_id", "subject", (F.col("t") - F.lag("t").over(w)).alias("gap")).where("gap is not null")
    found = metrics.percentiles(gaps, "gap", [p / 100 for p in ADAPTIVE], lower=True).collect()  # seven rows
    adaptive = [(f"adaptive_p{round(100 * r.share)}", int(r.percentile)) for r in sorted(found, key=lambda r: r.share) if int(r.percentile) > 0]
    ranked = gaps.withColumn("r", F.row_number().over(Window.partitionBy("subject").orderBy("gap"))).withColumn("n", F.count("*").over(Window.partitionBy("subject")))
    median = ranked.where("r = floor(n / 2) + 1").select("subject", F.col("gap").alias("median"))
    by_subject: list[Column] = []
    for s in SUBJECT_AWARE:
        base = float(s * UNIT)
        by_subject.append(F.lit(base) * F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.coalesce(F.col("median"), F.lit(base)) / base)))
    names = [n for n, _, _ in _fixed()] + [n for n, _ in adaptive] + [f"subject_aware_{s}s" for s in SUBJECT_AWARE]
    every = [F.lit(float(g)) for _, _, g in _fixed()] + [F.lit(float(g)) for _, g in adaptive] + by_subject
    # An alarm hits or not whatever cluster it stands for, so alarms are joined once and not once for each strategy.
    wide = tr.select("user_id", "seizure", (F.col("start") - PRE).alias("low"), (F.col("end") + POST).alias("high"))
    hits = intervals.range_join(a, wide, KEY, "t", "low", "high", 12 * HOUR).select(F.col("user_id").alias("_u"), F.col("event_id").alias("_e"), F.col("t").alias("_t")).distinct()
    a = a.join(hits, (F.col("user_id") == F.col("_u")) & F.col("event_id").eqNullSafe(F.col("_e")) & (F.col("t") == F.col("_t")), "left")
    a = a.select("user_id", "subject", "event_id", "t", "score", F.col("_u").isNotNull().alias("hit"))
    r = clusters.sweep_hits(a.join(median, "subject", "left").withColumn("_gaps", F.array(*every)), KEY, "t", "event_id", "_gaps", "hit")
    by_gap = r.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("setting") + 1).alias("strategy"), "user_id", F.col("clusters").alias("c"), "tp")
    c = clusters.score_aware_sweep(a, KEY, "t", "score", "event_id", [s * UNIT for s in SCORE_AWARE], ["hit"])
    c = c.select("user_id", "event_id", "t", "score", "hit", F.posexplode("clusters").alias("setting", "cluster"))
    first = c.groupBy("user_id", "setting", "cluster").agg(F.min(F.struct((-F.col("score")).alias("s"), "t", "event_id", "hit")).alias("x"))
    aware = F.element_at(F.array(*[F.lit(f"score_aware_{s}s") for s in SCORE_AWARE]), F.col("setting") + 1)
    r = first.select(aware.alias("strategy"), "user_id", "x.event_id", "x.hit")
    r = r.unionByName(a.select(F.lit("none").alias("strategy"), "user_id", "event_id", "hit"))
    m = r.groupBy("strategy", "user_id", "event_id").agg(F.max("hit").alias("hit"))
    s = m.groupBy("strategy", "user_id").agg(F.count("*").alias("c"), F.count_if("hit").alias("tp")).unionByName(by_gap)
    g = s.groupBy("strategy").agg(F.sum("c").alias("clusters"), F.sum("tp").alias("tp"), F.sum((F.col("tp") > 0).cast("long")).alias("found")).withColumn("fp", F.col("clusters") - F.col("tp"))
    files = tr.agg(F.countDistinct("user_id").alias("files"))
    before = g.where("strategy = 'none'").select(F.col("clusters").alias("c0"), F.col("fp").alias("f0"), F.col("found").alias("d0")).crossJoin(files)  # one row
    q = g.where("strategy <> 'none'").crossJoin(F.broadcast(before))
    share = lambda c: F.col(c) / F.col("files")
    q = q.withColumn("score", F.round(clusters.strategy_score(F.col("f0"), F.col("fp"), F.col("c0"), F.col("clusters"), share("d0"), share("found")), 6))
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "strategy")) == 1  # 57 rows
    return q.select("strategy", "clusters", "tp", "fp", F.round(share("found"), 6).alias("sensitivity"), "score", best.alias("best"))


_WINDOW_LENGTHS, _WINDOW_SPLIT = [4, 6], 4


@query(f"""WITH {_N}, {_FULL}, iw AS (SELECT s.user_id, w.window_index, s.idx - w."start" AS idx, s.value FROM se s JOIN fw w ON s.user_id = w.user_id AND s.idx >= w."start" AND s.idx < w."end"),
oa AS (SELECT user_id, idx, avg(value) AS value FROM (SELECT s.user_id, s.idx, s.value FROM se s JOIN fw w ON s.user_id = w.user_id AND s.idx >= w."start" AND s.idx < w."end") GROUP BY ALL),
one AS (WITH {_lengths_sql(_WINDOW_LENGTHS, _WINDOW_SPLIT, "iw", "user_id, window_index")} SELECT 'individual' AS strategy, user_id, CAST(window_index AS BIGINT) AS window_index, m, score, pos FROM ld),
two AS (WITH {_lengths_sql(_WINDOW_LENGTHS, _WINDOW_SPLIT, "oa")} SELECT 'reconstruct' AS strategy, user_id, CASE WHEN pos < 0 THEN NULL ELSE CAST(greatest(0, ceil((pos - 19) / CAST(10 AS DOUBLE))) AS BIGINT) END AS window_index, m, score, pos FROM ld)
SELECT strategy, user_id, window_index, CAST(m AS INTEGER) AS m, round(score, 5) AS score, CAST(pos AS BIGINT) AS pos FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""")
def window_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Both ways to search a windowed recording, side by side: each window by itself, and the signal put together again.

    A discord of the reconstructed signal is given to the first window that holds it.
    """
    s = _in_windows(spark, d)
    one = s.select("user_id", "window_index", (F.col("idx") - F.col("window_index") * 10).alias("pos"), F.col("value").cast("double").alias("v"))
    one = profile.left_discords(one, ["user_id", "window_index"], _WINDOW_LENGTHS, _WINDOW_SPLIT).select(F.lit("individual").alias("strategy"), "user_id", "window_index", "m", "score", "pos")
    back = sequence.reconstruct(s, KEY, "idx", "value")
    two = profile.left_discords(back.select("user_id", F.col("idx").alias("pos"), F.col("value").alias("v")), KEY, _WINDOW_LENGTHS, _WINDOW_SPLIT)
    first = F.when(F.col("pos") >= 0, F.greatest(F.lit(0).cast("long"), F.ceil((F.col("pos") - 19) / 10).cast("long")))
    two = two.select(F.lit("reconstruct").alias("strategy"), "user_id", first.alias("window_index"), "m", "score", "pos")
    return one.unionByName(two).withColumn("score", F.round("score", 5))
