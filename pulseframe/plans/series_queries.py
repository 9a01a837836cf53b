"""Queries over series: islands, windows, rolling statistics, heart-rate rules, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scalars, tables
from ..operators import hrv, intervals, metrics, ml, sequence
from ..sources import bridge
from ..sources.bridge import HOUR
from .registry import query

KEY, ORDER = ["user_id"], ["idx"]


def _w() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("idx")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return bridge.series(spark, d).withColumn("label", (F.col("event_type") == "error").cast("int"))


_LABEL = "la AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM se)"
_ISLANDS = f"""{_LABEL},
i0 AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY user_id ORDER BY idx), 0) = 0 THEN 1 ELSE 0 END AS nw FROM la),
i1 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM i0),
il AS (SELECT user_id, island, min(idx) AS first, max(idx) AS last, count(*) AS n, min(t) AS t0, max(t) AS t1, max(value) AS best FROM i1 WHERE label = 1 GROUP BY ALL)"""


@query(f"WITH {_ISLANDS} SELECT user_id, CAST(island AS BIGINT) AS island, first, last, n FROM il")
def label_islands(spark: SparkSession, d: str) -> DataFrame:
    return sequence.islands(_labelled(spark, d), KEY, ORDER, "label", "idx")


@query(f"WITH {_ISLANDS} SELECT user_id, first, n, t1 - t0 AS duration_us FROM il WHERE n > 1")
def island_durations(spark: SparkSession, d: str) -> DataFrame:
    s = _labelled(spark, d)
    i = sequence.islands(s, KEY, ORDER, "label", "idx").where("n > 1")
    ends = s.select("user_id", "idx", "t")
    j = i.join(ends.withColumnRenamed("idx", "first").withColumnRenamed("t", "t0"), ["user_id", "first"]).join(ends.withColumnRenamed("idx", "last").withColumnRenamed("t", "t1"), ["user_id", "last"])
    return j.select("user_id", "first", "n", (F.col("t1") - F.col("t0")).alias("duration_us"))


@query(f"""WITH {_LABEL} SELECT user_id, event_id, max(label) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS padded FROM la""")
def padded_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels widened by three rows before and two after."""
    return _labelled(spark, d).select("user_id", "event_id", sequence.pad(F.col("label"), _w(), 3, 2).alias("padded"))


@query(f"""WITH {_LABEL} SELECT user_id, event_id, coalesce(max(label) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND {12 * HOUR} FOLLOWING), 0) AS dilated FROM la""")
def dilated_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels widened in time: twelve hours before and six after."""
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-6 * HOUR, 12 * HOUR)
    return _labelled(spark, d).select("user_id", "event_id", F.max("label").over(w).alias("dilated"))


_MASKS = f"""{_ISLANDS},
p0 AS (SELECT *, CASE WHEN value > 90 AND coalesce(lag(value > 90) OVER (PARTITION BY user_id ORDER BY idx), false) = false THEN 1 ELSE 0 END AS nw FROM se),
p1 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM p0),
pl AS (SELECT user_id, island, min(idx) AS first, max(idx) AS last, max(value) AS best FROM p1 WHERE value > 90 GROUP BY ALL)"""


@query(f"""WITH {_MASKS},
pp AS (SELECT t.user_id, t.island AS ti, p.island AS pi FROM il t JOIN pl p ON t.user_id = p.user_id AND t.first <= p.last AND p.first <= t.last),
c AS (SELECT user_id, count(DISTINCT ti) AS tp, count(DISTINCT pi) AS hit FROM pp GROUP BY user_id),
n AS (SELECT user_id, count(*) AS n FROM il GROUP BY user_id), m AS (SELECT user_id, count(*) AS m FROM pl GROUP BY user_id),
j AS (SELECT coalesce(n.user_id, m.user_id) AS user_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM n FULL JOIN m ON n.user_id = m.user_id)
SELECT j.user_id, coalesce(tp, 0) AS tp, n - coalesce(tp, 0) AS fn, m - coalesce(hit, 0) AS fp FROM j LEFT JOIN c ON j.user_id = c.user_id""")
def mask_events_eval(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two masks against each other: labels, and scores strictly over a threshold."""
    s = _labelled(spark, d).withColumn("hit", F.col("value") > 90)
    span = lambda flag: sequence.islands(s, KEY, ORDER, flag, "idx").select("user_id", F.col("first").alias("start"), (F.col("last") + 1).alias("end"))
    return metrics.mask_events(span("label"), span("hit"), KEY, 64).select("user_id", "tp", "fn", "fp")


@query(f"""WITH {_MASKS} SELECT p.user_id, p.first, p.last, p.best, CASE WHEN count(t.island) > 0 THEN 1 ELSE 0 END AS hit
FROM pl p LEFT JOIN il t ON t.user_id = p.user_id AND t.first <= p.last AND p.first <= t.last GROUP BY ALL""")
def mask_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Runs over the threshold with their largest score and whether they meet a labelled row."""
    s = _labelled(spark, d).withColumn("over", F.col("value") > 90)
    return sequence.islands(s, KEY, ORDER, "over", "idx", best=F.max("value"), hit=F.max("label")).drop("n", "island")


_N = "ln AS (SELECT user_id, count(*) AS n FROM se GROUP BY user_id)"
_FULL = "fw AS (SELECT user_id, n, k AS window_index, k * 10 AS \"start\", k * 10 + 20 AS \"end\" FROM ln, LATERAL (SELECT unnest(range(0, CASE WHEN n >= 20 THEN (n - 20) // 10 + 1 ELSE 0 END)) AS k))"


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return bridge.series(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_N}, {_FULL} SELECT user_id, CAST(window_index AS INTEGER) AS window_index, "start", "end" FROM fw""")
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return sequence.fixed_windows(_lengths(spark, d), KEY, "n", 20, 10).drop("kind")


@query(f"""WITH {_N}, {_FULL},
x AS (SELECT user_id, window_index, "start", "end", 'full' AS kind FROM fw
  UNION ALL SELECT user_id, (n - 20) // 10 + 1, ((n - 20) // 10) * 10 + 20, n, 'trailing' FROM ln WHERE n >= 20 AND n - ((n - 20) // 10) * 10 - 20 >= 3)
SELECT x.user_id, window_index, "start", "end", kind, round(avg(se.value), 5) AS mean FROM x JOIN se ON x.user_id = se.user_id AND se.idx >= x."start" AND se.idx < x."end" GROUP BY ALL""")
def exploded_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows with their means by the table function, called from SQL on partitions in order."""
    tables.register(spark)
    rows = bridge.series(spark, d).select("user_id", "idx", "value")
    call = "SELECT * FROM explode_windows(TABLE({rows}) PARTITION BY user_id ORDER BY idx, key => 'user_id', value => 'value', width => 20, stride => 10, least_tail => 3)"
    return spark.sql(call, rows=rows).withColumn("mean", F.round("mean", 5))


@query(f"""WITH {_N}, {_FULL},
x AS (SELECT user_id, n, (n - 20) // 10 + 1 AS k, ((n - 20) // 10) * 10 + 20 AS covered FROM ln WHERE n >= 20)
SELECT user_id, CAST(window_index AS INTEGER) AS window_index, "start", "end", 'full' AS kind FROM fw
UNION ALL SELECT user_id, CAST(k AS INTEGER), covered, n, 'trailing' FROM x WHERE n - covered >= 3""")
def trailing_windows(spark: SparkSession, d: str) -> DataFrame:
    return sequence.fixed_windows(_lengths(spark, d), KEY, "n", 20, 10, least_tail=3)


@query(f"""WITH {_N} SELECT user_id, CAST(k AS INTEGER) AS window_index, k * 30 AS "start", k * 30 + 60 AS "end", 'full' AS kind
FROM ln, LATERAL (SELECT unnest(range(0, CASE WHEN n >= 60 THEN (n - 60) // 30 + 1 ELSE 0 END)) AS k)
UNION ALL SELECT user_id, 0, 0, n, 'whole' FROM ln WHERE n < 60""")
def flexible_windows(spark: SparkSession, d: str) -> DataFrame:
    return sequence.fixed_windows(_lengths(spark, d), KEY, "n", 60, 30, whole_if_short=True)


_IN = f"{_N}, {_FULL}, iw AS (SELECT s.*, w.window_index FROM se s JOIN fw w ON s.user_id = w.user_id AND s.idx >= w.\"start\" AND s.idx < w.\"end\")"


def _in_windows(spark: SparkSession, d: str) -> DataFrame:
    s = sequence.in_windows(bridge.series(spark, d), KEY, "idx", 20, 10)
    return s.join(_lengths(spark, d), KEY).where("window_index * 10 + 20 <= n")


@query(f"""WITH {_IN}, c AS (SELECT user_id, window_index, event_type, count(*) AS n FROM iw GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_index ORDER BY n DESC, event_type) AS r FROM c)
SELECT user_id, window_index, CASE WHEN n > 10 THEN event_type ELSE 'mixed' END AS phase FROM r WHERE r = 1""")
def phase_windows(spark: SparkSession, d: str) -> DataFrame:
    """The label of over half of a window's rows, else mixed."""
    c = _in_windows(spark, d).groupBy("user_id", "window_index", "event_type").agg(F.count("*").alias("c"))
    g = c.groupBy("user_id", "window_index").agg(F.max("c").alias("c"), F.max_by("event_type", "c").alias("e"))
    return g.select("user_id", "window_index", F.when(F.col("c") > 10, F.col("e")).otherwise("mixed").alias("phase"))


@query(f"""WITH {_IN} SELECT user_id, window_index, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_labelled,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS ratio, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS label FROM iw GROUP BY ALL""")
def window_labels(spark: SparkSession, d: str) -> DataFrame:
    on = (F.col("event_type") == "error").cast("int")
    return _in_windows(spark, d).groupBy("user_id", "window_index").agg(F.sum(on).alias("n_labelled"), F.round(F.avg(on), 6).alias("ratio"), F.max(on).alias("label"))


@query(f"""WITH {_IN} SELECT user_id, window_index, round(avg(value), 6) AS mean_value FROM iw GROUP BY user_id, window_index HAVING sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0""")
def normal_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows without a labelled row."""
    g = _in_windows(spark, d).groupBy("user_id", "window_index").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.sum((F.col("event_type") == "error").cast("int")).alias("n"))
    return g.where("n = 0").drop("n")


@query(f"""WITH {_IN}, sc AS (SELECT user_id, window_index, avg(value) AS score FROM iw GROUP BY ALL)
SELECT iw.user_id, iw.idx, round(avg(score), 6) AS mean_score, round(sum(score), 4) AS sum_score FROM iw JOIN sc ON iw.user_id = sc.user_id AND iw.window_index = sc.window_index GROUP BY ALL""")
def overlap_add(spark: SparkSession, d: str) -> DataFrame:
    """Window scores put back on the rows they cover, as mean and as sum."""
    s = _in_windows(spark, d).withColumn("score", F.avg("value").over(Window.partitionBy("user_id", "window_index")))
    return s.groupBy("user_id", "idx").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.sum("score"), 4).alias("sum_score"))


@query("SELECT user_id, event_id, (t - lag(t) OVER (PARTITION BY user_id ORDER BY idx)) / CAST(1000 AS DOUBLE) AS rr_ms FROM se")
def rr_intervals(spark: SparkSession, d: str) -> DataFrame:
    return bridge.series(spark, d).select("user_id", "event_id", (sequence.difference(F.col("t"), _w()) / 1000.0).alias("rr_ms"))


@query("SELECT user_id, event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS median7 FROM se")
def rr_median7(spark: SparkSession, d: str) -> DataFrame:
    return bridge.series(spark, d).select("user_id", "event_id", F.round(sequence.rolling_median(F.col("value"), _w().rowsBetween(-6, 0)), 6).alias("median7"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean10 FROM se")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return bridge.series(spark, d).select("user_id", "event_id", F.round(F.avg("value").over(_w().rowsBetween(-9, 0)), 6).alias("mean10"))


_CSI = """q0 AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY idx) AS b FROM se),
q1 AS (SELECT *, stddev_samp((value - b) / sqrt(2)) OVER w AS s1, stddev_samp((value + b) / sqrt(2)) OVER w AS s2 FROM q0 WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
q2 AS (SELECT *, CASE WHEN idx >= 9 THEN s1 END AS sd1, CASE WHEN idx >= 9 THEN s2 END AS sd2 FROM q1),
cs AS (SELECT *, CASE WHEN sd1 > 1e-9 THEN sd2 / sd1 END AS csi, CASE WHEN sd1 > 1e-9 THEN (4 * sd2) * (4 * sd2) / (4 * sd1) END AS mod_csi FROM q2),
sl AS (SELECT *, CASE WHEN idx >= 9 THEN abs(regr_slope(value, CAST(idx + 1 AS DOUBLE)) OVER v) / avg(value) OVER v END AS slope FROM cs WINDOW v AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_CSI} SELECT user_id, event_id, round(csi, 5) AS csi, round(mod_csi, 3) AS mod_csi FROM cs")
def csi_modcsi(spark: SparkSession, d: str) -> DataFrame:
    p = sequence.poincare(bridge.series(spark, d), KEY, ORDER, "value", 10)
    return p.select("user_id", "event_id", F.round("csi", 5).alias("csi"), F.round("mod_csi", 3).alias("mod_csi"))


@query("""WITH h AS (SELECT *, coalesce(lead(value) OVER w - lag(value) OVER w, 0) AS d FROM se WINDOW w AS (PARTITION BY user_id ORDER BY idx))
SELECT user_id, event_id, CASE WHEN idx >= 9 THEN round(sum(d) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) END AS hr_diff FROM h""")
def hr_diff(spark: SparkSession, d: str) -> DataFrame:
    r = sequence.central_difference_sum(bridge.series(spark, d), KEY, ORDER, "value", 10)
    return r.select("user_id", "event_id", F.round("hr_diff", 4).alias("hr_diff"))


@query(f"WITH {_CSI} SELECT user_id, event_id, round(slope, 6) AS slope FROM sl")
def tachogram_slope(spark: SparkSession, d: str) -> DataFrame:
    return sequence.relative_slope(bridge.series(spark, d), KEY, ORDER, "value", 10).select("user_id", "event_id", F.round("slope", 6).alias("slope"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    s = sequence.poincare(bridge.series(spark, d), KEY, ORDER, "value", 10)
    return sequence.relative_slope(s, KEY, ORDER, "value", 10)


@query(f"WITH {_CSI} SELECT user_id, event_id, round(csi * slope, 5) AS csi_slope, round(mod_csi * slope, 3) AS mod_csi_slope FROM sl")
def feature_products(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("user_id", "event_id", F.round(F.col("csi") * F.col("slope"), 5).alias("csi_slope"), F.round(F.col("mod_csi") * F.col("slope"), 3).alias("mod_csi_slope"))


#: A recording is one week of a user's series.
_WEEK = 7 * 24 * HOUR
_REC = f"""rc AS (SELECT *, (t - min(t) OVER (PARTITION BY user_id)) // {_WEEK} AS rec FROM se),
du AS (SELECT user_id, rec, min(t) AS t0, max(t) - min(t) AS dur FROM rc GROUP BY ALL),
tt AS (SELECT user_id, sum(dur) AS total FROM du GROUP BY user_id),
ba AS (SELECT user_id, CASE WHEN total > {48 * HOUR} THEN {24 * HOUR} * CAST(1 AS DOUBLE) ELSE total / CAST(2 AS DOUBLE) END AS base FROM tt)"""


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    s = bridge.series(spark, d)
    first = F.min("t").over(Window.partitionBy("user_id"))
    return s.withColumn("rec", F.floor((F.col("t") - first) / _WEEK).cast("long")).withColumn("label", (F.col("event_type") == "error").cast("int"))


@query(f"""WITH {_REC},
n0 AS (SELECT rc.user_id, rc.rec, rc.t, rc.value FROM rc WHERE event_type <> 'error'),
n1 AS (SELECT *, min(t) OVER (PARTITION BY user_id, rec) AS a FROM n0),
f1 AS (SELECT n1.user_id, max(value) AS best FROM n1 JOIN ba ON n1.user_id = ba.user_id WHERE rec = (SELECT min(rec) FROM n1 x WHERE x.user_id = n1.user_id) AND t <= a + base GROUP BY n1.user_id)
SELECT user_id, round(best * 1.05, 6) AS first_recording_cutoff FROM f1""")
def baseline_cutoff_first(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff from the first recording's part of the baseline."""
    return hrv.baseline_cutoff(_recordings(spark, d), KEY, "rec", "t", "value", "label", first_only=True).select("user_id", F.round("cutoff", 6).alias("first_recording_cutoff"))


@query(f"""WITH RECURSIVE {bridge.SQL}, {_REC},
n0 AS (SELECT rc.user_id, rc.rec, rc.t, rc.value FROM rc WHERE event_type <> 'error'),
n1 AS (SELECT user_id, rec, min(t) AS a, row_number() OVER (PARTITION BY user_id ORDER BY rec) AS k FROM n0 GROUP BY user_id, rec),
lf AS (
  SELECT n1.user_id, n1.rec, k, a, base AS rest FROM n1 JOIN ba ON n1.user_id = ba.user_id WHERE k = 1
  UNION ALL
  SELECT n.user_id, n.rec, n.k, n.a, l.rest - l.used FROM (
    SELECT lf.user_id, lf.k, lf.rest, CASE WHEN lf.rest > 0 THEN (SELECT max(n0.t) FROM n0 WHERE n0.user_id = lf.user_id AND n0.rec = lf.rec AND n0.t <= lf.a + lf.rest) - lf.a ELSE 0 END AS used FROM lf) l
  JOIN n1 n ON n.user_id = l.user_id AND n.k = l.k + 1)
SELECT lf.user_id, round(coalesce(max(n0.value) FILTER (rest > 0 AND n0.t <= a + rest) * 1.05, 0), 6) AS cutoff FROM lf JOIN n0 ON n0.user_id = lf.user_id AND n0.rec = lf.rec GROUP BY lf.user_id""", shared=False)
def baseline_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff from as many recordings as the baseline takes, each using what the ones before have left."""
    return hrv.baseline_cutoff(_recordings(spark, d), KEY, "rec", "t", "value", "label").select("user_id", F.round("cutoff", 6).alias("cutoff"))


HOLD = 48 * HOUR


def _refractory_sql(condition: str) -> str:
    return f"""a AS (SELECT user_id, t FROM se WHERE {condition}),
r AS (SELECT user_id, min(t) AS t FROM a GROUP BY user_id UNION ALL
  SELECT user_id, t FROM (SELECT r.user_id, (SELECT min(a.t) FROM a WHERE a.user_id = r.user_id AND a.t > r.t + {HOLD}) AS t FROM r) WHERE t IS NOT NULL)
SELECT user_id, t FROM r"""


def _recursive(condition: str) -> str:
    return f"WITH RECURSIVE {bridge.SQL}, {_refractory_sql(condition)}"


@query(_recursive("value > 60"), shared=False)
def refractory_alarms(spark: SparkSession, d: str) -> DataFrame:
    return sequence.refractory(bridge.series(spark, d).where("value > 60").select("user_id", "t"), KEY, "t", HOLD)


@query(_recursive("value > 120 OR (event_type = 'click' AND value > 40)"), shared=False)
def refractory_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Alarms when any of several cutoffs is passed."""
    return sequence.refractory(bridge.series(spark, d).where("value > 120 OR (event_type = 'click' AND value > 40)").select("user_id", "t"), KEY, "t", HOLD)


_PARAMS = {"value": 120.0, "value_click": 60.0}
_HITS = """pa AS (SELECT 'value' AS parameter, user_id, subject, idx, event_type FROM se WHERE value > 120 UNION ALL SELECT 'value_click', user_id, subject, idx, event_type FROM se WHERE event_type = 'click' AND value > 60),
pm AS (SELECT p.parameter, p.user_id, p.subject, p.idx, CASE WHEN EXISTS (SELECT 1 FROM se s WHERE s.user_id = p.user_id AND s.event_type = 'error' AND s.idx BETWEEN p.idx - 3 AND p.idx + 3) THEN 1 ELSE 0 END AS ok FROM pa p),
pd AS (SELECT p.parameter, s.user_id, s.subject, s.idx, CASE WHEN EXISTS (SELECT 1 FROM pa q WHERE q.parameter = p.parameter AND q.user_id = s.user_id AND q.idx BETWEEN s.idx - 3 AND s.idx + 3) THEN 1 ELSE 0 END AS found
  FROM se s, (SELECT DISTINCT parameter FROM pa) p WHERE s.event_type = 'error'),
sa AS (SELECT parameter, subject, count(*) AS n_pred, CAST(sum(ok) AS BIGINT) AS n_ok FROM pm GROUP BY ALL),
sb AS (SELECT parameter, subject, count(*) AS n_true, CAST(sum(found) AS BIGINT) AS n_found FROM pd GROUP BY ALL),
sh AS (SELECT subject, sum(hours) AS hours FROM hr GROUP BY subject),
sm AS (SELECT b.parameter, b.subject, n_true, n_found, coalesce(n_pred, 0) AS n_pred, coalesce(n_ok, 0) AS n_ok, hours FROM sb b LEFT JOIN sa a ON a.parameter = b.parameter AND a.subject = b.subject JOIN sh ON sh.subject = b.subject)"""


def _param(spark: SparkSession, d: str) -> DataFrame:
    s = bridge.series(spark, d)
    p = s.where("value > 120").withColumn("parameter", F.lit("value")).unionByName(s.where("event_type = 'click' AND value > 60").withColumn("parameter", F.lit("value_click")))
    hours = bridge.hours(spark, d).groupBy("subject").agg(F.sum("hours").alias("hours"))
    return hrv.parameter_counts(p, s.where("event_type = 'error'"), hours, "parameter", ["user_id"], "subject", "idx", 3, sorted(_PARAMS))


@query(f"""WITH {_HITS} SELECT parameter, subject, n_true, n_found, n_pred, n_ok, round(CAST(n_found AS DOUBLE) / n_true, 6) AS sensitivity, round(CAST(n_ok AS DOUBLE) / nullif(n_pred, 0), 6) AS prec,
  round(CASE WHEN n_pred > 0 AND n_ok + n_found > 0 THEN 2.0 * (CAST(n_ok AS DOUBLE) / n_pred) * (CAST(n_found AS DOUBLE) / n_true) / (CAST(n_ok AS DOUBLE) / n_pred + CAST(n_found AS DOUBLE) / n_true) END, 6) AS f1,
  round((n_pred - n_ok) / nullif(hours / 24, 0), 6) AS fa_per_day FROM sm""")
def param_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = hrv.parameter_metrics(_param(spark, d))
    return m.select("parameter", "subject", "n_true", "n_found", "n_pred", "n_ok", *[F.round(c, 6).alias(c) for c in ("sensitivity", "prec", "f1", "fa_per_day")])


@query(f"""WITH {_HITS} SELECT parameter, CAST(sum(n_true) AS BIGINT) AS n_true, CAST(sum(n_found) AS BIGINT) AS n_found, round(CAST(sum(n_found) AS DOUBLE) / sum(n_true), 6) AS sensitivity,
  round(CAST(sum(n_ok) AS DOUBLE) / nullif(sum(n_pred), 0), 6) AS prec, round(CAST(sum(n_pred - n_ok) AS DOUBLE) / sum(hours), 6) AS fa_per_hour,
  row_number() OVER (ORDER BY round(CAST(sum(n_found) AS DOUBLE) / sum(n_true), 6) DESC, parameter) AS rank FROM sm GROUP BY parameter""")
def pooled_metrics_rank(spark: SparkSession, d: str) -> DataFrame:
    g = _param(spark, d).groupBy("parameter").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_found", "n_pred", "n_ok", "hours")])
    g = g.select("parameter", "n_true", "n_found", F.round(metrics.ratio(F.col("n_found"), F.col("n_true")), 6).alias("sensitivity"), F.round(metrics.ratio(F.col("n_ok"), F.col("n_pred")), 6).alias("prec"), F.round((F.col("n_pred") - F.col("n_ok")) / F.col("hours"), 6).alias("fa_per_hour"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sensitivity"), "parameter")).cast("long"))


@query(f"""WITH {_LABEL}, x AS (SELECT *, max(CASE WHEN label = 1 AND value < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS excluded FROM la)
SELECT user_id, CAST(sum(CASE WHEN value > 60 AND excluded = 0 THEN 1 ELSE 0 END) AS BIGINT) AS counted, CAST(sum(CASE WHEN value > 60 AND excluded = 1 THEN 1 ELSE 0 END) AS BIGINT) AS excluded FROM x GROUP BY user_id""")
def excluded_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions outside and inside the padded runs that the unfiltered labels have and the filtered ones lack."""
    s = _labelled(spark, d).withColumn("filtered", F.when((F.col("label") == 1) & (F.col("value") >= 50), 1).otherwise(0))
    return hrv.excluded_predictions(s.withColumn("predicted", F.col("value") > 60), KEY, ORDER, "label", "filtered", "predicted", 2)


@query(f"""WITH {_ISLANDS}, h AS (SELECT il.user_id, il.island, max(CASE WHEN s.value > 60 THEN 1 ELSE 0 END) AS hit FROM il JOIN se s ON s.user_id = il.user_id AND s.idx BETWEEN il.first AND il.last GROUP BY ALL)
SELECT user_id, count(*) AS islands, CAST(sum(hit) AS BIGINT) AS hit FROM h GROUP BY user_id""")
def island_hits(spark: SparkSession, d: str) -> DataFrame:
    s = _labelled(spark, d).withColumn("predicted", F.col("value") > 60)
    return hrv.island_hits(s, KEY, ORDER, "label", "predicted")


@query("SELECT user_id, event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z, round((value - avg(value) OVER w) / greatest(stddev_samp(value) OVER w, CAST(0.0001 AS DOUBLE)), 6) AS z_floor, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS scaled FROM se WINDOW w AS (PARTITION BY user_id)")
def zscore_series(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    v = F.col("value")
    z = metrics.ratio(v - F.avg(v).over(w), F.stddev_pop(v).over(w))
    zf = (v - F.avg(v).over(w)) / F.greatest(F.stddev_samp(v).over(w), F.lit(1e-4))
    mm = metrics.ratio(v - F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w))
    return bridge.series(spark, d).select("user_id", "event_id", F.round(z, 6).alias("z"), F.round(zf, 6).alias("z_floor"), F.round(mm, 6).alias("scaled"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM se")
def centered_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Mean over the half-open window of eight values around each."""
    return bridge.series(spark, d).select("user_id", "event_id", F.round(F.avg("value").over(_w().rowsBetween(-4, 3)), 6).alias("smooth"))


@query(f"""WITH a AS (SELECT user_id, t, value, min(t) OVER (PARTITION BY user_id) AS t0, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1, lead(value) OVER (PARTITION BY user_id ORDER BY t) AS v1 FROM se),
g AS (SELECT user_id, t0, k, t0 + k * {12 * HOUR} AS pt FROM (SELECT user_id, min(t) AS t0, unnest(range(0, (max(t) - min(t)) // {12 * HOUR} + 1)) AS k FROM se GROUP BY user_id))
SELECT g.user_id, k, round(least(200, greatest(30, CASE WHEN t1 IS NULL OR g.pt = t THEN value ELSE value + (g.pt - t) / CAST(t1 - t AS DOUBLE) * (v1 - value) END)), 5) AS value
FROM g JOIN a ON a.user_id = g.user_id AND a.t <= g.pt AND (a.t1 > g.pt OR a.t1 IS NULL)""")
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    """On a regular grid, clipped to 30 to 200."""
    r = sequence.resample(bridge.series(spark, d).select("user_id", "t", "value"), KEY, "t", "value", 12 * HOUR)
    return r.select("user_id", "k", F.round(F.least(F.lit(200.0), F.greatest(F.lit(30.0), "value")), 5).alias("value"))


@query(f"""WITH g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY idx) AS rr, (t - min(t) OVER (PARTITION BY user_id)) // {24 * HOUR} AS k FROM se)
SELECT user_id, k, count(rr) AS beats, round(CAST({24 * HOUR} AS DOUBLE) / avg(rr), 6) AS rate FROM g WHERE rr IS NOT NULL GROUP BY user_id, k HAVING count(rr) >= 2""")
def heart_rate_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events a day from the mean interval in each day with at least two intervals."""
    s = bridge.series(spark, d).select("user_id", sequence.difference(F.col("t"), _w()).alias("rr"), F.floor((F.col("t") - F.min("t").over(Window.partitionBy("user_id"))) / (24 * HOUR)).cast("long").alias("k"))
    g = s.where("rr is not null").groupBy("user_id", "k").agg(F.count("*").alias("beats"), F.avg("rr").alias("m"))
    return g.where("beats >= 2").select("user_id", "k", "beats", F.round(float(24 * HOUR) / F.col("m"), 6).alias("rate"))


@query(f"""WITH {_LABEL}, p AS (SELECT *, CASE WHEN value > 90 THEN 1 ELSE 0 END AS hit FROM la)
SELECT user_id, CAST(sum(hit * label) AS BIGINT) AS tp, CAST(sum(hit * (1 - label)) AS BIGINT) AS fp, round(CAST(sum(hit * label) AS DOUBLE) / nullif(sum(label), 0), 6) AS sensitivity, round(CAST(sum(hit * (1 - label)) AS DOUBLE) / nullif(sum(hit), 0), 6) AS far FROM p GROUP BY user_id""")
def metrics_classic(spark: SparkSession, d: str) -> DataFrame:
    """Row by row: hits over positives, false alarms over all alarms."""
    s = _labelled(spark, d).withColumn("hit", (F.col("value") > 90).cast("int"))
    g = s.groupBy("user_id").agg(F.sum(F.col("hit") * F.col("label")).alias("tp"), F.sum(F.col("hit") * (1 - F.col("label"))).alias("fp"), F.sum("label").alias("p"), F.sum("hit").alias("h"))
    return g.select("user_id", "tp", "fp", F.round(metrics.ratio(F.col("tp"), F.col("p")), 6).alias("sensitivity"), F.round(metrics.ratio(F.col("fp"), F.col("h")), 6).alias("far"))


@query(f"""WITH {_ISLANDS}, n AS (SELECT user_id, count(*) AS events FROM il GROUP BY user_id),
h AS (SELECT s.user_id, s.idx, min(il.island) AS island FROM se s LEFT JOIN il ON il.user_id = s.user_id AND s.idx BETWEEN il.first AND il.last WHERE s.value > 90 GROUP BY ALL),
c AS (SELECT user_id, count(DISTINCT island) AS tp, count(*) - count(island) AS outside FROM h GROUP BY user_id)
SELECT u.user_id, coalesce(events, 0) AS events, coalesce(tp, 0) AS tp, CASE WHEN coalesce(events, 0) > 0 THEN coalesce(outside, 0) ELSE 0 END AS fp_with_events, coalesce(outside, 0) AS fp_all
FROM (SELECT DISTINCT user_id FROM se) u LEFT JOIN n ON n.user_id = u.user_id LEFT JOIN c ON c.user_id = u.user_id""")
def metrics_event(spark: SparkSession, d: str) -> DataFrame:
    """Events hit by any alarm inside; false alarms counted in series with events only, and in all."""
    s = _labelled(spark, d).withColumn("hit", F.col("value") > 90)
    i = sequence.islands(s, KEY, ORDER, "label", "idx").groupBy("user_id").agg(F.count("*").alias("events"))
    c = hrv.island_hits(s, KEY, ORDER, "label", "hit").select("user_id", F.col("hit").alias("tp"))
    o = s.groupBy("user_id").agg(F.sum((F.col("hit") & (F.col("label") == 0)).cast("long")).alias("fp_all"))
    j = o.join(i, KEY, "left").join(c, KEY, "left").na.fill(0)
    return j.select("user_id", "events", "tp", F.when(F.col("events") > 0, F.col("fp_all")).otherwise(0).alias("fp_with_events"), "fp_all")


@query(f"""WITH {_ISLANDS},
h AS (SELECT s.user_id, s.idx, il.island FROM se s LEFT JOIN il ON il.user_id = s.user_id AND s.idx BETWEEN il.first - 2 AND il.last + 2 WHERE s.value > 90)
SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, island FROM h WHERE island IS NOT NULL)) AS tp, (SELECT count(*) FROM h WHERE island IS NULL) AS fp, (SELECT count(*) FROM il) AS events, round((SELECT sum(hours) FROM hr), 4) AS hours""")
def metrics_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Events with an alarm within two rows, alarms near no event, over all series."""
    s = _labelled(spark, d)
    i = sequence.islands(s, KEY, ORDER, "label", "idx")
    near = sequence.pad(F.col("label"), _w(), 2, 2)
    a = s.withColumn("near", near).where("value > 90")
    wide = i.select("user_id", "island", (F.col("first") - 2).alias("low"), (F.col("last") + 2).alias("high"))
    tp = intervals.range_join(a.select("user_id", "idx"), wide, KEY, "idx", "low", "high", 32).select("user_id", "island").distinct().agg(F.count("*").alias("tp"))
    fp = a.agg(F.sum((F.col("near") == 0).cast("long")).alias("fp"))
    return tp.crossJoin(fp).crossJoin(i.agg(F.count("*").alias("events"))).crossJoin(bridge.hours(spark, d).agg(F.round(F.sum("hours"), 4).alias("hours")))  # one row each


@query("""WITH q AS (SELECT user_id, avg(value) + 2 * stddev_pop(value) AS lim FROM se GROUP BY user_id)
SELECT s.user_id, CAST(sum(CASE WHEN abs(value) > lim THEN 1 ELSE 0 END) AS BIGINT) AS artifacts, CASE WHEN avg(CASE WHEN abs(value) > lim THEN 1.0 ELSE 0.0 END) < 0.05 THEN 'good' ELSE 'poor' END AS quality FROM se s JOIN q ON s.user_id = q.user_id GROUP BY s.user_id""")
def artifact_quality(spark: SparkSession, d: str) -> DataFrame:
    """Values beyond mean plus so many deviations, and a label for few of them."""
    w = Window.partitionBy("user_id")
    s = bridge.series(spark, d).withColumn("bad", F.abs("value") > F.avg("value").over(w) + 2 * F.stddev_pop("value").over(w))
    return s.groupBy("user_id").agg(F.sum(F.col("bad").cast("long")).alias("artifacts"), F.when(F.avg(F.col("bad").cast("double")) < 0.05, "good").otherwise("poor").alias("quality"))


@query(f"""WITH {_IN} SELECT user_id, window_index, round(min(value), 6) AS low, round(max(value), 6) AS high FROM iw GROUP BY user_id, window_index HAVING min(value) >= 1 AND max(value) <= 300""")
def plausible_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows all of whose values are finite and within limits."""
    g = _in_windows(spark, d).groupBy("user_id", "window_index").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.isnan("value")).alias("nan"))
    return g.where((F.col("low") >= 1) & (F.col("high") <= 300) & ~F.col("nan")).select("user_id", "window_index", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT user_id, event_id, CASE WHEN subject BETWEEN 1 AND 96 THEN 'train' WHEN subject BETWEEN 97 AND 125 THEN 'test' END AS split FROM se WHERE idx % 3 = 0")
def strided_split(spark: SparkSession, d: str) -> DataFrame:
    """Every third row of each series (the operator is the stride), with the subject's split."""
    return bridge.series(spark, d).where("idx % 3 = 0").select("user_id", "event_id", scalars.split_of(F.col("subject")).alias("split"))


@query(f"""WITH {_LABEL}, w AS (SELECT user_id, idx, label, list(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS win FROM la)
SELECT user_id, idx, label, round(list_avg(win), 6) AS mean_value, win[5] AS middle FROM w WHERE len(win) = 9""")
def centred_samples(spark: SparkSession, d: str) -> DataFrame:
    s = ml.centred_windows(_labelled(spark, d), KEY, "idx", "value", "label", 4)
    mean = F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / 9
    return s.select("user_id", "idx", "label", F.round(mean, 6).alias("mean_value"), F.element_at("window", 5).alias("middle"))
