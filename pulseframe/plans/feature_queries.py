"""Queries over features, peaks, thresholds and the state of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dsp, hrv, intervals, metrics, profile, sequence
from ..sources import bridge, readers
from ..sources.bridge import HOUR, POST, PRE, table
from .registry import query
from .signal_queries import _LENGTHS, _VEC, SPLIT, _lengths_sql, _series, _vectors

KEY = ["user_id"]


@query(f"""WITH g AS (SELECT user_id, t - min(t) OVER (PARTITION BY user_id) AS s FROM se),
w AS (SELECT user_id, s, unnest(range(greatest(0, s // {24 * HOUR} - 1), s // {24 * HOUR} + 1)) AS k FROM g)
SELECT user_id, k, count(*) AS beats, round(CAST({24 * HOUR} AS DOUBLE) / ((max(s) - min(s)) / CAST(count(*) - 1 AS DOUBLE)), 6) AS rate FROM w GROUP BY user_id, k HAVING count(*) >= 2 AND max(s) > min(s)""")
def heart_rate_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Rate from the mean interval in windows of two days that begin every day, where at least two beats stand in one."""
    since = F.col("t") - F.min("t").over(Window.partitionBy("user_id"))
    return hrv.sliding_rate(bridge.events(spark, d).select("user_id", since.alias("s")), KEY, "s", 48 * HOUR, 24 * HOUR, float(24 * HOUR)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_VEC}, p AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(v) AS x FROM ve), h AS (SELECT vec_id, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS x FROM p),
k AS (SELECT CAST(unnest(range(0, 33)) AS BIGINT) AS k), w AS (SELECT sum((0.5 - 0.5 * cos(2 * pi() * i / 63)) ** 2) AS w FROM (SELECT unnest(range(0, 64)) AS i)),
f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * i * k / 64)) ** 2 + sum(x * sin(2 * pi() * i * k / 64)) ** 2 AS p FROM h, k GROUP BY ALL), g AS (SELECT vec_id, k * CAST(64 AS DOUBLE) / 64 AS f, p / (64 * w) AS p FROM f, w),
b AS (SELECT vec_id, round(sum(p), 6) AS total, round(avg(p) FILTER (f >= 0.5 AND f < 4), 6) AS delta, round(avg(p) FILTER (f >= 4 AND f < 8), 6) AS theta, round(avg(p) FILTER (f >= 8 AND f < 13), 6) AS alpha, round(avg(p) FILTER (f >= 13 AND f < 30), 6) AS beta FROM g GROUP BY vec_id)
SELECT ve.vec_id, round(list_stddev_pop(v), 6) AS std, round(list_min(v), 6) AS low, round(list_max(v), 6) AS high, round(list_sum(list_transform(range(1, len(v)), lambda i: abs(v[i + 1] - v[i]))), 5) AS line_length,
  round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)), 6) AS rms, total, delta, theta, alpha, beta FROM ve JOIN b ON ve.vec_id = b.vec_id""", shared=False)
def window_feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """All features of a window, of the time domain (in the JVM) and of the frequency bands."""
    f = dsp.time_features(F.col("values"))
    time = [F.round(c, 5 if n == "line_length" else 6).alias(n) for n, c in f.items()]
    p = dsp.powers(_vectors(spark, d), ["vec_id"], 64.0)
    return _vectors(spark, d).select("vec_id", *time).join(p.select("vec_id", *[F.round(c, 6).alias(c) for c in ("total", *dsp.BANDS)]), "vec_id")


@query("""WITH b AS (SELECT user_id, idx, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY idx) AS dv FROM se), ln AS (SELECT user_id, count(*) AS n FROM se GROUP BY user_id),
w AS (SELECT b.*, k FROM b JOIN ln ON ln.user_id = b.user_id, LATERAL (SELECT unnest(range(0, CASE WHEN n > 20 THEN (n - 21) // 10 + 1 ELSE 0 END)) AS k) WHERE idx >= k * 10 AND idx < k * 10 + 20),
a AS (SELECT user_id, k, avg(value) AS mean_nn, stddev_samp(value) AS sdnn, sqrt(avg(dv * dv) FILTER (idx > k * 10)) AS rmssd, stddev_samp(dv) FILTER (idx > k * 10) AS sdsd, median(value) AS median_nn,
  quantile_cont(value, CAST(0.75 AS DOUBLE)) - quantile_cont(value, CAST(0.25 AS DOUBLE)) AS iqr_nn, quantile_cont(value, CAST(0.2 AS DOUBLE)) AS prc20_nn, quantile_cont(value, CAST(0.8 AS DOUBLE)) AS prc80_nn,
  100 * avg(CASE WHEN abs(dv) > 50 THEN 1.0 ELSE 0.0 END) FILTER (idx > k * 10) AS pnn50, 100 * avg(CASE WHEN abs(dv) > 20 THEN 1.0 ELSE 0.0 END) FILTER (idx > k * 10) AS pnn20, min(value) AS min_nn, max(value) AS max_nn FROM w GROUP BY ALL HAVING max(value) <= 250),
m AS (SELECT w.user_id, w.k, CAST(1.4826 AS DOUBLE) * median(abs(w.value - a.median_nn)) AS mad_nn FROM w JOIN a ON w.user_id = a.user_id AND w.k = a.k GROUP BY ALL)
SELECT a.user_id, CAST(a.k AS BIGINT) AS window_index, round(mean_nn, 5) AS mean_nn, round(sdnn, 5) AS sdnn, round(rmssd, 5) AS rmssd, round(sdsd, 5) AS sdsd, round(sdnn / mean_nn, 5) AS cvnn, round(rmssd / mean_nn, 5) AS cvsd, round(median_nn, 5) AS median_nn,
  round(mad_nn + 1e-9, 5) AS mad_nn, round(mad_nn / median_nn, 5) AS mcv_nn, round(iqr_nn, 5) AS iqr_nn, round(sdnn / rmssd, 5) AS sd_rmssd, round(prc20_nn, 5) AS prc20_nn, round(prc80_nn, 5) AS prc80_nn, round(pnn50, 5) AS pnn50, round(pnn20, 5) AS pnn20, round(min_nn, 5) AS min_nn, round(max_nn, 5) AS max_nn
FROM a JOIN m ON a.user_id = m.user_id AND a.k = m.k""")
def hrv_features(spark: SparkSession, d: str) -> DataFrame:
    """The time domain of heart-rate variability over sliding windows of intervals; windows with implausible ones are left out."""
    f = hrv.time_domain(bridge.series(spark, d), KEY, "idx", "value", 20, 10, 0.0, 250.0)
    return f.select("user_id", "window_index", *[F.round(F.col(c) + (1e-9 if c == "mad_nn" else 0.0), 5).alias(c) for c in f.columns if c not in ("user_id", "window_index")])


_WINDOWS40 = """ln AS (SELECT user_id, count(*) AS n FROM se GROUP BY user_id),
w0 AS (SELECT se.user_id, k, idx - k * 20 AS i, value AS v FROM se JOIN ln ON ln.user_id = se.user_id, LATERAL (SELECT unnest(range(0, CASE WHEN n > 40 THEN (n - 41) // 20 + 1 ELSE 0 END)) AS k) WHERE idx >= k * 20 AND idx < k * 20 + 40),
w AS (SELECT * FROM w0 WHERE (user_id, k) IN (SELECT (user_id, k) FROM w0 GROUP BY user_id, k HAVING min(v) >= 0.01 AND max(v) <= 250))"""


def _windows40(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 40 intervals, every 20; their unit is a hundredth of a second."""
    return hrv.whole_windows(bridge.series(spark, d), KEY, "idx", "value", 40, 20, 0.01, 250.0)


_PHASE = "2 * pi() * f * t"


@query(f"""WITH {_WINDOWS40}, a AS (SELECT user_id, k, i, v / 100 AS v, sum(v / 100) OVER (PARTITION BY user_id, k ORDER BY i) AS t FROM w),
m AS (SELECT user_id, k, avg(v) AS mv, (max(t) - min(t)) / 39 AS dt FROM a GROUP BY ALL), x AS (SELECT a.user_id, a.k, t, v - mv AS x, dt FROM a JOIN m ON a.user_id = m.user_id AND a.k = m.k),
fr AS (SELECT j * CAST(0.005 AS DOUBLE) AS f FROM (SELECT unnest(range(1, 100)) AS j)),
tu AS (SELECT user_id, k, f, atan2(sum(sin(2 * {_PHASE})), sum(cos(2 * {_PHASE}))) / 2 AS z FROM x, fr GROUP BY ALL),
p AS (SELECT x.user_id, x.k, tu.f, 2 * max(dt) * (sum(x * cos({_PHASE} - z)) ** 2 / sum(cos({_PHASE} - z) ** 2) + sum(x * sin({_PHASE} - z)) ** 2 / sum(sin({_PHASE} - z) ** 2)) / 2 AS p
  FROM x JOIN tu ON x.user_id = tu.user_id AND x.k = tu.k GROUP BY x.user_id, x.k, tu.f),
b AS (SELECT user_id, k, 0.005 * coalesce(sum(p) FILTER (f >= 0.0033 AND f < 0.0399), 0) AS vlf, 0.005 * coalesce(sum(p) FILTER (f >= 0.0399 AND f < 0.1499), 0) AS lf,
  0.005 * coalesce(sum(p) FILTER (f >= 0.1499 AND f < 0.3999), 0) AS hf, 0.005 * coalesce(sum(p) FILTER (f >= 0.3999 AND f < 0.4999), 0) AS vhf FROM p GROUP BY ALL)
SELECT user_id, CAST(k AS BIGINT) AS window_index, round(vlf, 6) AS vlf, round(lf, 6) AS lf, round(hf, 6) AS hf, round(vhf, 6) AS vhf, round(vlf + lf + hf + vhf, 6) AS tp,
  round(lf / hf, 6) AS lf_hf, round(lf / (vlf + lf + hf + vhf), 6) AS lf_n, round(hf / (vlf + lf + hf + vhf), 6) AS hf_n, round(ln(hf), 6) AS ln_hf FROM b""")
def hrv_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The frequency domain of heart-rate variability over sliding windows."""
    f = hrv.frequency_domain(_windows40(spark, d), KEY, 100.0)
    return f.select("user_id", "window_index", *[F.round(c, 6).alias(c) for c in f.columns[2:]])


def _within(n: int) -> str:
    return " AND ".join(f"abs(a.l[{i}] - b.l[{i}]) <= r" for i in range(1, n + 1))


@query(f"""WITH {_WINDOWS40}, g AS (SELECT user_id, k, list(v ORDER BY i) AS v, CAST(0.2 AS DOUBLE) * stddev_samp(v) AS r FROM w GROUP BY ALL),
t AS (SELECT user_id, k, r, j, v[j:j + 2] AS l FROM g, LATERAL (SELECT unnest(range(1, 40)) AS j)),
c AS (SELECT a.user_id, a.k, a.j, count(*) FILTER ({_within(2)}) AS m2, count(*) FILTER (a.j <= 38 AND b.j <= 38 AND {_within(2)}) AS s2, count(*) FILTER (a.j <= 38 AND b.j <= 38 AND {_within(3)}) AS m3
  FROM t a JOIN (SELECT user_id, k, j, l FROM t) b ON a.user_id = b.user_id AND a.k = b.k GROUP BY a.user_id, a.k, a.j),
e AS (SELECT user_id, k, sum(CASE WHEN j <= 38 THEN m3 - 1 END) AS aa, sum(CASE WHEN j <= 38 THEN s2 - 1 END) AS bb,
  avg(ln(CAST(m2 AS DOUBLE) / 39)) - avg(CASE WHEN j <= 38 THEN ln(CAST(m3 AS DOUBLE) / 38) END) AS apen FROM c GROUP BY ALL),
q AS (SELECT user_id, k, stddev_samp((v - nv) / sqrt(2)) AS sd1, stddev_samp((v + nv) / sqrt(2)) AS sd2 FROM (SELECT *, lead(v) OVER (PARTITION BY user_id, k ORDER BY i) AS nv FROM w) GROUP BY ALL),
y AS (SELECT user_id, k, i, sum(v - mv) OVER (PARTITION BY user_id, k ORDER BY i) AS y FROM (SELECT *, avg(v) OVER (PARTITION BY user_id, k) AS mv FROM w)),
sc AS (SELECT unnest([4, 6, 8, 10, 12, 16]) AS n),
h AS (SELECT user_id, k, n, i // n AS piece, var_pop(y) * n - (covar_pop(y, i % n) * n) ** 2 / (var_pop(CAST(i % n AS DOUBLE)) * n) AS rest FROM y, sc WHERE i < 40 // n * n GROUP BY user_id, k, n, i // n),
fl AS (SELECT user_id, k, ln(CAST(n AS DOUBLE)) AS x, ln(avg(greatest(rest, 0)) / n) / 2 AS f FROM h GROUP BY user_id, k, n),
ap AS (SELECT user_id, k, regr_slope(f, x) AS alpha FROM fl GROUP BY ALL)
SELECT q.user_id, CAST(q.k AS BIGINT) AS window_index, round(sd1, 6) AS sd1, round(sd2, 6) AS sd2, round(CASE WHEN aa > 0 AND bb > 0 THEN -ln(CAST(aa AS DOUBLE) / bb) END, 6) AS sampen, round(apen, 6) AS apen, round(alpha, 6) AS dfa_alpha1,
  round(sd1 / sd2, 6) AS sd_ratio, round(pi() * sd1 * sd2, 4) AS ellipse, round(sd2 / sd1, 6) AS csi, round(log10(16 * sd1 * sd2), 6) AS cvi, round(4 * sd2 * sd2 / sd1, 4) AS csi_modified
FROM q JOIN e ON q.user_id = e.user_id AND q.k = e.k JOIN ap ON q.user_id = ap.user_id AND q.k = ap.k""")
def hrv_nonlinear(spark: SparkSession, d: str) -> DataFrame:
    """Poincare plot, entropies and fluctuation slope of heart-rate variability over sliding windows."""
    f = hrv.nonlinear(_windows40(spark, d), KEY)
    return f.select("user_id", "window_index", *[F.round(c, 4 if c in ("ellipse", "csi_modified") else 6).alias(c) for c in f.columns[2:]])


_GREEDY = """r AS (
  SELECT {key}, CAST([] AS BIGINT[]) AS taken FROM c GROUP BY {key}
  UNION ALL
  SELECT {key}, list_append(taken, nxt) FROM (
    SELECT r.{key}, r.taken, (SELECT arg_max(c.pos, struct_pack(a := c.score, b := -c.pos)) FROM c WHERE c.{key} = r.{key} AND len(list_filter(r.taken, lambda x: abs(x - c.pos) {near})) = 0) AS nxt
    FROM r WHERE len(taken) < {most}) WHERE nxt IS NOT NULL),
z AS (SELECT {key}, arg_max(taken, len(taken)) AS taken FROM r GROUP BY {key})"""


@query(f"""WITH RECURSIVE {bridge.SQL}, c AS (SELECT user_id, idx AS pos, value - 50 AS score FROM se WHERE value - 50 > 0),
{_GREEDY.format(key="user_id", near="<= 4", most=3)}, u AS (SELECT user_id, unnest(range(1, len(taken) + 1)) AS rank, unnest(taken) AS pos FROM z)
SELECT u.user_id, CAST(rank AS INTEGER) AS rank, u.pos, round(score, 5) AS score FROM u JOIN c ON u.user_id = c.user_id AND u.pos = c.pos""", shared=False)
def greedy_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three largest positive scores that stand more than four rows apart."""
    s = profile.gather(bridge.series(spark, d), KEY, ["idx"], "value").withColumn("values", F.transform("values", lambda x: x - 50.0))
    return profile.greedy(s, KEY, 4, 3, strict=False, positive=True).withColumn("score", F.round("score", 5))


@query(f"""WITH RECURSIVE {_VEC}, p AS (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(v) AS score FROM ve),
q AS (SELECT *, lag(score) OVER w AS a, lead(score) OVER w AS b, stddev_pop(score) OVER (PARTITION BY vec_id) AS sd FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY pos)),
c AS (SELECT vec_id, pos, score FROM q WHERE score > a AND score >= b AND score >= CAST(0.3 AS DOUBLE) * sd), {_GREEDY.format(key="vec_id", near="< 4", most=64)}
SELECT vec_id, CAST(unnest(taken) AS BIGINT) AS pos FROM z""", shared=False)
def simple_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Local maxima over 0.3 deviations, by falling value at least four samples apart."""
    return dsp.peaks(_vectors(spark, d), ["vec_id"], 4, 0.3)


@query("SELECT CAST(0.95 AS DOUBLE) AS q, round(quantile_cont(value, CAST(0.95 AS DOUBLE)), 6) AS threshold FROM ev UNION ALL SELECT CAST(1.5 AS DOUBLE), round(max(value) * 1.5, 6) FROM ev")
def score_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """A percentile of the scores for a share up to 1, else a multiple of the largest."""
    e = bridge.events(spark, d)
    each = [metrics.score_threshold(e, "value", q).select(F.lit(q).alias("q"), F.round("threshold", 6).alias("threshold")) for q in (0.95, 1.5)]
    return each[0].unionByName(each[1])


@query(f"""SELECT user_id, event_id, coalesce(seizure, 0) AS seizure, CAST(CASE WHEN seizure IS NULL THEN 0.0 WHEN inside THEN 1.0 ELSE 0.8 END AS DOUBLE) AS overlap_ratio, coalesce(distance, -1) AS distance FROM (
  SELECT a.user_id, a.event_id, i.seizure, a.t BETWEEN i."start" AND i."end" AS inside, abs(a.t - i."start") AS distance, row_number() OVER (PARTITION BY a.user_id, a.event_id ORDER BY i.seizure NULLS LAST) AS r
  FROM al a LEFT JOIN tr i ON a.user_id = i.user_id AND a.t BETWEEN i."start" - {PRE} AND i."end" + {POST}) WHERE r = 1""")
def tolerance_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Each alarm with the first interval whose tolerance holds it: ratio 1.0 inside, 0.8 in the margins, 0.0 (and seizure 0, distance -1) without any."""
    i = bridge.truth(spark, d).select("user_id", "seizure", "start", "end", (F.col("start") - PRE).alias("low"), (F.col("end") + POST).alias("high"))
    j = intervals.range_join(bridge.alarms(spark, d), i, KEY, "t", "low", "high", 12 * HOUR, "left")
    first = j.groupBy("user_id", "event_id", "t").agg(F.min(F.struct(F.col("seizure").isNull().alias("o"), "seizure", "start", "end")).alias("f"))
    inside = F.col("t").between(F.col("f.start"), F.col("f.end"))
    ratio = F.when(F.col("f.seizure").isNull(), 0.0).when(inside, 1.0).otherwise(0.8)
    return first.select("user_id", "event_id", F.coalesce("f.seizure", F.lit(0)).alias("seizure"), ratio.alias("overlap_ratio"), F.coalesce(F.abs(F.col("t") - F.col("f.start")), F.lit(-1)).alias("distance"))


@query("SELECT user_id, has_event, row_number() OVER (ORDER BY has_event DESC, user_id) AS place FROM (SELECT user_id, bool_or(event_type = 'error') AS has_event FROM ev GROUP BY user_id)")
def work_order(spark: SparkSession, d: str) -> DataFrame:
    """Recordings with events first; a row a recording."""
    g = bridge.events(spark, d).groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("has_event"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("has_event"), "user_id")).cast("long"))


@query("""WITH x AS (SELECT vec_id, vec_id % 9 AS k FROM embeddings)
SELECT vec_id, CASE k WHEN 0 THEN 'window_size and stride' WHEN 1 THEN 'several windows' WHEN 2 THEN 'flexible_windowing' WHEN 3 THEN 'window parameter' WHEN 4 THEN 'window times' WHEN 5 THEN 'flexible window' WHEN 6 THEN 'n_windows' WHEN 7 THEN 'duration' END AS method FROM x""", shared=False)
def windowed_probe(spark: SparkSession, d: str) -> DataFrame:
    """By what sign a recording is known to be windowed, for one of each kind."""
    k, text = F.col("vec_id") % 9, "map<string,string>"
    none = F.expr(f"cast(map() as {text})")
    one = F.transform(F.sequence(F.lit(1), F.when(k == 7, 64 * 60 * 2).otherwise(64)), lambda x: x.cast("double"))
    params = F.when(k == 0, F.create_map(F.lit("window_size"), F.lit("10"), F.lit("stride"), F.lit("5"))).when(k == 2, F.create_map(F.lit("flexible_windowing"), F.lit("true"))).when(k == 3, F.create_map(F.lit("overlap"), F.lit("0.5"))).otherwise(none)
    meta = F.when(k == 4, F.create_map(F.lit("start_time"), F.lit("0"), F.lit("end_time"), F.lit("10"))).when(k == 5, F.create_map(F.lit("is_flexible_window"), F.lit("true"))).otherwise(none)
    docs = table(spark, d, "embeddings").select(
        "vec_id", F.when(k == 1, F.array(one, one)).otherwise(F.array(one)).alias("windows"), params.alias("preprocessing_params"), F.array(meta).alias("metadata"),
        F.when(k == 6, F.lit(1)).alias("n_windows"), F.lit(64.0).alias("processed_fs"),
    )
    return docs.select("vec_id", readers.windowed_method().alias("method"))


_STATE = """sz AS (SELECT user_id, sum(octet_length(encode(coalesce(props, '')))) AS bytes, count(*) FILTER (event_type = 'error') AS events, max(t) AS until FROM ev GROUP BY user_id),
tc AS (SELECT tr.user_id, count(*) AS truncated FROM tr JOIN sz ON tr.user_id = sz.user_id WHERE tr."end" > sz.until GROUP BY tr.user_id),
fl AS (SELECT sz.user_id, bytes, events, coalesce(truncated, 0) AS truncated, bytes <= 1000 AS small, events = 0 AS orphan FROM sz LEFT JOIN tc ON sz.user_id = tc.user_id)"""


def _state(spark: SparkSession, d: str) -> DataFrame:
    e = bridge.events(spark, d)
    s = e.groupBy("user_id").agg(F.sum(F.octet_length(F.coalesce("props", F.lit(""))).cast("long")).alias("bytes"), F.sum((F.col("event_type") == "error").cast("long")).alias("events"), F.max("t").alias("until"))
    cut = bridge.truth(spark, d).join(s, "user_id").where("end > until").groupBy("user_id").agg(F.count("*").alias("truncated"))
    return s.join(cut, "user_id", "left").select("user_id", "bytes", "events", F.coalesce("truncated", F.lit(0).cast("long")).alias("truncated"), (F.col("bytes") <= 1000).alias("small"), (F.col("events") == 0).alias("orphan"))


@query(f"""WITH {_STATE} SELECT user_id, CAST(bytes AS BIGINT) AS bytes, CASE WHEN small THEN 'small' WHEN orphan THEN 'orphan' WHEN truncated > 0 THEN 'truncated' ELSE 'usable' END AS verdict FROM fl""")
def run_verdict(spark: SparkSession, d: str) -> DataFrame:
    """One verdict a recording: large enough, with annotations, and none of them cut off."""
    verdict = F.when(F.col("small"), "small").when(F.col("orphan"), "orphan").when(F.col("truncated") > 0, "truncated").otherwise("usable")
    return _state(spark, d).select("user_id", "bytes", verdict.alias("verdict"))


@query(f"""WITH {_STATE}, p AS (
  SELECT user_id, 'small' AS problem, 'CRITICAL' AS severity FROM fl WHERE small UNION ALL SELECT user_id, 'orphan', 'CRITICAL' FROM fl WHERE orphan
  UNION ALL SELECT user_id, 'truncated', CASE WHEN truncated = events THEN 'CRITICAL' ELSE 'WARNING' END FROM fl WHERE truncated > 0
  UNION ALL SELECT user_id, 'short', 'WARNING' FROM ev GROUP BY user_id HAVING count(*) < 60)
SELECT user_id, problem, severity, count(*) OVER (PARTITION BY severity) AS of_severity FROM p""")
def problem_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every problem of every recording with its severity, and how many there are of that severity."""
    n = bridge.events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    s = _state(spark, d).join(n, "user_id")
    row = lambda on, name, how: F.when(on, F.struct(F.lit(name).alias("problem"), how.alias("severity")))
    kinds = F.array(
        row(F.col("small"), "small", F.lit("CRITICAL")), row(F.col("orphan"), "orphan", F.lit("CRITICAL")),
        row(F.col("truncated") > 0, "truncated", F.when(F.col("truncated") == F.col("events"), "CRITICAL").otherwise("WARNING")), row(F.col("n") < 60, "short", F.lit("WARNING")),
    )
    p = s.select("user_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("p")).select("user_id", "p.problem", "p.severity")
    counts = p.groupBy("severity").agg(F.count("*").alias("of_severity"))  # a row a severity
    return p.join(counts, "severity").select("user_id", "problem", "severity", "of_severity")


@query("""WITH v AS (SELECT vec_id, list_transform(range(0, 8), lambda j: list_avg(list_transform(embedding[j * 8 + 1:j * 8 + 8], lambda x: CAST(x AS DOUBLE)))) AS m FROM embeddings),
p AS (SELECT vec_id, m, unnest(range(0, 64)) AS i FROM v), q AS (SELECT *, greatest(0, (i + 0.5) * CAST(8 AS DOUBLE) / 64 - 0.5) AS s FROM p)
SELECT vec_id, CAST(i AS BIGINT) AS i, round(m[CAST(floor(s) AS INT) + 1] * (1 - (s - floor(s))) + m[CAST(least(7, floor(s) + 1) AS INT) + 1] * (s - floor(s)), 6) AS score FROM q""", shared=False)
def latent_linear(spark: SparkSession, d: str) -> DataFrame:
    """Latent scores, one for eight samples, up-sampled by linear interpolation between the middles of their stretches."""
    v = F.col("values")
    latent = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.aggregate(F.slice(v, j * 8 + 1, 8), F.lit(0.0), lambda a, x: a + x) / 8)
    return _vectors(spark, d).select("vec_id", F.posexplode(dsp.upsampled(latent, 8, 64)).alias("i", "score")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("score", 6).alias("score"))


@query(f"""WITH {_VEC}, fr AS (SELECT vec_id, v, unnest(range(0, 33)) AS frame FROM ve), sm AS (SELECT vec_id, frame, unnest(range(0, 8)) AS i, v FROM fr),
px AS (SELECT vec_id, frame, i, frame * 2 + i - 4 AS p, v FROM sm), pv AS (SELECT vec_id, frame, i, v[CAST(CASE WHEN p < 0 THEN -p WHEN p > 63 THEN 126 - p ELSE p END AS INT) + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 8)) AS x FROM px),
k AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS bin)
SELECT vec_id, CAST(frame AS INTEGER) AS frame, bin, round(sum(x * cos(2 * pi() * i * bin / 8)) / sqrt(8), 6) + 0.0 AS re, round(-sum(x * sin(2 * pi() * i * bin / 8)) / sqrt(8), 6) + 0.0 AS im FROM pv, k GROUP BY vec_id, frame, bin""", shared=False)
def spectrogram(spark: SparkSession, d: str) -> DataFrame:
    """Short-time Fourier transforms with windows of eight samples."""
    return dsp.spectrogram(_vectors(spark, d), ["vec_id"], 8).withColumns({c: F.round(c, 6) + 0.0 for c in ("re", "im")})


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM se GROUP BY user_id), w AS (SELECT user_id, unnest(range(0, CASE WHEN n >= 10 THEN (n - 10) // 5 + 1 ELSE 0 END)) AS k FROM n),
c AS (SELECT w.user_id, k FROM w JOIN se s ON s.user_id = w.user_id AND s.idx >= k * 5 AND s.idx < k * 5 + 10 GROUP BY ALL HAVING count(*) FILTER (event_type = 'error') = 0)
SELECT user_id, k AS window_index, k * 5 AS "start", (row_number() OVER (PARTITION BY user_id ORDER BY k) - 1) // 4 AS batch FROM c""")
def clean_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows that hold no excluded row, in mini-batches of four."""
    return sequence.clean_windows(bridge.series(spark, d), KEY, "idx", F.col("event_type") == "error", 10, 5, 4)


@query(f"""WITH {_lengths_sql(_LENGTHS, SPLIT)}, hi AS (SELECT user_id, pos AS hint FROM ld WHERE m = 8),
hp AS (SELECT lw.user_id, lw.m, lw.pos, min(sqrt(greatest(0, 2 * lw.m * (1 - (list_dot_product(lw.w, b.w) - lw.m * lw.mu * b.mu) / (lw.m * lw.sd * b.sd))))) / (2 * sqrt(lw.m)) AS score
  FROM lw JOIN hi ON lw.user_id = hi.user_id AND lw.pos = hi.hint JOIN lw b ON b.user_id = lw.user_id AND b.m = lw.m AND b.pos <= lw.pos - lw.m WHERE lw.pos >= lw.m GROUP BY lw.user_id, lw.m, lw.pos)
SELECT ld.user_id, CAST(ld.m AS INTEGER) AS m, round(greatest(ld.score, coalesce(hp.score, 0)), 5) AS score, CAST(CASE WHEN hp.score > ld.score + 1e-9 THEN hp.pos ELSE ld.pos END AS BIGINT) AS pos
FROM ld LEFT JOIN hp ON ld.user_id = hp.user_id AND ld.m = hp.m""")
def hinted_discords(spark: SparkSession, d: str) -> DataFrame:
    """Discords of several lengths with the middle length's position as a hint for the others."""
    s = _series(spark, d)
    found = profile.left_discords(s, KEY, _LENGTHS, SPLIT)
    return profile.hinted(s, found, KEY, 8).withColumn("score", F.round("score", 5))
