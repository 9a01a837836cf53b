"""Further queries: window- and file-level metrics, named strategies, feature windows, joint scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import clusters, dsp, metrics, profile, sequence
from ..sources import bridge
from ..sources.bridge import HOUR, POST, PRE, table
from .alarm_queries import _counts, _match_sql
from .registry import query
from .signal_queries import _lengths_sql

KEY = ["user_id"]


def _w() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("idx")


_TW = "tw AS (SELECT *, idx // 20 AS k FROM se)"


def _tumbling(spark: SparkSession, d: str) -> DataFrame:
    return bridge.series(spark, d).withColumn("k", F.floor(F.col("idx") / 20).cast("long")).withColumn("hit", F.col("value") > 90).withColumn("label", (F.col("event_type") == "error").cast("long"))


@query(f"""WITH {_TW}, w AS (SELECT user_id, k, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS lab, sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS hits FROM tw GROUP BY ALL)
SELECT CAST(sum(lab) AS BIGINT) AS labelled_windows, CAST(sum(lab * hits) AS BIGINT) AS tp, CAST(sum((1 - lab) * hits) AS BIGINT) AS fp, CAST(sum(CASE WHEN lab = 1 AND hits > 0 THEN 1 ELSE 0 END) AS BIGINT) AS windows_hit,
  round(CAST(sum(lab * hits) AS DOUBLE) / nullif(sum(lab), 0), 6) AS raw_ratio, round(CAST(sum(CASE WHEN lab = 1 AND hits > 0 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(lab), 0), 6) AS window_rate FROM w""")
def window_level_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every alarm in a labelled window is a hit, so the raw ratio can exceed 1; the share of windows hit cannot."""
    w = _tumbling(spark, d).groupBy("user_id", "k").agg(F.max("label").alias("lab"), F.sum(F.col("hit").cast("long")).alias("hits"))
    on = (F.col("lab") == 1) & (F.col("hits") > 0)
    g = w.agg(F.sum("lab").alias("labelled_windows"), F.sum(F.col("lab") * F.col("hits")).alias("tp"), F.sum((1 - F.col("lab")) * F.col("hits")).alias("fp"), F.sum(on.cast("long")).alias("windows_hit"))
    return g.withColumn("raw_ratio", F.round(metrics.ratio(F.col("tp"), F.col("labelled_windows")), 6)).withColumn("window_rate", F.round(metrics.ratio(F.col("windows_hit"), F.col("labelled_windows")), 6))


@query(f"""WITH {_match_sql('al')} SELECT count(*) AS files, CAST(sum(CASE WHEN detected = n_truth THEN 1 ELSE 0 END) AS BIGINT) AS complete, round(avg(CASE WHEN detected = n_truth THEN 1.0 ELSE 0.0 END), 6) AS file_sensitivity,
  round(CAST(sum(detected) AS DOUBLE) / sum(n_truth), 6) AS event_sensitivity FROM co WHERE n_truth > 0""")
def file_level_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Share of series with events all of which are found, beside the share of events."""
    c = _counts(spark, d, bridge.alarms(spark, d)).where("n_truth > 0")
    all_found = (F.col("detected") == F.col("n_truth")).cast("long")
    return c.agg(F.count("*").alias("files"), F.sum(all_found).alias("complete"), F.round(F.avg(all_found), 6).alias("file_sensitivity"), F.round(F.sum("detected") / F.sum("n_truth"), 6).alias("event_sensitivity"))


@query("""WITH c AS (SELECT user_id, avg(CASE WHEN event_type <> 'error' AND value > 90 THEN 1.0 ELSE 0.0 END) / nullif(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 0) AS fpr,
  CAST(count(*) FILTER (event_type = 'error' AND value > 90) AS DOUBLE) / nullif(count(*) FILTER (event_type = 'error'), 0) AS sens FROM se GROUP BY user_id)
SELECT count(*) AS n, round(avg(1 - fpr), 6) AS mean_specificity, round(stddev_samp(1 - fpr), 6) AS std_specificity, round(avg(sens), 6) AS mean_sensitivity, round(stddev_samp(sens), 6) AS std_sensitivity FROM c""")
def batch_configuration_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Specificity is one less the share of normal rows that are flagged; mean and deviation over series."""
    s = _tumbling(spark, d)
    normal, hit = F.col("label") == 0, F.col("hit")
    c = s.groupBy("user_id").agg(F.sum((normal & hit).cast("long")).alias("fp"), F.sum(normal.cast("long")).alias("n0"), F.sum((~normal & hit).cast("long")).alias("tp"), F.sum("label").alias("n1"))
    c = c.select((1 - metrics.ratio(F.col("fp"), F.col("n0"))).alias("spec"), metrics.ratio(F.col("tp"), F.col("n1")).alias("sens"))
    return c.agg(F.count("*").alias("n"), F.round(F.avg("spec"), 6).alias("mean_specificity"), F.round(F.stddev_samp("spec"), 6).alias("std_specificity"), F.round(F.avg("sens"), 6).alias("mean_sensitivity"), F.round(F.stddev_samp("sens"), 6).alias("std_sensitivity"))


_MS = [2, 3, 5, 8]


@query(f"""WITH m AS (SELECT unnest({_MS}) AS m), r AS (SELECT m, user_id, idx, event_type, (SELECT 1) AS one FROM se, m),
a AS (SELECT m.m, s.user_id, s.idx, s.event_type, rank() OVER (PARTITION BY m.m, s.user_id, s.idx // m.m ORDER BY s.value DESC, s.idx) = 1 AS top FROM se s, m),
u AS (SELECT m, user_id, CAST(count(*) FILTER (event_type = 'error' AND top) AS DOUBLE) / nullif(count(*) FILTER (event_type = 'error'), 0) AS sens FROM a GROUP BY ALL)
SELECT CAST(m AS BIGINT) AS m, round(avg(sens), 6) AS mean, round(stddev_samp(sens), 6) AS std, round(max(sens), 6) AS high, round(min(sens), 6) AS low, round(avg(sens), 6) = max(round(avg(sens), 6)) OVER () AS best FROM u GROUP BY m""")
def length_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Sensitivity of the largest value of each stretch of m rows, for several m, and the best m."""
    s = bridge.series(spark, d).select("*", F.explode(F.array(*[F.lit(m).cast("long") for m in _MS])).alias("m")).withColumn("stretch", F.floor(F.col("idx") / F.col("m")).cast("long"))
    s = s.withColumn("top", F.row_number().over(Window.partitionBy("m", "user_id", "stretch").orderBy(F.desc("value"), "idx")) == 1)
    e = F.col("event_type") == "error"
    u = s.groupBy("m", "user_id").agg(F.sum((e & F.col("top")).cast("long")).alias("a"), F.sum(e.cast("long")).alias("b")).select("m", metrics.ratio(F.col("a"), F.col("b")).alias("sens"))
    g = u.groupBy("m").agg(F.round(F.avg("sens"), 6).alias("mean"), F.round(F.stddev_samp("sens"), 6).alias("std"), F.round(F.max("sens"), 6).alias("high"), F.round(F.min("sens"), 6).alias("low"))
    return g.withColumn("best", F.col("mean") == F.max("mean").over(Window.partitionBy(F.lit(1))))


@query("""WITH p AS (SELECT user_id, idx, value, event_type FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM se WINDOW w AS (PARTITION BY user_id ORDER BY idx)) WHERE value > a AND value >= b),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, idx) AS r FROM p),
k AS (SELECT unnest([1, 3, 5]) AS k),
h AS (SELECT k, s.user_id, max(CASE WHEN EXISTS (SELECT 1 FROM se e WHERE e.user_id = s.user_id AND e.event_type = 'error' AND abs(e.idx - s.idx) <= 2) THEN 1 ELSE 0 END) AS ok FROM r s, k WHERE s.r <= k GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, count(*) AS series, round(avg(ok), 6) AS accuracy FROM h GROUP BY k""")
def topk_peak_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of series in which one of the k largest local maxima stands within two rows of an event."""
    e = (F.col("event_type") == "error").cast("int")
    s = bridge.series(spark, d).withColumn("near", sequence.pad(e, _w(), 2, 2)).withColumn("peak", (F.col("value") > F.lag("value").over(_w())) & (F.col("value") >= F.lead("value").over(_w())))
    r = s.where("peak").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "idx"))).where("r <= 5")
    k = r.select("user_id", "near", "r", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k")).where("r <= k")
    return k.groupBy("k", "user_id").agg(F.max("near").alias("ok")).groupBy("k").agg(F.count("*").alias("series"), F.round(F.avg("ok"), 6).alias("accuracy"))


@query("""SELECT user_id FROM ev WHERE event_type IN ('click', 'view', 'error') AND value > 100 GROUP BY user_id HAVING count(DISTINCT event_type) = 3""")
def completed_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Series for which all wanted settings are done."""
    done = bridge.events(spark, d).where("value > 100").groupBy("user_id").agg(F.collect_set("event_type").alias("done"))
    return done.where(F.size(F.array_except(F.array(F.lit("click"), F.lit("view"), F.lit("error")), "done")) == 0).select("user_id")


_NAMES = ["time_7200s", "fine_time_21600s", "extended_time_86400s"]


@query(f"""WITH n AS (SELECT unnest({_NAMES}) AS strategy), t AS (SELECT strategy, CAST(regexp_extract(strategy, '(\\d+)s$', 1) AS BIGINT) * 1000000 AS theta FROM n),
c AS (SELECT strategy, user_id, CASE WHEN t - lag(t) OVER (PARTITION BY strategy, user_id ORDER BY t, event_id) <= theta THEN 0 ELSE 1 END AS nw FROM al, t)
SELECT strategy, CAST(sum(nw) AS BIGINT) AS clusters, count(*) AS alarms FROM c GROUP BY strategy""")
def named_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Strategies by name: the gap is read from it."""
    names = F.explode(F.array(*[F.lit(n) for n in _NAMES])).alias("strategy")
    a = bridge.alarms(spark, d).select("*", names).withColumn("theta", F.regexp_extract("strategy", r"(\d+)s$", 1).cast("long") * 1_000_000)
    c = clusters.by_gap(a, ["strategy", "user_id"], "t", F.col("theta"), "event_id")
    return c.groupBy("strategy", "user_id").agg(F.countDistinct("cluster").alias("c"), F.count("*").alias("n")).groupBy("strategy").agg(F.sum("c").alias("clusters"), F.sum("n").alias("alarms"))


@query("""WITH b AS (SELECT user_id, idx, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY idx) AS dv FROM se), ln AS (SELECT user_id, count(*) AS n FROM se GROUP BY user_id),
w AS (SELECT b.*, k FROM b JOIN ln ON ln.user_id = b.user_id, LATERAL (SELECT unnest(range(0, CASE WHEN n >= 20 THEN (n - 20) // 10 + 1 ELSE 0 END)) AS k) WHERE idx >= k * 10 AND idx < k * 10 + 20)
SELECT user_id, CAST(k AS BIGINT) AS window_index, round(avg(value), 5) AS mean_nn, round(stddev_samp(value), 5) AS sdnn, round(sqrt(avg(dv * dv) FILTER (idx > k * 10)), 5) AS rmssd, round(avg(CASE WHEN abs(dv) > 50 THEN 1.0 ELSE 0.0 END) FILTER (idx > k * 10), 6) AS pnn50 FROM w GROUP BY ALL""")
def hrv_windows(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation, root mean square of steps and share of large steps over sliding windows of values."""
    s = bridge.series(spark, d).withColumn("dv", sequence.difference(F.col("value"), _w())).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    w = sequence.in_windows(s, KEY, "idx", 20, 10).where("window_index * 10 + 20 <= n")
    inner = F.col("idx") > F.col("window_index") * 10
    return w.groupBy("user_id", "window_index").agg(
        F.round(F.avg("value"), 5).alias("mean_nn"), F.round(F.stddev_samp("value"), 5).alias("sdnn"), F.round(F.sqrt(F.avg(F.when(inner, F.col("dv") * F.col("dv")))), 5).alias("rmssd"),
        F.round(F.avg(F.when(inner, (F.abs("dv") > 50).cast("double"))), 6).alias("pnn50"),
    )


@query("""WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings), b AS (
  SELECT vec_id, i, CAST(x AS DOUBLE) AS x, avg(CAST(x AS DOUBLE)) OVER (PARTITION BY vec_id, i // 8) AS m8, avg(CAST(x AS DOUBLE)) OVER (PARTITION BY vec_id, i // 16) AS m16 FROM v),
j AS (SELECT vec_id, i, (m8 + m16) / 2 AS s FROM b), k AS (SELECT vec_id, i, s, avg(s) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS sm FROM j)
SELECT vec_id, CAST(i AS BIGINT) AS i, round((s + sm) / 2, 6) AS joint FROM k""", shared=False)
def joint_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two latent rates, up-sampled to the rows they stand for, averaged, smoothed, and averaged with that."""
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    up = [F.avg("x").over(Window.partitionBy("vec_id", F.floor(F.col("i") / n))) for n in (8, 16)]
    s = v.withColumn("s", (up[0] + up[1]) / 2)
    smooth = F.avg("s").over(Window.partitionBy("vec_id").orderBy("i").rowsBetween(-4, 3))
    return s.select("vec_id", F.col("i").cast("long").alias("i"), F.round((F.col("s") + smooth) / 2, 6).alias("joint"))


@query("""SELECT CAST(w AS BIGINT) AS w, CAST(CASE WHEN floor(w * CAST(0.3 AS DOUBLE)) = 0 THEN 1 WHEN floor(w * CAST(0.3 AS DOUBLE)) % 2 <> 0 THEN floor(w * CAST(0.3 AS DOUBLE)) WHEN ceil(w * CAST(0.3 AS DOUBLE)) % 2 <> 0 THEN ceil(w * CAST(0.3 AS DOUBLE)) ELSE floor(w * CAST(0.3 AS DOUBLE)) + 1 END AS BIGINT) AS latent
FROM (SELECT DISTINCT p_size AS w FROM part WHERE p_size IS NOT NULL)""", shared=False)
def latent_windows(spark: SparkSession, d: str) -> DataFrame:
    """Odd widths of windows in latent cells, for every width in the table."""
    w = table(spark, d, "part").where("p_size IS NOT NULL").select(F.col("p_size").cast("long").alias("w")).distinct()
    return w.select("w", scalars.latent_window(F.col("w").cast("double"), 0.3).alias("latent"))


@query(f"""SELECT a.user_id, a.event_id, k.k AS window_index, row_number() OVER (PARTITION BY a.user_id, a.event_id ORDER BY k.k) = 1 AS most_likely FROM (SELECT * FROM se WHERE value >= 150) a,
LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((a.idx - 19) / CAST(10 AS DOUBLE)) AS BIGINT)), a.idx // 10 + 1)) AS k) k""")
def candidate_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows in which an alarm found in the whole series may stand; the first is the most likely."""
    a = sequence.in_windows(bridge.series(spark, d).where("value >= 150"), KEY, "idx", 20, 10)
    first = F.row_number().over(Window.partitionBy("user_id", "event_id").orderBy("window_index")) == 1
    return a.select("user_id", "event_id", "window_index", first.alias("most_likely"))


_PARTS = """pt AS (SELECT l_suppkey, (row_number() OVER w - 1) // 150 AS k, (row_number() OVER w - 1) % 150 AS idx, CAST(l_quantity AS DOUBLE) AS value FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice))"""


@query(f"""WITH {_PARTS}, {_lengths_sql([8, 16], 30, "pt", "l_suppkey, k")}, n AS (SELECT l_suppkey, k, count(*) AS n FROM pt GROUP BY ALL)
SELECT l_suppkey, k, CAST(m AS INTEGER) AS m, round(score, 5) AS score, CAST(pos AS BIGINT) AS pos FROM ld UNION ALL SELECT l_suppkey, k, 0, 0.0, -1 FROM n WHERE n < 16""")
def windowed_discords(spark: SparkSession, d: str) -> DataFrame:
    """The individual-window strategy: each window of a long series is searched by itself, the shorter last ones too, with the
    lengths that fit; a window too short for any has length 0 and position -1."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    s = table(spark, d, "lineitem").select("l_suppkey", (F.row_number().over(w).cast("long") - 1).alias("idx"), F.col("l_quantity").alias("v"))
    s = s.select("l_suppkey", F.floor(F.col("idx") / 150).cast("long").alias("k"), (F.col("idx") % 150).alias("pos"), F.col("v").cast("double").alias("v"))
    found = profile.left_discords(s, ["l_suppkey", "k"], [8, 16], 30).withColumn("score", F.round("score", 5))
    short = s.groupBy("l_suppkey", "k").count().where("count < 16").select("l_suppkey", "k", F.lit(0).alias("m"), F.lit(0.0).alias("score"), F.lit(-1).cast("long").alias("pos"))
    return found.select("l_suppkey", "k", "m", "score", "pos").unionByName(short)


@query(f"""WITH {_match_sql('al', 0, 0)}, a AS (SELECT 'strict' AS margin, sum(detected) AS d, sum(n_truth) AS n, sum(fp) AS fp FROM co),
m2 AS (SELECT a.user_id, a.event_id, min(i.seizure) AS s FROM al a LEFT JOIN tr i ON a.user_id = i.user_id AND a.t BETWEEN i."start" - {PRE} AND i."end" + {POST} GROUP BY ALL),
b AS (SELECT 'wide' AS margin, (SELECT count(*) FROM (SELECT DISTINCT user_id, s FROM m2 WHERE s IS NOT NULL)) AS d, (SELECT count(*) FROM tr) AS n, (SELECT count(*) FROM m2 WHERE s IS NULL) AS fp)
SELECT margin, CAST(d AS BIGINT) AS detected, CAST(fp AS BIGINT) AS fp, round(CAST(d AS DOUBLE) / n, 6) AS sensitivity FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def margins_compared(spark: SparkSession, d: str) -> DataFrame:
    """The same alarms against strict and against extended intervals."""
    out = None
    for name, pre, post in (("strict", 0, 0), ("wide", PRE, POST)):
        p = metrics.pooled(_counts(spark, d, bridge.alarms(spark, d), pre, post)).select(F.lit(name).alias("margin"), "detected", "fp", F.round("sensitivity", 6).alias("sensitivity"))
        out = p if out is None else out.unionByName(p)
    return out


@query(f"""WITH a AS (SELECT user_id, t, event_id, score, score - lag(score) OVER (PARTITION BY user_id ORDER BY t, event_id) AS ds FROM al)
SELECT user_id, event_id, round(score * 1.0, 4) AS score, t // {HOUR} AS hour, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) AS in_last_day FROM a""")
def alarm_density(spark: SparkSession, d: str) -> DataFrame:
    """Alarms of the last day at each alarm."""
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-24 * HOUR, 0)
    return bridge.alarms(spark, d).select("user_id", "event_id", F.round("score", 4).alias("score"), F.floor(F.col("t") / HOUR).cast("long").alias("hour"), F.count("*").over(w).alias("in_last_day"))


@query()
def decimated_beats(spark: SparkSession, d: str) -> DataFrame:
    """Beats after the band-pass, from the long series."""
    g = profile.gather(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], "l_extendedprice")
    y = dsp.filtered(g, ["l_suppkey"], 64.0, 1.0, 20.0)
    return dsp.beats(profile.gather(y, ["l_suppkey"], ["pos"], "v"), ["l_suppkey"], 64.0)
