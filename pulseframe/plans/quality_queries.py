"""Queries over signal quality, completeness, annotation statistics and taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics, quality
from ..sources import bridge, readers, sinks
from ..sources.bridge import table
from .registry import query

SUP = ["l_suppkey"]
_LI = "li AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx, l_quantity AS q, l_extendedprice AS v FROM lineitem)"


def _long(spark: SparkSession, d: str) -> DataFrame:
    """A long series for each supplier."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_suppkey", (F.row_number().over(w).cast("long") - 1).alias("idx"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("v"))


_SEG = f"""{_LI}, sg AS (
  SELECT l_suppkey, idx // 50 AS segment, count(*) AS n, count(DISTINCT q) AS n_distinct, max(q) - min(q) AS spread, avg(CASE WHEN q <= 1 OR q >= 50 THEN 1.0 ELSE 0.0 END) AS at_limit FROM li GROUP BY ALL),
sb AS (SELECT *, n_distinct < 10 OR spread < 0.001 OR at_limit > 0.05 AS bad FROM sg),
sr AS (SELECT l_suppkey, count(*) AS segments, CAST(sum(CAST(bad AS INT)) AS BIGINT) AS bad_segments, CAST(100 AS DOUBLE) * sum(CAST(bad AS INT)) / count(*) AS percent FROM sb GROUP BY l_suppkey)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return quality.saturation_segments(_long(spark, d), SUP, "idx", "q", 50, F.lit(1.0), F.lit(50.0))


@query(f"WITH {_SEG} SELECT l_suppkey, segment, n, n_distinct, spread, round(at_limit, 6) AS at_limit, bad FROM sb")
def saturation_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).withColumn("at_limit", F.round("at_limit", 6))


def _saturation(spark: SparkSession, d: str) -> DataFrame:
    return quality.saturation(_segments(spark, d), SUP)


@query(f"WITH {_SEG} SELECT l_suppkey, segments, bad_segments, round(percent, 6) AS percent FROM sr WHERE percent >= 10 AND l_suppkey % 125 + 1 BETWEEN 1 AND 96")
def saturated_runs(spark: SparkSession, d: str) -> DataFrame:
    r = _saturation(spark, d).where((F.col("percent") >= 10) & (F.col("l_suppkey") % 125 + 1).between(1, 96))
    return r.withColumn("percent", F.round("percent", 6))


@query(f"WITH {_SEG} SELECT l_suppkey, segments, bad_segments, round(percent, 6) AS percent FROM sr WHERE percent >= 10 AND l_suppkey % 125 + 1 BETWEEN 97 AND 125")
def saturated_test_runs(spark: SparkSession, d: str) -> DataFrame:
    """Saturated runs of the test subjects; saturated_runs has those of the training subjects."""
    r = _saturation(spark, d).where((F.col("percent") >= 10) & (F.col("l_suppkey") % 125 + 1).between(97, 125))
    return r.withColumn("percent", F.round("percent", 6))


_LEVELS = [0.0, 5.0, 10.0, 20.0, 30.0, 40.0, 50.0, 75.0, 100.0]
_LEVEL_SQL = ", ".join(f"CAST({x} AS DOUBLE)" for x in _LEVELS)


@query(f"""WITH {_SEG}, th AS (SELECT unnest([{_LEVEL_SQL}]) AS threshold)
SELECT threshold, count(*) AS runs, CAST(sum(CASE WHEN percent >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS excluded, round(avg(CASE WHEN percent >= threshold THEN 1.0 ELSE 0.0 END), 6) AS share FROM sr, th GROUP BY threshold""")
def saturation_curve(spark: SparkSession, d: str) -> DataFrame:
    return quality.exclusion_curve(_saturation(spark, d), "percent", _LEVELS).withColumn("share", F.round("share", 6))


@query(f"""WITH {_SEG}, th AS (SELECT unnest([{_LEVEL_SQL}]) AS threshold),
rt AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey),
j AS (SELECT threshold, sr.l_suppkey % 25 AS subject, sr.l_suppkey, percent >= threshold AS out, coalesce(n, 0) AS n FROM sr LEFT JOIN rt ON sr.l_suppkey = rt.l_suppkey, th),
s AS (SELECT threshold, subject, sum(n) AS n, sum(CASE WHEN out THEN n ELSE 0 END) AS lost FROM j GROUP BY ALL)
SELECT threshold, CAST(sum(n) AS BIGINT) AS events, CAST(sum(lost) AS BIGINT) AS lost, CAST(sum(CASE WHEN n > 0 AND lost = n THEN 1 ELSE 0 END) AS BIGINT) AS subjects_losing_all FROM s GROUP BY threshold""")
def loss_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Events lost with the runs that each threshold excludes, and subjects that lose all."""
    returns = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    r = _saturation(spark, d).join(returns, SUP, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    j = r.select((F.col("l_suppkey") % 25).alias("subject"), "percent", "n", F.explode(F.array(*[F.lit(x) for x in _LEVELS])).alias("threshold"))
    s = j.groupBy("threshold", "subject").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("percent") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("lost"))
    return s.groupBy("threshold").agg(F.sum("n").alias("events"), F.sum("lost").alias("lost"), F.sum(((F.col("n") > 0) & (F.col("lost") == F.col("n"))).cast("long")).alias("subjects_losing_all"))


@query(f"""WITH {_LI}, g AS (SELECT l_suppkey, count(*) AS n, avg(CASE WHEN q = 0 THEN 1.0 ELSE 0.0 END) AS zero, avg(CASE WHEN q >= 45 THEN 1.0 ELSE 0.0 END) AS saturated FROM li WHERE idx < 200 GROUP BY l_suppkey)
SELECT l_suppkey, n, round(zero, 6) AS zero, round(saturated, 6) AS saturated, round(1 - zero - saturated, 6) AS usable, CASE WHEN 1 - zero - saturated >= 0.9 THEN 'good' WHEN 1 - zero - saturated > 0.1 THEN 'partial' ELSE 'empty' END AS quality FROM g""")
def channel_quality(spark: SparkSession, d: str) -> DataFrame:
    c = quality.channel_quality(_long(spark, d), SUP, "idx", "q", 200, 45.0)
    return c.select("l_suppkey", "n", *[F.round(x, 6).alias(x) for x in ("zero", "saturated", "usable")], "quality")


_CONST = f"""{_LI}, k0 AS (SELECT *, abs(q - lag(q) OVER (PARTITION BY l_suppkey ORDER BY idx)) < 2 AS b FROM li),
k1 AS (SELECT *, CASE WHEN b AND NOT coalesce(lag(b) OVER (PARTITION BY l_suppkey ORDER BY idx), false) THEN 1 ELSE 0 END AS nw FROM k0),
k2 AS (SELECT *, sum(nw) OVER (PARTITION BY l_suppkey ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM k1),
kr AS (SELECT l_suppkey, min(idx) - 1 AS first, max(idx) AS last, count(*) + 1 AS n FROM k2 WHERE b GROUP BY l_suppkey, g HAVING count(*) + 1 >= 3)"""


@query(f"WITH {_CONST} SELECT * FROM kr")
def constant_regions(spark: SparkSession, d: str) -> DataFrame:
    return quality.constant_regions(_long(spark, d), SUP, "idx", "q", 2.0, 3)


@query(f"""WITH {_CONST}, v AS (SELECT l_suppkey, var_pop(q) AS variance, max(CASE WHEN b THEN 1 ELSE 0 END) AS pair FROM k0 GROUP BY l_suppkey), r AS (SELECT l_suppkey, count(*) AS regions FROM kr GROUP BY l_suppkey)
SELECT v.l_suppkey, round(variance, 4) AS variance, pair, coalesce(regions, 0) AS regions, coalesce(regions, 0) > 0 OR (pair = 1 AND variance < 200) AS constant FROM v LEFT JOIN r ON v.l_suppkey = r.l_suppkey""")
def has_constant(spark: SparkSession, d: str) -> DataFrame:
    return quality.has_constant(_long(spark, d), SUP, "idx", "q", 2.0, 3, 200.0).withColumn("variance", F.round("variance", 4))


@query(f"""WITH {_CONST} SELECT li.l_suppkey, li.idx AS old_position, row_number() OVER (PARTITION BY li.l_suppkey ORDER BY li.idx) - 1 AS new_position, li.q
FROM li WHERE NOT EXISTS (SELECT 1 FROM kr WHERE kr.l_suppkey = li.l_suppkey AND li.idx BETWEEN kr.first AND kr.last)""")
def remove_constant(spark: SparkSession, d: str) -> DataFrame:
    s = _long(spark, d)
    r = quality.without_regions(s, quality.constant_regions(s, SUP, "idx", "q", 2.0, 3), SUP, "idx")
    return r.select("l_suppkey", F.col("idx").alias("old_position"), "new_position", "q")


@query(f"""WITH {_LI}, m AS (SELECT *, var_pop(q) OVER (PARTITION BY l_suppkey ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS mv, count(*) OVER (PARTITION BY l_suppkey) AS n FROM li)
SELECT l_suppkey, idx, round(mv, 4) AS mv, round(mv, 4) < 60 AS flat FROM m WHERE idx <= n - 10""")
def moving_variance_flags(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("idx").rowsBetween(0, 9)
    s = _long(spark, d).withColumn("mv", F.round(F.var_pop("q").over(w), 4)).withColumn("n", F.count("*").over(Window.partitionBy("l_suppkey")))
    return s.where("idx <= n - 10").select("l_suppkey", "idx", "mv", (F.col("mv") < 60).alias("flat"))


@query(f"""WITH {_LI}, c AS (SELECT l_suppkey, idx, sum(v) OVER w / 10 AS m FROM li WINDOW w AS (PARTITION BY l_suppkey ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT l_suppkey, idx, round(m, 3) AS mean10 FROM c WHERE idx >= 9""")
def moving_means(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("idx").rowsBetween(-9, 0)
    return _long(spark, d).select("l_suppkey", "idx", F.round(F.sum("v").over(w) / 10, 3).alias("mean10")).where("idx >= 9")


@query("""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS expected FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'R') AS found FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(expected, 0) AS INTEGER) AS expected, coalesce(found, 0) AS found,
  CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN expected > 0 AND found = 0 THEN 'unlabelled' ELSE 'complete' END AS status FROM a FULL JOIN b ON a.k = b.k""", shared=False)
def completeness(spark: SparkSession, d: str) -> DataFrame:
    """Raw keys against processed keys, of which either side lacks some."""
    a = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").cast("int").alias("expected"))
    b = table(spark, d, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("found"))
    return quality.completeness(a, b, ["k"], "expected", "found")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')", shared=False)
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Annotations without a recording of the wanted kind."""
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").where("lang = 'en'"), "doc_id", "left_anti")


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'only_documents' WHEN d.doc_id IS NULL THEN 'only_labels' ELSE 'both' END AS side, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""", shared=False)
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Differences and intersection of two key sets."""
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    parts = [a.subtract(b).withColumn("side", F.lit("only_documents")), b.subtract(a).withColumn("side", F.lit("only_labels")), a.intersect(b).withColumn("side", F.lit("both"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("side").agg(F.count("*").alias("n"))


@query(f"""SELECT user_id, seizure FROM tr WHERE "end" > (SELECT max(t) FROM ev e WHERE e.user_id = tr.user_id)""")
def truncated_events(spark: SparkSession, d: str) -> DataFrame:
    """Annotated intervals that end after their recording."""
    ends = bridge.events(spark, d).groupBy("user_id").agg(F.max("t").alias("until"))
    return bridge.truth(spark, d).join(ends, "user_id").where("end > until").select("user_id", "seizure")


@query("""WITH ln AS (SELECT user_id, count(*) AS n FROM se GROUP BY user_id), x AS (SELECT user_id, n, CASE WHEN n >= 20 THEN ((n - 20) // 10) * 10 + 20 ELSE 0 END AS covered FROM ln)
SELECT x.user_id, n, covered, n - covered AS rest, count(s.idx) AS events_inside FROM x LEFT JOIN se s ON s.user_id = x.user_id AND s.event_type = 'error' AND s.idx >= covered WHERE n - covered >= 3 GROUP BY ALL""")
def trailing_finder(spark: SparkSession, d: str) -> DataFrame:
    """Rows that no full window covers, where there are enough of them, and the events inside."""
    s = bridge.series(spark, d)
    n = s.groupBy("user_id").agg(F.count("*").alias("n"))
    x = n.withColumn("covered", F.when(F.col("n") >= 20, F.floor((F.col("n") - 20) / 10) * 10 + 20).otherwise(0).cast("long")).withColumn("rest", F.col("n") - F.col("covered")).where("rest >= 3")
    inside = F.sum(((F.col("event_type") == "error") & (F.col("idx") >= F.col("covered"))).cast("long")).alias("events_inside")
    return s.join(x, "user_id").groupBy("user_id", "n", "covered", "rest").agg(inside)


@query("SELECT user_id, count(*) AS n FROM se GROUP BY user_id HAVING count(*) < 60")
def zero_window_finder(spark: SparkSession, d: str) -> DataFrame:
    """Series too short for a single window."""
    return bridge.series(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).where("n < 60")


@query(f"""WITH {_SEG}, p AS (
  SELECT l_suppkey, 'saturated' AS problem, CASE WHEN percent >= 50 THEN 'high' WHEN percent >= 10 THEN 'medium' ELSE 'low' END AS severity FROM sr WHERE bad_segments > 0
  UNION ALL SELECT l_suppkey, 'short', 'low' FROM li GROUP BY l_suppkey HAVING count(*) < 600) SELECT problem, severity, count(*) AS runs FROM p GROUP BY ALL""")
def problem_report(spark: SparkSession, d: str) -> DataFrame:
    s = _saturation(spark, d).where("bad_segments > 0")
    a = s.select(F.lit("saturated").alias("problem"), F.when(F.col("percent") >= 50, "high").when(F.col("percent") >= 10, "medium").otherwise("low").alias("severity"))
    b = _long(spark, d).groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n < 600").select(F.lit("short").alias("problem"), F.lit("low").alias("severity"))
    return a.unionByName(b).groupBy("problem", "severity").agg(F.count("*").alias("runs"))


_GAPS = "gd AS (SELECT user_id, event_type, value AS dur FROM ev)"


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return bridge.events(spark, d).select("user_id", "event_type", F.col("value").alias("dur"))


_ROUND = ["mean", "median", "std_pop", "std_samp", "low", "high", "p05", "p25", "p75", "p95", "range", "cv"]
_STATS = """count(*) AS n, avg(dur) AS mean, median(dur) AS median, stddev_pop(dur) AS std_pop, stddev_samp(dur) AS std_samp, min(dur) AS low, max(dur) AS high,
  quantile_cont(dur, 0.05) AS p05, quantile_cont(dur, 0.25) AS p25, quantile_cont(dur, 0.75) AS p75, quantile_cont(dur, 0.95) AS p95, max(dur) - min(dur) AS "range", stddev_pop(dur) / avg(dur) AS cv"""


@query(f"WITH {_GAPS}, s AS (SELECT event_type, {_STATS} FROM gd GROUP BY event_type) SELECT event_type, n, {', '.join(f'round({c if c != 'range' else chr(34) + c + chr(34)}, 5) AS {c if c != 'range' else chr(34) + c + chr(34)}' for c in _ROUND)} FROM s")
def duration_stats(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.duration_stats(_durations(spark, d), ["event_type"], "dur")
    return s.select("event_type", "n", *[F.round(c, 5).alias(c) for c in _ROUND])


_P = [0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99, 0.999]


@query(f"""WITH p AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in _P)}]) AS share, unnest((SELECT quantile_cont(value, [{', '.join(f'CAST({x} AS DOUBLE)' for x in _P)}]) FROM ev)) AS value) SELECT share, round(value, 5) AS value FROM p""")
def duration_percentiles(spark: SparkSession, d: str) -> DataFrame:
    a = bridge.events(spark, d).agg(F.percentile("value", F.array(*[F.lit(x) for x in _P])).alias("p"))
    return a.select(F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in _P]).alias("share"), F.col("p").alias("value"))).alias("z")).select(F.col("z.share").alias("share"), F.round("z.value", 5).alias("value"))


@query("""SELECT CASE WHEN value < 2 THEN 'very_short' WHEN value < 5 THEN 'short' WHEN value < 15 THEN 'medium' WHEN value < 60 THEN 'long' ELSE 'very_long' END AS bucket,
  count(*) AS n, round(100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS percent FROM ev GROUP BY 1""")
def duration_buckets(spark: SparkSession, d: str) -> DataFrame:
    g = bridge.events(spark, d).groupBy(scalars.duration_bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query("""SELECT * FROM (SELECT CASE WHEN value < 15 THEN 'short' ELSE 'long' END AS b, event_type FROM ev) PIVOT (count(*) FOR event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY b)""")
def bucket_pivot(spark: SparkSession, d: str) -> DataFrame:
    b = bridge.events(spark, d).select(F.when(F.col("value") < 15, "short").otherwise("long").alias("b"), "event_type")
    return b.groupBy("b").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("""WITH m AS (SELECT event_type, 'weekday' AS field, CAST(dayofweek(make_timestamp(t)) AS VARCHAR) AS v, value FROM ev UNION ALL SELECT event_type, 'half', CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END, value FROM ev)
SELECT event_type, field, v, count(*) AS n, round(100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY event_type, field), 6) AS percent, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std FROM m GROUP BY event_type, field, v""")
def metadata_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Counts, shares within the type, means and deviations over several fields at once."""
    e = bridge.events(spark, d)
    half, day = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"), (F.dayofweek(F.timestamp_micros("t")) - 1).cast("string")
    fields = F.explode(F.array(F.struct(F.lit("weekday").alias("field"), day.alias("v")), F.struct(F.lit("half").alias("field"), half.alias("v")))).alias("f")
    g = e.select("event_type", "value", fields).groupBy("event_type", "f.field", "f.v").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_samp("value"), 5).alias("std"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("event_type", "field")), 6))


@query("""WITH s AS (SELECT event_type, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, avg(value) AS mean FROM ev GROUP BY event_type),
a AS (SELECT event_type, 'conservative' AS approach, greatest(CAST(0.1 AS DOUBLE), p5 * 0.5) AS lo, least(CAST(600 AS DOUBLE), p95 * 1.5) AS hi FROM s UNION ALL
  SELECT event_type, 'focused', greatest(CAST(0.2 AS DOUBLE), p25 * 0.8), least(CAST(300 AS DOUBLE), p75 * 1.2) FROM s UNION ALL SELECT event_type, 'aggressive', greatest(CAST(0.1 AS DOUBLE), mean * 0.5), least(CAST(200 AS DOUBLE), mean * 2.0) FROM s),
b AS (SELECT event_type, approach, greatest(2, CAST(trunc(lo * 8) AS BIGINT)) AS low, CAST(trunc(hi * 8) AS BIGINT) AS high FROM a)
SELECT event_type, approach, low, high, greatest(1, CAST(trunc((high - low) / CAST(20 AS DOUBLE)) AS BIGINT)) AS step FROM b""")
def length_recommendation(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.duration_stats(_durations(spark, d), ["event_type"], "dur")
    r = s.select("event_type", F.explode(scalars.length_recommendations(F.col("event_type"), F.col("p05"), F.col("p25"), F.col("p75"), F.col("p95"), F.col("mean"), 8.0)).alias("r"))
    return r.select("event_type", "r.*")


_TAX = """ty AS (SELECT user_id, subject, value, t, event_id, CASE event_type WHEN 'signup' THEN 'sz_foc_a_m_tonic' WHEN 'purchase' THEN 'sz_foc_ia_nm' WHEN 'error' THEN 'sz_gen_m_tonicClonic' WHEN 'view' THEN 'bckg' ELSE 'sz_uo_nm_behavior' END AS ty FROM ev)"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Events with names of the annotation taxonomy in the place of their own."""
    e = F.col("event_type")
    return bridge.events(spark, d).withColumn("ty", F.when(e == "signup", "sz_foc_a_m_tonic").when(e == "purchase", "sz_foc_ia_nm").when(e == "error", "sz_gen_m_tonicClonic").when(e == "view", "bckg").otherwise("sz_uo_nm_behavior"))


@query(f"""WITH {_TAX}, x AS (SELECT ty, value, CASE ty WHEN 'sz_foc_a_m_tonic' THEN 'focal_aware' WHEN 'sz_foc_ia_nm' THEN 'focal_impaired' WHEN 'sz_gen_m_tonicClonic' THEN 'generalized_motor' WHEN 'bckg' THEN 'non_seizure' ELSE 'unknown_nonmotor' END AS category,
  CASE ty WHEN 'sz_foc_a_m_tonic' THEN 'Focal Aware' WHEN 'sz_foc_ia_nm' THEN 'Focal Impaired-Awareness' WHEN 'sz_gen_m_tonicClonic' THEN 'Generalized Seizures' WHEN 'bckg' THEN 'Non-Seizure' ELSE 'Seizures Unknown Onset' END AS category_v2,
  CASE ty WHEN 'sz_foc_a_m_tonic' THEN 'focal_mit_moption' WHEN 'sz_foc_ia_nm' THEN 'focal_ohne_moption' WHEN 'sz_gen_m_tonicClonic' THEN 'gen_mit_moption' WHEN 'bckg' THEN 'unclassified' ELSE 'unknown_ohne_moption' END AS category_v1 FROM ty)
SELECT category, category_v1, category_v2, count(*) AS n, round(avg(value), 5) AS mean FROM x GROUP BY ALL""")
def category_rules(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ty")
    g = _typed(spark, d).groupBy(scalars.category(t).alias("category"), scalars.category_lists(t).alias("category_v1"), scalars.category_v2(t).alias("category_v2"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"))


@query(f"""WITH {_TAX} SELECT CASE ty WHEN 'sz_foc_a_m_tonic' THEN 'motor' WHEN 'sz_foc_ia_nm' THEN 'non-motor' WHEN 'sz_gen_m_tonicClonic' THEN 'motor' WHEN 'bckg' THEN 'unknown' ELSE 'non-motor' END AS motor, count(*) AS n FROM ty GROUP BY 1""")
def motor_class(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).groupBy(scalars.motor_class(F.col("ty")).alias("motor")).agg(F.count("*").alias("n"))


@query(f"""WITH {_TAX}, h AS (SELECT *, value > 60 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ty WHERE ty <> 'bckg')
SELECT k AS ordinal, ty AS name, count(*) AS events, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS detected, count(DISTINCT subject) AS subjects, round(avg(CAST(hit AS INT)), 6) AS sensitivity FROM h GROUP BY ALL""")
def type_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Detection by type and ordinal of the event in its series; type_metrics_all has the keys without the ordinal."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    h = _typed(spark, d).where("ty <> 'bckg'").withColumn("ordinal", F.row_number().over(w).cast("long")).withColumn("hit", (F.col("value") > 60).cast("int"))
    g = h.groupBy("ordinal", F.col("ty").alias("name"))
    return g.agg(F.count("*").alias("events"), F.sum("hit").alias("detected"), F.countDistinct("subject").alias("subjects"), F.round(F.avg("hit"), 6).alias("sensitivity"))


@query(f"""WITH {_TAX}, h AS (SELECT *, value > 60 AS hit FROM ty WHERE ty <> 'bckg'),
u AS (SELECT 'type' AS kind, ty AS name, subject, hit FROM h UNION ALL SELECT 'onset', substr(ty, 1, 6), subject, hit FROM h
  UNION ALL SELECT 'category', CASE ty WHEN 'sz_foc_a_m_tonic' THEN 'focal_aware' WHEN 'sz_foc_ia_nm' THEN 'focal_impaired' WHEN 'sz_gen_m_tonicClonic' THEN 'generalized_motor' ELSE 'unknown_nonmotor' END, subject, hit FROM h
  UNION ALL SELECT 'motor', CASE ty WHEN 'sz_foc_a_m_tonic' THEN 'motor' WHEN 'sz_gen_m_tonicClonic' THEN 'motor' ELSE 'non-motor' END, subject, hit FROM h)
SELECT kind, name, count(*) AS events, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS detected, count(DISTINCT subject) AS subjects, round(avg(CAST(hit AS INT)), 6) AS sensitivity FROM u GROUP BY ALL""")
def type_metrics_all(spark: SparkSession, d: str) -> DataFrame:
    """Detection by type, onset, category and motor class, for all typed events."""
    t = F.col("ty")
    h = _typed(spark, d).where("ty <> 'bckg'").withColumn("hit", (F.col("value") > 60).cast("int"))
    named = {"type": t, "onset": F.substring("ty", 1, 6), "category": scalars.category(t), "motor": scalars.motor_class(t)}
    keys = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), name.alias("name")) for kind, name in named.items()])).alias("u")
    g = h.select("subject", "hit", keys).groupBy("u.kind", "u.name")
    return g.agg(F.count("*").alias("events"), F.sum("hit").alias("detected"), F.countDistinct("subject").alias("subjects"), F.round(F.avg("hit"), 6).alias("sensitivity"))


@query("""SELECT subject % 5 AS threshold, event_type AS strategy, count(*) AS n, round(100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY subject % 5), 6) AS percent,
  row_number() OVER (PARTITION BY subject % 5 ORDER BY count(*) DESC, event_type) = 1 AS most_used FROM ev GROUP BY 1, 2""")
def strategy_usage_pct(spark: SparkSession, d: str) -> DataFrame:
    g = bridge.events(spark, d).groupBy((F.col("subject") % 5).alias("threshold"), F.col("event_type").alias("strategy")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("threshold")
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(w), 6)).withColumn("most_used", F.row_number().over(w.orderBy(F.desc("n"), "strategy")) == 1)


@query("""WITH f AS (SELECT event_type, CASE WHEN user_id % 3 = 0 THEN 'responder' ELSE 'other' END AS flag, value FROM ev), u AS (SELECT * FROM f UNION ALL SELECT event_type, 'overall', value FROM f)
SELECT event_type, round(avg(value) FILTER (flag = 'responder'), 5) AS responder, round(avg(value) FILTER (flag = 'other'), 5) AS other, round(avg(value) FILTER (flag = 'overall'), 5) AS overall FROM u GROUP BY event_type""")
def flag_overall_pivot(spark: SparkSession, d: str) -> DataFrame:
    f = bridge.events(spark, d).select("event_type", F.when(F.col("user_id") % 3 == 0, "responder").otherwise("other").alias("flag"), "value")
    u = f.unionByName(f.withColumn("flag", F.lit("overall")))
    return u.groupBy("event_type").pivot("flag", ["responder", "other", "overall"]).agg(F.round(F.avg("value"), 5))


@query("""SELECT event_type AS threshold, CASE WHEN grouping(flag) = 1 THEN 'all' WHEN flag THEN 'responders' ELSE 'others' END AS grp, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std
FROM (SELECT event_type, user_id % 3 = 0 AS flag, value FROM ev) GROUP BY GROUPING SETS ((event_type), (event_type, flag))""")
def threshold_groups(spark: SparkSession, d: str) -> DataFrame:
    e = bridge.events(spark, d).select(F.col("event_type").alias("threshold"), (F.col("user_id") % 3 == 0).alias("flag"), "value")
    e = e.groupingSets([["threshold"], ["threshold", "flag"]], "threshold", "flag").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_samp("value"), 5).alias("std"), F.grouping("flag").alias("g"))
    return e.select("threshold", F.when(F.col("g") == 1, "all").when(F.col("flag"), "responders").otherwise("others").alias("grp"), "n", "mean", "std")


@query("""SELECT user_id, max_by(event_type, struct_pack(a := m, b := event_type)) AS best, max(m) AS mean, count(*) AS methods FROM (SELECT user_id, event_type, round(avg(value), 6) AS m FROM ev GROUP BY ALL) GROUP BY user_id""")
def best_per_dataset(spark: SparkSession, d: str) -> DataFrame:
    m = bridge.events(spark, d).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("m"))
    return m.groupBy("user_id").agg(F.max_by("event_type", F.struct("m", "event_type")).alias("best"), F.max("m").alias("mean"), F.count("*").alias("methods"))


@query("SELECT round(avg(m), 5) AS mean_of_means FROM (SELECT user_id, avg(value) AS m FROM ev GROUP BY user_id)")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    return bridge.events(spark, d).groupBy("user_id").agg(F.avg("value").alias("m")).agg(F.round(F.avg("m"), 5).alias("mean_of_means"))


@query("""SELECT count(*) AS series, count(*) FILTER (n > 0) AS with_events, count(DISTINCT subject) AS subjects, round(avg(n) FILTER (n > 0), 6) AS events_each FROM (SELECT user_id, subject, count(*) FILTER (event_type = 'error') AS n FROM ev GROUP BY ALL)""")
def collection_summary(spark: SparkSession, d: str) -> DataFrame:
    s = bridge.events(spark, d).groupBy("user_id", "subject").agg(F.sum((F.col("event_type") == "error").cast("long")).alias("n"))
    return s.agg(F.count("*").alias("series"), F.count_if(F.col("n") > 0).alias("with_events"), F.countDistinct("subject").alias("subjects"), F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 6).alias("events_each"))


@query("SELECT subject, count(DISTINCT user_id) AS runs, round(sum(h), 5) AS hours FROM (SELECT subject, user_id, (max(t) - min(t)) / CAST(3600000000 AS DOUBLE) AS h FROM ev GROUP BY ALL) GROUP BY subject")
def runs_and_hours(spark: SparkSession, d: str) -> DataFrame:
    return bridge.hours(spark, d).groupBy("subject").agg(F.countDistinct("user_id").alias("runs"), F.round(F.sum("hours"), 5).alias("hours"))


@query("SELECT event_type AS phase, round(100 * avg(CASE WHEN value > 90 THEN 1.0 ELSE 0.0 END), 6) AS percent FROM ev GROUP BY event_type")
def phase_rates(spark: SparkSession, d: str) -> DataFrame:
    return bridge.events(spark, d).groupBy(F.col("event_type").alias("phase")).agg(F.round(100 * F.avg((F.col("value") > 90).cast("double")), 6).alias("percent"))


@query("""SELECT user_id, event_id, CAST(coalesce(props->>'k', '0') AS BIGINT) AS k, coalesce(props->>'missing', 'n/a') AS missing FROM ev WHERE event_type = 'signup'""")
def json_accessors(spark: SparkSession, d: str) -> DataFrame:
    e = bridge.events(spark, d).where("event_type = 'signup'")
    return e.select("user_id", "event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("n/a")).alias("missing"))


@query("""WITH x AS (SELECT c_custkey + 1 AS i FROM customer WHERE c_custkey IS NOT NULL), y AS (SELECT i, i * 37 AS n, 8 AS fs FROM x)
SELECT i, CAST(trunc(i * CAST(1.37 AS DOUBLE)) AS BIGINT) AS cut, CAST(round_even(i * CAST(1.5 AS DOUBLE), 0) AS BIGINT) AS half_even, round(1 / (2 * sqrt(CAST(i AS DOUBLE))), 8) AS scale,
  round(greatest(0, (200 - i) / CAST(200 AS DOUBLE)), 8) AS overlap, 'run-' || CASE WHEN i < 10 THEN '0' ELSE '' END || i AS run,
  CASE WHEN i BETWEEN 1 AND 96 THEN 'train' WHEN i BETWEEN 97 AND 125 THEN 'test' END AS split,
  greatest(256, least(CAST(round_even(8 * 60.0 / greatest(i, 30) * 120, 0) AS BIGINT), 1280)) AS beats FROM y""", shared=False)
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """The column functions for numbers of subjects, seconds and widths, on every customer's number plus one."""
    i = F.col("i")
    return bridge.table(spark, d, "customer").where("c_custkey IS NOT NULL").select((F.col("c_custkey") + 1).cast("long").alias("i")).select(
        "i", scalars.samples(i.cast("double"), 1.37).alias("cut"), scalars.samples_rounded(i.cast("double"), 1.5).alias("half_even"), F.round(scalars.discord_scale(i), 8).alias("scale"),
        F.round(scalars.overlap_ratio(F.lit(200.0), i.cast("double")), 8).alias("overlap"), scalars.run_id(F.concat(F.lit("sub-001_run-"), i.cast("string"), F.lit("_ecg.edf"))).alias("run"),
        scalars.split_of(i).alias("split"), scalars.beats_window(F.lit(8.0), i.cast("double"), 120.0).alias("beats"),
    )


@query("""WITH x AS (SELECT DISTINCT 20 + o_orderkey % 20000 AS n FROM orders), y AS (SELECT n, n / CAST(8 AS DOUBLE) AS s FROM x),
a AS (SELECT n, s, CASE WHEN s < 30 THEN 16 WHEN s < 300 THEN 40 ELSE 80 END AS low, CASE WHEN s < 30 THEN CAST(0.3 AS DOUBLE) WHEN s < 300 THEN CAST(0.4 AS DOUBLE) WHEN s < 1800 THEN CAST(0.5 AS DOUBLE) END AS part FROM y)
SELECT n, CAST(low AS BIGINT) AS low, CAST(CASE WHEN s < 1800 THEN least(greatest(CAST(trunc(n * part) AS BIGINT), low * 2), n - 1) ELSE 800 END AS BIGINT) AS high,
  CAST(CASE WHEN s < 30 THEN 8 WHEN s < 300 THEN 16 WHEN s < 1800 THEN 40 ELSE 80 END AS BIGINT) AS step,
  greatest(1, least(CASE WHEN 1200 >= s THEN CAST(trunc(n * CAST(0.5 AS DOUBLE)) AS BIGINT) ELSE least(9600, n - 1) END, n - 1)) AS split FROM a""", shared=False)
def length_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Subsequence lengths and training part by window duration."""
    x = bridge.table(spark, d, "orders").select((20 + F.col("o_orderkey") % 20000).alias("n")).distinct()
    r = x.select("n", scalars.length_range(F.col("n"), F.lit(8)).alias("r"), scalars.train_split(F.col("n"), F.lit(8.0), 20.0, 0.5).alias("split"))
    return r.select("n", "r.*", "split")


@query("SELECT user_id, window_index, rank, score FROM (SELECT user_id, idx // 20 AS window_index, value AS score, row_number() OVER (PARTITION BY user_id, idx // 20 ORDER BY value DESC, idx) AS rank FROM se) WHERE rank <= 3")
def result_documents_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Ranked anomalies as nested documents in JSON and read back by schema."""
    s = bridge.series(spark, d).withColumn("window_index", F.floor(F.col("idx") / 20).cast("int"))
    w = Window.partitionBy("user_id", "window_index").orderBy(F.desc("value"), "idx")
    a = s.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select(
        F.col("user_id").cast("string").alias("subject_id"), F.lit("run-01").alias("run_id"), "window_index", (F.col("window_index") * 20.0).alias("window_start_time"), "rank", F.lit(8).alias("m_value"),
        F.col("value").alias("score"), F.col("idx").alias("loc_sample"), (F.col("idx") / 8.0).alias("loc_time"),
    )
    docs = sinks.result_documents(a).select(F.from_json("value", readers.RESULT).alias("d")).select("d.*")
    back = readers.anomalies_of(docs)
    return back.select(F.col("subject_id").cast("long").alias("user_id"), F.col("window_index").cast("long").alias("window_index"), F.col("rank").cast("long").alias("rank"), "score")


@query("SELECT user_id FROM ev GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase' AND value > 200) = 0")
def remaining_work(spark: SparkSession, d: str) -> DataFrame:
    """Work that is not finished: a restart takes up only this."""
    e = bridge.events(spark, d)
    return sinks.remaining(e.select("user_id").distinct(), e.where("event_type = 'purchase' AND value > 200"), ["user_id"])


@query(f"""WITH w AS (SELECT user_id, idx // 20 AS k, count(*) AS n, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS label FROM se GROUP BY ALL)
SELECT user_id, count(*) AS n_windows, CAST(sum(label) AS BIGINT) AS n_seizure_windows FROM w GROUP BY user_id""")
def patched_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals counted again after the trailing windows are appended to the full ones."""
    s = bridge.series(spark, d).withColumn("k", F.floor(F.col("idx") / 20).cast("long"))
    g = s.groupBy("user_id", "k").agg(F.count("*").alias("n"), F.max((F.col("event_type") == "error").cast("int")).alias("window_label"))
    return sinks.with_trailing_window(g.where("n = 20"), g.where("n < 20"), ["user_id"])[1]


