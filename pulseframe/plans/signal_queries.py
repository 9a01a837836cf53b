"""Queries over arrays: features, spectra, filters, similarity search, learning, streams."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dsp, graph, ml, profile, quantize, segments
from ..sources import bridge, readers
from ..sources.bridge import HOUR, table
from ..streaming import alarms as streaming
from .registry import query

M, SPLIT = 8, 16


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Users' series, a row a value."""
    return bridge.series(spark, d).select("user_id", F.col("idx").alias("pos"), F.col("value").cast("double").alias("v"))


_VEC = "ve AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query(f"""WITH {_VEC} SELECT vec_id, round(list_stddev_pop(v), 6) AS std, round(list_min(v), 6) AS low, round(list_max(v), 6) AS high,
  round(list_sum(list_transform(range(1, len(v)), lambda i: abs(v[i + 1] - v[i]))), 5) AS line_length, round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)), 6) AS rms FROM ve""", shared=False)
def window_features(spark: SparkSession, d: str) -> DataFrame:
    f = dsp.time_features(F.col("values"))
    return _vectors(spark, d).select("vec_id", *[F.round(c, 5 if n == "line_length" else 6).alias(n) for n, c in f.items()])


_BANDS = {"low": (0.5, 4.0), "mid": (4.0, 8.0), "top": (8.0, 20.0)}


@query(f"""WITH {_VEC}, p AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(v) AS x FROM ve), h AS (SELECT vec_id, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS x FROM p),
k AS (SELECT CAST(unnest(range(0, 33)) AS BIGINT) AS k), w AS (SELECT sum((0.5 - 0.5 * cos(2 * pi() * i / 63)) ** 2) AS w FROM (SELECT unnest(range(0, 64)) AS i)),
f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * i * k / 64)) ** 2 + sum(x * sin(2 * pi() * i * k / 64)) ** 2 AS p FROM h, k GROUP BY ALL), g AS (SELECT vec_id, k * CAST(64 AS DOUBLE) / 64 AS f, p / (64 * w) AS p FROM f, w)
SELECT vec_id, round(avg(p) FILTER (f >= 0.5 AND f < 4), 6) AS low, round(avg(p) FILTER (f >= 4 AND f < 8), 6) AS mid, round(avg(p) FILTER (f >= 8 AND f < 20), 6) AS top, round(sum(p), 6) AS total FROM g GROUP BY vec_id""", shared=False)
def band_power(spark: SparkSession, d: str) -> DataFrame:
    p = dsp.powers(_vectors(spark, d), ["vec_id"], 64.0, _BANDS)
    return p.select("vec_id", *[F.round(c, 6).alias(c) for c in (*_BANDS, "total")])


_WIN = f"""l0 AS (SELECT user_id, idx, list(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING) AS w FROM se),
l1 AS (SELECT user_id, idx AS pos, list_avg(w) AS mu, list_stddev_pop(w) AS sd, w FROM l0 WHERE len(w) = {M})"""


def _dist(a: str, b: str) -> str:
    return f"sqrt(greatest(0, 2 * {M} * (1 - (list_dot_product({a}.w, {b}.w) - {M} * {a}.mu * {b}.mu) / ({M} * {a}.sd * {b}.sd))))"


@query(f"WITH {_WIN} SELECT a.user_id, b.pos, round(CASE WHEN b.pos = 0 THEN 0 ELSE {_dist('a', 'b')} END, 4) AS dist FROM l1 a JOIN l1 b ON a.user_id = b.user_id WHERE a.pos = 0")
def mass_profile(spark: SparkSession, d: str) -> DataFrame:
    p = profile.mass(_series(spark, d), ["user_id"], 0, M)
    return p.select("user_id", "pos", F.when(F.col("pos") == 0, 0.0).otherwise(F.round("dist", 4)).alias("dist"))


@query(f"WITH {_WIN} SELECT a.user_id, a.pos, round(min({_dist('a', 'b')}), 4) AS dist FROM l1 a JOIN l1 b ON a.user_id = b.user_id AND b.pos <= a.pos - {M} WHERE a.pos > {M} AND a.pos >= {SPLIT} GROUP BY a.user_id, a.pos")
def left_profile_exact(spark: SparkSession, d: str) -> DataFrame:
    p = profile.matrix_profile(_series(spark, d), ["user_id"], M, M, left_only=True)
    return p.where(f"pos > {M} AND pos >= {SPLIT} AND dist IS NOT NULL").select("user_id", "pos", F.round("dist", 4).alias("dist"))


@query(f"WITH {_WIN} SELECT a.user_id, a.pos, round(min({_dist('a', 'b')}), 4) AS dist FROM l1 a JOIN l1 b ON a.user_id = b.user_id AND abs(a.pos - b.pos) >= 2 GROUP BY a.user_id, a.pos")
def matrix_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.matrix_profile(_series(spark, d), ["user_id"], M).select("user_id", "pos", F.round("dist", 4).alias("dist"))


@query(f"""WITH {_WIN}, p AS (SELECT a.user_id, a.pos, min({_dist('a', 'b')}) AS dist FROM l1 a JOIN l1 b ON a.user_id = b.user_id AND b.pos <= a.pos - {M} WHERE a.pos > {M} AND a.pos >= {SPLIT} GROUP BY a.user_id, a.pos)
SELECT user_id, round(max(dist) / (2 * sqrt({M})), 5) AS score FROM p GROUP BY user_id""")
def left_profile_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The pruned search gives the exact largest left distance."""
    return profile.left_discords(_series(spark, d), ["user_id"], [M], SPLIT, pruned=True).select("user_id", F.round("score", 5).alias("score"))


_LENGTHS = [6, 8, 10, 12]


def _lengths_sql(lengths: list[int], split: int, rows: str = "se", key: str = "user_id") -> str:
    """ld: key, m, score, pos of the best left discord of each series (columns key, idx, value) and length."""
    each = " UNION ALL ".join(
        f"""SELECT {key}, pos, {m} AS m, w, list_avg(w) AS mu, list_stddev_pop(w) AS sd FROM (
  SELECT {key}, idx AS pos, list(value) OVER (PARTITION BY {key} ORDER BY idx ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS w FROM {rows}) WHERE len(w) = {m}""" for m in lengths
    )
    same = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    own = ", ".join(f"a.{k}" for k in key.split(", "))
    whole = " AND ".join(f"g.{k} = p.{k}" for k in key.split(", "))
    names = ", ".join(f"g.{k}" for k in key.split(", "))
    return f"""lw AS ({each}),
lp AS (
  SELECT {own}, a.m, a.pos, min(sqrt(greatest(0, 2 * a.m * (1 - (list_dot_product(a.w, b.w) - a.m * a.mu * b.mu) / (a.m * a.sd * b.sd))))) AS dist
  FROM lw a JOIN lw b ON {same} AND a.m = b.m AND b.pos <= a.pos - a.m WHERE a.pos > a.m AND a.pos >= {split} AND a.sd > 1e-5 AND b.sd > 1e-5 GROUP BY {own}, a.m, a.pos),
lg AS (SELECT {key}, m, n FROM (SELECT {key}, count(*) AS n FROM {rows} GROUP BY {key}), (SELECT unnest({lengths}) AS m) WHERE n >= 2 * m),
ld AS (
  SELECT {names}, g.m, coalesce(max(dist), 0) / (2 * sqrt(g.m)) AS score, coalesce(arg_max(pos, dist), -1) AS pos FROM lg g LEFT JOIN lp p ON {whole} AND g.m = p.m GROUP BY {names}, g.m)"""


@query(f"WITH {_lengths_sql(_LENGTHS, SPLIT)} SELECT user_id, CAST(m AS INTEGER) AS m, round(score, 5) AS score, CAST(pos AS BIGINT) AS pos FROM ld")
def multi_length_discords(spark: SparkSession, d: str) -> DataFrame:
    return profile.left_discords(_series(spark, d), ["user_id"], [6, 8, 10, 12], SPLIT).select("user_id", "m", F.round("score", 5).alias("score"), "pos")


_RANGES = [8, 11]


@query(f"""WITH rw AS ({" UNION ALL ".join(f"SELECT user_id, pos, {m} AS m, w, list_avg(w) AS mu, list_stddev_pop(w) AS sd FROM (SELECT user_id, idx AS pos, list(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS w FROM se) WHERE len(w) = {m}" for m in _RANGES)}),
rp AS (SELECT a.user_id, a.m, a.pos, min(sqrt(greatest(0, 2 * a.m * (1 - (list_dot_product(a.w, b.w) - a.m * a.mu * b.mu) / (a.m * a.sd * b.sd))))) AS dist
  FROM rw a JOIN rw b ON a.user_id = b.user_id AND a.m = b.m AND abs(a.pos - b.pos) >= a.m WHERE a.sd > 1e-5 AND b.sd > 1e-5 GROUP BY a.user_id, a.m, a.pos),
rg AS (SELECT user_id, m FROM (SELECT user_id, count(*) AS n FROM se GROUP BY user_id), (SELECT unnest({_RANGES}) AS m) WHERE n >= 2 * m)
SELECT g.user_id, CAST(g.m AS INTEGER) AS m, round(coalesce(max(dist), 0) / (2 * sqrt(g.m)), 5) AS score, CAST(coalesce(arg_max(pos, struct_pack(a := round(dist, 9), b := -pos)), -1) AS BIGINT) AS pos FROM rg g LEFT JOIN rp p ON g.user_id = p.user_id AND g.m = p.m GROUP BY g.user_id, g.m""")
def range_discords(spark: SparkSession, d: str) -> DataFrame:
    """The best discord of each series and length by candidates within a falling range."""
    return segments.range_discords(_series(spark, d), ["user_id"], _RANGES).withColumn("score", F.round("score", 5))


@query(f"""WITH {_lengths_sql(_LENGTHS, SPLIT)}, q AS (SELECT user_id, quantile_cont(score, CAST(0.95 AS DOUBLE)) AS lim FROM ld GROUP BY user_id)
SELECT ld.user_id, CAST(m AS INTEGER) AS m, round(score, 5) AS score, CAST(pos AS BIGINT) AS pos, CAST(row_number() OVER (PARTITION BY ld.user_id ORDER BY score DESC, m) AS INTEGER) AS rank FROM ld JOIN q ON ld.user_id = q.user_id WHERE score >= lim""")
def best_so_far_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Of each series' best discords, one a length, those from the 95th percentile up, by falling score."""
    b = profile.left_discords(_series(spark, d), ["user_id"], _LENGTHS, SPLIT)
    return profile.best_so_far(b, ["user_id"], 0.95).select("user_id", "m", F.round("score", 5).alias("score"), "pos", "rank")


@query(f"""WITH p AS (SELECT user_id, count(*) AS n FROM se GROUP BY user_id),
f0 AS (SELECT user_id, idx, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY idx) THEN 0 ELSE 1 END AS nw, event_type FROM se),
f1 AS (SELECT user_id, sum(nw) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM f0),
f2 AS (SELECT user_id, max(c) AS flat FROM (SELECT user_id, g, count(*) AS c FROM f1 GROUP BY ALL) GROUP BY user_id)
SELECT p.user_id, x.problem FROM p JOIN f2 ON p.user_id = f2.user_id, LATERAL (SELECT unnest([CASE WHEN n < 60 THEN 'short' END, CASE WHEN n <= 55 THEN 'split' END, CASE WHEN flat >= 5 THEN 'constant' END]) AS problem) x WHERE x.problem IS NOT NULL""")
def fit_problems(spark: SparkSession, d: str) -> DataFrame:
    """Why a series cannot be searched: fewer values than the longest length, none behind the split, a constant stretch."""
    kind = F.transform(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), lambda x: x)
    s = bridge.series(spark, d).withColumn("code", F.coalesce(F.nullif(F.array_position(kind, F.col("event_type")), F.lit(0)).cast("double"), F.lit(9.0)))
    return profile.fit_problems(profile.gather(s, ["user_id"], ["idx"], "code"), ["user_id"], 5, 60, 55)


@query(f"""WITH RECURSIVE {bridge.SQL}, {_WIN}, p AS (SELECT a.user_id, a.pos, min({_dist('a', 'b')}) AS dist FROM l1 a JOIN l1 b ON a.user_id = b.user_id AND b.pos <= a.pos - {M} WHERE a.pos > {M} AND a.pos >= {SPLIT} GROUP BY a.user_id, a.pos),
c AS (SELECT p.* FROM p JOIN (SELECT user_id, quantile_cont(dist, CAST(0.95 AS DOUBLE)) AS lim FROM p GROUP BY user_id) q ON p.user_id = q.user_id WHERE dist >= lim),
r AS (
  SELECT user_id, CAST([] AS BIGINT[]) AS taken FROM c GROUP BY user_id
  UNION ALL
  SELECT user_id, list_append(taken, nxt) FROM (
    SELECT r.user_id, r.taken, (SELECT arg_max(c.pos, struct_pack(a := c.dist, b := -c.pos)) FROM c WHERE c.user_id = r.user_id AND len(list_filter(r.taken, lambda x: abs(x - c.pos) < {M // 4})) = 0) AS nxt
    FROM r WHERE len(taken) < 5) WHERE nxt IS NOT NULL),
z AS (SELECT user_id, arg_max(taken, len(taken)) AS taken FROM r GROUP BY user_id),
u AS (SELECT user_id, unnest(range(1, len(taken) + 1)) AS rank, unnest(taken) AS pos FROM z)
SELECT u.user_id, CAST(rank AS INTEGER) AS rank, u.pos, round(c.dist, 4) AS score, round(c.dist / max(c.dist) OVER (PARTITION BY u.user_id), 4) AS confidence FROM u JOIN c ON u.user_id = c.user_id AND u.pos = c.pos""", shared=False)
def profile_anomalies(spark: SparkSession, d: str) -> DataFrame:
    p = profile.matrix_profile(_series(spark, d), ["user_id"], M, M, left_only=True).where(f"pos > {M} AND pos >= {SPLIT}")
    return profile.anomalies(p, ["user_id"], M).withColumn("score", F.round("score", 4)).withColumn("confidence", F.round("confidence", 4))


@query()
def approx_profile(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the diagonals; never under the exact profile."""
    return profile.matrix_profile(_series(spark, d), ["user_id"], M, share=0.1)


@query(f"""WITH g0 AS (SELECT user_id, idx, value, coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY idx)) / CAST({HOUR} AS DOUBLE), 0) AS gap FROM se),
g1 AS (SELECT user_id, idx AS pos, list(value) OVER w AS v, list(gap) OVER w AS g FROM g0 WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING)),
g2 AS (SELECT user_id, pos, v, g, list_avg(v) AS mv, list_stddev_pop(v) AS sv, list_avg(g) AS mg, list_stddev_pop(g) AS sg FROM g1 WHERE len(v) = {M}),
g3 AS (
  SELECT a.user_id, a.pos, sqrt(greatest(0, 2 * {M} * (1 - (list_dot_product(a.v, b.v) - {M} * a.mv * b.mv) / ({M} * a.sv * b.sv)))) AS dv,
    sqrt(greatest(0, 2 * {M} * (1 - (list_dot_product(a.g, b.g) - {M} * a.mg * b.mg) / ({M} * a.sg * b.sg)))) AS dg
  FROM g2 a JOIN g2 b ON a.user_id = b.user_id AND abs(a.pos - b.pos) >= {-(-M // 4)}),
g4 AS (SELECT user_id, pos, (min(least(dv, dg)) + min((dv + dg) / 2)) / 2 AS dist FROM g3 GROUP BY user_id, pos),
g5 AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY dist DESC, pos DESC) AS r FROM g4)
SELECT user_id, pos + {M // 2} AS pos, round(dist, 4) AS dist FROM g5 WHERE r <= greatest(1, floor(n * CAST(0.1 AS DOUBLE)))""")
def multivariate_profile(spark: SparkSession, d: str) -> DataFrame:
    """Two dimensions, the value and the gap to the event before."""
    w = Window.partitionBy("user_id").orderBy("idx")
    s = bridge.series(spark, d).withColumn("gap", F.coalesce((F.col("t") - F.lag("t").over(w)) / float(HOUR), F.lit(0.0)))
    g = s.select("user_id", F.col("idx").alias("pos"), F.array(F.col("value").cast("double"), "gap").alias("v"))
    return profile.multivariate_anomalies(g, ["user_id"], M, 0.1).withColumn("dist", F.round("dist", 4))


def _pass_sql(sos: np.ndarray, name: str, source: str) -> str:
    """name: the values of source (vec_id, x) run through sections one sample after the other, in reverse order."""
    start, step, level = [], [], "x[1]"
    number = lambda c: f"({c:.17e})"
    for j, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist(), 1):
        dc = (b0 + b1 + b2) / (1 + a1 + a2)
        start += [f"{number(b1 - a1 * dc + b2 - a2 * dc)} * {level} AS p{j}", f"{number(b2 - a2 * dc)} * {level} AS q{j}"]
        step.append(f"{number(b0)} * u{j - 1} + p{j} AS u{j}, {number(b1)} * u{j - 1} - {number(a1)} * u{j} + q{j} AS np{j}, {number(b2)} * u{j - 1} - {number(a2)} * u{j} AS nq{j}")
        level = f"{number(dc)} * {level}"
    own = ", ".join(f"p{j}, q{j}" for j in range(1, len(sos) + 1))
    new = ", ".join(f"np{j}, nq{j}" for j in range(1, len(sos) + 1))
    return f"""{name}_r AS (SELECT vec_id, 0 AS i, x, {", ".join(start)}, CAST([] AS DOUBLE[]) AS y FROM {source}
  UNION ALL SELECT vec_id, i + 1, x, {new}, list_append(y, u{len(sos)}) FROM (SELECT vec_id, i, x, y, {own}, x[i + 1] AS u0, {", ".join(step)} FROM {name}_r WHERE i < len(x))),
{name} AS (SELECT vec_id, list_reverse(y) AS x FROM {name}_r WHERE i = len(x))"""


def _zero_phase_sql(sos: np.ndarray, pad: int) -> str:
    """zp: vec_id, y: the vectors forward and backward through sections, with their ends mirrored through their points."""
    return f"""WITH RECURSIVE {_VEC}, ex AS (SELECT vec_id, list_concat(list_transform(range(0, {pad}), lambda k: 2 * v[1] - v[{pad + 1} - k]), v, list_transform(range(0, {pad}), lambda k: 2 * v[len(v)] - v[len(v) - 1 - k])) AS x FROM ve),
{_pass_sql(sos, "fw", "ex")}, {_pass_sql(sos, "bw", "fw")}, zp AS (SELECT vec_id, x[{pad + 1}:len(x) - {pad}] AS y FROM bw)"""


@query(f"{_zero_phase_sql(dsp.butter_sections(4, 2.0, 20.0, 64.0), 27)} SELECT vec_id, CAST(i AS BIGINT) AS pos, round(y[i + 1], 7) + 0.0 AS v FROM (SELECT vec_id, y, unnest(range(0, len(y))) AS i FROM zp)", shared=False)
def bandpass(spark: SparkSession, d: str) -> DataFrame:
    return dsp.filtered(_vectors(spark, d), ["vec_id"], 64.0, 2.0, 20.0).withColumn("v", F.round("v", 7) + 0.0)


@query(f"{_zero_phase_sql(dsp.cheby_sections(8, 0.05, 0.2), 27)} SELECT vec_id, CAST(i AS BIGINT) AS pos, round(y[4 * i + 1], 7) + 0.0 AS v, CAST(16 AS DOUBLE) AS fs_true FROM (SELECT vec_id, y, unnest(range(0, (len(y) + 3) // 4)) AS i FROM zp)", shared=False)
def decimate(spark: SparkSession, d: str) -> DataFrame:
    return dsp.decimated(_vectors(spark, d), ["vec_id"], 64, 16).withColumn("v", F.round("v", 7) + 0.0)


@query()
def rpeaks(spark: SparkSession, d: str) -> DataFrame:
    """Beats and their intervals in the long series of quantities."""
    g = profile.gather(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], "l_quantity")
    return dsp.beats(g, ["l_suppkey"], 64.0)


def _alarm_features(spark: SparkSession, d: str) -> DataFrame:
    """Time, score, length (hours since the alarm before) and rank (by falling score) of each alarm."""
    w = Window.partitionBy("user_id")
    a = bridge.alarms(spark, d).withColumn("hours", F.col("t") / float(HOUR))
    a = a.withColumn("length", F.coalesce((F.col("t") - F.lag("t").over(w.orderBy("t", "event_id"))) / float(HOUR), F.lit(0.0)))
    return a.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "event_id")).cast("double"))


_FEATURES = ["hours", "score", "length", "rank"]


@query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The number of clusters, 2 to 19, with the best silhouette."""
    return ml.kmeans(_alarm_features(spark, d), _FEATURES, range(2, 20)).select("user_id", "event_id", "cluster")


def _density_sql(features: str, dims: int) -> str:
    """Clusters of z's columns f1.. by user_id: core points, their closure by near pairs, numbers by the first, and what borders on them."""
    scaled = ", ".join(f"CASE WHEN stddev_pop(f{i}) OVER w > 0 THEN (f{i} - avg(f{i}) OVER w) / stddev_pop(f{i}) OVER w ELSE 0 END AS f{i}" for i in range(1, dims + 1))
    far = " + ".join(f"(a.f{i} - b.f{i}) ** 2" for i in range(1, dims + 1))
    return f"""WITH RECURSIVE {bridge.SQL}, {features}, z AS (SELECT user_id, event_id, {scaled} FROM fa WINDOW w AS (PARTITION BY user_id)),
nb AS (SELECT a.user_id, a.event_id AS i, b.event_id AS j FROM z a JOIN z b ON a.user_id = b.user_id AND {far} <= 0.25),
cp AS (SELECT user_id, i FROM nb GROUP BY user_id, i HAVING count(*) >= 3),
ce AS (SELECT nb.user_id, nb.i, nb.j FROM nb JOIN cp a ON nb.user_id = a.user_id AND nb.i = a.i JOIN cp b ON nb.user_id = b.user_id AND nb.j = b.i),
rc AS (SELECT user_id, i, j FROM ce UNION SELECT rc.user_id, rc.i, ce.j FROM rc JOIN ce ON rc.user_id = ce.user_id AND rc.j = ce.i),
cc AS (SELECT user_id, i, min(j) AS first FROM rc GROUP BY user_id, i), cn AS (SELECT user_id, i, dense_rank() OVER (PARTITION BY user_id ORDER BY first) - 1 AS cluster FROM cc),
bo AS (SELECT nb.user_id, nb.i, min(cn.cluster) AS cluster FROM nb JOIN cn ON nb.user_id = cn.user_id AND nb.j = cn.i GROUP BY nb.user_id, nb.i),
dc AS (SELECT z.user_id, z.event_id, cn.cluster IS NOT NULL AS core, CAST(coalesce(cn.cluster, bo.cluster, -1) AS INTEGER) AS cluster
  FROM z LEFT JOIN cn ON z.user_id = cn.user_id AND z.event_id = cn.i LEFT JOIN bo ON z.user_id = bo.user_id AND z.event_id = bo.i)"""


_ALARM_POINTS = f"""fa AS (SELECT user_id, event_id, t / CAST({HOUR} AS DOUBLE) AS f1, score AS f2, coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) / CAST({HOUR} AS DOUBLE), 0) AS f3,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS DOUBLE) AS f4 FROM al)"""


@query(f"{_density_sql(_ALARM_POINTS, 4)} SELECT user_id, event_id, cluster FROM dc", shared=False)
def dbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    return ml.dbscan(_alarm_features(spark, d), ["user_id"], _FEATURES, "event_id", 0.5, 3)


@query(f"{_density_sql(f'fa AS (SELECT user_id, event_id, t / CAST({HOUR} AS DOUBLE) AS f1, value AS f2 FROM ev)', 2)} SELECT user_id, event_id, core, cluster FROM dc", shared=False)
def event_density(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user in the plane of time and value: core points and clusters."""
    e = bridge.events(spark, d).select("user_id", "event_id", (F.col("t") / float(HOUR)).alias("hours"), "value")
    return graph.density_clusters(e, ["user_id"], ["hours", "value"], "event_id", 0.5, 3)


_CODES, _DECAY = 16, 0.8
_FAR = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) ** 2))"


def _round_sql(k: int) -> str:
    """c{k}: the codebook after another round over ve, from c{k - 1} (code, v, size, total)."""
    return f"""a{k} AS (SELECT vec_id, w.v AS v, arg_min(code, {_FAR.format(a="w.v", b="c.v")}) AS code FROM ve w, c{k - 1} c GROUP BY vec_id, w.v),
n{k} AS (SELECT code, count(*) AS n FROM a{k} GROUP BY code), d{k} AS (SELECT code, i, sum(v[i]) AS s FROM a{k}, (SELECT unnest(range(1, 65)) AS i) GROUP BY code, i),
l{k} AS (SELECT code, list(s ORDER BY i) AS s FROM d{k} GROUP BY code),
t{k} AS (SELECT c.code, {_DECAY} * size + {1 - _DECAY!r} * coalesce(n, 0) AS size, CASE WHEN l.s IS NULL THEN list_transform(total, lambda x: {_DECAY} * x) ELSE list_transform(list_zip(total, l.s), lambda z: {_DECAY} * z[1] + {1 - _DECAY!r} * z[2]) END AS total
  FROM c{k - 1} c LEFT JOIN n{k} n ON c.code = n.code LEFT JOIN l{k} l ON c.code = l.code),
e{k} AS (SELECT code, size, total, (size + 1e-5) / (sum(size) OVER () + {_CODES} * 1e-5) * sum(size) OVER () AS even FROM t{k}),
c{k} AS (SELECT code, list_transform(total, lambda x: x / even) AS v, size, total FROM e{k})"""


_VQ = f"{_VEC}, c0 AS (SELECT CAST(vec_id AS INTEGER) AS code, v, CAST(1 AS DOUBLE) AS size, v AS total FROM ve WHERE vec_id < {_CODES}), {_round_sql(1)}, {_round_sql(2)}"


@query(f"""WITH {_VQ}, z AS (SELECT vec_id, code, {_FAR.format(a="w.v", b="c.v")} AS far FROM ve w, c2 c)
SELECT vec_id, arg_min(code, far) AS code, round(min(far) / 64, 6) AS error FROM z GROUP BY vec_id""", shared=False)
def vq_codes(spark: SparkSession, d: str) -> DataFrame:
    """Windows by the nearest of 16 codes, after two rounds from the first windows."""
    w = _vectors(spark, d).withColumnRenamed("values", "window")
    first = [r.window for r in w.where(F.col("vec_id") < _CODES).orderBy("vec_id").collect()]  # one row a code
    return quantize.encode(w, quantize.learn(w, np.array(first), 2, _DECAY)).select("vec_id", "code", F.round("error", 6).alias("error"))


@query()
def rf_profile_windows(spark: SparkSession, d: str) -> DataFrame:
    s = bridge.series(spark, d).withColumn("label", (F.col("event_type") == "error").cast("int"))
    w = ml.centred_windows(s, ["user_id"], "idx", "value", "label", 4)
    _, out = ml.forest(w, "window", "label", 10, 4)
    return out.select("user_id", "idx", "label", F.round("p", 6).alias("p"), "prediction")


_RANKS = """me AS (SELECT user_id AS ds, event_type AS m, round(avg(value), 6) AS v FROM ev GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY ds ORDER BY v DESC) + (count(*) OVER (PARTITION BY ds, v) - 1) / CAST(2 AS DOUBLE) AS r FROM me)"""


def _methods(spark: SparkSession, d: str) -> DataFrame:
    return bridge.events(spark, d).groupBy(F.col("user_id").alias("ds"), F.col("event_type").alias("m")).agg(F.round(F.avg("value"), 6).alias("v"))


@query(f"WITH {_RANKS} SELECT m, round(avg(r), 6) AS mean_rank, count(*) AS datasets FROM rk GROUP BY m")
def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return ml.average_ranks(_methods(spark, d), "ds", "m", "v").withColumn("mean_rank", F.round("mean_rank", 6))


@query("""WITH me AS (SELECT user_id AS ds, event_type AS m, round(avg(value), 6) AS v FROM ev GROUP BY ALL),
f AS (SELECT me.* FROM me WHERE m IN (SELECT m FROM (SELECT m, count(*) AS c, max(count(*)) OVER () AS most FROM me GROUP BY m) WHERE c = most)),
rk AS (SELECT *, rank() OVER (PARTITION BY ds ORDER BY v DESC) + (count(*) OVER (PARTITION BY ds, v) - 1) / CAST(2 AS DOUBLE) AS r, count(*) OVER (PARTITION BY ds, v) AS c FROM f),
a AS (SELECT m, sum(r) AS s, count(*) AS n, CAST(sum(c * c - 1) AS DOUBLE) AS t FROM rk GROUP BY m),
b AS (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(max(n) AS DOUBLE) AS n, sum(s * s) AS ss, sum(t) AS t FROM a),
c AS (SELECT k, n, (12 * ss / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))) AS chi2 FROM b)
SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(chi2, 4) AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p, exp(-chi2 / 2) * (1 + chi2 / 2) < 0.05 AS differ FROM c""")
def friedman(spark: SparkSession, d: str) -> DataFrame:
    """Five methods, so the tail of the distribution has a closed form in SQL."""
    return ml.friedman(_methods(spark, d), "ds", "m", "v").withColumn("chi2", F.round("chi2", 4)).withColumn("p", F.round("p", 6))


@query("""WITH me AS (SELECT user_id AS ds, event_type AS m, round(avg(value), 6) AS v FROM ev GROUP BY ALL),
p AS (SELECT x.m AS a, y.m AS b, x.v - y.v AS d FROM me x JOIN me y ON x.ds = y.ds AND x.m < y.m),
q AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / CAST(2 AS DOUBLE) AS r, count(*) OVER (PARTITION BY a, b, abs(d)) AS c FROM p),
s AS (SELECT a, b, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (d = 0) AS DOUBLE) AS o,
  CAST(coalesce(sum(c * c - 1) FILTER (d <> 0), 0) AS DOUBLE) AS t FROM q GROUP BY a, b)
SELECT a, b, w, CAST(n - o AS BIGINT) AS n, round((w - (n * (n + 1) - o * (o + 1)) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - o * (o + 1) * (2 * o + 1) - t / 2) / 24), 6) AS z FROM s WHERE n > o""")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return ml.wilcoxon(_methods(spark, d), "ds", "m", "v").select("a", "b", "w", "n", F.round("z", 6).alias("z"))


#: Pairs of methods with the decision of Holm's rule at 0.05: sorted by falling |z|, a pair differs if it and all before pass their bounds.
_HOLM = """me AS (SELECT user_id AS ds, event_type AS m, round(avg(value), 6) AS v FROM ev GROUP BY ALL),
p AS (SELECT x.m AS a, y.m AS b, x.v - y.v AS d FROM me x JOIN me y ON x.ds = y.ds AND x.m < y.m),
q AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / CAST(2 AS DOUBLE) AS r, count(*) OVER (PARTITION BY a, b, abs(d)) AS c FROM p),
s AS (SELECT a, b, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (d = 0) AS DOUBLE) AS o,
  CAST(coalesce(sum(c * c - 1) FILTER (d <> 0), 0) AS DOUBLE) AS t FROM q GROUP BY a, b),
zz AS (SELECT a, b, abs((w - (n * (n + 1) - o * (o + 1)) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - o * (o + 1) * (2 * o + 1) - t / 2) / 24)) AS z FROM s WHERE n > o),
bd AS (SELECT * FROM (VALUES """ + ", ".join(f"({k}, CAST({NormalDist().inv_cdf(1 - 0.025 / k)!r} AS DOUBLE))" for k in range(1, 11)) + """) t(k, bound)),
zr AS (SELECT a, b, z, row_number() OVER (ORDER BY z DESC, a, b) AS i, count(*) OVER () - row_number() OVER (ORDER BY z DESC, a, b) + 1 AS k FROM zz),
hd AS (SELECT a, b, bool_and(z >= bound) OVER (ORDER BY i) AS differ FROM zr JOIN bd ON zr.k = bd.k)"""


@query()
def wilcoxon_holm(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities and Holm's decision; SQL has no error function, so the probabilities are tested against worked values."""
    return ml.wilcoxon(_methods(spark, d), "ds", "m", "v").select("a", "b", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"), "differ")


@query(f"WITH {_HOLM} SELECT a, b, differ FROM hd")
def holm_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Which of the (up to ten) pairs of methods differ by Holm's rule."""
    return ml.wilcoxon(_methods(spark, d), "ds", "m", "v").select("a", "b", "differ")


@query(f"""WITH RECURSIVE {bridge.SQL}, {_HOLM}, ed AS (SELECT a, b FROM hd WHERE NOT differ UNION SELECT b, a FROM hd WHERE NOT differ),
nd AS (SELECT DISTINCT a AS m FROM ed),
cq AS (SELECT [m] AS c FROM nd UNION ALL SELECT list_append(c, m) FROM cq, nd WHERE m > c[len(c)] AND (SELECT count(*) FROM ed WHERE ed.a = m AND list_contains(c, ed.b)) = len(c))
SELECT array_to_string(c, ', ') AS clique, CAST(len(c) AS INTEGER) AS methods FROM cq WHERE NOT EXISTS (SELECT 1 FROM nd WHERE (SELECT count(*) FROM ed WHERE ed.a = nd.m AND list_contains(c, ed.b)) = len(c))""", shared=False)
def method_cliques(spark: SparkSession, d: str) -> DataFrame:
    """Maximal groups of methods of which no two differ."""
    pairs = ml.wilcoxon(_methods(spark, d), "ds", "m", "v").where("not differ").select(F.lit(0).alias("g"), "a", "b")
    return graph.maximal_cliques(pairs, ["g"]).select(F.array_join("clique", ", ").alias("clique"), F.size("clique").alias("methods"))


_WORD = "list_reduce(range(8), lambda v, i: 16 * v + strpos('0123456789abcdef', substr(md5('42:' || s_suppkey || ':' || idx || ':{k}'), i + 1, 1)) - 1, CAST(0 AS BIGINT))"


@query(f"""WITH x AS (SELECT s_suppkey, unnest(range(0, 300)) AS idx FROM supplier),
u AS (SELECT s_suppkey, idx, ({_WORD.format(k=1)} + CAST(0.5 AS DOUBLE)) / 4294967296 AS a, ({_WORD.format(k=2)} + CAST(0.5 AS DOUBLE)) / 4294967296 AS b, CASE WHEN idx >= 200 AND idx < 250 THEN 1 ELSE 0 END AS label FROM x)
SELECT s_suppkey, idx, round(sqrt(-2 * ln(a)) * cos(2 * pi() * b) * CASE WHEN label = 1 THEN 2.5 ELSE 0.5 END, 6) AS v, CAST(label AS INTEGER) AS label FROM u""", shared=False)
def synthetic_series(spark: SparkSession, d: str) -> DataFrame:
    """A made-up recording for each supplier."""
    return readers.synthetic_recordings(table(spark, d, "supplier"), "s_suppkey", 300).withColumn("v", F.round("v", 6))


def _alarm_stream(spark: SparkSession, d: str, least: float) -> DataFrame:
    """Alarms as they arrive: in files by time, one a batch."""
    s = table(spark, d, "events").where(F.col("value") >= least).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return streaming.in_batches(s, "ts", 3)


@query(f"""WITH a AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {12 * HOUR} THEN 1 ELSE 0 END AS nw FROM ev WHERE value >= 150),
b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM a)
SELECT user_id, min(t) AS first, count(*) AS size FROM b GROUP BY user_id, c HAVING max(t) + {12 * HOUR} < (SELECT max(t) FROM ev WHERE value >= 150)""")
def stream_session_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that the stream has closed: those whose gap has passed the last alarm seen."""
    out = streaming.drain(streaming.session_clusters(_alarm_stream(spark, d, 150.0), "user_id", "ts", "12 hours", "0 seconds"), "sessions")
    return out.select("user_id", F.unix_micros("first").alias("first"), "size")


@query(f"""SELECT (t // {24 * HOUR}) * {24 * HOUR} AS "start", count(*) AS alarms FROM ev WHERE value >= 150 GROUP BY 1 HAVING (t // {24 * HOUR} + 1) * {24 * HOUR} <= (SELECT max(t) FROM ev WHERE value >= 150)""".replace("HAVING (t // ", "HAVING (min(t) // "))
def stream_alarm_rate(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.drain(streaming.alarm_rate(_alarm_stream(spark, d, 150.0), "ts", "24 hours", "0 seconds"), "rate")
    return out.select(F.unix_micros("start").alias("start"), "alarms")


_HOLD = 48 * HOUR


@query(f"""WITH RECURSIVE {bridge.SQL}, a AS (SELECT user_id, t FROM ev WHERE value >= 60), z AS (SELECT max(t) // 1000 * 1000 AS m FROM a),
r AS (SELECT user_id, min(t) AS t FROM a GROUP BY user_id UNION ALL SELECT user_id, t FROM (SELECT r.user_id, (SELECT min(a.t) FROM a WHERE a.user_id = r.user_id AND a.t > r.t + {_HOLD}) AS t FROM r) WHERE t IS NOT NULL)
SELECT user_id, t FROM r, z WHERE t <= m""", shared=False)
def stream_refractory(spark: SparkSession, d: str) -> DataFrame:
    """Alarms that the stream has accepted by its last watermark; the same as the batch rule up to there."""
    out = streaming.drain(streaming.refractory(_alarm_stream(spark, d, 60.0), "user_id", "ts", _HOLD / 1e6, "0 seconds"), "refractory")
    return out.select("user_id", F.unix_micros("ts").alias("t"))
