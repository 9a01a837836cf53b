"""Hand-worked values and invariants of the engine's operators."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseframe.functions import scalars
from pulseframe.operators import clusters, dsp, graph, hrv, intervals, metrics, ml, profile, quality, segments, sequence
from pulseframe.sources import readers, sinks

RR = [800.0, 810, 790, 805, 795, 850, 700, 720, 710, 730]


@pytest.fixture(scope="module")
def rr(spark):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(RR)], "k string, i int, v double")


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def near(got, want, places=6):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (a is None and b is None) or round(a - b, places) == 0, (got, want)


@pytest.mark.parametrize(("theta", "want"), [(100, [0, 250, 500]), (150, [100, 500]), (180, [100, 500]), (250, [100])])
def test_gap_clusters(spark, theta, want):
    a = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 100, 250, 500])], "k string, e long, t long")
    r = clusters.representatives(clusters.by_gap(a, ["k"], "t", theta, "e"), ["k"], "t", "e")
    assert sorted(x.t for x in r.collect()) == want
    tr = spark.createDataFrame([("a", 1, 300, 310)], "k string, seizure long, start long, end long")
    m = intervals.first_match(r, tr, ["k"], "t", "e", "seizure", 300, 180)
    assert m.where("seizure is not null").count() == sum(t <= 490 for t in want)


def test_gap_means(spark):
    d = spark.createDataFrame([("a", i) for i in (1, 2, 3, 7, 11, 12, 22, 23)], "k string, i long")
    assert sorted(r.position for r in clusters.gap_means(d, ["k"], "i", 1, 2).collect()) == [2, 12, 22]


def test_rolling(rr):
    w = Window.partitionBy("k").orderBy("i")
    near(column(rr.withColumn("m", sequence.rolling_median(F.col("v"), w.rowsBetween(-6, 0))), "m"), [800, 805, 800, 802.5, 800, 802.5, 800, 795, 790, 730])
    p = sequence.poincare(rr, ["k"], ["i"], "v", 5)
    near(column(p, "csi"), [None] * 4 + [0.380839, 0.701810, 0.435806, 1.082291, 1.190392, 0.745356])
    near(column(p, "mod_csi"), [None] * 4 + [6.777076, 46.552811, 47.872543, 297.679347, 360.113966, 127.656948])
    near(column(sequence.central_difference_sum(rr, ["k"], ["i"], "v", 5), "hr_diff"), [None] * 4 + [35, -60, -180, -165, -160, -205])
    near(column(sequence.relative_slope(rr, ["k"], ["i"], "v", 5), "slope"), [None] * 4 + [0.001875, 0.01049383, 0.01713198, 0.03423773, 0.0397351, 0.0309973])


def series_of(spark, xs):
    return spark.createDataFrame([(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)], "k string, pos long, v double")


def plain_distances(x, m):
    """Of all windows to all others, by the definition."""
    w = profile.normalised_windows(x, m)
    d = np.sqrt(((w[:, None] - w[None]) ** 2).sum(axis=2))
    flat = np.lib.stride_tricks.sliding_window_view(x, m).std(axis=1) < 1e-5
    d[flat] = d[:, flat] = np.inf
    return d


def test_left_profile(spark):
    x = np.array([0, 1, 2, 1, 0, 1, 2, 1, 0, 5, 0, 1, 2, 1], float)
    d, _ = profile.profile(x, 4, 4, left_only=True)
    near([round(v, 6) for v in d[5:]], [0, 2.230759, 1.584943, 1.584943, 1.397343, 0], 5)
    r = profile.left_discords(series_of(spark, {"a": x}), ["k"], [4], 1).first()
    assert r.pos == 6 and abs(r.score - 0.557690) < 1e-5


def walks(seeds, n=900):
    return {str(s): np.cumsum(np.random.default_rng(s).standard_normal(n)) + 5 * np.sin(np.arange(n) / 7) for s in seeds}


def test_pruned_finds_the_best(spark, monkeypatch):
    """Score and place of the exact search on all seeds, with fewer pairs of windows compared."""
    monkeypatch.setattr(profile, "TILE", 64)
    xs, m, split = walks(range(6)), 12, 60
    d = series_of(spark, xs)
    exact, pruned = ({r.k: r for r in profile.left_discords(d, ["k"], [m], split, p, count=True).collect()} for p in (False, True))
    for k, x in xs.items():
        left = np.where(np.subtract.outer(np.arange(len(x) - m + 1), np.arange(len(x) - m + 1)) >= m, plain_distances(x, m), np.inf).min(axis=1)
        left[: max(split, m + 1)] = -1
        assert abs(exact[k].score - left.max() / (2 * np.sqrt(m))) < 1e-9 and exact[k].pos == left.argmax()
        assert (pruned[k].pos, round(pruned[k].score - exact[k].score, 9)) == (exact[k].pos, 0)
        assert pruned[k].looked < exact[k].looked


def test_range_search_finds_the_best(spark):
    """Place and score of all pairs, for series of many segments, one that repeats, a flat one and one that is too short."""
    xs = walks(range(3), 400) | {"same": np.tile([0.0, 1, 4, 2, 7, 3], 40), "flat": np.ones(60), "short": np.arange(11.0)}
    lengths = [8, 13]
    got = {(r.k, r.m): (r.score, r.pos) for r in segments.range_discords(series_of(spark, xs), ["k"], lengths, size=40).collect()}
    assert set(got) == {(k, m) for k, x in xs.items() for m in lengths if len(x) >= 2 * m}
    for (k, m), (score, pos) in got.items():
        far = plain_distances(xs[k], m)
        far[np.abs(np.subtract.outer(np.arange(len(far)), np.arange(len(far)))) < m] = np.inf
        best = np.where(np.isinf(far.min(axis=1)), -1, far.min(axis=1))
        if best.max() < 0:
            assert (score, pos) == (0.0, -1)
        else:
            assert abs(score * 2 * np.sqrt(m) - best.max()) < 1e-6 and best[pos] > best.max() - 1e-6


@pytest.mark.parametrize("offset", [0.0, 1e4, -1e6, 1e7])
def test_distances_do_not_depend_on_the_offset(spark, monkeypatch, offset):
    monkeypatch.setattr(profile, "TILE", 400)
    x = np.cumsum(np.random.default_rng(8).standard_normal(2000))
    moved = x + offset
    centred = moved - offset  # what is left of the values beside the offset
    m = 50
    want, _ = profile.profile(centred, m, 13)
    assert np.abs(profile.distance_profile(moved[100:150], moved) - profile.distance_profile(centred[100:150], centred)).max() < 1e-6
    d = series_of(spark, {"a": moved})
    got = {r.pos: r.dist for r in profile.matrix_profile(d, ["k"], m).collect()}
    assert max(abs(got[i] - want[i]) for i in range(len(want))) < 1e-6
    mass = {r.pos: r.dist for r in profile.mass(d, ["k"], 700, m).collect()}
    near_one = profile.distance_profile(centred[700:750], centred)
    assert max(abs(mass[i] - near_one[i]) for i in range(len(want))) < 1e-6
    a, b = (profile.left_discords(series_of(spark, {"a": y}), ["k"], [m], 300).first() for y in (moved, centred))
    assert a.pos == b.pos and abs(a.score - b.score) < 1e-6


def test_segments_of_a_long_series_stay_small(spark, monkeypatch):
    """200,000 values: no task gets more than pairs of segments, and the values moved are those of the pairs."""
    size, m, n = 20_000, 32, 200_000
    d = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("pos"), (F.sin(F.col("id") / 17.0) + F.cos(F.col("id") / 5.3) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1e4).alias("v"))
    cut_up = segments.segmented(d, ["k"], m, size)
    pairs = segments.paired(cut_up, ["k"], F.array(F.lit(m)), size)
    got = pairs.select("lo", "hi", F.size("values").alias("n")).collect()
    parts = -(-(n - m + 1) // size)
    assert len(got) == parts * parts and max(r.n for r in got) == size + m - 1 and len({(r.lo, r.hi) for r in got}) == parts * (parts + 1) // 2
    monkeypatch.setattr(profile, "TILE", size)
    near_ones = profile.matrix_profile(d, ["k"], m).where("pos % 9973 = 0").collect()
    x = np.array([r.v for r in d.orderBy("pos").collect()])
    for r in near_ones:
        far = profile.distance_profile(x[r.pos : r.pos + m], x)
        far[max(0, r.pos - 7) : r.pos + 8] = np.inf
        assert abs(r.dist - far.min()) < 1e-6


def test_joins_by_the_definition(spark):
    """Exclusion, sides, dimensions, flat stretches, missing values and series that are too short; for segments of all sizes."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal(150)
    x[40:60], x[100] = 2.0, np.nan
    xs = {"a": x, "b": rng.standard_normal(33), "c": np.ones(30), "d": np.arange(5.0)}
    m, d = 7, series_of(spark, xs)
    for size in (9, 50, 1000):
        for left in (False, True):
            got = {(r.k, r.pos): (r.dist, r.nn) for r in segments.joined(d, ["k"], F.array(F.lit(m)), lambda _: 3, left, size=size, longest=m).collect()}
            assert len(got) == sum(max(0, len(v) - m + 1) for v in xs.values())
            for k in "abc":
                y = xs[k]
                far = plain_distances(np.nan_to_num(y), m)
                holes = [i for i in range(len(y) - m + 1) if np.isnan(y[i : i + m]).any()]
                far[holes] = far[:, holes] = np.inf
                gap = np.subtract.outer(np.arange(len(far)), np.arange(len(far)))
                far[np.abs(gap) < 3] = np.inf
                far[(gap < 0) & left] = np.inf
                for i, row in enumerate(far):
                    if np.isfinite(row.min()):
                        assert abs(got[k, i][0] - row.min()) < 1e-7 and row[got[k, i][1]] < row.min() + 1e-7
                    else:
                        assert got[k, i] == (None, None)
    two = np.stack([rng.standard_normal(80), np.sin(np.arange(80) / 3)])
    rows = spark.createDataFrame([("a", i, [float(v) for v in two[:, i]]) for i in range(80)], "k string, pos long, v array<double>")
    far = np.sort(np.stack([plain_distances(y, m) for y in two]), axis=0)
    far[:, np.abs(np.subtract.outer(np.arange(74), np.arange(74))) < 2] = np.inf
    for size in (10, 500):
        got = {(r.pos, r.k): r.dist for r in segments.multivariate(rows.withColumnRenamed("k", "key"), ["key"], m, 2, size).collect()}
        for i in range(74):
            assert abs(got[i, 1] - far[0, i].min()) < 1e-7 and abs(got[i, 2] - far[:, i].mean(axis=0).min()) < 1e-7


def test_mass_and_constant():
    x = np.random.default_rng(3).standard_normal(200)
    want = [np.linalg.norm(profile.normalised_windows(x, 20)[5] - w) for w in profile.normalised_windows(x, 20)]
    assert np.allclose(profile.distance_profile(x[5:25], x), want, atol=1e-5)
    assert np.isinf(profile.distance_profile(np.ones(20), x)).all()


def test_percentiles_and_stats(spark):
    s = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "v double")
    near(list(s.agg(F.percentile("v", F.array(*map(F.lit, (0.05, 0.5, 0.95, 0.999)))).alias("p")).first().p), [1.2, 3, 8.8, 9.976])
    r = metrics.duration_stats(s.withColumn("g", F.lit(1)), ["g"], "v").first()
    assert (r.n, r.mean, r.median, r.range) == (5, 4.0, 3.0, 9.0)


def test_merge_intervals(spark):
    i = spark.createDataFrame([("a", 0, 100), ("a", 108, 200), ("a", 215, 300), ("a", 250, 260)], "k string, start long, end long")
    assert sorted((r.start, r.end) for r in intervals.merge(i, ["k"], 10).collect()) == [(0, 200), (215, 300)]


def test_windows(spark):
    d = spark.createDataFrame([("a", 100), ("b", 110), ("c", 7)], "k string, n long")
    w = sequence.fixed_windows(d, ["k"], "n", 40, 20, least_tail=10, whole_if_short=True)
    got = {k: [(r.start, r.end, r.kind) for r in w.where(F.col("k") == k).orderBy("window_index").collect()] for k in "abc"}
    full = [(s, s + 40, "full") for s in (0, 20, 40, 60)]
    assert got == {"a": full, "b": [*full, (100, 110, "trailing")], "c": [(0, 7, "whole")]}


def test_refractory(spark):
    d = spark.createDataFrame([("a", t) for t in (0, 60, 180, 181, 400)] + [("b", 10)], "k string, t long")
    got = sequence.refractory(d, ["k"], "t", 180).collect()
    assert sorted((r.k, r.t) for r in got) == [("a", 0), ("a", 181), ("a", 400), ("b", 10)]


def test_mask_events(spark):
    t = spark.createDataFrame([("a", 10, 20), ("a", 50, 60)], "k string, start long, end long")
    p = spark.createDataFrame([("a", 15, 18), ("a", 30, 35), ("a", 20, 25)], "k string, start long, end long")
    r = metrics.mask_events(t, p.where("start <> 20"), ["k"]).first()
    assert (r.tp, r.fn, r.fp, round(r.iou, 6)) == (1, 1, 1, round(1 / 3, 6))
    assert metrics.mask_events(t, p.where("start = 20"), ["k"]).first().tp == 0


@pytest.mark.parametrize(("rule", "want"), [("two_thirds", True), ("066", True), ("strict", False)])
def test_responder(spark, rule, want):
    c = spark.createDataFrame([(1, 3, 2, 2, 0, 1.0)], "s long, n_truth long, detected long, tp long, fp long, hours double")
    assert metrics.responders(c, "s", rule).first().responder is want


def test_islands_and_padding(spark):
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 1, 0, 0, 1, None, 1])], "k string, i long, x int")
    assert sorted((r["first"], r["last"], r.n) for r in sequence.islands(d, ["k"], ["i"], "x", "i").collect()) == [(0, 1, 2), (4, 4, 1), (6, 6, 1)]
    w = sequence.ordered(["k"], ["i"])
    assert column(d.withColumn("p", sequence.pad(F.coalesce("x", F.lit(0)), w, 1, 0)), "p") == [1, 1, 0, 1, 1, 1, 1]


def test_clusters_shrink_with_theta(spark):
    d = spark.createDataFrame([("a", i, (i * i * 7919) % 5000) for i in range(200)], "k string, e long, t long")
    sizes = [clusters.by_gap(d, ["k"], "t", t, "e").select("cluster").distinct().count() for t in (5, 20, 60)]
    assert sizes == sorted(sizes, reverse=True)


def test_score_aware(spark):
    d = spark.createDataFrame([("a", 1, 100, 9.0), ("a", 2, 130, 8.0), ("a", 3, 500, 7.0), ("a", 4, 160, 6.0)], "k string, e long, t long, s double")
    got = {r.e: r.cluster for r in clusters.score_aware(d, ["k"], "t", "s", "e", 40).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2}


def test_constant_regions(spark):
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 1, 1, 5, 6, 6, 2])], "k string, i long, v double")
    r = quality.constant_regions(d, ["k"], "i", "v", 1e-10, 3)
    assert [(x["first"], x["last"], x.n) for x in r.collect()] == [(0, 2, 3)]
    rest = quality.without_regions(d, r, ["k"], "i")
    assert column(rest, "new_position") == [0, 1, 2, 3] and column(rest, "v") == [5, 6, 6, 2]


def test_taxonomy(spark):
    names = ["sz_foc_ia_nm", "sz_foc_a_m_tonic", "sz_gen_x", "sz", "bckg", None, "sz_foc_f2b", "sz_uo_m_hyperkinetic"]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert column(d.withColumn("c", scalars.category(F.col("n"))), "c") == ["focal_impaired", "focal_aware", "generalized_other", "seizure_unclassified", "non_seizure", "unknown", "focal_bilateral", "unknown_motor"]
    assert column(d.withColumn("c", scalars.motor_class(F.col("n"))), "c") == ["non-motor", "motor", "unknown", "unknown", "unknown", "unknown", "motor", "motor"]
    assert column(d.withColumn("c", scalars.duration_bucket(F.lit(72.0))), "c")[0] == "very_long"


def test_run_ids(spark):
    d = spark.createDataFrame([(0, "sub-001_run-5_ecg.edf"), (1, "x-run-012.tsv"), (2, "nothing")], "i int, n string")
    got = column(d.withColumn("r", scalars.run_id(F.col("n"))), "r")
    assert got[:2] == ["run-05", "run-12"] and got[2].startswith("run-") and len(got[2]) == 8


def test_bandpass_keeps_its_band():
    t = np.arange(4000) / 250
    keep, drop = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 0.05 * t) + np.sin(2 * np.pi * 90 * t)
    y = dsp.bandpass(keep + drop, 250)
    assert np.abs(y[500:-500] - keep[500:-500]).max() < 0.05


def test_decimate():
    x = np.sin(2 * np.pi * np.arange(5000) / 250)
    y, rate = dsp.decimate(x, 250, 8)
    assert rate == 250 / 31 and len(y) == -(-5000 // 31) and np.abs(y[5:-5] - x[::31][5:-5]).max() < 0.06
    assert dsp.decimate(x, 250, 300)[1] == 250


def test_beats():
    fs, x = 250, np.zeros(250 * 20)
    at = np.arange(200, len(x) - 200, 200)
    for p in at:
        x[p - 6 : p + 7] += np.hanning(13)
    found = dsp.r_peaks(x + 0.01 * np.random.default_rng(0).standard_normal(len(x)), fs)
    assert len(found) == len(at) and np.abs(found - at).max() <= 2
    assert len(dsp.simple_peaks(x, 50, prominence=0.5)) == len(at)


def test_baseline_cutoff(spark):
    hour = 3600 * 1_000_000
    rows = [("a", 0, h * hour, float(h), 0) for h in range(5)] + [("a", 1, (10 + h) * hour, 10.0 + h, 0) for h in range(5)]
    d = spark.createDataFrame(rows, "k string, rec long, t long, v double, label int")
    assert hrv.baseline_cutoff(d, ["k"], "rec", "t", "v", "label").first().cutoff == 4.0 * 1.05  # half of 8 hours is the first recording
    assert hrv.baseline_cutoff(d.withColumn("v", F.lit(None).cast("double")), ["k"], "rec", "t", "v", "label").first().cutoff == 0.0


def plain_density(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core, label, k = near.sum(axis=1) >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                p = stack.pop()
                if label[p] < 0:
                    label[p] = k
                    stack += [q for q in np.flatnonzero(near[p]).tolist() if core[p] and label[q] < 0]
            k += 1
    return core, label


@pytest.mark.parametrize("dims", [1, 2, 4])
def test_density_clusters_over_many_parts(spark, dims):
    """A group whose clusters run through many parts, with copies, noise, a column without variation and missing values."""
    rng = np.random.default_rng(dims)
    line = np.stack([np.linspace(0, 40, 260)] * dims, axis=1) + rng.normal(scale=0.02, size=(260, dims))
    x = np.concatenate([line, rng.uniform(-5, 45, (60, dims)), np.repeat(line[:3], 5, axis=0)])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    eps = 0.06
    core, label = plain_density(x, eps, 4)
    rows = [("a", i, *map(float, v), 3.0) for i, v in enumerate(x)] + [("a", 1000, *[None] * dims, 3.0), ("b", 1, *[1.0] * dims, 3.0), ("b", 2, *[1.0] * dims, 3.0)]
    names = [f"c{k}" for k in range(dims)]
    d = spark.createDataFrame(rows, "k string, i long, " + ", ".join(f"{n} double" for n in [*names, "flat"])).repartition(5)
    got = {(r.k, r.i): (r.core, r.cluster) for r in graph.density_clusters(d, ["k"], [*names, "flat"], "i", eps, 4, cells=3).collect()}
    assert [got["a", i] for i in range(len(x))] == list(zip(core.tolist(), label.tolist(), strict=True))
    assert got["a", 1000] == got["b", 1] == got["b", 2] == (False, -1) and len(got) == len(rows) and (label == 0).sum() > 50


def test_cliques(spark):
    rng = np.random.default_rng(1)
    edges = [(g, int(a), int(b)) for g in range(4) for a in range(9) for b in range(a) if rng.random() < 0.2 + 0.2 * g] + [(9, 1, 1)]
    got = {}
    for r in graph.maximal_cliques(spark.createDataFrame(edges, "g long, a long, b long"), ["g"]).collect():
        got.setdefault(r.g, []).append(tuple(r.clique))
    for g in range(4):
        linked = {frozenset(e[1:]) for e in edges if e[0] == g}
        full = [set(c) for k in range(2, 10) for c in combinations(range(9), k) if all(frozenset(p) in linked for p in combinations(c, 2))]
        assert sorted(got.get(g, [])) == sorted(tuple(sorted(c)) for c in full if not any(c < o for o in full))
    assert 9 not in got


def test_greedy_peaks():
    s = np.array([1, 9, 8, 1, 7, np.nan, 6.0])
    assert profile.greedy_peaks(s, 2, 5) == [1, 4, 6] and profile.greedy_peaks(s, 2, 5, strict=False) == [1, 4]


def test_optimal_thresholds(spark):
    c = spark.createDataFrame([(0.1, 0.9, 9.0), (0.2, 0.9, 5.0), (0.3, 0.2, 0.1), (0.4, 0.0, 0.0)], "threshold double, sensitivity double, fa_per_hour double")
    got = {r.aim: r.threshold for r in metrics.optimal_thresholds(c).collect()}
    assert got == {"sensitivity": 0.1, "fewest_false_alarms": 0.3, "challenge": 0.2}


def edf_bytes():
    head = "0".ljust(8) + "p".ljust(80) + "r".ljust(80) + "01.01.0001.01.01" + "512".ljust(8) + "".ljust(44) + "2".ljust(8) + "1".ljust(8) + "1".ljust(4)
    sig = "ECG".ljust(16) + "".ljust(80) + "mV".ljust(8) + "-1".ljust(8) + "1".ljust(8) + "-100".ljust(8) + "100".ljust(8) + "".ljust(80) + "4".ljust(8) + "".ljust(32)
    return (head + sig).encode() + np.array([-100, 0, 50, 100, 100, 50, 0, -100], "<i2").tobytes()


def test_edf(spark, tmp_path):
    f = tmp_path / "sub-001" / "ses-01" / "ecg"
    f.mkdir(parents=True)
    (f / "sub-001_ses-01_run-02_ecg.edf").write_bytes(edf_bytes())
    (f / "broken.edf").write_bytes(b"no")
    r = readers.edf(spark, str(tmp_path)).first()
    assert r.v == [-1, 0, 0.5, 1, 1, 0.5, 0, -1] and r.fs == 4 and r.channel == "ECG"
    assert {(x.subject_id, x.run_id, x.modality) for x in readers.discover(spark, str(tmp_path), "sub*.edf").collect()} == {("sub-001", "run-02", "ecg")}


def large_edf(path, signals, records, filled):
    """A file of any size whose records are holes but for those filled: {(record, signal): samples}."""
    width = sum(2 * per for _, per in signals)
    head = "0".ljust(8) + " " * 160 + "01.01.0001.01.01" + str(256 * (len(signals) + 1)).ljust(8) + "".ljust(44) + str(records).ljust(8) + "1".ljust(8) + str(len(signals)).ljust(4)
    for wide, of in ((16, lambda s: s[0]), (80, lambda s: ""), (8, lambda s: "mV"), (8, lambda s: "-2"), (8, lambda s: "2"), (8, lambda s: "-1000"), (8, lambda s: "1000"), (80, lambda s: ""), (8, lambda s: str(s[1])), (32, lambda s: "")):
        head += "".join(of(s).ljust(wide) for s in signals)
    with open(path, "wb") as f:
        f.write(head.encode())
        f.truncate(len(head) + records * width)
        for (r, k), samples in filled.items():
            f.seek(len(head) + r * width + sum(2 * per for _, per in signals[:k]))
            f.write(np.array(samples, "<i2").tobytes())


def test_recordings_above_two_gigabytes(spark, tmp_path):
    """A channel of a recording of 2.4 GB is read by many tasks, and the bytes of the others are not."""
    large_edf(tmp_path / "long.edf", [("EEG", 600_000), ("ECG", 2)], 2000, {(0, 1): [500, 0], (1999, 1): [250, -1000]})
    d = readers.edf(spark, str(tmp_path), ["ECG"])
    assert (tmp_path / "long.edf").stat().st_size > 2**31 and d.rdd.getNumPartitions() > 20
    v = {r.start_idx + i: x for r in d.collect() for i, x in enumerate(r.v)}
    assert len(v) == 4000 and {i: x for i, x in v.items() if x} == {0: 1.0, 3998: 0.5, 3999: -2.0}
    assert readers.edf(spark, str(tmp_path)).where("channel = 'ECG' and start_idx > 3000").count() == d.where("start_idx > 3000").count()


def test_ranges_of_records_hold_the_whole_recording(spark, tmp_path):
    rng = np.random.default_rng(6)
    signals, filled = [("A", 7), ("B", 3), ("A", 50)], {}
    for r in range(40):
        for k, (_, per) in enumerate(signals):
            filled[r, k] = rng.integers(-1000, 1000, per)
    large_edf(tmp_path / "x.edf", signals, 40, filled)
    (tmp_path / "broken.edf").write_bytes(b"0".ljust(8) + b" " * 90)
    (tmp_path / "empty.edf").write_bytes(b"")
    for size, chunk in ((1 << 20, 1 << 16), (1 << 20, 11), (500, 64), (1, 5)):
        got = {}
        for r in readers.edf(spark, str(tmp_path), chunk=chunk, partition_bytes=size).collect():
            got.setdefault(r.channel_index, {}).update({r.start_idx + i: x for i, x in enumerate(r.v)})
            assert len(r.v) <= chunk and r.fs == signals[r.channel_index][1]
        for k in range(3):
            want = np.concatenate([filled[r, k] for r in range(40)]) * 0.002
            assert np.allclose([got[k][i] for i in range(len(want))], want) and len(got[k]) == len(want)
    assert {r.channel_index for r in readers.edf(spark, str(tmp_path), primary=1).collect()} == {1} and {r.channel_index for r in readers.edf(spark, str(tmp_path), primary=9).collect()} == {0}
    some = readers.edf(spark, str(tmp_path)).where("channel in ('A') and v[0] < 100")
    assert {r.channel for r in some.collect()} == {"A"} and readers.edf(spark, str(tmp_path), ["B"]).where("channel = 'A'").count() == 0


def test_annotations(spark, tmp_path):
    f = tmp_path / "sub-001" / "ses-01" / "eeg"
    f.mkdir(parents=True)
    head = "onset\tduration\teventType\tlateralization\tlocalization\tvigilance\tconfidence\tchannels\tdateTime\trecordingDuration\n"
    rows = ["23059.00\t6.00\timpd\tn/a\tn/a\tn/a\tn/a\tn/a\t2000-01-01 00:00:00\t64979.00\n", "57975.00\t72.00\tsz_foc_ia_nm\tleft\ttemp\tasleep\tn/a\tn/a\t2000-01-01 00:00:00\t64979.00\n", "1.00\t2.00\tsz\tn/a\tn/a\tn/a\tn/a\tn/a\t2000-01-01 00:00:00\t64979.00\n"]
    (f / "sub-001_ses-01_task-szMonitoring_run-03_events.tsv").write_text(head + "".join(rows))
    a = readers.annotations(spark, str(tmp_path))
    assert sorted(r.event_type for r in a.collect()) == ["sz", "sz_foc_ia_nm"]
    one = readers.annotations(spark, str(tmp_path), seizures_only=True).first()
    assert (one.onset_s, one.end_s, one.subject_id, one.run_id, one.confidence) == (57975.0, 58047.0, "sub-001", "run-03", None)
    assert readers.recording_durations(spark, str(tmp_path)).first().duration_s == 64979.0


def test_result_documents(spark, tmp_path):
    a = spark.createDataFrame([("sub-001", "run-01", 0, 0.0, 1, 80, 0.9, 12, 1.5), ("sub-001", "run-01", 1, 1800.0, 1, 80, 0.5, 8, 1.0)], "subject_id string, run_id string, window_index int, window_start_time double, rank int, m_value int, score double, loc_sample long, loc_time double")
    sinks.write_documents(sinks.result_documents(a), str(tmp_path / "docs"))
    back = readers.anomalies_of(readers.results(spark, str(tmp_path / "docs"), "part-*"))
    assert sorted((r.window_index, r.score, r.abs_time) for r in back.collect()) == [(0, 0.9, 1.5), (1, 0.5, 1801.0)]


def test_checkpoint_of_work(spark, tmp_path):
    done = str(tmp_path / "done")
    work = spark.range(5)
    assert sinks.remaining(work, sinks.finished(spark, done, "id long"), ["id"]).count() == 5
    sinks.append(work.where("id < 3"), done)
    assert sorted(r.id for r in sinks.remaining(work, sinks.finished(spark, done, "id long"), ["id"]).collect()) == [3, 4]


def test_windowed_problems(spark):
    good = spark.createDataFrame([], readers.WINDOWED)
    assert readers.windowed_problems(good).count() == 0
    assert {r.column for r in readers.windowed_problems(good.drop("samples").withColumn("run_id", F.lit(1))).collect()} == {"samples", "run_id"}


def test_samples_and_lists(spark, tmp_path):
    f = spark.createDataFrame([(f"p{i}",) for i in range(10)], "path string")
    a, b = readers.sample_files(f, 0.25).collect(), readers.sample_files(f, 0.25).collect()
    assert len(a) == 3 and a == b
    (tmp_path / "list.txt").write_text("x/ecg/a_ecg.edf\nx/eeg/a_eeg.edf\nx/eeg/a_events.tsv\n")
    assert readers.download_list(spark, str(tmp_path / "list.txt")).count() == 2


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, e long, t long")
    assert clusters.representatives(clusters.by_gap(e, ["k"], "t", 5, "e"), ["k"], "t", "e").count() == 0
    assert sequence.refractory(e.select("k", "t"), ["k"], "t", 5).count() == 0
    i = spark.createDataFrame([], "k string, start long, end long")
    assert intervals.merge(i, ["k"]).count() == 0 and metrics.mask_events(i, i, ["k"]).count() == 0


def test_long_series_are_searched_in_tiles(spark, monkeypatch):
    """Several tiles give what one gives."""
    rng = np.random.default_rng(3)
    rows = [("a", rng.standard_normal(300).tolist()), ("b", rng.standard_normal(61).tolist()), ("c", [1.0] * 20)]
    d = spark.createDataFrame(rows, "k string, values array<double>")
    want = {(r.k, r.pos): (r.dist, r.nn) for r in profile.matrix_profile(d, ["k"], 8).collect()}
    best = {(r.k, r.m): (r.score, r.pos) for r in profile.left_discords(d, ["k"], [6, 9], 20).collect()}
    monkeypatch.setattr(profile, "TILE", 37)
    got = {(r.k, r.pos): (r.dist, r.nn) for r in profile.matrix_profile(d, ["k"], 8).collect()}
    assert {k: nn for k, (_, nn) in got.items()} == {k: nn for k, (_, nn) in want.items()} and len(want) == 293 + 54 + 13
    assert all(v == w or abs(v - w) < 1e-9 for v, w in ((got[k][0], want[k][0]) for k in want))
    for (k, m), (score, pos) in {(r.k, r.m): (r.score, r.pos) for r in profile.left_discords(d, ["k"], [6, 9], 20).collect()}.items():
        assert abs(score - best[k, m][0]) < 1e-9 and pos == best[k, m][1]


def test_exact_percentiles_from_ranges(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.standard_normal(500), np.full(400, 0.25), [7.0]])
    d = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.777, 0.95, 1.0]
    got = {r.share: r.percentile for r in metrics.percentiles(d, "v", shares, buckets=7).collect()}
    low = {r.share: r.percentile for r in metrics.percentiles(d, "v", shares, buckets=7, lower=True).collect()}
    for s in shares:
        assert abs(got[s] - np.quantile(v, s)) < 1e-12 and low[s] == np.sort(v)[int(s * (len(v) - 1))]
    assert metrics.percentiles(d.limit(0), "v", shares).count() == 0


def test_overlaps_by_bucket_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    make = lambda n: [(int(k), int(s), int(s + w)) for k, s, w in zip(rng.integers(0, 3, n), rng.integers(-200, 900, n), rng.integers(0, 300, n), strict=True)]
    a, b = make(70), make(60)
    frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, k long, start long, end long")
    got = sorted((r.i, r.i_b) for r in intervals.overlaps(frame(a), frame(b), ["k"], 50).collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


def test_sweep_is_clustering_for_each_gap(spark):
    rng = np.random.default_rng(6)
    rows = [(int(u), i, int(t)) for i, (u, t) in enumerate(zip(rng.integers(0, 4, 120), rng.integers(0, 400, 120), strict=True))]
    d = spark.createDataFrame(rows, "user_id long, event_id long, t long")
    gaps = [0, 2, 5, 11, 400]
    got = {(r.setting, r.user_id, r.event_id, r["size"], r.span) for r in clusters.sweep(d.withColumn("g", F.array(*[F.lit(g) for g in gaps])), ["user_id"], "t", "event_id", "g").collect()}
    want = set()
    for k, g in enumerate(gaps):
        for r in clusters.representatives(clusters.by_gap(d, ["user_id"], "t", g, "event_id"), ["user_id"], "t", "event_id").collect():
            want.add((k, r.user_id, r.event_id, r["size"], r.span))
    assert got == want


def test_lists_and_scans_by_file_name(spark, tmp_path):
    d = spark.range(4).withColumnRenamed("id", "v")
    for name in ("profile_01", "other_02"):
        d.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert {r.file for r in readers.profiles(spark, str(tmp_path), "profile_").select("file").collect()} == {"profile_01.parquet"}
    (tmp_path / "s").mkdir()
    for name in ("run_07_windowed", "run_08"):
        d.toPandas().to_parquet(tmp_path / "s" / f"{name}.parquet")
    assert {(r.id, r.windowed) for r in readers.scores(spark, str(tmp_path / "s")).collect()} == {(7, True), (8, False)}
    assert {r.id for r in readers.scores(spark, str(tmp_path / "s"), windowed=False).collect()} == {8}
    (tmp_path / "list.csv").write_text("run,x\n a ,1\nb,2\na,3\n,4\n")
    assert {r.run for r in readers.file_list(spark, str(tmp_path / "list.csv"), "run").collect()} == {"a", "b"}


@pytest.mark.parametrize("n_fft", [4, 8, 16])
def test_short_time_transform_goes_back(n_fft):
    x = np.random.default_rng(n_fft).standard_normal(64)
    assert np.allclose(dsp.istft(dsp.stft(x, n_fft), n_fft), x)


def test_windows_that_are_each_others_nearest_tie_exactly():
    """A pair's distance is one number for both of its windows, in a segment and across two."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        dims = [segments.Windows(x, 8) for x in rng.normal(size=(2, 60)).round(2) * 40]
        _, best = segments.nearest_of_many(dims, dims, 0, 2, True)
        values = best[0].tolist()
        assert min(values) in [v for v in values if values.count(v) == 2]
        for v in best:  # no two windows are apart by rounding alone
            steps = np.diff(np.sort(v))
            assert not ((steps > 0) & (steps < 1e-10)).any()


def test_ranks_of_few_large_groups_by_ranges(spark):
    """One group goes over several ranges of its order, none of which holds it; nulls come last."""
    rows = [("a", float(k), 1 + k % 3) for k in range(400)] + [("b", 5.0, 7), ("b", 1.0, 2), ("b", None, 4)]
    d = spark.createDataFrame(rows, "g string, x double, c long").repartition(3)
    out = ml._before(d, ["g"], "x", "c")
    got = {(r.g, r.x): r._before for r in out.collect()}
    want, total = {}, {}
    for g, x, c in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0.0)):
        want[g, x], total[g] = total.get(g, 0), total.get(g, 0) + c
    assert got == want
    sizes = [r["count"] for r in out.where("g = 'a'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 400


def test_equal_left_discords_go_to_the_earlier_window(spark):
    """Windows 36 and 37 hold the same values turned by one, as do their nearest; times 1.1 rounding alone put 37 first."""
    x = [46, 42, 39, 19, 7, 39, 15, 40, 2, 43, 47, 43, 34, 35, 31, 9, 36, 1, 41, 23, 32, 9, 36, 8, 46, 1, 46, 18, 3, 20, 15, 12, 46, 32, 32, 5, 20, 17, 44, 31, 13, 29, 33, 25, 20, 49]
    d = series_of(spark, {"a": np.array(x) * 1.0, "b": np.array(x) * 1.1})
    for pruned in (True, False):
        assert {(r.k, r.pos) for r in segments.left_discords(d, ["k"], [8], 30, pruned).collect()} == {("a", 36), ("b", 36)}


def test_dense_parts_give_one_link_for_each_core_point(spark, monkeypatch):
    """Points that are all near each other are not linked pair by pair, and parts that are searched together stay apart."""
    found, whole = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: found.append(edges.count()) or whole(edges))
    monkeypatch.setattr(graph, "PAIRS", 50)
    rows = [(k, i, i * 1e-4 + (1000.0 if i >= 30 else 0.0)) for k in range(3) for i in range(60)]
    got = graph.density_clusters(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], ["x"], "i", 0.5, 3).collect()
    assert {(r.k, r.i, r.core, r.cluster) for r in got} == {(k, i, True, int(i >= 30)) for k in range(3) for i in range(60)}
    assert found[0] <= 180


def test_sweep_hits_counts_what_sweep_finds(spark):
    import random

    from pulseframe.operators import clusters

    r = random.Random(1)
    rows = [(k, r.randrange(30), r.randrange(400), r.random() < 0.4, [3.0, 7.5 + k % 3, 50.0]) for k in range(60) for _ in range(r.randrange(1, 25))]
    d = spark.createDataFrame(rows, "k long, e long, t long, hit boolean, gaps array<double>")
    hits = {(k, e, t): h for k, e, t, h, _ in sorted(rows)}
    d = d.dropDuplicates(["k", "e", "t"]).drop("hit").join(spark.createDataFrame([(*x, h) for x, h in hits.items()], "k long, e long, t long, hit boolean"), ["k", "e", "t"])
    want = {}
    for x in clusters.sweep(d, ["k"], "t", "e", "gaps").collect():
        every, true = want.setdefault((x.setting, x.k), (set(), set()))
        every.add(x.e)
        if hits[x.k, x.e, x.t]:
            true.add(x.e)
    got = {(x.setting, x.k): (x.clusters, x.tp) for x in clusters.sweep_hits(d, ["k"], "t", "e", "gaps", "hit").collect()}
    assert got == {x: (len(a), len(b)) for x, (a, b) in want.items()}
