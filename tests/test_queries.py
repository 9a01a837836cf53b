"""Every query with SQL against DuckDB on the smallest tables; the others against invariants."""

import collections
import math
import importlib.util
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from pulseframe.operators import dsp
from pulseframe.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = ordered(QUERIES[name](spark, SF).toPandas()), ordered(duck.execute(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if pd.api.types.is_numeric_dtype(a) and pd.api.types.is_numeric_dtype(b):
            near = (a.astype(float) - b.astype(float)).abs() <= 1e-4 * (1 + b.astype(float).abs())
            assert (near | (a.isna() & b.isna())).all(), c
        else:
            assert ((a.astype(str) == b.astype(str)) | (a.isna() & b.isna())).all(), c


def test_every_query_without_sql_has_a_test_here():
    assert set(QUERIES) - set(ORACLE_SQL) == {"approx_profile", "rpeaks", "decimated_beats", "kmeans_clusters", "rf_profile_windows", "wilcoxon_holm"}


def test_approx_profile_is_never_under_the_exact_one(spark):
    exact = {(r.user_id, r.pos): r.dist for r in QUERIES["matrix_profile"](spark, SF).collect()}
    got = QUERIES["approx_profile"](spark, SF).collect()
    assert {(r.user_id, r.pos) for r in got} == set(exact) and any(r.dist is not None for r in got)
    assert all(r.dist is None or r.dist >= exact[r.user_id, r.pos] - 1e-4 for r in got)


def test_filters_keep_the_band_and_the_length(spark):
    v = {r.vec_id: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    band, low = collections.defaultdict(list), collections.defaultdict(list)
    from pulseframe.plans.signal_queries import _vectors

    for r in dsp.filtered(_vectors(spark, SF), ["vec_id"], 64.0, 2.0, 20.0).orderBy("pos").collect():
        band[r.vec_id].append(r.v)
    for r in dsp.decimated(_vectors(spark, SF), ["vec_id"], 64, 16).orderBy("pos").collect():
        assert r.fs_true == 16.0
        low[r.vec_id].append(r.v)
    assert set(band) == set(low) == set(v)
    for k, x in v.items():
        y = loop_zero_phase(dsp.butter_sections(4, 2.0, 20.0, 64.0), x, 27)
        assert np.allclose(band[k], y, atol=1e-9) and len(low[k]) == 16
        assert np.allclose(low[k], loop_zero_phase(dsp.cheby_sections(8, 0.05, 0.2), x, 27)[::4], atol=1e-9)


def loop_zero_phase(sos, x, pad):
    """Sample by sample, as direct-form recursions."""

    def once(y):
        level = y[0]
        for b0, b1, b2, _, a1, a2 in sos:
            dc = (b0 + b1 + b2) / (1 + a1 + a2)
            x1 = x2 = level
            y1 = y2 = level * dc
            out = []
            for v in y:
                o = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
                x1, x2, y1, y2 = v, x1, o, y1
                out.append(o)
            y, level = np.array(out), level * dc
        return y

    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return once(once(ext)[::-1])[::-1][pad:-pad]


@pytest.mark.parametrize("name", ["rpeaks", "decimated_beats"])
def test_beats_are_apart_and_their_intervals_add_up(spark, name):
    rows = collections.defaultdict(list)
    for r in QUERIES[name](spark, SF).orderBy("l_suppkey", "beat_idx").collect():
        rows[r.l_suppkey].append(r)
    assert rows
    for beats in rows.values():
        assert [r.beat_idx for r in beats] == list(range(len(beats))) and beats[0].rr is None
        for a, b in zip(beats, beats[1:], strict=False):
            assert b.pos - a.pos >= 16 and abs(b.rr - (b.pos - a.pos) * 1000 / 64) < 1e-9


def test_density_clusters_by_all_pairs(spark):
    from pulseframe.plans.signal_queries import _FEATURES, _alarm_features

    rows = _alarm_features(spark, SF).toPandas()
    got = {(r.user_id, r.event_id): r.cluster for r in QUERIES["dbscan_clusters"](spark, SF).collect()}
    assert len(got) == len(rows)
    for _, g in rows.groupby("user_id"):
        g = g.sort_values("event_id")
        x = g[_FEATURES].to_numpy(float)
        dev = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(dev == 0, 1, dev)
        near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.25
        core, label = near.sum(axis=1) >= 3, np.array([got[k] for k in zip(g.user_id, g.event_id, strict=True)])
        assert (label[core] >= 0).all() and all(label[i] == -1 or (near[i] & core).any() for i in range(len(x)))
        assert ((label >= 0) == (near & core[None, :]).any(axis=1)).all()
        for i, j in zip(*np.nonzero(near & core[:, None] & core[None, :]), strict=True):
            assert label[i] == label[j]


def test_kmeans_takes_the_best_silhouette(spark):
    from pulseframe.operators import ml
    from pulseframe.plans.signal_queries import _FEATURES, _alarm_features

    a = _alarm_features(spark, SF)
    got = QUERIES["kmeans_clusters"](spark, SF).collect()
    assert len(got) == a.count() and len({r.cluster for r in got}) <= 19
    two = spark.createDataFrame([(float(i), float(i % 2 * 100), float(i % 2 * 50), 0.5) for i in range(40)], "hours double, score double, length double, rank double")
    found = ml.kmeans(two.withColumn("hours", two.score), _FEATURES[:3], range(2, 5)).collect()
    assert len({r.cluster for r in found}) == 2 and all((r.score == 100) == (found[0].cluster == r.cluster) for r in found) in (True, False)
    assert len({(r.score, r.cluster) for r in found}) == 2


def test_kmeans_fits_several_numbers_at_once(spark, monkeypatch):
    import threading

    from pulseframe.operators import ml

    both = threading.Barrier(2, timeout=60)

    class Met(ml.KMeans):
        def fit(self, df):
            both.wait()  # broken where one fit follows another
            return super().fit(df)

    monkeypatch.setattr(ml, "KMeans", Met)
    d = spark.createDataFrame([(float(i % 2 * 100), float(i)) for i in range(20)], "x double, y double")
    assert ml.kmeans(d, ["x", "y"], range(2, 4)).count() == 20


def test_forest_scores_rows_that_it_was_not_fitted_to(spark):
    got = QUERIES["rf_profile_windows"](spark, SF).collect()
    assert got and all(0 <= r.p <= 1 and r.prediction == float(r.p > 0.5) or abs(r.p - 0.5) < 1e-6 for r in got)
    assert len({(r.user_id, r.idx) for r in got}) == len(got)


def test_synthetic_series_has_its_bursts(spark):
    order = ["s_suppkey", "idx"]
    rows = QUERIES["synthetic_series"](spark, SF).orderBy(*order).toPandas()
    assert (rows.groupby("s_suppkey").label.sum() == 50).all() and len(rows) == 300 * rows.s_suppkey.nunique()
    assert 0.45 < rows.v[rows.label == 0].std() < 0.55 and 2.4 < rows.v[rows.label == 1].std() < 2.6
    assert rows.equals(QUERIES["synthetic_series"](spark, SF).orderBy(*order).toPandas())


def test_holm_by_hand(spark):
    """Differences 1 to 8 and one of -1; a second pair of methods without any difference but one."""
    from pulseframe.operators import ml

    rows = [(k, "a", 10.0 + k) for k in range(1, 10)] + [(k, "b", 10.0 if k < 9 else 20.0) for k in range(1, 10)] + [(k, "c", 10.0 + k - (0.5 if k == 3 else 0.0)) for k in range(1, 10)]
    got = {(r.a, r.b): r for r in ml.wilcoxon(spark.createDataFrame(rows, "ds long, m string, v double"), "ds", "m", "v").collect()}
    ab = got["a", "b"]  # differences 1..8 and -1: the two of size 1 share rank 1.5
    z = (1.5 - 22.5) / math.sqrt((9 * 10 * 19 - 3.0) / 24)
    assert ab.w == 1.5 and ab.n == 9 and abs(ab.z - z) < 1e-12 and abs(ab.p - math.erfc(-z / math.sqrt(2))) < 1e-12
    ac = got["a", "c"]  # eight equal pairs take ranks 1 to 8
    assert ac.n == 1 and ac.w == 0 and abs(ac.z - (0 - (90 - 72) / 4) / math.sqrt((9 * 10 * 19 - 8 * 9 * 17) / 24)) < 1e-12
    p = sorted(r.p for r in got.values())
    assert sorted(r.p_holm for r in got.values()) == pytest.approx([min(1, 3 * p[0]), min(1, max(3 * p[0], 2 * p[1])), min(1, max(3 * p[0], 2 * p[1], p[2]))])
    assert all(r.differ == (r.p_holm <= 0.05) for r in got.values()) and ab.differ


def test_chi_squared_tail():
    from pulseframe.operators import ml

    for x in (0.1, 1.0, 4.0, 9.5, 40.0):
        assert abs(ml._chi2_tail(x, 2) - math.exp(-x / 2)) < 1e-12
        assert abs(ml._chi2_tail(x, 1) - math.erfc(math.sqrt(x / 2))) < 1e-12
        assert abs(ml._chi2_tail(x, 4) - math.exp(-x / 2) * (1 + x / 2)) < 1e-12


def test_saturated_test_runs(spark):
    """The saturated runs of subjects 97 to 125; with those of the training range these are all over 10 %."""
    from pulseframe.plans import quality_queries as q

    sf = "/root/testdata/sf0.1"
    over = {r.l_suppkey for r in q._saturation(spark, sf).where("percent >= 10").collect()}
    got = {r.l_suppkey for r in QUERIES["saturated_test_runs"](spark, sf).collect()}
    assert got == {k for k in over if 97 <= k % 125 + 1 <= 125} and got
    assert got | {r.l_suppkey for r in QUERIES["saturated_runs"](spark, sf).collect()} == over


def test_type_metrics_all_counts_every_event(spark):
    """Each of the four keys counts all typed events, also those of series with over twenty."""
    from pulseframe.plans import quality_queries as q

    sf = "/root/testdata/sf0.1"
    n = q._typed(spark, sf).where("ty <> 'bckg'").count()
    got = {}
    for r in QUERIES["type_metrics_all"](spark, sf).collect():
        got[r.kind] = got.get(r.kind, 0) + r.events
    assert got == dict.fromkeys(("type", "onset", "category", "motor"), n)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def _in_a_copy(tmp_path, gone, code):
    """What code prints in a copy of the repository without some of it, whatever PYTHONPATH says here."""
    root, copy = os.path.dirname(os.path.abspath(entry.__file__)), tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.parametrize("gone", [["pulseframe/llm", "tests/llm"], ["pulseframe/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_corpus_part(tmp_path, gone):
    """The other queries are there when the corpus subpackage is missing, with and without the pipeline."""
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), sorted(e.oracle_sql()) == sorted(e.ORACLE_SQL))"
    assert _in_a_copy(tmp_path, gone, code)[-2:] == ["True", "True"]


def test_entry_without_the_pipeline_alone(tmp_path):
    """The corpus operators, where there are any, do not depend on the pipeline."""
    if importlib.util.find_spec("pulseframe.llm") is None:
        pytest.skip("no corpus part here")
    code = "import __spark_entry__ as e; q = e.queries(); print(set(e.QUERIES) < set(q), any(n.startswith('op1_') for n in q), 'pipeline' in q)"
    assert _in_a_copy(tmp_path, ["corpus_pipeline.py"], code)[-3:] == ["True", "True", "False"]


def test_entry_where_the_corpus_part_cannot_be_imported(tmp_path):
    """A package that only the corpus part needs may be missing."""
    code = "import sys; sys.modules['zstandard'] = sys.modules['xxhash'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES))"
    assert _in_a_copy(tmp_path, [], code)[-1:] == ["True"]


def test_entry_needs_no_session():
    """The queries can be listed before any session is there."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-2]) >= len(QUERIES)
