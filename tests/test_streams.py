"""Streams over several batches, out of order and restarted, against their batch counterparts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import sequence
from pulseframe.streaming import alarms

START = dt.datetime(2024, 1, 1)
SCHEMA = "k long, ts timestamp"


def rows(seed, n=120):
    r = random.Random(seed)
    return [(r.randrange(4), START + dt.timedelta(seconds=r.choice([r.randrange(4000), 600 * r.randrange(6)]), microseconds=r.choice([0, 0, 250, 999_999]))) for _ in range(n)]


def plain_refractory(found, hold):
    out = []
    for k in {k for k, _ in found}:
        last = None
        for t in sorted(t for j, t in found if j == k):
            if last is None or t > last + dt.timedelta(seconds=hold):
                out.append((k, t))
                last = t
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_refractory_over_shuffled_files_and_a_restart(spark, tmp_path, seed):
    """Five files in any order, the query stopped after two: what it accepts is what the batch rule does."""
    found, hold = rows(seed), 300
    files = [sorted(found, key=lambda r: r[1])[i::5] for i in range(4)] + [[x for i, x in enumerate(sorted(found, key=lambda r: r[1])) if i % 5 == 4]]
    random.Random(seed).shuffle(files)
    end = START + dt.timedelta(days=3)
    arrive = lambda part, name: spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    go = lambda: alarms.run_into(alarms.refractory(stream(), "k", "ts", hold, "1 day"), str(tmp_path / "out"), str(tmp_path / "progress"))
    for i, part in enumerate(files[:2]):
        arrive(part, f"a{i}")
    go()
    for i, part in enumerate([*files[2:], [(9, end)]]):  # the last moves the watermark past all others
        arrive(part, f"b{i}")
    go()
    got = sorted((r.k, r.ts) for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect() if r.k != 9)
    assert got == plain_refractory(found, hold)
    batch = sequence.refractory(spark.createDataFrame(found, SCHEMA).distinct().select("k", F.unix_micros("ts").alias("t")), ["k"], "t", hold * 1_000_000)
    assert sorted((r.k, r.t) for r in batch.collect()) == sorted((k, round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)) for k, t in got)


def test_batches_arrive_by_time(spark):
    found = rows(3)
    s = alarms.in_batches(spark.createDataFrame(found, SCHEMA), "ts", 4)
    got = alarms.drain(s, "all")
    assert sorted((r.k, r.ts) for r in got.collect()) == sorted(found)
    none = alarms.in_batches(spark.createDataFrame([], SCHEMA), "ts", 4)
    assert alarms.drain(alarms.alarm_rate(none, "ts", "1 hour", "0 seconds"), "none").count() == 0


def test_a_batch_of_several_files_is_read_at_once(spark):
    """Rows in many partitions: a trigger reads all files of a part, so the watermark passes none of its rows."""
    found, hold = sorted(set(rows(5, 4000))), 30
    df = spark.createDataFrame(found, SCHEMA).repartition(4)
    s = alarms.in_batches(df, "ts", 3, at_once=400)
    got = alarms.drain(alarms.refractory(s, "k", "ts", hold, "0 seconds"), "files")
    end = max(t for _, t in found).replace(microsecond=max(t for _, t in found).microsecond // 1000 * 1000)
    assert sorted((r.k, r.ts) for r in got.collect()) == [x for x in plain_refractory(found, hold) if x[1] <= end]
