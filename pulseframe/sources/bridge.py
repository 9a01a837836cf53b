"""The engine's inputs read from the star-schema test tables.

A series is one user's events in the order (ts, event_id); time is whole microseconds, so that differences, sums and
comparisons are exact; ``error`` events are the annotated onsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
#: Defaults of the queries: score of an alarm, length of an annotated interval, margins around it, cluster gap.
ALARM, LENGTH, PRE, POST, THETA = 150.0, 6 * HOUR, 2 * HOUR, HOUR, 12 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, subject (1 to 125), event_id, t, value, event_type, props."""
    return table(spark, sf_dir, "events").select(
        "user_id", (F.col("user_id") % 125 + 1).alias("subject"), "event_id", micros(F.col("ts")).alias("t"), "value", "event_type", "props"
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with idx, the position in the user's series from 0."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    return events(spark, sf_dir).withColumn("idx", F.row_number().over(order).cast("long") - 1)


def alarms(spark: SparkSession, sf_dir: str, at_least: float = ALARM) -> DataFrame:
    """user_id, subject, event_id, t, score."""
    return events(spark, sf_dir).where(F.col("value") >= at_least).select("user_id", "subject", "event_id", "t", F.col("value").alias("score"))


def truth(spark: SparkSession, sf_dir: str, length: int = LENGTH) -> DataFrame:
    """user_id, subject, seizure (ordinal), start, end."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, sf_dir).where("event_type = 'error'")
    return e.select("user_id", "subject", F.row_number().over(order).cast("long").alias("seizure"), F.col("t").alias("start"), (F.col("t") + length).alias("end"))


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, subject, hours of recording."""
    return events(spark, sf_dir).groupBy("user_id", "subject").agg(((F.max("t") - F.min("t")) / float(HOUR)).alias("hours"))


#: The same inputs in SQL, to be put after WITH.
SQL = f"""ev AS (
  SELECT user_id, user_id % 125 + 1 AS subject, event_id, epoch_us(ts) AS t, value, event_type, props FROM events),
se AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS idx FROM ev),
al AS (SELECT user_id, subject, event_id, t, value AS score FROM ev WHERE value >= {ALARM}),
tr AS (
  SELECT user_id, subject, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS seizure, t AS "start", t + {LENGTH} AS "end"
  FROM ev WHERE event_type = 'error'),
hr AS (SELECT user_id, subject, (max(t) - min(t)) / CAST({HOUR} AS DOUBLE) AS hours FROM ev GROUP BY user_id, subject)"""
