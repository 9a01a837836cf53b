"""Sinks: recordings, result documents, append logs, checkpoints of finished keys, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_recordings(df: DataFrame, path: str) -> None:
    """A folder a subject, so a subject's scan reads its own files only."""
    df.write.mode("overwrite").partitionBy("subject_id").parquet(path)


def result_documents(anomalies: DataFrame) -> DataFrame:
    """A JSON document for each (subject, run): its windows with their anomalies in rank order."""
    one = F.struct("rank", "m_value", F.col("score").alias("anomaly_score"), F.col("loc_sample").alias("location_sample_in_window"), F.col("loc_time").alias("location_time_in_window"))
    w = anomalies.groupBy("subject_id", "run_id", "window_index", "window_start_time").agg(F.array_sort(F.collect_list(one)).alias("anomalies"))
    r = w.groupBy("subject_id", "run_id").agg(F.array_sort(F.collect_list(F.struct("window_index", "window_start_time", "anomalies"))).alias("window_results"))
    return r.select("subject_id", "run_id", F.to_json(F.struct(F.struct("subject_id", "run_id").alias("input_data"), F.struct("window_results").alias("analysis_results"))).alias("value"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select("value").write.mode("overwrite").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def remaining(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work that is not done yet."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def finished(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table of finished keys, empty before the first one was appended."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def with_trailing_window(windows: DataFrame, trailing: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """All windows, and each recording's totals counted again."""
    every = windows.unionByName(trailing)
    return every, every.groupBy(*key).agg(F.count("*").alias("n_windows"), F.sum((F.col("window_label") > 0).cast("int")).alias("n_seizure_windows"))


def write_summary(df: DataFrame, path: str) -> None:
    """One CSV file; for summaries, which have a few rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def report_lines(df: DataFrame) -> DataFrame:
    """A summary as text, a line a row: name=value, ..."""
    return df.select(F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in df.columns]).alias("line"))
