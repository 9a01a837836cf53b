"""Scans: annotation tables, sidecars, signal files, windowed recordings, result documents, lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions.scalars import run_id
from . import edf as edf_source

ANNOTATION = "onset double, duration double, eventType string, lateralization string, localization string, vigilance string, confidence string, channels string, dateTime timestamp, recordingDuration double"
SIDECAR = (
    "ECGReference string, SamplingFrequency int, PowerLineFrequency string, SoftwareFilters string, ECGChannelCount int, ECGMontage string, ECGPlacementScheme string, "
    "HardwareFilters string, RecordingType string, RecordingDuration double, TaskName string, TaskDescription string, InstitutionName string"
)
ANOMALY = "rank int, window_index int, m_value int, anomaly_score double, location_sample_in_window bigint, location_time_in_window double, normalized_score double, confidence double, anomaly_id string"
RESULT = (
    "input_data struct<subject_id string, run_id string, seizure_id string, signal_metadata struct<sampling_rate double, num_windows int, total_duration_seconds double>>, "
    f"analysis_results struct<window_results array<struct<window_index int, window_start_time double, window_duration double, anomalies array<struct<{ANOMALY.replace(' string', ': string').replace(' int', ': int').replace(' double', ': double').replace(' bigint', ': bigint')}>>>>>, "
    "validation_data struct<ground_truth struct<seizure_present boolean, total_windows int, seizure_windows array<struct<window_index int, window_start_time double, seizure_segments array<struct<start_time_absolute double, end_time_absolute double>>>>>>"
)
WINDOWED = (
    "subject_id string, run_id string, channel string, window_index int, start_idx bigint, end_idx bigint, start_time double, end_time double, window_label int, "
    "n_seizure_samples int, seizure_ratio double, samples array<double>"
)


def with_ids(df: DataFrame, path: Column) -> DataFrame:
    """subject_id, session and run_id from a path of the form sub-*/ses-*/..."""
    return df.withColumn("subject_id", F.regexp_extract(path, r"(sub-\d+)", 1)).withColumn("session", F.regexp_extract(path, r"(ses-\d+)", 1)).withColumn("run_id", run_id(F.regexp_extract(path, r"([^/]+)$", 1)))


def discover(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: path, bytes, subject_id, session, run_id, modality; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("bytes"))
    return with_ids(f, F.col("path")).withColumn("modality", F.regexp_extract("path", r"/(ecg|eeg|emg|mov)/", 1))


def annotations(spark: SparkSession, path: str, seizures_only: bool = False) -> DataFrame:
    """Interval annotations with subject and run; without background and impedance rows, or of names with ``sz_`` only."""
    d = spark.read.schema(ANNOTATION).option("recursiveFileLookup", True).option("pathGlobFilter", "*_events.tsv").csv(path, sep="\t", header=True, nullValue="n/a", timestampFormat="yyyy-MM-dd HH:mm:ss", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    d = with_ids(d.withColumn("_path", F.col("_metadata.file_path")), F.col("_path"))
    kept = F.col("eventType").startswith("sz_") if seizures_only else ~F.coalesce(F.col("eventType"), F.lit("")).isin("bckg", "impd")
    return d.where(kept).select(
        "subject_id", "run_id", F.col("onset").alias("onset_s"), F.col("duration").alias("duration_s"), (F.col("onset") + F.col("duration")).alias("end_s"), F.col("eventType").alias("event_type"),
        "lateralization", "localization", "vigilance", "confidence", "channels", F.col("dateTime").alias("date_time"), F.col("recordingDuration").alias("recording_duration_s"),
    )


def recording_durations(spark: SparkSession, path: str) -> DataFrame:
    """subject_id, run_id, duration_s: the duration that each annotation file states."""
    d = spark.read.schema(ANNOTATION).option("recursiveFileLookup", True).option("pathGlobFilter", "*_events.tsv").csv(path, sep="\t", header=True, nullValue="n/a")
    d = with_ids(d.withColumn("_path", F.col("_metadata.file_path")), F.col("_path"))
    return d.groupBy("subject_id", "run_id").agg(F.max("recordingDuration").alias("duration_s"))


def sidecars(spark: SparkSession, path: str, pattern: str = "*_ecg.json") -> DataFrame:
    d = spark.read.schema(SIDECAR).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return with_ids(d.withColumn("_path", F.col("_metadata.file_path")), F.col("_path")).drop("_path")


def results(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Result documents, as nested rows."""
    return spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)


def anomalies_of(docs: DataFrame) -> DataFrame:
    """A row for each anomaly of nested result documents, with its absolute time."""
    w = docs.select("input_data.subject_id", "input_data.run_id", F.explode("analysis_results.window_results").alias("w"))
    a = w.select("subject_id", "run_id", F.col("w.window_index").alias("window_index"), F.col("w.window_start_time").alias("window_start_time"), F.explode("w.anomalies").alias("a"))
    return a.select(
        "subject_id", "run_id", "window_index", "window_start_time", F.col("a.rank").alias("rank"), F.col("a.m_value").alias("m_value"), F.col("a.anomaly_score").alias("score"),
        F.col("a.location_sample_in_window").alias("loc_sample"), F.col("a.location_time_in_window").alias("loc_time"), (F.col("window_start_time") + F.col("a.location_time_in_window")).alias("abs_time"),
    )


def windowed(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Windowed recordings; unreadable files are passed over."""
    d = spark.read.schema(WINDOWED).option("ignoreCorruptFiles", True).parquet(path)
    return d if most is None else d.join(F.broadcast(d.select("subject_id", "run_id").distinct().orderBy("subject_id", "run_id").limit(most)), ["subject_id", "run_id"])


def windowed_problems(df: DataFrame) -> DataFrame:
    """(column, reason) for each way in which a table is not a windowed recording; no row if it is."""
    want = T._parse_datatype_string(WINDOWED)
    have = {f.name: f.dataType for f in df.schema}
    rows = [(f.name, "missing" if f.name not in have else f"{have[f.name].simpleString()} instead of {f.dataType.simpleString()}") for f in want if have.get(f.name) != f.dataType]
    return df.sparkSession.createDataFrame(rows, "column string, reason string")


# Parameters that tell that a recording was cut into windows.
WINDOW_PARAMETERS = ["window_size", "stride", "overlap", "windowing", "min_window_size"]


def windowed_method() -> Column:
    """The first sign by which a row is known to be a windowed recording; null if it has none.

    For columns windows (arrays of samples), preprocessing_params, metadata (a map for each window), n_windows, processed_fs.
    """
    p, meta, n = F.col("preprocessing_params"), F.get("metadata", F.lit(0)), F.size("windows")
    has = lambda m, k: F.coalesce(F.map_contains_key(m, k), F.lit(False))
    true = lambda m, k: F.coalesce(F.lower(F.element_at(m, k)) == "true", F.lit(False))
    any_parameter = has(p, WINDOW_PARAMETERS[0])
    for k in WINDOW_PARAMETERS[1:]:
        any_parameter = any_parameter | has(p, k)
    minutes = F.size(F.get("windows", F.lit(0))) / (F.coalesce("processed_fs", F.lit(32.0)) * 60)
    sign = (
        F.when(has(p, "window_size") & has(p, "stride"), "window_size and stride").when(n > 1, "several windows").when(true(p, "flexible_windowing"), "flexible_windowing").when(any_parameter, "window parameter")
        .when((n >= 1) & has(meta, "start_time") & has(meta, "end_time"), "window times").when((n >= 1) & true(meta, "is_flexible_window"), "flexible window")
        .when(F.col("n_windows") >= 1, "n_windows").when((n >= 1) & minutes.between(1, 120), "duration")
    )
    return F.when(F.col("windows").isNotNull(), sign)


def profiles(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Stored profiles whose file name begins with prefix, with the name as ``file``."""
    d = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    return d.where(F.col("file").startswith(prefix))


def scores(spark: SparkSession, path: str, windowed: bool | None = None) -> DataFrame:
    """Stored scores with the number in their file's name as ``id``; of windowed recordings, of others, or of all."""
    d = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_name"))
    d = d.withColumn("id", F.regexp_extract("_file", r"(\d+)", 1).cast("long")).withColumn("windowed", F.lower("_file").contains("windowed"))
    return (d if windowed is None else d.where(F.col("windowed") == windowed)).drop("_file")


def file_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The distinct values of one column of a list of files, from CSV with a header or from Parquet."""
    d = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return d.select(F.trim(F.col(column).cast("string")).alias(column)).where(F.length(column) > 0).distinct()


def sample_files(files: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Exactly ceil(share * n) files, the same ones each time."""
    n = files.count()
    return files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(int(np.ceil(share * n)))


def download_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a download list that name electrocardiograms or events, or no modality at all."""
    return spark.read.text(path).where(~F.lower("value").rlike(r"/(eeg|emg|mov)/[^/]*_(eeg|emg|mov)\."))


def edf(spark: SparkSession, path: str, channels: list[str] | None = None, primary: int | None = None, chunk: int = 1 << 16, partition_bytes: int | None = None) -> DataFrame:
    """Signals of all EDF files below a path, in physical units and in chunks of samples; files that are no EDF give no rows.

    A recording is read by ranges of its records (see sources.edf); a range ends with a shorter chunk.
    """
    edf_source.register(spark)
    read = spark.read.format(edf_source.NAME).option("chunk", chunk)
    if channels:
        read = read.option("channels", "\n".join(channels))
    if primary is not None:
        read = read.option("primary", primary)
    if partition_bytes:
        read = read.option("partitionBytes", partition_bytes)
    return read.load(path)


#: Stretches of a made-up series in which it varies more.
BURSTS = ((200, 250), (500, 580), (750, 800))


def synthetic(spark: SparkSession, n: int = 1000, seed: int = 42, bursts: tuple[tuple[int, int], ...] = BURSTS) -> DataFrame:
    """idx, v, label: noise of deviation 0.5 with bursts of deviation 2.5."""
    return spark.range(n).select(F.col("id").alias("idx"), *_noise(F.col("id"), F.lit(str(seed)), bursts))


def synthetic_recordings(series: DataFrame, key: str, n: int = 1000, seed: int = 42, bursts: tuple[tuple[int, int], ...] = BURSTS) -> DataFrame:
    """key, idx, v, label: such a series for each row of a table, by its key and the seed."""
    rows = series.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("idx"))
    return rows.select(key, "idx", *_noise(F.col("idx"), F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), bursts))


def _noise(at: Column, seed: Column, bursts: tuple[tuple[int, int], ...]) -> list[Column]:
    inside = F.lit(False)
    for a, b in bursts:
        inside = inside | ((at >= a) & (at < b))
    word = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", seed, at.cast("string"), F.lit(str(k))).cast("binary")), 1, 8), 16, 10).cast("double")
    u = lambda k: (word(k) + 0.5) / float(1 << 32)
    noise = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    return [(noise * F.when(inside, 2.5).otherwise(0.5)).alias("v"), inside.cast("int").alias("label")]
