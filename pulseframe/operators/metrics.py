"""Detection metrics: per series, pooled, by group, by threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import first_match, overlaps


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b > 0, a.cast("double") / b)


def match_counts(alarms: DataFrame, truth: DataFrame, hours: DataFrame, key: list[str], pre: int, post: int) -> DataFrame:
    """A row a series: n_truth, detected, tp, fp, hours.  An alarm counts for the first interval that holds it."""
    m = first_match(alarms, truth, key, "t", "event_id", "seizure", pre, post)
    hit = m.groupBy(*key).agg(F.countDistinct("seizure").alias("detected"), F.count("seizure").alias("tp"), F.sum(F.when(F.col("seizure").isNull(), 1).otherwise(0)).alias("fp"))
    n = truth.groupBy(*key).agg(F.count("*").alias("n_truth"))
    joined = hours.join(n, key, "left").join(hit, key, "left")
    return joined.select(*hours.columns, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_truth", "detected", "tp", "fp")])


def pooled(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sensitivity (null without truth) and false alarms an hour (0 without hours) over many series."""
    g = counts.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_truth", "detected", "tp", "fp")], F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"))
    return g.withColumn("sensitivity", ratio(F.col("detected"), F.col("n_truth"))).withColumn("fa_per_hour", F.when(F.col("hours") > 0, F.col("fp") / F.col("hours")).otherwise(0.0))


def challenge_score(sensitivity: Column, fa_per_hour: Column) -> Column:
    return 100.0 * sensitivity - 0.4 * fa_per_hour


#: Rules for a subject to be a responder, from detected and n_truth.
RESPONDER = {
    "two_thirds": lambda d, n: d * 3 >= n * 2,
    "strict": lambda d, n: d * 3 > n * 2,
    "066": lambda d, n: d / n >= 0.66,
}


def responders(counts: DataFrame, subject: str, rule: str = "two_thirds") -> DataFrame:
    """Subjects with truth, and whether they respond."""
    s = counts.groupBy(subject).agg(*[F.sum(c).alias(c) for c in ("n_truth", "detected", "tp", "fp", "hours")]).where("n_truth > 0")
    return s.withColumn("responder", RESPONDER[rule](F.col("detected"), F.col("n_truth")))


def responder_summary(counts: DataFrame, subject: str, rule: str = "two_thirds") -> DataFrame:
    """Pooled metrics of responders and of the others, with the number of subjects and their share."""
    r = responders(counts, subject, rule)
    g = pooled(r, ["responder"]).join(r.groupBy("responder").agg(F.count("*").alias("subjects")), "responder")
    return g.withColumn("share", F.col("subjects") / F.sum("subjects").over(Window.partitionBy(F.lit(1))))


def mask_events(truth: DataFrame, predicted: DataFrame, key: list[str], width: int = 12 * 3600 * 1_000_000) -> DataFrame:
    """tp and fn over the true intervals, fp over the predicted ones, iou, a row for each series in either; width: of the join's buckets."""
    number = lambda d: d.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy("start", "end")))
    t, p = number(truth), number(predicted)
    pairs = overlaps(t, p, key, width)
    hits = pairs.groupBy(*key).agg(F.countDistinct("_i").alias("tp"), F.countDistinct("_i_b").alias("p_hit"))
    n = t.groupBy(*key).agg(F.count("*").alias("n")).join(p.groupBy(*key).agg(F.count("*").alias("m")), key, "full_outer").join(hits, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = n.select(*key, zero("tp").alias("tp"), (zero("n") - zero("tp")).alias("fn"), (zero("m") - zero("p_hit")).alias("fp"))
    return d.withColumn("iou", ratio(F.col("tp"), F.col("tp") + F.col("fn") + F.col("fp")))


def percentiles(df: DataFrame, value: str, shares: list[float], buckets: int = 256, lower: bool = False) -> DataFrame:
    """(share, percentile): exact percentiles with linear interpolation (or the lower value) of a whole column, without one task that holds it.

    Values are counted before they move, dealt over ranges that approximate percentiles bound, and numbered in each range;
    only the rows with a wanted rank go on.  Nulls do not count; without values there is no row.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    bounds = sorted(set(d.agg(F.percentile_approx("v", [k / buckets for k in range(1, buckets)], 10000)).first()[0] or []))  # at most buckets - 1
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b < F.col("v")))
    d = d.groupBy("v").agg(F.count("*").alias("c")).withColumn("b", bucket)
    every = Window.partitionBy(F.lit(1))  # over one row a bucket
    sizes = d.groupBy("b").agg(F.sum("c").alias("s")).withColumn("n", F.sum("s").over(every)).withColumn("before", F.sum("s").over(every.orderBy("b")) - F.col("s"))
    upto = F.sum("c").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("upto", upto).join(F.broadcast(sizes.select("b", "n", "before")), "b").withColumn("high", F.col("before") + F.col("upto"))
    wanted = F.array(*[F.lit(x) for x in shares]).cast("array<double>")
    at = lambda rank: (rank >= F.col("high") - F.col("c")) & (rank < F.col("high"))
    found = d.select("v", "n", F.explode(F.filter(wanted, lambda x: at(F.floor(x * (F.col("n") - 1))) | at(F.ceil(x * (F.col("n") - 1))))).alias("share"))
    part = F.col("share") * (F.first("n") - 1) - F.floor(F.col("share") * (F.first("n") - 1))
    return found.groupBy("share").agg((F.min("v") if lower else F.min("v") + (F.max("v") - F.min("v")) * part).alias("percentile"))


def threshold_grid(scores: DataFrame, score: str, n: int = 100, most: float = 99.9) -> DataFrame:
    """Distinct percentiles (linear) of the scores at n evenly spaced shares from 0 to most percent."""
    return percentiles(scores, score, [most * k / (n - 1) / 100.0 for k in range(n)]).select(F.col("percentile").alias("threshold")).distinct()


def score_threshold(scores: DataFrame, score: str, q: float) -> DataFrame:
    """threshold: the percentile q of all scores, or q times the largest one where q is over 1."""
    if q > 1:
        return scores.agg((F.max(score) * q).alias("threshold"))
    return percentiles(scores, score, [q]).select(F.col("percentile").alias("threshold"))


def optimal_thresholds(curve: DataFrame) -> DataFrame:
    """One row for each aim: the largest sensitivity, the fewest false alarms with any, the best score; ties to the lowest threshold."""
    row = F.struct("threshold", "sensitivity", "fa_per_hour")
    by = lambda *order: F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], row.alias("r")))
    some = F.when(F.col("sensitivity") > 0, 0).otherwise(1)
    best = curve.agg(
        by(-F.coalesce("sensitivity", F.lit(-1.0)), F.col("threshold")).alias("a"),
        by(some, F.col("fa_per_hour"), F.col("threshold")).alias("b"),
        by(-challenge_score(F.coalesce("sensitivity", F.lit(-1.0)), F.col("fa_per_hour")), F.col("threshold")).alias("c"),
    )
    names = {"a": "sensitivity", "b": "fewest_false_alarms", "c": "challenge"}
    out = F.explode(F.array(*[F.struct(F.lit(v).alias("aim"), F.col(f"{k}.r").alias("r")) for k, v in names.items()]))
    return best.select(out.alias("x")).select("x.aim", "x.r.*")


def duration_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, population and sample deviation, min, max, range, coefficient of variation, percentiles."""
    shares = (0.05, 0.25, 0.75, 0.95)
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("std_pop"), F.stddev_samp(value).alias("std_samp"),
        F.min(value).alias("low"), F.max(value).alias("high"), *[F.percentile(value, s).alias(f"p{int(100 * s):02d}") for s in shares],
    )
    return g.withColumn("range", F.col("high") - F.col("low")).withColumn("cv", F.when(F.col("mean") != 0, F.col("std_pop") / F.col("mean")))


def top_k(df: DataFrame, key: list[str], value: str, tie: str, k: Column | int) -> DataFrame:
    """The k largest rows of each series (ties: the larger tie column), with rank from 1; k may use the row count ``n``."""
    w = Window.partitionBy(*key)
    d = df.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc(value), F.desc(tie))))
    return d.where(F.col("rank") <= k)
