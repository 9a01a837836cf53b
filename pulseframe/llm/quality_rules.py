"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus (operator 2).

DataFrame functions only.  Words and word pairs are hashed into a fixed number of buckets; a bucket's ratio is
log((target count + k) / (expected count + k)), where the expected count is the bucket's share of the whole corpus times
the target's size; so buckets too rare to tell have a ratio near 0. The counts cover every document, and a document's score
is the mean ratio over its n-grams.  Every document with a score of at least the threshold is kept unless a base rule fails.

Defined cases: a null text counts as empty; a text without words has score 0.0 and fails the base rule; a null doc_id is
carried through and is never trusted; repeated rows are each scored; an empty table gives an empty result; without any
trusted document all ratios are 0.  Extra columns of the input are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of, words_of

BUCKETS = 65536
SMOOTHING = 10.0
THRESHOLD = -0.1
SYMBOLS = r"[#*$%&|<>]"


def repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more in the array.

    Sorts one long a window, the high bits of its hash with its position in the low bits; windows whose high bits meet
    are compared as text.  Linear but for the sorts, for any length.
    """
    n = F.size(words)
    mask = (-F.pow(F.lit(2.0), F.ceil(F.log2(n + F.lit(2))))).cast("long")

    def windows(w: Column, mask: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(mask).bitwiseOR(i.cast("long")),
            )
        )

    def meet(s: Column, mask: Column) -> Column:
        same = lambda x, j: x.bitwiseAND(mask) == F.get(s, j).bitwiseAND(mask)
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.bitwiseAND(F.bitwise_not(mask)).cast("int"))

    def exact(p: Column, w: Column) -> Column:
        grams = F.array_sort(F.transform(p, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
        return let(grams, lambda g: F.sort_array(F.transform(F.filter(g, lambda x, i: (x["g"] == F.get(g, i - 1)["g"]) | (x["g"] == F.get(g, i + 1)["g"])), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return let(
        F.struct(words.alias("w"), mask.alias("m")),
        lambda b: let(let(windows(b["w"], b["m"]), lambda s: meet(s, b["m"])), lambda p: let(exact(p, b["w"]), covered)),
    )


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, _words, and the columns of the base rule."""
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select("doc_id", text_of().alias("_text")).select("doc_id", "_text", words_of(F.col("_text")).alias("_words"))
    d = d.select(
        "doc_id",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of all words and all pairs of neighbours."""
    return let(
        words,
        lambda w: F.concat(
            F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")),
            F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(w, i), x), F.lit(buckets)).cast("int")),
        ),
    )


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """The log ratio of each bucket, from counts over all documents; the trusted ones are labelled quality 1."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct().withColumn("_good", F.lit(1))
    d = docs.select("doc_id", "text").join(trusted.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left")
    grams = d.select(F.explode(buckets_of(words_of(text_of()), buckets)).alias("b"), F.coalesce("_good", F.lit(0)).cast("long").alias("g"))
    counts = {r.b: (r.t, r.n) for r in grams.groupBy("b").agg(F.sum("g").alias("t"), F.count("*").alias("n")).collect()}  # one row a bucket at most
    target, raw = (sum(x[i] for x in counts.values()) for i in (0, 1))
    if not target:
        return [0.0] * buckets
    return [log((t + smoothing) / (n * target / raw + smoothing)) for t, n in (counts.get(b, (0, 0)) for b in range(buckets))]


def score(words: Column, ratios: list[float]) -> Column:
    """Mean log ratio of a document's n-grams; 0.0 without words."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal
    return let(
        buckets_of(words, len(ratios)),
        lambda b: F.when(F.size(b) == 0, F.lit(0.0)).otherwise(F.aggregate(b, F.lit(0.0), lambda a, x: a + F.element_at(table, x + 1)) / F.size(b)),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """Base columns, llr (mean log ratio) and kept for every document."""
    ratios = fit(docs, labels, buckets, smoothing)
    d = base_columns(docs).withColumn("llr", score(F.col("_words"), ratios))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("_words")
