"""Quality classifier: hashed word n-gram logistic regression fitted with follow-the-regularised-leader (operator 9).

The features of a text are hashed: its words, its pairs of neighbouring words, and the same for word shapes (case of the
first letter, what the word ends with, whether it repeats the word before).  A feature counts as its occurrences over
the root of the text's number of features.  The fit sees a bounded sample of the labelled documents that are not held out;
scores are sparse dot products over whole texts.

Defined cases: null and empty texts have no features and score the intercept; without labelled rows every score is
0.5; a null doc_id is carried through and is not held out; repeated rows are each scored; an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import Words, encode, mixed, pair_hash, pieces, split_long, words
from .labelled import fit_in_task, held_out, sample

BITS = 18
#: The fit's sample: documents a class, and bytes of their texts.
PER_CLASS = 3000
MAX_BYTES = 32 << 20
THRESHOLD = 0.5
MODULUS, REST = 3, 1


def _kind() -> np.ndarray:
    kind = np.zeros(256, np.uint64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    kind[[ord(c) for c in ".,;:"]] = 5
    kind[[ord(c) for c in "!?"]] = 6
    kind[[ord(c) for c in "#*$%&|<>"]] = 7
    return kind


_KIND = _kind()


def features(w: Words, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each feature occurrence; the first known words are only there for the pairs that follow."""
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    shift = np.uint64(64 - BITS)
    same_doc = w.doc[1:] == w.doc[:-1]
    again = np.concatenate(([False], same_doc & (w.hash[1:] == w.hash[:-1])))
    shape = _KIND[w.data[w.start]] + np.uint64(8) * _KIND[w.data[w.end - 1]] + np.uint64(64) * _KIND[w.data[np.maximum(w.end - 2, w.start)]] + np.uint64(512) * again
    shape = mixed(shape + np.uint64(0x51ED2701))
    first = np.flatnonzero(same_doc)
    first = first[first >= known - 1]
    grams = [w.hash[known:], shape[known:], pair_hash(w.hash[first], w.hash[first + 1]), pair_hash(shape[first], shape[first + 1])]
    return np.concatenate([(g >> shift).astype(np.int64) for g in grams]), np.concatenate([w.doc[known:], w.doc[known:], w.doc[first], w.doc[first]])


def long_features(text: bytes) -> Iterator[np.ndarray]:
    """The features of one text of any length, part by part; a part repeats the last two words of the one before."""
    tail, known = b"", 0
    for p in split_long(text):
        raw = tail + p
        w = words([raw])
        yield features(w, known)[0]
        known = min(2, len(w.start))
        tail = raw[int(w.start[-known]) - 1 :] if known else b""  # data begins with a space of its own


def _vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    index, count = np.unique(np.concatenate(list(long_features(encode(text)))), return_counts=True)
    return index, count / np.sqrt(max(count.sum(), 1))


def fit(rows: list[tuple[str, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by follow-the-regularised-leader, one document at a time, classes weighted alike in the order of the rows."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    data = [(np.append(i, size), np.append(x, 1.0), y) for i, x, y in ((*_vector(t), y) for t, y in rows)]
    order = np.random.default_rng(11)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(data)):
            i, x, y = data[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], float(w[size])


def score_texts(texts: list[bytes], weights: np.ndarray, intercept: float) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for at, group in pieces(texts):
        if len(group[0]) <= arrays.PIECE:
            index, part = features(words(group))
            doc = np.array(at)[part] if len(part) else part
            total += np.bincount(doc, weights[index], len(texts))
            count += np.bincount(doc, minlength=len(texts))
            continue
        for index in long_features(group[0]):
            total[at[0]] += weights[index].sum()
            count[at[0]] += len(index)
    return 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(count, 1)) + intercept, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    weights, intercept = fit_in_task(sample(docs, labels, "quality", MODULUS, REST, per_class, max_bytes), fit)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts([encode(t) for t in texts], weights, intercept))

    scored = docs.select("doc_id", held_out(MODULUS, REST).alias("held_out"), run(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
