"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy (operator 1).

The input at each word is a hashed word embedding beside the sum of the hashed embeddings of the word's character
5-grams (the space before the word counts as a character).  Both directions run over windows of ``WINDOW`` words that
overlap by a quarter; every window of a whole text is scored and the text's score is the largest.

A text's label does not say where its toxic words stand.  So training picks, for each text, the window that scores
highest so far (and another one of each clean text) and fits these; the first pick goes by the log odds of the hashed
words and character grams, from which the embeddings start.

Defined cases: null, empty and white texts are scored as a window without words (the bias alone); without labelled rows
every score is the prior 0.0; a null doc_id is carried through and is not held out; repeated rows are each scored; an
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import Words, encode, gram_hash, pieces, windowed_parts, words
from .common import columns_of, unused
from .labelled import fit_in_task, held_out, sample

WINDOW, STRIDE, GRAM = 32, 24, 5
BITS, DIM, HIDDEN, ATTEND = 16, 4, 6, 8
#: The fit's sample: documents a class, and bytes of their texts.
PER_CLASS = 1500
MAX_BYTES = 24 << 20
THRESHOLD = 0.3
MODULUS, REST = 4, 2

Model = dict[str, np.ndarray]


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; buckets of all character grams; where each word's grams begin (and their number at the end).

    A gram belongs to the word that it ends in; the first begins at the space before the word.
    """
    shift = np.uint64(64 - BITS)
    grams = np.maximum(w.end - w.start + 2 - GRAM, 1)
    first = np.concatenate(([0], np.cumsum(grams)))
    at = np.arange(first[-1]) - np.repeat(first[:-1] - (w.start - 1), grams)
    every = (gram_hash(w.prefix, GRAM) >> shift).astype(np.int32) if len(w.prefix) > GRAM else np.zeros(0, np.int32)
    # A word too short for a gram takes the one that begins at its space, cut off by the hash of its own letters.
    short = np.repeat(w.end - w.start + 1 < GRAM, grams)
    c = np.empty(len(at), np.int32)
    c[~short] = every[at[~short]]
    c[short] = (np.repeat(w.hash, grams)[short] >> np.uint64(11)).astype(np.int32) & ((1 << BITS) - 1)
    return (w.hash >> shift).astype(np.int32), c, first


def windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of each window; a text without words has none."""
    at = w.docs_from()
    n = np.diff(at)
    each = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(w.n_docs), each)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    return at[doc] + k * STRIDE, np.minimum(WINDOW, n[doc] - k * STRIDE), doc


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]


def inputs(m: Model, t: Tokens) -> np.ndarray:
    """The network's input at each word."""
    word, gram, first = t
    sums = np.add.reduceat(m["char"][gram], first[:-1], axis=0) if len(word) else np.zeros((0, DIM), np.float32)
    return np.concatenate([m["word"][word], sums], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def forward(m: Model, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Scores of windows: x (steps, windows, inputs), mask (steps, windows)."""
    steps, n, _ = x.shape
    states, saved = [], []
    for d in ("f", "b"):
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        px = x.reshape(steps * n, -1) @ m["W" + d] + m["c" + d]
        px = px.reshape(steps, n, 3 * HIDDEN)
        h, out, kept = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), {}
        for t in order:
            g = _sigmoid(px[t, :, : 2 * HIDDEN] + h @ m["U" + d])
            u, r = g[:, :HIDDEN], g[:, HIDDEN:]
            rh = r * h
            cand = np.tanh(px[t, :, 2 * HIDDEN :] + rh @ m["V" + d])
            step = u * mask[t][:, None]
            new = h + step * (cand - h)
            if keep:
                kept[t] = (h, u, r, cand)
            h = new
            out[t] = h
        states.append(out)
        saved.append(kept)
    s = np.concatenate(states, axis=2)
    a = np.tanh(s.reshape(steps * n, -1) @ m["A"]).reshape(steps, n, ATTEND)
    e = a @ m["v"] - 1e4 * (1 - mask)
    e = np.exp(e - e.max(axis=0)) * mask
    weight = e / np.maximum(e.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", weight, s)
    p = _sigmoid(pooled @ m["o"] + m["bias"][0])
    return (p, (s, a, weight, pooled, saved)) if keep else p


def gradients(m: Model, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[Model, np.ndarray]:
    """Gradients of the mean log loss, and that of the inputs."""
    steps, n, _ = x.shape
    p, (s, a, weight, pooled, saved) = forward(m, x, mask, True)
    g: Model = {}
    dlogit = ((p - y) / n).astype(np.float32)
    g["o"], g["bias"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
    dpool = dlogit[:, None] * m["o"]
    dweight = np.einsum("nh,tnh->tn", dpool, s)
    de = weight * (dweight - (weight * dweight).sum(axis=0))
    da = de[:, :, None] * m["v"] * (1 - a * a)
    g["v"], flat = np.einsum("tn,tna->a", de, a), da.reshape(steps * n, -1)
    g["A"] = s.reshape(steps * n, -1).T @ flat
    ds = weight[:, :, None] * dpool[None] + (flat @ m["A"].T).reshape(s.shape)
    dx = np.zeros_like(x)
    for k, d in enumerate(("f", "b")):
        order = range(steps - 1, -1, -1) if d == "f" else range(steps)
        dh, dpx = np.zeros((n, HIDDEN), np.float32), np.zeros((steps, n, 3 * HIDDEN), np.float32)
        gU, gV = np.zeros_like(m["U" + d]), np.zeros_like(m["V" + d])
        for t in order:
            h, u, r, cand = saved[k][t]
            dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            on = mask[t][:, None]
            dc = dh * u * on * (1 - cand * cand)
            du = dh * (cand - h) * on * u * (1 - u)
            drh = dc @ m["V" + d].T
            dr = drh * h * r * (1 - r)
            dg = np.concatenate([du, dr], axis=1)
            gU += h.T @ dg
            gV += (r * h).T @ dc
            dpx[t] = np.concatenate([dg, dc], axis=1)
            dh = dh * (1 - u * on) + drh * r + dg @ m["U" + d].T
        flat = dpx.reshape(steps * n, -1)
        g["U" + d], g["V" + d], g["c" + d] = gU, gV, flat.sum(axis=0)
        g["W" + d] = x.reshape(steps * n, -1).T @ flat
        dx += (flat @ m["W" + d].T).reshape(x.shape)
    return g, dx


def _steps(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of each (step, window), and the mask."""
    t = np.arange(WINDOW)[:, None]
    on = t < length[None, :]
    return np.where(on, first[None, :] + t, 0), on.astype(np.float32)


def window_scores(m: Model, w: Words, t: Tokens | None = None, at_once: int = 512, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all windows (or the first ones) and their texts; t has the words' tokens, if they are known."""
    first, length, doc = (x[:most] for x in windows(w))
    x = inputs(m, t or tokens(w))
    scores = np.empty(len(first), np.float32)
    for a in range(0, len(first), at_once):
        at, mask = _steps(first[a : a + at_once], length[a : a + at_once])
        scores[a : a + at_once] = forward(m, x[at], mask)
    return scores, doc


def score_texts(m: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's largest window score (that of the bias alone without words) and number of windows."""
    best, count = np.full(len(texts), _sigmoid(m["bias"][0]), np.float32), np.zeros(len(texts), np.int64)

    def take(doc: np.ndarray, got: np.ndarray) -> None:
        fresh = np.unique(doc)
        best[fresh[count[fresh] == 0]] = 0
        np.maximum.at(best, doc, got)
        np.add.at(count, doc, 1)

    for at, group in pieces(texts):
        if len(group[0]) <= arrays.PIECE:
            got, doc = window_scores(m, words(group, lower=True))
            take(np.array(at)[doc], got)
            continue
        for w, _, n in windowed_parts(group[0], WINDOW, STRIDE, lower=True):
            got, doc = window_scores(m, w, most=n)
            take(doc + at[0], got)
    return best, count


def _start(rows: list[tuple[Words, Tokens, np.ndarray]]) -> tuple[Model, np.ndarray, np.ndarray]:
    """Small random weights; the embeddings' first part holds the log odds of the buckets."""
    rng = np.random.default_rng(5)
    size = 1 << BITS
    odds = []
    for kind in (0, 1):
        df = np.full((2, size), 0.5)
        n = np.ones(2)
        for w, (word, gram, first), y in rows:
            doc = w.doc if kind == 0 else np.repeat(w.doc, np.diff(first))
            seen = np.unique(doc.astype(np.int64) * size + (word if kind == 0 else gram))
            for c in (0, 1):
                df[c] += np.bincount(seen[y[seen // size] == c] % size, minlength=size)
                n[c] += (y == c).sum()
        sure = np.minimum(1, (df[1] - 0.5) / 4)
        odds.append(np.clip(np.log(df[1] / n[1]) - np.log(df[0] / n[0]), 0, 6) * sure)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
    m: Model = {"word": normal(size, DIM) * 0.2, "char": normal(size, DIM) * 0.1, "A": normal(2 * HIDDEN, ATTEND), "v": normal(ATTEND), "o": normal(2 * HIDDEN), "bias": np.array([-1.0], np.float32)}
    m["word"][:, 0], m["char"][:, 0] = odds[0] / 3, odds[1] / 3
    for d in "fb":
        m |= {"W" + d: normal(2 * DIM, 3 * HIDDEN), "c" + d: np.zeros(3 * HIDDEN, np.float32), "U" + d: normal(HIDDEN, 2 * HIDDEN), "V" + d: normal(HIDDEN, HIDDEN)}
        m["W" + d][[0, DIM], 2 * HIDDEN :] += 0.5
    m["A"][:, :] += 0.2
    m["v"][:] += 0.5
    m["o"][:] += 0.5
    return m, odds[0], odds[1]


def fit(rows: list[tuple[str, int]], epochs: int = 5, batch: int = 128, rate: float = 0.08) -> Model | None:
    """The network fitted to (text, label) by Adagrad."""
    if not any(y for _, y in rows):
        return None
    texts, labels = [encode(t) for t, _ in rows], np.array([y for _, y in rows])
    data = []
    for numbers, group in pieces(texts):
        w = words(group, lower=True)
        t = tokens(w)
        w.data, w.prefix = w.data[:0], w.prefix[:0]  # the tokens are all that is needed from here on
        data.append((w, t, labels[numbers]))
    m, word_odds, char_odds = _start(data)
    squares = {k: np.full_like(v, 1e-3) for k, v in m.items()}
    rng = np.random.default_rng(9)
    for epoch in range(epochs):
        picked = []
        for k, (w, t, y) in enumerate(data):
            first, length, doc = windows(w)
            if not len(first):
                continue
            if epoch == 0:
                word, gram, at = t
                each = word_odds[word] + np.maximum.reduceat(char_odds[gram], at[:-1])
                total = np.concatenate(([0], np.cumsum(each)))
                scores = total[first + length] - total[first]
            else:
                scores, _ = window_scores(m, w, t)
            best = np.lexsort((scores, doc))
            best = best[np.concatenate((doc[best][1:] != doc[best][:-1], [True]))]
            other = rng.integers(0, len(first), len(first) // 16 + 1)
            for i in np.concatenate([best, other[y[doc[other]] == 0]]):
                picked.append((k, first[i], length[i], y[doc[i]]))
        order = rng.permutation(len(picked))
        for a in range(0, len(order), batch):
            some = [picked[i] for i in order[a : a + batch]]
            xs = np.zeros((WINDOW, len(some), 2 * DIM), np.float32)
            mask = np.zeros((WINDOW, len(some)), np.float32)
            used = []
            for c, (k, f, n, _) in enumerate(some):
                word, gram, at = data[k][1]
                word, gram, at = word[f : f + n], gram[at[f] : at[f + n]], at[f : f + n + 1] - at[f]
                xs[:n, c, :DIM] = m["word"][word]
                xs[:n, c, DIM:] = np.add.reduceat(m["char"][gram], at[:-1], axis=0)
                mask[:n, c] = 1
                used.append((word, gram, at, n))
            g, dx = gradients(m, xs, mask, np.array([s[3] for s in some], np.float32))
            for name, at_ in (("word", 0), ("char", 1)):
                index = np.concatenate([u[at_] for u in used])
                grad = np.concatenate([dx[: u[3], c, :DIM] if name == "word" else np.repeat(dx[: u[3], c, DIM:], np.diff(u[2]), axis=0) for c, u in enumerate(used)])
                unique, back = np.unique(index, return_inverse=True)
                total = np.zeros((len(unique), DIM), np.float32)
                np.add.at(total, back, grad)
                squares[name][unique] += total * total
                m[name][unique] -= rate * total / np.sqrt(squares[name][unique])
            for name, grad in g.items():
                squares[name] += grad * grad
                m[name] -= (rate * grad / np.sqrt(squares[name])).astype(np.float32)
    return m


def scorer(model: Model | None):
    """A column function: text -> struct of score and n_windows."""

    @F.pandas_udf("score double, n_windows long")
    def run(texts: pd.Series) -> pd.DataFrame:
        best, count = np.zeros(len(texts), np.float32), np.zeros(len(texts), np.int64)
        if model is not None:
            best, count = score_texts(model, [encode(t) for t in texts])
        return pd.DataFrame({"score": best.astype(float), "n_windows": count})

    return run


def _scored(docs: DataFrame, labels: DataFrame, name: str, per_class: int, max_bytes: int) -> DataFrame:
    run = scorer(fit_in_task(sample(docs, labels, "toxic", MODULUS, REST, per_class, max_bytes), fit))
    return docs.withColumn(name, run(F.col("text")))


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and n_windows for every document."""
    d = _scored(docs.select("doc_id", "text"), labels, "_toxicity", per_class, max_bytes)
    d = d.select("doc_id", held_out(MODULUS, REST).alias("held_out"), F.col("_toxicity.score").alias("score"), F.col("_toxicity.n_windows").alias("n_windows"))
    return d.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows")


def reject(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    (name,) = unused(docs, "_toxicity")
    return _scored(docs, labels, name, per_class, max_bytes).where(F.col(name)["score"] < threshold).select(*columns_of(docs))
