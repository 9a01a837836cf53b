"""Benchmark decontamination with a BM25 index of the test items and block-max WAND (operator 5).

The items are indexed: a posting holds an item and the term's BM25 weight in it, as a share of the item's score against
itself; postings are kept in blocks with the largest weight of each.  Every passage of every document is a query: passages
are windows of twice the longest item's words that overlap by half, so each stretch as long as an item lies whole in
one.  Retrieved are all items with at least ``threshold`` of their own score; then the item's question and answer are
compared with the passage, by their shares of word runs found in it.

For many passages at once the first pivot test of WAND is done with array operations: the sum over a passage's terms
of each item block's largest weight bounds every item of that block.  Passages and blocks over the threshold go through
the block-max WAND loop.  Postings and block maxima are kept sparse, about 30 bytes for a word of an item,
but for the block maxima of small sets of items.

The index is built once, by the driver, and sent to each worker as arrays.  Where the items are larger than ``INDEX_BYTES`` they are dealt into shards of at most
that size, each of which is run against all passages; document frequencies and the mean length are always those of all
items, so the shards change nothing but the number of passes.

Defined cases: null and empty texts and items have no words and never match; a null item_id or doc_id is carried
through; repeated rows are queried each and give equal rows; without items or documents the result is empty; ties cannot
matter, as every item over the threshold is returned.  Extra columns are ignored, but for ``question`` and ``answer`` of
the items, which are used when both are there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import Words, encode, pieces, windowed_parts, word_hashes, words
from .common import id_of, name_of, text_of, unused

K1, B = 1.2, 0.75
THRESHOLD = 0.6
#: Share of the question's and of the answer's word runs that must stand in the passage.
QUESTION, ANSWER, RUN = 0.8, 0.8, 5
BLOCK = 4
#: Block maxima are a table of terms by blocks up to so many cells (16 MB), and sparse beyond; both give the same blocks.
DENSE_CELLS = 1 << 22
#: Twice the bytes of items' texts in a shard; a shard's index takes about ten times their bytes in each Python worker.
INDEX_BYTES = 32 << 20
RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def own_words(text: str) -> np.ndarray:
    """Words are compared in lower case without the punctuation at their ends."""
    return word_hashes(encode(text), lower=True, bare=True)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what stands before it the question; a single sentence is halved."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    return " ".join(w[: (len(w) + 1) // 2]), " ".join(w[(len(w) + 1) // 2 :])


def runs(h: np.ndarray, n: int = RUN) -> np.ndarray:
    """Distinct hashes of all runs of n words (of all words, if there are fewer)."""
    n = min(n, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return np.unique(out)


@dataclass
class Index:
    """One shard of the items."""

    item_id: list = field(default_factory=list)
    question: list[tuple[int, np.ndarray]] = field(default_factory=list)  # words a run, and the runs
    answer: list[tuple[int, np.ndarray]] = field(default_factory=list)
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where each term's postings begin, and their number
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))  # a term's largest weight
    n_blocks: int = 0
    block_key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # term * n_blocks + block, ascending
    block_most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray | None = None  # the same block maxima, terms by blocks, where that is small
    table: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))

    @classmethod
    def build(cls, items: list, df: Mapping[int, int], n_items: int, mean: float) -> Index:
        """items: (item_id, question, answer); df has the document frequency of each of their words."""
        ix, found = cls(), defaultdict(list)
        for item_id, question, answer in items:
            q, a = own_words(question), own_words(answer)
            h, count = np.unique(np.concatenate([q, a]), return_counts=True)
            if not len(h):
                continue
            idf = np.log1p((n_items - np.array([df[int(x)] for x in h]) + 0.5) / (np.array([df[int(x)] for x in h]) + 0.5))
            weight = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * count.sum() / mean))
            for t, w in zip(h.tolist(), (weight / weight.sum()).tolist(), strict=True):
                found[t].append((len(ix.item_id), w))
            ix.item_id.append(item_id)
            ix.question.append((min(RUN, len(q)), runs(q)))
            ix.answer.append((min(RUN, len(a)), runs(a)))
        ix.terms = np.array(sorted(found), np.uint64)
        ix.n_blocks = -(-len(ix.item_id) // BLOCK)
        if not found:
            return ix
        lists = [found[t] for t in ix.terms.tolist()]
        ix.first = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        ix.item = np.array([i for x in lists for i, _ in x], np.int32)
        ix.weight = np.array([w for x in lists for _, w in x])
        ix.most = np.maximum.reduceat(ix.weight, ix.first[:-1])
        key = np.repeat(np.arange(len(lists)), np.diff(ix.first)) * np.int64(ix.n_blocks) + ix.item // BLOCK
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))  # items ascend in a term, and so do keys
        ix.block_key, ix.block_most = key[new], np.maximum.reduceat(ix.weight, new)
        if len(lists) * ix.n_blocks <= DENSE_CELLS:
            ix.dense = np.zeros((len(lists), ix.n_blocks), np.float32)
            ix.dense.ravel()[ix.block_key] = ix.block_most * 1.00001
        ix.table = np.full(1 << 18, -1, np.int32)  # by the hash's high bits: the last term with these
        ix.table[(ix.terms >> np.uint64(46)).astype(np.int64)] = np.arange(len(ix.terms))
        return ix

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """The term's number for each word, -1 for words that no item has."""
        if not len(self.terms):
            return np.full(len(h), -1)
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.table[(h >> np.uint64(46)).astype(np.int64)] >= 0)
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        hit = self.terms[at] == h[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def blocks(self, window: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(window, block) pairs whose block maxima add up to the threshold; the input is ascending by window.

        Terms with the smallest maxima whose sum stays under the threshold cannot lift an item to it by themselves, so
        only blocks of the other terms are looked at; their bounds count all terms.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(window):
            return none
        if self.dense is not None:
            start = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
            own, block = np.nonzero(np.add.reduceat(self.dense[term], start, axis=0) >= np.float32(threshold))
            return window[start][own], block
        order = np.lexsort((self.most[term], window))
        w, t = window[order], term[order]
        start = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        upto = np.cumsum(self.most[t])
        size = np.diff(np.append(start, len(w)))
        upto -= np.repeat(upto[start] - self.most[t[start]], size)
        main = np.flatnonzero(upto >= threshold * (1 - 1e-9))
        if not len(main):
            return none
        low, high = (np.searchsorted(self.block_key, (t[main] + k) * np.int64(self.n_blocks)) for k in (0, 1))
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.unique(np.repeat(np.searchsorted(w[start], w[main]), n) * np.int64(self.n_blocks) + self.block_key[at] % self.n_blocks)
        own, block = pair // self.n_blocks, pair % self.n_blocks
        each = size[own]
        back = np.repeat(np.arange(len(pair)), each)
        k = start[own][back] + np.arange(len(back)) - np.repeat(np.cumsum(each) - each, each)
        key = t[k] * np.int64(self.n_blocks) + block[back]
        place = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        bound = np.bincount(back, np.where(self.block_key[place] == key, self.block_most[place], 0.0), len(pair))
        good = bound >= threshold * (1 - 1e-9)
        return w[start][own[good]], block[good]

    def wand(self, terms: list[int], good: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items with at least the threshold, by block-max WAND.

        good: the blocks, ascending, whose maxima reach the threshold.  The postings of the terms are walked together in the
        order of their current items; the pivot is the first item that the lists up to it can lift to the threshold, and
        a pivot in a block that cannot reach it moves all lists on to the next block that can.
        """
        if not good:
            return []
        lists = []  # [position, items, weights, largest weight]
        for t in terms:
            a, b = self.first[t], self.first[t + 1]
            at = int(np.searchsorted(self.item[a:b], good[0] * BLOCK))
            if at < b - a:
                lists.append([at, self.item[a:b].tolist(), self.weight[a:b], float(self.most[t])])
        found = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= threshold * (1 - 1e-9):
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][1][lists[pivot][0]]
            block = bisect_left(good, item // BLOCK)
            if block == len(good):
                break
            if good[block] != item // BLOCK:
                to = good[block] * BLOCK
            elif lists[0][1][lists[0][0]] == item:
                score = float(sum(x[2][x[0]] for x in lists if x[1][x[0]] == item))
                if score >= threshold:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            for x in lists:
                if x[1][x[0]] < to:
                    x[0] = bisect_left(x[1], to, x[0])
            lists = [x for x in lists if x[0] < len(x[1])]
        return found


def search(ix: Index, w: Words, length: int, threshold: float, question: float, answer: float, most: int | None = None) -> list[tuple]:
    """(text, item_id, score, question overlap, answer overlap, first word) of all verified hits, the best passage each.

    most: only that many passages of each text are queries.
    """
    term = ix.term_of(w.hash)
    known = np.flatnonzero(term >= 0)
    at = w.docs_from()
    in_doc = known - at[w.doc[known]]
    # Windows of 2 * length words every length words: word i stands in window i // length and in the one before.
    n = np.diff(at)
    each = np.maximum(1, -(-n // length) - 1)
    if most is not None:
        each = np.minimum(each, most)
    base = np.concatenate(([0], np.cumsum(each)))
    own = in_doc // length
    doc = w.doc[known].astype(np.int64)
    both = np.concatenate([np.where(own < each[doc], base[doc] + own, -1), np.where((own > 0) & (own <= each[doc]), base[doc] + own - 1, -1)])
    t2 = np.concatenate([term[known], term[known]])
    ok = both >= 0
    pair = np.sort(both[ok] * np.int64(len(ix.terms) + 1) + t2[ok])
    pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(pair) else pair
    window, t = pair // (len(ix.terms) + 1), pair % (len(ix.terms) + 1)
    first = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1]))) if len(window) else np.zeros(0, np.int64)
    best: dict[tuple[int, int], tuple] = {}
    step = 4096 if ix.dense is not None else 1024
    for a in range(0, len(first), step):
        lo, hi = first[a], first[a + step] if a + step < len(first) else len(window)
        own, block = ix.blocks(window[lo:hi], t[lo:hi], threshold)
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        for e0, e1 in zip(edge.tolist(), [*edge[1:].tolist(), len(own)], strict=False):
            s = lo + int(np.searchsorted(window[lo:hi], own[e0]))
            e = lo + int(np.searchsorted(window[lo:hi], own[e0], side="right"))
            hits = ix.wand(t[s:e].tolist(), block[e0:e1].tolist(), threshold)
            if not hits:
                continue
            d = int(np.searchsorted(base, window[s], side="right") - 1)
            from_word = int(window[s] - base[d]) * length
            passage = w.hash[at[d] + from_word : min(at[d + 1], at[d] + from_word + 2 * length)]
            there = {}
            for item, score in hits:
                share = []
                for run, own_runs in (ix.question[item], ix.answer[item]):
                    if run not in there:
                        there[run] = runs(passage, run)
                    share.append(float(np.isin(own_runs, there[run]).mean()) if run else 1.0)
                if share[0] >= question and share[1] >= answer and ((d, item) not in best or best[d, item][2] < score):
                    best[d, item] = (d, ix.item_id[item], score, share[0], share[1], from_word)
    return list(best.values())


def leaks(ix: Index, texts: list[bytes], length: int, threshold: float, question: float, answer: float) -> list[tuple]:
    """search() over texts of any length."""
    rows: list[tuple] = []
    for numbers, group in pieces(texts):
        if len(group[0]) <= arrays.PIECE:
            rows += [(numbers[d], *rest) for d, *rest in search(ix, words(group, lower=True, bare=True), length, threshold, question, answer)]
            continue
        best: dict = {}  # a very long text, part by part
        for w, done, n in windowed_parts(group[0], 2 * length, length, lower=True, bare=True):
            for _, item, *rest in search(ix, w, length, threshold, question, answer, n):
                if item not in best or best[item][0] < rest[0]:
                    best[item] = (*rest[:3], rest[3] + done)
        rows += [(numbers[0], item, *rest) for item, rest in best.items()]
    return rows


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, index_bytes: int = INDEX_BYTES, with_hash: bool = False) -> DataFrame:
    """One row for each document and item that it leaks; with_hash: also text_hash, as rows may share a doc_id."""
    spark = docs.sparkSession
    if {"question", "answer"} <= set(items.columns):
        items = items.select("item_id", F.coalesce("question", F.lit("")).alias("q"), F.coalesce("answer", F.lit("")).alias("a"))
    else:
        items = items.select("item_id", F.coalesce("text", F.lit("")).alias("q"), F.lit(None).cast("string").alias("a"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("q") + F.coalesce(F.octet_length("a"), F.lit(0))), F.lit(0))).first()[0]
    shards = max(1, -(-size * 2 // index_bytes))

    def read(k: int) -> list[tuple]:
        rows = items.where(F.pmod(F.xxhash64("q", "item_id"), F.lit(shards)) == k).collect()  # about half of index_bytes
        return sorted({(r.item_id, *((r.q, r.a) if r.a is not None else question_and_answer(r.q))) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))

    words_, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # document frequencies of all items' words
    n_items = total = longest = 0
    for k in range(shards):
        found = [words_]
        for _, q, a in read(k):
            h = own_words(f"{q} {a}")
            found.append(np.unique(h))
            n_items, total, longest = n_items + bool(len(h)), total + len(h), max(longest, len(h))
        size = np.concatenate([counts, np.ones(sum(map(len, found[1:])), np.int64)])
        words_, back = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.bincount(back, size, len(words_)).astype(np.int64)
    out = None
    for k in range(shards):
        part = read(k)
        own = np.unique(np.concatenate([own_words(f"{q} {a}") for _, q, a in part])) if part else words_[:0]
        have = dict(zip(own.tolist(), counts[np.searchsorted(words_, own)].tolist(), strict=True))
        found = _against(docs, part, have, max(n_items, 1), total / max(n_items, 1) or 1.0, max(longest, 16), threshold, question, answer, with_hash)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item.  A row is known by doc_id and text, so others with its doc_id stay."""
    leak, hashed = unused(docs, "_leak", "_hash")
    leaks = decontaminate(docs, items, with_hash=True).select(id_of().alias(leak), F.col("text_hash").alias(hashed)).distinct()
    return docs.join(leaks, (id_of() == F.col(leak)) & (F.xxhash64(text_of()) == F.col(hashed)), "left_anti")


def _against(docs: DataFrame, part: list[tuple], df: Mapping[int, int], n_items: int, mean: float, length: int, threshold: float, question: float, answer: float, with_hash: bool) -> DataFrame:
    own = ["doc_id", "text_hash"] if with_hash else ["doc_id"]
    built = docs.sparkSession.sparkContext.broadcast(Index.build(part, df, n_items, mean))  # of bounded size, see INDEX_BYTES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = list(zip(*[b[c].to_list() for c in own], strict=True))
            texts = [encode(t) for t in b["text"]]
            rows = [(*ids[d], *rest) for d, *rest in leaks(built.value, texts, length, threshold, question, answer)]
            yield pd.DataFrame(rows, columns=[*own, "item_id", "score", "question_overlap", "answer_overlap", "first_word"]).astype({"item_id": "Int64"})

    rows = docs.select(id_of().alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), "text").select(*own, "text")
    found = rows.mapInPandas(run, RESULT.replace("doc_id long", "doc_id long, text_hash long") if with_hash else RESULT)
    return found.withColumn("doc_id", name_of("doc_id"))
