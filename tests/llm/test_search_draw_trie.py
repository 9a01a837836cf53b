"""Vector search, resampling and the conversation trie against plain loops, on rows that are null, empty, tied, repeated or huge."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseframe.llm import prefix_trie, resampling, vector_topk

NO = -(2**63)
own_id = lambda i: NO if i is None else i


# ---- exact top-k ----------------------------------------------------------------------------------------------------


def vectors(seed=3, n=160, dims=21):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dims))
    rows = [(i, [float(x) for x in centres[i % 5] * (1 + i % 7) + r.normal(scale=0.2, size=dims)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(50, rows[50][1]), (50, [0.5] * dims), (None, rows[3][1]), (None, rows[3][1])]
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 19), (2051, [float("nan")] * dims), (2052, [float("inf")] + [0.0] * 20), (2100, []), (2101, [3.0, -2.5]), (2150, [-0.001] * dims), (-100, [1.0] * dims)]
    return rows


def plain_top(rows, k=5, every=50):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [max(-(2**62), min(2**62, math.floor(256 * x))) for x in v]

    kept = [(own_id(i), w) for i, v in rows if (w := whole(v)) is not None]
    out = collections.Counter()
    for a, (i, q) in enumerate(kept):
        if i != NO and math.fmod(i, every) == 0:
            scores = [(-max(NO, min(2**63 - 1, sum(x * y for x, y in zip(q, v)))), j) for b, (j, v) in enumerate(kept) if b != a]  # noqa: B905
            for rank, (s, j) in enumerate(heapq.nsmallest(k, scores), 1):
                out[i, rank, None if j == NO else j, -s] += 1
    return out


def found(df):
    return collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


VECTOR = "vec_id long, embedding array<double>, _id string, block string, row string, score string"


@pytest.mark.parametrize("block", [16, 4096])
def test_top_products(spark, monkeypatch, block):
    monkeypatch.setattr(vector_topk, "BOXES", 8)
    monkeypatch.setattr(vector_topk, "SLICE", 3)
    rows = vectors()
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTOR).repartition(3)
    assert found(vector_topk.top_products(df, block_rows=block)) == plain_top(rows)
    assert found(vector_topk.top_products(df, k=300, every=100, block_rows=block)) == plain_top(rows, 300, 100)


def test_top_products_of_huge_components_and_few_rows(spark):
    rows = [(0, [1e15, -1e15, 2.0]), (1, [1e15, 1e15, 1.0]), (50, [1e300, 1.0]), (2, [-1e300, 7.0]), (100, [0.1, 0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(vector_topk.top_products(df)) == plain_top(rows)
    assert vector_topk.top_products(df.where("vec_id < 0")).count() == 0
    assert vector_topk.top_products(df.where("vec_id = 50")).count() == 0


def test_bounds_hold_and_leave_few_products():
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(30, 64)).repeat(100, axis=0) * 100 + r.normal(size=(3000, 64)) * 8).astype("<i2")
    block = vector_topk.Searched(x, np.arange(3000), np.arange(3000))
    for s in vector_topk.SEGMENTS:
        level = np.hstack(vector_topk.segment_statistics(x, s))
        assert (level[:50] @ level.T >= x[:50].astype(float) @ x.T.astype(float) - 1e-6).all()
    for q in range(0, 3000, 100):
        _, scores = block.best(x[q : q + 1], np.array([q]), np.array([-np.inf]), 5)[0]
        every = x.astype(np.int64) @ x[q].astype(np.int64)
        every[q] = NO
        assert scores.tolist() == sorted(every.tolist(), reverse=True)[:5]
    assert block.exact < 0.2 * 30 * 3000


# ---- resampling -----------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, percent=5, least=20, buckets=10000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in plain_features(x)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    out = []
    for i, text in rows:
        n, f = plain_features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], own_id(r[0]), -r[1]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return collections.Counter(tuple(r[:5]) for r in out)


def prose(seed, n=400):
    r = random.Random(seed)
    words = ["The", "an", "x1", "été", "naïve", "ПРИВЕТ", "ABC-def", "a_b", "3.14", "\x00", "z" * 300, "!", "日本語", "tail"]
    rows = [(i * 7 % 1000, " ".join(r.choices(words, k=r.choice([0, 5, 19, 20, 40, 90])))) for i in range(n)]
    rows += [(None, rows[0][1])] * 30 + [(5, rows[4][1])] * 25 + [(2000, None), (2001, ""), (2002, " ,;"), (2003, "one"), (2004, "two words")]
    return rows + [(3000 + i, "the an x1 tail " * 8) for i in range(200)]


DOCS = "doc_id long, text string, score string, row string, weight string"


@pytest.mark.parametrize(("percent", "range_rows", "block"), [(5, 1_000_000, 4096), (40, 20, 3), (100, 50, 1)])
def test_resample(spark, monkeypatch, percent, range_rows, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rows = prose(5)
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS).repartition(5)
    target = spark.createDataFrame([("the an x1",), (None,), ("été",)], "text string")
    out = resampling.resample(docs, target, percent=percent, range_rows=range_rows)
    assert collections.Counter(tuple(r) for r in out.collect()) == plain_resample(rows, ["the an x1", None, "été"], percent)
    assert sorted(out.schema.names) == sorted(["doc_id", "n_features", "weight", "score", "rank"])


def test_resample_of_empty_tables(spark):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in prose(6, 30)], DOCS)
    none = docs.where("doc_id = -1")
    assert resampling.resample(none, docs).count() == 0
    got = collections.Counter(tuple(r) for r in resampling.resample(docs, none.select("text")).collect())
    assert got == plain_resample(prose(6, 30), [])


def test_features_of_long_texts(monkeypatch):
    """Cut texts have the features of the uncut ones."""
    texts = [" ".join(str(i % 97) + "é" * (i % 5) for i in range(4000)), "w" * 9000, "", "a", "b " * 3000 + "." * 5000 + " c d e"]
    for size in (64, 501):
        monkeypatch.setattr(resampling, "PIECE", size)
        found, words = collections.defaultdict(collections.Counter), collections.Counter()
        for numbers, c, who, n in resampling.features([t.encode() for t in texts]):
            for k, b in zip(who.tolist(), c.tolist(), strict=True):
                found[numbers[k]][b] += 1
            words.update(dict(zip(numbers, n.tolist(), strict=True)))
        for k, t in enumerate(texts):
            n, f = plain_features(t)
            assert found[k] == collections.Counter(zlib.crc32(x.encode()) % 10000 for x in f) and words[k] == n


@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=300)), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_joined_checksums(pairs):
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = resampling.joined_checksum(a, b, np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in pairs]


@given(st.lists(st.lists(st.integers(0, 50), max_size=30), max_size=9), st.integers(1, 5), st.integers(0, 200))
@settings(max_examples=150, deadline=None)
def test_merged_runs(runs, block, most):
    runs = [sorted((v, k, i) for i, v in enumerate(run)) for k, run in enumerate(runs)]
    blocks = sorted(((run[at], k, run[at : at + block]) for k, run in enumerate(runs) for at in range(0, len(run), block)), key=lambda b: b[0])
    got = list(resampling.merged(((k, items) for _, k, items in blocks), most))
    assert got == sorted(x for run in runs for x in run)[:most]


# ---- conversation trie ----------------------------------------------------------------------------------------------


def talk(seed=2, n=70):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "tool"]), r.choice(["hi", "ho", "é", ""])) for c in range(n) if c % 17 for t in range(r.choice([1, 2, 3, 6, 12]))]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(40) for t in range(5)]  # copies
    rows += [(200 + c, 0, "system", "one first turn") for c in range(30)] + [(200 + c, 1, "user", str(c)) for c in range(30)]
    rows += [(301, None, "user", "null turn"), (301, 0, None, None), (301, 0, None, None), (None, 0, "user", "lost"), (-7, 0, "user", "hi"), (-5, 0, "user", "below"), (-5, 1, "user", "x")]
    return rows + [(403, t, "user", "deep" if t % 7 else "é" * 50) for t in range(300)]


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((t is not None, t or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    nodes = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    out = collections.Counter()
    children = collections.defaultdict(list)
    for v in nodes:
        if v:
            children[v[:-1]].append(v)
    total = {}
    for v in sorted(nodes, key=len, reverse=True):
        below = [total[u] for u in children[v]]
        total[v] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(nodes[v]) - 1) * (len(v[-1][1].encode()) if v else 0))
    for v, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(v))
        out[min(members), len(v), min(nodes[v[:-1]]) if v else None, len(members), len(children[v]), *total[v], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


TALK = "conv_id long, turn long, role string, text string, node string, depth string, _range string"


@pytest.mark.parametrize("piece", [40, 16_000])
def test_prefix_trie(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = talk()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TALK).repartition(3)
    out = prefix_trie.prefix_trie(df)
    assert collections.Counter(tuple(r) for r in out.collect()) == plain_trie(rows)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(3, 0, "a", "b")], [(c, 0, "a", "b") for c in range(30)], [(c, t, "u", f"{c >> max(0, 5 - t)}") for c in range(0, 320, 5) for t in range(7)]])
def test_small_tries(spark, rows):
    """Without rows, with turnless conversations, with one node for all, and a tree that branches at each depth."""
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert collections.Counter(tuple(r) for r in prefix_trie.prefix_trie(df).collect()) == plain_trie(rows)


def test_sums_carried_over_ranges(spark):
    """A group that fills several ranges goes on from one to the next."""
    rows = [(g, i, i % 5) for g, n in ((1, 3), (2, 400), (3, 1), (4, 50)) for i in range(n)]
    ranged = prefix_trie.ranged(spark.createDataFrame(rows, "g long, i long, v long"), ["g", "i"], 9)
    got = {(r.g, r.i): r.s for r in prefix_trie.carried_sums(ranged, "g", ["i"], {"s": "v"}).collect()}
    so_far = collections.Counter()
    for g, i, v in sorted(rows):
        so_far[g] += v
        assert got[g, i] == so_far[g]
