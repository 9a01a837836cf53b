"""The corpus operators against plain loops over a small corpus with awkward rows."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseframe.llm import decontamination, line_dedup, mixing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, toxicity
from pulseframe.llm.arrays import encode, windowed_parts, words
from pulseframe.llm.common import components, evenly
from pulseframe.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, chunk string, key string, score string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus() -> list[tuple]:
    """Prose with copies, near copies, shared passages and lines, and rows that are empty, null, tied or repeated."""
    r = random.Random(4)
    vocabulary = [a + b for a in ("the", "an", "tion", "er", "ou", "ñé", "x") for b in ("", "s", "ing", "a", "or", "ed", "zu", "!")]
    prose = lambda n: " ".join(r.choice(vocabulary) + ("\n" if r.random() < 0.04 else "") for _ in range(n))
    passage, line = prose(70), "A line that stands in many documents, License 3.0 of all."
    texts = [prose(r.choice([3, 30, 120, 400])) for _ in range(60)]
    texts += [texts[0]] * 12 + [texts[5].replace("the", "she", 1), texts[5] + " end", texts[7].upper()]
    texts += [f"{prose(15)} {passage} {prose(10)}" for _ in range(6)] + [f"{prose(8)}\n  {line.upper() if i % 2 else line}\t\n{prose(5)}" for i in range(7)]
    texts += [None, "", " \n\t ", "\0" * 120, "\0" * 130, "a " * 90, "a " * 95, "one", "two words", "\n\n", " ".join(["long"] * 3000) + prose(3000), "é" * 60, " ".join(["em"] * 60)]
    rows = [(i * 3 % 97 + i // 97 * 97, t, "en", f"src{i % 5}" if i % 9 else None, 0) for i, t in enumerate(texts)]
    rows += [(None, prose(60), "en", "src0", 0), (7, texts[7], None, "", 0), (7, texts[7], None, "", 0)]
    return [(*x, "own", "c", "k", "s") for x in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int("!" in (r[1] or "")), int("zu" in (r[1] or ""))) for r in rows if r[0] is None or r[0] % 2 == 0] + [(None, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")


def bag(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def own_id(i):
    return -(2**63) if i is None else i


def test_quality_rules(spark, docs, labels, rows, empty):
    out = quality_rules.quality_rules(docs, labels)
    want = collections.Counter()
    for i, text, *_ in rows:
        t = text or ""
        w = t.encode().split()
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        covered = {k + j for p in at.values() if len(p) > 1 for k in p for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        bad = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), bad] += 1
    assert bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    # the ratio by a plain count over all documents; xxhash is Spark's hash of a string with the seed 42
    h = lambda x: xxhash.xxh64_intdigest(x, 42)
    grams = {}
    for _, text, *_ in rows:
        w = (text or "").encode().split()
        pair = [xxhash.xxh64_intdigest(b, h(a)) for a, b in zip(w, w[1:], strict=False)]
        grams[text] = [v % 65536 if v < 2**63 else (v - 2**64) % 65536 for v in [*map(h, w), *pair]]
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - {None}
    target, raw = collections.Counter(), collections.Counter()
    for i, text, *_ in rows:
        raw.update(grams[text])
        if i in good:
            target.update(grams[text])
    share, k = sum(target.values()) / sum(raw.values()), quality_rules.SMOOTHING
    for r in out.collect():
        texts = [t for i, t, *_ in rows if i == r.doc_id]
        g = grams[texts[0]]
        llr = sum(math.log((target[b] + k) / (raw[b] * share + k)) for b in g) / len(g) if g else 0.0
        assert any(abs(r.llr - x) < 1e-9 for x in [llr] + [sum(math.log((target[b] + k) / (raw[b] * share + k)) for b in grams[t]) / max(1, len(grams[t])) for t in texts])
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("llr <> 0").count() == 0


def test_mixing(spark, docs, rows, empty):
    out = mixing.mix(docs).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(sizes.values()) == sum(len((r[1] or "").encode().split()) for r in rows) and len(out) == len(rows)
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [3, 1, 2] * 9, strict=False))
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or set(open_):
            want[s] = 2 * sizes[s] if full else level * weight[s]
            left -= want[s]
            open_.discard(s)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-4 and taken[s] == math.floor(target[s] + 1e-9)
    assert bag(mixing.mix(docs.repartition(7)), "doc_id", "source", "size", "taken") == bag(mixing.mix(docs), "doc_id", "source", "size", "taken")
    made = mixing.materialise(docs)
    assert made.columns == docs.columns and made.count() == sum(r.copies for r in out)
    assert mixing.mix(empty).count() == 0 and mixing.materialise(empty).count() == 0


def plain_suffix_dedup(rows):
    first, want = {}, collections.Counter()
    for i, text, *_ in sorted(rows, key=lambda r: own_id(r[0])):
        b = encode(text)
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], own_id(i))
    for i, text, *_ in rows:
        b = encode(text)
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < own_id(i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return want


def test_suffix_dedup(docs, rows, empty):
    assert bag(suffix_dedup.dedup_suffixes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_suffix_dedup(rows)
    assert suffix_dedup.dedup_suffixes(empty).count() == 0


def crowded_rows():
    """One phrase in many surroundings, some of them shared on one side or both, and one text with a third of the rows."""
    r = random.Random(17)
    some = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    phrase, left, right = "all rights are reserved by us.", [some(60) for _ in range(40)], [some(60) for _ in range(40)]
    texts = [some(r.randint(0, 30)) + r.choice(left)[-r.randint(5, 60) :] + phrase + r.choice(right)[: r.randint(5, 60)] + some(9) for _ in range(250)]
    texts += ["\0" * 90 + phrase + "\0" * 90, phrase + "\0" * 51, "\0" * 52 + phrase] + [some(70)] * 120
    return [(None if k % 7 == 0 else k // 2, t) for k, t in enumerate(texts)]


def test_suffix_dedup_of_crowded_strings(spark, monkeypatch):
    """Small chunks, several of them in a bucket, many parts, texts longer than a piece, and k-grams over a part's share."""
    for module, name, value in (("chunks", "CHUNK_BYTES", 3000), ("chunks", "MOST_BUCKETS", 4), ("suffix_dedup", "PIECE", 64), ("suffix_dedup", "MERGE_BYTES", 400), ("suffix_dedup", "MOST_RANGES", 40)):
        monkeypatch.setattr(f"pulseframe.llm.{module}.{name}", value)
    learned, learn = [], suffix_dedup._learn_order
    monkeypatch.setattr(suffix_dedup, "_learn_order", lambda *x: learned.append(learn(*x)) or learned[-1])
    given = crowded_rows()
    out = suffix_dedup.dedup_suffixes(spark.createDataFrame(given, "doc_id long, text string"))
    assert bag(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_suffix_dedup(given)
    assert len(learned[0].heavy) and len(learned[0].light) and learned[0].each > 1 and len(learned[0].strings)


def test_evenly_dealt(spark):
    d = spark.range(5000).withColumn("n", F.col("id") * 429_496)
    assert d.where(F.hash(evenly(F.col("n"))) != F.col("n")).count() == 0
    assert sorted(r.n for r in d.limit(60).repartition(6, evenly(F.col("id"))).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) == [10] * 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), min_size=1, max_size=9))
def test_loser_tree(lists):
    runs = [sorted(set(x)) for x in lists]
    got = list(suffix_dedup.merge([suffix_dedup.FrontCoded.decode(suffix_dedup.FrontCoded.encode(r)) for r in runs]))
    assert [g[:2] for g in got] == sorted((s, i) for i, r in enumerate(runs) for s in r)
    for a, b in zip(got, got[1:], strict=False):
        assert b[2] == suffix_dedup.common_prefix(a[0], b[0])


def test_substring_dedup(docs, rows, empty):
    seen, want = set(), collections.Counter()
    for i, text, *_ in sorted(rows, key=lambda r: (own_id(r[0]), encode(r[1]))):
        w = encode(text).split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    assert bag(substring_dedup.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_dedup_compares_the_words_themselves(spark):
    """Words on which sums modulo 2**64 collide: a long word of two letters and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 11)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    shared = " ".join(f"w{k}" for k in range(19))
    out = substring_dedup.dedup_substrings(spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {two}"), (3, f"{shared}  {two}\n")], "doc_id long, text string"))
    assert bag(out, "doc_id", "n_words", "n_removed") == collections.Counter([(1, 20, 0), (2, 20, 0), (3, 20, 20)])


def test_substring_dedup_in_small_chunks(spark, monkeypatch):
    """Many chunks in few buckets, many parts, texts longer than a piece, and rows that share a doc_id or have none."""
    for module, name, value in (("chunks", "CHUNK_BYTES", 3000), ("chunks", "MOST_BUCKETS", 3), ("substring_dedup", "DECIDE_BYTES", 900), ("substring_dedup", "PART_BYTES", 900), ("arrays", "PIECE", 128)):
        monkeypatch.setattr(f"pulseframe.llm.{module}.{name}", value)
    r = random.Random(31)
    prose = lambda n: " ".join(r.choice(["aa", "b", "cde", "fgh", "ij"]) + str(r.randrange(40)) for _ in range(n))
    shared = [prose(45) for _ in range(4)]
    given = [(k, f"{prose(r.randrange(40))} {r.choice(shared)[r.randrange(60):]} {prose(9)}\n{r.choice(shared)}") for k in range(120)] + [(200 + k, shared[0]) for k in range(60)]
    seen, want = set(), collections.Counter()
    for i, text in given:
        w = text.split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        want[i, len(w), sum(gone)] += 1
    assert bag(substring_dedup.dedup_substrings(spark.createDataFrame(given, "doc_id long, text string").repartition(5)), "doc_id", "n_words", "n_removed") == want
    tied = spark.createDataFrame([(None, t) for _, t in given[:60]] + [(1, f"{shared[1]} x")], "doc_id long, text string")
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(tied).collect()}
    assert out[1].n_removed == 45  # the null ids come before it


def plain_fingerprint(text):
    w = (text or "").translate(LOW).encode().split()
    grams = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    fp = [plain_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                parent[root(a)] = root(b)
    low = collections.defaultdict(lambda: 2**63)
    for k, r in enumerate(rows):
        low[root(k)] = min(low[root(k)], own_id(r[0]))
    want = collections.Counter((r[0], f"{fp[k]:016x}", None if low[root(k)] == own_id(None) else low[root(k)]) for k, r in enumerate(rows))
    assert bag(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs, 4)
    assert kept.columns == docs.columns and kept.count() == len({root(k) for k in range(len(rows))})


def test_keep_first_with_tied_ids(spark):
    """Groups whose smallest doc_id is the same value, null or not, keep one row each."""
    r = random.Random(11)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(9)]
    given = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (50, texts[2]), (4, texts[3]), (4, texts[4]), (51, texts[4]), (4, texts[5]), (6, texts[6]), (6, texts[6]), (7, texts[7]), (None, texts[8]), (8, texts[8])]
    d = spark.createDataFrame(given, "doc_id long, text string")
    want = collections.Counter([(None, texts[0]), (None, texts[1]), (None, texts[2]), (4, texts[3]), (4, texts[4]), (4, texts[5]), (6, texts[6]), (7, texts[7]), (None, texts[8])])
    assert bag(simhash.keep_first(d), "doc_id", "text") == want


def test_ball_links_find_all(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {b for x in base for b in [x, *(x ^ sum(1 << k for k in r.sample(range(64), n)) for n in (1, 2, 3, 4, 5) for _ in range(6))]} | {0, 1, 3, 7, 15, 31}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    group = {x: x for x in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for l in links:
        assert ((l.a ^ l.b) & (2**64 - 1)).bit_count() <= 4
        group[root(l.a % 2**64)] = root(l.b % 2**64)
    listed = list(fps)
    for k, a in enumerate(listed):
        for b in listed[:k]:
            if (a ^ b).bit_count() <= 4:
                assert root(a) == root(b)


def test_crowded_keys_are_sliced(spark, monkeypatch):
    """Fingerprints that all share their leading bits are dealt over slices, and every link is still found."""
    monkeypatch.setattr(simhash, "AT_ONCE", 20_000)
    r = random.Random(5)
    centre = 0xABC << 52 | r.getrandbits(40)
    fps = {centre ^ sum(1 << k for k in r.sample(range(40), r.choice([1, 2, 3]))) for _ in range(2600)}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    c = components(links).select("component").distinct().count()
    assert c == 1 and components(links).count() == len(fps)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (3, 8), (7, 5)], "a long, b long")
    assert bag(components(e), "node", "component") == collections.Counter({(1, 1): 1, (2, 1): 1, (3, 1): 1, (8, 1): 1, (4, 4): 1, (5, 4): 1, (7, 4): 1})


def test_sharding(spark, docs, rows, empty):
    out = sharding.shard_documents(docs, 5).collect()
    assert bag(spark.createDataFrame([(r.doc_id, r.size, r.text_crc32) for r in out], "a long, b long, c long"), "a", "b", "c") == collections.Counter((i, len(encode(t)) + 1, zlib.crc32(encode(t))) for i, t, *_ in rows)
    groups = collections.defaultdict(lambda: [2**63, 0])
    for i, t, *_ in rows:
        g = groups[encode(t)]
        g[0], g[1] = min(g[0], own_id(i)), g[1] + len(encode(t)) + 1
    sizes = [g[1] for _, g in sorted(groups.items(), key=lambda x: (x[1][0], hashlib.sha256(x[0]).hexdigest()))]

    def fits(c):
        n, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            n, held = (n, held + s) if held + s <= c else (n + 1, s)
        return n <= 5

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    load = collections.Counter()
    slots = collections.defaultdict(list)
    for r in out:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(load.values()) <= best == out[0].capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    of_text = collections.defaultdict(set)
    for r in out:
        for t in {t for i, t, *_ in rows if i == r.doc_id and len(encode(t)) + 1 == r.size}:
            of_text[t or ""].add(r.shard)
    assert all(len(s) == 1 for t, s in of_text.items() if sum(1 for x in rows if (x[1] or "") == t) > 1 and t)
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_minimax_by_small_pictures(spark, seed):
    """The driver's picture is refined until the cuts are exact, however coarse it begins."""
    r = random.Random(seed)
    sizes = [r.choice([1, 5, 40, 300]) for _ in range(200)]
    upto = np.cumsum(sizes).tolist()
    g = spark.createDataFrame(list(zip(upto, sizes, strict=True)), "upto long, size long")
    capacity, cuts = sharding.minimax_cuts(g, 7, resolution=3)
    def need(c):
        n, held = 1, 0
        for s in sizes:
            n, held = (n, held + s) if held + s <= c else (n + 1, s)
        return n
    assert capacity == next(c for c in range(max(sizes), sum(sizes) + 1) if need(c) <= 7)
    assert cuts[-1] == upto[-1] and all(b - a <= capacity for a, b in zip([0, *cuts], cuts, strict=False))


def test_line_dedup(docs, rows, empty):
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(own_id(i))
    want = collections.Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and own_id(i) != max(holders[key(x)]))]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert bag(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_text") == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_index_is_reversible(spark, docs):
    some, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 or doc_id is null")
    ix = line_dedup.LineIndex.empty(spark).insert(some)
    both = ix.insert(rest).insert(some)  # the second insertion counts nothing twice
    every = line_dedup.LineIndex.empty(spark).insert(docs)
    counts = lambda x: bag(x.counts(), "key", "n_docs", "last")
    assert counts(both) == counts(every) and counts(both.delete(rest)) == counts(ix) and not counts(both.delete(docs))


def test_line_index_by_a_plain_set(spark, monkeypatch):
    """Random batches in and out; most filters grow on the way, some answer wrongly yes, and the table decides."""
    monkeypatch.setattr(line_dedup.CuckooFilter, "_places", lambda f, v: plain_places(f, v))
    r = random.Random(9)
    line = lambda k: f"line {k} " + "x" * 40
    texts = {i: "\n".join(line(r.randrange(60)) for _ in range(r.randrange(1, 9))) for i in range(150)}
    ix, have, probed = line_dedup.LineIndex.empty(spark, 3), set(), 0
    for some, out in ((range(10), False), (range(5, 90), False), (range(40, 60), True), (range(30, 150), False), (range(0, 150, 3), True), (range(150), False)):
        d = spark.createDataFrame([(i, texts[i]) for i in some], "doc_id long, text string")
        ix = ix.delete(d) if out else ix.insert(d)
        have = have - set(some) if out else have | set(some)
        want = collections.defaultdict(set)
        for i in have:
            for x in texts[i].split("\n"):
                want[hashlib.sha256(x.encode()).hexdigest()[:32]].add(i)
        assert bag(ix.counts(), "key", "n_docs", "last") == collections.Counter((k, len(v), max(v)) for k, v in want.items())
        assert ix.table.groupBy("key", "id").agg(F.sum("sign").alias("n")).where("n not in (0, 1)").count() == 0


def plain_places(f, values):
    """Few tags, so that the filter is often wrong."""
    from pulseframe.llm.arrays import mixed

    h = mixed(values.astype(np.uint64))
    tag = (h >> np.uint64(60)).astype(np.uint16) + np.uint16(1)
    one = (h & np.uint64(f.buckets - 1)).astype(np.int64)
    return tag, one, f._other(one, tag)


@settings(max_examples=20, deadline=None)
@given(st.sets(st.integers(0, 2**63), max_size=300), st.sets(st.integers(0, 2**63), max_size=100))
def test_cuckoo_filter(values, gone):
    f = line_dedup.CuckooFilter(max(1, len(values) // 2))  # too small, so some overflow
    v = np.array(sorted(values), np.uint64)
    f.add(v)
    assert f.may_have(v).all()
    out = np.array(sorted(values & gone) or [], np.uint64)
    f.remove(out)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.may_have(np.array(sorted(values - gone), np.uint64)).all()


def test_decontamination(spark, docs, empty):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(12)) + "? " + " ".join(word() for _ in range(4)) + ".") for k in range(30)] + [(98, None), (99, "")]
    clean = [" ".join(word() for _ in range(60)) for _ in range(20)]
    leaks = [(1000 + k, f"{' '.join(word() for _ in range(r.choice([0, 7, 90])))} {items[k][1].upper() if k % 2 else items[k][1]} {' '.join(word() for _ in range(20))}") for k in range(10)]
    halves = [(2000 + k, clean[k] + " " + items[k][1].split("?")[0]) for k in range(5)]  # the question alone is no leak
    d = spark.createDataFrame(leaks + halves + [(3000 + k, c) for k, c in enumerate(clean)] + [(None, leaks[0][1]), (4000, None), (4001, "")], "doc_id long, text string")
    bm = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter({(1000 + k, k): 1 for k in range(10)} | {(None, 0): 1})
    assert bag(decontamination.decontaminate(d, bm), "doc_id", "item_id") == want
    assert bag(decontamination.decontaminate(d, bm, index_bytes=900), "doc_id", "item_id") == want  # several shards
    assert decontamination.decontaminate(empty, bm).count() == 0 and decontamination.decontaminate(d, bm.limit(0)).count() == 0
    assert decontamination.decontaminate(docs, bm).count() == 0


@pytest.mark.parametrize("cells", [0, 1 << 22])
@pytest.mark.parametrize("seed", range(3))
def test_wand_finds_all_over_the_threshold(seed, cells, monkeypatch):
    monkeypatch.setattr(decontamination, "DENSE_CELLS", cells)
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choices(vocabulary, k=12)), " ".join(r.choices(vocabulary, k=3))) for k in range(50)]
    df = collections.Counter(x for _, q, a in items for x in np.unique(decontamination.own_words(f"{q} {a}")).tolist())
    ix = decontamination.Index.build(items, df, 50, 15.0)
    for _ in range(30):
        t = np.unique(ix.term_of(words([encode(" ".join(r.choices(vocabulary, k=25)))], True, True).hash))
        t = t[t >= 0].tolist()
        score = collections.Counter()
        for k in t:
            for item, w in zip(ix.item[ix.first[k] : ix.first[k + 1]].tolist(), ix.weight[ix.first[k] : ix.first[k + 1]], strict=True):
                score[item] += w
        _, good = ix.blocks(np.zeros(len(t), np.int64), np.array(t, np.int64), 0.5)
        assert {i // decontamination.BLOCK for i, x in score.items() if x >= 0.5} <= set(good.tolist())
        got = ix.wand(t, good.tolist(), 0.5)
        assert sorted(i for i, _ in got) == sorted(i for i, s in score.items() if s >= 0.5)


def labelled_corpus(spark, n=600):
    r = random.Random(1)
    word = lambda: r.choice(["the", "of", "and"]) if r.random() < 0.4 else "".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(r.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.choice([5, 40, 90]))]
        toxic, good = r.random() < 0.3, r.random() < 0.7
        if toxic:
            w[r.randrange(len(w))] = r.choice(["idiot", "scum", "zuqua" + word()])
        if not good:
            w = [x + r.choice(["!!", "***"]) for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame([*docs, (None, "the of"), (n, ""), (n + 1, None)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def labelled(spark):
    return labelled_corpus(spark)


@pytest.mark.parametrize(("run", "label", "modulus", "rest", "threshold"), [(toxicity.score, "toxic", 4, 2, 0.3), (quality_classifier.classify, "quality", 3, 1, 0.5)])
def test_classifiers(spark, labelled, empty, run, label, modulus, rest, threshold):
    docs, labels = labelled
    out = run(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(out) == docs.count()
    right = held = 0
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        if r.held_out and r[label] is not None:
            held += 1
            right += r.predicted == r[label]
    assert right / held > 0.85
    # held-out labels change nothing
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, 1 - F.col(label)).otherwise(F.col(label)))
    assert bag(run(docs, flipped), "doc_id", "score") == bag(run(docs, labels), "doc_id", "score")
    assert run(empty, labels).count() == 0 and run(docs, labels.limit(0)).count() == docs.count()


def test_network_gradients():
    """Against finite differences, in double precision."""
    rng = np.random.default_rng(0)
    shapes = {"A": (2 * toxicity.HIDDEN, toxicity.ATTEND), "v": (toxicity.ATTEND,), "o": (2 * toxicity.HIDDEN,), "bias": (1,)}
    for d in "fb":
        shapes |= {"W" + d: (2 * toxicity.DIM, 3 * toxicity.HIDDEN), "c" + d: (3 * toxicity.HIDDEN,), "U" + d: (toxicity.HIDDEN, 2 * toxicity.HIDDEN), "V" + d: (toxicity.HIDDEN, toxicity.HIDDEN)}
    m = {k: rng.standard_normal(s) * 0.5 for k, s in shapes.items()}
    x, mask, y = rng.standard_normal((5, 3, 2 * toxicity.DIM)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0.0]]), np.array([1, 0, 1.0])

    def loss(m, x):
        p = np.clip(toxicity.forward(m, x, mask).astype(float), 1e-6, 1 - 1e-6)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g, dx = toxicity.gradients(m, x, mask, y)
    for k, v in m.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(3)]:
            up, down = {**m, k: v.copy()}, {**m, k: v.copy()}
            up[k][at] += 1e-3
            down[k][at] -= 1e-3
            assert abs((loss(up, x) - loss(down, x)) / 2e-3 - g[k][at]) < 2e-3, (k, at)


def test_windows_cover_all_words():
    w = words([b"", b"a", b" ".join(b"w%d" % k for k in range(77)), b"x " * 32, b"y " * 33])
    first, length, doc = toxicity.windows(w)
    n = np.diff(w.docs_from())
    for d in range(5):
        seen = set()
        for f, k in zip(first[doc == d], length[doc == d], strict=True):
            assert 1 <= k <= toxicity.WINDOW
            seen |= set(range(f, f + k))
        assert len(seen) == n[d]


def plain_network(m, text):
    """Largest window score by a plain loop over words, steps and units, in double precision."""
    w = words([encode(text)], lower=True)
    if not len(w.start):
        return 1 / (1 + math.exp(-m["bias"][0])), 0
    word, gram, first = toxicity.tokens(w)
    x = [np.concatenate([m["word"][word[i]], sum(m["char"][g].astype(float) for g in gram[first[i] : first[i + 1]])]).astype(float) for i in range(len(word))]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    scores, at = [], 0
    while True:
        part, states, n = x[at : at + toxicity.WINDOW], [], toxicity.HIDDEN
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            h, out = np.zeros(n), {}
            for t in order:
                p = part[t] @ m["W" + d] + m["c" + d]
                gate = sigmoid(p[: 2 * n] + h @ m["U" + d])
                u, r = gate[:n], gate[n:]
                h = (1 - u) * h + u * np.tanh(p[2 * n :] + (r * h) @ m["V" + d])
                out[t] = h
            states.append(out)
        s = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(part))]
        e = np.array([np.tanh(v @ m["A"]) @ m["v"] for v in s])
        e = np.exp(e - e.max())
        scores.append(float(sigmoid(sum(a * v for a, v in zip(e / e.sum(), s, strict=True)) @ m["o"] + m["bias"][0])))
        if at + toxicity.WINDOW >= len(x):
            return max(scores), len(scores)
        at += toxicity.STRIDE


@pytest.fixture(scope="module")
def network():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    rows = [(" ".join([word() for _ in range(r.choice([3, 40, 120]))] + (["scum"] if k % 3 == 0 else [])), int(k % 3 == 0)) for k in range(90)]
    return toxicity.fit(rows, epochs=2), [t for t, _ in rows] + ["", " \n", "one", "A\tb\n\nC " * 33, "\n".join(word() for _ in range(300)), "é ü " * 20]


def test_toxicity_scores_by_a_plain_loop(network):
    m, texts = network
    score, n = toxicity.score_texts(m, [encode(t) for t in texts])
    for t, a, b in zip(texts, score, n, strict=True):
        want, windows = plain_network(m, t)
        assert abs(a - want) < 1e-4 and b == windows


@pytest.mark.parametrize("size", [64, 301])
def test_scores_do_not_depend_on_where_long_texts_are_cut(network, monkeypatch, size):
    """Toxicity, quality features and passages are those of the uncut text."""
    m, texts = network
    data = [encode(t) for t in texts]
    r = random.Random(size)
    weights = np.array([r.uniform(-1, 1) for _ in range(1 << quality_classifier.BITS)])
    whole, quality = toxicity.score_texts(m, data), quality_classifier.score_texts(data, weights, 0.1)
    monkeypatch.setattr("pulseframe.llm.arrays.PIECE", size)
    cut, quality_cut = toxicity.score_texts(m, data), quality_classifier.score_texts(data, weights, 0.1)
    assert np.allclose(whole[0], cut[0], atol=1e-5) and (whole[1] == cut[1]).all() and np.allclose(quality, quality_cut)
    for t in data:
        w = words([t], True, True)
        found = [w.hash[k * 16 : k * 16 + 32].tolist() for k in range(max(1, -(-len(w.hash) // 16) - 1))] if len(w.hash) else []
        parts = [p.hash[k * 16 : k * 16 + 32].tolist() for p, _, n in windowed_parts(t, 32, 16, True, True) for k in range(n)]
        assert parts == found


@pytest.mark.parametrize("cells", [0, 1 << 22])
@pytest.mark.parametrize("size", [1 << 20, 200])
def test_decontamination_finds_the_same_passages_in_cut_texts(monkeypatch, size, cells):
    monkeypatch.setattr("pulseframe.llm.arrays.PIECE", size)
    monkeypatch.setattr(decontamination, "DENSE_CELLS", cells)
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(12)) + "? " + " ".join(word() for _ in range(4)) + ".") for k in range(8)]
    before = [0, 1, 15, 16, 17, 31, 200, 333]
    texts = [encode(" ".join(word() for _ in range(n)) + " " + items[k][1] + " " + " ".join(word() for _ in range(90))) for k, n in enumerate(before)]
    part = [(k, *decontamination.question_and_answer(t)) for k, t in items]
    df = collections.Counter(x for _, q, a in part for x in np.unique(decontamination.own_words(f"{q} {a}")).tolist())
    found = decontamination.leaks(decontamination.Index.build(part, df, 8, 16.0), texts, 16, 0.6, 0.8, 0.8)
    assert {(d, item): first for d, item, _, _, _, first in found} == {(k, k): max(0, -(-(n + 16) // 16) * 16 - 32) for k, n in enumerate(before)}


def test_anchors_and_words_of_cut_texts(monkeypatch):
    """A chunk's anchors and word hashes do not depend on where long texts are cut."""
    texts = [t for _, t in crowded_rows()] + [" ".join(t for _, t in crowded_rows()), "", None]
    d = pd.DataFrame({"_id": np.arange(len(texts)), "_h": 0, "text": texts})
    whole, words_ = suffix_dedup._Chunk(d, 50, 25), substring_dedup._Chunk(d)
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr("pulseframe.llm.arrays.PIECE", 64)
    cut, cut_words = suffix_dedup._Chunk(d, 50, 25), substring_dedup._Chunk(d)
    starts = lambda c: {(t, s): (int(h), a) for t, a, x, y, h in zip(c.of.tolist(), c.at.tolist(), c.first.tolist(), c.last.tolist(), c.hash.tolist(), strict=True) for s in range(x, y + 1)}
    assert starts(whole) == starts(cut) and (words_.hash == cut_words.hash).all() and words_.counts == cut_words.counts


def test_fit_follows_the_regularised_leader():
    """Weights by a plain loop over dictionaries."""
    rows = [("good text here now", 1), ("bad!! text here!!", 0), ("", 0), ("good good now", 1)]
    got, intercept = quality_classifier.fit(rows, epochs=3)
    z, n, order = collections.defaultdict(float), collections.defaultdict(float), np.random.default_rng(11)
    alpha, beta, l1, l2, one = 0.3, 1.0, 0.05, 1.0, 1 << quality_classifier.BITS

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for k in order.permutation(4):
            count = collections.Counter(quality_classifier.features(words([encode(rows[k][0])]))[0].tolist())
            x = {i: c / math.sqrt(max(1, sum(count.values()))) for i, c in count.items()} | {one: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - rows[k][1]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    assert abs(intercept - weight(one)) < 1e-9
    assert {i: round(v, 9) for i, v in enumerate(got.tolist()) if v} == {i: round(weight(i), 9) for i in z if i != one and weight(i)}


def test_sharding_levels_the_rest_around_a_large_group(spark):
    for copies in (range(200), range(300, 500)):
        texts = {i: "x" * 1000 for i in copies}
        d = spark.createDataFrame([(i, texts.get(i, f"{i:04d} " + "y" * (i * 7 % 180))) for i in range(600)], "doc_id long, text string")
        load = collections.Counter()
        for r in sharding.shard_documents(d).collect():
            load[r.shard] += r.size
        small = sum(load.values()) - 200 * 1001
        assert sorted(load) == list(range(16)) and max(load.values()) == 200 * 1001
        assert sorted(load.values())[-2] <= 1.05 * small / 15 + 200


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([r[:5] for r in rows if r[0] is not None], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int("zu" in (r[1] or ""))) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[20][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    got = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before, got = got, stage(spark, got, sf)
        assert got.columns == docs.columns
        got.write.parquet(str(tmp_path / f"stage{k}"))
        got = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 3:
            assert got.exceptAll(before).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == got.count()


def test_pipeline_finds_all_near_copies(spark, tmp_path):
    """The stage keeps one text of each component of the pairs whose five-word shingles have a similarity of 0.8."""
    import corpus_pipeline

    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage, texts = [word() for _ in range(30)], [None, "", " \n", "one", "ONE ", "two words", "a b c d e", "a b c d e f"]
    for k in range(30):
        base = [word() for _ in range(r.choice([12, 80, 200]))] + (passage if k % 2 else [])
        texts.append(" ".join(base))
        for changed in (1, 1, 2, 3, 4, 5, 6):
            copy = list(base)
            for at in r.sample(range(len(copy)), min(changed, len(copy) // 12 + 1)):
                copy[at] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for _ in range(25):  # a crowded bucket: each is near the one before, the ends are not
        chain[r.randrange(100)] = word()
        texts += [" ".join(chain)]
    split = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in split]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for k in range(len(texts)):
        low.setdefault(root(k), k)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.without_near_duplicates(spark, d, str(tmp_path))
    assert bag(kept, "doc_id") == collections.Counter((k,) for k in low.values())
    assert corpus_pipeline.without_near_duplicates(spark, d.limit(0), str(tmp_path)).count() == 0


def test_pipeline_drops_only_leaking_rows(spark, tmp_path):
    """A clean row stays, though a leaking one has the same doc_id or none as well."""
    import corpus_pipeline

    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    item, big = f"{prose(12)}? {prose(4)}.", 2**60 + 1
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = f"{prose(9)} {item} {prose(20)}"
    clean = [(None, prose(40)), (None, prose(40)), (None, None), (5, prose(40)), (6, prose(40)), (big, prose(40))]
    d = spark.createDataFrame([*clean, (None, leak), (5, leak), (5, f"{leak} more"), (big, leak), (9, leak)], "doc_id long, text string").coalesce(1)
    assert bag(corpus_pipeline.without_benchmark(spark, d, str(tmp_path)), "doc_id", "text") == collections.Counter(clean)


def test_large_doc_ids_beside_null_ones(spark):
    """A null doc_id in a batch does not round the others."""
    big = [2**60 + k for k in range(1, 4)] + [None, 5]
    d = spark.createDataFrame([(i, f"one two three {i} words " * 9) for i in big], "doc_id long, text string").coalesce(1)
    lab = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    want = collections.Counter((i,) for i in big)
    item = spark.createDataFrame([(2**60 + 1, "one two three 5 words one two three 5 words")], "item_id long, text string")
    for out in (toxicity.score(d, lab), quality_rules.quality_rules(d, lab), mixing.mix(d.withColumn("source", F.lit("s"))), suffix_dedup.dedup_suffixes(d), substring_dedup.dedup_substrings(d), simhash.near_duplicates(d), sharding.shard_documents(d), quality_classifier.classify(d, lab), line_dedup.dedup_lines(d)):
        assert bag(out, "doc_id") == want
    assert bag(decontamination.decontaminate(d.where("doc_id = 5 or doc_id is null"), item), "doc_id", "item_id") == collections.Counter([(5, 2**60 + 1)])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, name):
    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert collections.Counter(tuple(r) for r in got.select(*columns).collect()) == collections.Counter(want.fetchall())
