"""Clashing names, bounds of samples, and decontamination by all pairs of passages and items."""

import collections
import math
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulseframe.llm import common, decontamination, labelled, line_dedup, mixing, near_copies, simhash, toxicity

CLASH = ["_doc", "_source", "__source", "__k", "_k", "_row", "__row", "_copies", "_copy", "_hash", "__hash", "_d", "_s", "_h", "_toxicity", "__toxicity", "_first_id", "_first_hash", "__first_id", "_leak", "__leak", "_id", "_group", "text_hash", "key", "chunk", "a.b"]


def clashing(spark, n=60):
    """Documents with columns of all names that the stages might put beside them; a third without a doc_id."""
    r = random.Random(3)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "zu"]) for _ in range(r.randint(2, 4)))
    texts = [" ".join(word() for _ in range(r.choice([8, 30, 60]))) for _ in range(n)]
    texts += [texts[0], texts[0] + " x", None, "", None]
    rows = [(None if i % 3 == 0 else i, t, "en", f"s{i % 2}" if i % 5 else None, 0, *[f"{c}:{i}" for c in CLASH]) for i, t in enumerate(texts)]
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{c}` string" for c in CLASH]]
    return spark.createDataFrame(rows, ", ".join(names)), rows


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Every row that comes out of a stage is a row that went in, all columns unchanged, null doc_ids among them."""
    docs, rows = clashing(spark)
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, rows[20][1])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    known, got = set(rows), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        got = stage(spark, got, sf)
        assert got.columns == docs.columns, name
        got.write.parquet(f"{sf}/{k}")
        got = spark.read.parquet(f"{sf}/{k}")
        out = [tuple(r) for r in got.collect()]
        assert set(out) <= known and out, name
        assert name == "mixing" or len(out) == len(set(out)), name
    assert any(r[0] is None for r in out)
    docs.write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == len(out)


def test_copies_follow_the_mix(spark):
    """Each row stands in the mixed corpus as often as the mix says, also where rows share doc_id, source and size."""
    rows = [(None, f"w{i % 7} and {i % 3}", "s", i) for i in range(40)] + [(5, "one two three", "t", 100 + i) for i in range(6)] + [(5, "six five four", "t", 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __k long")
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.text_hash] += r.copies
    got = collections.Counter()
    for r in mixing.materialise(docs).select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h")).collect():
        got[tuple(r)] += 1
    assert got == +want


@pytest.mark.parametrize("max_bytes", [0, 60, 1000])
def test_samples_stay_under_their_bound(spark, max_bytes):
    """A doc_id on a short and several long rows is one text, and the bytes of all stay within the bound."""
    rows = [(1, "short")] + [(1, "x" * 400_000)] * 3 + [(1, "y" * 300_000)] * 2 + [(i, "word " * (i % 5)) for i in range(2, 40)] + [(50, None), (51, "")] + [(52, "z" * 900)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] * 2, "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", 3, 1, 100, max_bytes).collect()
    assert sum(len(r.text.encode()) for r in got) <= max_bytes and len({r._n for r in got}) == len(got)
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    assert all(any(r.text in t for t in texts.values()) for r in got) and (max_bytes == 0 or len(got) > 5)
    again = labelled.sample(docs.repartition(3), labels, "quality", 3, 1, 100, max_bytes).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def plain_leaks(docs, items, threshold=0.6, question=0.8, answer=0.8, run=5):
    """BM25 of every passage against every item, then the shares of word runs."""
    def own(text):
        return [x for w in re.split(r"[ \t-\r]+", text.lower()) if (x := re.sub(r"^[^a-z0-9_\x80-\U0010ffff]+|[^a-z0-9_\x80-\U0010ffff]+$", "", w))]

    split = {i: decontamination.question_and_answer(t or "") for i, t in items}
    words = {i: (own(q), own(a)) for i, (q, a) in split.items()}
    bags = {i: collections.Counter(q + a) for i, (q, a) in words.items() if q + a}
    df = collections.Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    length = max(16, *(sum(b.values()) for b in bags.values()))
    weight = {}
    for i, b in bags.items():
        w = {t: math.log1p((len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t, n in b.items()}
        weight[i] = {t: x / sum(w.values()) for t, x in w.items()}
    grams = lambda ws, n: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if n else set()
    out = collections.Counter()
    for d, text in docs:
        ws, hit = own(text or ""), set()
        for at in range(0, max(1, -(-len(ws) // length) - 1)):
            passage = ws[at * length : (at + 2) * length]
            for i, w in weight.items():
                if sum(x for t, x in w.items() if t in passage) >= threshold - 1e-12:
                    share = []
                    for part in words[i]:
                        n = min(run, len(part))
                        mine = grams(part, n)
                        share.append(len(mine & grams(passage, n)) / len(mine) if mine else 1.0)
                    if share[0] >= question and share[1] >= answer:
                        hit.add(i)
        for i in hit:
            out[d, i] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination_by_all_pairs(spark, seed):
    """Whole, cut, reordered and diluted items in short and long texts: the query finds what all pairs of passages and items do."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, f"{say(r.randint(6, 20))}? {say(r.randint(1, 6))}.") for k in range(40)] + [(90, None), (91, "one"), (92, "…")]
    docs = []
    for k in range(120):
        whole = items[r.randrange(40)][1].split()
        cut = whole[: max(1, int(len(whole) * r.choice([1, 1, 0.9, 0.8, 0.5])))]
        if r.random() < 0.2:
            r.shuffle(cut)
        docs.append((k if k % 10 else None, f"{say(r.choice([0, 3, 40, 150]))} {' '.join(cut)}, {say(r.choice([0, 5, 60]))}"))
    docs += [(500, None), (501, ""), (502, say(400)), (503, items[3][1]), (503, items[3][1])]
    d, bm = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(docs, items)
    assert sum(want.values()) > 30
    for size in (decontamination.INDEX_BYTES, 700):
        assert collections.Counter((x.doc_id, x.item_id) for x in decontamination.decontaminate(d, bm, index_bytes=size).collect()) == want


def test_the_index_is_built_once(spark, monkeypatch):
    """Not by every task: the workers get the arrays."""
    built, make = [], decontamination.Index.build
    monkeypatch.setattr(decontamination.Index, "build", classmethod(lambda cls, *a: built.append(1) or make(*a)))
    docs = spark.createDataFrame([(i, f"alpha beta gamma delta {i}") for i in range(50)], "doc_id long, text string").repartition(12)
    bm = spark.createDataFrame([(1, "alpha beta gamma. delta")], "item_id long, text string")
    decontamination.decontaminate(docs, bm).collect()
    assert len(built) == 1


def test_first_of_each_and_reject_with_their_own_names(spark):
    docs, rows = clashing(spark, 20)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(rows)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert collections.Counter(map(tuple, toxicity.reject(docs, labels).collect())) == collections.Counter(rows)


@pytest.mark.parametrize(("at_once", "block"), [(40, 7), (24, 1000)])
def test_crowded_buckets_in_parts_and_blocks(spark, monkeypatch, at_once, block):
    """Very many texts that share their rare shingles, near copies only of some: the components are those of all pairs."""
    monkeypatch.setattr(near_copies, "AT_ONCE", at_once)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "_common", lambda docs: np.zeros(0, np.uint64))
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared, texts = [word() for _ in range(12)], []
    for _ in range(40):
        own = [word() for _ in range(9)]
        for _ in range(r.choice([1, 1, 3])):
            copy = list(own)
            copy[r.randrange(9)] = word() if r.random() < 0.5 else copy[0]
            texts.append(" ".join(shared + copy))
    texts += texts[:5] * 30
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {x.doc_id for x in near_copies.keep_first(d).collect()} == {root(k) for k in range(len(texts))}


def test_near_copies_leave_no_shuffle_files(spark):
    """The files of a query go when it ends, while it is still in use on the driver; the session's setting is as before."""
    folders = [Path(x.getPath()) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {x for f in folders for x in f.rglob("shuffle_*")}
    before, setting = files(), spark.conf.get(common.DROP_SHUFFLES, None)
    d = spark.createDataFrame([(k, " ".join(f"w{k // 2} {j}" for j in range(40)) + f" x{k % 2}") for k in range(40)], "doc_id long, text string")
    kept = near_copies.keep_first(d)
    for _ in range(20):  # they go a moment later
        if not (left := files() - before):
            break
        time.sleep(0.5)
    assert not left and spark.conf.get(common.DROP_SHUFFLES, None) == setting
    assert {x.doc_id for x in kept.collect()} == set(range(0, 40, 2))


@pytest.mark.parametrize("most", [400_000, 0])
def test_components_of_few_edges_stay_in_few_partitions(spark, monkeypatch, most):
    """Whether the minima are broadcast or joined, the components are the same; a small graph doesn't spread over all partitions."""
    monkeypatch.setattr(common, "SENT", most)
    r = random.Random(5)
    edges = [(a, max(0, a - r.choice([1, 1, 2, 0]))) for a in range(300) if a % 50] + [(7, 7)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    with_edge = {x for a, b in edges if a != b for x in (a, b)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        named = common.cut(common.components(spark.createDataFrame(edges, "a long, b long")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, named.collect())) == sorted((x, root(x)) for x in with_edge)
    assert not most or named.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("compact", [1, 3])
def test_line_index_looks_up_what_the_filters_ask_for(spark, monkeypatch, compact):
    """A batch without repeats asks the exact table for next to nothing, one with repeats for these; the table stays summed up."""
    monkeypatch.setattr(line_dedup, "COMPACT", compact)
    asked, known = [], line_dedup.LineIndex.known
    monkeypatch.setattr(line_dedup.LineIndex, "known", lambda ix, rows: asked.append(rows.count()) or known(ix, rows))
    batch = lambda a, b: spark.createDataFrame([(i, "\n".join(f"line {i} {k} " + "x" * 40 for k in range(20))) for i in range(a, b)], "doc_id long, text string")
    ix = line_dedup.LineIndex.empty(spark, 4).insert(batch(0, 100)).insert(batch(100, 200))
    assert sum(asked) < 20
    asked.clear()
    ix = ix.insert(batch(190, 230))
    assert 200 <= sum(asked) < 230
    ix = ix.delete(batch(0, 230)).insert(batch(5, 15))
    assert ix.counts().count() == 200 and (compact > 1 or ix.table.count() == 200)


def test_simhash_comes_first_and_prefixes_only_fill_up(spark, monkeypatch):
    """Pairs of similarity 0.9 come from SimHash's runs of bits; without these the second step still finds the same links."""
    r = np.random.default_rng(7)
    sets = []
    for _ in range(200):
        own = r.integers(0, 1 << 63, 200, dtype=np.uint64)
        copy = own.copy()
        copy[:10] = r.integers(0, 1 << 63, 10, dtype=np.uint64)  # 190 of 210
        sets += [np.unique(own), np.unique(copy)]
    rows = [(k, len(s), near_copies.marks(s).tobytes()) for k, s in enumerate(sets)]
    b = near_copies.bands(spark.createDataFrame(rows, "hash long, n int, marks binary"), 12).toPandas().sort_values(["key", "hash"], ignore_index=True)
    got = set(near_copies._star(b, 0.8)[["a", "b"]].itertuples(index=False, name=None))
    assert len(got & {(2 * k, 2 * k + 1) for k in range(200)}) >= 190 and len(got) < 250
    words = [f"w{k}" for k in r.integers(0, 5000, 4000)]
    texts = [" ".join([*words[100 * k : 100 * k + 99], x]) for k in range(40) for x in ("p", "q")]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    asked, plausible = [], near_copies._plausible
    monkeypatch.setattr(near_copies, "_plausible", lambda pairs, *a: asked.append(pairs.count()) or plausible(pairs, *a))
    want = {(2 * k,) for k in range(40)}
    assert {(x.doc_id,) for x in near_copies.keep_first(d).collect()} == want
    assert asked[0] >= 38 and asked[1] <= 2
    monkeypatch.setattr(near_copies, "bands", lambda sets, bits: spark.createDataFrame([], "key long, hash long, n int, fp long"))
    assert {(x.doc_id,) for x in near_copies.keep_first(d).collect()} == want and asked[2] == 0 and asked[3] == 40


@pytest.mark.parametrize("n", [0, 3, 300, 30_000])
def test_signatures_grow_with_their_sets(n):
    """Sets that share a third are told apart at any size, no similar pair is, also where one signature is longer."""
    r = np.random.default_rng(n)
    own = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
    other, more = own.copy(), np.concatenate([own, r.integers(0, 1 << 63, n // 8, dtype=np.uint64)])
    other[: len(own) // 2] = r.integers(0, 1 << 63, len(own) // 2, dtype=np.uint64)
    possible = lambda a, b: near_copies._possible(np.array([len(a)]), np.array([len(b)]), *(np.array([near_copies.signature(x).tobytes(), None], object)[:1] for x in (a, b)), 0.8)[0]
    assert possible(own, own) and possible(own, more) and possible(more, own)
    assert n < 4 or not possible(own, other)


def test_python_stages_take_long_texts_in_small_batches(spark, tmp_path):
    from pulseframe.llm import common

    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def seen(batches):
        for b in batches:
            yield b.assign(n=b["text"].str.len().sum())[["n"]][:1]

    spark.conf.unset(common.BATCH_BYTES)  # other tests call stages too
    before = spark.conf.get(common.BATCH_BYTES)
    try:
        corpus_pipeline.without_toxic(spark, docs, str(tmp_path))
        n = [r.n for r in docs.mapInPandas(seen, "n long").collect()]
        assert sum(n) == 2000 * 10_000 and max(n) <= common.BATCH
    finally:
        spark.conf.unset(common.BATCH_BYTES)
    docs.limit(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() and spark.conf.get(common.BATCH_BYTES) == before
    spark.conf.set(common.BATCH_BYTES, "1m")
    try:
        corpus_pipeline.without_toxic(spark, docs, str(tmp_path))
        assert spark.conf.get(common.BATCH_BYTES) == "1m"  # an own setting stays
    finally:
        spark.conf.unset(common.BATCH_BYTES)
