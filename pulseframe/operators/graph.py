"""Graphs as tables of edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Rows that a task holds before it searches whole parts together, unless one part has more, and pairs of points that it compares at a time.
AT_ONCE, PAIRS = 100_000, 1_000_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b, of any ordered type): node and component, its smallest node.

    Every node hands the smallest of its neighbours to the others and then drops to it; each step is a minimum and an equi join.
    """
    cur = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        up = both.where("b > a").join(lowest, "a").select(F.col("to").alias("a"), "b").where("a <> b").distinct()
        first = up.groupBy("b").agg(F.min("a").alias("to"))
        down = up.join(first, "b").select(F.explode(F.array(F.struct(F.col("to").alias("a"), "b"), F.struct(F.col("to").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        cur = kept(down.where("a <> b").distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return cur.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def maximal_cliques(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, clique: every maximal clique (sorted nodes) of each key's graph; edges: key, a, b.

    For graphs of few nodes, such as methods in a comparison: a graph is one group.  Nodes without an edge are no clique.
    """
    kind = edges.schema["a"].dataType.simpleString()
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.select(*key).schema)

    def run(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        found = sorted(sorted(c) for c in _grown(set(), set(near), set(), near))
        return _frame(key, name, len(found), clique=found)

    return edges.select(*key, "a", "b").groupBy(*key).applyInPandas(run, f"{own}, clique array<{kind}>")


def _grown(clique: set, more: set, done: set, near: dict) -> Iterator[set]:
    """All maximal cliques that hold clique and take from more but not from done, branching off a node with most neighbours."""
    if not more and not done:
        if clique:
            yield clique
        return
    pivot = max(more | done, key=lambda v: (len(near[v] & more), -len(near[v])))
    for v in sorted(more - near[pivot]):
        yield from _grown(clique | {v}, more & near[v], done & near[v], near)
        more, done = more - {v}, done | {v}


def density_clusters(df: DataFrame, key: list[str], columns: list[str], tie: str, eps: float, least: int, cells: int = 8) -> DataFrame:
    """key, tie, core, cluster: density clusters of each group's points; -1 is noise, others are numbered by their first core point.

    Columns are standardised in the group.  Space is cut into parts of so many eps a side; a part gets its points and those of others
    within eps of it, so it knows all neighbours of its own.  In a first pass parts find the core points, in a second they join core
    points that are near each other; parts' clusters are connected over the points that they share.  A point near core points of
    several clusters belongs to the first of these.  Points that agree in all columns travel as one; a group goes over many tasks.
    A task searches many parts in one go, and a part gives one link for each core point, however many are near.

    Defined cases: a column without variation is 0; a null or NaN in a column leaves the row without a cluster (-1, no core point).
    """
    dims = len(columns)
    whole = df.select(*key, tie, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    fine = [F.col(f"_x{i}").isNotNull() & ~F.isnan(f"_x{i}") for i in range(dims)]
    good = fine[0]
    for f in fine[1:]:
        good = good & f
    stats = whole.where(good).groupBy(*key).agg(*[f(f"_x{i}").alias(f"_{n}{i}") for i in range(dims) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = [F.when(F.col(f"_s{i}") > 0, (F.col(f"_x{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(0.0) for i in range(dims)]
    points = kept(whole.where(good).join(stats, key).select(*key, tie, F.array(*scaled).alias("x")))  # once: sums in another order would give other digits
    places = kept(points.groupBy(*key, "x").agg(F.min(tie).alias("id"), F.count("*").alias("n")))
    side = cells * eps
    own = F.transform("x", lambda v: F.floor(v / side).cast("long"))
    spread = places.withColumn("home", own)
    part = F.array(F.array().cast("array<bigint>"))
    for i in range(dims):  # the parts that a point is within eps of
        v, c = F.element_at("x", i + 1), F.element_at("home", i + 1)
        choice = F.filter(F.array(F.when(v - c * side <= eps, c - 1), c, F.when((c + 1) * side - v <= eps, c + 1)), lambda z: z.isNotNull())
        part = _each_with(part, choice)
    spread = spread.withColumn("part", F.explode(part)).withColumn("mine", F.col("part") == F.col("home"))
    axes = [f"_z{i}" for i in range(dims)]
    spread = kept(spread.select(*key, F.concat_ws(",", "part").alias("part"), "id", "n", "mine", *[F.element_at("x", i + 1).alias(c) for i, c in enumerate(axes)]))
    kind, keys = df.schema[tie].dataType.simpleString(), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)

    by = [*key, "part"]

    def count(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        mine, n = rows["mine"].to_numpy(bool), rows["n"].to_numpy(np.int64)
        total = np.zeros(len(rows), np.int64)
        for i, j in _near(group, rows[axes].to_numpy(float), np.flatnonzero(mine), eps):
            np.add.at(total, i, n[j])
        return rows.loc[mine, [*key, "id"]].assign(core=total[mine] >= least)

    core = kept(_in_parts(spread, by, count, f"{keys}, id {kind}, core boolean"))

    def join(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        """Links of the parts' own points: a core point to the smallest of those that it is connected with here, any other to each core point near it."""
        mine, cores, x = rows["mine"].to_numpy(bool), rows["core"].to_numpy(bool), rows[axes].to_numpy(float)
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        root, a, b = np.arange(len(rows)), [], []  # by places in the order of ids
        for i, j in _near(group, x, np.flatnonzero(mine), eps):
            i, j = i[cores[j]], j[cores[j]]
            _unite(root, place[i[cores[i]]], place[j[cores[i]]])
            a.append(i[~cores[i]])
            b.append(j[~cores[i]])
        first = order[root[place]]
        some = np.flatnonzero(first != np.arange(len(rows)))
        a, b = np.concatenate([some, *a]), np.concatenate([first[some], *b])
        ids = rows["id"].to_numpy()
        return rows[key].iloc[a].assign(a=ids[a], b=ids[b], core=cores[a])

    links = kept(_in_parts(spread.join(core, [*key, "id"]), by, join, f"{keys}, a {kind}, b {kind}, core boolean"))
    node = lambda c: F.struct(*key, F.col(c).alias("id"))
    joined = components(links.where("core").select(node("a").alias("a"), node("b").alias("b")))
    named = core.where("core").select(node("id").alias("node")).join(joined, "node", "left").select(F.col("node.*"), F.coalesce("component.id", "node.id").alias("first"))
    numbers = named.select(*key, "first").distinct()
    numbers = kept(numbers.withColumn("cluster", (F.row_number().over(Window.partitionBy(*key).orderBy("first")) - 1).cast("int")))  # a row a cluster
    named = named.join(numbers, [*key, "first"]).select(*key, "id", "cluster")
    edge = links.where("not core").select(*key, "a", F.col("b").alias("id")).join(named, [*key, "id"]).groupBy(*key, F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    known = kept(core.join(named.unionByName(edge.select(*key, "id", "cluster")), [*key, "id"], "left").select(*key, "id", "core", F.coalesce("cluster", F.lit(-1)).alias("cluster")))
    at = places.select(*key, "x", "id").join(known, [*key, "id"]).select(*key, "x", "core", "cluster")
    out = points.join(at, [*key, "x"]).select(*key, tie, "core", "cluster")
    return out.unionByName(whole.where(~good).select(*key, tie, F.lit(False).alias("core"), F.lit(-1).alias("cluster")))


def _frame(key: list[str], name: tuple, n: int, **columns: list) -> pd.DataFrame:
    """A group's rows; of objects, so that no column's type is guessed where there are none."""
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in {**{c: [v] * n for c, v in zip(key, name, strict=False)}, **columns}.items()})


def _each_with(arrays: Column, values: Column) -> Column:
    """All arrays, each with each value behind it."""
    return F.flatten(F.transform(arrays, lambda a: F.transform(values, lambda v: F.concat(a, F.array(v)))))


def _in_parts(rows: DataFrame, by: list[str], body: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """body(rows, numbers of their parts) for whole parts, many at a time; a part is the rows that agree in by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def new(b: pd.DataFrame) -> np.ndarray:
            first = np.zeros(len(b), bool)
            first[:1] = True
            for c in by:
                v = b[c].to_numpy()
                first[1:] |= v[1:] != v[:-1]
            return first

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            count += len(b)
            if count < AT_ONCE:
                continue
            b = pd.concat(held, ignore_index=True)
            first = new(b)
            last = int(np.flatnonzero(first)[-1])
            if last:
                yield body(b[:last], np.cumsum(first[:last]))
            held, count = [b[last:]], (len(b) - last if last else 0)  # a part of that size is waited for by so many rows again
        if held:
            b = pd.concat(held, ignore_index=True)
            yield body(b, np.cumsum(new(b)))

    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *by).sortWithinPartitions(*by).mapInPandas(run, schema)


def _near(group: np.ndarray, x: np.ndarray, some: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of points of one group within eps of each other, i from some, j any, i too; so many are compared at a time.

    By a grid of eps a side over the first dimensions: cells that differ only in the last of these are neighbours in their order.
    """
    if not len(some):
        return
    grid = np.floor(x[:, :3] / eps).astype(np.int64)
    grid -= grid.min(axis=0) - 1
    wide = grid.max(axis=0) + 2
    lead = np.concatenate([group[:, None], grid[:, :-1]], axis=1)
    span = [int(group.max()) + 1, *wide[:-1].tolist()]
    number = np.zeros(len(x), np.int64)
    steps = [np.zeros(len(some), np.int64)]
    if np.prod([float(v) for v in (*span, wide[-1])]) < 2.0**62:
        for c, v in zip(lead.T, span, strict=True):
            number = number * v + c
        for v in span[1:]:
            steps = [s * v + d for s in steps for d in (-1, 0, 1)]
        number, last = number * wide[-1] + grid[:, -1], int(wide[-1])
        order = np.argsort(number, kind="stable")
        ranked = number[order]
        for s in steps:
            at = number[some] + s * last
            low, high = np.searchsorted(ranked, at - 1), np.searchsorted(ranked, at + 1, side="right")
            yield from _pairs(x, some, low, high, order, eps)
        return
    half = np.median(group)  # too far apart for one number: by groups, then each point with all of its group
    if (group <= half).all() or not (group <= half).any():
        half = group.max() - 1
    if group.min() == group.max():
        low = np.zeros(len(some), np.int64)
        yield from _pairs(x, some, low, low + len(x), np.arange(len(x)), eps)
        return
    for part in (np.flatnonzero(group <= half), np.flatnonzero(group > half)):
        inner = np.flatnonzero(np.isin(part, some))
        for i, j in _near(group[part] - group[part].min(), x[part], inner, eps):
            yield part[i], part[j]


def _pairs(x: np.ndarray, some: np.ndarray, low: np.ndarray, high: np.ndarray, order: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within eps of each point of some and those from low to high in the order."""
    size = high - low
    ends = np.cumsum(size)
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = size[at:to]
        i = np.repeat(some[at:to], n)
        j = order[np.repeat(low[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        near = ((x[j] - x[i]) ** 2).sum(axis=1) <= eps * eps
        yield i[near], j[near]
        at = to


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j in place; afterwards root names the smallest of each tree, for all."""
    while True:
        p, q = root[i], root[j]
        apart = p != q
        if not apart.any():
            return
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root[:] = root[root]
