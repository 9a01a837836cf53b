"""Prefix trie of conversations by heavy-path decomposition (operator 13).

A node is a sequence of first turns; it is known by a chained checksum of its turns, so no text leaves the scan.  Turns lie in ranges
of (conversation, place); what a range hands to the next one (how many turns, how far the chain) is one small row, so a
conversation of any length is split over ranges.

Each node's largest child is heavy; a heavy path runs from a light node down to a leaf, and is an end piece of the turns of that
leaf's smallest conversation.  So a path is an array over (path, depth).  Subtree totals are suffix sums along these arrays, once
each path's total has been attached to the node over its first one: paths are attached in rounds, those below most light nodes
first; a light node has at most half of its parent's members, so there are at most log2(conversations) rounds.

Defined cases: a null role or text is empty; a null turn comes first, turns of one number follow by the SHA-256 of role and text;
repeated rows are turns of their own; rows with a null conv_id take no part; a conversation without turns of its own after the
rebuilding ends at the root; an empty table has no nodes.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

FAMILY, HEAD = 5, 9
#: The chain is a polynomial in the turns' digests over this field, so ranges can hand it on.
_FIELD, _POINT = 2**127 - 1, int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
ROOT = bytes(16)
#: Characters of a joined piece of conv_ids.
PIECE = 16_000
CHAIN = "_range int, conv_id long, depth long, node binary, parent binary, bytes long, last boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (digest of role and text) and bytes (of the text) of every row with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))


def ranged(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """The rows in ranges of the order, sorted in each, with the range's number; kept in the shared folder."""
    n = parts or partitions(df.sparkSession)
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))


def carried_sums(rows: DataFrame, group: str, order: list, sums: dict[str, str]) -> DataFrame:
    """Running totals (own row included) of columns within each group, of ranged rows whose order begins with the group.

    A group may go over many ranges: each range adds what the ranges before hold of its first group.  One small row a range is
    all that comes together.
    """
    inside = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    edges = rows.groupBy("_range").agg(F.min(group).alias("_first"), F.max(group).alias("_last"))
    tails = rows.join(F.broadcast(edges), "_range").where(F.col(group) == F.col("_last"))
    tails = tails.groupBy("_range", "_first", "_last").agg(*[F.sum(c).alias(new) for new, c in sums.items()])
    start: list[tuple] = []
    held, so_far = None, [0] * len(sums)
    for r in sorted(tails.collect(), key=lambda r: r["_range"]):  # a row a range
        if held is not None and r["_first"] == held:
            start.append((r["_range"], held, *so_far))
        own = [r[new] for new in sums]
        so_far = [a + b for a, b in zip(so_far, own, strict=True)] if r["_last"] == held else own
        held = r["_last"]
    names = [f"_before_{new}" for new in sums]
    kind = rows.schema[group].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(start, f"_from int, _group {kind}, " + ", ".join(f"`{n}` long" for n in names))
    out = rows.select("*", *[F.sum(c).over(inside).alias(new) for new, c in sums.items()])
    out = out.join(F.broadcast(table), (F.col("_range") == F.col("_from")) & (F.col(group) == F.col("_group")), "left")
    return out.select(*rows.columns, *[(F.col(new) + F.coalesce(F.col(n), F.lit(0))).alias(new) for new, n in zip(sums, names, strict=True)])


def rebuilt(own: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """conv_id, side, pos, key, bytes of the rebuilt conversations, and for each a row of side -1 that stands for the root.

    The first h = crc32(conv_id) % head turns come from the family's first conversation (conv_id - conv_id % family).
    """
    placed = carried_sums(ranged(own.withColumn("one", F.lit(1)), ["conv_id", F.col("turn").asc_nulls_first(), "key"]), "conv_id", [F.col("turn").asc_nulls_first(), F.col("key")], {"pos": "one"})
    placed = cut(placed.select("conv_id", "pos", "key", "bytes"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head
    convs = placed.where("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    kept = placed.where((F.col("conv_id") % family == 0) | (F.col("pos") > h)).select("conv_id", F.lit(1).alias("side"), "pos", "key", "bytes")
    heads = placed.where((F.col("conv_id") % family == 0) & (F.col("pos") < head)).select(F.col("conv_id").alias("base"), "pos", "key", "bytes")  # head - 1 turns at most
    given = convs.where("conv_id <> base and h > 0").join(heads, "base").where("pos <= h").select("conv_id", F.lit(0).alias("side"), "pos", "key", "bytes")
    roots = convs.select("conv_id", F.lit(-1).alias("side"), F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("bytes"))
    return kept.unionByName(given).unionByName(roots)


def chain(rows: DataFrame) -> DataFrame:
    """Depth, node and parent of every rebuilt turn, and whether it is its conversation's last; as ranged rows."""
    each = ranged(rows, ["conv_id", "side", "pos"])

    def hand_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a range: its first and last conversation, and how the last one's turns in it carry a chain on."""
        first = last = number = None
        times, plus, n = 1, 0, 0
        for b in batches:
            for r, c, key in zip(b["_range"].tolist(), b["conv_id"].tolist(), b["key"], strict=True):
                if c != last:
                    first, last, number = (c if first is None else first), c, r
                    times, plus, n = 1, 0, 0
                times, plus = times * _POINT % _FIELD, (plus * _POINT + int.from_bytes(key[:16], "big")) % _FIELD
                n += 1
        if last is not None:
            yield pd.DataFrame({"_range": [number], "first": [first], "last": [last], "times": [str(times)], "plus": [str(plus)], "n": [n]})

    parts = sorted(each.mapInPandas(hand_on, "_range int, first long, last long, times string, plus string, n long").collect())  # a row a range
    start: dict[int, tuple] = {}
    follow: dict[int, int] = {}
    conv, value, depth = None, 0, -1
    for k, r in enumerate(parts):
        if r.first == conv:
            start[r._range] = (conv, value, depth)
        if r.last != conv:
            value, depth = 0, -1  # a chain begins
        value, depth, conv = (value * int(r.times) + int(r.plus)) % _FIELD, depth + r.n, r.last
        if k + 1 < len(parts):
            follow[r._range] = parts[k + 1].first

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple | None = None  # conversation, chain, depth of the row before
        waits: list | None = None
        for b in batches:
            if not len(b):
                continue
            out = []
            number = int(b["_range"].iloc[0])
            if state is None:
                state = start.get(number, (None, 0, -1))
            conv, value, depth = state
            for c, key, size in zip(b["conv_id"].tolist(), b["key"], b["bytes"].tolist(), strict=True):
                if waits is not None:
                    waits[-1] = waits[1] != c
                    out.append(waits)
                if c != conv:
                    conv, value, depth = c, 0, -1
                parent = _name(value, depth)
                value, depth = (value * _POINT + int.from_bytes(key[:16], "big")) % _FIELD, depth + 1
                waits = [number, c, depth, _name(value, depth), parent, size, True]
            state = (conv, value, depth)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHAIN.split(", ")])
        if waits is not None:
            waits[-1] = follow.get(waits[0]) != waits[1]
            yield pd.DataFrame([waits], columns=[x.split()[0] for x in CHAIN.split(", ")])

    return cut(each.mapInPandas(walk, CHAIN))


def _name(value: int, depth: int) -> bytes | None:
    """The node of a chain; the depth is a part of it. All conversations have one root, and that has no parent."""
    return None if depth < 0 else ROOT if depth == 0 else hashlib.blake2b(value.to_bytes(16, "big") + depth.to_bytes(8, "big"), digest_size=16).digest()


def ends_hash(rows: DataFrame) -> DataFrame:
    """node, ends_sha256: the hash of the ascending conv_ids that end at each node, comma-joined.

    Ranges pack their ids by node; a node's pieces are then hashed as they stream by.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list[str]] = {}
        size: dict[bytes, int] = {}
        piece = chars = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame([(node, number, piece, ",".join(ids)) for node, ids in held.items()], columns=["node", "_range", "piece", "ids"])

        for b in batches:
            for number, node, c in zip(b["_range"].tolist(), b["node"], b["conv_id"].tolist(), strict=True):
                text = str(c)
                held.setdefault(bytes(node), []).append(text)
                size[bytes(node)] = size.get(bytes(node), 0) + len(text) + 1
                chars += len(text) + 60
                if size[bytes(node)] > PIECE or chars > 64 * PIECE:
                    yield flush()
                    held, size, piece, chars = {}, {}, piece + 1, 0
        if held:
            yield flush()

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for b in batches:
            out = []
            for name, ids in zip(b["node"], b["ids"], strict=True):
                if name != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = bytes(name), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    packed = rows.where("last").select("_range", "node", "conv_id").mapInPandas(pack, "node binary, _range int, piece int, ids string")
    return packed.repartition(partitions(rows.sparkSession), "node").sortWithinPartitions("node", "_range", "piece").mapInPandas(stream, "node binary, ends_sha256 string")


def _paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, path (the leaf's conversation), level (light nodes down to the path's first one, itself included), depth, is_top."""
    leaves = nodes.where("n_children = 0 and depth > 0").select("conv_id")  # distinct: a leaf's smallest conversation ends there
    own = cut(rows.where("depth > 0").join(leaves, "conv_id", "left_semi").select("conv_id", "depth", "node"))
    light = nodes.where("depth > 0 and not heavy").select("node")
    tops = own.join(light, "node", "left_semi").groupBy("conv_id").agg(F.count("*").alias("level"), F.max("depth").alias("top"))
    return own.join(tops, "conv_id").where("depth >= top").select("node", F.col("conv_id").alias("path"), "level", (F.col("depth") == F.col("top")).alias("is_top"))


def _totals(on_path: DataFrame) -> DataFrame:
    """received by nodes from the light subtrees that hang on them: node, leaves, saved.

    In each round the paths of one level, with all that was attached to them, are summed and attached to their parents.
    """
    whole = cut(on_path.groupBy("path", "level").agg(F.sum("own_leaf").alias("leaves"), F.sum("own_saved").alias("saved"), F.max(F.when(F.col("is_top"), F.col("parent"))).alias("parent")))
    deepest = whole.agg(F.max("level")).first()[0] or 0
    every = empty = on_path.sparkSession.createDataFrame([], "node binary, leaves long, saved long")
    below = empty
    for level in range(deepest, 1, -1):
        got = below.join(on_path.where(F.col("level") == level).select("node", "path"), "node").select("path", "leaves", "saved")
        paths = whole.where(F.col("level") == level).select("path", "leaves", "saved").unionByName(got).groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        hung = paths.join(whole.where(F.col("level") == level).select("path", "parent"), "path")
        below = cut(hung.groupBy(F.col("parent").alias("node")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        every = every.unionByName(below)
    return every


def prefix_trie(conversations: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    rows = chain(rebuilt(turns(conversations), family, head))
    nodes = cut(rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("parent").alias("parent")))
    below = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.max_by("node", F.struct("n_convs", (-F.col("conv_id")).alias("first"))).alias("largest"))
    below = cut(below)
    largest = below.where(F.col("node") != F.lit(ROOT)).select(F.col("largest").alias("node"), F.lit(True).alias("heavy"))  # the root's children all begin paths
    nodes = nodes.join(below.select("node", "n_children"), "node", "left").join(largest, "node", "left")
    nodes = cut(nodes.select("node", "conv_id", "depth", "n_convs", "bytes", "parent", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("heavy", F.lit(False)).alias("heavy")))
    own = [(F.col("n_children") == 0).cast("long").alias("own_leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own_saved")]
    on_path = cut(nodes.where("depth > 0").select("node", "conv_id", "depth", "n_convs", "n_children", "parent", *own).join(_paths(rows, nodes), "node"))
    hung = _totals(on_path)
    value = on_path.join(hung, "node", "left").withColumns({"v_leaf": F.col("own_leaf") + F.coalesce("leaves", F.lit(0)), "v_saved": F.col("own_saved") + F.coalesce("saved", F.lit(0)), "up": -F.col("depth")})
    summed = carried_sums(ranged(value.drop("leaves", "saved", "level", "is_top"), ["path", "up"]), "path", [F.col("up")], {"n_leaves": "v_leaf", "saved_tokens": "v_saved"})
    root = nodes.where("depth = 0").crossJoin(F.broadcast(nodes.agg(F.sum(own[0]).alias("n_leaves"), F.sum(own[1]).alias("saved_tokens"))))  # one row and one row
    first = rows.agg(F.min("conv_id")).first()[0]
    known = summed.select("node", "conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens")
    deeper = known.where("depth > 1").join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    top = known.where("depth = 1").withColumn("parent_conv_id", F.lit(first))
    base = root.select("node", "conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = deeper.unionByName(top.withColumn("parent_conv_id", F.col("parent_conv_id").cast("long"))).unionByName(base).join(ends_hash(rows), "node", "left")
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    return out
