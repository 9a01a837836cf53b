"""What several corpus operators share: the word rule, checkpoints, prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of rows that Spark hands to Python, or gets back, at a time; both sides hold a batch several times over and keep what they took.
BATCH = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a small table that one task reads, and rows of two numbers that are broadcast at most.
FEW, SENT = 50_000, 400_000
#: Stands for a missing doc_id inside the operators; it sorts before every other id.
NO_ID = -(2**63)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array without nulls."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once for each row.

    A plain column used inside a lambda may be inlined there by the optimizer and computed once for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def id_of(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name), F.lit(NO_ID))


def name_of(inner: str = "_id") -> Column:
    """The doc_id of an inner id."""
    return F.when(F.col(inner) != NO_ID, F.col(inner))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where df has a column of that name; for columns put beside its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_small_batches(spark: SparkSession) -> bool:
    """From here on the session hands rows to Python in batches of BATCH bytes; whether this was set here (an own setting of the session stays).

    A number of rows (10,000 by default) bounds no memory where texts are long.  Results do not depend on it.
    """
    if spark.conf.get(BATCH_BYTES, None) is not None:
        return False
    spark.conf.set(BATCH_BYTES, str(BATCH))
    return True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where none is set and all runs on one machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulseframe-checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_M32 = (1 << 32) - 1


def evenly(number: Column) -> Column:
    """An int whose hash, as Spark deals rows by it, is number (0 to 2**31 - 1): so rows go to partition or bucket number mod n.

    The 32-bit Murmur3 hash of an int is one to one; its steps are undone here from last to first.
    """
    low = lambda x: x.bitwiseAND(F.lit(_M32))
    steps: list[Callable[[Column], Column]] = []

    def undo_xor(*shifts: int) -> None:
        steps.append(lambda x: reduce(Column.bitwiseXOR, [F.shiftright(x, n) for n in shifts], x))

    def undo_times(c: int) -> None:  # in two halves, as a product of 64 bits may not overflow
        i = pow(c, -1, 1 << 32)
        steps.append(lambda x: low(x.bitwiseAND(F.lit(0xFFFF)) * F.lit(i) + F.shiftleft((F.shiftright(x, 16) * F.lit(i)).bitwiseAND(F.lit(0xFFFF)), 16)))

    def undo_turn(n: int) -> None:
        steps.append(lambda x: low(F.shiftright(x, n).bitwiseOR(F.shiftleft(x, 32 - n))))

    undo_xor(16)
    undo_times(0xC2B2AE35)
    undo_xor(13, 26)
    undo_times(0x85EBCA6B)
    undo_xor(16)
    steps.append(lambda x: low(x.bitwiseXOR(F.lit(4)) - F.lit(0xE6546B64)))
    undo_times(5)
    undo_turn(13)
    steps.append(lambda x: x.bitwiseXOR(F.lit(42)))
    undo_times(0x1B873593)
    undo_turn(15)
    undo_times(0xCC9E2D51)
    x = reduce(let, steps, number.cast("long"))
    return let(x, lambda v: F.when(v >= F.lit(1 << 31), v - F.lit(1 << 32)).otherwise(v).cast("int"))


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """df, which has about so many rows, in as few partitions as these need; work that is heavy for each row comes after another shuffle."""
    return df.coalesce(1 + rows // FEW)


def sent(df: DataFrame) -> DataFrame:
    """df computed once, and broadcast where it has no more than SENT rows."""
    df = cut(df)
    return F.broadcast(in_few(df, rows)) if (rows := df.count()) <= SENT else df


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """Adds running totals (own row included) of columns over the whole order: {new name: column}.

    Range-partitions by the order, sums each range, adds the sums of the ranges before.  No task sees more than one
    range; the only table that is not partitioned has one row for each range.
    """
    parts = parts or partitions(df.sparkSession)
    ranged = cut(df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order]).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
    offsets = offsets.select("_range", *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums])
    inside = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(c).over(inside).alias(new) for new, c in sums.items()]).join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, *[(F.col(new) + F.col(f"_{new}")).alias(new) for new in sums])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long): one row (node, component = smallest node) a node.

    Alternates the large-star and small-star steps until the edges stand still.  Every step is a minimum (combined
    before the shuffle) and an equi join, with the minima broadcast where the edges are few; nothing is gathered by group.
    """
    cur = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen, rows = None, cur.count()
    for _ in range(max_rounds):
        few = 2 * rows <= SENT
        cur = in_few(cur, rows) if few else cur
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(F.broadcast(low) if few else low, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        large = large if few else large.distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(F.broadcast(down) if few else down, "b").select("m", "a", "b")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        small = small.where("a <> b").distinct()
        cur = cut(in_few(small, rows) if few else small)
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen, rows = state, state[0]
    else:
        raise RuntimeError("the components did not settle")
    named = cur.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(cur.select("a", "a").distinct())
    return in_few(named, rows) if few else named
