"""Helpers that the operators of this subpackage share: intermediate tables
in the cluster's shared folder, running sums over hot keys, and connected
components."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset in local mode
    (tests, a laptop) a temporary folder of this process, removed when it ends. A
    cluster must name one: a folder of one machine is none that its executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="tallyweave-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return "file://" + _own_root[0]


class Scratch:
    """Intermediate tables of one run of an operator. What an operator returns reads
    them, so they stay until ``release``, which a caller may use once results are stored."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.folder = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
        self._numbers = itertools.count()
        self._held: list[DataFrame] = []
        Scratch._open.append(self)

    @classmethod
    def opened(cls) -> list[Scratch]:
        return list(cls._open)

    @classmethod
    def release(cls, *but: Scratch) -> None:
        """Frees the held blocks and deletes the tables of all runs so far, less ``but``."""
        for one in [x for x in cls._open if x not in but]:
            cls._open.remove(one)
            for df in one._held:
                df.unpersist()
            one._delete(one.folder)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def hold(self, df: DataFrame) -> DataFrame:
        """Keeps what is read more than once on the executors' disks. A block that is
        lost with its executor is computed again, so this suits tables one step away
        from an input or a shuffle; it does not cut lineage."""
        self._held.append(df.persist(StorageLevel.DISK_ONLY))
        return self._held[-1]

    def keep(self, df: DataFrame, name: str = "t", files_a_core: int | None = 2) -> DataFrame:
        """Writes a table to the shared folder and reads it back, which cuts lineage.
        Tables of few columns get few files: ``files_a_core`` for each core at most."""
        path = f"{self.folder}/{name}-{next(self._numbers)}"
        schema = df.schema
        if files_a_core:
            df = df.coalesce(files_a_core * self.spark.sparkContext.defaultParallelism)
        df.write.parquet(path)
        kept = self.spark.read.schema(schema).parquet(path)
        kept._tallyweave_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables of ``keep`` that nothing will read again."""
        for df in kept:
            path = getattr(df, "_tallyweave_path", None)
            if path:
                self._delete(path)


def word_count(text: Column) -> Column:
    """Words of a text, as the contracts define them; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_order(column: Column) -> Column:
    """A portable shuffle key: hex digits of the md5 of a value's text."""
    return F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def row_marks(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, which tell rows apart by all their columns."""
    cells = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else df[f"`{f.name}`"] for f in df.schema]
    nulls = F.array(*(F.isnull(c) for c in cells)) if cells else F.lit(0)  # the hash passes over nulls
    return [F.xxhash64(F.lit(seed), nulls, *cells) for seed in (1, 2)]


def ranked_sums(df: DataFrame, order: Sequence[Column], values: dict[str, str], scratch: Scratch) -> DataFrame:
    """Exclusive running sums over a whole table in an order without ties, for tables
    without a bucket that refines it: rows are range-sorted, each range is summed in its
    own task, and only one row for each range (of the session's shuffle partitions) meets
    in one window."""
    place = F.spark_partition_id().alias("_range")
    ranged = scratch.hold(df.repartitionByRange(*order).select("*", place))
    totals = ranged.groupBy("_range").agg(*(F.sum(v).alias(v) for v in values))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_start_{v}") for v in values))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ((F.col(f"_start_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(out) for v, out in values.items())
    return ranged.join(F.broadcast(starts), "_range").select(*df.columns, *sums)  # one row for each range


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    values: dict[str, str],
) -> DataFrame:
    """Exclusive running sums per key in an order that ``bucket`` refines.

    ``values`` maps each value column to the name of its running sum over the
    rows before. The buckets of a key must follow one another in ``order``; a
    key that holds most rows is then spread over as many tasks as it has
    buckets: one aggregate gives the sums of the buckets, a window over those
    few rows gives where each starts, and the window over rows runs inside a
    bucket. Keys and buckets must not be null.
    """
    keys = list(keys)
    totals = df.groupBy(*keys, bucket).agg(*(F.sum(v).alias(v) for v in values))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, bucket, *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_start_{v}") for v in values)
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [*keys, bucket])
        .select(
            *df.columns,
            *(
                (F.col(f"_start_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(out)
                for v, out in values.items()
            ),
        )
    )


class WordFilter:
    """A Bloom filter as a table of 64-bit words: a key's first mark names its word, its
    second mark three bits of it. It has ``WORDS`` rows at most, whatever it holds, so it
    can be broadcast; with millions of keys it lets more rows through, but loses none."""

    WORDS = 1 << 20

    def __init__(self, keys: DataFrame, first: str, second: str):
        self.first, self.second = first, second
        named = keys.select(self._word().alias("_word"), self._bits().alias("_own"))
        self.words = named.groupBy("_word").agg(F.bit_or("_own").alias("_bits"))

    def _word(self) -> Column:
        return F.pmod(F.col(self.first), F.lit(self.WORDS)).cast("int")

    def _bits(self) -> Column:
        taken = (F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{self.second}`, {at}) & 63 AS INT))") for at in (0, 20, 40))
        return reduce(Column.bitwiseOR, taken)

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that are surely not among the keys, and all others."""
        met = df.withColumn("_word", self._word()).join(F.broadcast(self.words), "_word", "left")
        missing = F.coalesce(self._bits().bitwiseAND(F.bitwise_not("_bits")) != 0, F.lit(True))
        return met.filter(missing).select(*df.columns), met.filter(~missing).select(*df.columns)


def join_copies(rows: DataFrame, found: DataFrame, keys: Sequence[str], copies: str, scratch: Scratch, most: int = 0) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row for each key), as a left join.

    ``copies`` says how many rows a key of ``found`` has. Keys with over a thousandth
    of all these rows, of which there are fewer than a thousand, are broadcast, so the
    rows of a large group of copies stay where they are; only the others are shuffled.
    A ``found`` that was counted to have up to ``most`` rows is broadcast whole.
    """
    keys = list(keys)
    if most and found.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(found.drop(copies)), keys, "left")
    total = found.agg(F.sum(copies).alias("_total"))  # one row
    large = found.crossJoin(F.broadcast(total)).filter(F.col(copies) * 1000 > F.col("_total"))
    hot = scratch.keep(large.drop("_total", copies).withColumn("_hot", F.lit(True)), "hot", files_a_core=1)
    met = rows.join(F.broadcast(hot), keys, "left")
    rest = met.filter("_hot IS NULL").select(*rows.columns).join(found.drop(copies), keys, "left")
    return met.filter("_hot").drop("_hot").unionByName(rest)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of links ``(a, b)``: one row ``(node, root)`` for each
    node of a link, root being the smallest node of its component.

    Alternates two moves on an edge table until it stops changing: every node
    hands its larger neighbours (large star), then its smaller ones (small
    star), the smallest node it knows. Each move is one aggregate and one join
    over narrow rows; the table never grows beyond its first size. The minima are
    held before the join, so that both of its sides are shuffled for it and a hub's
    edges can be split over tasks. Each round ends with a written table, which cuts
    its lineage. Null and self links are dropped.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = scratch.keep(
        edges.filter("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "edges"
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.hold(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = scratch.hold(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        smallest = scratch.hold(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, scratch.keep(moved.union(smallest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for held in (smallest, large, least):
            held.unpersist()
        scratch.drop(last)
        seen = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if (seen["n"], seen["h"]) == state:
            break
        state = (seen["n"], seen["h"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
