"""Concise and reservoir samples by hashing, so that they repeat and merge exactly.

Units of weight are never made one by one. Each unit of a key has an arrival time, an
exponential variable drawn from a hash, and a sample holds the units that arrive first. A
key's weight is cut into pieces of up to a bound, of which most have no early arrival at
all; a piece of b units has its first one after an exponential time of rate b, the next
after rate b - 1 and so on. Both samples depend on weights only, not on their order, so
streams are summed by key first.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.hashing import unit_hash
from tallyweave.operators.exact import limit_of, total_weight, with_total

#: The seeds whose estimates are averaged.
SEEDS = (41, 42, 43, 44, 45)
#: Arrivals that a piece can have. It expects a quarter of one in time, so that it has more
#: with a chance below 1e-30.
MOST = 20
#: Halvings of the stream that a sample can need.
LEVELS = 60
#: Arrival time up to which a unit is among the 2**-level first, for each level from 1.
TIMES = tuple(-math.log1p(-(2.0**-k)) for k in range(1, LEVELS + 1))


def enough(size: int) -> int:
    """Units that must be expected before a time for a sample of ``size`` to be full by
    then but with a chance below 1e-15."""
    return 8 * size + 128


def arrivals(counted: DataFrame, size: int, seeds: tuple[int, ...] = (42,), part: int = 0) -> DataFrame:
    """``seed, key, at, level, least``: the first units to arrive, at least ``size`` of them
    or all.

    ``at`` is a unit's time; it survives level k, with chance 2**-k, if it arrives by
    ``TIMES[k - 1]``. Units below level ``least`` are left out. The number of rows is that of the keys that arrive and some 32 times
    ``size``, however great the weights are. ``part`` names the part of a stream, so that
    the units of several parts are others and their samples can be merged.
    """
    total = total_weight(counted).select(
        F.when(F.col("n") > enough(size), F.floor(F.log2(F.col("n").cast("double") / enough(size))).cast("int")).otherwise(0).alias("least")
    )  # one row
    bound = F.expr("shiftleft(1L, greatest(0, least - 2))")
    pieces = (
        counted.filter("total > 0")
        .crossJoin(F.broadcast(total))
        .select("key", "total", "least", bound.alias("bound"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(total - 1) div bound div 1024"))))
        .withColumn("piece", F.explode(F.sequence(F.col("block") * 1024, F.least(F.col("block") * 1024 + 1023, F.expr("(total - 1) div bound")))))
        .withColumn("units", F.least(F.col("bound"), F.col("total") - F.col("piece") * F.col("bound")))
        .withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    )
    time = F.get(F.array(*map(F.lit, TIMES)), F.col("least") - 1)
    limit = F.when(F.col("least") > 0, time).otherwise(F.lit(float("inf")))
    first = pieces.withColumn("limit", limit).withColumn("first", _wait(F.lit(0), part)).filter("first < limit")
    second = first.withColumn("second", F.when(F.col("units") > 1, _wait(F.lit(1), part)).otherwise(F.lit(float("inf"))))
    every = F.transform(F.sequence(F.lit(0), (F.least(F.col("units"), F.lit(MOST)) - 1).cast("int")), lambda j: _wait(j, part))
    waits = second.select("seed", "key", "least", "limit", F.when(F.col("first") + F.col("second") < F.col("limit"), every).otherwise(F.array("first")).alias("waits"))
    sums = F.transform("waits", lambda w, i: F.aggregate(F.slice("waits", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x))
    early = waits.select("seed", "key", "least", "limit", F.explode(sums).alias("at")).filter("at < limit")
    return early.select("seed", "key", "at", level(F.col("at")).alias("level"), "least")


def _wait(j: Column, part: int) -> Column:
    """Time from one arrival of a piece to the next, the ``j``-th from 0."""
    names = [F.lit(f"p{part}")] * bool(part) + [F.col("piece"), j, F.col("key")]
    drawn = (unit_hash(F.col("seed"), *names).cast("double") + 1.0) / float(1 << 60)
    return -F.log(drawn) / (F.col("units") - j).cast("double")


def level(at: Column) -> Column:
    """Levels that a unit survives: those of ``TIMES`` that it arrives by. The logarithm is
    within one of it, and the times themselves decide."""
    near = F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.floor(-F.log2(-F.expm1(-at))).cast("int")))
    times = F.array(*map(F.lit, (float("inf"), *TIMES, 0.0)))
    return near - 1 + (at < F.get(times, near)).cast("int") + (at < F.get(times, near + 1)).cast("int")


def _sizes(size: int | Mapping[int, int]) -> dict[int, int]:
    sizes = {0: size} if isinstance(size, int) else dict(size)
    if min(sizes.values()) < 1:
        raise ValueError("the size must be positive")
    return sizes


def _wanted(sizes: Mapping[int, int]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(s).cast("long").alias("size")) for t, s in sizes.items())))


def concise(counted: DataFrame, size: int | Mapping[int, int], seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """``tag, seed, key, sample_count, t``: a sample of at most ``size`` units (one for each
    tag), kept with chance 1 / t, t the least power of two that leaves so few."""
    sizes = _sizes(size)
    return concise_of(arrivals(counted, max(sizes.values()), seeds), sizes)


def concise_of(units: DataFrame, size: int | Mapping[int, int]) -> DataFrame:
    """``concise`` from ``arrivals``, or from those of several parts of a stream together. The
    counts by key and level are read twice and kept for that, until the caller clears the
    session's cache."""
    sizes = _sizes(size)
    counts = units.groupBy("seed", "key", "level").agg(F.count("*").alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
    by_level = counts.groupBy("seed", "level").agg(F.sum("c").alias("c"))
    tried = by_level.withColumn("least", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    left = tried.groupBy("seed", "least").agg(F.sum(F.when(F.col("level") >= F.col("least"), F.col("c")).otherwise(0)).alias("left"))
    whole = units.agg(F.max("least").alias("whole"))  # one row: below, units of some part are left out
    fits = left.crossJoin(F.broadcast(whole)).filter("least >= whole").withColumn("w", _wanted(sizes)).filter(F.col("left") <= F.col("w.size"))
    chosen = fits.groupBy("w.tag", "seed").agg(F.min("least").alias("least"))
    kept = counts.join(F.broadcast(chosen), "seed").filter("level >= least")  # one row for each tag and seed
    return kept.groupBy("tag", "seed", "key").agg(F.sum("c").alias("sample_count"), F.min(F.pow(F.lit(2.0), "least").cast("long")).alias("t"))


def concise_estimates(sample: DataFrame) -> DataFrame:
    return sample.select("tag", "seed", "key", (F.col("sample_count") * F.col("t")).alias("estimate"))


def reservoir(counted: DataFrame, size: int | Mapping[int, int], seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """``tag, seed, key, sample_count, m``: a uniform sample of ``size`` units (one for each
    tag) without replacement, the first to arrive; m is its real size."""
    sizes = _sizes(size)
    return reservoir_of(arrivals(counted, max(sizes.values()), seeds), sizes)


def reservoir_of(units: DataFrame, size: int | Mapping[int, int]) -> DataFrame:
    """``reservoir`` from ``arrivals``, or from those of several parts of a stream together.
    The window sees some 16 times the greatest size of each seed."""
    sizes = _sizes(size)
    place = F.row_number().over(Window.partitionBy("seed").orderBy("at", "key"))
    placed = units.withColumn("place", place).filter(F.col("place") <= max(sizes.values()))
    drawn = placed.withColumn("w", _wanted(sizes)).filter(F.col("place") <= F.col("w.size")).groupBy("w.tag", "seed", "key").agg(F.count("*").alias("sample_count"))
    real = drawn.groupBy("tag", "seed").agg(F.sum("sample_count").alias("m"))  # one row for each tag and seed
    return drawn.join(F.broadcast(real), ["tag", "seed"])


def reservoir_estimates(sample: DataFrame, counted: DataFrame) -> DataFrame:
    """``tag, seed, key, estimate``: count * n / m, rounded half up."""
    scaled = F.floor(F.col("sample_count").cast("double") * F.col("n") / F.col("m") + 0.5).cast("long")
    return with_total(sample, counted).select("tag", "seed", "key", scaled.alias("estimate"))


def averaged(estimates: DataFrame, seeds: int) -> DataFrame:
    """``tag``, ``key``, ``estimate``: the mean over seeds, a seed without the key giving 0,
    rounded half up."""
    return estimates.groupBy("tag", "key").agg(F.floor(F.sum("estimate") / seeds + 0.5).cast("long").alias("estimate"))


def heavy(estimates: DataFrame, counted: DataFrame, phi: float) -> DataFrame:
    return with_total(estimates, counted).filter(F.col("estimate") >= limit_of(phi)).drop("n")
