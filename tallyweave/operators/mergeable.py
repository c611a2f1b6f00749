"""One contract for summaries that are built on parts of a stream and merged."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.sizing import Grid
from tallyweave.operators import counters, linear, sampling
from tallyweave.operators.exact import frequencies, total_weight


class Mergeable(Protocol):
    """``shape`` tells what may merge: summaries with equal shapes only."""

    @property
    def shape(self) -> tuple: ...

    def build(self, stream: DataFrame) -> DataFrame: ...

    def merge(self, *summaries: DataFrame) -> DataFrame: ...

    def estimate(self, summary: DataFrame, keys: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Summary:
    """What a kind built from a stream, and the stream's weight (one row, ``n``)."""

    kind: Mergeable
    rows: DataFrame
    weight: DataFrame

    def merge(self, other: Summary) -> Summary:
        rows = merged(self.kind, other.kind, self.rows, other.rows)
        return Summary(self.kind, rows, self.weight.unionByName(other.weight).agg(F.sum("n").alias("n")))

    def estimate(self, keys: DataFrame) -> DataFrame:
        found = self.kind.estimate(self.rows, keys)
        return found.crossJoin(F.broadcast(self.weight)).withColumn("estimate", _scaled(found)).select("key", "estimate")  # one row


def _scaled(found: DataFrame):
    """Estimates that come as a share of the stream (``share``) are scaled by its weight."""
    if "share" not in found.columns:
        return F.col("estimate")
    return F.floor(F.col("share") * F.col("n") + 0.5).cast("long")


def summarise(kind: Mergeable, stream: DataFrame) -> Summary:
    return Summary(kind, kind.build(stream), total_weight(stream, "weight"))


def merged(first: Mergeable, second: Mergeable, a: DataFrame, b: DataFrame) -> DataFrame:
    """Merges summaries of two streams, or raises if their shapes differ."""
    if first.shape != second.shape:
        raise ValueError(f"shapes differ: {first.shape} and {second.shape}")
    return first.merge(a, b)


def _looked_up(keys: DataFrame, summary: DataFrame) -> DataFrame:
    """Estimates of keys, 0 for those without an entry."""
    return keys.select("key").join(summary.select("key", "estimate"), "key", "left").select("key", F.coalesce("estimate", F.lit(0)).alias("estimate"))


def _numbered(summaries: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.withColumn("part", F.lit(i).cast("long")) for i, s in enumerate(summaries)])


@dataclass(frozen=True)
class CountMin:
    grid: Grid
    family: str = "portable"
    seed: int = 0

    @property
    def shape(self) -> tuple:
        return ("count_min", self.grid, self.family, self.seed)

    def build(self, stream: DataFrame) -> DataFrame:
        return linear.count_min(frequencies(stream), self.grid, self.family, self.seed)

    def merge(self, *summaries: DataFrame) -> DataFrame:
        return linear.merge(*summaries, grids=self.grid)

    def estimate(self, summary: DataFrame, keys: DataFrame) -> DataFrame:
        return linear.count_min_estimates(keys, summary, self.grid, self.family, self.seed).select("key", "estimate")


@dataclass(frozen=True)
class CountSketch:
    grid: Grid
    family: str = "portable"
    seed: int = 0

    @property
    def shape(self) -> tuple:
        return ("count_sketch", self.grid, self.family, self.seed)

    def build(self, stream: DataFrame) -> DataFrame:
        return linear.count_sketch(frequencies(stream), self.grid, self.family, self.seed)

    def merge(self, *summaries: DataFrame) -> DataFrame:
        return linear.merge(*summaries, grids=self.grid).filter("cell <> 0")

    def estimate(self, summary: DataFrame, keys: DataFrame) -> DataFrame:
        return linear.count_sketch_estimates(keys, summary, self.grid, self.family, self.seed).select("key", "estimate")


@dataclass(frozen=True)
class Ams:
    grid: Grid
    family: str = "portable"
    seed: int = 0

    @property
    def shape(self) -> tuple:
        return ("ams", self.grid, self.family, self.seed)

    def build(self, stream: DataFrame) -> DataFrame:
        return linear.ams(frequencies(stream), self.grid, self.family, self.seed)

    def merge(self, *summaries: DataFrame) -> DataFrame:
        return linear.merge_ams(*summaries)

    def estimate(self, summary: DataFrame, keys: DataFrame) -> DataFrame:
        return linear.ams_estimates(keys, summary, self.grid, None, self.family, self.seed).select("key", "estimate")


@dataclass(frozen=True)
class MisraGries:
    capacity: int
    parts: int | None = None

    @property
    def shape(self) -> tuple:
        return ("misra_gries", self.capacity)

    def build(self, stream: DataFrame) -> DataFrame:
        return self.merge(counters.misra_gries(stream, self.capacity, self.parts))

    def merge(self, *summaries: DataFrame) -> DataFrame:
        return counters.merge_misra_gries(reduce(DataFrame.unionByName, [s.select("key", "estimate") for s in summaries]), self.capacity)

    def estimate(self, summary: DataFrame, keys: DataFrame) -> DataFrame:
        return _looked_up(keys, summary)


@dataclass(frozen=True)
class SpaceSaving:
    """Its relation is one part of ``counters.SUMMARY``."""

    capacity: int
    parts: int | None = None

    @property
    def shape(self) -> tuple:
        return ("space_saving", self.capacity)

    def build(self, stream: DataFrame) -> DataFrame:
        return counters.one_part(counters.space_saving(stream, self.capacity, self.parts), self.capacity)

    def merge(self, *summaries: DataFrame) -> DataFrame:
        return counters.one_part(_numbered(summaries), self.capacity)

    def estimate(self, summary: DataFrame, keys: DataFrame) -> DataFrame:
        return _looked_up(keys, summary)


@dataclass(frozen=True)
class LossyCounting:
    """Its relation is one part of ``counters.SUMMARY``."""

    window: int
    parts: int | None = None

    @property
    def shape(self) -> tuple:
        return ("lossy_counting", self.window)

    def build(self, stream: DataFrame) -> DataFrame:
        return counters.one_lossy_part(counters.lossy_counting(stream, self.window, self.parts))

    def merge(self, *summaries: DataFrame) -> DataFrame:
        return counters.one_lossy_part(_numbered(summaries))

    def estimate(self, summary: DataFrame, keys: DataFrame) -> DataFrame:
        return _looked_up(keys, summary)


@dataclass(frozen=True)
class Concise:
    """``part`` names the part of a stream; parts that are to be merged need different ones."""

    size: int
    seed: int = 42
    part: int = 0

    @property
    def shape(self) -> tuple:
        return ("concise", self.size, self.seed)

    def build(self, stream: DataFrame) -> DataFrame:
        return sampling.arrivals(frequencies(stream), self.size, (self.seed,), self.part)

    def merge(self, *summaries: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, summaries)

    def estimate(self, summary: DataFrame, keys: DataFrame) -> DataFrame:
        return _looked_up(keys, sampling.concise_estimates(sampling.concise_of(summary, self.size)))


@dataclass(frozen=True)
class Reservoir(Concise):
    @property
    def shape(self) -> tuple:
        return ("reservoir", self.size, self.seed)

    def estimate(self, summary: DataFrame, keys: DataFrame) -> DataFrame:
        sample = sampling.reservoir_of(summary, self.size)
        found = keys.select("key").join(sample.select("key", (F.col("sample_count").cast("double") / F.col("m")).alias("share")), "key", "left")
        return found.select("key", F.coalesce("share", F.lit(0.0)).alias("share"))
