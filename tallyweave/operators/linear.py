"""Linear sketches as relations of cells.

A sketch is the table ``tag, row, bucket, cell``; merging is a sum by cell, which the
partial aggregate of a groupBy does before the shuffle. ``tag`` holds several sketches
in one table, so that a sweep over shapes is one job. Streams are summed by key first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.hashing import hash_pair, sign
from tallyweave.functions.prefix import prefix_sums
from tallyweave.functions.sizing import Grid
from tallyweave.operators.exact import frequencies, limit_of, with_total


#: Bits that places in a stream may have.
ORD_BITS = 63


def _tagged(grids: Grid | Mapping[int, Grid]) -> dict[int, Grid]:
    return {0: grids} if isinstance(grids, Grid) else dict(grids)


def _hashed(keys: DataFrame, tagged: Mapping[int, Grid], family: str, seed: int) -> DataFrame:
    """Keys with a hash ``h<row>`` for each row, taken once for all tags that have it."""
    rows = max(g.rows for g in tagged.values())
    return keys.select("*", *(hash_pair(F.lit(r), F.col("key"), family, seed).alias(f"h{r}") for r in range(rows)))


def places(keys: DataFrame, grids: Grid | Mapping[int, Grid], family: str = "portable", seed: int = 0) -> DataFrame:
    """Each key with the cell it has in each row: ``tag, row, bucket, sign``."""
    tagged = _tagged(grids)
    each = F.array(
        *(
            F.struct(F.lit(t).alias("tag"), F.lit(r).alias("row"), F.pmod(F.col(f"h{r}.hi"), F.lit(g.width).cast("long")).alias("bucket"), sign(F.col(f"h{r}.lo")).alias("sign"))
            for t, g in tagged.items()
            for r in range(g.rows)
        )
    )
    return _hashed(keys, tagged, family, seed).select(*keys.columns, F.explode(each).alias("g")).select(*keys.columns, "g.tag", "g.row", "g.bucket", "g.sign")


def _cells(placed: DataFrame, value: Column) -> DataFrame:
    return placed.groupBy("tag", "row", "bucket").agg(F.sum(value).alias("cell"))


def count_min(counted: DataFrame, grids: Grid | Mapping[int, Grid], family: str = "portable", seed: int = 0) -> DataFrame:
    return _cells(places(counted, grids, family, seed), F.col("total"))


def count_sketch(counted: DataFrame, grids: Grid | Mapping[int, Grid], family: str = "portable", seed: int = 0) -> DataFrame:
    """Cells that sum to zero are left out."""
    return _cells(places(counted, grids, family, seed), F.col("total") * F.col("sign")).filter("cell <> 0")


def merge(*sketches: DataFrame, grids: Grid | Mapping[int, Grid] | None = None) -> DataFrame:
    """The sketch of all streams together; all must have the same grids, family and seed.
    With ``grids``, a cell that lies outside of them raises an error."""
    whole = reduce(DataFrame.unionByName, sketches)
    if grids is not None:
        wrong = F.raise_error(F.concat(F.lit("a cell outside the grid: "), F.to_json(F.struct("tag", "row", "bucket")))).cast("long")
        tagged = _tagged(grids)
        inside = reduce(Column.__or__, ((F.col("tag") == t) & F.col("row").between(0, g.rows - 1) & F.col("bucket").between(0, g.width - 1) for t, g in tagged.items()))
        whole = whole.withColumn("cell", F.when(inside, F.col("cell")).otherwise(wrong))
    return whole.groupBy("tag", "row", "bucket").agg(F.sum("cell").alias("cell"))


#: Cells of all grids together up to which estimates read them as arrays.
DENSE = 1 << 22


def _dense(cells: DataFrame, tagged: Mapping[int, Grid]) -> DataFrame:
    """One row with an array of cells, zeros included, for each tag and row: ``c<tag>_<row>``."""
    every = reduce(
        DataFrame.unionByName,
        [cells.sparkSession.range(g.width).select(F.lit(t).alias("tag"), F.explode(F.array(*map(F.lit, range(g.rows)))).alias("row"), F.col("id").alias("bucket"), F.lit(0).cast("long").alias("cell")) for t, g in tagged.items()],
    )
    whole = every.unionByName(cells.select("tag", "row", "bucket", "cell")).groupBy("tag", "row", "bucket").agg(F.sum("cell").alias("cell"))
    rows = whole.groupBy("tag", "row").agg(F.sort_array(F.collect_list(F.struct("bucket", "cell"))).alias("all")).select("tag", "row", F.col("all.cell").alias("all"))
    return rows.agg(*(F.first(F.when((F.col("tag") == t) & (F.col("row") == r), F.col("all")), ignorenulls=True).alias(f"c{t}_{r}") for t, g in tagged.items() for r in range(g.rows)))


def _scored(keys: DataFrame, cells: DataFrame, grids: Grid | Mapping[int, Grid], family: str, seed: int, signed: bool, score: Callable[[Column], Column]) -> DataFrame:
    """``tag``, ``key``, ``estimate`` from the array of a key's cells in all rows.

    The number of cells is known when this is planned. Up to ``DENSE`` of them (32 MB) go to
    every task and keys stay where they are; for larger grids keys are joined with cells."""
    tagged = _tagged(grids)
    if sum(g.rows * g.width for g in tagged.values()) > DENSE:
        found = places(keys.select("key"), tagged, family, seed).join(cells, ["tag", "row", "bucket"], "left")
        value = F.coalesce(F.col("cell") * F.col("sign") if signed else F.col("cell"), F.lit(0))
        return found.groupBy("tag", "key").agg(F.collect_list(value).alias("v")).select("tag", "key", score(F.col("v")).alias("estimate"))
    met = _hashed(keys.select("key"), tagged, family, seed).crossJoin(F.broadcast(_dense(cells, tagged)))  # one row

    def value(t: int, r: int, g: Grid) -> Column:
        cell = F.get(F.col(f"c{t}_{r}"), F.pmod(F.col(f"h{r}.hi"), F.lit(g.width)).cast("int"))
        return cell * sign(F.col(f"h{r}.lo")) if signed else cell

    each = (F.struct(F.lit(t).alias("tag"), score(F.array(*(value(t, r, g) for r in range(g.rows)))).alias("estimate")) for t, g in tagged.items())
    return met.select("key", F.array(*each).alias("e")).select(F.explode("e").alias("e"), "key").select("e.tag", "key", "e.estimate")


def count_min_estimates(keys: DataFrame, cells: DataFrame, grids: Grid | Mapping[int, Grid], family: str = "portable", seed: int = 0) -> DataFrame:
    """``tag``, ``key``, ``estimate``: the least of a key's cells, never below its weight."""
    return _scored(keys, cells, grids, family, seed, False, F.array_min)


def upper_median(values: Column) -> Column:
    """The middle of an array, the upper one if its length is even."""
    return F.get(F.sort_array(values), (F.size(values) / 2).cast("int"))


def count_sketch_estimates(keys: DataFrame, cells: DataFrame, grids: Grid | Mapping[int, Grid], family: str = "portable", seed: int = 0) -> DataFrame:
    """``tag``, ``key``, ``estimate``: the upper median over rows of sign * cell; it can
    be negative. The array that is sorted has one value for each row of the grid."""
    return _scored(keys, cells, grids, family, seed, True, upper_median)


def second_moment(cells: DataFrame) -> DataFrame:
    """``tag``, ``f2``: upper median over rows of the sum of squared cells, as DOUBLE."""
    rows = cells.groupBy("tag", "row").agg(F.sum(F.col("cell").cast("double") * F.col("cell")).alias("s"))
    return rows.groupBy("tag").agg(F.collect_list("s").alias("v")).select("tag", upper_median(F.col("v")).alias("f2"))


def prefix_estimates(stream: DataFrame, grid: Grid, shift: int = 20, family: str = "portable", seed: int = 0, signed: bool = False) -> DataFrame:
    """``ord``, ``key``, ``estimate``, ``n``: the Count-Min (``signed``: Count-Sketch) estimate
    of each arrival's key and the weight of the stream, both up to and with the arrival.
    Sums run by ranges of 2**shift places of ``ord``, which must be distinct."""
    ranged = stream.withColumn("range", F.shiftright("ord", shift))
    placed = places(ranged, grid, family, seed)
    if signed:
        placed = placed.withColumn("weight", F.col("weight") * F.col("sign"))
    cells = prefix_sums(placed, ["tag", "row", "bucket"], "range", ["ord"], "weight", "before", ORD_BITS - shift)
    upto = F.col("before") + F.col("weight")
    score = upper_median(F.collect_list(upto * F.col("sign"))) if signed else F.min(upto)
    scored = cells.groupBy("ord").agg(score.alias("estimate"))
    running = prefix_sums(ranged, [], "range", ["ord"], "weight", "before", ORD_BITS - shift)
    return running.join(scored, "ord").select("ord", "key", "estimate", (F.col("before") + F.col("weight")).alias("n"))


def candidate_pool(stream: DataFrame, grid: Grid, phi: float, shift: int = 20, family: str = "portable", seed: int = 0, signed: bool = False) -> DataFrame:
    """``key``: keys whose estimate reached phi of the stream so far when they arrived."""
    reached = prefix_estimates(stream, grid, shift, family, seed, signed).filter(F.col("estimate") >= F.lit(float(phi)) * F.col("n"))
    return reached.select("key").distinct()


# --- AMS: tug-of-war sketches ---------------------------------------------------------


def ams(counted: DataFrame, grid: Grid, family: str = "portable", seed: int = 0) -> DataFrame:
    """``row``, ``copy``, ``x``: for each copy the sum of weights with random signs."""
    signed = _signs(counted, grid, family, seed)
    return signed.groupBy("row", "copy").agg(F.sum(F.col("total") * F.col("sign")).alias("x"))


def _signs(keys: DataFrame, grid: Grid, family: str, seed: int) -> DataFrame:
    """A copy's sign for a key is one bit of a hash of the copy's number and the key."""
    number = F.col("row") * grid.width + F.col("copy")
    spread = keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(grid.rows - 1)))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))))
    return spread.withColumn("sign", sign(hash_pair(number, F.col("key"), family, seed)["lo"]))


def merge_ams(*states: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy("row", "copy").agg(F.sum("x").alias("x"))


def ams_estimates(keys: DataFrame, state: DataFrame, grid: Grid, copies: list[int] | None = None, family: str = "portable", seed: int = 0) -> DataFrame:
    """``copies``, ``key``, ``estimate``: upper median over rows of the mean of sign * x,
    cut toward zero, for each number of first copies to use (all by default)."""
    tiers = F.array(*(F.lit(c) for c in copies or [grid.width]))
    found = _signs(keys.select("key"), grid, family, seed).join(state, ["row", "copy"])
    used = found.withColumn("copies", F.explode(tiers)).filter(F.col("copy") < F.col("copies"))
    sums = used.groupBy("copies", "key", "row").agg(F.sum(F.col("sign") * F.col("x")).alias("s"))
    means = sums.select("copies", "key", F.expr("s div copies").alias("m"))
    return means.groupBy("copies", "key").agg(F.collect_list("m").alias("v")).select("copies", "key", upper_median(F.col("v")).alias("estimate"))


def ams_linear_mean(state: DataFrame, grid: Grid) -> DataFrame:
    """``estimate``: upper median over rows of the mean of x, cut toward zero."""
    rows = state.groupBy("row").agg(F.sum("x").alias("s")).select(F.expr(f"s div {grid.width}").alias("m"))
    return rows.agg(F.collect_list("m").alias("v")).select(upper_median(F.col("v")).alias("estimate"))


def ams_second_moment(state: DataFrame, grid: Grid) -> DataFrame:
    """``f2``: upper median over rows of the mean of x squared, as DOUBLE."""
    rows = state.groupBy("row").agg((F.sum(F.col("x").cast("double") * F.col("x")) / grid.width).alias("m"))
    return rows.agg(F.collect_list("m").alias("v")).select(upper_median(F.col("v")).alias("f2"))


def gated_ams(counted: DataFrame, gate: Grid, grid: Grid, phi: float, family: str = "portable") -> DataFrame:
    """``key``, ``estimate``: keys that a Count-Min gate lets pass, scored by AMS, and
    heavy by that score."""
    rough = with_total(count_min_estimates(counted, count_min(counted, gate, family), gate, family), counted)
    passed = rough.filter(F.col("estimate") >= limit_of(phi)).select("key")
    scored = with_total(ams_estimates(passed, ams(counted, grid, family), grid, family=family), counted)
    return scored.filter(F.col("estimate") >= limit_of(phi)).select("key", "estimate")


def heavy(estimates: DataFrame, counted: DataFrame, phi: float) -> DataFrame:
    """``tag``, ``key``, ``estimate`` of the keys whose estimate is heavy."""
    return with_total(estimates, counted).filter(F.col("estimate") >= limit_of(phi)).drop("n")


def by_partitions(counted: DataFrame, parts: Sequence[int], grid: Grid, signed: bool = False, family: str = "portable") -> DataFrame:
    """The sketch as built on P partitions and merged, for each P (the ``tag``) in one job:
    cells by partition first. A key's hashes are taken once for all P."""
    placed = places(counted, grid, family).drop("tag").withColumn("place", hash_pair(F.lit("part"), F.col("key"), family)["hi"])
    split = placed.withColumn("tag", F.explode(F.array(*map(F.lit, parts)))).withColumn("part", F.pmod("place", "tag"))
    local = split.groupBy("tag", "part", "row", "bucket").agg(F.sum(F.col("total") * F.col("sign") if signed else F.col("total")).alias("cell"))
    return merge(local.drop("part"))


def by_partition(counted: DataFrame, parts: int, grid: Grid, signed: bool = False, family: str = "portable") -> DataFrame:
    """The same for one number of partitions, with tag 0."""
    return by_partitions(counted, [parts], grid, signed, family).withColumn("tag", F.lit(0))


def sketch_of(stream: DataFrame, grid: Grid, family: str = "portable") -> DataFrame:
    """Count-Min cells of a raw stream."""
    return count_min(frequencies(stream), grid, family)


def _batch_signs(hashes: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """+1 or -1 of each key hash for copies ``first`` to ``last``: the top bit of a
    multiply-xorshift mix of hash and copy number."""
    copy = (np.arange(first, last, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = hashes[:, None] ^ copy[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return np.where(mixed >> np.uint64(63), np.int8(1), np.int8(-1))


def ams_batched(counted: DataFrame, grid: Grid, seed: int = 0) -> DataFrame:
    """``row``, ``copy``, ``x`` for grids of many copies: sign matrices over Arrow batches,
    of which each partition yields only its sums, instead of a row for each key and copy."""
    copies = grid.rows * grid.width

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(copies, np.int64)
        for batch in batches:
            hashes, totals = batch["h"].to_numpy(np.int64).view(np.uint64), batch["total"].to_numpy(np.int64)
            for at in range(0, copies, 1 << 10):
                last = min(copies, at + (1 << 10))
                for part in range(0, len(batch), 1 << 10):
                    signs = _batch_signs(hashes[part : part + (1 << 10)], at, last, seed)
                    sums[at:last] += totals[part : part + (1 << 10)] @ signs.astype(np.int64)
        number = np.arange(copies)
        yield pd.DataFrame({"row": number // grid.width, "copy": number % grid.width, "x": sums})

    hashed = counted.select(F.xxhash64("key").alias("h"), "total")
    return merge_ams(hashed.mapInPandas(of, "row int, copy int, x long"))


def ams_batched_estimates(keys: DataFrame, state: DataFrame, grid: Grid, seed: int = 0) -> DataFrame:
    """``key``, ``estimate`` from a state of ``ams_batched``, which has one number for each
    copy and goes to every executor."""
    x = state.orderBy("row", "copy").toPandas()["x"].to_numpy(np.int64)
    if len(x) != grid.rows * grid.width:
        raise ValueError("the state is not of this grid")
    sent = keys.sparkSession.sparkContext.broadcast(x)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = batch["h"].to_numpy(np.int64).view(np.uint64)
            means = np.zeros((len(batch), grid.rows), np.int64)
            for row in range(grid.rows):
                for at in range(0, grid.width, 1 << 10):
                    first, last = row * grid.width + at, row * grid.width + min(grid.width, at + (1 << 10))
                    means[:, row] += _batch_signs(hashes, first, last, seed).astype(np.int64) @ sent.value[first:last]
            means = np.trunc(means / grid.width).astype(np.int64)
            yield pd.DataFrame({"key": batch["key"], "estimate": np.sort(means, axis=1)[:, grid.rows // 2]})

    return keys.select("key", F.xxhash64("key").alias("h")).mapInPandas(of, "key string, estimate long")
