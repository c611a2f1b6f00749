"""Counter summaries: Misra-Gries, Space-Saving and Lossy Counting.

A stream is folded where it lies: each partition sums its keys by blocks of Arrow batches
and merges each block into a summary of bounded size, whatever the cluster; what partitions
yield are relations that merge by DataFrame operations. Only a caller that asks for the
result of arrivals one by one has the stream dealt and sorted by ``ord``. Forms that need
no fold are here too.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.hashing import hash_pair
from tallyweave.functions.prefix import prefix_sums
from tallyweave.functions.sizing import ENTRY_BYTES
from tallyweave.operators.exact import limit_of, with_total


class MisraGries:
    """At most ``capacity`` counters, none above its key's weight. Counters are held
    with an offset that all lose together, and a heap finds those that reach it."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.gone, self.total = capacity, 0, 0
        self.raised: dict[str, int] = {}
        self.queue: list[tuple[int, str]] = []

    def update(self, key: str, weight: int = 1) -> None:
        if weight < 0:
            raise ValueError("negative weight")
        self.total += weight
        if not weight:
            return
        if key in self.raised:
            self.raised[key] += weight
        elif len(self.raised) < self.capacity:
            self._add(key, weight)
        else:
            step = min(weight, self._least() - self.gone)
            self.gone += step
            while self.queue and self._least() <= self.gone:
                del self.raised[heapq.heappop(self.queue)[1]]
            if weight > step:
                self._add(key, weight - step)

    def _add(self, key: str, weight: int) -> None:
        self.raised[key] = self.gone + weight
        heapq.heappush(self.queue, (self.gone + weight, key))

    def _least(self) -> int:
        while self.raised[self.queue[0][1]] != self.queue[0][0]:
            key = self.queue[0][1]
            heapq.heapreplace(self.queue, (self.raised[key], key))
        return self.queue[0][0]

    def estimate(self, key: str) -> int:
        return self.raised.get(key, self.gone) - self.gone

    def entries(self) -> Iterator[tuple[str, int, int]]:
        """(key, estimate, 0)."""
        return ((k, v - self.gone, 0) for k, v in self.raised.items())

    def floor(self) -> int:
        """Most weight that a key without a counter can have lost here."""
        return self.gone


class SpaceSaving:
    """At most ``capacity`` counters, none below its key's weight. A new key takes the
    place, and the count, of the smallest by (count, key)."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.total = capacity, 0
        self.counts: dict[str, tuple[int, int]] = {}
        self.queue: list[tuple[int, str]] = []

    def update(self, key: str, weight: int = 1) -> None:
        if weight < 0:
            raise ValueError("negative weight")
        self.total += weight
        if not weight:
            return
        if key in self.counts:
            count, error = self.counts[key]
            self.counts[key] = count + weight, error
        elif len(self.counts) < self.capacity:
            self.counts[key] = weight, 0
            heapq.heappush(self.queue, (weight, key))
        else:
            least, old = self._least()
            del self.counts[old]
            self.counts[key] = least + weight, least
            heapq.heapreplace(self.queue, (least + weight, key))

    def _least(self) -> tuple[int, str]:
        while self.counts[self.queue[0][1]][0] != self.queue[0][0]:
            key = self.queue[0][1]
            heapq.heapreplace(self.queue, (self.counts[key][0], key))
        return self.queue[0]

    def estimate(self, key: str) -> int:
        return self.counts.get(key, (0, 0))[0]

    def entries(self) -> Iterator[tuple[str, int, int]]:
        """(key, estimate, error); at least estimate - error is sure."""
        return ((k, c, e) for k, (c, e) in self.counts.items())

    def floor(self) -> int:
        return self._least()[0] if len(self.counts) == self.capacity else 0


class LossyCounting:
    """Counters with the error they may have missed; after each window of ``window``
    units those that cannot matter go."""

    def __init__(self, window: int):
        if window < 1:
            raise ValueError("the window must be positive")
        self.window, self.total = window, 0
        self.counts: dict[str, tuple[int, int]] = {}

    def update(self, key: str, weight: int = 1) -> None:
        if weight < 0:
            raise ValueError("negative weight")
        if not weight:
            return
        bucket = self.total // self.window + 1
        count, error = self.counts.get(key, (0, bucket - 1))
        self.counts[key] = count + weight, error
        before, self.total = self.total, self.total + weight
        if self.total // self.window > before // self.window:
            now = self.total // self.window
            self.counts = {k: v for k, v in self.counts.items() if v[0] + v[1] > now}

    def estimate(self, key: str) -> int:
        return self.counts.get(key, (0, 0))[0]

    def entries(self) -> Iterator[tuple[str, int, int]]:
        """(key, estimate, error); at most estimate + error."""
        return ((k, c, e) for k, (c, e) in self.counts.items())

    def floor(self) -> int:
        return self.total // self.window


SUMMARY = "part long, key string, estimate long, error long, floor long, part_total long"


def fold_ordered(stream: DataFrame, make: Callable[[], object], parts: int = 1) -> DataFrame:
    """``SUMMARY``: arrivals one by one, as the algorithms are published: a summary for each
    of ``parts`` partitions, dealt by a hash of ``ord`` and read in its order. ``floor`` is
    what a key without an entry may have, or have lost, in that part."""
    part = F.pmod(hash_pair(F.lit("part"), F.col("ord"))["hi"], F.lit(parts))
    dealt = stream.select(part.alias("part"), "ord", "key", "weight").repartition(parts, "part").sortWithinPartitions("part", "ord", "key")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, state = None, None

        def done() -> pd.DataFrame:
            rows = pd.DataFrame(state.entries(), columns=["key", "estimate", "error"])
            return rows.assign(part=part, floor=state.floor(), part_total=state.total)

        for batch in batches:
            for p, key, weight in zip(batch["part"].tolist(), batch["key"].tolist(), batch["weight"].tolist(), strict=True):
                if p != part:
                    if state is not None:
                        yield done()
                    part, state = p, make()
                state.update(key, weight)
        if state is not None:
            yield done()

    return dealt.mapInPandas(of, SUMMARY)


class Block:
    """Keys with estimate and error as columns, which takes in a block of summed rows at a
    time. Each kind says what a new key may have missed (``unseen``) and what goes
    afterwards (``trim``)."""

    def __init__(self, size: int):
        if size < 1:
            raise ValueError("the size must be positive")
        self.size, self.total, self.floor = size, 0, 0
        self.rows = pa.table({"key": pa.array([], pa.string()), "w": pa.array([], pa.int64()), "e": pa.array([], pa.int64()), "old": pa.array([], pa.int64())})

    def absorb(self, block: pa.Table) -> None:
        """A block of ``key``, ``w``."""
        weight = pc.sum(block["w"]).as_py() or 0
        if weight:
            if pc.min(block["w"]).as_py() < 0:
                raise ValueError("negative weight")
            zeros = pa.array(np.zeros(len(block), np.int64))
            both = pa.concat_tables([self.rows, pa.table({"key": block["key"], "w": block["w"], "e": zeros, "old": zeros})])
            met = both.group_by("key", use_threads=False).aggregate([("w", "sum"), ("e", "sum"), ("old", "max")])
            estimate, error, old = (met[c].to_numpy() for c in ("w_sum", "e_sum", "old_max"))
            new = old == 0
            missed = self.unseen()
            self.total += weight
            self.trim(met["key"], estimate + missed[0] * new, error + missed[1] * new)

    def unseen(self) -> tuple[int, int]:
        """What a new key adds to its estimate, and its error."""
        return 0, 0

    def trim(self, keys: pa.ChunkedArray, estimate: np.ndarray, error: np.ndarray) -> None:
        raise NotImplementedError

    def keep(self, keys: pa.ChunkedArray, estimate: np.ndarray, error: np.ndarray, which: np.ndarray) -> None:
        kept = keys.filter(pa.array(which))
        self.rows = pa.table({"key": kept, "w": estimate[which], "e": error[which], "old": np.ones(len(kept), np.int64)})

    def table(self) -> pa.Table:
        return self.rows


class MisraGriesBlock(Block):
    """Merges a block as Misra-Gries summaries merge: if more than ``size`` keys are left,
    all lose the largest that is too many. ``floor`` is all that was taken off."""

    def trim(self, keys: pa.ChunkedArray, estimate: np.ndarray, error: np.ndarray) -> None:
        if len(estimate) > self.size:
            cut = int(np.partition(estimate, -self.size - 1)[-self.size - 1])
            self.floor += cut
            estimate = estimate - cut
        self.keep(keys, estimate, error, estimate > 0)


class SpaceSavingBlock(Block):
    """Keeps the ``size`` largest by estimate. A new key may have had the ``floor``, the
    largest that was ever left out; it counts in its estimate and as its error."""

    def unseen(self) -> tuple[int, int]:
        return self.floor, self.floor

    def trim(self, keys: pa.ChunkedArray, estimate: np.ndarray, error: np.ndarray) -> None:
        which = np.ones(len(estimate), bool)
        if len(estimate) > self.size:
            order = np.lexsort((np.arange(len(estimate)), -estimate))
            which[order[self.size :]] = False
            self.floor = max(self.floor, int(estimate[order[self.size]]))
        self.keep(keys, estimate, error, which)


class LossyCountingBlock(Block):
    """``size`` is the window: after a block all keys go whose estimate and error are within
    the number of full windows so far."""

    def unseen(self) -> tuple[int, int]:
        return 0, self.total // self.size

    def trim(self, keys: pa.ChunkedArray, estimate: np.ndarray, error: np.ndarray) -> None:
        self.floor = self.total // self.size
        self.keep(keys, estimate, error, estimate + error > self.floor)


#: Rows that are summed before they meet the summary.
ROWS = 1 << 17


def fold(stream: DataFrame, kind: type[Block], size: int) -> DataFrame:
    """``SUMMARY``: one summary for each partition of the stream as it lies, without a
    shuffle or a sort. The bounds of a summary hold for any order of its rows, so a block of
    ``ROWS`` rows may be summed by key first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = kind(size), []

        def flush() -> None:
            if held:
                state.absorb(pa.Table.from_batches(held).group_by("key", use_threads=False).aggregate([("weight", "sum")]).rename_columns(["key", "w"]))
                held.clear()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS:
                flush()
        flush()
        rows, context = state.table(), TaskContext.get()
        n = len(rows)
        same = lambda x: pa.array(np.full(n, x, np.int64))
        out = pa.table({"part": same(context.partitionId() if context else 0), "key": rows["key"], "estimate": rows["w"], "error": rows["e"], "floor": same(state.floor), "part_total": same(state.total)})
        yield from out.combine_chunks().to_batches()

    return stream.select("key", "weight").mapInArrow(of, SUMMARY)


def misra_gries(stream: DataFrame, capacity: int, parts: int | None = None) -> DataFrame:
    """``SUMMARY`` of the partitions as they lie, or of ``parts`` ordered ones."""
    return fold(stream, MisraGriesBlock, capacity) if parts is None else fold_ordered(stream, lambda: MisraGries(capacity), parts)


def space_saving(stream: DataFrame, capacity: int, parts: int | None = None) -> DataFrame:
    return fold(stream, SpaceSavingBlock, capacity) if parts is None else fold_ordered(stream, lambda: SpaceSaving(capacity), parts)


def lossy_counting(stream: DataFrame, window: int, parts: int | None = None) -> DataFrame:
    return fold(stream, LossyCountingBlock, window) if parts is None else fold_ordered(stream, lambda: LossyCounting(window), parts)


def merge_misra_gries(summaries: DataFrame, capacity: int) -> DataFrame:
    """``key``, ``estimate``: counters of a key added up; beyond ``capacity`` of them all
    lose the first that is too many, and those without anything left go."""
    added = summaries.groupBy("key").agg(F.sum("estimate").alias("estimate"))
    extra = added.orderBy(F.desc("estimate")).limit(capacity + 1).agg(F.count("*").alias("c"), F.min("estimate").alias("m"))
    cut = extra.select(F.when(F.col("c") > capacity, F.col("m")).otherwise(0).alias("cut"))
    lowered = added.crossJoin(F.broadcast(cut)).select("key", (F.col("estimate") - F.col("cut")).alias("estimate"))  # one row
    return lowered.filter("estimate > 0")


def merge_upper(summaries: DataFrame) -> DataFrame:
    """``key``, ``estimate``, ``error``: an upper bound from Space-Saving parts: a part
    without an entry counts with its floor."""
    floors = summaries.select("part", "floor").distinct().agg(F.coalesce(F.sum("floor"), F.lit(0)).alias("all"))
    added = summaries.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("estimate", "error", "floor")))
    missed = F.col("all") - F.col("floor")
    return added.crossJoin(F.broadcast(floors)).select("key", (F.col("estimate") + missed).alias("estimate"), (F.col("error") + missed).alias("error"))


def _floor_and_total(summaries: DataFrame) -> DataFrame:
    """One row: what a key without any entry may have, and all weight."""
    each = summaries.select("part", "floor", "part_total").distinct()
    return each.agg(F.coalesce(F.sum("floor"), F.lit(0)).alias("floor"), F.coalesce(F.sum("part_total"), F.lit(0)).alias("part_total"))


def one_part(summaries: DataFrame, capacity: int) -> DataFrame:
    """Space-Saving parts as one part of ``SUMMARY``, cut to the ``capacity`` largest."""
    upper, sums = merge_upper(summaries), _floor_and_total(summaries)
    first = upper.orderBy(F.desc("estimate"), F.asc("key")).limit(capacity + 1)
    place = F.row_number().over(Window.orderBy(F.desc("estimate"), F.asc("key")))  # capacity + 1 rows
    placed = first.withColumn("place", place)
    cut = placed.agg(F.max(F.when(F.col("place") > capacity, F.col("estimate"))).alias("cut"))
    kept = placed.filter(F.col("place") <= capacity).crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(sums))  # one row each
    floor = F.greatest("floor", F.coalesce("cut", F.lit(0)))
    return kept.select(F.lit(0).cast("long").alias("part"), "key", "estimate", "error", floor.alias("floor"), "part_total")


def one_lossy_part(summaries: DataFrame) -> DataFrame:
    """Lossy Counting parts as one part of ``SUMMARY``."""
    whole = merge_lossy(summaries).crossJoin(F.broadcast(_floor_and_total(summaries)))  # one row
    return whole.filter(F.col("upper") > F.col("floor")).select(F.lit(0).cast("long").alias("part"), "key", "estimate", "error", "floor", "part_total")


def misra_gries_offline(counted: DataFrame, capacity: int) -> DataFrame:
    """A Misra-Gries summary of exact weights in one step, whatever their order."""
    return merge_misra_gries(counted.select("key", F.col("total").alias("estimate")), capacity)


def misra_gries_parts(counted: DataFrame, capacity: int, by: list[str]) -> DataFrame:
    """``by, key, estimate``: the same for each value of ``by``; the window that finds what
    all lose keeps ``capacity + 1`` rows of each."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), F.asc("key")))
    extra = counted.select(*by, "key", "total").withColumn("place", place).filter(F.col("place") <= capacity + 1)
    cuts = extra.filter(F.col("place") == capacity + 1).select(*by, F.col("total").alias("cut"))
    lowered = extra.join(cuts, by, "left").withColumn("estimate", F.col("total") - F.coalesce("cut", F.lit(0)))
    return lowered.filter("estimate > 0").select(*by, "key", "estimate")


def space_saving_offline(counted: DataFrame, capacity: int) -> DataFrame:
    """``key, estimate, error``: a Space-Saving summary of exact weights in one step: the
    ``capacity`` largest, equal ones by key."""
    return counted.orderBy(F.desc("total"), F.asc("key")).limit(capacity).select("key", F.col("total").alias("estimate"), F.lit(0).cast("long").alias("error"))


def merge_lossy(summaries: DataFrame) -> DataFrame:
    """``key, estimate, error, upper``: Lossy Counting parts added up; a part without an
    entry may have lost its floor."""
    merged = merge_upper(summaries.withColumn("estimate", F.col("estimate") + F.col("error")))
    return merged.select("key", (F.col("estimate") - F.col("error")).alias("estimate"), "error", F.col("estimate").alias("upper"))


def with_bounds(summary: DataFrame, kind: str) -> DataFrame:
    """Adds ``guaranteed``, the weight that a key surely has, and ``upper``, the most it can
    have, to entries of a kind: Space-Saving's estimates are the upper end, those of Lossy
    Counting the lower one."""
    if kind == "space_saving":
        return summary.withColumn("guaranteed", F.col("estimate") - F.col("error")).withColumn("upper", F.col("estimate"))
    if kind in ("lossy_counting", "misra_gries"):
        return summary.withColumn("guaranteed", F.col("estimate")).withColumn("upper", F.col("estimate") + F.col("error"))
    raise ValueError(f"no bounds for {kind}")


def arrival_pool(stream: DataFrame, make: Callable[[], object], share: float) -> DataFrame:
    """``key``: keys whose estimate, when they arrived, reached ``share`` of the stream so
    far, from a summary that sees arrivals one by one in the order of ``ord``. The order is
    the point of it, so one task reads the stream; its state is bounded."""
    dealt = stream.select("ord", "key", "weight").repartition(1).sortWithinPartitions("ord", "key")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, pool, n = make(), set(), 0
        for batch in batches:
            for key, weight in zip(batch["key"].tolist(), batch["weight"].tolist(), strict=True):
                state.update(key, weight)
                n += weight
                if state.estimate(key) >= share * n:
                    pool.add(key)
        yield pd.DataFrame({"key": sorted(pool)}, dtype=object)

    return dealt.mapInPandas(of, "key string")


def lossy_counting_unique(stream: DataFrame, window: int | Mapping[int, int], shift: int = 10) -> DataFrame:
    """``key``, ``estimate`` (and ``tag``, if windows come by tag): Lossy Counting of a stream
    in which each key comes once. The last pruning decides, so a key stays if its weight plus
    the windows full when it came exceed those full at the end. What came before a key is
    summed once for all windows."""
    ranged = stream.withColumn("range", F.shiftright("ord", shift))
    running = prefix_sums(ranged, [], "range", ["ord", "key"], "weight", "before", 63 - shift)
    windows = {0: window} if isinstance(window, int) else dict(window)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(w).alias("window")) for t, w in windows.items())))
    kept = with_total(running, stream, "weight").withColumn("w", each).filter(
        F.col("weight") + F.floor(F.col("before") / F.col("w.window")) > F.floor(F.col("n") / F.col("w.window"))
    )
    return kept.select(*(["w.tag"] if not isinstance(window, int) else []), "key", F.col("weight").alias("estimate"))


def lower_limit(phi: float, epsilon: float) -> Column:
    """Least estimate that counts as heavy where estimates miss up to epsilon * n."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0.0), F.lit(phi - epsilon)) * F.col("n").cast("double")).cast("long"))


def heavy_lower(summary: DataFrame, counted: DataFrame, phi: float, epsilon: float) -> DataFrame:
    """Keys that may be heavy, from estimates that are never too high."""
    return with_total(summary, counted).filter(F.col("estimate") >= lower_limit(phi, epsilon)).select("key", "estimate")


def heavy_upper(summary: DataFrame, counted: DataFrame, phi: float) -> DataFrame:
    """Keys that may be heavy, from estimates that are never too low."""
    return with_total(summary, counted).filter(F.col("estimate") >= limit_of(phi)).select("key", "estimate")


def added(summaries: DataFrame) -> DataFrame:
    """``key``, ``estimate``: entries of a key added up over the parts."""
    return summaries.groupBy("key").agg(F.sum("estimate").alias("estimate"))


def memory_bytes(entries: DataFrame, kind: str, slots: int = 0) -> DataFrame:
    """One row, ``entries`` and the ``bytes`` they take, two for each character of a key."""
    each = F.lit(ENTRY_BYTES[kind]) + 2 * F.length("key")
    return entries.agg(F.count("*").alias("entries"), (F.lit(8 * slots) + F.coalesce(F.sum(each), F.lit(0))).cast("long").alias("bytes"))

