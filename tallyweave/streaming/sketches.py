"""Summaries of unbounded streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweave.functions.sizing import Grid
from tallyweave.operators import linear
from tallyweave.operators.counters import MisraGries


def streaming_count_min(stream: DataFrame, grid: Grid, family: str = "portable") -> DataFrame:
    """Cells of an unbounded stream; run it in update or complete mode. The state is one
    number for each cell that was touched."""
    placed = linear.places(stream.select("key", F.col("weight").alias("total")), grid, family)
    return placed.groupBy("tag", "row", "bucket").agg(F.sum("total").alias("cell"))


def windowed_frequencies(stream: DataFrame, time: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """``start, end, key, total`` of each window, final once the watermark passes it."""
    windows = F.window(time, length, slide) if slide else F.window(time, length)
    found = stream.withWatermark(time, late).groupBy(windows.alias("w"), "key").agg(F.sum("weight").alias("total"))
    return found.select("w.start", "w.end", "key", "total")


def streaming_misra_gries(stream: DataFrame, capacity: int, parts: int = 8) -> DataFrame:
    """``part, key, estimate`` after each batch (update mode): a Misra-Gries summary for each
    of ``parts`` hash parts of the keys, carried from batch to batch as its counters."""
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")

    def of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        summary = MisraGries(capacity)
        if state.exists:
            keys, counts = state.get
            for k, c in zip(keys, counts, strict=True):
                summary.update(k, c)
        for batch in batches:
            for k, w in zip(batch["key"].tolist(), batch["weight"].tolist(), strict=True):
                summary.update(k, w)
        kept = sorted((k, e) for k, e, _ in summary.entries())
        state.update(([k for k, _ in kept], [e for _, e in kept]))
        yield pd.DataFrame({"part": key[0], "key": [k for k, _ in kept], "estimate": [e for _, e in kept]})

    rows = stream.select(part.alias("part"), "key", "weight")
    return rows.groupBy("part").applyInPandasWithState(
        of, "part int, key string, estimate long", "keys array<string>, counts array<long>", "update", GroupStateTimeout.NoTimeout
    )
