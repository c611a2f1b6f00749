"""Running sums that do not put all rows of a key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a bucket's number that one level of sums takes, and bits that buckets may have.
FANOUT, BITS = 15, 60


def _starts(sums: DataFrame, keys: list[str], bucket: str, bits: int) -> DataFrame:
    """``keys, bucket, _start``: what lies before each bucket, from one row for each
    (``bucket``, ``_sum``). Up to ``2**FANOUT`` buckets of a parent meet in one task; parents
    are summed the same way, so the last window has as many rows at most."""
    ahead = Window.partitionBy(*keys, "_parent").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_sum").over(ahead), F.lit(0))
    if bits <= FANOUT:
        return sums.withColumn("_parent", F.lit(0)).select(*keys, bucket, before.alias("_start"))
    inner = sums.withColumn("_parent", F.shiftright(bucket, FANOUT)).withColumn("_inner", before)
    above = inner.groupBy(*keys, "_parent").agg(F.sum("_sum").alias("_sum")).withColumnRenamed("_parent", "_above")
    parents = _starts(above, keys, "_above", bits - FANOUT).select(*keys, F.col("_above").alias("_parent"), F.col("_start").alias("_outer"))
    return inner.join(parents, [*keys, "_parent"]).select(*keys, bucket, (F.col("_inner") + F.col("_outer")).alias("_start"))


def prefix_sums(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str, name: str, bits: int = BITS) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the rows before in the key's order.

    ``bucket``, a BIGINT of ``bits`` bits, must refine the order (all rows of a lower bucket
    come first). Sums of buckets are accumulated in levels, rows only inside their bucket.
    """
    keys = list(keys)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    starts = _starts(sums, keys, bucket, bits)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return df.join(starts, [*keys, bucket]).select(*df.columns, running.alias(name))
