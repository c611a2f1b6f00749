"""Exact frequencies, heavy hitters and top keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequencies(stream: DataFrame) -> DataFrame:
    """``key``, ``total``: the weight of each key."""
    return stream.groupBy("key").agg(F.sum("weight").alias("total"))


def total_weight(counted: DataFrame, weight: str = "total") -> DataFrame:
    """One row, ``n``: all weight; 0 if there is none."""
    return counted.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n"))


def limit_of(phi: float | Column, n: Column | str = "n") -> Column:
    """Least weight of a heavy key: phi * n rounded up."""
    n = F.col(n) if isinstance(n, str) else n
    phi = F.lit(float(phi)) if isinstance(phi, (int, float)) else phi
    return F.ceil(phi * n.cast("double")).cast("long")


def with_total(df: DataFrame, counted: DataFrame, weight: str = "total") -> DataFrame:
    """Adds ``n`` to every row."""
    return df.crossJoin(F.broadcast(total_weight(counted, weight)))  # one row


def heavy_hitters(counted: DataFrame, phi: float) -> DataFrame:
    """``key``, ``total`` of the keys with at least ceil(phi * n)."""
    return with_total(counted, counted).filter(F.col("total") >= limit_of(phi)).select("key", "total")


def top_k(counted: DataFrame, k: int, by: str = "total") -> DataFrame:
    """The k first by weight; equal weights by key."""
    return counted.orderBy(F.desc(by), F.asc("key")).limit(k)


def diagnose(true_heavy: DataFrame, counted: DataFrame, phi: float) -> DataFrame:
    """Heavy keys of a baseline held against a stream: ``never`` (key unseen),
    ``below`` (seen, but not heavy there) or ``heavy``."""
    here = with_total(true_heavy.select("key", F.col("total").alias("baseline_total")), counted)
    joined = here.join(counted.select("key", "total"), "key", "left")
    state = F.when(F.col("total").isNull(), "never").when(F.col("total") < limit_of(phi), "below").otherwise("heavy")
    return joined.select("key", "baseline_total", F.coalesce("total", F.lit(0)).alias("stream_total"), state.alias("state"))


def verified(candidates: DataFrame, counted: DataFrame, phi: float) -> DataFrame:
    """Heavy hitters among candidate keys, by their exact weight. With candidates from
    a summary that misses no heavy key, these are all heavy hitters."""
    chosen = with_total(counted, counted).join(candidates.select("key").distinct(), "key", "left_semi")
    return chosen.filter(F.col("total") >= limit_of(phi)).select("key", "total")
