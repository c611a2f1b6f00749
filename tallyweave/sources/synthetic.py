"""Zipf streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Exponents, keys and total weight of the skew experiments. The
#: published skew results hold ranks up to 50,000 only.
EXPONENTS, KEYS, TOTAL, KEPT = (0.6, 0.8, 1.0, 1.2, 1.5), 1_000_000, 44_367_267, 50_000


def tag(exponent: float) -> str:
    """1.0 as ``10``, 0.6 as ``06``."""
    return f"{exponent:.1f}".replace(".", "")


def zipf_stream(spark: SparkSession, exponent: float, keys: int = KEYS, total: int = TOTAL, keep_top: int | None = None) -> DataFrame:
    """``key``, ``weight``, ``ord``: rank i gets total / (i**exponent * H), rounded, H
    being the sum of i**-exponent over all keys; zeros are dropped. Nothing is random."""
    ranks = spark.range(1, keys + 1)
    norm = ranks.agg(F.sum(F.pow(F.col("id").cast("double"), F.lit(-float(exponent)))).alias("h"))
    share = F.lit(float(total)) / (F.pow(F.col("id").cast("double"), F.lit(float(exponent))) * F.col("h"))
    kept = ranks if keep_top is None else ranks.filter(F.col("id") <= keep_top)
    rows = kept.crossJoin(F.broadcast(norm))  # one row
    return rows.select(F.concat(F.lit("synth_"), F.col("id").cast("string")).alias("key"), F.round(share).cast("long").alias("weight"), F.col("id").alias("ord")).filter("weight > 0")
