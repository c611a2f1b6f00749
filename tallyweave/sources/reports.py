"""Reports and metrics on disk."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str) -> None:
    """One CSV file with a header, quotes doubled; for reports of bounded size."""
    report.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_report(spark: SparkSession, path: str, schema: str = "key string, total_views long") -> DataFrame:
    """A report with its keys unquoted."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(path)


def write_stream(stream: DataFrame, path: str) -> None:
    stream.write.mode("overwrite").parquet(path)


def upsert_metrics(metrics: DataFrame, path: str, keys: Sequence[str] = ("algorithm",)) -> None:
    """Replaces the rows with the same ``keys`` (``algorithm`` and parameters) as one in
    ``metrics`` and keeps all others. Only the algorithms in ``metrics`` are rewritten."""
    spark, new = metrics.sparkSession, metrics
    try:
        old = spark.read.schema(metrics.schema).parquet(path)
    except AnalysisException:  # the first write
        old = None
    if old is not None:
        mine = metrics.select("algorithm").distinct()
        same = reduce(Column.__and__, (old[k].eqNullSafe(metrics[k]) for k in keys))
        new = old.join(mine, "algorithm", "left_semi").join(metrics, same, "left_anti").unionByName(metrics)
    writer = new.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("algorithm").parquet(path)


def write_comparison(metrics: DataFrame, folder: str, keys: Sequence[str] = ("algorithm",)) -> None:
    """Upserts ``metrics`` into a table, and writes it as one CSV for each algorithm and one
    of all, for comparison."""
    upsert_metrics(metrics, f"{folder}/metrics", keys)
    whole = metrics.sparkSession.read.schema(metrics.schema).parquet(f"{folder}/metrics").select(*metrics.columns)
    whole.coalesce(1).write.mode("overwrite").option("header", True).partitionBy("algorithm").csv(f"{folder}/by_algorithm")
    write_report(whole.orderBy(*keys), f"{folder}/comparison")


def as_text(metrics: DataFrame) -> DataFrame:
    """Metrics as lines ``name: value``, one text for each row."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in metrics.columns]
    return metrics.select(F.concat_ws("\n", *parts).alias("report"))


def inspect(df: DataFrame, rows: int = 20) -> tuple[str, list, int]:
    """Schema, first rows and count."""
    return df.schema.treeString(), df.take(rows), df.count()
