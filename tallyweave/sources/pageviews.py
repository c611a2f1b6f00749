"""Page view dumps: lines of at least six fields between blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files, compressed or not, one ``value`` for each line."""
    return spark.read.text(path)


def parse_pageviews(lines: DataFrame, value: str = "value") -> DataFrame:
    """``project, page, access, agent, views, key`` from the lines that have six fields,
    a whole number of views in the fifth, and a page other than ``-``."""
    fields = F.split(F.trim(F.regexp_replace(value, r"[\x20\x09-\x0D]+", " ")), " ")
    named = lines.select(fields.alias("f")).filter(F.size("f") >= 6)
    rows = named.select(
        *(F.col("f")[i].alias(name) for i, name in enumerate(("project", "page", "access", "agent"))),
        F.expr("try_cast(f[4] AS BIGINT)").alias("views"),
    )
    return rows.filter("views IS NOT NULL AND page <> '-'").withColumn("key", F.concat_ws("/", "project", "page"))
