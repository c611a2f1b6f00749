"""Tables as weighted streams: ``key``, ``weight`` and ``ord``, the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places of the words of a document in ``ord``.
WORDS = 1 << 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores if the input has fewer splits than there are cores, as
    one small file has; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stream(df: DataFrame, key: Column, weight: Column | int = 1, order: Column | None = None) -> DataFrame:
    """A stream from any table. Rows without key or weight are left out; a negative
    weight raises an error, as the summaries count insertions only."""
    if isinstance(weight, int):
        weight = F.lit(weight).cast("long")
    else:
        bad = F.raise_error(F.lit("negative weight")).cast("long")
        weight = F.when(weight < 0, bad).otherwise(weight.cast("long"))
    order = F.lit(0) if order is None else order
    rows = df.select(key.cast("string").alias("key"), weight.alias("weight"), order.cast("long").alias("ord"))
    return rows.filter("key IS NOT NULL AND weight IS NOT NULL")


def words(df: DataFrame, text: str = "text", number: Column | None = None) -> DataFrame:
    """The words of a text column, each of weight 1, in order of row number and place. Row
    numbers beyond 2**39 and texts of over ``WORDS`` words have no place in ``ord``: an error."""
    found = df.select((F.lit(0) if number is None else number).alias("n"), F.posexplode(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("at", "key"))
    n = F.col("n").cast("long")
    fits = F.coalesce((F.abs(n) < (1 << 39)) & (F.col("at") < WORDS), F.lit(True))
    place = F.when(fits, n * WORDS + F.col("at")).otherwise(F.raise_error(F.lit("no place in the order of the stream")).cast("long"))
    return found.select("key", F.lit(1).cast("long").alias("weight"), place.alias("ord"))


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    return words(spread(table(spark, folder, "documents").select("doc_id", "text")), number=F.col("doc_id"))


def conversation_words(spark: SparkSession, folder: str) -> DataFrame:
    """In order of conversation, turn and place; turns beyond 1,024 mix with the next one's."""
    return words(table(spark, folder, "conversations"), number=F.col("conv_id") * 1024 + F.col("turn"))


def page_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted by a rule, from 0 to 6."""
    return stream(table(spark, folder, "pages"), F.regexp_extract("url", "://([^/]+)", 1), F.col("page_id") % 7, F.col("page_id"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    return stream(table(spark, folder, "events"), F.col("user_id"), 1, F.col("event_id"))


def typed_users(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted by the event's value, rounded half away from zero."""
    return stream(table(spark, folder, "events"), F.concat("event_type", F.col("user_id").cast("string")), F.round("value"), F.col("event_id"))


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    order = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    return stream(spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")), F.col("l_suppkey"), F.col("l_quantity"), order)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    order = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    return stream(table(spark, folder, "lineitem"), F.col("l_partkey"), F.col("l_quantity"), order)
